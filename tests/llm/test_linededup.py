import random

import pytest

from landgraph.llm import linededup as L

SCHEMA = "doc_id long, text string, kept string, lines string"


def by_hand(docs, threshold=0.8):
    seen, out = [], {}
    for key, text in sorted(docs):
        kept, lines = [], (text or "").split("\n")
        for i, line in enumerate(lines):
            if not line.strip(" "):
                continue
            s = {w for w in line.lower().split(" ") if w}
            if not any(t == line or len(s & u) >= threshold * len(s | u) - 1e-9 for t, u in seen):
                kept.append(i)
            seen.append((line, s))
        out[key] = (0 if text is None else len(lines), kept, None if text is None else "\n".join(x for i, x in enumerate(lines) if i in kept or not x.strip(" ")))
    return out


def case(seed, docs=60, words=40, near=0.5, longest=14):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "Été", "A", "a"]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(1, longest))] for _ in range(12)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(r.randrange(0, 7)):
            w = list(r.choice(base)) if r.random() < near else [r.choice(vocabulary) for _ in range(r.randrange(1, longest))]
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            lines.append(r.choice(["", " "]) + r.choice([" ", "  "]).join(w) if r.random() < 0.9 else r.choice(["", "  "]))
        rows.append((i * 7 % 1000, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed,first,kw", [(1, 16, {}), (2, 2, {}), (3, 1, {"near": 0.95, "longest": 30, "docs": 90}), (4, 1, {"words": 5, "longest": 6}), (5, 3, {"words": 2000, "near": 0.9, "longest": 60})])
def test_against_brute_force(spark, monkeypatch, seed, first, kw):
    monkeypatch.setattr(L, "LONG", first)
    monkeypatch.setattr(L, "LEADERS", 2)
    monkeypatch.setattr(L, "WIDE", 8 if seed % 2 else 48)
    docs = case(seed, **kw) + [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "word " * 30_000 + "\n" + "x\n" * 3000)]
    frame = spark.createDataFrame([(i, t, "clash", None) for i, t in docs], SCHEMA)
    got = {x.doc_id: (x.n_lines, x.kept, x.text) for x in L.dedup_lines(frame).collect()}
    assert got == by_hand(docs)


def test_one_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"t{i}" for i in range(40)]
    docs = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(40), r.randrange(0, 9)):
            w[k] = f"u{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_lines, x.kept, x.text) for x in L.dedup_lines(spark.createDataFrame([(i, t, "", "") for i, t in docs], SCHEMA)).collect()}
    assert got == by_hand(docs)


def test_repeated_rows_null_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "one two three", "", ""), (4, "one two three\nfour", "", ""), (4, "one two three\nfour", "", "")], SCHEMA)
    got = sorted((str(x.doc_id), x.text) for x in L.dedup_lines(frame).collect())
    assert got == [("4", "four"), ("4", "four"), ("None", "one two three")]
    assert L.dedup_lines(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        L.dedup_lines(frame.drop("text"))


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rows = [(4, "one two three\nfour\nfive six"), (4, "seven"), (None, "eight nine\nten"), (None, "eight nine\neleven\ntwelve"), (-(2**63), "thirteen\nten"), (4, None), (4, "")]
    got = [(x.doc_id, x.n_lines, x.text) for x in L.dedup_lines(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()]
    assert sorted(map(str, (i for i, _, _ in got))) == sorted(str(i) for i, _ in rows)
    assert sorted(n for _, n, _ in got) == [0, 1, 1, 2, 2, 3, 3]
    left = sorted(line for _, _, t in got for line in (t or "").split("\n") if line)
    assert left == sorted({line for _, t in rows for line in (t or "").split("\n") if line})
    assert {t for i, _, t in got if i == -(2**63)} <= {"thirteen\nten", "thirteen"}


def test_no_python_in_the_plan(spark):
    plan = L.dedup_lines(spark.createDataFrame([(1, "a b", "", "")], SCHEMA).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_postings_are_narrow(spark):
    """A posting of a short list is five numbers: its line stands there as one, its set's size and its place share one."""
    lines = L.owners(spark.createDataFrame([(1, 0, "a b c d e\nf g h i j"), (2, 0, "k l m n o")], "id long, h long, text string"), 0.8)
    assert lines.count() == lines.select("u").distinct().count() == 3
    places = L._short_postings(lines, "a")
    assert sorted(places.columns) == ["aat", "aodd", "aodd_b", "au", "t"]
    got = L._unpacked(places.join(L._short_postings(lines, "b"), "t")).where("au = bu").select("an", "apos", "bn", "bpos").distinct().collect()
    assert sorted(map(tuple, got)) == [(5, 0, 5, 0), (5, 1, 5, 1)]


def test_distinct_ids_are_told_apart_without_reading_texts(spark):
    from landgraph.llm.common import told_apart

    texts = told_apart(spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"))
    assert texts.where("h <> 0").isEmpty()
    assert "xxhash64" not in texts.select("h")._jdf.queryExecution().optimizedPlan().toString()


def test_kept_numbers_are_put_together_as_bits(spark):
    """The numbers of a document come back sorted, and only words of 64 of them are collected, which a hash aggregate makes."""
    numbers = {(1, 0): [0, 31, 32, 63, 64, 127, 700], (1, 5): [2], (2, 0): list(range(200))}
    rows = spark.createDataFrame([(i, h, n) for (i, h), all_ in numbers.items() for n in reversed(all_)], "id long, h long, no int")
    got = L._numbers_by_document(rows)
    assert dict(got.dtypes)["kept"] == "array<int>"
    assert {(x.id, x.h): x.kept for x in got.collect()} == numbers
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[id" in plan and "bit_or" in plan and "collect_list(no" not in plan
