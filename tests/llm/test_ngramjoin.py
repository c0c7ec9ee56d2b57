import random
import re

import numpy as np
import pytest

from landgraph.llm import ngramjoin as J
from landgraph.llm.components import connected_components

SCHEMA = "doc_id long, text string, id long, key string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(docs, n=5, threshold=0.8):
    sets = {}
    for key, text in docs:
        w = words(text)
        sets[key] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else None
    distinct = {s for s in sets.values() if s}
    near = {s: {t for t in distinct if t is not s and len(s & t) >= threshold * len(s | t) - 1e-9} for s in distinct}
    out = {}
    for key, s in sets.items():
        if not s:
            out[key] = (key, 0, 1)
            continue
        seen, todo = {s}, [s]
        while todo:
            for t in near[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        out[key] = (min(k for k, t in sets.items() if t in seen), len(near[s]), sum(t == s for t in sets.values()))
    return out


def case(seed, groups=8, size=9, length=80):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["Été", "ß", "日本"]
    docs = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 5, 9, length, length * 4]))]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(r.choice([" ", ", "]).join(w).replace("w1", r.choice(["w1", "W1"])))
    r.shuffle(docs)
    return [(i * 13 % 9973, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,block,kw", [(1, 1000, {}), (2, 3, {}), (3, 1000, {"groups": 2, "size": 60}), (4, 7, {"groups": 2, "size": 60, "length": 30})])
def test_against_brute_force(spark, monkeypatch, seed, block, kw):
    monkeypatch.setattr(J, "BLOCK_DOCS", block)
    docs = case(seed, **kw) + [(10_000, None), (10_001, "..."), (10_002, ""), (10_003, "one two"), (10_004, "One, two"), (10_005, "long " * 30_000)]
    got = J.near_duplicates(spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], SCHEMA).repartition(3)).collect()
    assert {x.doc_id: (x.class_id, x.n_links, x.n_copies) for x in got} == by_hand(docs) and len(got) == len(docs)


def test_hashes_are_those_of_words():
    a, b = J.shingles("The end, of the LINE is here"), J.shingles(" the\tend of the line is... here")
    assert np.array_equal(a, b) and len(a) == 3
    assert len(J.shingles("a a a a a a a a")) == 1 and len(J.shingles("ab c")) == 1 and not np.array_equal(J.shingles("ab c"), J.shingles("a bc"))
    assert not np.array_equal(J.shingles("a b c d e"), J.shingles("b a c d e"))


def test_posterior_bounds():
    r = random.Random(1)
    for n in (16, 64, 128):
        m = J.least_matches(n)
        draws = sum(r.betavariate(m, n - m + 2) >= 0.8 for _ in range(20_000))  # one match fewer is dropped
        assert m > 0 and draws <= 2
    assert J.least_matches(128) < 0.7 * 128
    assert [J.least_matches(n) for n in range(16, 129, 16)] == sorted(J.least_matches(n) for n in range(16, 129, 16))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2001 + i) for i in range(50)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {x.id: x.label for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k not in loops}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_repeated_rows_null_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(3, "a b c d e f", 0, ""), (3, "a b c d e f", 0, ""), (None, "x y", 0, ""), (1, "a b c d e f", 0, "")], SCHEMA)
    got = sorted((str(x.doc_id), str(x.class_id), x.n_links, x.n_copies) for x in J.near_duplicates(frame).collect())
    assert got == [("1", "1", 0, 3), ("3", "1", 0, 3), ("3", "1", 0, 3), ("None", "None", 0, 1)]
    assert J.near_duplicates(frame.limit(0)).collect() == []


@pytest.mark.parametrize("copies,shingles", [(2, 40), (3, 5), (3, 1)])
def test_few_documents_dealt_over_many_blocks(spark, monkeypatch, copies, shingles):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", shingles)
    docs = [(100 * g + i, " ".join(f"w{g}x{k}" for k in range(60)) + f" end{i}") for g in range(8) for i in range(copies)]
    got = J.near_duplicates(spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], SCHEMA)).collect()
    assert {x.doc_id: (x.class_id, x.n_links, x.n_copies) for x in got} == by_hand(docs) and len(got) == len(docs)


def test_two_blocks_one_of_them_empty():
    sets = [J.shingles(" ".join(f"w{k}" for k in range(60)) + end) for end in ("", " x", " y")]
    assert list(J.compare(sets, None)) == [(0, 1), (0, 2), (1, 2)] and list(J.compare(sets, 1)) == [(0, 1), (0, 2)]
    assert list(J.compare(sets, 0)) == list(J.compare(sets, 3)) == list(J.compare([], None)) == []


def test_ids_that_are_null_or_repeat_with_other_texts(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(-(2**63), "a b c d e f"), (None, "a b c d e f"), (None, f"{long} x"), (None, f"{long} y"), (5, f"{long} z"), (5, "of its own"), (6, "of its own")]
    got = J.near_duplicates(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)).collect()
    assert sorted((str(x.doc_id), x.n_links, x.n_copies) for x in got) == sorted([(str(-(2**63)), 0, 2), ("None", 0, 2), ("None", 2, 1), ("None", 2, 1), ("5", 2, 1), ("5", 0, 2), ("6", 0, 2)])
    assert len({x.class_id for x in got if x.n_links == 0 and x.doc_id not in (5, 6)}) == 1 and len({x.class_id for x in got if x.n_links == 2}) == 1
    assert {x.class_id for x in got if x.doc_id == 6} == {5} and [x.n_links for x in got if x.doc_id == 5 and x.n_copies == 1] == [2]
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)


@pytest.mark.parametrize("block", [1000, 7])
def test_what_shares_buckets_only_is_pruned_before_clusters_are_made(spark, monkeypatch, block):
    """Half of each text is boilerplate: nearly all share a bucket with another, few are similar."""
    monkeypatch.setattr(J, "BLOCK_DOCS", block)
    r = random.Random(5)
    common = " ".join(f"c{k}" for k in range(60))
    docs = []
    for i in range(60):
        own = " ".join(f"d{i}x{k}" for k in range(40))
        docs += [(10 * i + c, f"{common} {own}" + f" end{c}" * c) for c in range(r.choice([1, 1, 2, 4]))]
    frame = spark.createDataFrame([(i, t, 1, "") for i, t in docs], SCHEMA)
    made = {}
    plain = J.links
    monkeypatch.setattr(J, "links", lambda *a: made.setdefault("links", plain(*a)))
    got = J.near_duplicates(frame).collect()
    assert {x.doc_id: (x.class_id, x.n_links, x.n_copies) for x in got} == by_hand(docs)
    stars = [x for x in J._sets(frame.select("doc_id", "text"), J.N, J._WORD_BYTES).collect()]
    shared = {b for x in stars for b in x.buckets if sum(b in y.buckets for y in stars) > 5}
    assert shared  # buckets of many
    assert all(u // 10 == v // 10 for u, v in made["links"].collect())
