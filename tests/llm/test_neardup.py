import random
import re

import numpy as np
import pytest

from landgraph.llm import neardup as D
from landgraph.llm import ngramjoin as J

SCHEMA = "doc_id long, text string, id long, h string"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand(docs):
    sets = [shingle_set(t) for _, t in docs]
    near = [[k for k, b in enumerate(sets) if a and b and 100 * len(a & b) >= 85 * len(a | b)] for a in sets]
    out = []
    for k, (i, _) in enumerate(docs):
        seen, todo = {k}, [k]
        while todo:
            for j in set(near[todo.pop()]) - seen:
                seen.add(j)
                todo.append(j)
        least = min((docs[j][0] for j in seen), key=lambda x: (x is not None, x or 0))
        out.append((i, len(sets[k]), least, i == least))
    return sorted(map(repr, out))


def got(spark, docs):
    frame = spark.createDataFrame([(i, t, 7, "clash") for i, t in docs], SCHEMA).repartition(3)
    return sorted(repr(tuple(x)) for x in D.near_duplicate_components(frame).collect())


def case(seed, groups, size, length, edits=(0, 0, 1, 2, 4, 9)):
    r = random.Random(seed)
    known = [f"w{i}" for i in range(900)] + ["Été", "ß-x", "日本", "a.b"]
    docs = []
    for _ in range(groups):
        base = [r.choice(known) for _ in range(r.choice([3, 5, 9, length, length * 4]))]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.choice(edits)):
                w[r.randrange(len(w))] = r.choice(known)
            docs.append(r.choice([" ", "\t", "\n\n", "\r\n "]).join(w).replace("w1", r.choice(["w1", "W1"])))
    r.shuffle(docs)
    return [(i * 31 % 9973, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,block,kw", [(1, 1000, dict(groups=12, size=9, length=150)), (2, 4, dict(groups=3, size=60, length=150)), (3, 9, dict(groups=1, size=300, length=200, edits=range(12)))])
def test_against_brute_force(spark, monkeypatch, seed, block, kw):
    monkeypatch.setattr(J, "BLOCK_DOCS", block)
    docs = case(seed, **kw)
    docs += [(10_000, None), (10_001, " \n"), (10_002, ""), (10_003, "one two"), (10_004, "One\ttwo"), (10_005, "one, two"), (10_006, "many words " * 50_000), (10_007, "many words " * 50_001)]
    assert got(spark, docs) == by_hand(docs)


def test_boilerplate_is_told_apart_and_copies_in_it_are_found(spark, monkeypatch):
    """All share 60 words of 100: their buckets are hot, and the lists of rare shingles find what is similar."""
    monkeypatch.setattr(J, "BLOCK_DOCS", 8)
    used = []
    rarest = J._rarest
    monkeypatch.setattr(J, "_rarest", lambda *a: (used.append(1), rarest(*a))[1])
    r = random.Random(5)
    shared = [f"s{k}" for k in range(60)]
    docs = [(k, " ".join(shared + [f"v{r.randrange(10**6)}" for _ in range(40)])) for k in range(150)]
    docs += [(1000 + k, docs[k][1] + " end") for k in range(0, 150, 9)] + [(2000, docs[3][1].replace("s10 ", "t10 "))]
    r.shuffle(docs)
    want = by_hand(docs)
    assert got(spark, docs) == want and used
    assert sum("False" in x for x in want) >= 17


def test_repeated_ids_none_and_no_rows(spark):
    long = " ".join(f"w{k}" for k in range(80))
    docs = [(None, long + " p"), (5, long + " q"), (5, "other words of five here"), (5, "other words of five here"), (None, "Other words of five here"), (4, long), (4, "x"), (None, None), (-(2**63), "alone")]
    assert got(spark, docs) == by_hand(docs)
    empty = D.near_duplicate_components(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    with pytest.raises(ValueError):
        D.near_duplicate_components(spark.range(1))


def test_threshold_is_exact():
    a = np.arange(0, 185, dtype=np.uint64)
    assert J.similar(np.arange(200, dtype=np.uint64), np.arange(170, dtype=np.uint64), 0.85)
    assert not J.similar(np.arange(200, dtype=np.uint64), np.arange(169, dtype=np.uint64), 0.85)
    assert J.similar(a, np.r_[a[:170], np.arange(1000, 1015, dtype=np.uint64)], 0.85) and not J.similar(a, np.r_[a[:169], np.arange(1000, 1016, dtype=np.uint64)], 0.85)


def test_words_end_at_ascii_white_space_only():
    assert len(J.shingles("a\xa0b c\x1cd e f g h", 5, J._BLANK_BYTES)) == len(shingle_set("a\xa0b c\x1cd e f g h")) == 2
    assert np.array_equal(J.shingles("A, b\tC d É f", 5, J._BLANK_BYTES), J.shingles("a, B c\x0bD É F ", 5, J._BLANK_BYTES))
    assert not np.array_equal(J.shingles("é b c d e", 5, J._BLANK_BYTES), J.shingles("É b c d e", 5, J._BLANK_BYTES))


def test_query_agrees_with_sql(spark):
    import duckdb

    tables = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    want = con.execute(D.OP11_SQL).fetchall()
    assert sorted(map(tuple, D.op11_minhash_neardup(spark, tables).collect())) == sorted(want)
