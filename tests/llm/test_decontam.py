import hashlib
import random
import re
from collections import defaultdict

import pytest

from landgraph.llm import decontam as D

SCHEMA = "doc_id long, text string, n_words long, hits string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(docs, items, n=10):
    grams = defaultdict(set)
    for key, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[k : k + n])].add(str(key))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for g, who in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= who
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed, known=12):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Émile", "x1", "ß", "日本", "A", "b_c", "don't", *(f"w{i}" for i in range(known))]
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 9, 10, 11, 30]) if i % 4 else 25)) for i in range(25)] + [(90, None), (91, "..."), (3, "the of the of the of the of the of the of the of")]
    docs = []
    for i in range(80):
        text = say(r.randrange(0, 60))
        if i % 3 == 0:
            text += " " + (r.choice(items)[1] or "").replace("w", "W")
        if i % 5 == 0:
            w = (r.choice(items)[1] or "").split()
            text += " " + " ".join(w[2:15]) + say(3)
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (102, items[0][1]), (103, (items[4][1] + " ") * 900), (103, (items[4][1] + " ") * 900)], items


@pytest.mark.parametrize("seed,tokens", [(1, D.SEGMENT_TOKENS), (2, 3000), (3, 40)])
def test_against_brute_force(spark, monkeypatch, seed, tokens):
    monkeypatch.setattr(D, "SEGMENT_TOKENS", tokens)
    docs, items = case(seed)
    d = spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], SCHEMA)
    b = spark.createDataFrame([(i, t, "clash") for i, t in items + items[:3]], "item_id long, text string, doc_id string")
    index = D.build_index(d)
    got = sorted(map(tuple, D.contamination(index, D.find(index, b)).collect()), key=str)
    assert got == by_hand(docs, items)
    few = [(7, "of the"), (8, docs[3][1])]  # the index serves another benchmark
    b = spark.createDataFrame(few, "item_id long, text string")
    assert sorted(map(tuple, D.contamination(index, D.find(index, b)).collect()), key=str) == by_hand(docs, few)
    assert index.postings.agg({"n": "sum"}).first()[0] == sum(len(words(t)) for _, t in docs)


def test_many_hits_in_one_document(spark):
    d = spark.createDataFrame([(1, "one two " * 60_000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one")], "item_id long, text string")
    index = D.build_index(d)
    assert tuple(D.contamination(index, D.find(index, b)).first())[:4] == (1, 120_000, 60_000, 1)


def test_query_and_sql_agree(spark, tmp_path):
    import duckdb

    docs, items = case(7, 30)
    docs = [x for k, x in enumerate(docs) if k == 0 or x[0] != docs[k - 1][0]]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items[:-1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = D.op7_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(D.OP7_SQL).fetchall())
    assert any(x.contaminated for x in got) and not all(x.contaminated for x in got)


def test_proximity(spark):
    item = "alpha beta gamma delta"
    texts = ["alpha beta gamma delta", "alpha x beta gamma delta", "delta gamma beta alpha", "alpha beta gamma x x x delta", "alpha beta gamma", "alpha alpha beta gamma"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: [(h["start"], h["end"], h["exact"]) for h in x.hits] for x in D.find_phrases(d, b, 4, slop=1).collect()}
    assert got == {0: [(0, 4, True)], 1: [(0, 5, False)], 2: [(0, 4, False)], 3: [], 4: [], 5: []}


def test_no_rows(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    index = D.build_index(d)
    assert [tuple(x)[:4] for x in D.contamination(index, D.find(index, b)).collect()] == [(1, 2, 0, 0)]
    assert D.find_phrases(d.limit(0), b).collect() == []
