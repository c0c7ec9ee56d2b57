import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from landgraph.llm import merkle as M

SCHEMA = "doc_id long, lang string, leaf string, root string, n long, pos string, g string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels, and the siblings (side, digest) of every leaf, None where a node is alone."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for row in levels[:-1]:
            path.append(("<" if i % 2 else ">", row[i ^ 1]) if i ^ 1 < len(row) else None)
            i //= 2
        paths.append(path)
    return levels[-1][0], paths


def by_hand(rows):
    groups = {}
    for i, g, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, outer = tree([trees[g][0] for g in order])
    out = []
    for g, upper in zip(order, outer, strict=True):
        for (has, i, leaf), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            whole = path + upper
            out.append((i if has else None, g, leaf, trees[g][0], root, h(*(s[1] for s in whole if s))))
    return sorted(map(repr, out))


@pytest.mark.parametrize("levels,strip", [(1, 1), (4, 1), (5, 2), (6, 4), (7, 3)])
def test_traversal(levels, strip):
    for n in {1, 2, 3, 2**levels // 2 + 1, 2**levels - 1, 2**levels}:
        if n > 2**levels:
            continue
        leaves = [h(str(k)) for k in range(n)]
        height = (n - 1).bit_length()
        root, paths = tree(leaves)
        got = list(M.traverse([bytes.fromhex(x) for x in leaves], height, strip))
        assert got[0][0].hex() == root and all(r is None for r, _ in got[1:])
        assert [[(e[:1].decode(), e[1:].hex()) if len(e) > 1 else None for e in p] for _, p in got] == paths


def test_subtrees_are_small_and_take_in_one_leaf_a_path(monkeypatch):
    made, most = [], []
    new, step = M._Subtree.__init__, M._Subtree.step
    monkeypatch.setattr(M._Subtree, "__init__", lambda self, *a: (new(self, *a), made.append(self))[0])
    monkeypatch.setattr(M._Subtree, "step", lambda self: (step(self), most.append(sum(map(len, self.nodes)) + len(self.stack)))[0])
    steps = []
    for _ in M.traverse([bytes(32)] * 256, 8, 2):
        steps.append(len(most))
    assert max(most) <= 2 * 2**2 + 8  # nodes of two levels, and a stack
    assert all(b - a <= 3 for a, b in zip(steps, steps[1:], strict=False))  # a leaf for each desired subtree, none at once


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_against_brute_force(spark, levels):
    r = random.Random(levels)
    rows = [(i * 7 % 199, r.choice(["en", "en", "en", "de", None, ""]), h(str(i))) for i in range(199)]
    rows += [(None, "en", h("x")), (None, None, h("y")), (3, "zz", h("z")), (5, "en", h("tie")), (5, "en", h("tie")), (-4, "de", h("w"))]
    frame = spark.createDataFrame([(i, g, x, "mine", 1, "p", "q") for i, g, x in rows], SCHEMA).repartition(5)
    got = M.manifest(frame, levels=levels).withColumn("folded", M.fold("leaf", "path")).withColumn("proof", M.proof_digest("path"))
    assert got.columns == ["doc_id", "lang", "leaf", "n", "pos", "g", "subroot", "root", "path", "folded", "proof"]
    got = got.collect()
    assert all(x.folded == x.root and (x.n, x.pos, x.g) == (1, "p", "q") for x in got)
    assert sorted(repr((x.doc_id, x.lang, x.leaf, x.subroot, x.root, x.proof)) for x in got) == by_hand(rows)


def test_one_row_and_none(spark):
    one = M.manifest(spark.createDataFrame([(1, None, h("a"))], "doc_id long, lang string, leaf string"))
    row = one.withColumn("proof", M.proof_digest("path")).first()
    assert (row.subroot, row.root, row.path, row.proof) == (h("a"), h("a"), [], h())
    assert M.manifest(one.select("doc_id", "lang", "leaf").limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.manifest(spark.range(1))


def test_leaves(spark):
    text = "ä" * 200_000
    frame = spark.createDataFrame([(1, text, None), (None, "", "a:b")], "a long, b string, c string")
    got = frame.select(M.leaf_hash("a", "b", "c").alias("x")).collect()
    assert [x.x for x in got] == [h("1:1", f"400000:{text}", "-"), h("-", "0:", "3:a:b")]


def test_query_finds_what_was_tampered(spark, tmp_path):
    import zlib

    import duckdb

    docs = [(i, f"text {i}" if i % 5 else None, ["en", "de", None][i % 3], "s", None if i % 4 == 0 else i) for i in range(60)] + [(None, None, None, None, None), (8, "again", "en", "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op12_merkle_manifest(spark, str(tmp_path))
    rows = got.collect()
    bad = {d[0] for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None}
    assert bad and {x.doc_id for x in rows if not x.verified} == bad
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(M.OP12_SQL)
    at = [[c[0] for c in found.description].index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(x[k] for k in at)) for x in found.fetchall())
    assert got.where(F.col("verified") != (F.col("folded_root") == F.col("root"))).count() == 0
