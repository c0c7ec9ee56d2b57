"""Merkle manifests of tables, with a proof for every row.

A group's rows are leaves in the order of their ids.  Every two consecutive nodes become their hash,
a last one alone becomes its own, until one node remains, the group's subroot; the subroots, in the
order of the groups, give the root in the same way.

1. Rows are dealt by ranges of (group, id) and counted; a row's position is its place within its
   range behind those before, so no group is ordered in one task.
2. Aligned blocks of 2^``LEVELS`` leaves are traversed one after the other.  A block's tree is cut into
   strips of ``STRIP`` levels.  For each strip there is the existing subtree, whose nodes the current
   leaf's path needs, and the desired one, which will follow it and takes in one leaf for each path
   that is emitted, so it is complete just when it is needed.  Besides the leaves' digests (32 bytes
   each) a task holds no more than two small subtrees for each strip.
3. The blocks' roots are the leaves of the next round, in blocks again, until each group has one node;
   then the subroots are.  A round has 2^-``LEVELS`` of the rows of the one before.
4. Going down again, each block's proof is appended to those of its leaves, by equi-joins.

A path has an entry for each level: a byte that tells the side of the sibling and its digest, or only the
byte for a node that has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, shuffle_partitions, stage

#: A block has 2^LEVELS leaves, a strip of its tree STRIP levels.
LEVELS, STRIP = 12, 4
_LEFT, _RIGHT, _NONE = b"<", b">", b"-"


def _parent(nodes: list[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in nodes).encode()).digest()


class _Subtree:
    """The nodes of heights ``low`` to ``high`` - 1 above leaves ``start`` .. ``start + 2^high`` - 1, built leaf by leaf."""

    def __init__(self, leaves: list[bytes], low: int, high: int, start: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.next, self.end = start, min(start + (1 << high), len(leaves))
        self.nodes: list[list[bytes]] = [[] for _ in range(high - low)]
        self.stack: list[tuple[int, bytes]] = []
        self.top: bytes | None = None

    def _put(self, height: int, node: bytes) -> None:
        if height >= self.low and height < self.high:
            self.nodes[height - self.low].append(node)
        if height == self.high:
            self.top = node
        else:
            self.stack.append((height, node))

    def step(self) -> None:
        """Take in one leaf, and what it completes."""
        if self.next >= self.end:
            return
        self._put(0, self.leaves[self.next])
        self.next += 1
        while self.stack:
            height = self.stack[-1][0]
            if len(self.stack) > 1 and self.stack[-2][0] == height:
                (_, b), (_, a) = self.stack.pop(), self.stack.pop()
                self._put(height + 1, _parent([a, b]))
            elif self.next == len(self.leaves):  # nothing follows: a node alone goes up
                self._put(height + 1, _parent([self.stack.pop()[1]]))
            else:
                break

    def finish(self) -> _Subtree:
        while self.next < self.end:
            self.step()
        return self


def traverse(leaves: list[bytes], levels: int, strip: int = STRIP) -> Iterator[tuple[bytes | None, list[bytes]]]:
    """(root, path) of each leaf of a tree of ``levels`` in turn; the root comes with the first one only.

    There are at most 2^levels leaves; missing ones are at the end.
    """
    if not levels:
        for leaf in leaves:
            yield leaf, []
        return
    lows = list(range(0, levels, strip))
    spans = [(low, min(low + strip, levels)) for low in lows]
    exist = [_Subtree(leaves, low, high, 0).finish() for low, high in spans]
    desire = [_Subtree(leaves, low, high, 1 << high) if high < levels else None for low, high in spans]
    root = exist[-1].top
    for i in range(len(leaves)):
        for s, (low, high) in enumerate(spans[:-1]):
            if i and not i & ((1 << high) - 1):
                exist[s] = desire[s].finish()  # complete already, but for a last, shorter one
                desire[s] = _Subtree(leaves, low, high, i + (1 << high))
        path = []
        for s, (low, high) in enumerate(spans):
            first = (i >> high) << (high - low)  # the subtree's first node of height low
            for height in range(low, high):
                at = ((i >> height) ^ 1) - (first >> (height - low))
                row = exist[s].nodes[height - low]
                path.append((_LEFT if (i >> height) & 1 else _RIGHT) + row[at] if at < len(row) else _NONE)
        yield root, path
        root = None
        for tree in desire[:-1]:
            tree.step()


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, pos, path, root) of ``nodes`` (g, pos, n, node), n being the number of nodes of g: the path within
    the aligned block of 2^levels nodes and, with the block's first node, the block's root."""
    schema = T.StructType.fromDDL("g string, pos long, path array<binary>, root binary")

    def judge(block: tuple[str, int, int], leaves: list[bytes]) -> Iterator[tuple]:
        g, first, n = block
        for k, (root, path) in enumerate(traverse(leaves, min(levels, (n - 1).bit_length()))):
            yield g, first + k, path, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.binary())), ("root", pa.binary())])
        now, leaves, done = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow.types, strict=True)], schema=arrow)

        for b in batches:
            for g, pos, n, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or (g, pos >> levels) != (now[0], now[1] >> levels):
                    if now is not None:
                        done += judge(now, leaves)
                    if len(done) >= 4096:
                        yield batch()
                        done = []
                    now, leaves = (g, pos, n), []
                leaves.append(node)
        if now is not None:
            done += judge(now, leaves)
            yield batch()

    dealt = nodes.withColumn("_block", F.shiftright("pos", levels))
    dealt = dealt.repartition(shuffle_partitions(nodes.sparkSession), "g", "_block").sortWithinPartitions("g", "_block", "pos")
    return dealt.select("g", "pos", "n", "node").mapInArrow(run, schema)


def placed(rows: DataFrame, order: list[str], group: str = "g") -> DataFrame:
    """``rows`` with ``pos``, their place in the order within their group (from 0), and ``n``, its rows.

    Rows that are equal in ``order`` take any of their places; they are told apart by where they are read.
    ``rows`` has to be a table.
    """
    parts = shuffle_partitions(rows.sparkSession)
    keys = [group, *order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    ranged = stage(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    of = W.partitionBy(group)
    before = F.sum("_rows").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(of).alias("n"))
    within = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order, "_row")) - 1
    ranked = ranged.withColumn("_at", within).join(counts, [group, "_part"])
    return ranked.withColumn("pos", (F.col("_before") + F.col("_at")).cast("long")).drop("_row", "_part", "_at", "_before")


def _trees(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Paths (g, pos, path) of ``nodes`` (g, pos, n, node) to the one node of their group, and these nodes (g, root)."""
    rounds, now = [], nodes
    while True:
        paths = stage(_paths(now, levels), "paths")
        rounds.append(paths)
        blocks = paths.where("root is not null").select("g", F.shiftright("pos", levels).alias("pos"), F.col("root").alias("node"))
        if blocks.where("pos > 0").isEmpty():
            break
        now = blocks.join(blocks.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").select("g", "pos", "n", "node")
    whole = rounds.pop()
    while rounds:
        upper = whole.select("g", F.col("pos").alias("_block"), F.col("path").alias("_upper"))
        lower = rounds.pop().withColumn("_block", F.shiftright("pos", levels))
        whole = lower.join(upper, ["g", "_block"]).select("g", "pos", F.concat("path", "_upper").alias("path"))
    return whole.select("g", "pos", "path"), blocks.select("g", F.col("node").alias("root"))


def _hex(x: str | Column) -> Column:
    return F.lower(F.hex(x))


def _sibling(e: Column) -> Column:
    """The digest of a path's entry in hexadecimal; nothing where there is none."""
    return F.substr(_hex(e), F.lit(3))


def proof_digest(path: str) -> Column:
    """The hash of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, _sibling), ""), 256)


def fold(leaf: str, path: str) -> Column:
    """The root to which a leaf (in hexadecimal) leads by its path."""
    left = _hex(F.lit(_LEFT))

    def up(node: Column, e: Column) -> Column:
        at_left = F.substr(_hex(e), F.lit(1), F.lit(2)) == left
        return F.sha2(F.when(at_left, F.concat(_sibling(e), node)).otherwise(F.concat(node, _sibling(e))), 256)

    return F.aggregate(path, F.col(leaf), up)


def field(column: str | Column) -> Column:
    """A value's part of a leaf: ``-`` for null, else the number of its UTF-8 bytes, a colon and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: str | Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def manifest(rows: DataFrame, group: str = "lang", id_column: str = "doc_id", leaf: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``path``, the siblings of their ``leaf`` (in hexadecimal) up to the root.

    Leaves of a group, null being one and the first, ascend by ``id_column``, null ids first and equal ids by their leaves; rows
    that are equal in both take either place.  Other columns stay.  An empty table has no rows, and no root.
    """
    need(rows, group, id_column, leaf)
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    told = rows.select(key.alias("g"), F.col(id_column).alias("_id"), F.col(leaf).alias("_leaf"), F.struct(*rows.columns).alias("_rest"))
    leaves = stage(placed(stage(told, "leaves"), ["_id", "_leaf"]), "leaves")
    inner, subroots = _trees(leaves.select("g", "pos", "n", F.unhex("_leaf").alias("node")), levels)
    tops = placed(stage(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("root").alias("node")), "subroots"), ["group"])
    tops = stage(tops, "subroots")
    outer, root = _trees(tops.select("g", "pos", "n", "node"), levels)
    outer = tops.join(outer.drop("g"), "pos").join(root.withColumnRenamed("root", "_root"), "g")
    outer = outer.select(F.col("group").alias("g"), F.col("node").alias("_subroot"), "_root", F.col("path").alias("_upper"))
    found = leaves.select("g", "pos", "_rest").join(inner, ["g", "pos"]).join(outer, "g")
    own = [F.col("_rest").getField(c).alias(c) for c in rows.columns if c not in ("subroot", "root", "path")]
    return found.select(*own, _hex("_subroot").alias("subroot"), _hex("_root").alias("root"), F.concat("path", "_upper").alias("path"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each verified against the root, the tampered ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tamper = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    own, after = ("doc_id", "source", "lang"), F.when(tamper, leaf_hash("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    rows = docs.select("doc_id", "lang", leaf_hash(*own, "n_chars", "text").alias("leaf"), after.alias("tampered"))
    out = manifest(rows).withColumn("now", F.coalesce("tampered", "leaf")).withColumn("folded_root", fold("now", "path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text"))
_CRC = """list_reduce(flatten([[ord(c)] || [NULL::INTEGER for k in range(8)] for c in string_split(doc_id::VARCHAR, '')]),
           lambda c, x: CASE WHEN x IS NOT NULL THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295::BIGINT)"""
OP12_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER () AS id, sha256({_LEAF.format("n_chars")}) AS leaf, sha256({_LEAF.format("(n_chars + 1)")}) AS tampered,
         n_chars IS NOT NULL AND xor({_CRC}, 4294967295) % 7 = 0 AS tamper FROM documents),
leaves AS (
  SELECT id, doc_id, lang AS g, leaf, CASE WHEN tamper THEN tampered ELSE leaf END AS now,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows),
inner_nodes AS (
  SELECT 0 AS level, g, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, g, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM inner_nodes WHERE n > 1 GROUP BY g, pos // 2),
subroots AS (
  SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM outer_nodes WHERE n > 1 GROUP BY pos // 2),
steps AS (
  SELECT l.id, x.level, x.h, x.pos % 2 AS at_right FROM leaves l JOIN inner_nodes x ON x.g IS NOT DISTINCT FROM l.g AND x.n > 1 AND x.pos = xor(l.pos // (1 << x.level), 1)
  UNION ALL
  SELECT l.id, 1000 + x.level, x.h, x.pos % 2 FROM leaves l JOIN subroots s ON s.g IS NOT DISTINCT FROM l.g JOIN outer_nodes x ON x.n > 1 AND x.pos = xor(s.pos // (1 << x.level), 1)),
levels AS (
  SELECT l.id, u.level, row_number() OVER (PARTITION BY l.id ORDER BY u.level) AS k FROM leaves l
  JOIN (SELECT DISTINCT g, level FROM inner_nodes WHERE n > 1 UNION ALL SELECT DISTINCT s.g, 1000 + o.level FROM subroots s, outer_nodes o WHERE o.n > 1) u ON u.g IS NOT DISTINCT FROM l.g),
folded AS (
  SELECT id, 0 AS k, now AS h FROM leaves
  UNION ALL
  SELECT f.id, f.k + 1, sha256(CASE WHEN s.at_right = 0 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM folded f JOIN levels v ON v.id = f.id AND v.k = f.k + 1 LEFT JOIN steps s ON s.id = v.id AND s.level = v.level)
SELECT l.doc_id, l.leaf, s.h AS subroot, o.h AS root, sha256(coalesce(p.all_h, '')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM leaves l JOIN subroots s ON s.g IS NOT DISTINCT FROM l.g JOIN (SELECT h FROM outer_nodes WHERE n = 1) o ON true
JOIN (SELECT id, max_by(h, k) AS h FROM folded GROUP BY id) f ON f.id = l.id
LEFT JOIN (SELECT id, string_agg(h, '' ORDER BY level) AS all_h FROM steps GROUP BY id) p ON p.id = l.id
"""
