"""Components of near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation.

Words are what lies between ASCII white space, A-Z lower-cased; a document's set holds its distinct runs of
five words, or all its words as one run.  Two documents are linked where 100 * intersection >= 85 * union.

1. Documents of equal sets are one vertex.  128 MinHash values in 32 bands of four give its buckets: two sets of similarity 0.85
   share none with a probability of 6e-11.
2. Candidates of a bucket are compared by 16 MinHash values at a time, and go as soon as the posterior probability
   that they reach the threshold is below ``MISS``, the chosen probability of a miss (``ngramjoin.links``: first with the leader of a
   bucket, then only what differs from it with the rest).
3. What survives is confirmed on the full sets: each link's two texts meet in one task, a leader of many in many tasks.
4. Confirmed links make components, and all survivors clusters.  A cluster of one component is done, which groups of copies of any size are.
   In the others the documents outside of the largest component are compared with all documents of the cluster in blocks of
   bounded size, by the same three steps, so no link between different components is lost.

Only links that connect are kept, one for each document and task, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngramjoin as J
from .common import bounded_batches, need, real_id, shuffle_partitions, stage, told_apart
from .components import connected_components

N, THRESHOLD, MISS = 5, 0.85, 1e-6


def _confirmed(links: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Those of the links (u, v) whose full sets reach the threshold."""

    def judge(both: list, lead: np.ndarray, own: np.ndarray) -> np.ndarray:
        sets: dict[int, np.ndarray] = {}
        out = []
        for a, b in zip(lead.tolist(), own.tolist(), strict=True):
            if a not in sets:
                sets = {a: J.shingles(both[a], n, J._BLANK_BYTES)}
            out.append(J.similar(sets[a], J.shingles(both[b], n, J._BLANK_BYTES), threshold))
        return np.array(out, dtype=bool)

    many = links.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / J.BLOCK_DOCS).alias("tasks"))
    dealt = stage(links.join(many, "v").select("u", "v", F.pmod(F.xxhash64("u"), "tasks").cast("int").alias("dealt")), "dealt-links")
    return J.against_leaders(dealt, texts.withColumnRenamed("text", "payload"), judge)


def _in_blocks(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """(u, v): confirmed links of the blocks in ``rows`` (cluster, i, j, side, id, is_open, text), which come sorted by the
    first five: one to the least of its component for each document, by the pairs of which one is open."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in "uv"])

    def judge(key: list | None, sides: list[int], ids: list[int], opened: list[bool], texts: list[str]) -> tuple[list[int], list[int]]:
        if key is None:
            return [], []
        first = None if key[1] == key[2] else sides.count(0)
        forest = J._Forest(ids)
        for x, y in J.compare([J.shingles(t, n, J._BLANK_BYTES) for t in texts], first, threshold, np.array(opened)):
            forest.join(x, y)
        at = forest.roots()
        keep = [k for k in range(len(ids)) if at[k] != ids[k]]
        return [ids[k] for k in keep], [at[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, ([], [], [], [])
        for batch in batches:
            for *key, side, id_, opened, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in judge(block, *parts)], names=schema.names)
                    block, parts = key, ([], [], [], [])
                for whole, x in zip(parts, (side, id_, opened, text), strict=True):
                    whole.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in judge(block, *parts)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _components(first: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, label) of all vertices (id, size, buckets, sig) that have a confirmed link; ``texts`` (id, text) has each one once."""
    survivors = stage(J.links(first, texts, n, threshold, J._BLANK_BYTES).distinct(), "survivors")
    sure = stage(_confirmed(survivors, texts, n, threshold), "confirmed-links")
    if survivors.join(sure, ["u", "v"], "left_anti").isEmpty():
        return connected_components(sure)
    clusters = connected_components(survivors).withColumnRenamed("label", "cluster")
    parts = connected_components(sure).withColumnRenamed("label", "part")
    placed = clusters.join(parts, "id", "left").select("id", "cluster", F.coalesce("part", "id").alias("part")).join(first.select("id", "size"), "id")
    placed = stage(placed, "clusters")
    sized = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size"))
    most = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("docs", "part", "size")).alias("most"), F.sum("docs").alias("docs"), F.sum("size").alias("size"))
    blocks = lambda docs, size: F.greatest(F.ceil(docs / J.BLOCK_DOCS), F.ceil(size / J.BLOCK_SHINGLES)).cast("int")
    most = most.where("parts > 1").select(
        "cluster",
        F.col("most.part").alias("main"),
        blocks(F.col("docs") - F.col("most.docs"), F.col("size") - F.col("most.size")).alias("opened"),
        blocks(F.col("most.docs"), F.col("most.size")).alias("others"),
    )
    is_open = F.col("part") != F.col("main")
    task = F.explode(J.block_pairs(F.col("opened"), F.col("others"), is_open, F.col("id"))).alias("p")
    rows = stage(placed.join(most, "cluster").select("cluster", "id", is_open.alias("is_open"), task), "open-clusters").join(texts, "id")
    rows = rows.select("cluster", "p.i", "p.j", "p.side", "id", "is_open", "text")
    rows = rows.repartition(shuffle_partitions(first.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "id")
    return connected_components(sure.unionByName(stage(_in_blocks(rows, n, threshold), "confirmed-links")))


def near_duplicate_components(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of documents linked by similarity.

    Returns for each row of ``docs``: ``id_column``, ``n_shingles`` (the size of its set), ``component_id`` (the least id
    that links lead to, its own included) and ``kept`` (whether that is its own).  The threshold is taken to six decimals.

    Null texts, and those without words, have an empty set and are linked with nothing, not even with each other.  Sets are of 64-bit
    hashes of shingles.  Ids are integers.  Rows that repeat an id and its text are copies; rows of one id (or none) with
    other texts are each judged by their own, and a null id is below all others.
    """
    need(docs, id_column, text_column)
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType
    bounded_batches(spark, 256, 4 << 20)
    rows = told_apart(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    vertex = F.when(F.col("h") == 0, F.col("id")).otherwise(F.xxhash64("id", "h"))
    texts = rows.select(vertex.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stage(J._sets(texts, n, J._BLANK_BYTES), "shingle-sets")
    same = (F.any_value(c).alias(c) for c in ("size", "buckets", "sig"))
    owners = stage(sets.where("key is not null").groupBy("key").agg(F.min("id").alias("owner"), *same), "set-owners")
    first = owners.select(F.col("owner").alias("id"), "size", "buckets", "sig")
    once = texts if rows.select("h").where("h <> 0").isEmpty() else texts.dropDuplicates(["id"])
    found = _components(first, once, n, threshold)
    at = owners.select("key", "owner").join(found.withColumnRenamed("id", "owner"), "owner", "left").select("key", F.coalesce("label", "owner").alias("class"))
    real = rows.select(vertex.alias("id"), F.col("id").alias("own"), "h")
    out = sets.select("id", "key", F.col("size").alias("n_shingles")).join(at, "key", "left").withColumn("class", F.coalesce("class", "id"))
    hashed = stage(real.where("h <> 0").distinct(), "named-vertices")
    if hashed.isEmpty():
        least = F.col("class")
    else:
        out = stage(out.join(hashed, "id", "left").withColumns({"own": F.coalesce("own", "id"), "h": F.coalesce("h", F.lit(0).cast("long"))}), "named-components")
        least = out.groupBy("class").agg(F.min(F.struct("own", "h")).alias("first"))
        out, least = out.join(least, "class"), real_id("first.own", "first.h")
        out = out.withColumn("id", real_id("own", "h"))
    named = out.select(F.col("id").cast(kind).alias(id_column), "n_shingles", least.cast(kind).alias("component_id"))
    return named.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def op11_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE least(x.n, y.n) * 100 >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reached AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(x.n, 0) AS n_shingles, coalesce(least(d.doc_id, r.least_id), d.doc_id) AS component_id,
       d.doc_id = coalesce(least(d.doc_id, r.least_id), d.doc_id) AS kept
FROM documents d LEFT JOIN sizes x ON x.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) r ON r.a = d.doc_id
"""
