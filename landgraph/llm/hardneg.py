"""Hard negatives from inverted lists of k-means clusters, exactly.

1. K-means (``pyspark.ml``) is fitted on a sample of ``SAMPLE`` rows; every row is put into the list of its nearest centroid.
   A list's radius, the largest distance of its rows from the centroid, is stored with it.
2. By Cauchy-Schwarz no row of a list scores more than q.c + |q| r for an anchor q, nor less than q.c - |q| r.  An
   anchor visits lists by descending upper bound.  Lists that lie outside of the window of scores it asks for are skipped, and it
   stops when the bound falls strictly below its k-th score so far; equal scores still count, since ties go by id.
3. Lists are visited in rounds, so that Spark does the visits of all anchors at once: the first ``STEPS`` lists of each,
   then, with the scores these leave, the next, and in the last round all that the bounds do not exclude.
4. Lists are split into parts of bounded size and anchors into blocks.  A task multiplies a part with the anchors of a block that visit it,
   and returns the best k for each, so neither a large list nor many anchors come together in one task.

Positives are found by such a search, then the negatives in the windows that the positives' scores open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, need, shuffle_partitions, stage

#: Most lists, rows that they are fitted on, numbers in a part, anchors in a block, lists visited before each look at the bounds.
LISTS, SAMPLE, PART, BLOCK, STEPS = 64, 16_384, 2 << 20, 8_192, (4, 20)
_FOUND = "rid long, t int, score double, id long, other long"


class Lists:
    """Centroids with the radii and sizes of their lists, and the rows (rid, id, label, v, list, part) in these."""

    def __init__(self, rows: DataFrame, lists: int = LISTS, sample: int = SAMPLE):
        """``rows`` (rid, id, label, v) is a table; v are arrays of finite numbers, shorter ones as if zeros followed."""
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
        self.n, self.width = sizes.n, max(1, sizes.d or 0)
        if not self.n:
            return
        padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(self.width) - F.size("v")))
        some = rows.orderBy(F.xxhash64("rid"), "rid").limit(sample).select(array_to_vector(padded).alias("features"))
        model = KMeans(k=max(2, min(lists, self.n // 64)), maxIter=8, seed=11).fit(stage(some, "sample"))
        self.centers = np.array(model.clusterCenters(), dtype=np.float64)
        placed = stage(_assigned(rows.withColumn("v", padded), self.centers), "lists")
        self.radius, self.parts = np.full(len(self.centers), -1.0), np.zeros(len(self.centers), dtype=np.int64)
        most = max(1, min(max(512, self.n // 64), PART // self.width))
        for x in placed.groupBy("list").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row for each list
            self.radius[x.list], self.parts[x.list] = x.r, -(-x.n // most)
        of = F.get(F.lit([int(x) for x in self.parts]), F.col("list"))
        self.rows = placed.withColumn("part", F.pmod(F.xxhash64("rid"), of).cast("int")).drop("away")

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (anchors x lists) of scores, a little wider than rounding needs; NaN for empty lists."""
        mid = q @ self.centers.T
        size = np.linalg.norm(q, axis=1)[:, None]
        away = size * self.radius * (1 + 1e-9) + 1e-9 * (1 + size * np.linalg.norm(self.centers, axis=1))
        away[:, self.radius < 0] = np.nan
        return mid - away, mid + away


def _matrix(v: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1)


def _assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``rows`` with their vectors packed, ``list`` (that of the nearest centroid) and ``away`` (the distance from it)."""
    half = (centers**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
            at = np.argmax(x @ centers.T - half, axis=1).astype(np.int32)
            away = np.linalg.norm(x - centers[at], axis=1)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed, pa.array(at), pa.array(away)], names=["rid", "id", "label", "v", "list", "away"])

    return rows.select("rid", "id", "label", "v").mapInArrow(run, T.StructType.fromDDL("rid long, id long, label long, v binary, list int, away double"))


def visits(lists: Lists, q: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, begin: int, end: int) -> list[np.ndarray]:
    """For each anchor (row of ``q``) the lists to visit among the ``begin``-th to ``end``-th by descending upper bound.

    ``low``, ``high`` and ``kth`` have a column for each of its targets (NaN: none): its window, and its k-th score so far.
    """
    below, above = lists.bounds(q)
    order = np.argsort(-above, axis=1, kind="stable")[:, begin:end]
    below, above = (np.take_along_axis(x, order, axis=1)[:, None, :] for x in (below, above))
    wanted = ((above >= np.fmax(low, kth)[:, :, None]) & (below <= high[:, :, None]) & ~np.isnan(low)[:, :, None]).any(axis=1)
    return [o[w] for o, w in zip(order, wanted, strict=True)]


def best(scores: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best: higher scores first, ties by id, then by row."""
    at = np.arange(len(scores))
    if len(at) > 4 * k:
        at = at[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return at[np.lexsort((others[at], ids[at], -scores[at]))[:k]]


def _targets(arrays: list[list[float]], width: int) -> np.ndarray:
    out = np.full((len(arrays), width), np.nan)
    for k, x in enumerate(arrays):
        out[k, : len(x)] = x
    return out


def _visits(lists: Lists, asking: DataFrame, begin: int, end: int) -> DataFrame:
    """A row for each anchor of ``asking`` and list that it visits now."""
    model = Lists.__new__(Lists)  # what the bounds need, without tables
    model.centers, model.radius = lists.centers, lists.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            low, high, kth = (b.column(k).to_pylist() for k in (4, 5, 6))
            width = max(map(len, low))
            to = visits(model, _matrix(b.column(2).to_pylist()), *(_targets(x, width) for x in (low, high, kth)), begin, end)
            rows = pa.array(np.repeat(np.arange(len(b)), [len(x) for x in to]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), *(c.take(rows) for c in b.columns)], names=["list", *b.schema.names])

    asked = asking.select("rid", "label", "v", "t", "low", "high", "kth")
    return asked.mapInArrow(run, T.StructType([T.StructField("list", T.IntegerType()), *asked.schema.fields]))


def _visited(rows: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each visit for each target, from rows (list, part, block, side, rid, id, label, v, t, low, high, kth) that come
    sorted by the first five, those of a list's part before the anchors that visit it."""

    def judge(part: tuple, anchors: list[tuple], out: list[list]) -> None:
        rids, ids, labels, v = part
        scores = _matrix([a[2] for a in anchors]) @ v.T
        for (rid, label, _, t, low, high, kth), s in zip(anchors, scores, strict=True):
            fits = (labels == label) & (rids != rid) if same else labels != label
            for n, lo, hi, least in zip(t, low, high, kth, strict=True):
                at = np.flatnonzero(fits & (s >= max(lo, least)) & (s <= hi))
                at = at[best(s[at], ids[at], rids[at], k)]
                for whole, x in zip(out, ([rid] * len(at), [n] * len(at), s[at], ids[at], rids[at]), strict=True):
                    whole.extend(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["rid", "t", "score", "id", "other"], (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
        key, rows, part = None, [], None
        for b in batches:
            anchors, out = [], [[] for _ in names]
            for *now, side, rid, id_, label, v, t, low, high, kth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != key:
                    if anchors:
                        judge(part, anchors, out)
                    key, rows, part, anchors = now, [], None, []
                if side == 0:
                    rows.append((rid, id_, label, v))
                elif rows or part:
                    if part is None:
                        own = list(zip(*rows, strict=True))
                        part, rows = (*(np.array(x, dtype=np.int64) for x in own[:3]), _matrix(own[3])), []
                    anchors.append((rid, label, v, t, low, high, kth))
            if anchors:
                judge(part, anchors, out)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return rows.mapInArrow(run, T.StructType.fromDDL(_FOUND))


def search(lists: Lists, anchors: DataFrame, targets: DataFrame, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows for each target (rid, t, low, high) of the anchors (rid, label, v): those of the same label but for the
    anchor itself, or of others, with low <= score <= high, as (rid, t, score, id, other, rank)."""
    spark = anchors.sparkSession
    parts = shuffle_partitions(spark)
    blocks = -(-anchors.count() // BLOCK)
    block = F.pmod(F.xxhash64("rid"), F.lit(max(1, blocks))).cast("int")
    none = F.lit(None)
    held = lists.rows.select("list", "part", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("block"), F.lit(0).alias("side"), "rid", "id", "label", "v")
    held = held.select("*", none.cast("array<int>").alias("t"), *(none.cast("array<double>").alias(c) for c in ("low", "high", "kth")))
    found = None
    for begin, end in zip((0, *STEPS), (*STEPS, len(lists.centers)), strict=True):
        least = F.lit(float("-inf")).alias("kth")
        if found is None:
            state = targets.withColumn("kth", F.lit(float("-inf")))
        else:
            full = found.where(F.col("rank") == k).select("rid", "t", F.col("score").alias("kth"))
            state = targets.join(full, ["rid", "t"], "left").withColumn("kth", F.coalesce("kth", least))
        listed = state.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("t", "low", "high", "kth"))).alias("x"))  # few targets an anchor
        asking = anchors.join(listed, "rid").select("rid", "label", "v", *(F.col("x").getField(c).alias(c) for c in ("t", "low", "high", "kth")))
        now = stage(_visits(lists, asking, begin, end), "visits")
        if now.isEmpty():
            continue
        part = F.explode(F.sequence(F.lit(0), F.get(F.lit([int(x) for x in lists.parts]), F.col("list")) - 1)).alias("part")
        now = now.withColumn("part", part).select("list", "part", block.alias("block"), F.lit(1).alias("side"), "rid", F.lit(None).cast("long").alias("id"), "label", "v", "t", "low", "high", "kth")
        rows = held.unionByName(now).repartition(parts, "list", "part", "block").sortWithinPartitions("list", "part", "block", "side", "rid")
        more = _visited(rows, k, same)
        more = more if found is None else more.unionByName(found.drop("rank"))
        rank = F.row_number().over(W.partitionBy("rid", "t").orderBy(F.desc("score"), "id", "other"))
        found = stage(more.withColumn("rank", rank).where(F.col("rank") <= k), "found")
    return found if found is not None else spark.createDataFrame([], f"{_FOUND}, rank int")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
) -> DataFrame:
    """Hard negatives of those rows that ``is_anchor`` holds for.

    An anchor's positives are the first ``positives`` other rows of its label by inner product, higher scores first, ties by
    smaller id.  For each of them the first ``negatives`` rows of other labels are returned whose score s satisfies
    a p <= b s <= b p, p being the positive's score and (a, b) the ``window``: ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score``, ``negative_score`` (doubles).  Scores are sums of doubles: exact for integers below 2^53.

    Rows with a null id, label or vector, or with a null, NaN or infinite component take no part.  Vectors may differ in length, as if
    zeros followed the shorter.  Rows that repeat an id are rows of their own.  Ids and labels are integers.
    """
    need(rows, id_column, label_column, vector_column)
    bounded_batches(rows.sparkSession, 1024, 16 << 20)
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    ok = rows.where(whole & F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    ok = ok.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    ok = stage(ok.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    lists = Lists(ok)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"
    if not lists.n:
        return rows.sparkSession.createDataFrame([], empty)
    asked = ok.where("anchor").select("rid", F.col("id").alias("anchor_id"))
    anchors = stage(lists.rows.join(asked, "rid").select("rid", "anchor_id", "label", "v"), "anchors")
    all_scores = (F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    near = search(lists, anchors, anchors.select("rid", F.lit(0).alias("t"), *all_scores), positives, same=True)
    near = near.select("rid", F.col("rank").alias("t"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    a, b = window
    windows = near.where("positive_score >= 0").select("rid", "t", least_score(F.col("positive_score"), a, b).alias("low"), F.col("positive_score").alias("high"))
    found = search(lists, anchors, windows, negatives, same=False).select("rid", "t", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(near, ["rid", "t"]).join(anchors.select("rid", "anchor_id"), "rid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def least_score(p: Column, a: int, b: int) -> Column:
    """The least integer s with a p <= b s where p is one (all scores are, then); else a p / b."""
    exact = F.ceil(p * a / b)
    exact = F.when(exact * b < p * a, exact + 1).when((exact - 1) * b >= p * a, exact - 1).otherwise(exact).cast("double")
    return F.when((p == F.floor(p)) & (p < 2**46), exact).otherwise(p * a / b)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    rows = rows.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.when(F.abs(x) < float("inf"), F.floor(x.cast("double") * 256).cast("double"))).alias("embedding"),
    )
    out = hard_negatives(rows, F.col("vec_id") % 100 == 0)
    return out.withColumns({c: F.col(c).try_cast("long") for c in ("positive_score", "negative_score")})


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT a, b, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5
"""
