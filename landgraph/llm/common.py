"""Shared plumbing: tables in the cluster's shared folder, batch bounds, column checks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_local_root: str | None = None
#: Stands for a null id (see ``told_apart``).
NO_ID = -(2**63)
_kept: dict[Hashable, Any] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``, as in tests) may leave it unset; it then gets
    a temporary folder that goes with the process.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="landgraph-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: this cuts the lineage, and
    a lost executor costs only what has not been read from the table yet.  The shuffles behind it,
    whose files no one reads again, are dropped when it is written.  ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 512, bytes_: int = 16 << 20) -> None:
    """Lower the Arrow batch limits so that a Python worker holds a few MB of text at a time."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if not now.isdigit() or int(now) > bytes_:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps for its next tasks, as a tokenizer and its memory of words.

    Workers live on from one operator to the next, so there is one such thing at a time: what an earlier operator left goes first.
    """
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Give back what this Python worker keeps, and the memory that its allocators hold of earlier tasks."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def need(df: DataFrame, *columns: str) -> None:
    """Raise early, with the names, when input columns are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def told_apart(texts: DataFrame) -> DataFrame:
    """From rows of (id, text, ...), whose ids are integers or null, make ids that are never null and
    add ``h``, so that rows of one id and ``h`` have one text; ``real_id`` gives the id back.

    ``h`` is 0 where all rows of an id have the same text, which costs narrow rows next to nothing,
    else a hash of the text.  A null id becomes ``NO_ID`` with an even hash, one that is really
    ``NO_ID`` has an odd one.
    """
    text = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    given = F.col("id").cast("long")
    texts = texts.withColumns({"id": F.coalesce(given, F.lit(NO_ID)), "_none": given.isNull()})
    repeated = stage(texts.groupBy("id").count().where((F.col("count") > 1) | (F.col("id") == NO_ID)).select("id"), "repeated-ids")
    if repeated.isEmpty():  # as a rule; so far no text was read
        return texts.withColumn("h", F.lit(0).cast("long")).drop("_none")
    again = texts.join(repeated.where(F.col("id") != NO_ID), "id", "left_semi")
    many = again.groupBy("id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("id", F.lit(True).alias("_many"))
    many = stage(many, "repeated-ids")
    odd = F.lit(1).cast("long")
    least = F.when(F.col("id") == NO_ID, F.when(F.col("_none"), text.bitwiseAND(F.lit(-2).cast("long"))).otherwise(text.bitwiseOR(odd)))
    if many.isEmpty():
        return texts.withColumn("h", F.coalesce(least, F.lit(0).cast("long"))).drop("_none")
    return texts.join(many, "id", "left").withColumn("h", F.coalesce(least, F.when(F.col("_many"), text), F.lit(0).cast("long"))).drop("_many", "_none")


def real_id(id_: str = "id", h: str = "h") -> Column:
    """The id that ``told_apart`` was given."""
    return F.when((F.col(id_) != NO_ID) | (F.col(h) % 2 != 0), F.col(id_))


def gapless_rank(df: DataFrame, group: list[str], ids: list[str], groups: int, rows: int, out: str = "rank") -> DataFrame:
    """Add ``out``: 0, 1, ... within each ``group``, ordered by a hash part of ``ids``, then ``ids``.

    A group is ranked in parts of some ten thousand rows, so one that holds most of the table is
    still dealt over all tasks; the counts of the parts, summed in order, give each part's start.
    ``groups`` and ``rows`` are the (rough) numbers of both.  ``df`` is read twice.
    """
    parts = max(rows // 50_000, 4 * shuffle_partitions(df.sparkSession)) // max(1, min(groups, 64)) + 1
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*ids), F.lit(parts)).cast("int"))
    ranked = dealt.withColumn("_n", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*ids)))
    before = (
        dealt.groupBy(*group, "_part").count()
        .withColumn("_before", F.sum("count").over(W.partitionBy(*group).orderBy("_part")) - F.col("count"))
        .drop("count")
    )
    return ranked.join(before, [*group, "_part"]).withColumn(out, (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_before")
