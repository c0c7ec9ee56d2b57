"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's ``docs``; all but the last return the columns of ``docs``.  No stage
drops rows for any reason but its own decision, so nulls, empty texts and repeated rows pass
through to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgraph.llm import decontam, linededup, ngramjoin, packing, toxicity
from landgraph.llm.common import stage, told_apart

#: Not expressible: the model of the first stage and the packing of the last.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels that are not held out, does not reject."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are similar to an earlier line of any of them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = linededup.dedup_lines(docs, carry=tuple(rest)).select("doc_id", "text", *rest)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id (and hash, where an id has several texts) of each class of near
    duplicates; of repeated rows one."""
    rows = told_apart(docs.select(F.col("doc_id").alias("id"), "text", F.struct(*docs.columns).alias("row")))
    first = ngramjoin.classes(rows.select("id", "h", "text")).where("id = first.id and h = first.h").select("id", "h").distinct()
    return rows.join(first, ["id", "h"], "left_semi").select("row.*").dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    keys = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    index = decontam.build_index(keys, "key")
    found = decontam.contamination(index, decontam.find(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "key")
    bad = found.where("contaminated").select(F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_h"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    out = packing.best_fit_pack(docs, packing.tokenizer_path(), payload={"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
