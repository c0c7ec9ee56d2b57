"""Benchmark decontamination by a positional inverted index of the training documents.

1. ``build_index`` stores the postings of all tokens of all documents once.  Tasks write them in segments
   of some ``SEGMENT_TOKENS`` tokens; a segment has for each of its terms one ascending list of places, each
   the number of the document in the segment and the position in the document in one number.  So the list of
   a frequent term is spread over as many segments as there are, and no text is shuffled.  The index knows
   nothing of a benchmark and serves any number of them.
2. Each window of ``n`` consecutive words of a benchmark item gets its terms ordered from the rarest, by
   their frequency in the index.  A window with a term that never occurs is done with.
3. A window is looked for in the segments that have its rarest term.  There the lists of all terms of the benchmark
   meet it in one task: each less its offset, they are intersected from the shortest on, and what is left begins
   an exact phrase.  Only lists are shuffled, each once; no place and no candidate is a row.
4. With ``slop`` > 0 windows whose terms all occur within n + slop words, in any order, are found as well,
   by the places around those of the rarest term.

Index, benchmark and candidates are tables that are joined by segment and term; nothing of them is sent to
all tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, let_go, need, stage

#: Words of a window, tokens of a segment, windows that a task looks for in a segment.
WINDOW, SEGMENT_TOKENS, TASK_WINDOWS = 10, 2_000_000, 50_000
#: A word is a run of these bytes of UTF-8: 0-9, a-z (A-Z are lower-cased) and all beyond ASCII.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW = ("segment", "document")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Index:
    """``postings`` (segment, term, n, places) of all terms; ``documents`` (segment, document, id, n_words), a row for each."""

    postings: DataFrame
    documents: DataFrame


class _Segment:
    """Postings in the making."""

    def __init__(self, number: int):
        self.number, self.terms, self.ids, self.places, self.n = number, defaultdict(count().__next__), [], [], 0
        self.keys, self.sizes = [], []

    def add(self, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.terms.__getitem__, words), dtype=np.int32, count=len(words)))
        self.places.append(np.arange(len(words), dtype=np.int64) + (len(self.sizes) << 32))
        self.n += len(words)
        self.sizes.append(len(words))

    def batches(self, key_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows of documents, then those of terms."""
        rows, ids = len(self.sizes), np.concatenate([np.empty(0, np.int32), *self.ids])
        yield self._rows(rows, names, document=pa.array(range(rows), pa.int32()), id=pa.array(self.keys, key_type), n=pa.array(self.sizes, pa.int64()))
        places = np.concatenate([np.empty(0, np.int64), *self.places])[np.argsort(ids, kind="stable")]
        at = np.r_[0, np.cumsum(np.bincount(ids, minlength=len(self.terms)))]
        terms = pa.array([t.decode("utf-8", "replace") for t in self.terms], pa.string())
        for a in range(0, len(terms), 50_000):
            b = min(len(terms), a + 50_000)
            part = pa.ListArray.from_arrays(pa.array(at[a : b + 1] - at[a], pa.int32()), pa.array(places[at[a] : at[b]], pa.int64()))
            yield self._rows(b - a, names, term=terms[a:b], n=pa.array(np.diff(at[a : b + 1]), pa.int64()), places=part, id=pa.nulls(b - a, key_type))

    def _rows(self, rows: int, names: list[str], **given: pa.Array) -> pa.RecordBatch:
        kinds = {"segment": pa.int64(), "document": pa.int32(), "term": pa.string(), "n": pa.int64(), "places": pa.list_(pa.int64())}
        given["segment"] = pa.array(np.full(rows, self.number), pa.int64())
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, kinds[c]) for c in names], names=names)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """Store the postings of all tokens of ``docs``, and a row for each of its rows.

    Repeated rows are documents of their own.  Null texts have no words.
    """
    need(docs, id_column, text_column)
    bounded_batches(docs.sparkSession, 256, 4 << 20)
    from pyspark.sql.pandas.types import to_arrow_type

    key_type, most = to_arrow_type(docs.schema[id_column].dataType), SEGMENT_TOKENS
    fields = (("segment", T.LongType()), ("document", T.IntegerType()), ("id", docs.schema[id_column].dataType), ("term", T.StringType()), ("n", T.LongType()), ("places", T.ArrayType(T.LongType())))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        numbers = count(TaskContext.get().partitionId() << 32)
        made = _Segment(next(numbers))
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made.add(words_of(text))
                made.keys.append(key)
                if made.n >= most:
                    yield from made.batches(key_type, schema.names)
                    made = _Segment(next(numbers))
        if made.sizes:
            yield from made.batches(key_type, schema.names)
        del made
        let_go()

    rows = stage(docs.select(id_column, text_column).mapInArrow(run, schema), "postings", compression="zstd")
    documents = rows.where("term is null").select(*_ROW, "id", F.col("n").alias("n_words"))
    return Index(rows.where("term is not null").select("segment", "term", "n", "places"), documents)


def windows(benchmark: DataFrame, n: int = WINDOW, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(terms, at): each window of the items, with the (item_id, place) where it occurs.

    An item of fewer words than ``n``, but not none, is one window.  Repeated items are one.
    """
    need(benchmark, item_column, item_text)
    low = F.translate(item_text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col(item_column).alias("item_id"), F.regexp_extract_all(low, F.lit(_WORD), 0).alias("w")).where("size(w) > 0").distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    cut = items.select("item_id", "w", F.explode(starts).alias("place")).select("item_id", "place", F.slice("w", F.col("place") + 1, F.lit(n)).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set(F.struct("item_id", "place")).alias("at"))


def _ordered(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """(window, need): the (frequency, offset, term) of each window, from the rarest; only of those whose terms all occur."""
    frequency = postings.groupBy("term").agg(F.sum("n").alias("frequency"))
    rows = phrases.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(frequency, "term")
    found = rows.groupBy("window", "size").agg(F.sort_array(F.collect_list(F.struct("frequency", "offset", "term"))).alias("need"))
    return found.where(F.size("need") == F.col("size")).select("window", "need")


def _present(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """Those of the places (segment, term, place) that the lists of the index hold: a list is intersected once with all that is wanted of it."""
    lists = wanted.groupBy("segment", "term").agg(F.collect_set("place").alias("wanted"))
    asked = postings.join(wanted.select("term").distinct(), "term", "left_semi")  # spares the long lists of other terms a shuffle
    return lists.join(asked, ["segment", "term"]).select("segment", "term", F.explode(F.array_intersect("places", "wanted")).alias("place"))


def _first_places(needs: DataFrame, postings: DataFrame) -> DataFrame:
    """(window, segment, place, offset) of the rarest term of each window."""
    first = needs.select("window", F.col("need")[0]["term"].alias("term"), F.col("need")[0]["offset"].alias("offset"))
    return first.join(postings.select("segment", "term", "places"), "term").select("window", "segment", "offset", F.explode("places").alias("place"))


def _position(place: Column) -> Column:
    return place.bitwiseAND(F.lit(0xFFFFFFFF))


def _starts(lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(window, segment, start) in one segment: from its lists (segment, term, places) and the windows (window, need)
    whose rarest term it has, the places that are in all lists of a window, less the offsets."""
    windows, starts = [], []
    if len(lists) and len(asked):
        of = dict(zip(lists["term"], lists["places"], strict=True))
        for window, need_ in zip(asked["window"], asked["need"], strict=True):
            found = sorted(((of.get(r["term"]), r["offset"]) for r in need_), key=lambda x: -1 if x[0] is None else len(x[0]))
            if found[0][0] is None:
                continue
            left = found[0][0]
            left = left[(left & 0xFFFFFFFF) >= found[0][1]] - found[0][1]
            for places, offset in found[1:]:
                at = np.searchsorted(places, left + offset)
                left = left[places[np.minimum(at, len(places) - 1)] == left + offset]
                if not len(left):
                    break
            windows.append(np.full(len(left), window))
            starts.append(left)
    out = pd.DataFrame({c: np.concatenate(x).astype(np.int64) if x else np.empty(0, dtype=np.int64) for c, x in (("window", windows), ("start", starts))})
    return out.assign(segment=int(lists["segment"].iloc[0]) if len(lists) else 0)[["window", "segment", "start"]]


def _exact(needs: DataFrame, postings: DataFrame) -> DataFrame:
    """(window, segment, start): the places where whole windows begin."""
    first = needs.select("window", F.col("need")[0]["term"].alias("term"), F.transform("need", lambda r: F.struct(r["term"].alias("term"), r["offset"].alias("offset"))).alias("need"))
    parts = -(-needs.count() // TASK_WINDOWS) or 1
    asked = postings.select("segment", "term").join(first, "term").select("segment", F.pmod(F.xxhash64("window"), F.lit(parts)).cast("int").alias("part"), "window", "need").toDF("to_segment", "to_part", "window", "need")
    lists = postings.select("segment", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "term", "places")
    both = lists.groupBy("segment", "part").cogroup(asked.groupBy("to_segment", "to_part"))
    return both.applyInPandas(_starts, "window long, segment long, start long")


def _near(needs: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """(window, segment, start, end) of the spans of at most size + ``slop`` words that hold all terms of a window as often as it does."""
    reach = F.size("need") + slop - 1
    around = F.sequence(F.greatest(_position(F.col("place")) - reach, F.lit(0)), _position(F.col("place")) + reach)
    near = _first_places(needs, postings).join(needs, "window")
    near = near.select("window", "segment", "place", F.array_distinct(F.transform("need", lambda t: t["term"])).alias("terms"), F.transform(around, lambda x: x + F.col("place") - _position(F.col("place"))).alias("around"))
    wanted = stage(near.select("window", "segment", F.col("place").alias("anchor"), F.explode("terms").alias("term"), "around").select("window", "segment", "anchor", "term", F.explode("around").alias("place")), "wanted-places")
    found = wanted.join(_present(wanted, postings), ["segment", "term", "place"]).groupBy("window", "segment", "anchor").agg(F.collect_list(F.struct("term", "place")).alias("found"))
    found = found.join(needs, "window").select("window", "segment", "found", F.transform("need", lambda t: t["term"]).alias("terms"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("window", "segment", "start", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for window, segment, places, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where: dict[str, list[int]] = defaultdict(list)
                for x in sorted(places, key=lambda x: x["place"]):
                    where[x["term"]].append(x["place"])
                out += ((window, segment, a, b) for a, b in spans(where, terms, slop))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, names=schema.names)

    return found.mapInArrow(run, schema).distinct()


def spans(where: dict[str, list[int]], terms: list[str], slop: int) -> Iterator[tuple[int, int]]:
    """Spans of at most len(terms) + ``slop`` places, from each first place, that hold all terms as often as ``terms`` does."""
    wanted = Counter(terms)
    if any(len(where.get(t, ())) < n for t, n in wanted.items()):
        return
    for start in sorted({p for t in wanted for p in where[t]}):
        end = start
        for t, n in wanted.items():
            k = bisect_left(where[t], start) + n - 1
            end = max(end, where[t][k] + 1) if k < len(where[t]) else 1 << 62
        if end - start <= len(terms) + slop:
            yield start, end


def find(index: Index, benchmark: DataFrame, n: int = WINDOW, slop: int = 0, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(segment, document, item_id, place, start, end, exact): where windows of ``n`` words of benchmark
    items occur; place is the window's first word in its item, start and end are words of the document."""
    phrases = windows(benchmark, n, item_column, item_text).withColumn("window", F.monotonically_increasing_id())
    phrases = stage(phrases, "phrases")
    terms = phrases.select(F.explode("terms").alias("term")).distinct()
    postings = index.postings.join(stage(terms, "benchmark-terms"), "term", "left_semi")
    needs = stage(_ordered(phrases, postings), "phrase-terms")
    sizes = needs.select("window", F.size("need").alias("size"))
    found = _exact(needs, postings).join(sizes, "window").select("window", "segment", "start", (F.col("start") + F.col("size")).alias("end"), F.lit(True).alias("exact"))
    if slop:
        found = stage(found, "phrase-matches")
        near = _near(needs, postings, slop).join(found, ["window", "segment", "start", "end"], "left_anti")
        found = found.unionByName(near.withColumn("exact", F.lit(False)))
    placed = found.join(phrases.select("window", F.explode("at").alias("r")), "window")
    at = lambda c: _position(F.col(c)).cast("int").alias(c)
    return placed.select("segment", F.shiftright("start", 32).cast("int").alias("document"), "r.item_id", "r.place", at("start"), at("end"), "exact")


def find_phrases(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = 0, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``find`` with an index of its own: a row for each row of ``docs``, with ``id_column``, ``n_words`` and
    ``hits``, an array of (item_id, place, start, end, exact) without any order."""
    index = build_index(docs, id_column, text_column)
    hits = find(index, benchmark, n, slop, item_column, item_text).groupBy(*_ROW).agg(F.collect_list(F.struct("item_id", "place", "start", "end", "exact")).alias("hits"))
    whole = index.documents.join(hits, [*_ROW], "left")
    none = F.array().cast(hits.schema["hits"].dataType)
    return whole.select(F.col("id").alias(id_column), "n_words", F.coalesce("hits", none).alias("hits"))


def contamination(index: Index, found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``n_words``, ``n_hit`` (words inside exact matches), ``n_items``, ``items_sha256`` and
    ``contaminated`` of every document, by the rows of ``find``.

    Spans are merged in the order of their starts, in time linear in their number.
    """
    exact = stage(found.where("exact"), "phrase-matches")
    before = W.partitionBy(*_ROW).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ends = exact.groupBy(*_ROW, "start").agg(F.max("end").alias("end"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = ends.withColumn("new", new).groupBy(*_ROW).agg(F.sum("new").alias("n_hit"))
    named = exact.select(*_ROW, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*_ROW).agg(F.sort_array(F.collect_list("item")).alias("items"))
    whole = index.documents.join(covered, [*_ROW], "left").join(named, [*_ROW], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        F.col("id").alias(id_column),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    index = build_index(docs)
    return contamination(index, find(index, benchmark))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT DISTINCT doc_id, s, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.k = win.k),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
