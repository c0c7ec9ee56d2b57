"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text.  A window of a
text is compressed with either; how many bytes the toxic one saves is the window's gain.  How many
windows of a document gain at least so much, for several thresholds, gives its score through a
logistic calibration.

Three things make the lengths of short windows comparable:

* both dictionaries end alike.  The ordinary one is ordinary text, filler, carrier; the toxic one
  has the toxic text in place of the filler, so what is not toxic costs the same in both;
* each window follows a carrier of frequent words that is in both dictionaries, so the block is
  never stored as it is and its length is that of the window alone;
* each byte is written ``REPEAT`` times, which raises the price of literals against that of
  matches: a word of five letters then gains as clearly as a long one.

Toxic documents are mostly ordinary prose, so the toxic dictionary is trained on those of their
words whose beginning, or most of whose byte n-grams, clearly more toxic than ordinary documents have.

Windows are of ``WINDOW`` words, by default one, so that lengths can be remembered by window.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, kept, let_go, need
from .ngramjoin import shingles, signature

#: Learning reads at most so many labelled rows, those with the smallest hash of their id, and of these no
#: more than fit the bytes.
MAX_LABELLED, MAX_LABELLED_BYTES = 8_000, 96 << 20
#: What the trainer is given: an ordinary word as often as it occurs in documents, up to ``ORDINARY_TIMES``, if it occurs in
#: two at least, ``ORDINARY_SAMPLES`` in all; a toxic word up to ``TOXIC_TIMES``.
ORDINARY_TIMES, TOXIC_TIMES = 8, 20
WINDOW, GRAM, REPEAT = 1, 5, 3
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SAMPLES, MEMO = 200 << 10, 32 << 10, 400_000, 1_000_000
FOLDS, THRESHOLDS = 3, (1, 3, 5, 7, 9, 12, 16)
PREDICT, SURPRISE, MOST = 0.7, 26.0, 0.6
_SEPARATORS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


def _windows(text: str | None, n: int) -> list[bytes]:
    words = _words(text)
    return words if n == 1 else [b" ".join(words[k : k + n]) for k in range(0, len(words), n)]


def _spread(raw: bytes) -> bytes:
    return np.repeat(np.frombuffer(b" " + raw + b" ", dtype=np.uint8), REPEAT).tobytes()


def _starts(word: bytes) -> set[bytes]:
    """The word and its beginnings, with its bounds."""
    word = b" " + word + b" "
    return {word, *(word[:k] for k in range(GRAM, min(2 * GRAM, len(word))))}


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[k : k + GRAM] for k in range(max(1, len(word) - GRAM + 1))}


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary's content; the samples themselves where there are too few to train on."""
    import zstandard

    random.Random(0).shuffle(samples)
    joined = [b"".join(samples[k : k + 8]) for k in range(0, len(samples), 8)]
    try:
        return zstandard.train_dictionary(size, joined, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(joined)[:size]


@dataclass(frozen=True)
class Dictionaries:
    """The two trained dictionaries and what precedes each window."""

    ordinary: bytes
    toxic: bytes
    carrier: bytes
    window: int = WINDOW

    @classmethod
    def train(cls, ordinary: Counter, toxic: Counter, window: int = WINDOW) -> Dictionaries:
        """From the numbers of documents of either kind that hold a word."""
        seen = (Counter(), Counter())
        for w, n in toxic.items():
            for g in _starts(w) | _grams(w):
                seen[1][g] += n
        asked = {g for g, n in seen[1].items() if n > 2}
        for w, n in ordinary.items():
            for g in (_starts(w) | _grams(w)) & asked:
                seen[0][g] += n
        share = sum(toxic.values()) / max(1, sum(toxic.values()) + sum(ordinary.values()))

        def clear(gram: bytes, n: int) -> bool:
            """At least four times as frequent in toxic documents, and not by chance (a G-test)."""
            m = seen[0].get(gram, 0)
            expected = (n + m) * share
            surprise = 2 * (n * math.log(n / expected) + (m * math.log(m / (n + m - expected)) if m else 0))
            return n * (1 - share) > 4 * m * share and surprise > SURPRISE

        marks = {g for g in asked if clear(g, seen[1][g])}
        found = Counter({w: n for w, n in toxic.items() if not marks.isdisjoint(_starts(w)) or len(marks & (g := _grams(w))) > MOST * len(g)})
        content = _dictionary(TOXIC_BYTES, [_spread(w) for w, n in found.items() for _ in range(min(n, TOXIC_TIMES))], 32 * REPEAT)
        missed = b"".join(s for s in map(_spread, (w for w, _ in reversed(found.most_common()))) if s not in content)
        content += missed[max(0, len(missed) + len(content) - TOXIC_BYTES) :]  # training leaves out what is rare
        rest = [(w, n) for w, n in ordinary.items() if n > 1 and w not in found]
        random.Random(0).shuffle(rest)
        samples: list[bytes] = []
        for w, n in rest:
            if len(samples) >= ORDINARY_SAMPLES:
                break
            samples += [_spread(w)] * min(n, ORDINARY_TIMES)
        carrier = _spread(b" ".join(sorted(ordinary, key=lambda w: (-ordinary[w], w))[:12]))
        return cls(_dictionary(ORDINARY_BYTES, samples, 64 * REPEAT), content, carrier, window)


class _Scorer:
    """Gains of windows, remembered up to ``MEMO``."""

    def __init__(self, d: Dictionaries):
        import zstandard as z

        filler = (d.ordinary * (len(d.toxic) // max(1, len(d.ordinary)) + 1))[: len(d.toxic)]
        settings = z.ZstdCompressionParameters(
            format=z.FORMAT_ZSTD1_MAGICLESS, strategy=z.STRATEGY_BTOPT, min_match=3, window_log=20, hash_log=17, chain_log=17, search_log=5,
            target_length=48, write_content_size=0, write_checksum=0, write_dict_id=0,
        )

        def lengths(content: bytes):
            made = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=settings)
            return z.ZstdCompressor(dict_data=made, compression_params=settings).compress

        self.d, self.memo = d, {}
        self.plain, self.toxic = (lengths(d.ordinary + part + d.carrier) for part in (filler.ljust(len(d.toxic)), d.toxic))

    def gain(self, window: bytes) -> int:
        if (got := self.memo.get(window)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            raw = self.d.carrier + _spread(window)
            got = self.memo[window] = len(self.plain(raw)) - len(self.toxic(raw))
        return got

    def features(self, text: str | None) -> list[float]:
        gains = np.fromiter(map(self.gain, _windows(text, self.d.window)), dtype=np.int64)
        counts = [int((gains >= t).sum()) for t in THRESHOLDS]
        share = [1000 * c / (len(gains) + 50) for c in counts]
        return [*map(math.log1p, counts), *map(math.log1p, share), float(gains.max(initial=0)) / 10]


def scorer(d: Dictionaries) -> _Scorer:
    return kept(("scorer", hash(d.ordinary), hash(d.toxic), d.window), lambda: _Scorer(d))


def _dictionaries(texts: Sequence[str], labels: Sequence[int], fold: int | None, window: int) -> Dictionaries:
    """Those of all texts but every ``FOLDS``-th, from ``fold`` on."""
    counts = (Counter(), Counter())
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        if fold is None or i % FOLDS != fold:
            counts[label].update(list(dict.fromkeys(_words(text))))  # in their order, as a set's differs from process to process
    return Dictionaries.train(*counts, window)


def _fold_features(texts: Sequence[str], labels: Sequence[int], fold: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the texts of ``fold``, by the dictionaries of the others."""
    own = range(fold, len(texts), FOLDS)
    made = _Scorer(_dictionaries(texts, labels, fold, window)) if len(own) else None
    return np.array([made.features(texts[i]) for i in own]).reshape(-1, 2 * len(THRESHOLDS) + 1), np.array([labels[i] for i in own], dtype=float)


@dataclass(frozen=True)
class ToxicityModel:
    dictionaries: Dictionaries
    mean: np.ndarray = field(repr=False)
    scale: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)

    @classmethod
    def fit(cls, texts: Sequence[str], labels: Sequence[int], window: int = WINDOW) -> ToxicityModel:
        """Train on all texts; calibrate on features from dictionaries that did not see the text."""
        folds = [_fold_features(texts, labels, fold, window) for fold in range(FOLDS)]
        return cls.calibrated(_dictionaries(texts, labels, None, window), np.concatenate([x for x, _ in folds]), np.concatenate([y for _, y in folds]))

    @classmethod
    def calibrated(cls, dictionaries: Dictionaries, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
        mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (x.sum(0), x.sum(0) + 1)
        return cls(dictionaries, mean, scale, _logistic((x - mean) / scale, y))

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        made = scorer(self.dictionaries)
        x = np.array([made.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30))) if len(texts) else np.zeros(0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    a, penalty = np.c_[x, np.ones(len(x))], np.r_[np.full(x.shape[1], ridge), 1e-6] * max(1, len(x))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6)
        w = w - np.linalg.solve(h, a.T @ (p - y) + penalty * w)
    return w


def held_out(id_column: str = "doc_id") -> Column:
    """The third of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def distinct_texts(texts: Sequence[str], labels: Sequence[int]) -> list[int]:
    """The first of each group of near copies of one label, which else would count as often as they are copied.

    Copies share one of eight bands of six MinHash values of word 5-grams: of similarity 0.9 do 0.999 of
    the pairs, of 0.8 nine in ten, of 0.4 one in thirty.
    """
    seen: set = set()
    out = []
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        s = shingles(text)
        sig = signature(s)[:48].reshape(8, 6).tolist() if len(s) else [[len(text)]]
        bands = {(label, b, *x) for b, x in enumerate(sig)}
        if bands.isdisjoint(seen):
            out.append(i)
        seen |= bands
    return out


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most: int = MAX_LABELLED, most_bytes: int = MAX_LABELLED_BYTES) -> ToxicityModel:
    """Fit on at most ``most`` labelled rows of at most ``most_bytes`` of text, those with the smallest hash
    of their id.

    Rows without a label, or whose id is held out or not in ``docs``, are not used.  An id with several
    labels has the largest, one with several texts the last in their order.  Without any row, each text
    scores alike.
    """
    need(docs, id_column, text_column)
    need(labels, id_column, label_column)
    named = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    named = named.groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text"))
    sizes = texts.join(F.broadcast(named), "_id").groupBy("_id").agg(F.max(F.octet_length("_text")).alias("n"), F.max("_label").alias("y"), F.xxhash64("_id").alias("hash"))
    taken, total = {}, 0
    for r in sorted(sizes.collect(), key=lambda r: (r.hash, r[0])):  # at most ``most``
        if total + r.n <= most_bytes:
            taken[r[0]], total = int(r.y > 0), total + r.n
    if not taken:
        return ToxicityModel.fit([], [])
    chosen = docs.sparkSession.createDataFrame(list(taken.items()), T.StructType([named.schema["_id"], T.StructField("_label", T.IntegerType())]))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_text").alias("text"), F.max("_label").alias("label"))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    parts = {r.fold: r for r in rows.groupBy("fold").applyInPandas(_learn_part, _PART).collect()}
    if FOLDS not in parts:  # no chosen id has a text
        return ToxicityModel.fit([], [])
    last, x, y = parts[FOLDS], [], []
    for fold in range(FOLDS):
        y.append(np.array(parts[fold].labels))
        x.append(np.array(parts[fold].features).reshape(len(y[-1]), 2 * len(THRESHOLDS) + 1))
    return ToxicityModel.calibrated(Dictionaries(*map(bytes, (last.ordinary, last.toxic, last.carrier))), np.concatenate(x), np.concatenate(y))


_PART = "fold int, features array<double>, labels array<double>, ordinary binary, toxic binary, carrier binary"


def _learn_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The features of a fold; for the fold after the last, the dictionaries of all rows."""
    let_go()
    rows = rows.sort_values("_id")
    texts, labels = rows["text"].tolist(), rows["label"].tolist()
    first = distinct_texts(texts, labels)
    texts, labels, fold = [texts[i] for i in first], [labels[i] for i in first], int(key[0])
    if fold < FOLDS:
        x, y = _fold_features(texts, labels, fold, WINDOW)
        return pd.DataFrame([[fold, x.ravel(), y, None, None, None]], columns=["fold", "features", "labels", "ordinary", "toxic", "carrier"])
    d = _dictionaries(texts, labels, None, WINDOW)
    return pd.DataFrame([[fold, None, None, d.ordinary, d.toxic, d.carrier]], columns=["fold", "features", "labels", "ordinary", "toxic", "carrier"])


def score_texts(docs: DataFrame, model: ToxicityModel, text_column: str = "text", predict: float = PREDICT) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``predict`` on) to every row.

    Whole texts are scored; null counts as empty, and an empty text has the score of one without
    any toxic window.  Columns of these two names are replaced.
    """
    need(docs, text_column)
    bounded_batches(docs.sparkSession, 256, 4 << 20)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(at).to_pylist())
            yield batch.append_column("score", pa.array(scores, pa.float64())).append_column("predicted", pa.array((scores >= predict).astype(np.int32), pa.int32()))

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labelled rows that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_texts(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
