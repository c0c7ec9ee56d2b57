"""Near duplicates by Jaccard similarity of word n-grams, with Bayesian pruning.

1. A document's set holds the hashes of its runs of five lower-cased words (of all its words, if
   they are fewer).  Documents of equal sets are copies; only the first of each goes on.
2. 128 MinHash values in 32 bands of four name its buckets.  Two sets of similarity 0.8 share none
   with a probability of 5e-8.
3. Bayesian pruning: of pairs in a bucket the MinHash values are compared, and after every 16 those go for
   which the posterior probability of reaching the threshold, given the matches so far and a uniform prior,
   is below ``TOLERANCE``.  Each document is compared with the first of its bucket; those that this
   prunes, the open ones, are compared with all others of the bucket.  Of the pairs left one link for each
   document and task is kept, and the links are joined to clusters, their connected components.  So what
   merely shares a bucket, as boilerplate does, joins no cluster.
   A bucket with more than ``BLOCK_DOCS`` open documents is not compared all against all: these documents are put
   into the lists of the rarest shingles of their sets, so many that two similar sets share one, and the same is done with
   the lists.  Boilerplate is frequent, and leads to no list while it is less than the threshold's part of a set.
4. The texts of clustered documents are dealt by cluster, large clusters as pairs of blocks of
   bounded size.  In a task the pairs that share a bucket are pruned as above; the rest is verified on the sets.
5. A task returns for each document its number of links and one link to its component, never the
   pairs, so a group of thousands of near copies stays as many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, let_go, need, real_id, shuffle_partitions, stage, told_apart
from .components import connected_components

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
HASHES, BANDS, STEP = 128, 32, 16
BLOCK_DOCS, BLOCK_SHINGLES = 1_000, 400_000
#: What the bytes of a text become before it is split at spaces: letters, digits and bytes above 127 make words, or all but white space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLANK_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_RARITY = 1 << 20
_U = np.uint64
_BASE = 0x100000001B3
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_random = np.random.default_rng(7)
_FACTORS = _random.integers(1 << 20, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_COMBINE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.r_[_U(1), np.cumprod(np.full(size - 1, base, dtype=np.uint64))]
    return _powers[0], _powers[1]


def shingles(text: str | None, n: int = N, table: bytes = _WORD_BYTES) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the runs of n words; of all words if they are fewer."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(table), dtype=np.uint8)
    edge = np.diff(np.r_[False, raw != 32, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _power(len(raw) + 1)
    total = np.r_[_U(0), np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)])]
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _COMBINE[-1])
    m = min(n, len(word))
    out = np.full(len(word) - m + 1, m, dtype=np.uint64)
    for k in range(m):
        out = out * _COMBINE[k % 63] + word[k : len(word) - m + 1 + k]
        out = out ^ (out >> _U(29))
    return np.unique(_mix(out))


def signature(shingle: np.ndarray) -> np.ndarray:
    """The MinHash values, for a set that is not empty."""
    x, out = (shingle >> _U(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 4096):
        h = x[k : k + 4096, None] * _FACTORS + _TERMS
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def buckets(sig: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band; ``sig`` has a row for each set."""
    part = sig.reshape(len(sig), BANDS, HASHES // BANDS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _COMBINE[0], part.shape[:2]).copy()
    for k in range(part.shape[2]):
        out = _mix(out * _U(31) + part[:, :, k])
    return out.astype(np.int64)


@cache
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of n equal MinHash values with which P(similarity >= threshold) is not below tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper tail at t is the
    probability that a binomial of n + 1 trials of probability t is at most m.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of rows of ``sig`` that no step of the comparison prunes."""
    same = np.zeros(len(i), dtype=np.int32)
    for k in range(0, HASHES, STEP):
        same += (sig[i, k : k + STEP] == sig[j, k : k + STEP]).sum(axis=1, dtype=np.int32)
        stay = same >= least_matches(k + STEP, threshold)
        i, j, same = i[stay], j[stay], same[stay]
    return i, j


class _Forest:
    """Disjoint sets of 0 to n - 1; a set is named by its member of the least key."""

    def __init__(self, keys: list[int]):
        self.keys, self.up = keys, list(range(len(keys)))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if self.keys[a] > self.keys[b]:
            a, b = b, a
        self.up[b] = a

    def roots(self) -> list[int]:
        return [self.keys[self.find(k)] for k in range(len(self.keys))]


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sorted sets, not empty, reach the threshold; in integers, to six decimals of it."""
    t = round(threshold * 1_000_000)
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 1_000_000 < t * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both * 1_000_000 >= t * (len(a) + len(b) - both)


def compare(sets: list[np.ndarray], first: int | None, threshold: float = THRESHOLD, opened: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs i < j of similar sets of one block; of two blocks, the first of ``first`` sets, only those with
    i < first <= j.  With ``opened``, only pairs of which one is."""
    if first in (0, len(sets)):  # two blocks, one without rows
        return
    sig = np.array([signature(s) for s in sets], dtype=np.uint32).reshape(len(sets), HASHES)
    band, n = buckets(sig), len(sets)
    rows, columns = (np.arange(first), np.arange(first, n)) if first is not None else (np.arange(n), np.arange(n))
    shared = np.zeros((len(rows), len(columns)), dtype=bool)
    for b in range(BANDS):
        shared |= band[rows, b][:, None] == band[columns, b]
    i, j = np.nonzero(shared if first is not None else np.triu(shared, 1))
    i, j = rows[i], columns[j]
    if opened is not None:
        i, j = (k[opened[i] | opened[j]] for k in (i, j))
    i, j = survivors(sig, i, j, threshold)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if similar(sets[x], sets[y], threshold):
            yield x, y


def _sets(docs: DataFrame, n: int, table: bytes) -> DataFrame:
    """(id, key, size, buckets, sig) of every row; documents without words have no key."""
    fields = (("id", T.LongType()), ("key", T.BinaryType()), ("size", T.LongType()), ("buckets", T.ArrayType(T.LongType())), ("sig", T.BinaryType()))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        let_go()
        for batch in batches:
            keys, sizes, names, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, n, table)
                sizes.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s) if len(s) else None
                names.append(buckets(sig[None])[0] if len(s) else [])
                sigs.append(sig.tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), HASHES)


def against_leaders(pairs: DataFrame, payload: DataFrame, judge: Callable[[list, np.ndarray], np.ndarray]) -> DataFrame:
    """Those (u, v) of the pairs (u, v, dealt) that ``judge`` keeps, by the ``payload`` (id, payload) of both.

    A leader v and those u that are ``dealt`` the same number come together, the leader first, so a leader of many is
    sent to as many tasks, and a task holds a leader and a batch.  ``judge`` gets a list of payloads and for each row of a
    batch the place of its leader's among them (the row's own follows at place + 1), and returns a mask.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in "uv"])
    fields = ("v", "dealt", "side", "id", "payload")
    follow = pairs.withColumn("side", F.lit(1)).join(payload, F.col("u") == F.col("id")).select(*fields)
    lead = pairs.select("v", "dealt", F.lit(0).alias("side")).distinct().join(payload, F.col("v") == F.col("id")).select(*fields)
    rows = lead.unionByName(follow).repartition(shuffle_partitions(pairs.sparkSession), "v", "dealt").sortWithinPartitions("v", "dealt", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            own = batch.column(4).to_pylist()
            leads = batch.column(2).to_numpy(zero_copy_only=False) == 0
            at = np.maximum.accumulate(np.where(leads, np.arange(1, len(own) + 1), 0))
            both = [last, *own]
            last = both[at[-1]] if len(own) else last
            rest = np.flatnonzero(~leads)
            stay = pa.array(rest[judge(both, at[rest], rest + 1)] if len(rest) else rest, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(stay), batch.column(0).take(stay)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Those (u, v) of the pairs (u, v, dealt) that are not pruned."""

    def judge(both: list, lead: np.ndarray, own: np.ndarray) -> np.ndarray:
        blank = bytes(4 * HASHES)
        sig = np.frombuffer(b"".join(x or blank for x in both), dtype=np.uint32).reshape(len(both), HASHES)
        stay = np.zeros(len(both), dtype=bool)
        stay[survivors(sig, own, lead, threshold)[0]] = True
        return stay[own]

    return against_leaders(pairs, sigs.select("id", F.col("sig").alias("payload")), judge)


def _links_in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the blocks in ``rows`` (bucket, i, j, side, id, open, sig), which come sorted by the first four: a link to
    the least of its component for each document, by the pairs not pruned that have an ``open`` one."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in "uv"])

    def judge(key: list, side: list[int], ids: list[int], opened: list[bool], sigs: list[bytes]) -> tuple[list[int], list[int]]:
        if key is None:
            return [], []
        sig = np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(ids), HASHES)
        is_open, second, forest = np.array(opened), np.array(side) == 1, _Forest(ids)
        for x in range(len(ids)):
            others = np.flatnonzero(second) if key[1] != key[2] else np.arange(x + 1, len(ids))
            if key[1] != key[2] and second[x]:
                break
            others = others if is_open[x] else others[is_open[others]]
            for y in survivors(sig, np.full(len(others), x), others, threshold)[1].tolist():
                forest.join(x, y)
        roots = forest.roots()
        keep = [k for k in range(len(ids)) if ids[k] != roots[k]]
        return [ids[k] for k in keep], [roots[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, done = None, ([], [], [], []), ([], [])
        for batch in batches:
            for *key, side, id_, opened, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    for whole, part in zip(done, judge(block, *parts), strict=True):
                        whole += part
                    block, parts = key, ([], [], [], [])
                for whole, x in zip(parts, (side, id_, opened, sig), strict=True):
                    whole.append(x)
            if len(done[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], names=schema.names)
                done = ([], [])
        for whole, part in zip(done, judge(block, *parts), strict=True):
            whole += part
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], names=schema.names)

    return rows.mapInArrow(run, schema)


def block_pairs(opened: Column, others: Column, is_open: Column, id_: Column) -> Column:
    """The (i, j, side) of all tasks that a row has a part in.  The open rows are dealt over the first ``opened`` blocks, the
    others over ``others`` more; each block of open rows is paired with itself and all others."""
    block = F.when(is_open, F.pmod(F.xxhash64(id_), opened)).otherwise(opened + F.pmod(F.xxhash64(id_), F.greatest(others, F.lit(1)))).cast("int")
    to = F.sequence(F.lit(0), F.when(is_open, opened + others).otherwise(opened) - 1)
    return F.transform(to, lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j"), (block > o).cast("int").alias("side")))


def _blocks(of: Column, size: int) -> Column:
    return F.ceil(of / size).cast("int")


def _links_in_lists(named: DataFrame, sigs: DataFrame, threshold: float, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links between those documents (id, bucket) of a bucket that the Bayesian comparison leaves, and the ids of
    those that share a bucket of too many open documents, which is left out unless this is the ``last`` try."""
    parts = shuffle_partitions(named.sparkSession)
    least = named.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = stage(named.join(least, "bucket").where("id <> least"), "bucket-stars")
    pairs = stars.groupBy(F.col("id").alias("u"), F.col("least").alias("v")).agg(F.max("members").alias("members"))
    pairs = pairs.select("u", "v", F.pmod(F.xxhash64("u"), F.ceil(F.col("members") / BLOCK_DOCS)).cast("int").alias("dealt"))
    kept = stage(_pruned(pairs, sigs, threshold), "bucket-links")
    apart = stage(stars.join(kept.select(F.col("u").alias("id"), F.col("v").alias("least")), ["id", "least"], "left_anti"), "bucket-rest")
    again = stage(apart.groupBy("bucket", "members", "least").agg(F.count(F.lit(1)).alias("open")), "bucket-sizes")
    many = again.where(f"open > {BLOCK_DOCS}")
    rest = None
    if not last and not many.isEmpty():
        in_many = stars.join(many.select("bucket"), "bucket", "left_semi").select("id").unionByName(many.select(F.col("least").alias("id")))
        again, rest = again.where(f"open <= {BLOCK_DOCS}"), stage(in_many.distinct(), "open-documents")
    rows = stars.join(again.select("bucket", "open"), "bucket").select("bucket", "id", "members", "open")
    rows = rows.unionByName(again.select("bucket", F.col("least").alias("id"), "members", "open"))
    rows = rows.join(apart.select("bucket", "id", F.lit(True).alias("is_open")), ["bucket", "id"], "left").join(sigs, "id")
    rows = rows.withColumn("is_open", F.coalesce("is_open", F.lit(False)))
    whole = F.col("members") <= BLOCK_DOCS  # one block
    opened = F.when(whole, 1).otherwise(_blocks(F.col("open"), BLOCK_DOCS))
    others = F.when(whole, 0).otherwise(_blocks(F.col("members") - F.col("open"), BLOCK_DOCS))
    task = F.explode(block_pairs(opened, others, whole | F.col("is_open"), F.col("id"))).alias("p")
    rows = rows.select("bucket", task, "id", "is_open", "sig").select("bucket", "p.i", "p.j", "p.side", "id", "is_open", "sig")
    found = _links_in_blocks(rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "id"), threshold)
    return kept.unionByName(stage(found, "bucket-links")), rest


def _rarest(texts: DataFrame, n: int, threshold: float, table: bytes) -> DataFrame:
    """(id, bucket): the rarest shingles of each text (id, text), so many that two sets of the threshold share one.

    Shingles are ordered by how often their part of ``_RARITY`` hash parts occurs in these texts, then by hash: any order finds all,
    this one keeps what very many texts share out of the lists.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(t, n, table).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["id", "s"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_RARITY, dtype=np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(s, dtype=np.uint64) & _U(_RARITY - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    made = stage(texts.mapInArrow(sets, T.StructType.fromDDL("id long, s binary")), "open-sets")
    found = made.select("s").mapInArrow(count, T.StructType.fromDDL("b long, n long")).groupBy("b").agg(F.sum("n").alias("n"))
    found = found.select("b", F.log2("n").cast("tinyint").alias("n")).toArrow()  # at most _RARITY rows
    often = np.zeros(_RARITY, dtype=np.uint8)
    often[found.column(0).to_numpy()] = found.column(1).to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for id_, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(s, dtype=np.uint64)
                order = np.lexsort((h, often[(h & _U(_RARITY - 1)).astype(np.int64)]))
                first = h[order[: len(h) - -(-round(threshold * 1_000_000) * len(h) // 1_000_000) + 1]]
                ids.append(np.full(len(first), id_, dtype=np.int64))
                out.append(first.astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, out)], names=["id", "bucket"])

    return stage(made.mapInArrow(rarest, T.StructType.fromDDL("id long, bucket long")), "rarest-shingles")


def links(first: DataFrame, texts: DataFrame, n: int = N, threshold: float = THRESHOLD, table: bytes = _WORD_BYTES) -> DataFrame:
    """(u, v): links between documents (id, buckets, sig) of a bucket that the Bayesian comparison leaves; similar ones
    are connected by them.  ``texts`` (id, text) has their texts."""
    sigs = first.select("id", "sig")
    found, rest = _links_in_lists(first.select("id", F.explode("buckets").alias("bucket")), sigs, threshold, last=False)
    if rest is None:
        return found
    listed = _rarest(texts.join(rest.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]), n, threshold, table)
    more, _ = _links_in_lists(listed, sigs, threshold, last=True)
    return found.unionByName(more)


def _linked(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, root, links) of the blocks in ``rows`` (cluster, i, j, side, id, text), which come sorted by the first five."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "root", "links")])

    def judge(ids: list[int], texts: list[str], first: int | None) -> tuple[list[int], list[int], list[int]]:
        if first in (0, len(ids)):  # the tasks of single blocks return these documents
            return [], [], []
        order = sorted(range(len(ids)), key=lambda k: (first is not None and k >= first, ids[k]))
        ids = [ids[k] for k in order]
        forest, links = _Forest(ids), [0] * len(ids)
        for x, y in compare([shingles(texts[k], n) for k in order], first, threshold):
            links[x] += 1
            links[y] += 1
            forest.join(x, y)
        return ids, forest.roots(), links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, first, done = None, [], [], None, ([], [], [])
        for batch in batches:
            for *key, side, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    for whole, part in zip(done, judge(ids, texts, first), strict=True):
                        whole += part
                    block, ids, texts, first = key, [], [], 0 if key[1] != key[2] else None
                if id_ not in ids[-1:]:  # rows that repeat an id come together
                    first = None if first is None else first + (side == 0)
                    ids.append(id_), texts.append(text)
            if len(done[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], names=schema.names)
                done = ([], [], [])
        for whole, part in zip(done, judge(ids, texts, first), strict=True):
            whole += part
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], names=schema.names)

    return rows.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Classes of documents that are linked by similarity, and their numbers of links.

    Returns for each row of ``docs``: ``id_column``, ``class_id`` (the least id of its class),
    ``n_links`` (other sets it is similar to, counted once however many copies they have) and
    ``n_copies`` (rows of its own set, itself included).

    Null texts and those without words are alone in their class.  Ids are integers.  Rows that
    repeat an id and its text are copies; rows of one id (or none) with other texts are each judged
    by their own, and a null id is below all others.
    """
    need(docs, id_column, text_column)
    kind = docs.schema[id_column].dataType
    texts = told_apart(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    return classes(texts, n, threshold).select(real_id().cast(kind).alias(id_column), real_id("first.id", "first.h").cast(kind).alias("class_id"), "n_links", "n_copies")


def classes(rows: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(id, h, first, n_links, n_copies) of every row (id, h, text) of ``told_apart``; ``first`` is
    the least (id, h) of its class."""
    spark = rows.sparkSession
    bounded_batches(spark, 256, 4 << 20)
    parts = shuffle_partitions(spark)
    vertex = F.when(F.col("h") == 0, F.col("id")).otherwise(F.xxhash64("id", "h"))
    texts = rows.select(vertex.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stage(_sets(texts, n, _WORD_BYTES), "shingle-sets")
    keyed = sets.where("key is not null")
    same = (F.any_value(c).alias(c) for c in ("size", "buckets", "sig"))
    owners = stage(keyed.groupBy("key").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n_copies"), *same), "set-owners")
    first = owners.select(F.col("owner").alias("id"), "size", "buckets", "sig")
    clusters = connected_components(links(first, texts, n, threshold))

    sized = clusters.join(first.select("id", "size"), "id")
    blocks = sized.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = stage(clusters.join(blocks, "label"), "clusters")

    pair = F.explode(block_pairs(F.col("blocks"), F.lit(0), F.lit(True), F.col("id"))).alias("p")
    tasks = texts.join(placed.hint("shuffle_hash"), "id").select(F.col("label").alias("cluster"), pair, "id", "text")
    tasks = tasks.select("cluster", "p.i", "p.j", "p.side", "id", "text")
    found = stage(_linked(tasks.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "id"), n, threshold), "links")

    counted = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    many = found.join(placed.where("blocks > 1").select("id"), "id", "left_semi").where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
    merged = connected_components(many)
    roots = found.groupBy("id").agg(F.min("root").alias("root")).join(merged, "id", "left").select("id", F.coalesce("label", "root").alias("class"))
    judged = roots.join(counted, "id")

    member = sets.select("id", "key").join(owners.select("key", "owner", "n_copies"), "key", "left").withColumn("at", F.coalesce("owner", "id"))
    out = member.join(judged.withColumnRenamed("id", "at"), "at", "left")
    out = out.select(
        "id",
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.coalesce("class", "at")).alias("class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )
    named = stage(rows.where("h <> 0").select(vertex.alias("vertex"), F.col("id").alias("own"), "h").distinct(), "named-vertices")
    zero = F.lit(0).cast("long")
    if named.isEmpty():  # vertices are ids
        return out.select("id", zero.alias("h"), F.struct(F.col("class").alias("id"), zero.alias("h")).alias("first"), "n_links", "n_copies")
    out = out.join(named, F.col("id") == F.col("vertex"), "left").withColumns({"id": F.coalesce("own", "id"), "h": F.coalesce("h", zero)})
    out = stage(out.select("id", "h", "class", "n_links", "n_copies"), "named-classes")
    first = out.groupBy("class").agg(F.min(F.struct("id", "h")).alias("first"))
    return out.join(first, "class").select("id", "h", "first", "n_links", "n_copies")


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
