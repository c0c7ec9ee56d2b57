"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Two steps that compose.  ``cut_pieces`` tokenises each document, appends an end id and cuts what
is longer than the capacity.  ``pack_pieces`` gives each piece a place in a sequence.

Pieces of one length are interchangeable, so the packing is decided on the histogram of lengths,
which has at most ``capacity`` entries whatever the input, and is then carried out by rank:

* pieces above a third of the capacity, of which a sequence holds two at most, are matched
  greedily, each with the longest that still fits beside it, longest first;
* the smaller ones go, longest first, to the fullest sequence that still has room (best fit);
  sequences of equal room are treated as one group with a count.

The plan is a list of runs: ranks a to b of one length go, k to a sequence, to sequences from s on,
at an offset.  Its length depends on the capacity alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, gapless_rank, kept, need, stage

CAPACITY, END_ID, MEMO = 4096, 1, 550_000
_STOP = re.compile(r"[.,](?<=[a-zA-Z][.,])")  # looks for the stop first: that is quicker


#: What a tokenizer has to be, by its own definition, to be given parts of texts: normalizers that only compose, collapse white space and
#: lower-case, and words that are a run of letters, a digit or a run of other signs.
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_WORDS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Texts on which such a tokenizer has to give its own ids by parts, too.
PROBES = ("The Quick BROWN fox. It's  here, there.\nAB.cd x.y", "A.b,c 12.5 (Ünï.) don't\t...", "one two three", " Zz zZ ZZ zz ")


def _chunks(text: str) -> list[str]:
    return _STOP.sub(r" \g<0>", (text.lower() if text.isascii() else text).replace("\n", " ")).split(" ")


def works_on_parts(definition: dict) -> bool:
    """Whether a tokenizer with this definition lower-cases, drops white space and never joins what it
    separates, nor a letter and the full stop or comma after it, but for added tokens."""
    norm, split, model = (definition.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    norms = norm.get("normalizers", [norm])
    known = all(n in _NORMALIZERS for n in norms) and {"type": "Lowercase"} in norms
    known = known and split.get("type") == "Sequence" and split.get("pretokenizers") == [_WORDS, _BYTES]
    known = known and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix"))
    return known and not definition.get("truncation") and not definition.get("padding") and all(t["content"].strip() and t["content"].isascii() for t in definition.get("added_tokens", []))


class _Encoder:
    """Encodes texts by way of a bounded memory of the ids of their space-separated chunks.

    A tokenizer whose definition says that it ``works_on_parts`` gives a text the ids of such parts, unless the text may hold one of its added
    tokens, of which one part without white space is looked for in any case of letters.  Such texts, and all texts of
    any other tokenizer, are encoded whole.  Parts that are not in the memory are encoded together, by the
    quickest way that gives the tokenizer's own ids: ASCII lower-case words need only its model, other words
    no separation, the rest all of it.  A full memory becomes the old one, from which what is used again is
    taken over.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        definition = json.loads(self.whole.to_str())
        self.added = [max(t["content"].lower().split(), key=len) for t in definition["added_tokens"] if t["content"].strip()]
        self.by_chunk = works_on_parts(definition) and all(self.separable(p) for p in PROBES)
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = self.by_chunk and token.endswith(suffix)
        if self.by_chunk:
            self.renew({})

    def separable(self, text: str) -> bool:
        """Whether the ids of the text are those of its parts, taken alone and as words of one list."""
        ids = lambda x, **how: self.whole.encode(x, add_special_tokens=False, **how).ids
        parts = [c for c in _chunks(text) if c]
        return ids(text) == [i for c in parts for i in ids(c)] == ids(parts, is_pretokenized=True)

    def renew(self, old: dict[str, bytes]) -> None:
        self.memo, self.old = {"": b""}, old
        self.learn([".", ","], self.parted)

    def parted(self, words: list[str]) -> list[bytes]:
        got = self.whole.encode(words, is_pretokenized=True, add_special_tokens=False)
        return _cut(got.ids, np.searchsorted(np.array(got.word_ids), np.arange(len(words) + 1)))

    def joined(self, tokenizer, words: list[str]) -> list[bytes]:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
        return _cut(ids, np.r_[0, ends]) if len(ends) == len(words) else self.parted(words)

    def learn(self, words: list[str], how, *args) -> None:
        if words:
            self.memo.update(zip(words, how(*args, words), strict=True))

    def may_hold_added(self, text: str) -> bool:
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return any(a in low for a in self.added)

    def wholly(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self.wholly(texts)
        held = [self.may_hold_added(t) for t in texts]
        if any(held):
            whole, parted = iter(self.wholly([t for t, h in zip(texts, held, strict=True) if h])), iter(self.by_parts([t for t, h in zip(texts, held, strict=True) if not h]))
            return [next(whole if h else parted) for h in held]
        return self.by_parts(texts)

    def by_parts(self, texts: list[str]) -> list[bytes]:
        chunks = [_chunks(t) for t in texts]
        new = set().union(*chunks).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:  # what is used again moves from the old memory to the new
            self.renew(self.memo)
            new = set().union(*chunks).difference(self.memo)
        if new:
            kept = {c: self.old[c] for c in new.intersection(self.old)}
            self.memo.update(kept)
            plain, word, rest = [], [], []
            for c in new.difference(kept):
                (rest if not c.isalpha() else plain if c.isascii() and c.islower() else word).append(c)
            self.learn(plain, self.joined, self.model)
            self.learn(word, self.joined, self.whole)
            self.learn(rest, self.parted)
        at = self.memo.__getitem__
        return [b"".join(map(at, c)) for c in chunks]


def _cut(ids, at: np.ndarray) -> list[bytes]:
    raw, cuts = np.asarray(ids, dtype="<u4").tobytes(), (at * 4).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _encoder(path: str) -> _Encoder:
    return kept(("encoder", path), lambda: _Encoder(path))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise every document and cut it into pieces of at most ``capacity`` ids.

    Returns ``id_column``, ``piece`` (from 0), ``start`` (ids of the document before the piece),
    ``length`` and ``ids`` (little-endian unsigned 32-bit).  A null or empty text is the end id
    alone.  ``tokenizer`` is the path of a tokenizer file on every machine.
    """
    need(docs, id_column, text_column)
    bounded_batches(docs.sparkSession, 256, 4 << 20)
    end, step = int(end_id).to_bytes(4, "little"), capacity * 4
    schema = T.StructType([docs.schema[id_column], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, raw in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    cut = raw[at : at + step]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(cut) // 4), ids.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first sequence, items a sequence, offset of the first)."""
    left, ranked, runs, sequence = dict(counts), defaultdict(int), [], 0
    rooms: list[int] = []  # sorted; for each, the groups of sequences with that much left
    groups: dict[int, list[tuple[int, int]]] = {}

    def place(length: int, items: int, first: int, each: int, offset: int) -> None:
        runs.append((length, ranked[length], items, first, each, offset))
        ranked[length] += items

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        j = bisect_right(large, capacity - a) - 1
        b = large[j] if j >= 0 else None
        if b == a and left[a] == 1:  # no second one of that length
            b = large[j - 1] if j else None
        if b is None:
            n = left[a]
            place(a, n, sequence, 1, 0)
            leave(capacity - a, sequence, n)
            left[a] = 0
        elif b == a:
            n = left[a] // 2
            place(a, 2 * n, sequence, 2, 0)
            leave(capacity - 2 * a, sequence, n)
            left[a] -= 2 * n
        else:
            n = min(left[a], left[b])
            place(a, n, sequence, 1, 0)
            place(b, n, sequence, 1, a)
            leave(capacity - a - b, sequence, n)
            left[a] -= n
            left[b] -= n
            if not left[b]:
                large.remove(b)
        if not left[a]:
            large.remove(a)
        sequence += n
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[s]
        while n:
            if (j := bisect_left(rooms, s)) == len(rooms):  # new sequences
                full = n // (capacity // s)
                leave(capacity, sequence, full + (n % (capacity // s) > 0))
                sequence += full + (n % (capacity // s) > 0)
                continue
            room = rooms[j]
            first, m = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[j]
            each, at = room // s, capacity - room
            full = min(m, n // each)
            if full:
                place(s, full * each, first, each, at)
                leave(room - each * s, first, full)
                n -= full * each
            if full < m and n:
                place(s, n, first + full, n, at)
                leave(room - n * s, first + full, 1)
                n, full = 0, full + 1
            leave(room, first + full, m - full)
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, ids: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that carry a ``length`` of 1 to ``capacity``.

    Sequences hold at most ``capacity``; offsets within one leave no gap.  All other columns are
    carried along, so drop what is heavy first.  Repeated rows are packed as often as they occur.
    """
    need(pieces, *ids, length)
    pieces = stage(pieces, "packing-pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if bad := [x for x in counts if x is None or not 0 < x <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    runs = sorted(plan(counts, capacity))
    table = np.array(runs, dtype=np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_rank"))
            at = table[np.searchsorted(keys, (size << 44) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            out = batch.drop_columns(["_rank"])
            for name, x in (("sequence_id", at[:, 3] + nth // np.maximum(at[:, 4], 1)), ("offset", at[:, 5] + nth % np.maximum(at[:, 4], 1) * size)):
                out = out.append_column(name, pa.array(x))
            yield out

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return gapless_rank(pieces, [length], list(ids), len(counts), sum(counts.values()), "_rank").select(*pieces.columns, "_rank").mapInArrow(run, schema)


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, payload: dict[str, Column] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``cut_pieces`` and ``pack_pieces``; ``payload`` says what of ``ids`` to keep (default: all)."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, id_column, text_column)
    if payload is not None:
        pieces = pieces.withColumns(payload).drop("ids") if payload else pieces.drop("ids")
    return pack_pieces(pieces, capacity, (id_column, "piece"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = best_fit_pack(docs, tokenizer_path(), payload={"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
