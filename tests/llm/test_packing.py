import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from landgraph.llm import packing as P

SCHEMA = "doc_id long, text string, length string, ids string"


def expand(runs, capacity):
    bins = defaultdict(list)
    for length, _, items, first, each, offset in runs:
        for i in range(items):
            bins[first + i // each].append((offset + i % each * length, length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_and_packs_as_well_as_best_fit(seed):
    r = random.Random(seed)
    capacity = [100, 4096, 37, 64, 100, 12][seed]
    lengths = [min(capacity, 1 + int(r.expovariate(1 / (capacity * [0.2, 0.3, 0.5, 0.1, 0.4, 0.4][seed])))) for _ in range(900)]
    runs = P.plan(dict(Counter(lengths)), capacity)
    bins = expand(runs, capacity)
    assert Counter(x for b in bins.values() for _, x in b) == Counter(lengths)
    assert sum(1 for b in bins.values() if sum(3 * x > capacity for _, x in b) > 2) == 0
    assert len(bins) <= plain_best_fit(lengths, capacity) * 1.01 + 1
    assert max(bins) == len(bins) - 1


def test_empty_plan():
    assert P.plan({}, 10) == [] and P.plan({10: 3}, 10) == [(10, 0, 3, 0, 1, 0)]


def test_query_against_the_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    words = ["thea", "OF", "the.", "é́t", "l'été", "don't", "ΣΑΣ", "…", "日本", "a b", "\x1c", "x\t\ty", "<|endoftext|>", "12,5", "ıİ"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60]))) + r.choice(["", "\n", "  "]) for _ in range(60)]
    texts += [None, "", " \n ", "word " * 9000, "hot copy"] + ["hot copy"] * 40
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    tok, got = Tokenizer.from_file(P.tokenizer_path()), defaultdict(list)
    out = P.best_fit_pack(frame, P.tokenizer_path(), 256).collect()
    for x in out:
        got[x.doc_id].append(x)
    bins = defaultdict(list)
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(got[i], key=lambda x: x.piece)
        assert [np.frombuffer(bytes(x.ids), "<u4").tolist() for x in parts] == [want[k : k + 256] for k in range(0, len(want), 256)]
        assert [(x.piece, x.start, x.length) for x in parts] == [(k, 256 * k, len(want[256 * k : 256 * k + 256])) for k in range(len(parts))]
        for x in parts:
            bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0] + [n for _, n in sorted(b)])[:-1].tolist() and sum(n for _, n in b) <= 256
    again = P.best_fit_pack(frame, P.tokenizer_path(), 256, payload={}).collect()
    assert {(x.doc_id, x.piece, x.length) for x in again} == {(x.doc_id, x.piece, x.length) for x in out} and "ids" not in again[0]


def test_repeated_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b", "", "")] * 7 + [(None, None, None, None)], SCHEMA)
    out = P.best_fit_pack(frame, P.tokenizer_path(), 8).collect()
    assert len(out) == 8 and len({(x.sequence_id, x.offset) for x in out}) == 8
    assert P.best_fit_pack(frame.limit(0), P.tokenizer_path()).collect() == []


def test_crc_of_ids(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, "the thea of", "", "")], SCHEMA)
    a = P.best_fit_pack(frame, P.tokenizer_path(), payload={"ids_crc32": F.crc32("ids"), "n": F.length("ids")}).first()
    b = P.best_fit_pack(frame, P.tokenizer_path()).first()
    assert a.ids_crc32 == zlib.crc32(bytes(b.ids)) and a.n == 4 * b.length


def test_a_tokenizer_that_keeps_white_space(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = " Two  spaces\n\nand, a stop. "
    x = P.best_fit_pack(spark.createDataFrame([(1, text, "", "")], SCHEMA), path).first()
    assert np.frombuffer(bytes(x.ids), "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("lower,split", [(False, True), (True, True), (True, False), (False, False)])
def test_tokenizers_of_another_make(spark, tmp_path, lower, split):
    """Word ends do not mean lower-casing, nor a cut before a full stop."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    signs = [*"abcdeABCDE.,", *(c + "</w>" for c in "abcdeABCDE.,")]
    vocabulary = {t: i for i, t in enumerate([*signs, "ab", "ab</w>", "AB</w>", "a.</w>", "<unk>"])}
    tok = Tokenizer(models.BPE(vocabulary, [("a", "b"), ("a", "b</w>"), ("A", "B</w>"), ("a", ".</w>")], unk_token="<unk>", end_of_word_suffix="</w>"))
    tok.normalizer = normalizers.Lowercase() if lower else None
    tok.pre_tokenizer = pre_tokenizers.BertPreTokenizer() if split else pre_tokenizers.WhitespaceSplit()
    tok.save(path := f"{tmp_path}/tokenizer.json")
    texts = ["AB ab a. aB, C", "Ab.cd", "", "  ab\n\nAB a.b"]
    out = P.best_fit_pack(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA), path).collect()
    assert {x.doc_id: np.frombuffer(bytes(x.ids), "<u4").tolist() for x in out} == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


@pytest.mark.parametrize("added", [["new york"], ["USA"], ["new york", "USA", "u.s.", "The"], []])
def test_added_tokens(tmp_path, added):
    """Plain and case-sensitive ones, which parts of a text would miss or find where the whole does not."""
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(P.tokenizer_path())
    tok.add_tokens([AddedToken(a, normalized=n) for a in added for n in (a != "USA",)])
    tok.save(path := f"{tmp_path}/tokenizer.json")
    encode = P._Encoder(path)
    assert encode.by_chunk
    texts = ["In New  York now", "the usa and the USA", "u.s. and U.S. new\nyork", "<|ENDOFTEXT|> or <|endoftext|>x", "a clean text, of words.", "\u212aelvin usa", "newyork", ""]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encode(texts) == want and encode(texts[::-1]) == want[::-1]


def test_only_known_definitions_work_on_parts():
    import json

    from tokenizers import Tokenizer

    known = json.loads(Tokenizer.from_file(P.tokenizer_path()).to_str())
    assert P.works_on_parts(known)
    other = [{"normalizer": None}, {"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**known["model"], "dropout": 0.1}}, {"added_tokens": [{"content": "é"}]}, {"model": {"type": "WordPiece"}}]
    assert not any(P.works_on_parts(known | x) for x in other)
