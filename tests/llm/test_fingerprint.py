import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landgraph.llm import fingerprint as Q

SCHEMA = "doc_id long, text string, n_chars long, fingerprint string"


def words(r, n, known):
    return " ".join(r.choice(known) for _ in range(n))


def plain_digest(text):
    """The digest, counted one triplet after the other."""
    raw, counts, seen, mask = (text or "").encode("utf-8", "surrogatepass"), [0] * 256, Counter(), (1 << 64) - 1
    for i in range(len(raw) - 5):
        triplet = raw[i] << 16 | raw[i + 2] << 8 | raw[i + 5]
        h = (triplet * 0x9E3779B97F4A7C15 + seen[triplet] * 0xC2B2AE3D27D4EB4F) & mask
        seen[triplet] += 1
        counts[((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 56] += 1
    bounds = [sorted(counts)[k] for k in (63, 127, 191)]
    quartiles = [sum(c > b for b in bounds) for c in counts]
    length = int(math.log(len(raw) + 1) / math.log(1.5))
    return f"Q1{length:02x}" + "".join(f"{a * 64 + b * 16 + c * 4 + d:02x}" for a, b, c, d in zip(*[iter(quartiles)] * 4, strict=True))


def plain_likeness(a, b):
    nibbles = lambda m: [int(c, 16) >> s & 3 for c in m[4:] for s in (2, 0)]
    apart = sum(abs(x - y) for x, y in zip(nibbles(a), nibbles(b), strict=True)) + 4 * abs(int(a[2:4], 16) - int(b[2:4], 16))
    return 1 - min(320, apart) / 320


def by_hand(rows):
    """The contract, over rows (id, text) sorted by id."""
    out = {}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, c = plain_digest(text), plain_digest(edited), plain_digest(after)
        out[key] = (len(text), edited, a, b, plain_likeness(a, b), plain_likeness(a, c))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_edits_and_order_by_hand(spark, n):
    r = random.Random(n)
    known = ["".join(r.choice("abcdeéñß日") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    ids = r.sample(range(-(10**6), 10**12), n)
    texts = [r.choice([None, "", "é", words(r, r.randrange(1, 60), known), words(r, 2000, known), "hot copy"]) for _ in ids]
    rows = [(i, t, 7, "clash") for i, t in zip(ids, texts, strict=True)]
    got = Q.compare_with_edits(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = by_hand(sorted((i, t) for i, t, *_ in rows))
    assert len(got) == n
    for x in got:
        assert (x.n_chars, x.edited, x.fingerprint, x.edited_fingerprint, x.near_edited, x.near_next) == want[x.doc_id]
    marks = {x.doc_id: x.fingerprint for x in Q.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert marks == {x.doc_id: x.fingerprint for x in got}


def test_null_and_repeated_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d e f g", 1, "")] * 2 + [(5, "x y z", 1, "")] * 3, SCHEMA)
    got = Q.compare_with_edits(frame).collect()
    assert len(got) == 5 and sum(x.doc_id is None for x in got) == 2
    last = [x for x in got if x.doc_id == 5 and x.edited == "x y a"[:5]]
    assert len(last) == 1
    assert Q.compare_with_edits(frame.limit(0)).collect() == []


def test_edits_are_nearer_than_other_texts():
    r = random.Random(3)
    known = ["".join(r.choice("etaonihsrd") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    for n in (60, 400, 3000):
        texts = [words(r, n, known) for _ in range(30)]
        near, far = [], []
        for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
            k = len(a) // 4
            near.append(Q.likeness(Q.digest(a), Q.digest(a[: len(a) - k] + b[:k])))
            far.append(Q.likeness(Q.digest(a), Q.digest(b)))
        assert all(e > o for e, o in zip(near, far, strict=True)) and sum(near) / 30 > sum(far) / 30 + 0.1


def test_bounds_and_symmetry():
    r = random.Random(4)
    marks = [Q.digest(t) for t in (None, "", "a", "abcdefg", "z" * 10**6, "".join(map(chr, (r.randrange(32, 0x2FF) for _ in range(5000)))))]
    assert marks[0] == marks[1] and len({len(m) for m in marks}) == 1
    assert all(0 <= Q.likeness(a, b) <= 1 and Q.likeness(a, b) == Q.likeness(b, a) for a in marks for b in marks)
    assert all(Q.likeness(m, m) == 1 for m in marks)


def test_missing_column(spark):
    with pytest.raises(ValueError):
        Q.compare_with_edits(spark.range(2).withColumn("x", F.lit("")))
    with pytest.raises(ValueError):
        Q.compare_with_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
