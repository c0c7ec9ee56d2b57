import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgraph.llm import toxicity as X


def corpus(n=900, seed=0):
    """Invented prose; the toxic ones hold words of a few stems with any ending."""
    r = random.Random(seed)
    parts = "an the on er ti re ou in ed es th ha st nd wh at le mo ri su ve pa".split()
    known = ["".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(1500)]
    bad = ["grumk", "vexxo", "plonk"]
    out = []
    for i in range(n):
        words, toxic = [r.choice(known) for _ in range(r.randrange(5, 200))], i % 8 == 0
        for _ in range(r.randrange(3, 7) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad) + r.choice([*parts, ""]))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def learned():
    rows = corpus()
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    return rows, X.ToxicityModel.fit([r[1] for r in kept], [r[2] for r in kept])


def test_held_out_accuracy(learned):
    rows, model = learned
    rest = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    scores, y = model.scores([r[1] for r in rest]), np.array([r[2] for r in rest])
    assert scores[y == 1].mean() > 0.8 and scores[y == 0].mean() < 0.05
    said = scores >= X.PREDICT
    assert (said & (y == 1)).sum() / (y == 1).sum() > 0.85 and (said & (y == 0)).sum() <= 2


def test_gain_is_the_difference_of_lengths(learned):
    _, model = learned
    made = X._Scorer(model.dictionaries)
    raw = model.dictionaries.carrier + X._spread(b"grumkan")
    assert made.gain(b"grumkan") == len(made.plain(raw)) - len(made.toxic(raw)) >= 5
    assert max(made.gain(w) for w in (b"the", b"anon", b"erti")) <= 2
    assert made.features(None) == made.features("") and len(made.features("x")) == 2 * len(X.THRESHOLDS) + 1


def test_rows_and_folds(spark, learned):
    rows, model = learned
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows[:40]] + [(None, None, None, None), (7, "", "", 0), (7, "", "", 0), (8, "word " * 40_000, "", 0)], "doc_id long, text string, score string, lang int")
    got = X.score_texts(frame, model).withColumn("held", X.held_out()).collect()
    assert len(got) == 44
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7)
        assert x.held == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    assert len({x.score for x in got if not x.text}) == 1


def test_learning_reads_no_held_out_label(spark):
    rows = corpus(240)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(1, 0, None), (None, 0, 1), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.learn(docs, labels), X.learn(docs.repartition(3), turned)
    assert np.array_equal(a.weights, b.weights) and a.dictionaries == b.dictionaries
    few = X.learn(docs, labels, most=20)
    assert 0 <= few.scores(["text"])[0] <= 1


def test_the_bounds_of_learning(spark):
    rows = corpus(240)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    small = X.learn(docs, labels, most_bytes=20_000)
    assert len(small.dictionaries.ordinary) < len(X.learn(docs, labels).dictionaries.ordinary)
    assert 0 <= X.learn(docs, labels, most_bytes=0).scores(["text"])[0] <= 1


def test_near_copies_of_one_label_are_learned_from_once():
    text = " ".join(f"w{k}" for k in range(300))
    other = " ".join(f"w{k}" if k < 150 else f"v{k}" for k in range(300))
    assert X.distinct_texts([text, f"{text} more", text, other, "", ""], [0, 0, 1, 0, 0, 1]) == [0, 2, 3, 4, 5]


def test_scores_do_not_depend_on_the_process():
    """Python's hash seed differs from process to process."""
    import os
    import subprocess
    import sys

    code = "import tests.llm.test_toxicity as t; r = t.corpus(200); m = t.X.ToxicityModel.fit([x[1] for x in r], [x[2] for x in r]); print(m.dictionaries.toxic[:500].hex(), m.weights.tolist(), m.scores([x[1] for x in r[:20]]).tolist())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": root}, cwd=root, capture_output=True, text=True, check=True).stdout for seed in ("1", "2")}
    assert len(said) == 1


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = X.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert X.score_texts(docs, model).count() == 1 and X.score_texts(docs.limit(0), model).collect() == []
