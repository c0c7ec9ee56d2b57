"""The pipeline against a brute-force version made of the operators' own ones."""

import importlib.util
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import test_decontam
import test_linededup
import test_ngramjoin

import corpus_pipeline as C
from landgraph.llm import packing, toxicity


def fixture(spark, folder):
    r = random.Random(4)
    parts = "an the on er ti re ou in ed es th ha st nd wh at le".split()
    known = ["".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(known) for _ in range(n))
    items = [(i, say(25)) for i in range(5)] + [(5, None)]
    docs, labels = [], []
    for i in range(300):
        lines = [say(r.randrange(1, 30)) for _ in range(r.randrange(1, 8))]
        toxic = i % 6 == 0
        if toxic:
            lines = [" ".join(w for x in line.split(" ") for w in ([x, r.choice(["grumk", "vexxo"]) + r.choice(parts)] if r.random() < 0.3 else [x])) for line in lines]
        if i % 10 == 3:
            lines[0] += " " + items[i % 5][1]
        if docs and i % 7 == 2:
            lines = docs[i // 2][1].split("\n") + lines[:1]
        docs.append((i, "\n".join(lines), "en", "src", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs += [(400, None, None, None, None), (401, "", "x", "y", 0), (402, "", "x", "y", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, labels, items


def test_against_brute_force(spark, tmp_path):
    docs, labels, items = fixture(spark, tmp_path)
    from tokenizers import Tokenizer

    texts = {d[0]: d[1] for d in docs}
    learn = sorted(k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1)
    toxic = {k: y for k, _, y in labels}
    model = toxicity.ToxicityModel.fit([texts[k] or "" for k in learn], [toxic[k] for k in learn])
    rows = [(k, t) for k, t in texts.items() if model.scores([t])[0] < 0.7]
    assert 200 < len(rows) < len(docs) - 20
    cleaned = test_linededup.by_hand(rows)
    rows = [(k, cleaned[k][2]) for k, _ in rows]
    classes = test_ngramjoin.by_hand(rows)
    rows = [(k, t) for k, t in rows if classes[k][0] == k]
    hit = {x[0] for x in test_decontam.by_hand(rows, items) if x[-1]}
    rows = [(k, t) for k, t in rows if k not in hit]
    assert hit
    tok, want = Tokenizer.from_file(packing.tokenizer_path()), {}
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            want[k, p // 4096] = (p, len(ids[p : p + 4096]), zlib.crc32(np.array(ids[p : p + 4096], dtype="<u4").tobytes()))
    got = C.run(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in got} == want
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 4096


def test_rows_of_one_id_or_none_are_told_apart(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(12))
    long = " ".join(f"w{k}" for k in range(40))
    docs = [(None, "one two three\nfour five six\nseven eight nine", "a"), (None, "alone here now", "b"), (None, "one two three\nother words follow", "c")]
    docs += [(7, f"x y z\n{item}\nlast line of it", "d"), (7, "one clean line", "e"), (None, f"{item} too", "f"), (8, f"{long} p", "g"), (None, f"{long} q", "h"), (8, f"{long} r", "i"), (8, "no copy", "j")]
    frame = spark.createDataFrame([(i, t, s, "src", 0) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda step: {x.lang: (x.doc_id, x.text) for x in step(spark, frame, str(tmp_path)).collect()}

    assert rows(C.drop_contaminated) == {s: (i, t) for i, t, s in docs if item not in t}
    assert rows(C.drop_near_duplicates) == {s: (i, t) for i, t, s in docs if s not in "gi"}
    got = rows(C.drop_repeated_lines)
    assert {s: i for s, (i, _) in got.items()} == {s: i for i, _, s in docs}
    left = sorted(x for _, t in got.values() for x in t.split("\n") if x)
    near = {x for _, t, _ in docs for x in t.split("\n") if x.startswith("w0") or x.startswith("b0")}
    once = {x for _, t, _ in docs for x in t.split("\n")} - near
    assert [x for x in left if x not in near] == sorted(once)
    assert len(left) == len(once) + 2


def test_stages_return_the_columns_and_stay_whole(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in C.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {401, 402, 400} <= {x.doc_id for x in out.where(F.col("doc_id") >= 400).collect()}, name
        empty = step(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
    assert importlib.util.find_spec("corpus_pipeline")
