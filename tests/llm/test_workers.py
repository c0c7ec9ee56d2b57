import weakref
from collections import Counter

import pytest

from landgraph.llm import common, decontam, packing, toxicity


def a_scorer():
    plain, toxic = Counter({b"calm%d" % i: 2 for i in range(300)}), Counter({b"vile%d" % i: 9 for i in range(30)})
    dictionaries = toxicity.Dictionaries.train(plain, toxic)
    assert toxicity.scorer(dictionaries) is toxicity.scorer(dictionaries)
    return weakref.ref(toxicity.scorer(dictionaries))


def test_a_worker_keeps_what_one_operator_needs():
    """Workers go on from stage to stage of the pipeline: scorers and tokenizers must not pile up in them."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    was = a_scorer()
    encoder = packing._encoder(path)
    assert was() is None and packing._encoder(path) is encoder
    again, encoder = weakref.ref(encoder), None
    a_scorer()
    assert again() is None


def test_an_index_is_built_without_what_was_kept(spark):
    """In the worker that takes the task, whichever it is."""
    docs = spark.createDataFrame([(i, f"one two {i}") for i in range(8)], "doc_id long, text string").repartition(8)

    def leave(batches):
        common.kept("left", lambda: bytearray(1000))
        yield from batches

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._kept)] * len(b))], names=["n"])

    assert docs.mapInArrow(leave, docs.schema).count() == 8
    decontam.build_index(docs)
    assert docs.mapInArrow(count, "n long").agg({"n": "min"}).first()[0] == 0
