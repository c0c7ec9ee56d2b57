"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontam, fingerprint, hardneg, linededup, merkle, neardup, ngramjoin, packing, preference, sharding, toxicity, urlfilter, warc

QUERIES = (
    toxicity.op1_toxicity,
    urlfilter.op2_url_filter,
    preference.op3_preference_formatting,
    sharding.op4_minimax_sharding,
    linededup.op5_line_dedup,
    ngramjoin.op6_ngram_jaccard,
    decontam.op7_benchmark_decontamination,
    warc.op8_warc_archives,
    fingerprint.op9_document_fingerprints,
    packing.op10_best_fit_packing,
    neardup.op11_minhash_neardup,
    merkle.op12_merkle_manifest,
    hardneg.op13_hard_negatives,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_benchmark_decontamination": decontam.OP7_SQL,
        "op8_warc_archives": warc.OP8_SQL,
        "op11_minhash_neardup": neardup.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
        "op13_hard_negatives": hardneg.OP13_SQL,
    }
