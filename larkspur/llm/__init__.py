"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import centroids, decontamination, exact_dedup, hard_negatives, licenses, ngram_join, packing, pieces, pii, quality, sharding, simhash, substrings

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_kd_sharding": sharding.op3_kd_sharding,
    "op4_pii": pii.op4_pii,
    "op5_simhash": simhash.op5_simhash,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_suffix_dedup": substrings.op7_suffix_dedup,
    "op8_quality": quality.op8_quality,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
