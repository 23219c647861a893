"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, divergence, exact_dedup, jaccard_join, language_id, packing, periodic_runs, pii, quality, sharding, substring_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_warc_derivatives": warc.op3_warc_derivatives,
    "op4_ordinal_quality": quality.op4_ordinal_quality,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_language_id": language_id.op6_language_id,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_kmeans_tree": ann.op9_kmeans_tree,
    "op10_weak_pii": pii.op10_weak_pii,
    "op11_sampled_splitters": sharding.op11_sampled_splitters,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_source_divergence": divergence.op13_source_divergence,
    "language_id_pages": language_id.language_id_pages,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_sampled_splitters": sharding.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
