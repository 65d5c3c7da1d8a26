"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dedup, fingerprint, html, mixing, packing, quality, rules, tokens, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [dedup.op1_dart_minhash, rules.op2_divergence_rules, packing.op3_best_fit_packing, mixing.op4_multinomial_mix, quality.op5_neighbour_votes, urls.op6_bloom_url_filter, warc.op7_revisit_resolution, fingerprint.op8_oph_fingerprints, tokens.op9_token_files, html.op10_ratio_extraction]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op6_bloom_url_filter": urls.OP6_SQL, "op7_revisit_resolution": warc.OP7_SQL}
