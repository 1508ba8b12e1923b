"""The registered queries of this subpackage: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, licenses, mixing, neighbours, oracles, packing, pii, quality, secrets, simhash, substrings

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, digest: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: digest(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_robust_outliers": _over("documents", quality.digest),
        "op2_secret_scan": _over("documents", secrets.digest),
        "op3_license_scan": _over("documents", licenses.digest),
        "op4_substring_dedup": _over("documents", substrings.digest),
        "op5_pii": _over("documents", pii.digest),
        "op6_nearest_neighbours": _over("embeddings", neighbours.digest),
        "op7_curriculum_mix": _over("documents", mixing.digest),
        "op8_simhash_dedup": _over("documents", simhash.digest),
        "op9_packing": _over("documents", packing.digest),
        "op10_html_extraction": _over("pages", html.digest),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
