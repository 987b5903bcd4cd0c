"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, divergence, language_id, license_scan, media, merkle, mixing, quality_rules, simhash, token_files, tree_weighting, url_filter, weak_quality
from .common import ship

_MODULES = {
    "op1_token_files": token_files,
    "op2_weak_quality": weak_quality,
    "op3_simhash": simhash,
    "op4_url_filter": url_filter,
    "op5_media": media,
    "op6_mixing": mixing,
    "op7_language_id": language_id,
    "op8_tree_weighting": tree_weighting,
    "op9_byte_bpe": byte_bpe,
    "op10_quality_rules": quality_rules,
    "op11_source_divergence": divergence,
    "op12_merkle_manifest": merkle,
    "op13_license_scan": license_scan,
}


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(module.query) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
