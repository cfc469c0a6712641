"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sifter.llm import decontaminate, divergence, language, licenses, lines, packing, quality, resample, rules, sharding, simhash, substring, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_lines": lines.op2_lines,
        "op3_licenses": licenses.op3_licenses,
        "op4_packing": packing.op4_packing,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_quality": quality.op6_quality,
        "op7_urls": urls.op7_urls,
        "op8_sharding": sharding.op8_sharding,
        "op9_substring": substring.op9_substring,
        "op10_rules": rules.op10_rules,
        "op11_divergence": divergence.op11_divergence,
        "op12_language": language.op12_language,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lines": lines.OP2_SQL,
        "op7_urls": urls.OP7_SQL,
        "op9_substring": substring.OP9_SQL,
        "op11_divergence": divergence.OP11_SQL,
        "op13_resample": resample.OP13_SQL,
    }
