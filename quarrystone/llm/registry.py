"""Queries of this subpackage and their SQL, for the driver entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, html, langid, mixing, quality, simhash, suffixdedup, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontam.op1_decontaminate,
        "op2_langid": langid.op2_langid,
        "op3_mix": mixing.op3_mix,
        "op4_simhash": simhash.op4_simhash,
        "op5_extract": html.op5_extract,
        "op6_quality": quality.op6_quality,
        "op7_ann": ann.op7_ann,
        "op8_suffixdedup": suffixdedup.op8_suffixdedup,
        "op9_urlfilter": urlfilter.op9_urlfilter,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontam.ORACLE_SQL,
        "op3_mix": mixing.ORACLE_SQL,
        "op8_suffixdedup": suffixdedup.ORACLE_SQL,
        "op9_urlfilter": urlfilter.ORACLE_SQL,
    }
