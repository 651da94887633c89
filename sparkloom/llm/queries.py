"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extract, langid, ngram_join, packing, quality, quotes, secrets, sharding, substrings
from .common import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": lambda s, d: sharding.assign_slots(documents(s, d)),
    "op2_decontamination": lambda s, d: decontaminate.leaks(documents(s, d), table(s, d, "benchmark")),
    "op3_langid": lambda s, d: langid.identify(documents(s, d)),
    "op4_packing": lambda s, d: packing.digest(documents(s, d)),
    "op5_substrings": lambda s, d: substrings.digest(documents(s, d)),
    "op6_quotes": lambda s, d: quotes.link(table(s, d, "conversations")),
    "op7_ngram_join": lambda s, d: ngram_join.digest(documents(s, d)),
    "op8_secrets": lambda s, d: secrets.digest(documents(s, d)),
    "op9_extraction": lambda s, d: extract.main_text(table(s, d, "pages")),
    "op10_quality": lambda s, d: quality.judge(documents(s, d)),
}

ORACLE_SQL: dict[str, str] = {"op7_ngram_join": ngram_join.ORACLE_SQL, "op1_sharding": sharding.oracle_sql(), "op5_substrings": substrings.ORACLE_SQL, "op6_quotes": quotes.ORACLE_SQL, "op10_quality": quality.oracle_sql()}
