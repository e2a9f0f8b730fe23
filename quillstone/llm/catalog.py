"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf))


QUERIES["op1_simhash_near_dedup"] = op1_simhash_near_dedup


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    from .bpe import digests

    return digests(documents(spark, sf))


QUERIES["op8_byte_bpe"] = op8_byte_bpe


def op6_fertility_rules(spark: SparkSession, sf: str) -> DataFrame:
    from .fertility import rules

    return rules(documents(spark, sf))


QUERIES["op6_fertility_rules"] = op6_fertility_rules


def op5_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from .quality import classify

    return classify(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


QUERIES["op5_quality_classifier"] = op5_quality_classifier


def op7_two_pass_shards(spark: SparkSession, sf: str) -> DataFrame:
    from .sharding import digests

    return digests(documents(spark, sf))


def op4_crf_language(spark: SparkSession, sf: str) -> DataFrame:
    from .langid import identify

    return identify(documents(spark, sf))


QUERIES["op7_two_pass_shards"] = op7_two_pass_shards
QUERIES["op4_crf_language"] = op4_crf_language


def op2_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark.read.parquet(f"{sf}/pages.parquet"))


from .warc import ORACLE as _WARC  # noqa: E402

QUERIES["op2_warc_archive"] = op2_warc_archive
ORACLES["op2_warc_archive"] = _WARC


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op10_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    from .rollup import maintained

    return maintained(documents(spark, sf))


from .rollup import ORACLE as _ROLLUP  # noqa: E402

QUERIES["op9_decontamination"] = op9_decontamination
QUERIES["op10_token_rollup"] = op10_token_rollup
ORACLES["op10_token_rollup"] = _ROLLUP


def op3_repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    from .substrings import digests

    return digests(documents(spark, sf)).withColumn("repeats", F.col("n_removed") > 0)


QUERIES["op3_repeated_substrings"] = op3_repeated_substrings
