"""The test tables as canonical events.

Times become microseconds (long): exact, and a total order with the ordinal of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURE = "error"
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, us, ordinal, event_type, event_subtype, item, value."""
    half = F.when(F.regexp_extract("props", "([0-9]+)", 1).cast("int") < 50, "low").otherwise("high")
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("entity_id"), micros("ts").alias("us"), F.col("event_id").alias("ordinal"), "event_type", half.alias("event_subtype"), F.concat("event_type", F.lit(":"), half).alias("item"), "value")
