"""The driver tables read as the engine's inputs, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DAY = "datediff(to_date({}), date'1992-01-01')"


def reads(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as aligned reads."""
    day = F.expr(DAY.format("l_shipdate")).cast("long")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("contig"),
        day.alias("start"),
        (day + F.col("l_quantity").cast("long")).alias("stop"),
        F.round(F.col("l_discount") * 100).cast("long").alias("mapq"),
        F.col("l_linestatus").alias("strand"),
        F.col("l_returnflag").alias("cls"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"),
        F.col("l_orderkey").alias("molecule"),
        F.round(F.col("l_tax") * 100).cast("long").alias("errors"),
        F.col("l_partkey").alias("part"),
    )


READS = """reads AS (SELECT l_suppkey AS contig, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS start,
    date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS stop, round(l_discount * 100)::BIGINT AS mapq,
    l_linestatus AS strand, l_returnflag AS cls, l_orderkey * 10 + l_linenumber AS read_id, l_orderkey AS molecule,
    round(l_tax * 100)::BIGINT AS errors, l_partkey AS part FROM lineitem)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Every third window of 90 days of each supplier."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("contig"), F.explode(F.expr("sequence(0L, 42L, 3L)")).alias("k")).select("contig", (F.col("k") * 90).alias("start"), (F.col("k") * 90 + 90).alias("stop"))


REGIONS = "regions AS (SELECT s_suppkey AS contig, k * 90 AS start, k * 90 + 90 AS stop FROM supplier, range(0, 43, 3) AS t(k))"

LENGTH = 4000


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("contig"), F.lit(LENGTH).cast("long").alias("length"))


def signal(spark: SparkSession, d: str) -> DataFrame:
    """events as ordered observations of a contig."""
    return table(spark, d, "events").select(F.col("user_id").alias("contig"), F.col("event_id").alias("pos"), F.col("value"), F.col("event_type").alias("kind"))


SIGNAL = "signal AS (SELECT user_id AS contig, event_id AS pos, value, event_type AS kind FROM events)"
