"""Read filters, read metrics and base-accuracy tables: one pass of conditional sums each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from plexframe.functions.numbers import phred


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def passes(mapq: str = "mapq", flag: str = "flag", least: int = 4, exclude: int = 3332) -> Column:
    """The read-level filter: mapping quality, and none of the excluded flag bits."""
    return (F.col(mapq) >= least) & (F.col(flag).bitwiseAND(exclude) == 0)


def passes_rescued(flag: str, rescued: str, exclude: int, secondary: int = 256) -> Column:
    """As the flag filter, but a rescued secondary record passes if no other excluded bit is set."""
    hit = F.col(flag).bitwiseAND(exclude)
    return (hit == 0) | (F.coalesce(F.col(rescued), F.lit(False)) & (hit == secondary))


def good_secondary(score: str, length: str, least: float) -> Column:
    """Alignment score per base of at least ``least``; false without score or length."""
    return F.coalesce((F.col(length) > 0) & (F.col(score) / F.col(length) >= least), F.lit(False))


def discard_counts(reads: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, reads: each failing rule counts by itself; ``any`` counts a read once, ``kept`` those without one."""
    any_ = F.lit(False)
    for rule in rules.values():
        any_ = any_ | F.coalesce(rule, F.lit(False))
    sums = reads.agg(*[count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()], count_if(any_).alias("any"), count_if(~any_).alias("kept"))
    names = [*rules, "any", "kept"]
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("reads")) for n in names])).alias("x")).select("x.*")


def read_metrics(reads: DataFrame, keep: Column) -> DataFrame:
    """Counts and bases before and after the filter ``keep``, one row."""
    bases = F.col("stop") - F.col("start")
    return reads.agg(
        F.count("*").alias("alignments"), count_if(keep).alias("passing"), F.sum(bases).alias("bases"), F.sum(F.when(keep, bases).otherwise(0)).alias("passing_bases"),
        F.countDistinct("molecule").alias("molecules"), count_if(F.col("errors") == 0).alias("perfect"), F.avg("mapq").alias("mean_mapq"),
    )


def gate(profile: DataFrame, least_depth: int, most_fraction: float) -> DataFrame:
    """Appends status to positions (depth, top_alt): low_depth, then high_alt, else used."""
    return profile.withColumn("status", F.when(F.col("depth") < least_depth, "low_depth").when(F.col("top_alt") / F.col("depth") > most_fraction, "high_alt").otherwise("used"))


def alt_profile(bases: DataFrame, keys: list[str], ref: str, alt: str) -> DataFrame:
    """Per position the depth and the largest count of a single allele that isn't the reference."""
    each = bases.groupBy(*keys, ref, alt).agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.sum("n").alias("depth"), F.coalesce(F.max(F.when(F.col(ref) != F.col(alt), F.col("n"))), F.lit(0)).alias("top_alt"))


def substitutions(bases: DataFrame, ref: str, alt: str, strand: str, forward: str) -> DataFrame:
    """ref, alt, total, forward, reverse of every change."""
    return bases.where(F.col(ref) != F.col(alt)).groupBy(ref, alt).agg(F.count("*").alias("total"), count_if(F.col(strand) == forward).alias("forward"), count_if(F.col(strand) != forward).alias("reverse"))


def error_summary(rows: DataFrame, keys: list[str], errors: str, bases: Column) -> DataFrame:
    """keys, errors, bases, percent (5 places) and phred (2 places, 93 at most; null without bases)."""
    e, b = F.sum(errors), F.sum(bases)
    out = rows.groupBy(*keys).agg(e.alias("errors"), b.alias("bases"))
    rate = F.col("errors") / F.nullif(F.col("bases"), F.lit(0))
    return out.withColumns({"percent": F.round(100 * rate, 5), "phred": F.round(phred(rate), 2)})


def capped(n: str, most: int) -> Column:
    return F.when(F.col(n) > most, F.lit(f"{most}+")).otherwise(F.col(n).cast("string"))


def runs(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Maximal runs of equal values in order: keys, value, first, last, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("run")


def run_table(run_rows: DataFrame, value: str) -> DataFrame:
    """Counts by (value, length) and, value null, by length alone."""
    return run_rows.groupingSets([[F.col(value), F.col("length")], [F.col("length")]], F.col(value), F.col("length")).agg(F.count("*").alias("runs"), F.sum("length").alias("bases"))


def masked_quality(run_rows: Column, qualities: str, least: int) -> Column:
    """A run whose smallest quality is at most ``least`` gets that quality throughout."""
    low = F.array_min(qualities)
    return F.when(low <= least, F.transform(qualities, lambda _: low)).otherwise(F.col(qualities))
