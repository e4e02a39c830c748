"""Depth, coverage histograms and their statistics.

Depth comes from a sweep over interval ends, not from exploded positions:
a run of positions of one depth is one row. Intervals are cut at tiles, so
that a contig is swept by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from plexframe.operators.intervals import range_join, split_windows

TILE = 1 << 20


def depth_runs(reads: DataFrame, keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """Maximal runs per tile: keys, start, stop, depth > 0."""
    lo, hi = F.floor(F.col("start") / tile), F.floor((F.col("stop") - 1) / tile)
    cut = reads.where("start < stop").withColumn("tile", F.explode(F.sequence(lo, hi)))
    ends = cut.select(*keys, "tile", F.explode(F.array(
        F.struct(F.greatest(F.col("start"), F.col("tile") * tile).alias("pos"), F.lit(1).cast("long").alias("d")),
        F.struct(F.least(F.col("stop"), (F.col("tile") + 1) * tile).alias("pos"), F.lit(-1).cast("long").alias("d")),
    )).alias("e")).select(*keys, "tile", "e.*")
    steps = ends.groupBy(*keys, "tile", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys, "tile").orderBy("pos")
    runs = steps.select(*keys, "tile", F.col("pos").alias("start"), F.lead("pos").over(w).alias("stop"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return runs.where("depth > 0 AND stop IS NOT NULL").drop("tile")


def clipped(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Parts of reads inside regions (which don't overlap each other), with the region's bounds."""
    return range_join(reads, regions).withColumns({"start": F.greatest("start", "r_start"), "stop": F.least("stop", "r_stop")})


def histogram(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """depth -> positions of the regions; positions without reads are depth 0."""
    covered = depth_runs(clipped(reads, regions)).groupBy("depth").agg(F.sum(F.col("stop") - F.col("start")).alias("positions"))
    size = regions.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("all"))
    seen = covered.agg(F.coalesce(F.sum("positions"), F.lit(0)).alias("seen"))
    zero = size.crossJoin(seen).select(F.lit(0).cast("long").alias("depth"), (F.col("all") - F.col("seen")).alias("positions")).where("positions > 0")  # one row each
    return zero.unionByName(covered)


def cap(hist: DataFrame, most: int, bin_: str = "depth", n: str = "positions") -> DataFrame:
    """Folds the bins above ``most`` into one, named with a plus."""
    name = F.when(F.col(bin_) > most, F.lit(f"{most}+")).otherwise(F.col(bin_).cast("string"))
    return hist.groupBy(name.alias(bin_)).agg(F.sum(n).alias(n))


def nearest_rank(hist: DataFrame, percents: list[float], bin_: str = "depth", n: str = "positions", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, percent, value: the smallest bin whose cumulative count reaches the percentage (0: the least, 100: the most)."""
    w = Window.partitionBy(*keys).orderBy(bin_)  # a histogram: a row per bin
    cum = hist.where(F.col(n) > 0).withColumns({"cum": F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(n).over(Window.partitionBy(*keys))})
    asked = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    hit = cum.withColumn("percent", asked).where(F.col("cum") * 100 >= F.col("total") * F.col("percent"))
    return hit.groupBy(*keys, "percent").agg(F.min(bin_).alias("value"))


def moments(hist: DataFrame, bin_: str = "depth", n: str = "positions") -> DataFrame:
    """count, mean and population standard deviation of a histogram."""
    x, k = F.col(bin_).cast("double"), F.col(n)
    mean = F.sum(x * k) / F.sum(k)
    return hist.agg(F.sum(k).alias("count"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(x * x * k) / F.sum(k) - mean * mean, F.lit(0.0))).alias("sd"), F.min(F.when(k > 0, F.col(bin_))).alias("least"), F.max(F.when(k > 0, F.col(bin_))).alias("most"))


def at_least(hist: DataFrame, cutoffs: list[int], bin_: str = "depth", n: str = "positions") -> DataFrame:
    """cutoff, positions and percent of the positions in bins of at least the cutoff."""
    total = F.sum(n).over(Window.partitionBy())  # a histogram: a row per bin
    rows = hist.withColumn("total", total).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    hit = F.sum(F.when(F.col(bin_) >= F.col("cutoff"), F.col(n)).otherwise(0))
    return rows.groupBy("cutoff").agg(hit.alias("positions"), (100.0 * hit / F.max("total")).alias("percent"))


def uniformity(hist: DataFrame, bin_: str = "depth", n: str = "positions") -> DataFrame:
    """mean, fold80 = mean / p20 (null if p20 is 0), and the percentage from floor(mean / 2) to floor(2 * mean)."""
    p20 = nearest_rank(hist, [20.0], bin_, n).select(F.col("value").alias("p20"))
    m = moments(hist, bin_, n).select("mean", "count")
    one = hist.crossJoin(F.broadcast(m))
    inside = F.sum(F.when((F.col(bin_) >= F.floor(F.col("mean") / 2)) & (F.col(bin_) <= F.floor(F.col("mean") * 2)), F.col(n)).otherwise(0))
    share = one.groupBy("mean", "count").agg((100.0 * inside / F.col("count")).alias("within"))
    return share.crossJoin(F.broadcast(p20)).select("mean", (F.col("mean") / F.nullif(F.col("p20"), F.lit(0))).alias("fold80"), "within")


def interval_coverage(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region: reads, bases, average depth and mean mapping quality (null without reads)."""
    shared = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    j = range_join(reads, regions).groupBy("contig", "r_start", "r_stop").agg(F.count("*").alias("reads"), F.sum(shared).alias("bases"), F.avg("mapq").alias("mean_mapq"))
    j = j.withColumnsRenamed({"r_start": "start", "r_stop": "stop"})
    out = regions.join(j, ["contig", "start", "stop"], "left").fillna(0, ["reads", "bases"])
    return out.withColumn("avg_depth", F.col("bases") / (F.col("stop") - F.col("start")))


def windows(regions: DataFrame, size: int) -> DataFrame:
    return split_windows(regions, size)
