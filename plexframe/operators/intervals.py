"""Interval algebra over (contig, start, stop), half open; DataFrame in, DataFrame out, lazy.

Joins bin both sides, so they are equi-joins on (contig, bin); a pair that
shares several bins is kept in one of them only, without a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

BIN = 128
#: Intervals of more bins than this are joined by coarser bins, COARSE times as wide.
LONG, COARSE = 64, 4096
#: Bases that one window runs over at most; what crosses a tile's edge is carried over as one row.
TILE = 1 << 20


def binned(df: DataFrame, size: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """A row per bin that an interval touches, fine ones only if it is short; empty intervals vanish.

    Columns bin, level (0 fine, 1 coarse) and own (the interval's level).
    """
    own = (F.col(stop) - F.col(start) > LONG * size).cast("int")
    bins = lambda level, width: F.transform(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width)), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))
    none = F.array().cast("array<struct<level: int, bin: bigint>>")
    at = F.concat(F.when(own == 0, bins(0, size)).otherwise(none), bins(1, size * COARSE))
    return df.where(F.col(start) < F.col(stop)).withColumn("own", own).withColumn("at", F.explode(at)).withColumns({"level": F.col("at.level"), "bin": F.col("at.bin")}).drop("at")


def range_join(left: DataFrame, right: DataFrame, size: int = BIN) -> DataFrame:
    """All overlapping pairs once; columns of the right side get the prefix r_.

    Two short intervals meet in fine bins, others in coarse ones, so that a
    whole contig costs hundreds of rows, not millions.
    """
    right = right.select(*[F.col(c).alias("r_" + c) for c in right.columns])
    a = binned(left, size)
    b = binned(right, size, "r_start", "r_stop").withColumnsRenamed({"bin": "r_bin", "level": "r_level", "own": "r_own"})
    width = F.when(F.col("level") == 0, size).otherwise(size * COARSE)
    first = F.floor(F.greatest("start", "r_start") / width)
    on = (a.contig == b.r_contig) & (F.col("level") == F.col("r_level")) & (F.col("bin") == F.col("r_bin"))
    on &= (F.col("start") < F.col("r_stop")) & (F.col("stop") > F.col("r_start")) & (F.col("level") == F.greatest("own", "r_own")) & (F.col("bin") == first)
    # Exploded rows are estimated as one each: without the hint millions of bins of a small table may be broadcast.
    return a.hint("merge").join(b, on).drop("bin", "level", "own", "r_bin", "r_level", "r_own", "r_contig")


def overlap_flag(left: DataFrame, right: DataFrame, size: int = BIN) -> DataFrame:
    """Appends ``overlaps``: whether a row overlaps any right row. Filter by it for a semi or an anti join."""
    at = ["contig", "start", "stop"]
    hit = range_join(left.select(*at).distinct(), right, size).select(*at).distinct().withColumn("hit", F.lit(True))
    return left.join(hit, at, "left").withColumn("overlaps", F.coalesce("hit", F.lit(False))).drop("hit")


def closest(left: DataFrame, right: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """Per left row the overlapping right interval whose start is nearest to the row's; ties to one that holds the row's start, then the smaller start and stop."""
    away = F.abs(F.col("start") - F.col("r_start"))
    outside = ~((F.col("start") >= F.col("r_start")) & (F.col("start") < F.col("r_stop")))
    best = F.min(F.struct(away.alias("distance"), outside.alias("outside"), "r_start", "r_stop"))
    return range_join(left, right, size).groupBy(key).agg(best.alias("b")).select(key, "b.r_start", "b.r_stop", "b.distance")


def _tiled(df: DataFrame, keys: tuple[str, ...], carried: dict[str, Column], running: str = "max") -> DataFrame:
    """Appends ``tile`` and, for each name, what earlier tiles of the key carry over: the running maximum, or the ``last`` tile's.

    One row per tile travels; a contig has as many as its length holds.
    """
    tiled = df.withColumn("tile", F.floor(F.col("start") / TILE))
    per = tiled.groupBy(*keys, "tile").agg(*[c.alias(n) for n, c in carried.items()])
    w = Window.partitionBy(*keys).orderBy("tile")
    before = (lambda n: F.max(n).over(w.rowsBetween(Window.unboundedPreceding, -1))) if running == "max" else (lambda n: F.lag(n).over(w))
    per = per.select(*[F.col(k).alias("t_" + k) for k in keys], F.col("tile").alias("t_tile"), *[before(n).alias(n) for n in carried])
    on = F.col("tile") == F.col("t_tile")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col("t_" + k))
    return tiled.join(per, on).drop("t_tile", *["t_" + k for k in keys])


def _islands(marked: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """Appends ``island``: the number of rows of the key so far whose ``fresh`` is 1, counted within tiles and over them."""
    w = Window.partitionBy(*keys, "tile").orderBy(*order)
    per = marked.groupBy(*keys, "tile").agg(F.sum("fresh").alias("n_fresh"))
    before = F.coalesce(F.sum("n_fresh").over(Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(k).alias("t_" + k) for k in keys], F.col("tile").alias("t_tile"), before.alias("begun"))
    on = F.col("tile") == F.col("t_tile")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col("t_" + k))
    return marked.join(per, on).withColumn("island", F.col("begun") + F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge(df: DataFrame, distance: int | None = 0, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Unions of intervals: distance None joins overlapping ones only, d >= 0 also those up to d apart (0: touching).

    Equal intervals become one row first; windows run over tiles.
    """
    once = df.groupBy(*keys, "start", "stop").agg(F.count("*").alias("n"))
    tiled = _tiled(once, keys, {"before": F.max("stop")})
    reach = F.greatest("before", F.max("stop").over(Window.partitionBy(*keys, "tile").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)))
    joins = F.col("start") < reach if distance is None else F.col("start") <= reach + distance
    marked = tiled.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return _islands(marked, keys, ["start", "stop"]).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("island")


def merge_adjacent(df: DataFrame, keys: tuple[str, ...] = ("contig",), same: tuple[str, ...] = ()) -> DataFrame:
    """Joins neighbours where the next starts exactly at the last stop, and ``same`` columns are equal; windows run over tiles."""
    tiled = _tiled(df, keys, {"before": F.max(F.struct("start", "stop", *same))}, "last")
    w = Window.partitionBy(*keys, "tile").orderBy("start", "stop")
    last = F.coalesce(F.lag(F.struct("start", "stop", *same)).over(w), F.col("before"))
    marked = tiled.withColumn("last", last)
    link = F.col("last.stop") == F.col("start")
    for c in same:
        link &= F.col("last")[c].eqNullSafe(F.col(c))
    marked = marked.withColumn("fresh", F.when(F.coalesce(link, F.lit(False)), 0).otherwise(1)).drop("last", "before")
    return _islands(marked, keys, ["start", "stop"]).groupBy(*keys, "island", *same).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def pad_merge(df: DataFrame, padding: int, lengths: DataFrame) -> DataFrame:
    """Widens intervals, clips them to their contig (contig, length) and merges touching ones."""
    wide = df.join(lengths, "contig").select("contig", F.greatest(F.col("start") - padding, F.lit(0)).alias("start"), F.least(F.col("stop") + padding, "length").alias("stop"))
    return merge(wide, 0)


def subtract(left: DataFrame, right: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """What of each left interval (identified by ``key``) no right interval covers.

    Left intervals are cut at the tiles' edges, so that the cuts of a piece
    that travel as one array are bounded; pieces that touch are joined again.
    """
    rest = [c for c in left.columns if c not in ("start", "stop")]
    tile = F.explode(F.sequence(F.floor(F.col("start") / TILE), F.floor((F.col("stop") - 1) / TILE)))
    pieces = left.where("start < stop").withColumn("tile", tile).withColumns({"start": F.greatest("start", F.col("tile") * TILE), "stop": F.least("stop", (F.col("tile") + 1) * TILE)}).drop("tile")
    cuts = range_join(pieces, merge(right, 0).drop("n"), size).groupBy(key, "start").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start").alias("cut_start"), F.col("r_stop").alias("cut_stop")))).alias("cuts"))
    gathered = pieces.join(cuts, [key, "start"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)))
    begins = F.concat(F.array(F.col("start")), F.transform("cuts", lambda c: c["cut_stop"]))
    ends = F.concat(F.transform("cuts", lambda c: c["cut_start"]), F.array(F.col("stop")))
    parts = gathered.withColumn("part", F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))))
    parts = parts.select(*rest, F.col("part.b").alias("start"), F.col("part.e").alias("stop")).where("start < stop")
    return merge_adjacent(parts, keys=tuple(rest)).drop("n").select(*rest, "start", "stop")


def complement(df: DataFrame, lengths: DataFrame, trim: int = 0, least: int = 1) -> DataFrame:
    """The gaps of each contig (contig, length) between the intervals, ``trim`` shorter at both ends, ``least`` long at least."""
    edge = lengths.select("contig", F.col("length").alias("start"), F.col("length").alias("stop"))
    tiled = _tiled(merge(df, 0).select("contig", "start", "stop").unionByName(edge), ("contig",), {"before": F.max("stop")})
    last = F.coalesce(F.lag("stop").over(Window.partitionBy("contig", "tile").orderBy("start")), "before", F.lit(0))
    out = tiled.select("contig", (last + trim).alias("start"), (F.col("start") - trim).alias("stop"))
    return out.where(F.col("stop") - F.col("start") >= least)


def split_windows(df: DataFrame, size: int) -> DataFrame:
    """Pieces of ``size`` from the start on; the last may be shorter."""
    out = df.withColumn("piece", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(size).cast("long"))))
    return out.withColumns({"start": F.col("piece"), "stop": F.least(F.col("piece") + size, F.col("stop"))}).drop("piece")


def split_equal(df: DataFrame, size: int) -> DataFrame:
    """ceil(length / size) pieces with integer bounds start + i * length / n."""
    length = F.col("stop") - F.col("start")
    out = df.withColumns({"len": length, "n": F.ceil(length / size)}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    bound = lambda i: F.expr(f"start + ({i}) * len div n")
    return out.withColumns({"a": bound("i"), "b": bound("i + 1")}).withColumns({"start": F.col("a"), "stop": F.col("b")}).drop("a", "b", "i", "len", "n")


def balanced_cuts(weights: DataFrame, parts: int) -> DataFrame:
    """Appends ``part``: (contig, pos) rows dealt in order so that parts carry about equal weight."""
    total = Window.partitionBy("contig")
    upto = Window.partitionBy("contig").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum("weight").over(upto), F.lit(0))
    return weights.withColumn("part", F.least(F.floor(done * parts / F.sum("weight").over(total)), F.lit(parts - 1)).cast("long"))


def contig_rank(df: DataFrame, order: DataFrame) -> DataFrame:
    """Appends ``rank`` of (contig, rank); contigs that aren't listed come last, by name, nulls at the end.

    The window runs over the distinct contigs that aren't listed.
    """
    most = order.agg(F.coalesce(F.max("rank"), F.lit(0)).cast("long").alias("most"))
    other = df.select("contig").distinct().join(order, "contig", "left_anti").crossJoin(F.broadcast(most))  # one row
    other = other.select("contig", (F.col("most") + F.row_number().over(Window.orderBy(F.col("contig").asc_nulls_last()))).alias("rank"))
    ranks = order.select("contig", F.col("rank").cast("long").alias("rank")).unionByName(other).withColumnRenamed("contig", "rank_of")
    return df.join(ranks, F.col("contig").eqNullSafe(F.col("rank_of")), "left").drop("rank_of")


def canonical(contig: Column) -> Column:
    """Not an alternate, viral or mitochondrial contig."""
    return ~contig.contains("_") & ~contig.isin("chrEBV", "chrM")


def partition(df: DataFrame, size: int, homopolymers: DataFrame | None = None) -> DataFrame:
    """Pieces of ``size`` of every region; a piece that ends inside a homopolymer (contig, start, stop) runs on to its end, where the next begins.

    Without homopolymers these are ``split_windows``.
    """
    pieces = split_windows(df, size)
    if homopolymers is None:
        return pieces
    rest = [c for c in df.columns if c not in ("contig", "start", "stop")]
    whole = df.select("contig", F.col("start").alias("w_start"), F.col("stop").alias("w_stop"), *rest)
    inner = pieces.join(whole, ["contig", *rest]).where((F.col("start") >= F.col("w_start")) & (F.col("stop") <= F.col("w_stop")))
    cuts = inner.select("contig", F.col("stop").alias("cut")).distinct()
    inside = range_join(cuts.withColumns({"start": F.col("cut"), "stop": F.col("cut") + 1}), homopolymers.select("contig", "start", "stop")).where("cut > r_start").select("contig", "cut", F.col("r_stop").alias("moved"))
    ends = inner.join(inside.withColumnRenamed("cut", "stop"), ["contig", "stop"], "left").withColumn("stop", F.least("w_stop", F.coalesce("moved", "stop")))
    w = Window.partitionBy("contig", "w_start", "w_stop", *rest).orderBy("start")
    return ends.withColumn("start", F.coalesce(F.lag("stop").over(w), "start")).where("start < stop").select(*df.columns)
