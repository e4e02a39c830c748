"""Copy number: normalisation, smoothing, segmentation, likelihoods and calls.

Whatever is a row-wise formula, a window or an aggregate is a DataFrame
expression. The order-dependent kernels work on one seed segment (contig)
at a time through ``applyInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from plexframe.functions.numbers import copies_of_log_ratio, expected_baf, expected_log_ratio, log_student_pdf
from plexframe.operators.ranks import quantile, quantiles

#: log2 of a hundredth, to six places: the least log ratio.
FLOOR = -6.643856


def self_log_ratio(rows: DataFrame, count: str, autosome: Column) -> DataFrame:
    """Appends log_ratio: log2(count) - log2(median autosomal count), FLOOR at least and for zero counts."""
    median = quantile(rows.where(autosome), count, 0.5)
    value = F.log2(count) - F.log2(F.lit(median).cast("double"))
    return rows.withColumn("log_ratio", F.when((F.col(count) <= 0) | value.isNull(), FLOOR).otherwise(F.greatest(value, F.lit(FLOOR))))


def pair_log_ratio(rows: DataFrame, tumor: str, normal: str) -> DataFrame:
    """Appends log_ratio of the fractions of the totals: minus infinity becomes the least finite value, then median-centred."""
    totals = rows.agg(F.sum(tumor).alias("t"), F.sum(normal).alias("n"))
    raw = rows.crossJoin(F.broadcast(totals)).withColumn("raw", F.when((F.col(tumor) > 0) & (F.col(normal) > 0), F.log2((F.col(tumor) / F.col("t")) / (F.col(normal) / F.col("n"))))).drop("t", "n")  # one row
    centre = raw.agg(F.min("raw").alias("least"))
    filled = raw.crossJoin(F.broadcast(centre)).withColumn("raw", F.when(F.col(normal) > 0, F.coalesce("raw", "least")))
    return filled.withColumn("log_ratio", F.col("raw") - F.lit(quantile(filled, "raw", 0.5)).cast("double")).drop("raw", "least")


def panel_medians(panel: DataFrame, keys: list[str], sample: str, count: str) -> DataFrame:
    """Per interval the median over samples of the fraction of the sample's total; totals and medians are aggregates."""
    totals = panel.groupBy(sample).agg(F.sum(count).alias("total"))
    return panel.join(totals, sample).groupBy(*keys).agg(F.percentile(F.col(count) / F.nullif("total", F.lit(0)), F.lit(0.5)).alias("panel"))


def panel_log_ratio(rows: DataFrame, medians: DataFrame, keys: list[str], count: str, impute: float = 1e-9) -> DataFrame:
    """log2 of the row's fraction over the panel's median, zeros imputed."""
    total = rows.agg(F.sum(count).alias("total"))
    j = rows.join(medians, keys).crossJoin(F.broadcast(total))
    return j.withColumn("log_ratio", F.log2(F.greatest(F.col(count) / F.col("total"), F.lit(impute)) / F.greatest("panel", F.lit(impute)))).drop("total")


#: Places of an ordered signal that one window runs over; the last value before them is carried over.
STRETCH = 1 << 16


def first_differences(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Appends ``diff`` to the row before in a numeric order; a key's first row has none and goes. Windows run over stretches of the order."""
    cut = rows.withColumn("stretch", F.floor(F.col(order) / STRETCH))
    last = cut.groupBy(*keys, "stretch").agg(F.max_by(value, order).alias("end"))
    carried = last.withColumn("carried", F.lag("end").over(Window.partitionBy(*keys).orderBy("stretch"))).drop("end")
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*keys, "stretch").orderBy(order)), F.col("carried"))
    return cut.join(carried, [*keys, "stretch"]).withColumn("diff", F.col(value) - before).where("diff IS NOT NULL").drop("stretch", "carried")


def difference_sd(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, sd: 1.4826 times the median absolute deviation of first differences, over root two; for few keys of any size."""
    diffs = first_differences(rows, keys, order, value)
    centre = quantiles(diffs, keys, "diff", [0.5])
    away = diffs.join(F.broadcast(centre), keys).withColumn("away", F.abs(F.col("diff") - F.col("q0")))  # a row per key, MAX_GROUPS at most
    return quantiles(away.drop("q0"), keys, "away", [0.5]).select(*keys, (1.4826 / math.sqrt(2) * F.col("q0")).alias("sd"))


def clamp_outliers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values beyond the 1st and 99th percentile by 1.5 times their distance are set to that bound; for few keys of any size."""
    q = quantiles(rows, keys, value, [0.01, 0.99]).withColumnsRenamed({"q0": "lo", "q1": "hi"})
    r = 1.5 * (F.col("hi") - F.col("lo"))
    return rows.join(F.broadcast(q), keys).withColumn(value, F.least(F.greatest(F.col(value), F.col("lo") - r), F.col("hi") + r)).drop("lo", "hi")


def sex_of_ratio(ratio: Column, female: float = 25, unknown: float = 20) -> Column:
    """From the X to Y coverage ratio; unknown without one."""
    return F.when(ratio.isNull() | F.isnan(ratio), "unknown").when(ratio > female, "female").when(ratio > unknown, "unknown").otherwise("male")


def sex_of_depth(autosomes: Column, x: Column) -> Column:
    """From the rounded ratio of autosomal to X depth: 1 female, 2 male; outside (0.5, 2.5) unknown."""
    r = autosomes / F.nullif(x, F.lit(0))
    return F.when((r > 0.5) & (r < 2.5), F.when(F.round(r) == 1, "female").otherwise("male")).otherwise("unknown")


def without_outliers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows of each group but, where it has five or more, those beyond its quartiles by 1.5 times their distance."""
    q = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.count("*").alias("m"))
    r = 1.5 * (F.col("q3") - F.col("q1"))
    return rows.join(q, keys).where((F.col("m") < 5) | F.col(value).between(F.col("q1") - r, F.col("q3") + r)).drop("q1", "q3", "m")


def xy_ratio(rows: DataFrame, keys: list[str], contig: str, value: str, x: str = "chrX", y: str = "chrY", few: int = 10) -> DataFrame:
    """keys, x_mean, y_mean, ratio: coverage of X over that of Y plus 0.0001, outliers of each removed.

    With fewer than ``few`` intervals left of Y both are medians, else means.
    No interval of Y counts as 0; a group without either has no row.
    """
    kept = without_outliers(rows.where(F.col(contig).isin(x, y)), [*keys, contig], value)
    of = lambda c, f: f(F.when(F.col(contig) == c, F.col(value)))
    half = lambda c: F.percentile(c, F.lit(0.5))
    out = kept.groupBy(*keys).agg(F.sum((F.col(contig) == y).cast("int")).alias("n_y"), of(x, half).alias("x_half"), of(y, half).alias("y_half"), of(x, F.avg).alias("x_avg"), of(y, F.avg).alias("y_avg"))
    pick = lambda c: F.when(F.col("n_y") < few, F.col(c + "_half")).otherwise(F.col(c + "_avg"))
    out = out.select(*keys, pick("x").alias("x_mean"), F.coalesce(pick("y"), F.lit(0.0)).alias("y_mean"))
    return out.withColumn("ratio", F.col("x_mean") / (F.col("y_mean") + 0.0001))


def best_copies(segments: DataFrame, keys: list[str], log_ratio: str, sd: str, purity: float, ploidy: float, most: int = 20) -> DataFrame:
    """Appends tcn: the copy number from 0 to ``most`` of the highest t density; smaller ones win ties."""
    options = F.array(*[F.struct(log_student_pdf(log_ratio, F.greatest(expected_log_ratio(float(k), F.lit(purity), F.lit(ploidy)), F.lit(FLOOR)), sd).alias("l"), F.lit(-k).alias("k")) for k in range(most + 1)])
    return segments.withColumn("tcn", -F.array_max(options)["k"])


def best_minor(segments: DataFrame, tcn: str, baf: str, sd: float, purity: float, most: int = 20) -> DataFrame:
    """Appends mcn: the minor copy number from 0 to half of tcn that explains the allele fraction best."""
    options = F.array(*[F.when(F.lit(2 * k) <= F.col(tcn), F.struct(log_student_pdf(baf, expected_baf(F.col(tcn), F.lit(float(k)), F.lit(purity)), F.lit(sd)).alias("l"), F.lit(-k).alias("k"))) for k in range(most // 2 + 1)])
    return segments.withColumn("mcn", -F.array_max(F.filter(options, lambda o: o.isNotNull()))["k"])


def purity_ploidy_grid(segments: DataFrame, log_ratio: str, sd: str, purities: list[float], ploidies: list[float], most: int = 7) -> DataFrame:
    """purity, ploidy, loglik: the sum over segments of the best copy number's log density.

    The grid is a small constant, so every segment is expanded by it and the
    sums are partial aggregates: one shuffle of a row per grid point and task.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("purity"), F.lit(q).alias("ploidy")) for p in purities for q in ploidies]))
    cells = segments.select(log_ratio, sd, grid.alias("g")).select(log_ratio, sd, "g.*")
    best = F.greatest(*[log_student_pdf(log_ratio, F.greatest(expected_log_ratio(float(k), "purity", "ploidy"), F.lit(FLOOR)), sd) for k in range(most + 1)])
    return cells.groupBy("purity", "ploidy").agg(F.sum(best).alias("loglik"))


def flags(segments: DataFrame, mapq_least: float, length_least: int, purity: float, ploidy: float, chr_y_female: Column | None = None) -> DataFrame:
    """Appends ``flags``: lowMmMapq (not at copy number 0), nonIntegerTcn (1 outside .7-1.3, 0 above .3), cnvLength and chrYFemale, or PASS."""
    real = copies_of_log_ratio("mean_log_ratio", F.lit(purity), F.lit(ploidy))
    names = F.concat_ws(";", F.when((F.col("mean_mapq") < mapq_least) & F.coalesce(F.col("tcn") != 0, F.lit(True)), "lowMmMapq"), F.when(((F.col("tcn") == 1) & ~real.between(0.7, 1.3)) | ((F.col("tcn") == 0) & (real > 0.3)), "nonIntegerTcn"), F.when(F.col("stop") - F.col("start") < length_least, "cnvLength"), F.when(chr_y_female if chr_y_female is not None else F.lit(False), "chrYFemale"))
    return segments.withColumn("flags", F.when(names == "", "PASS").otherwise(names))


# Kernels over one ordered array.


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic regression with tricube weights of the int(span * n) nearest points."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = int(span * len(x))
    if n < 1:
        raise ValueError("the span holds no point")
    out = np.empty(len(at))
    for i, a in enumerate(at):
        lo = int(np.clip(np.searchsorted(x, a) - n, 0, len(x) - n))
        hi = min(len(x), lo + 2 * n + 1)
        near = lo + np.argsort(np.abs(x[lo:hi] - a), kind="stable")[:n]
        d = np.abs(x[near] - a)
        if n == 1 or d.max() == 0:
            out[i] = y[near].mean()
            continue
        w = np.sqrt((1 - (d / d.max()) ** 3).clip(0) ** 3)
        b = np.column_stack([np.ones(n), x[near] - a, (x[near] - a) ** 2])
        out[i] = np.linalg.lstsq(b * w[:, None], y[near] * w, rcond=None)[0][0]
    return out


#: The first and the second span, the grid's step, the quantiles of coverage and GC between which an interval is ideal.
FIRST_SPAN, SECOND_SPAN, GC_STEP, IDEAL_COVERAGE, IDEAL_GC, IDEAL_SIZE = 0.03, 0.3, 0.001, 0.99, (0.001, 0.999), 0.1
#: Cells of distinct (GC, coverage) sums that the fit takes at most; GC is rounded to fewer places beyond.
FIT_CELLS = 200_000


def valid_intervals(coverage: str = "coverage", gc: str = "gc") -> Column:
    """Covered intervals of known GC."""
    return F.coalesce((F.col(coverage) > 0) & (F.col(gc) >= 0), F.lit(False))


def ideal_intervals(rows: DataFrame, autosome: Column, coverage: str = "coverage", gc: str = "gc", on_target: str = "on_target", mappability: str = "mappability") -> DataFrame:
    """Appends ``valid`` and ``ideal``, on- and off-target rows by themselves.

    Ideal: valid, autosomal, coverage up to the 99th percentile of the valid
    ones, GC within their 0.1st and 99.9th, on target wholly mappable, off
    target as long as the valid ones' tenth percentile at least.
    """
    size = F.col("stop") - F.col("start")
    marked = rows.withColumn("valid", valid_intervals(coverage, gc))
    lo, hi = IDEAL_GC
    good = marked.where("valid")
    q = quantiles(good, [on_target], coverage, [IDEAL_COVERAGE]).withColumnRenamed("q0", "q_cov")
    q = q.join(quantiles(good, [on_target], gc, [lo, hi]).withColumnsRenamed({"q0": "q_lo", "q1": "q_hi"}), on_target)
    q = q.join(quantiles(good.withColumn("size", size), [on_target], "size", [IDEAL_SIZE]).withColumnRenamed("q0", "q_size"), on_target)
    out = marked.join(F.broadcast(q), on_target, "left")  # a row for on and off target each
    shape = F.when(F.col(on_target), F.col(mappability) >= 1).otherwise(size >= F.col("q_size"))
    ideal = F.col("valid") & autosome & (F.col(coverage) <= F.col("q_cov")) & F.col(gc).between(F.col("q_lo"), F.col("q_hi")) & shape
    return out.withColumn("ideal", F.coalesce(ideal, F.lit(False))).drop("q_cov", "q_lo", "q_hi", "q_size")


def loess_weighted(x: np.ndarray, y: np.ndarray, times: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    """``loess`` over points that stand for ``times`` equal ones each."""
    order = np.argsort(x, kind="stable")
    x, y, times = x[order], y[order], times[order].astype(float)
    n = int(span * times.sum())
    if n < 1:
        raise ValueError("the span holds no point")
    out = np.empty(len(at))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        near = np.argsort(d, kind="stable")
        upto = np.cumsum(times[near])
        k = int(np.searchsorted(upto, n)) + 1
        near, share = near[:k], times[near[:k]].copy()
        share[-1] -= max(0.0, upto[min(k, len(upto)) - 1] - n)  # of the last point only as many as are needed
        far = d[near].max()
        if far == 0:
            out[i] = np.average(y[near], weights=share)
            continue
        w = np.sqrt((1 - (d[near] / far) ** 3).clip(0) ** 3 * share)
        b = np.column_stack([np.ones(k), x[near] - a, (x[near] - a) ** 2])
        out[i] = np.linalg.lstsq(b * w[:, None], y[near] * w, rcond=None)[0][0]
    return out


def gc_correct(rows: DataFrame, gc: str, coverage: str, counts: list[str], valid: Column, ideal: Column) -> DataFrame:
    """Divides ``counts`` by the trend of coverage by GC, relative to the ideal intervals' mean; invalid rows keep theirs.

    The trend is fitted twice: the ideal intervals' coverage on a grid of GC
    (FIRST_SPAN), then the grid's values at each interval's own GC
    (SECOND_SPAN). Ideal intervals of one GC are one cell of the first fit;
    the second is made once per distinct GC. A trend that isn't above zero
    makes the counts 0.
    """
    ok = rows.where(ideal)
    places = next(p for p in (6, 5, 4, 3) if p == 3 or ok.select(F.round(gc, p).alias("g"), coverage).distinct().limit(FIT_CELLS + 1).count() <= FIT_CELLS)
    cells = ok.groupBy(F.round(gc, places).alias("g"), coverage).agg(F.count("*").alias("n")).toPandas()  # FIT_CELLS, or 1001 GC values by coverage
    if not len(cells):
        return rows
    grid = np.arange(0, 1 + GC_STEP / 2, GC_STEP)
    first = loess_weighted(cells["g"].to_numpy(float), cells[coverage].to_numpy(float), cells["n"].to_numpy(), grid, FIRST_SPAN)
    mean = float(np.average(cells[coverage], weights=cells["n"]))

    @F.pandas_udf("double")
    def scale(g: pd.Series) -> pd.Series:
        own, back = np.unique(g.to_numpy(float), return_inverse=True)
        known = ~np.isnan(own)
        out = np.full(len(own), np.nan)
        if known.any():
            out[known] = loess(grid, first, own[known], SECOND_SPAN) / mean
        return pd.Series(out[back])

    gcs = rows.where(valid).select(F.col(gc).alias("of_gc")).distinct().withColumn("scale", scale(F.col("of_gc").cast("double")))
    out = rows.join(gcs, F.col(gc) == F.col("of_gc"), "left")
    new = {c: F.when(~valid, F.col(c)).when(F.col("scale") > 0, F.col(c) / F.col("scale")).otherwise(0.0) for c in counts}
    return out.withColumns(new).drop("of_gc", "scale")


#: Arcs of fewer observations are permuted even where the tail approximation holds; both sides need more than SHORTCUT to differ without a test.
SMALL_ARC, SHORTCUT = 25, 10


def arc_squares(rows: np.ndarray, least: int, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, the arc [i, j) of j < n whose mean differs most from the rest: sum of squares between the two, i, j.

    Arcs and their rests have ``least`` observations at least, arcs fewer than ``most`` (0: no limit).
    """
    m, n = rows.shape
    s = np.concatenate([np.zeros((m, 1)), np.cumsum(rows - rows.mean(1, keepdims=True), 1)], 1)
    best, first, end = np.zeros(m), np.zeros(m, int), np.zeros(m, int)
    for width in range(least, min(n - least, n - 1, most - 1 if most else n) + 1):
        d = np.abs(s[:, width:n] - s[:, : n - width])
        i = d.argmax(1)
        score = d[np.arange(m), i] ** 2 * n / (width * (n - width))
        better = score > best
        best[better], first[better], end[better] = score[better], i[better], i[better] + width
    return best, first, end


#: Permutations judged at a time; most tests of a signal without a change end with the first of them.
JUDGED = 128


def largest_square(rows: np.ndarray, least: int, most: int = 0, above: float = 0.0) -> np.ndarray:
    """The sums of squares of ``arc_squares`` alone; where none exceeds ``above`` it may be less.

    No arc of a width differs by more than the range of the sums, so that
    most rows are left out at most widths.
    """
    m, n = rows.shape
    s = np.zeros((n + 1, m))
    np.cumsum((rows - rows.mean(1, keepdims=True)).T, 0, out=s[1:])
    bound = (s.max(0) - s.min(0)) ** 2 * n
    order = np.argsort(-bound, kind="stable")
    s, bound, best = s[:, order], -bound[order], np.zeros(m)
    for width in range(least, min(n - least, n - 1, most - 1 if most else n) + 1):
        scale = width * (n - width)
        k = int(np.searchsorted(bound, -above * scale * (1 - 1e-9)))
        if k:
            d = np.abs(s[width:n, :k] - s[: n - width, :k]).max(0)
            np.maximum(best[:k], d**2 * n / scale, out=best[:k])
    out = np.empty(m)
    out[order] = best
    return out


def tail(t: float, m: int, k: int = SMALL_ARC, steps: int = 100) -> float:
    """Siegmund's approximation of the chance of such a maximum among m observations, for arcs of k and more; nu's series has two terms, as in the reference."""
    u = 0.5 + np.arange(steps) * (0.5 - k / m) / steps
    x = t / np.sqrt(m * u * (1 - u))
    cdf = lambda z: np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    nu = 2 / x**2 * np.exp(-2 * (cdf(-x / 2) + cdf(-x / math.sqrt(2)) / 2))
    y = nu * nu / (u * (1 - u)) ** 2
    return float(0.25 * t**3 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * ((y[1:] + y[:-1]) / 2 * np.diff(u)).sum())


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t: the incomplete beta function at df / (df + t t), by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if swap := x > (a + 1) / (a + b + 2):
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d or tiny), 1 + step / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * h if swap else front * h


def arc_differs(x: np.ndarray, between: float, width: int, p: float, least: int, permutations: int, sure: float, rng: np.random.Generator, follows: bool = True) -> bool:
    """The hybrid test of the best arc; ``between`` is its sum of squares, and F (which the reference names t) follows from it.

    A test that ends early still draws the permutations of its batch if another ``follows``, whose own are then those they always were.
    """
    n = len(x)
    total = float(((x - x.mean()) ** 2).sum())
    f = between / (((total if total >= between else between + 1) - between or 1e-300) / (n - 2))
    if width > SHORTCUT and n - width > SHORTCUT and f > sure:
        return True
    if f < 0.1:
        return False
    most = 0
    if n >= 4 * SMALL_ARC:
        p, most = p - tail(f, n), SMALL_ARC
        if p <= 0:
            return False
    allowed, more, done = int(p * permutations), 0, 0
    while done < permutations:
        some = min(permutations - done, max(1, 200_000 // n))
        for lo in range(0, some, JUDGED):
            shuffled = rng.permuted(np.broadcast_to(x, (min(JUDGED, some - lo), n)), axis=1)
            more += int((largest_square(shuffled, least, most, between) > between * (1 + 1e-12)).sum())
            if more > allowed:
                if follows and some - lo > JUDGED:
                    rng.permuted(np.broadcast_to(x, (some - lo - JUDGED, n)), axis=1)
                return False
        done += some
    return more / permutations < p


def pieces_differ(v: np.ndarray, w: np.ndarray, p: float, permutations: int, sure: float, rng: np.random.Generator) -> bool:
    """The binary test of two neighbours: Student's t, or where one is small the t of samples drawn from both."""
    low, high = sorted((len(v), len(w)))

    def t_of(n, mean, var, m, mean2, var2):
        return np.abs(mean - mean2) / (np.sqrt(((n - 1) * var + (m - 1) * var2) / (n + m - 2)) * math.sqrt(1 / n + 1 / m))

    var = lambda y: y.var(ddof=1) if len(y) > 1 else 0.0
    with np.errstate(all="ignore"):
        t = float(t_of(len(v), v.mean(), var(v), len(w), w.mean(), var(w)))
        if t > sure and low > SHORTCUT:
            return True
        if low > SMALL_ARC:
            return student_p(t, low + high - 2) < p
        both = np.r_[v, w]
        drawn = both[rng.integers(0, len(both), (permutations, low))]
        one, squares = drawn.sum(1), (drawn**2).sum(1)
        mean, mean2 = one / low, (both.sum() - one) / high
        found = t_of(low, mean, squares / low - mean**2, high, mean2, ((both**2).sum() - squares) / high - mean2**2)
    return int((found > t).sum()) / permutations < p


def binary_segments(x: np.ndarray, p: float = 0.01, least: int = 10, permutations: int = 10_000, seed: int = 1, sure: float = 7.0, arc: int = 2) -> list[tuple[int, int]]:
    """Circular binary segmentation: pieces [i, j) of one array.

    A piece of ``least`` observations is split at its best arc if the hybrid
    test says so; an end of fewer than ``arc`` joins its neighbour, and so
    do neighbours that the binary test can't tell apart.
    """
    rng = np.random.default_rng(seed)
    out, todo = [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        own = x[a:b]
        parts = [(0, b - a)]
        if b - a >= least:
            between, i, j = (v[0].item() for v in arc_squares(own[None], arc))
            if between > 1e-12 and j - i >= arc and arc_differs(own, between, j - i, p, arc, permutations, sure, rng, bool(todo)):
                parts = [(u, v) for u, v in ((0, i), (i, j), (j, b - a)) if v > u]
        if len(parts) > 1 and parts[0][1] < arc:
            parts[:2] = [(0, parts[1][1])]
        elif len(parts) > 1 and b - a - parts[-1][0] < arc:
            parts[-2:] = [(parts[-2][0], b - a)]
        kept = parts[:1]
        for u, v in parts[1:]:
            if pieces_differ(own[kept[-1][0] : kept[-1][1]], own[u:v], p, permutations, sure, rng):
                kept.append((u, v))
            else:
                kept[-1] = (kept[-1][0], v)
        if len(kept) == 1:
            out.append((a, b))
        else:
            todo += [(a + u, a + v) for u, v in kept]
    return sorted(out)


def undo(medians_of, pieces: list[tuple[int, int]], threshold: float) -> list[tuple[int, int]]:
    """Joins a piece to its nearer neighbour while their medians differ by ``threshold`` at most; rounds until nothing changes.

    ``medians_of`` gives the median of a piece. The first piece never starts a merge by itself.
    """
    while len(pieces) > 1:
        m = [medians_of(p) for p in pieces]
        join = [False] * len(m)
        for k in range(1, len(m)):
            before = abs(m[k] - m[k - 1])
            after = abs(m[k] - m[k + 1]) if k + 1 < len(m) else math.inf
            if before <= after and before <= threshold:
                join[k] = True
            elif after < before and after <= threshold:
                join[k + 1] = True
        out = [pieces[0]]
        for p, j in zip(pieces[1:], join[1:], strict=True):
            if j:
                out[-1] = (out[-1][0], p[1])
            else:
                out.append(p)
        if len(out) == len(pieces):
            break
        pieces = out
    return pieces


#: Distinct points up to which the distances of all pairs are held; more are linked along chains of nearest neighbours.
PAIRWISE = 512


def _outline(points: np.ndarray) -> np.ndarray:
    """The points of a cluster that can be farthest from any other: in the plane its convex hull, else all of them."""
    if points.shape[1] != 2 or len(points) < 3:
        return points
    p = points[np.lexsort((points[:, 1], points[:, 0]))].tolist()

    def half(q: list) -> list:
        out: list = []
        for x, y in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def _chained(points: np.ndarray, height: float) -> np.ndarray:
    """``complete_linkage`` along chains of nearest neighbours, which end in pairs that are each other's nearest; memory for the points only."""
    names, size = np.arange(len(points)), np.ones(len(points), int)
    held, who = points.astype(float), np.arange(len(points))  # outlines of the open clusters, one behind the other
    outline = {k: points[k : k + 1].astype(float) for k in range(len(points))}
    members = {k: [k] for k in range(len(points))}
    chain: list[int] = []
    while len(who):
        if not chain:
            chain.append(int(who[0]))
        top = chain[-1]
        far = np.zeros(len(held))
        for o in outline[top]:
            np.maximum(far, ((held - o) ** 2).sum(1), out=far)
        far = np.maximum.reduceat(far, np.r_[0, np.cumsum(size)[:-1]])
        far[who == top] = np.inf
        least = float(far.min())
        at = int(who[far.argmin()])
        if len(chain) > 1 and far[np.flatnonzero(who == chain[-2])[0]] <= least:
            at = chain[-2]
        if not math.sqrt(least) <= height:
            gone, chain, fresh = chain, [], None  # what led here is even farther from anything
        elif len(chain) > 1 and at == chain[-2]:
            gone, chain = chain[-2:], chain[:-2]
            fresh = min(gone)
            outline[fresh], members[fresh] = _outline(np.concatenate([outline[k] for k in gone])), members[gone[0]] + members[gone[1]]
            names[members[fresh]] = fresh
        else:
            chain.append(at)
            continue
        stay = ~np.isin(who, gone)
        held, who, size = held[np.repeat(stay, size)], who[stay], size[stay]
        if fresh is not None:
            held, who, size = np.concatenate([held, outline[fresh]]), np.r_[who, fresh], np.r_[size, len(outline[fresh])]
    return names


def complete_linkage(points: np.ndarray, height: float) -> np.ndarray:
    """Cluster numbers (the first member's place) by complete linkage, cut at ``height``; for the segments of one genome. Equal points are one."""
    _, first, back = np.unique(points, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)  # in order of their first places
    rank = np.empty(len(first), int)
    rank[order] = np.arange(len(first))
    distinct = points[first[order]]
    names = _pairwise(distinct, height) if len(distinct) <= PAIRWISE else _chained(distinct, height)
    return first[order][names][rank[back.reshape(-1)]] if len(points) else np.arange(0)


def _pairwise(points: np.ndarray, height: float) -> np.ndarray:
    names = np.arange(len(points))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    while len(points) > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if not d[i, j] <= height:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        names[names == j] = i
    return names


def local_maxima(x: np.ndarray) -> list[int]:
    """Peaks: where a rise (or the start) is followed by a fall, perhaps over a plateau.

    Of a plateau counts the element in its middle, the later one of two. The
    last element takes no part.
    """
    out, rising, top = [], True, 0
    for k in range(1, max(2, len(x) - 1)):
        step = x[k] - x[k - 1] if k < len(x) else 0.0
        if step < -1e-12:
            if rising:
                out.append(top + (k - top) // 2)
            rising, top = False, k
        elif step > 1e-12:
            rising, top = True, k
    return out


#: Fractions that the density is taken of at a time.
KDE_CHUNK = 1 << 14


def mirrored_peak(ref: np.ndarray, alt: np.ndarray, points: int = 512, times: np.ndarray | None = None) -> float:
    """The peak of the depth-weighted density of allele fractions and their mirror images, mirrored below one half; a site stands for ``times`` equal ones."""
    n = ref + alt
    t = (np.ones(len(n)) if times is None else times.astype(float))[n > 0]
    f, w = (alt / np.maximum(n, 1))[n > 0], n[n > 0] * t
    if not len(f):
        return math.nan
    both, weight, t = np.r_[f, 1 - f], np.r_[w, w], np.r_[t, t]
    total = t.sum()
    mean = (both * t).sum() / total
    width = max(1.06 * math.sqrt(((both - mean) ** 2 * t).sum() / total) * total**-0.2, 1e-3)
    grid = np.linspace(0, 1, points)
    density = np.zeros(points)
    for lo in range(0, len(both), KDE_CHUNK):
        density += (np.exp(-0.5 * ((grid[:, None] - both[lo : lo + KDE_CHUNK]) / width) ** 2) * weight[lo : lo + KDE_CHUNK]).sum(1)
    peaks = local_maxima(density) or [int(density.argmax())]
    at = grid[max(peaks, key=lambda k: (density[k], -k))]
    return float(min(at, 1 - at))


def merge_low_quality(segments: list[dict], least: float) -> list[dict]:
    """A segment of mean mapping quality below ``least`` and tcn other than 0 joins both neighbours, if these agree.

    The neighbours (the one before as merged so far) must be of its contig
    and its PAR status, have a mapping quality, and be of one tcn. What is
    merged spans all three, counts their observations together and has the
    means weighted by these; it keeps the first one's tcn.
    """
    out: list[dict] = []
    k = 0
    while k < len(segments):
        s = segments[k]
        after = segments[k + 1] if k + 1 < len(segments) else None
        fits = lambda o: o is not None and o["contig"] == s["contig"] and o.get("in_par") == s.get("in_par") and o["mean_mapq"] is not None
        low = s["mean_mapq"] is not None and least > 0 and s["mean_mapq"] < least and s["tcn"] != 0
        if low and out and fits(out[-1]) and fits(after) and out[-1]["tcn"] == after["tcn"]:
            three = [out[-1], s, after]
            n = sum(x["n"] for x in three)
            means = {c: sum(x[c] * x["n"] for x in three) / n for c in ("mean_mapq", "mean_log_ratio") if c in s}
            out[-1] = out[-1] | {"stop": after["stop"], "n": n} | means
            k += 2
            continue
        out.append(dict(s))
        k += 1
    return out


def segment(signal: DataFrame, keys: list[str], order: str, value: str, undo_factor: float = 1.0, least: int = 10) -> DataFrame:
    """keys, first, last, n, mean, median of the segments of each ordered signal, undone by ``undo_factor`` robust deviations."""
    types = {f.name: f.dataType.simpleString() for f in signal.schema}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([order, value])
        x = frame[value].to_numpy(float)
        d = np.diff(x)
        sd = 1.4826 / math.sqrt(2) * np.median(np.abs(d - np.median(d))) if len(d) else 0.0
        pieces = undo(lambda p: float(np.median(x[p[0] : p[1]])), binary_segments(x, least=least), sd * undo_factor)
        pos = frame[order].to_numpy()
        head = {k: [frame[k].iloc[0]] * len(pieces) for k in keys}
        return pd.DataFrame(head | {"first": [pos[a] for a, _ in pieces], "last": [pos[b - 1] for _, b in pieces], "n": [b - a for a, b in pieces], "mean": [x[a:b].mean() for a, b in pieces], "median": [np.median(x[a:b]) for a, b in pieces]})

    head = ", ".join(f"{k} {types[k]}" for k in keys)
    # Little data and much work: a stated number of partitions is not coalesced to a few.
    spread = int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return signal.select(*keys, order, value).repartition(spread, *keys).groupBy(*keys).applyInPandas(run, f"{head}, first {types[order]}, last {types[order]}, n long, mean double, median double")


def prune(segments: DataFrame, keys: list[str], order: str, features: list[str], height: float = 0.25) -> DataFrame:
    """Appends ``pruned``: consecutive segments of one complete-linkage cluster share a number; per key, so bounded by its segments."""
    kind = segments.schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        c = complete_linkage(frame[features].to_numpy(float), height)
        return frame.assign(pruned=np.cumsum(np.r_[0, np.diff(c) != 0]))

    return segments.groupBy(*keys).applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind) + ", pruned long")


def denoise(panel: np.ndarray, sample: np.ndarray, components: int = 20) -> np.ndarray:
    """The sample's log ratios less their projection on the panel's top left singular vectors (intervals by samples)."""
    centred = panel - panel.mean(1, keepdims=True)
    u = np.linalg.svd(centred, full_matrices=False)[0][:, : min(components, centred.shape[1])]
    return sample - u @ (u.T @ sample)


#: Samples of a panel at most: their products with each other are a square matrix on the driver.
MAX_SAMPLES = 1000


def denoise_panel(panel: DataFrame, keys: list[str], sample: str, value: str, components: int = 20) -> DataFrame:
    """sample, keys, value of every sample less its projection on the others' top singular vectors.

    Intervals never reach the driver: with samples few, the products of all
    pairs of samples (a square of MAX_SAMPLES at most) are one aggregation,
    and what is to be taken off a sample is a combination of the others,
    whose weights follow from that square. The combination is one join by
    sample and one sum by interval.
    """
    spark = panel.sparkSession
    names = sorted(r[0] for r in panel.select(sample).distinct().limit(MAX_SAMPLES + 1).collect())
    if len(names) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    number = F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(names)], f"{sample} {panel.schema[sample].dataType.simpleString()}, k int"))
    rows = panel.join(number, sample).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", F.col(value).cast("double").alias("v")))).alias("row")).where(F.size("row") == len(names)).select(*keys, F.col("row.v").alias("row"))
    m = len(names)

    def products(batches):
        import pyarrow as pa

        total = np.zeros((m, m))
        for b in batches:
            x = b.column("row").flatten().to_numpy().reshape(-1, m)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["g"])

    parts = rows.select("row").mapInArrow(products, "g array<double>")
    # Sums of squares come in steps, so that no task gathers all of them.
    flat = parts.select(F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g")).orderBy("at").toArrow()
    gram = flat["g"].to_numpy().reshape(m, m) if flat.num_rows else np.zeros((m, m))
    weights = np.zeros((m, m))  # column k: how much of each sample is left in sample k
    for k in range(m):
        other = np.delete(np.arange(m), k)
        centre = np.eye(m - 1) - 1 / (m - 1)  # the others, each interval centred on their mean
        inner = centre @ gram[np.ix_(other, other)] @ centre
        root, vectors = np.linalg.eigh(inner)
        top = np.argsort(-root)[: min(components, m - 1)]
        top = top[root[top] > max(root.max(initial=0.0), 0) * 1e-12]
        basis = centre @ vectors[:, top] / np.sqrt(root[top])  # the singular vectors as combinations of the others
        weights[other, k] = -basis @ (basis.T @ gram[other, k])
        weights[k, k] = 1.0
    table = F.array(*[F.array(*[F.lit(float(w)) for w in weights[:, k]]) for k in range(m)]) if m <= 16 else None
    if table is not None:
        each = rows.select(*keys, "row", F.posexplode(table).alias("k", "w"))
    else:
        wide = F.broadcast(spark.createDataFrame([(k, weights[:, k].tolist()) for k in range(m)], "k int, w array<double>"))
        each = rows.crossJoin(wide)  # MAX_SAMPLES rows at most, as the output has
    value_of = F.aggregate(F.zip_with("row", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return each.select(*keys, "k", value_of.alias(value)).join(number, "k").select(sample, *keys, value)


# Segments, grids and whole pipelines.


def aligned_coverage(tumor: DataFrame, normal: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, tumor, normal of the normal's rows in its intervals; a normal interval that the tumor lacks is an error when read."""
    out = normal.select(*keys, F.col(value).alias("normal")).join(tumor.select(*keys, F.col(value).alias("tumor")), keys, "left")
    return out.withColumn("tumor", F.when(F.col("tumor").isNull(), F.raise_error("an interval of the normal is missing in the tumor").cast("double")).otherwise(F.col("tumor")))


def midpoints(segments: DataFrame, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Neighbouring segments meet halfway: prev_stop + (start - prev_stop) / 2, a whole number."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    half = lambda a, b: F.expr(f"{a} + ({b} - {a}) div 2")
    out = segments.withColumns({"before": F.lag("stop").over(w), "after": F.lead("start").over(w)})
    return out.withColumns({"new_start": F.coalesce(half("before", "start"), "start"), "new_stop": F.coalesce(half("stop", "after"), "stop")}).withColumns({"start": F.col("new_start"), "stop": F.col("new_stop")}).drop("before", "after", "new_start", "new_stop")


def break_by(outer: list[dict], inner: list[dict], starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Splits each outer segment where its inner segments meet, at an edge of the observations (starts, ends) that lie in it.

    The break between two inner segments goes before the first observation
    (but the outer segment's first) that ends at or behind the point halfway
    between them; an inner segment that would hold no observation joins the
    next one. Outer segments without an inner one are left out.
    """
    out = []
    for seg in outer:
        own = [x for x in inner if x["contig"] == seg["contig"] and x["start"] < seg["stop"] and x["stop"] > seg["start"]]
        if not own:
            continue
        at = np.flatnonzero((starts < seg["stop"]) & (ends > seg["start"]))
        begin, done = seg["start"], at[0] if len(at) else 0
        for a, b in zip(own, own[1:]):
            middle = (a["stop"] + b["start"]) // 2
            cut = next((k for k in at[1:] if ends[k] >= middle), None)
            if cut is None or cut <= done:
                continue
            out.append({"contig": seg["contig"], "start": int(begin), "stop": int(ends[cut - 1])})
            begin, done = starts[cut], cut
        out.append({"contig": seg["contig"], "start": int(begin), "stop": int(seg["stop"])})
    return out


#: The grid's first purity, step and number of steps, and the same of ploidy.
PURITY_GRID, PLOIDY_GRID = (0.15, 0.01, 80), (1.4, 0.1, 46)


def grid_axis(axis: tuple[float, float, int]) -> list[float]:
    first, step, n = axis
    return [round(first + step * k, 6) for k in range(n)]


def grid_best(grid: DataFrame, value: str = "loglik") -> DataFrame:
    """The grid's best row; of equal ones that of the least ploidy, then the least purity."""
    return grid.orderBy(F.desc(value), "ploidy", "purity").limit(1)


def joint_grid(segments: DataFrame, log_ratio: str, sd: float, baf: str, baf_sd: float, purities: list[float], ploidies: list[float], most: int = 7, diploid_prior: bool = True) -> DataFrame:
    """purity, ploidy, logr, baf, joint: per grid point the segments' best total copies by log ratio (two copies count double in the prior), then the best minor copies of these by allele fraction, of doubled deviation; sums of log densities.

    A segment without a fraction adds its log ratio's likelihood alone. Each
    segment is expanded by the grid of constants; sums combine on the map side.
    """
    n = most + 1
    prior = lambda k: math.log((2.0 if k == 2 else 1.0) / (n + 1)) if diploid_prior else 0.0
    axes = F.explode(F.array(*map(F.lit, purities))).alias("purity"), F.explode(F.array(*map(F.lit, ploidies))).alias("ploidy")
    cells = segments.select(log_ratio, baf, axes[0]).select("*", axes[1])
    expected = lambda k: F.greatest(expected_log_ratio(float(k), "purity", "ploidy"), F.lit(FLOOR))
    by_ratio = F.array(*[F.struct((log_student_pdf(log_ratio, expected(k), F.lit(sd)) + prior(k)).alias("l"), F.lit(-k).alias("k")) for k in range(n)])
    cells = cells.withColumn("b", F.array_max(by_ratio)).withColumns({"logr": F.col("b.l"), "tcn": -F.col("b.k")})
    by_baf = [F.when(F.lit(2 * m) <= F.col("tcn"), log_student_pdf(baf, expected_baf(F.col("tcn"), F.lit(float(m)), "purity"), F.lit(2 * baf_sd))) for m in range(most // 2 + 1)]
    cells = cells.withColumn("lb", F.when(F.col(baf).isNotNull(), F.greatest(*by_baf)))
    return cells.groupBy("purity", "ploidy").agg(F.sum("logr").alias("logr"), F.coalesce(F.sum("lb"), F.lit(0.0)).alias("baf"), F.sum(F.col("logr") + F.coalesce("lb", F.lit(0.0))).alias("joint"))


def weighted_baf_sd(sites: DataFrame, keys: list[str], ref: str, alt: str, mean: str) -> DataFrame:
    """keys, sd of the mirrored fraction about a mean: weighted by the root of the depth, the weights' sum less one below."""
    n = F.col(ref) + F.col(alt)
    w = F.sqrt(n)
    away = F.pow(F.least(ref, alt) / n - F.col(mean), 2)
    return sites.where(n > 0).groupBy(*keys).agg(F.sqrt(F.sum(w * away) / (F.sum(w) - 1)).alias("sd"))


def mean_segment_sd(observations: DataFrame, segment: list[str], value: str, autosome: Column) -> DataFrame:
    """One row ``sd``: the mean over autosomal segments of their observations' sample deviation; a segment without one is an error."""
    each = observations.where(autosome).groupBy(*segment).agg(F.stddev_samp(value).alias("sd"))
    return each.agg(F.avg(F.when(F.col("sd").isNull() | F.isnan("sd"), F.raise_error("a segment has no deviation").cast("double")).otherwise(F.col("sd"))).alias("sd"))


def seeds(segments: DataFrame, sex: str, mode: str) -> DataFrame:
    """The seed segments (contig, allosome, par) of a sex and mode.

    Unknown sex: no allosome. Female: no Y. Male: germline without Y's PAR,
    somatic without Y and without X but its PAR.
    """
    y = F.col("contig").isin("chrY", "Y")
    gone = {"unknown": F.col("allosome"), "female": F.col("allosome") & y}.get(sex)
    if gone is None:
        gone = F.col("allosome") & (y & F.col("par") if mode == "germline" else y | ~F.col("par"))
    return segments.where(~gone)


def index_sex(counts: DataFrame, x: str = "chrX", y: str = "chrY") -> DataFrame:
    """One row: reads of X over reads of Y from an index's counts (contig, reads), and the sex; no read of either is unknown, none of Y female."""
    of = lambda c: F.coalesce(F.sum(F.when(F.lower("contig").isin(c.lower(), c.lower().removeprefix("chr")), F.col("reads"))), F.lit(0))
    out = counts.agg(of(x).alias("x"), of(y).alias("y"))
    ratio = F.when(F.col("y") > 0, F.col("x") / F.col("y")).when(F.col("x") > 0, F.lit(float("inf")))
    return out.select("x", "y", sex_of_ratio(ratio).alias("sex"))


def call_metrics(segments: DataFrame, somatic: bool) -> DataFrame:
    """metric, value: segments by status, all and passing ones (status, filter)."""
    kinds = ["gain", "loss", "cnLOH", "gainLOH"] if somatic else ["gain", "loss"]
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    good = F.col("filter") == "PASS"
    cells = {"segments": F.count("*")} | {k: n(F.col("status") == k) for k in kinds} | {f"passing {k}": n((F.col("status") == k) & good) for k in kinds}
    row = segments.agg(*[c.alias(name) for name, c in cells.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("value")) for name in cells])).alias("x")).select("x.*")


#: The purity from which doubling is looked for, the fewest deletions, their copies and largest mirrored fraction, the peaks' distance, the bandwidth's factor.
DOUBLING = {"purity": 0.3, "segments": 5, "copies": (0.9, 1.1), "mbaf": 0.45, "apart": 0.1, "bandwidth": 1.1}


def doubled(mbafs: np.ndarray, purity: float, points: int = 512) -> bool:
    """Whether candidate one-copy segments' mirrored fractions have two peaks far enough apart, as in a doubled genome."""
    if purity < DOUBLING["purity"] or len(mbafs) < DOUBLING["segments"]:
        return False
    width = max(DOUBLING["bandwidth"] * mbafs.std(ddof=1) * len(mbafs) ** -0.2, 1e-3)
    grid = np.linspace(0, 1, points)
    density = np.exp(-0.5 * ((grid[:, None] - mbafs) / width) ** 2).sum(1)
    peaks = sorted(local_maxima(density), key=lambda k: -density[k])[:2]
    return len(peaks) == 2 and abs(grid[peaks[0]] - grid[peaks[1]]) > DOUBLING["apart"]


def deletion_candidates(segments: DataFrame, autosome: Column, purity: float, ploidy: float, least: int = 11) -> DataFrame:
    """Segments (mean_log_ratio, n, snps, mbaf, dense) that look like one clonal copy."""
    low, high = DOUBLING["copies"]
    copies = copies_of_log_ratio("mean_log_ratio", F.lit(purity), F.lit(ploidy))
    return segments.where(autosome & (F.col("n") >= least) & (F.col("snps") >= least) & F.col("dense") & copies.between(low, high) & (F.col("mbaf") < DOUBLING["mbaf"]))


def two_rounds(ratios: DataFrame, shifts: DataFrame, keys: list[str], order: str, value: str, undo_factor: float = 1.0) -> DataFrame:
    """keys, first, last, n, mean, median of segments by log ratio, each segmented once more by the heterozygosity shifts inside it.

    Both rounds work on one key's ordered signal at a time; a segment without
    a break of its shifts stays as it is.
    """
    from plexframe.session import Scratch

    scratch = Scratch(ratios.sparkSession)  # each round is read several times, and costs more than all else
    one = scratch.write(segment(ratios, keys, order, value, undo_factor).withColumn("outer", F.col("first")), "one")
    at = [F.col(k) for k in keys]
    inside = shifts.alias("s").join(one.select(*at, "first", "last", "outer").alias("o"), keys).where((F.col("s." + order) >= F.col("o.first")) & (F.col("s." + order) <= F.col("o.last"))).select(*keys, "outer", F.col("s." + order).alias(order), F.col("s." + value).alias(value))
    two = scratch.write(segment(inside, [*keys, "outer"], order, value, undo_factor), "two")
    parts = two.groupBy(*keys, "outer").agg(F.count("*").alias("parts"))
    whole = one.join(parts, [*keys, "outer"], "left").where("parts IS NULL OR parts = 1").select(*keys, "outer", "first", "last")
    split = two.join(parts, [*keys, "outer"]).where("parts > 1").select(*keys, "outer", "first", "last")
    cut = whole.unionByName(split)
    stats = cut.alias("c").join(ratios.alias("r"), keys).where((F.col("r." + order) >= F.col("c.first")) & (F.col("r." + order) <= F.col("c.last"))).groupBy(*keys, "first", "last").agg(F.count("*").alias("n"), F.avg("r." + value).alias("mean"))
    return cut.select(*keys, "first", "last").join(stats, [*keys, "first", "last"], "left")


def genome_intervals(lengths: DataFrame, blocked: DataFrame, track: DataFrame, gc_of: DataFrame, size: int, autosome: Column, least_autosome: float, least_allosome: float) -> DataFrame:
    """contig, start, stop, mappability, gc: windows of ``size`` over contigs less the blocked and the unmappable stretches.

    Contigs, less blocked regions, less where the track (contig, start, stop,
    score) is 0 or absent, are cut into windows; those mappable enough and
    whole stay, of moderate GC (``gc_of`` has contig, start, stop, gc).
    """
    from plexframe.operators import filters as L, intervals as I
    from plexframe.session import Scratch

    scratch = Scratch(lengths.sparkSession)  # each step reads the one before several times
    whole = lengths.where(I.canonical(F.col("contig").cast("string"))).select("contig", F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("stop")).withColumn("key", F.col("contig").cast("string"))
    left = scratch.write(I.subtract(whole, blocked.select("contig", "start", "stop"), "key"), "unblocked")
    unmapped = scratch.write(I.complement(track.where("score > 0").select("contig", "start", "stop"), lengths), "unmapped")
    left = I.subtract(left.withColumn("key", F.concat_ws(":", "contig", "start")), unmapped, "key").drop("key")
    windows = scratch.write(I.split_windows(left, size).where(F.col("stop") - F.col("start") >= size), "windows")
    good = L.mappable(windows, track.select("contig", "start", "stop", "score"), autosome, least_autosome, least_allosome)
    at = ["contig", "start", "stop"]
    shared = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    gc = I.range_join(good.select(*at), gc_of.select(*at, "gc")).groupBy(*at).agg((F.sum(shared * F.col("r_gc")) / F.sum(shared)).alias("gc"))
    return good.hint("merge").join(gc, at).where(L.moderate_gc(F.col("gc"))).select(*at, "mappability", "gc")


def somatic_arcs(rows: np.ndarray, least: int, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the arc [i, j) whose t against the rest is largest: |t|, i, j.

    t pools the biased variances of arc and rest. Arcs have ``least``
    observations at least, and so have their rests; arcs fewer than ``most``
    (0: no limit). Of equal ones the first start counts, then the shortest.
    """
    m, n = rows.shape
    s = np.concatenate([np.zeros((m, 1)), np.cumsum(rows, 1)], 1)
    q = np.concatenate([np.zeros((m, 1)), np.cumsum(rows * rows, 1)], 1)
    best, first, end = np.zeros(m), np.zeros(m, int), np.zeros(m, int)
    for width in range(least, min(n - least, most - 1 if most else n) + 1):
        a, aq = s[:, width:] - s[:, : n + 1 - width], q[:, width:] - q[:, : n + 1 - width]
        rest = n - width
        b, bq = s[:, -1:] - a, q[:, -1:] - aq
        va, vb = aq / width - (a / width) ** 2, bq / rest - (b / rest) ** 2
        with np.errstate(all="ignore"):
            t = np.abs(a / width - b / rest) / (np.sqrt(((width - 1) * va + (rest - 1) * vb) / (n - 2)) * math.sqrt(1 / width + 1 / rest))
        t = np.where(np.isfinite(t), t, 0.0)
        i = t.argmax(1)
        score = t[np.arange(m), i]
        better = score > best + 1e-12
        best[better], first[better], end[better] = score[better], i[better], i[better] + width
    return best, first, end


def _exceeds(x: np.ndarray, t: float, p: float, least: int, most: int, permutations: int, rng: np.random.Generator, follows: bool = True) -> bool:
    """Whether fewer than a share ``p`` of the permutations have a larger arc; it ends early once too many have."""
    allowed, more, done = int(p * permutations), 0, 0
    while done < permutations:
        some = min(permutations - done, max(1, 100_000 // len(x)))
        for lo in range(0, some, JUDGED):
            shuffled = rng.permuted(np.broadcast_to(x, (min(JUDGED, some - lo), len(x))), axis=1)
            more += int((somatic_arcs(shuffled, least, most)[0] > t).sum())
            if more > allowed:
                if follows and some - lo > JUDGED:
                    rng.permuted(np.broadcast_to(x, (some - lo - JUDGED, len(x))), axis=1)
                return False
        done += some
    return more / permutations < p


def _apart(v: np.ndarray, w: np.ndarray, p: float, permutations: int, rng: np.random.Generator) -> bool:
    """Whether two neighbours differ: fewer than a share ``p`` of their shuffles have a larger t."""
    both, n, m = np.r_[v, w], len(v), len(w)
    t_of = lambda a, b: np.abs(a.mean(-1) - b.mean(-1)) / np.maximum(np.sqrt(((n - 1) * a.var(-1, ddof=1 if n > 1 else 0) + (m - 1) * b.var(-1, ddof=1 if m > 1 else 0)) / max(n + m - 2, 1)) * math.sqrt(1 / n + 1 / m), 1e-300)
    t = float(t_of(v, w))
    more, done = 0, 0
    while done < permutations:
        some = min(permutations - done, max(1, 200_000 // len(both)))
        shuffled = rng.permuted(np.broadcast_to(both, (some, len(both))), axis=1)
        more += int((t_of(shuffled[:, :n], shuffled[:, n:]) > t).sum())
        done += some
        if more >= permutations * p + 1:
            return False
    return more / permutations < p


def somatic_segments(x: np.ndarray, p: float = 0.01, least: int = 2, permutations: int = 10_000, seed: int = 1, small: int = 10) -> list[tuple[int, int]]:
    """Pieces [i, j) of one array by the somatic variant of circular binary segmentation.

    A piece of ``small`` observations or more is split at its best arc of
    ``small`` or more if permutations of it say so; for long pieces the tail
    approximation comes first, and then permutations of the small arcs have
    what is left of ``p``. Ends of fewer than ``least`` join their neighbours,
    and so do neighbours that shuffling can't tell apart.
    """
    rng = np.random.default_rng(seed)
    out, todo = [], [(0, len(x))] if len(x) else []
    while todo:
        a, b = todo.pop()
        own, parts = x[a:b], [(0, b - a)]
        if b - a >= small:
            t, i, j = (v[0].item() for v in somatic_arcs(own[None], least))
            if t > 1e-9 and j - i >= small:
                chance = tail(t, b - a) if b - a >= 4 * SMALL_ARC else 0.0
                limit = SMALL_ARC if b - a >= 4 * SMALL_ARC else 0
                if chance < p and _exceeds(own, t, p - chance, least, limit, permutations, rng, bool(todo)):
                    parts = [(u, v) for u, v in ((0, i), (i, j), (j, b - a)) if v > u]
        if len(parts) > 1 and parts[0][1] - parts[0][0] < least:
            parts[:2] = [(0, parts[1][1])]
        if len(parts) > 1 and parts[-1][1] - parts[-1][0] < least:
            parts[-2:] = [(parts[-2][0], parts[-1][1])]
        kept = parts[:1]
        for u, v in parts[1:]:
            if _apart(own[kept[-1][0] : kept[-1][1]], own[u:v], p, permutations, rng):
                kept.append((u, v))
            else:
                kept[-1] = (kept[-1][0], v)
        if len(kept) == 1:
            out.append((a, b))
        else:
            todo += [(a + u, a + v) for u, v in kept]
    return sorted(out)


def denoised_sample(sample: DataFrame, panel: DataFrame, keys: list[str], count: str, on_target: Column, least_length: int, least_panel: float, least_both: float, least_off: float = 0.05, components: int = 20, name: str = "sample") -> DataFrame:
    """keys, on_target, log_ratio, denoised of one sample against a panel (name, keys, count): on- and off-target intervals by themselves.

    Log ratios are those against the panel's medians; denoised ones are less
    the projection on the panel's top components. Intervals too short or too
    thinly covered go (keys have start and stop); off-target ones count only
    if they are at least ``least_off`` of what is left.
    """
    from plexframe.operators import filters as L

    out = []
    for on in (True, False):
        own, ref = sample.where(on_target == F.lit(on)), panel.where(on_target == F.lit(on))
        medians = panel_medians(ref, keys, name, count)
        ratios = panel_log_ratio(own, medians, keys, count)
        totals = ref.groupBy(name).agg(F.sum(count).alias("total"))
        logs = ref.join(totals, name).join(medians, keys).select(name, *keys, F.log2(F.greatest(F.col(count) / F.col("total"), F.lit(1e-9)) / F.greatest("panel", F.lit(1e-9))).alias("v"))
        mine = F.lit("the sample")
        everyone = logs.withColumn(name, F.col(name).cast("string")).unionByName(ratios.select(mine.alias(name), *keys, F.col("log_ratio").alias("v")))
        smooth = denoise_panel(everyone, keys, name, "v", components).where(F.col(name) == mine).select(*keys, F.col("v").alias("denoised"))
        half = ref.groupBy(*keys).agg(F.percentile(count, F.lit(0.5)).alias("panel_count"))
        kept = ratios.drop("panel").join(half.withColumnRenamed("panel_count", "panel"), keys).withColumn("coverage", F.col(count))
        kept = L.panel_and_sample(kept, least_length, least_panel, least_both)
        out.append(kept.join(smooth, keys).select(*keys, F.lit(on).alias("on_target"), "log_ratio", "denoised"))
    n = out[0].agg(F.count("*").alias("n_on")).crossJoin(out[1].agg(F.count("*").alias("n_off")))  # one row each
    enough = out[1].crossJoin(F.broadcast(n)).where(F.col("n_off") >= least_off * (F.col("n_on") + F.col("n_off"))).drop("n_on", "n_off")
    return out[0].unionByName(enough)
