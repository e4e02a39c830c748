"""Variant keys, features, filters, reconciliation and panels of normals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def split_alleles(records: DataFrame, alts: str = "alts", per_allele: tuple[str, ...] = ()) -> DataFrame:
    """One row per alternative: alt, allele (from 1), and the element of every per-allele array; other columns repeat."""
    zipped = F.arrays_zip(F.col(alts).alias("alt"), *[F.col(c) for c in per_allele])
    rest = [c for c in records.columns if c not in (alts, *per_allele)]
    out = records.select(*rest, F.posexplode(zipped).alias("i", "x"))
    return out.select(*rest, (F.col("i") + 1).cast("long").alias("allele"), F.col("x.alt").alias("alt"), *[F.col(f"x.{c}").alias(c) for c in per_allele])


def merge_biallelic(records: DataFrame, keys: list[str], ref: str = "ref", alt: str = "alt") -> DataFrame:
    """Positions with exactly two records as one: harmonised alleles in order of the records, genotype 1/2, AC 1,1, AF .5,.5, AN 2.

    Records whose alleles can't be written over one reference don't merge.
    """
    from plexframe.functions.sequences import common_ref

    two = records.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(ref, alt)).alias("a"), F.max(F.struct(ref, alt)).alias("b")).where("n = 2")
    both = two.withColumn("c", common_ref(F.col("a")[ref], F.col("a")[alt], F.col("b")[ref], F.col("b")[alt])).where("c IS NOT NULL")
    return both.select(*keys, F.col("c.ref").alias("ref"), F.concat_ws(",", "c.alt_a", "c.alt_b").alias("alts"), F.lit("1/2").alias("gt"), F.lit("1,1").alias("ac"), F.lit("0.5,0.5").alias("af"), F.lit(2).alias("an"))


def density(variants: DataFrame, reach: int = 100, keys: tuple[str, ...] = ("contig",), pos: str = "pos") -> DataFrame:
    """Appends ``density``: variants within ``reach`` of each, itself included."""
    w = Window.partitionBy(*keys).orderBy(pos).rangeBetween(-reach, reach)
    return variants.withColumn("density", F.count("*").over(w))


def highest_quality(rows: DataFrame, keys: list[str], quality: str, value: str) -> DataFrame:
    """The value of the highest quality per key; equal qualities give the larger value."""
    return rows.groupBy(*keys).agg(F.max(F.struct(quality, value)).alias("b")).select(*keys, F.col(f"b.{quality}").alias(quality), F.col(f"b.{value}").alias(value))


def first_failure(rules: list[tuple[str, Column]], good: str = "PASS") -> Column:
    """The name of the first rule that is true, in order."""
    out = F.lit(good)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def all_failures(rules: list[tuple[str, Column]], good: str = "PASS") -> Column:
    """Names of all true rules, semicolon-joined in order."""
    names = F.concat_ws(";", *[F.when(rule, F.lit(name)) for name, rule in rules])
    return F.when(names == "", good).otherwise(names)


def reconcile_haploid(calls: DataFrame, keys: list[str], genotype: str) -> DataFrame:
    """Appends ``resolved``: where a position has exactly one 1/1 among its calls that becomes 1, every other call fails."""
    n = F.sum(F.when(F.col(genotype) == "1/1", 1).otherwise(0)).over(Window.partitionBy(*keys))
    return calls.withColumn("resolved", F.when((n == 1) & (F.col(genotype) == "1/1"), "1").otherwise("FAIL"))


def reconcile_diploid(calls: DataFrame, keys: list[str], genotype: str, ref: str = "ref", alt: str = "alt", wildcard: str | None = None) -> DataFrame:
    """Appends ``resolved`` by all of a position's calls; those other than 0/1, 1/1 and 1/2 don't pass.

    A position's only call stays if it is 0/1 or 1/1; one of 1/1 or 1/2
    becomes 1/2 beside a wildcard allele (``wildcard``: whether an upstream
    deletion spans the position); any other only call fails. Of several
    calls the only passing one stays if it is 0/1 or 1/1. Two passing calls
    become 1/2 if both are 1/2, or if neither is 1/1 and just one is a
    deletion, provided their alleles can be written over one reference.
    Every other call fails.
    """
    from plexframe.functions.sequences import common_ref, variant_type

    w, g = Window.partitionBy(*keys), F.col(genotype)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    passing, half = g.isin("0/1", "1/1", "1/2"), g.isin("0/1", "1/2")
    deletion = variant_type(ref, alt) == "deletion"
    alleles = F.when(passing, F.struct(F.col(ref).alias("r"), F.col(alt).alias("a")))
    one, other = F.min(alleles).over(w), F.max(alleles).over(w)
    joins = common_ref(one["r"], one["a"], other["r"], other["a"]).isNotNull()
    pair = (n(passing) == 2) & ((n(g == "1/2") == 2) | (n(half) == 2) & (n(half & deletion) == 1)) & joins
    alone = F.count("*").over(w) == 1
    beside = (F.col(wildcard) if wildcard else F.lit(False)) & g.isin("1/1", "1/2")
    kept = F.when(alone & beside, "1/2").when((n(passing) == 1) & g.isin("0/1", "1/1"), g)
    return calls.withColumn("resolved", F.when(passing & pair & ~alone, "1/2").otherwise(F.coalesce(kept, F.lit("FAIL"))))


def panel(rows: DataFrame, keys: list[str], n_files: Column, af: str, mapq: str, least_af: float, most_af: float, least_mapq: float) -> DataFrame:
    """keys, occurrences, min_af, max_af, mean_af, ratio (to the number of input files, those without a row too) of the rows that pass."""
    kept = rows.where(F.col(af).between(least_af, most_af) & (F.col(mapq) >= least_mapq))
    out = kept.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(af).alias("min_af"), F.max(af).alias("max_af"), F.avg(af).alias("mean_af"))
    return out.withColumn("ratio", F.col("occurrences") / n_files)


#: The false positive rates that the thresholds aim at.
SNV_RATE, INDEL_RATE = 0.0005, 0.005


def count_threshold(scores: DataFrame, kinds: DataFrame, kind: str, score: str, panel_size: int, least: float) -> DataFrame:
    """kind, threshold: the whole number i whose count of scores >= i, over the panel's size, comes closest to the kind's ``rate``.

    i runs from 1 to one above the largest score; it must come closer than
    the rate itself, else it is 1; the smallest i wins ties; ``least`` is the
    least threshold, and that of kinds without scores. ``kinds`` has kind and
    rate. The count only changes behind an observed whole part, so those are
    all the candidates there are.
    """
    hist = scores.groupBy(kind, F.floor(score).alias("whole")).agg(F.count("*").alias("n"))
    zero = hist.select(kind).distinct().select(kind, F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("n"))
    cells = hist.unionByName(zero).groupBy(kind, F.greatest("whole", F.lit(0)).alias("whole")).agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy(kind).orderBy(F.desc("whole")).rowsBetween(Window.unboundedPreceding, -1))
    near = cells.withColumn("above", F.coalesce(above, F.lit(0))).join(F.broadcast(kinds), kind)  # a row per substitution type
    away = F.abs(F.col("above") / float(panel_size) - F.col("rate"))
    best = near.groupBy(kind).agg(F.min(F.when(away < F.col("rate"), F.struct(away.alias("away"), (F.col("whole") + 1).alias("i")))).alias("p"))
    return kinds.join(best, kind, "left").select(kind, F.greatest(F.lit(float(least)), F.coalesce(F.col("p.i"), F.lit(1)).cast("double")).alias("threshold"))


def cross_allele(rows: DataFrame, keys: list[str], support: str) -> DataFrame:
    """Appends total, af (share of the position's support), num_alt and others."""
    w = Window.partitionBy(*keys)
    total = F.sum(support).over(w)
    return rows.withColumns({"total": total, "af": F.col(support) / F.nullif(total, F.lit(0)), "num_alt": F.count("*").over(w), "others": total - F.col(support)})


def label_from_truth(variants: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Appends gt from truth (keys, gt); absent variants are 0/0, those whose truth is NA go."""
    return variants.join(truth, keys, "left").withColumn("gt", F.coalesce("gt", F.lit("0/0"))).where("gt != 'NA'")


def best_class(probabilities: list[str], least: float) -> Column:
    """Index of the largest probability if it exceeds both ``least`` and that of class 0, else 0; smaller indices win ties."""
    best = F.greatest(*[F.col(p) for p in probabilities])
    out = F.lit(0)
    for k in range(len(probabilities) - 1, 0, -1):
        out = F.when((F.col(probabilities[k]) == best) & (best > F.greatest(F.lit(least), F.col(probabilities[0]))), k).otherwise(out)
    return out


def to_intervals(records: DataFrame, left: int, right: int) -> DataFrame:
    """contig, start, stop around each record's reference allele."""
    return records.select("contig", F.greatest(F.col("pos") - left, F.lit(0)).alias("start"), (F.col("pos") + F.length("ref") + right).alias("stop"))


def tumor_fraction(sites: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sites, fraction: twice the mean allele fraction, the alternative's count less half of the other alternatives'."""
    adjusted = F.greatest(F.col("alt") - F.col("other") / 2, F.lit(0.0)) / F.col("depth")
    return sites.where("depth > 0").groupBy(*keys).agg(F.count("*").alias("sites"), (2 * F.avg(adjusted)).alias("fraction"))
