"""Predicates of reads, bases, alignment operations, intervals, segments and variants, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from plexframe.operators.intervals import overlap_flag, range_join
from plexframe.operators.ranks import quantile

#: Base types in order: a later one meets the minimum of an earlier one.
BASE_TYPES = ("discordant", "simplex", "concordant")


def type_rank(kind: Column) -> Column:
    """The place of a base type in BASE_TYPES, null for others."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(BASE_TYPES):
        out = F.when(kind == name, k).otherwise(out)
    return out


def base_passes(quality: Column, kind: Column, query: Column, ref: Column | None, least_quality: int, least_type: str) -> Column:
    """The base-level filter: quality, type, and query and reference both ACGT; coverage (``ref`` None) needs the query only."""
    good = (quality >= least_quality) & (type_rank(kind) >= BASE_TYPES.index(least_type)) & query.rlike("^[ACGT]$")
    return F.coalesce(good if ref is None else good & ref.rlike("^[ACGT]$"), F.lit(False))


def is_pass(filters: Column) -> Column:
    """FILTER holds PASS and nothing else."""
    return F.coalesce((F.size(filters) == 1) & (F.element_at(filters, 1) == "PASS"), F.lit(False))


def is_snp(ref: Column, alts: Column) -> Column:
    """Every allele is one base long."""
    return (F.length(ref) == 1) & F.forall(alts, lambda a: (F.length(a) == 1) & (a != "*"))


def is_multiallelic(alts: Column) -> Column:
    return F.size(alts) > 1


def _beyond_homopolymer(start: Column, pos: Column, strict: bool) -> Column:
    """Whether a homopolymer at the alignment's end has begun before the position (or at it)."""
    return F.coalesce(start < pos if strict else start <= pos, F.lit(False))


def can_insert(pos: Column, region_start: Column, region_end: Column, homopolymer: Column, known: Column | None, types: Column | None, least_type: str | None) -> Column:
    """An insertion counts: inside the region, not behind a homopolymer's start, at a known position, any base of the least type.

    ``known``: whether the position is among those with record features, null
    if none were extracted. ``types``: ranks of the inserted bases.
    """
    out = (pos >= region_start) & (pos < region_end) & ~_beyond_homopolymer(homopolymer, pos, True)
    out &= F.lit(True) if known is None else known
    return out if least_type is None else out & F.exists(types, lambda t: t >= BASE_TYPES.index(least_type))


def can_delete(pos: Column, length: Column, region_start: Column, region_end: Column, last_start: Column, last_end: Column, homopolymer: Column, known_before: Column | None, type_before: Column | None, least_type: str | None) -> Column:
    """A deletion counts: overlaps the region and not the region before, not at or behind a homopolymer's start, at a known position, the base before it of the least type."""
    stop = pos + length
    out = (pos < region_end) & (stop > region_start) & ~F.coalesce((pos < last_end) & (stop > last_start), F.lit(False))
    out &= ~_beyond_homopolymer(homopolymer, pos, False)
    out &= F.lit(True) if known_before is None else known_before
    return out if least_type is None else out & F.coalesce(type_before >= BASE_TYPES.index(least_type), F.lit(False))


def can_mismatch(pos: Column, region_start: Column, region_end: Column, homopolymer: Column, known: Column | None, kind: Column | None, least_type: str | None) -> Column:
    """A mismatch counts: inside the region, not at or behind a homopolymer's start, at a known position, of the least type."""
    out = (pos >= region_start) & (pos < region_end) & ~_beyond_homopolymer(homopolymer, pos, False)
    out &= F.lit(True) if known is None else known
    return out if least_type is None else out & F.coalesce(kind >= BASE_TYPES.index(least_type), F.lit(False))


def can_match(pos: Column, region_end: Column, known: Column | None, known_before: Column | None, kind: Column | None, least_type: str | None) -> Column:
    """A match counts: up to the region's end itself, at a known position or right behind one, of the least type."""
    out = pos <= region_end
    out &= F.lit(True) if known is None else known | known_before
    return out if least_type is None else out & F.coalesce(kind >= BASE_TYPES.index(least_type), F.lit(False))


def variants_per_read(ops: DataFrame, read: list[str], op: str, skip: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """read, variants: insertions, deletions and mismatches of each read but those that ``skip`` lists by ``key``; reads without one have 0."""
    counted = F.col(op).isin("insertion", "deletion", "mismatch")
    if skip is not None:
        ops = ops.join(skip.select(*key).distinct().withColumn("skipped", F.lit(True)), key, "left")
        counted &= F.col("skipped").isNull()
    return ops.groupBy(*read).agg(F.sum(counted.cast("int")).alias("variants"))


def moderate_gc(gc: Column, low: float = 0.15, high: float = 0.75) -> Column:
    return F.coalesce(gc.between(low, high), F.lit(False))


def mappable(intervals: DataFrame, track: DataFrame, autosome: Column, least_autosome: float, least_allosome: float) -> DataFrame:
    """The intervals whose length-weighted mean of a track (contig, start, stop, score) reaches the threshold of their contig; those without a score go.

    Appends ``mappability``, over the bases that the track covers.
    """
    at = ["contig", "start", "stop"]
    shared = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    mean = range_join(intervals.select(*at).distinct(), track).groupBy(*at).agg((F.sum(shared * F.col("r_score")) / F.sum(shared)).alias("mappability"))
    return intervals.hint("merge").join(mean, at).where(F.col("mappability") >= F.when(autosome, least_autosome).otherwise(least_allosome))


def both_covered(pairs: DataFrame, tumor: str, normal: str, least_tumor: float, least_normal: float) -> DataFrame:
    """The rows where both average coverages reach their minima."""
    return pairs.where((F.col(tumor) >= least_tumor) & (F.col(normal) >= least_normal))


def panel_intervals(counts: DataFrame, interval: list[str], sample: str, count: str, share: float = 0.25, least_nonzero: float = 0.97) -> DataFrame:
    """interval, median, keeps: fraction medians above ``share`` of their median, more than ``least_nonzero`` of the samples non-zero, median not 0."""
    totals = counts.groupBy(sample).agg(F.sum(count).alias("total"))
    fractions = counts.join(totals, sample).withColumn("f", F.col(count) / F.col("total"))
    each = fractions.groupBy(*interval).agg(F.percentile("f", F.lit(0.5)).alias("median"), F.avg((F.col(count) > 0).cast("double")).alias("nonzero"))
    middle = each.agg(F.percentile("median", F.lit(0.5)).alias("middle"))  # one value per interval of a panel
    keeps = (F.col("median") > share * F.col("middle")) & (F.col("nonzero") > least_nonzero) & (F.col("median") != 0)
    return each.crossJoin(F.broadcast(middle)).select(*interval, "median", keeps.alias("keeps"))


def panel_samples(counts: DataFrame, sample: str, count: str, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """sample, mean, keeps: means strictly between ``low`` and ``high`` times their median."""
    means = counts.groupBy(sample).agg(F.avg(count).alias("mean"))
    middle = means.agg(F.percentile("mean", F.lit(0.5)).alias("middle"))
    keeps = (F.col("mean") > low * F.col("middle")) & (F.col("mean") < high * F.col("middle"))
    return means.crossJoin(F.broadcast(middle)).select(sample, "mean", keeps.alias("keeps"))


def panel_and_sample(rows: DataFrame, least_length: int, least_panel: float, least_both: float) -> DataFrame:
    """Intervals (start, stop, panel, coverage) long enough, of the least panel median, and of the least in panel and sample together."""
    return rows.where((F.col("stop") - F.col("start") >= least_length) & (F.col("panel") >= least_panel) & (F.least("panel", "coverage") >= least_both))


def single_sample_site(biallelic_snp: Column, passed: Column, phased: Column, depth: Column, baf: Column, least_depth: int, low: float, high: float, keep_all: bool = False) -> Column:
    """A germline site of one sample: biallelic SNP, PASS, unphased, deep enough, its fraction strictly between the bounds unless all are kept."""
    out = biallelic_snp & passed & ~phased & (depth >= least_depth)
    return F.coalesce(out if keep_all else out & (baf > low) & (baf < high), F.lit(False))


def paired_site(biallelic_snp: Column, passed: Column, normal_depth: Column, normal_baf: Column, tumor_depth: Column, least_depth: int, low: float, high: float) -> Column:
    """A germline site of a pair: PASS rows are somatic and out; the normal is deep enough and its fraction within the bounds, the tumor covered."""
    return F.coalesce(biallelic_snp & ~passed & (normal_depth >= least_depth) & normal_baf.between(low, high) & (tumor_depth > 0), F.lit(False))


def pair_is_sufficient(sites: DataFrame, somatic: Column, het: Column, forced: bool = False) -> DataFrame:
    """One row ``sufficient``: no somatic row, or at least half of the rows heterozygous, or forced."""
    n = sites.agg(F.sum(somatic.cast("int")).alias("somatic"), F.avg(het.cast("double")).alias("het"))
    return n.select((F.lit(forced) | (F.coalesce("somatic", F.lit(0)) == 0) | (F.coalesce("het", F.lit(0.0)) >= 0.5)).alias("sufficient"))


def skip_by_sex(contig: Column, allosome: Column, par: Column, mode: str, sex: Column) -> Column:
    """Segments that aren't called: allosomes of unknown sex, Y of females, in somatic mode non-PAR allosomes of males, in germline mode Y's PAR of males."""
    y = contig.isin("chrY", "Y")
    male = (allosome & ~par) if mode == "somatic" else (y & par)
    return F.coalesce((sex == "unknown") & allosome | (sex == "female") & y | (sex == "male") & male, F.lit(False))


def expect_haploid(allosome: Column, par: Column, mode: str, sex: Column) -> Column:
    return F.lit(mode == "germline") & allosome & ~par & (sex == "male")


def skip_for_grid(mean_log_ratio: Column, n_log_ratios: Column, n_snps: Column | None, most: float = 0.9, least: int = 11) -> Column:
    """Segments that the purity grid leaves out: a mean log ratio above ``most``, fewer than ``least`` log ratios or SNPs."""
    out = (mean_log_ratio > most) | (n_log_ratios < least)
    return out if n_snps is None else out | F.coalesce(n_snps < least, F.lit(True))


def dense_segments(segments: DataFrame, intervals: DataFrame, least: float = 0.5) -> DataFrame:
    """Appends ``dense``: whether intervals cover at least ``least`` of a segment's bases."""
    at = ["contig", "start", "stop"]
    shared = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    covered = range_join(segments.select(*at).distinct(), intervals.select(*at)).groupBy(*at).agg(F.sum(shared).alias("covered"))
    out = segments.join(covered, at, "left")
    return out.withColumn("dense", F.coalesce("covered", F.lit(0)) >= least * (F.col("stop") - F.col("start"))).drop("covered")


def coverage_check(rows: DataFrame, count: str, least: float = 10) -> DataFrame:
    """One row: the median count of intervals, the percentage below the threshold, and whether the median reaches it."""
    out = rows.agg((100 * F.avg((F.col(count) < least).cast("double"))).alias("percent_low")).withColumn("median", F.lit(quantile(rows, count, 0.5)).cast("double")).select("median", "percent_low")
    return out.withColumn("enough", F.coalesce(F.col("median") >= least, F.lit(False)))


def phased_failures(blocked: Column, allele_depth: Column, allele_fraction: Column, mapq: Column, baseq: Column, least_count: int, least_baseq: int, least_mapq: int, low: float, high: float) -> Column:
    """All failures of a phased variant, in order, or PASS."""
    from plexframe.operators.variants import all_failures

    rules = [("blocklisted", blocked), ("min_alt_counts", allele_depth < least_count), ("base_quality", baseq < least_baseq), ("map_quality", mapq < least_mapq), ("allele_fraction", (allele_fraction < low) | (allele_fraction > high))]
    return all_failures(rules)


def variant_failures(mapq: Column, baseq: Column, score: Column, threshold: Column, hotspot: Column, hotspot_threshold: float, ml: Column, blocked: Column, allele_fraction: Column, least_mapq: float, least_baseq: float, least_ml: float, least_af: float) -> Column:
    """All failures of a target-enrichment variant, in order, or PASS; hotspots have a threshold of their own for the weighted counts."""
    from plexframe.operators.variants import all_failures

    weighted = score < F.when(hotspot, hotspot_threshold).otherwise(threshold)
    rules = [("map_quality", mapq < least_mapq), ("base_quality", baseq < least_baseq), ("weighted_counts", weighted), ("ml_score", ml < least_ml), ("blocklisted", blocked), ("allele_fraction", allele_fraction < least_af)]
    return all_failures(rules)


def somatic_failure(tumor_support: Column, normal_support: Column, tumor_af: Column, tumor_depth: Column, normal_depth: Column, target_tumor: Column, target_normal: Column, least_support: int, most_normal: int, least_af: float, ratio: tuple[float, float]) -> Column:
    """The first hard filter that a tumor and normal pair fails, or PASS: the tumor's support, the normal's, the tumor's fraction, then its depth over its target's relative to the normal's."""
    from plexframe.operators.variants import first_failure

    relative = (tumor_depth / F.nullif(target_tumor, F.lit(0))) / F.nullif(normal_depth / F.nullif(target_normal, F.lit(0)), F.lit(0))
    rules = [("tumor_support", tumor_support < least_support), ("normal_support", normal_support > most_normal), ("tumor_af", tumor_af < least_af), ("dp_ratio", ~F.coalesce(relative.between(*ratio), F.lit(True)))]
    return first_failure(rules)


#: Statuses of tumor-fraction sites in the order in which they are tested.
FRACTION_STATUSES = ("low_depth", "other_alts", "high_vaf", "low_mapq", "blocklisted", "not_in_region", "indel_neighbour")


def fraction_status(**failures: Column) -> Column:
    """The first of FRACTION_STATUSES whose failure holds, else pass."""
    from plexframe.operators.variants import first_failure

    return first_failure([(name, failures[name]) for name in FRACTION_STATUSES if name in failures], "pass")


def skip_record(assigned: Column, failed: Column, keep_unassigned: bool, keep_failed: bool) -> Column:
    """Demultiplexed records that aren't written: unassigned or failed ones, unless these are asked for."""
    return (~assigned & F.lit(not keep_unassigned)) | (failed & F.lit(not keep_failed))


def without_pars(intervals: DataFrame, pars: DataFrame, unmasked: bool | Column = True) -> DataFrame:
    """Drops the intervals that overlap a pseudo-autosomal region, if Y's PAR is unmasked (it has coverage)."""
    flagged = overlap_flag(intervals, pars.select("contig", "start", "stop"))
    return flagged.where(~(F.col("overlaps") & (unmasked if isinstance(unmasked, Column) else F.lit(unmasked)))).drop("overlaps")


def is_sorted(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """keys, sorted: whether each group's rows, numbered by ``place``, ascend by ``order``."""
    w = Window.partitionBy(*keys).orderBy("place")
    here = F.struct(*order)
    return rows.withColumn("good", F.coalesce(F.lag(here).over(w) <= here, F.lit(True))).groupBy(*keys).agg(F.min("good").alias("sorted"))
