"""Alignment records, variant features and training rows: joins, derived features, rescue, tagging and processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from plexframe.operators.intervals import range_join
from plexframe.operators.variants import first_failure

UNMAPPED, SECONDARY, DUPLICATE, SUPPLEMENTARY = 4, 256, 1024, 2048


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def in_regions(alignments: DataFrame, regions: DataFrame) -> DataFrame:
    """The alignments that overlap any region, each once however many it overlaps."""
    at = ["contig", "start", "stop"]
    hit = range_join(alignments.select(*at).distinct(), regions.select(*at)).select(*at).distinct()
    return alignments.join(hit, at, "left_semi")


def propagate_duplicates(records: DataFrame, name: str = "qname", flag: str = "flag", split: Column | None = None) -> DataFrame:
    """Sets the duplicate bit of supplementary records whose primary is a duplicate (``split``: and has further alignments)."""
    primary = ~has(F.col(flag), SECONDARY) & ~has(F.col(flag), SUPPLEMENTARY) & has(F.col(flag), DUPLICATE)
    names = records.where(primary & (F.lit(True) if split is None else split)).select(name).distinct().withColumn("copied", F.lit(True))
    out = records.join(names, name, "left")
    mark = has(F.col(flag), SUPPLEMENTARY) & F.col("copied").isNotNull()
    return out.withColumn(flag, F.when(mark, F.col(flag).bitwiseOR(DUPLICATE)).otherwise(F.col(flag))).drop("copied")


def rescue_secondaries(records: DataFrame, place: str, name: str = "qname", flag: str = "flag", score: str = "score", length: str = "length", least: float = 0.0) -> DataFrame:
    """Primary and supplementary records, and of reads whose primary is unmapped the first mapped secondary of a good score, with ``rescued`` set.

    ``place`` orders a read's records; the score per base must reach ``least``.
    """
    f = F.col(flag)
    secondary = has(f, SECONDARY)
    lost = records.where(~secondary & ~has(f, SUPPLEMENTARY) & has(f, UNMAPPED)).select(name).distinct()
    good = F.coalesce((F.col(length) > 0) & (F.col(score) / F.col(length) >= least), F.lit(False))
    first = records.where(secondary & ~has(f, UNMAPPED) & good).join(lost, name, "left_semi").groupBy(name).agg(F.min(place).alias(place))
    rescued = records.where(secondary).join(first, [name, place], "left_semi").withColumn("rescued", F.lit(True))
    return records.where(~secondary).withColumn("rescued", F.lit(False)).unionByName(rescued)


def samples_of_groups(records: DataFrame, groups: DataFrame, group: str = "rg") -> DataFrame:
    """Appends ``sample`` by read group; ``groups`` has one row per group of a header (group, sample)."""
    return records.join(F.broadcast(groups.limit(100_000)), group, "left")  # a header's read groups


def with_unplaced(metrics: DataFrame, reads: DataFrame, names: dict[str, Column]) -> DataFrame:
    """Adds the counts of unmapped reads without a place, once, to a one-row table of metrics."""
    extra = reads.where(F.col("contig").isNull()).agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias("u_" + n) for n, c in names.items()])
    both = metrics.crossJoin(F.broadcast(extra))  # one row each
    return both.select(*[(F.col(c) + F.col("u_" + c)).alias(c) if c in names else F.col(c) for c in metrics.columns])


def mark_duplicates(reads: DataFrame, cluster: list[str], best: str, flag: str = "flag") -> DataFrame:
    """Sets the duplicate bit of a cluster's reads but its best, and appends cluster_size; reads without a cluster stay as they are."""
    size = reads.where(F.col(cluster[0]).isNotNull()).groupBy(*cluster).agg(F.count("*").alias("cluster_size"))
    out = reads.join(size, cluster, "left")
    twin = F.col("cluster_size").isNotNull() & ~F.col(best)
    return out.withColumn(flag, F.when(twin, F.col(flag).bitwiseOR(DUPLICATE)).otherwise(F.col(flag)))


def attach_features(variants: DataFrame, features: DataFrame, references: DataFrame, keys: list[str], position: list[str], required: list[str]) -> DataFrame:
    """Variants with their features by ``keys`` and the reference's by ``position``; ``missing`` says whether a required one is absent."""
    out = variants.join(features, keys, "left").join(references, position, "left")
    absent = F.lit(False)
    for c in required:
        absent |= F.col(c).isNull()
    return out.withColumn("missing", absent)


def derived_features(sums: DataFrame, ratios: list[str], means: list[str], support: str = "support") -> DataFrame:
    """Appends x_ratio of every count x_count and x_mean of every sum x_sum over the support; null without support."""
    n = F.nullif(F.col(support), F.lit(0))
    return sums.withColumns({f"{x}_ratio": F.col(f"{x}_count") / n for x in ratios} | {f"{x}_mean": F.col(f"{x}_sum") / n for x in means})


def allele_shares(variants: DataFrame, references: DataFrame, position: list[str], support: str, ref_support: str) -> DataFrame:
    """Appends dp (variants and reference of the position), af, adt (the difference's share) and adtl (that times log10 of the pair's support)."""
    total = variants.groupBy(*position).agg(F.sum(support).alias("alt_total"))
    out = variants.join(references, position, "left").join(total, position)
    dp = F.col("alt_total") + F.coalesce(ref_support, F.lit(0))
    pair = F.col(support) + F.coalesce(ref_support, F.lit(0))
    adt = F.when(pair > 0, F.abs(F.col(support) - F.coalesce(ref_support, F.lit(0))) / pair)
    return out.withColumns({"dp": dp, "af": F.col(support) / F.nullif(dp, F.lit(0)), "adt": adt, "adtl": F.log10(pair) * adt}).drop("alt_total")


def median_depths(depths: DataFrame, keys: list[str], contig: str, depth: str) -> DataFrame:
    """keys, median, total: the median and the sum over contigs of their median depths, zeros left out; a position counts once a contig."""
    each = depths.groupBy(*keys, contig).agg(F.percentile(depth, F.lit(0.5)).alias("m")).where("m > 0")
    return each.groupBy(*keys).agg(F.percentile("m", F.lit(0.5)).alias("median"), F.sum("m").alias("total"))


def deletion_span(calls: DataFrame, keys: list[str], pos: str, end: str, spanning: Column) -> DataFrame:
    """Appends ``beneath``: whether an earlier call that spans (0/1 or 1/2) reaches a position, by the running maximum of their ends."""
    w = Window.partitionBy(*keys).orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("beneath", F.coalesce(F.max(F.when(spanning, F.col(end))).over(w) >= F.col(pos), F.lit(False)))


def training_rows(rows: DataFrame, variant: list[str], label: str, pos: str, order: str, *columns: str) -> DataFrame:
    """Rows to train on: of a majority label's rows of one variant the last stays at even positions, the first at odd ones; all of other labels.

    A label is a majority one if it has more rows than the labels' mean
    (integer division).
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    even = counts.agg((F.sum("n") / F.count("*")).cast("long").alias("expected"))
    major = counts.crossJoin(F.broadcast(even)).select(label, (F.col("n") > F.col("expected")).alias("major"))  # a row per label
    marked = rows.join(F.broadcast(major), label)
    kept = F.struct(order, *columns)
    picked = marked.where("major").groupBy(*variant, label).agg(F.when(F.col(pos) % 2 == 0, F.max(kept)).otherwise(F.min(kept)).alias("k")) if pos in variant else None
    if picked is None:
        raise ValueError("a variant's position is part of its key")
    return marked.where("NOT major").select(*variant, label, order, *columns).unionByName(picked.select(*variant, label, "k.*"))


def germline_tag(genotype: Column, score: Column, least: float) -> Column:
    """What a tag-only run writes: the genotype of a germline call of the least score, else 0/0."""
    return F.when(genotype.isin("0/1", "1/1", "1/2") & (score >= least), genotype).otherwise("0/0")


def somatic_result(alt: Column, ref: Column, missing: Column, hard: Column, score: Column, least: float, longest: int = 50) -> Column:
    """A somatic record's filter, tested in order: wildcard or symbolic allele, indel too long, missing feature, hard filters, model score."""
    odd = ~alt.rlike("^[ACGTN]+$")
    size = F.abs(F.length(alt) - F.length(ref))
    rules = [("unsupported_allele", odd), ("indel_length", size > longest), ("missing_feature", missing), ("hard", hard != "PASS"), ("low_score", F.coalesce(score, F.lit(0.0)) < least)]
    out = first_failure(rules)
    return F.when(out == "hard", hard).otherwise(out)


def with_forced_calls(records: DataFrame, forced: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Records and, where none is, a row for every listed position that has features, in the records' order of ``keys``; ``forced`` tells them apart.

    The order is that of a later sort by ``keys``.
    """
    listed = forced.select(*keys).distinct().join(features.select(*keys).distinct(), keys, "left_semi").join(records.select(*keys).distinct(), keys, "left_anti")
    return records.withColumn("forced", F.lit(False)).unionByName(listed.withColumn("forced", F.lit(True)), allowMissingColumns=True)


def contribution_rows(scores: DataFrame, keys: list[str], best: str, contributions: str, names: list[str]) -> DataFrame:
    """keys, feature, value: the contributions to the best class of each row, from an array of classes by features (the last is the bias)."""
    own = F.element_at(F.col(contributions), F.col(best) + 1)
    pairs = F.arrays_zip(F.array(*map(F.lit, [*names, "bias"])).alias("feature"), own.alias("value"))
    return scores.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.feature", "x.value")


def repick(bases: DataFrame, quality: int = 22) -> DataFrame:
    """Where a discordant base's second strand agrees with the graph's base, that base is taken with ``quality``; excluded positions stay.

    ``bases`` has base, qual, r2, graph and excluded.
    """
    switch = (F.col("base") != F.col("graph")) & (F.col("r2") == F.col("graph")) & ~F.col("excluded")
    return bases.withColumns({"base": F.when(switch, F.col("graph")).otherwise(F.col("base")), "qual": F.when(switch, F.lit(quality)).otherwise(F.col("qual")), "switched": switch})


def locate(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Appends ``located``: the number of the interval (contig, start, stop, number) that holds a point (contig, pos), null if none does."""
    ends = points.withColumns({"start": F.col("pos"), "stop": F.col("pos") + 1})
    hit = range_join(ends.select("contig", "start", "stop").distinct(), intervals).select("contig", F.col("start").alias("pos"), F.col("r_number").alias("located"))
    return points.join(hit, ["contig", "pos"], "left")


def probe_sites(sites: DataFrame, candidates: DataFrame, least_away: int = 200, most: int = 200_000) -> DataFrame:
    """Noise probes: candidates of a site's reference allele and context, at least ``least_away`` from every site; ``most`` of them by a digest of their place.

    Both have contig, pos, ref and context. The limit is the feature.
    """
    near = sites.select("contig", F.greatest(F.col("pos") - least_away + 1, F.lit(0)).alias("start"), (F.col("pos") + least_away).alias("stop"))
    spots = candidates.withColumns({"start": F.col("pos"), "stop": F.col("pos") + 1})
    kinds = sites.select("ref", "context").distinct()
    clear = range_join(spots.select("contig", "start", "stop").distinct(), near).select("contig", "start").distinct()
    out = spots.join(kinds, ["ref", "context"], "left_semi").join(clear, ["contig", "start"], "left_anti").drop("start", "stop")
    return out.orderBy(F.md5(F.concat_ws(":", "contig", "pos")), "contig", "pos").limit(most)


def alignment_ops(reads: DataFrame, keep: list[str]) -> DataFrame:
    """keep, at, op, len, pos, read_pos: a read's operations against its target sequence, in order.

    Runs of equal bases are one match, every other base a mismatch of its
    own; insertions (at the base before) and deletions at either end are left
    out, skipped stretches are kept, = and X are taken at their word. Reads
    have start, cigar, seq and target (from position 0 on); an operation of
    one read goes through its own bases only.
    """
    import re
    from functools import lru_cache

    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {"N": "skip", "=": "match", "X": "mismatch"}
    schema = ", ".join(f"{c} {reads.schema[c].dataType.simpleString()}" for c in keep) + ", at long, op string, len long, pos long, read_pos long"
    kind = to_arrow_schema(T.DataType.fromDDL(schema))

    def run(batches):
        @lru_cache(1 << 14)
        def parsed(cigar: str) -> list[tuple[int, str]]:
            return [(int(n), op) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]

        def ops(start: int, cigar: str, seq: str, target: str) -> list[tuple]:
            out: list[tuple] = []
            parts = parsed(cigar)
            t, q = start, 0
            for k, (n, op) in enumerate(parts):
                inner = bool(out) and k < len(parts) - 1
                if op == "M":
                    a, b = seq[q : q + n], target[t : t + n]
                    if len(a) < n or len(b) < n:
                        raise IndexError("an alignment beyond its read or its target")
                    # Runs of equal bases lie between the places that differ.
                    places = [-1, *([j for j in range(n) if a[j] != b[j]] if a != b else ()), n]
                    for lo, hi in zip(places, places[1:]):
                        if lo >= 0:
                            out.append(("mismatch", 1, t + lo, q + lo))
                        if hi > lo + 1:
                            if out and out[-1][0] == "match":
                                last = out[-1]
                                out[-1] = (last[0], last[1] + hi - lo - 1, *last[2:])
                            else:
                                out.append(("match", hi - lo - 1, t + lo + 1, q + lo + 1))
                elif op == "I" and inner:
                    out.append(("insertion", n, t - 1, q))
                elif op == "D" and inner:
                    out.append(("deletion", n, t, q))
                elif op in "N=X":
                    out.append((names[op], n, t, q))
                t += n if op in "MDN=X" else 0
                q += n if op in "MIS=X" else 0
            return out

        for batch in batches:
            own = batch.select(keep)
            found = [ops(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("start", "cigar", "seq", "target")), strict=True)]
            times = [len(o) for o in found]
            row = pa.array([k for k, n in enumerate(times) for _ in range(n)], pa.int64())
            columns = list(zip(*(o for some in found for o in some), strict=True)) or [()] * 4
            made = [pa.array([k for n in times for k in range(n)], pa.int64()), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([c.take(row).cast(f.type) for c, f in zip(own.columns, kind)] + made, schema=kind)

    return reads.select(*keep, "start", "cigar", "seq", "target").mapInArrow(run, schema)


def reference_context(rows: DataFrame, seq: str, pos: str, half: int = 100, k: int = 3) -> DataFrame:
    """Appends what the reference around a position says: context, its index, GC and distinct k-mers within ``half`` bases, and the run and repeat that begin behind it."""
    from plexframe.functions import numbers as N, sequences as S

    b = N.window_bounds(pos, F.length(seq), half)
    around = F.substring(F.col(seq), b["start"].cast("int") + 1, (b["stop"] - b["start"]).cast("int"))
    behind = F.substring(F.col(seq), F.col(pos).cast("int") + 2, F.length(seq))
    unit = S.repeat_unit(behind)
    two = S.context(seq, F.col(pos).cast("int"))
    return rows.withColumns({"context": two, "context_index": S.context_index(two), "gc": S.gc_fraction(around), "kmers": S.distinct_kmers(around, k), "run": S.homopolymer_at_start(behind), "unit": unit["unit"], "copies": unit["copies"]})


def record_features(records: DataFrame) -> DataFrame:
    """contig, pos, ref, alt, allele, qual, dp, ref_ad, alt_ad, af, gt: a feature row per alternative of VCF records' first sample."""
    from plexframe.functions.sequences import genotype_number

    own = F.col("samples")[0]["format"]
    depths = F.transform(F.coalesce(own["AD"], F.array().cast("array<string>")), lambda x: x.try_cast("int"))
    each = records.select("contig", "pos", "ref", "qual", "info", depths.alias("ad"), own["GT"][0].alias("g"), F.posexplode("alts").alias("i", "alt"))
    at = lambda k: F.try_element_at("ad", k)
    total = F.aggregate("ad", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    dp = F.try_element_at(F.try_element_at("info", F.lit("DP")), F.lit(1)).try_cast("int")
    return each.select("contig", "pos", "ref", "alt", (F.col("i") + 1).alias("allele"), "qual", dp.alias("dp"), at(F.lit(1)).alias("ref_ad"), at(F.col("i") + 2).alias("alt_ad"), (at(F.col("i") + 2) / F.nullif(total, F.lit(0))).alias("af"), genotype_number("g").alias("gt")).orderBy("contig", "pos", "allele")
