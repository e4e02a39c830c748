"""Filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexframe.operators import filters as L, intervals as I
from plexframe.plans.copy_queries import COV, cov
from plexframe.plans.views import READS, REGIONS, query, reads, regions, table

KIND = "CASE part % 3 WHEN 0 THEN 'discordant' WHEN 1 THEN 'simplex' ELSE 'concordant' END"


def kind(c="part"):
    return F.when(F.col(c) % 3 == 0, "discordant").when(F.col(c) % 3 == 1, "simplex").otherwise("concordant")


def base(c):
    return F.element_at(F.array(*map(F.lit, "ACGTN")), (F.col(c) % 5 + 1).cast("int"))


@query(f"WITH {READS}, b AS (SELECT *, {KIND} AS kind, (['A','C','G','T','N'])[molecule % 5 + 1] AS q, (['A','C','G','T','N'])[part % 5 + 1] AS r FROM reads) SELECT read_id, mapq >= 4 AND kind <> 'discordant' AND q <> 'N' AND r <> 'N' AS error, mapq >= 4 AND kind <> 'discordant' AND q <> 'N' AS coverage FROM b")
def base_level_filter(spark, d):
    b = reads(spark, d).withColumns({"kind": kind(), "q": base("molecule"), "r": base("part")})
    pass_ = lambda ref: L.base_passes(F.col("mapq"), F.col("kind"), F.col("q"), ref, 4, "simplex")
    return b.select("read_id", pass_(F.col("r")).alias("error"), pass_(None).alias("coverage"))


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN ['PASS'] WHEN p_partkey % 3 = 1 THEN ['PASS', 'q10'] ELSE ['q10'] END AS filters, CASE WHEN p_partkey % 4 = 0 THEN 'AT' ELSE 'A' END AS ref, CASE WHEN p_partkey % 5 = 0 THEN ['C', 'G'] WHEN p_partkey % 5 = 1 THEN ['CA'] WHEN p_partkey % 5 = 2 THEN ['*'] ELSE ['T'] END AS alts FROM part)
    SELECT id, filters = ['PASS'] AS passed, length(ref) = 1 AND NOT list_contains(alts, '*') AND list_max(list_transform(alts, lambda a: length(a))) = 1 AS snp, len(alts) > 1 AS multi FROM r""")
def record_predicates(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    texts = lambda *x: F.array(*map(F.lit, x))
    r = p.select(k.alias("id"), F.when(k % 3 == 0, texts("PASS")).when(k % 3 == 1, texts("PASS", "q10")).otherwise(texts("q10")).alias("filters"), F.when(k % 4 == 0, "AT").otherwise("A").alias("ref"), F.when(k % 5 == 0, texts("C", "G")).when(k % 5 == 1, texts("CA")).when(k % 5 == 2, texts("*")).otherwise(texts("T")).alias("alts"))
    return r.select("id", L.is_pass(F.col("filters")).alias("passed"), L.is_snp(F.col("ref"), F.col("alts")).alias("snp"), L.is_multiallelic(F.col("alts")).alias("multi"))


#: An operation of every read: its position, region, homopolymer start, base-type ranks and whether records are known there.
OPS = f"""{READS}, ops AS (SELECT read_id, start AS pos, stop - start AS len, part % 30 * 80 AS rs, part % 30 * 80 + 900 AS re, CASE WHEN part % 4 = 0 THEN start + mapq - 5 END AS hp, errors % 3 AS t, (errors + part) % 3 AS t2, part % 3 > 0 AS known, part % 5 > 0 AS before, part % 30 * 80 - 300 AS ls, part % 30 * 80 - 10 AS le FROM reads)"""


def ops(spark, d):
    p = F.col("part") % 30 * 80
    return reads(spark, d).select("read_id", F.col("start").alias("pos"), (F.col("stop") - F.col("start")).alias("len"), p.alias("rs"), (p + 900).alias("re"), F.when(F.col("part") % 4 == 0, F.col("start") + F.col("mapq") - 5).alias("hp"), (F.col("errors") % 3).alias("t"), ((F.col("errors") + F.col("part")) % 3).alias("t2"), (F.col("part") % 3 > 0).alias("known"), (F.col("part") % 5 > 0).alias("before"), (p - 300).alias("ls"), (p - 10).alias("le"))


@query(f"""WITH {OPS} SELECT read_id, pos >= rs AND pos < re AND NOT coalesce(hp < pos, false) AND known AND (t >= 1 OR t2 >= 1) AS insertion,
    pos < re AND pos + len > rs AND NOT (pos < le AND pos + len > ls) AND NOT coalesce(hp <= pos, false) AND before AND t >= 1 AS deletion,
    pos >= rs AND pos < re AND NOT coalesce(hp <= pos, false) AND known AND t >= 1 AS mismatch, pos <= re AND (known OR before) AND t >= 1 AS match FROM ops""")
def admissible_operations(spark, d):
    c = F.col
    o = ops(spark, d)
    return o.select("read_id", L.can_insert(c("pos"), c("rs"), c("re"), c("hp"), c("known"), F.array("t", "t2"), "simplex").alias("insertion"), L.can_delete(c("pos"), c("len"), c("rs"), c("re"), c("ls"), c("le"), c("hp"), c("before"), c("t"), "simplex").alias("deletion"),
        L.can_mismatch(c("pos"), c("rs"), c("re"), c("hp"), c("known"), c("t"), "simplex").alias("mismatch"), L.can_match(c("pos"), c("re"), c("known"), c("before"), c("t"), "simplex").alias("match"))


OP = "(['match', 'insertion', 'deletion', 'mismatch'])[errors % 4 + 1]"


@query(f"WITH {READS}, o AS (SELECT molecule, part, {OP} AS op FROM reads) SELECT molecule, count(*) FILTER (op <> 'match' AND part % 7 <> 0)::BIGINT AS variants FROM o GROUP BY molecule")
def variants_in_read(spark, d):
    o = reads(spark, d).select("molecule", "part", F.element_at(F.array(*map(F.lit, ("match", "insertion", "deletion", "mismatch"))), (F.col("errors") % 4 + 1).cast("int")).alias("op"))
    known = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("part"))
    return L.variants_per_read(o, ["molecule"], "op", known, ["part"])


@query(f"WITH {COV}, g AS (SELECT contig, bin, (bin + contig % 7) / 45.0 AS gc FROM cov) SELECT contig, bin, round(gc, 6) AS gc FROM g WHERE gc BETWEEN 0.15 AND 0.75")
def moderate_gc_intervals(spark, d):
    g = cov(spark, d).select("contig", "bin", ((F.col("bin") + F.col("contig") % 7) / 45.0).alias("gc"))
    return g.where(L.moderate_gc(F.col("gc"))).withColumn("gc", F.round("gc", 6))


@query(f"""WITH {REGIONS}, track AS (SELECT contig, start + 20 AS start, stop - 10 AS stop, (start // 90 % 4) / 3.0 AS score FROM regions WHERE start // 90 % 2 = 0),
    w AS (SELECT g.contig, g.start, g.stop, sum((least(g.stop, t.stop) - greatest(g.start, t.start)) * t.score) / sum(least(g.stop, t.stop) - greatest(g.start, t.start)) AS m FROM regions g JOIN track t ON g.contig = t.contig AND g.start < t.stop AND g.stop > t.start GROUP BY ALL)
    SELECT contig, start, stop, round(m, 6) AS mappability FROM w WHERE m >= CASE WHEN contig % 9 > 0 THEN 0.5 ELSE 0.9 END""")
def mappable_intervals(spark, d):
    g = regions(spark, d)
    track = g.where(F.floor(F.col("start") / 90) % 2 == 0).select("contig", (F.col("start") + 20).alias("start"), (F.col("stop") - 10).alias("stop"), (F.floor(F.col("start") / 90) % 4 / 3.0).alias("score"))
    return L.mappable(g, track, F.col("contig") % 9 > 0, 0.5, 0.9).withColumn("mappability", F.round("mappability", 6))


@query(f"WITH {COV} SELECT contig, bin, tumor, normal FROM cov WHERE tumor >= 1 AND normal >= 2")
def pair_coverage_filter(spark, d):
    return L.both_covered(cov(spark, d), "tumor", "normal", 1, 2).select("contig", "bin", "tumor", "normal")


PANEL = f"{COV}, p AS (SELECT contig % 15 AS sample, bin, sum(CASE WHEN bin % 11 = 3 AND contig % 15 < 3 THEN 0 WHEN bin % 13 = 0 THEN 0 ELSE counts END)::BIGINT AS counts FROM cov GROUP BY ALL)"


def panel(spark, d):
    low = (F.col("bin") % 11 == 3) & (F.col("contig") % 15 < 3) | (F.col("bin") % 13 == 0)
    return cov(spark, d).groupBy((F.col("contig") % 15).alias("sample"), "bin").agg(F.sum(F.when(low, 0).otherwise(F.col("counts"))).alias("counts"))


@query(f"""WITH {PANEL}, t AS (SELECT sample, sum(counts) AS total FROM p GROUP BY sample), e AS (SELECT bin, median(counts / total) AS m, avg((counts > 0)::INTEGER) AS nz FROM p JOIN t USING (sample) GROUP BY bin)
    SELECT bin, round(m, 8) AS median, m > 0.25 * (SELECT median(m) FROM e) AND nz > 0.97 AND m <> 0 AS keeps FROM e""")
def panel_interval_filter(spark, d):
    return L.panel_intervals(panel(spark, d), ["bin"], "sample", "counts").withColumn("median", F.round("median", 8))


@query(f"WITH {PANEL}, s AS (SELECT sample, counts * CASE WHEN sample = 2 THEN 9 WHEN sample = 5 THEN 0.1 ELSE 1 END AS counts FROM p), m AS (SELECT sample, avg(counts) AS mean FROM s GROUP BY sample) SELECT sample, round(mean, 6) AS mean, mean > 0.25 * (SELECT median(mean) FROM m) AND mean < 4 * (SELECT median(mean) FROM m) AS keeps FROM m")
def panel_sample_filter(spark, d):
    p = panel(spark, d).withColumn("counts", F.col("counts") * F.when(F.col("sample") == 2, 9.0).when(F.col("sample") == 5, 0.1).otherwise(1.0))
    return L.panel_samples(p, "sample", "counts").withColumn("mean", F.round("mean", 6))


@query(f"WITH {COV}, i AS (SELECT contig, bin, bin * 100 AS start, bin * 100 + 60 + contig % 60 AS stop, tumor AS panel, normal AS coverage FROM cov) SELECT contig, bin FROM i WHERE stop - start >= 80 AND panel >= 1 AND least(panel, coverage) >= 1")
def panel_and_sample_filter(spark, d):
    i = cov(spark, d).select("contig", "bin", (F.col("bin") * 100).alias("start"), (F.col("bin") * 100 + 60 + F.col("contig") % 60).alias("stop"), F.col("tumor").alias("panel"), F.col("normal").alias("coverage"))
    return L.panel_and_sample(i, 80, 1, 1).select("contig", "bin")


SITES = """s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 5 > 0 AS snp, l_returnflag = 'A' AS passed, l_linestatus = 'F' AS phased, l_quantity AS depth, l_discount * 10 AS baf, l_suppkey % 4 AS tumor FROM lineitem)"""


def sites(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 5 > 0).alias("snp"), (F.col("l_returnflag") == "A").alias("passed"), (F.col("l_linestatus") == "F").alias("phased"), F.col("l_quantity").alias("depth"), (F.col("l_discount") * 10).alias("baf"), (F.col("l_suppkey") % 4).alias("tumor"))


@query(f"WITH {SITES} SELECT id, snp AND passed AND NOT phased AND depth >= 10 AND baf > 0.15 AND baf < 0.85 AS single, snp AND NOT passed AND depth >= 10 AND baf BETWEEN 0.15 AND 0.85 AND tumor > 0 AS paired FROM s")
def baf_sites(spark, d):
    c = F.col
    return sites(spark, d).select("id", L.single_sample_site(c("snp"), c("passed"), c("phased"), c("depth"), c("baf"), 10, 0.15, 0.85).alias("single"), L.paired_site(c("snp"), c("passed"), c("depth"), c("baf"), c("tumor"), 10, 0.15, 0.85).alias("paired"))


@query(f"WITH {SITES} SELECT count(*) FILTER (passed) = 0 OR avg((baf BETWEEN 0.3 AND 0.7)::INTEGER) >= 0.5 AS sufficient FROM s")
def pair_sufficiency(spark, d):
    return L.pair_is_sufficient(sites(spark, d), F.col("passed"), F.col("baf").between(0.3, 0.7))


SEGS = """g AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' ELSE 'chr1' END AS contig, c_custkey % 4 < 2 AS allo, c_custkey % 3 = 0 AND c_custkey % 4 < 2 AS par, CASE c_nationkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS sex, c_acctbal / 5000 AS lr, c_custkey % 29 AS n, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 23 END AS snps FROM customer)"""


def segs(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    return table(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, "chrX").when(k % 4 == 1, "chrY").otherwise("chr1").alias("contig"), (k % 4 < 2).alias("allo"), ((k % 3 == 0) & (k % 4 < 2)).alias("par"), F.when(n == 0, "male").when(n == 1, "female").otherwise("unknown").alias("sex"), (F.col("c_acctbal") / 5000).alias("lr"), (k % 29).alias("n"), F.when(k % 7 > 0, k % 23).alias("snps"))


@query(f"""WITH {SEGS} SELECT id, (sex = 'unknown' AND allo) OR (sex = 'female' AND contig = 'chrY') OR (sex = 'male' AND contig = 'chrY' AND par) AS skip_germline, (sex = 'unknown' AND allo) OR (sex = 'female' AND contig = 'chrY') OR (sex = 'male' AND allo AND NOT par) AS skip_somatic,
    allo AND NOT par AND sex = 'male' AS haploid, lr > 0.9 OR n < 11 OR coalesce(snps < 11, true) AS skip_grid FROM g""")
def segment_skips(spark, d):
    c = F.col
    s = segs(spark, d)
    return s.select("id", L.skip_by_sex(c("contig"), c("allo"), c("par"), "germline", c("sex")).alias("skip_germline"), L.skip_by_sex(c("contig"), c("allo"), c("par"), "somatic", c("sex")).alias("skip_somatic"), L.expect_haploid(c("allo"), c("par"), "germline", c("sex")).alias("haploid"), L.skip_for_grid(c("lr"), c("n"), c("snps")).alias("skip_grid"))


@query(f"""WITH {READS}, {REGIONS}, s AS (SELECT contig, start, stop + 200 AS stop FROM regions), w AS (SELECT DISTINCT contig, start // 30 * 30 AS start, start // 30 * 30 + 30 AS stop FROM reads), c AS (SELECT s.contig, s.start, s.stop, sum(least(s.stop, w.stop) - greatest(s.start, w.start)) AS n FROM s JOIN w ON s.contig = w.contig AND s.start < w.stop AND s.stop > w.start GROUP BY ALL)
    SELECT s.contig, s.start, s.stop, coalesce(n, 0) >= 0.5 * (s.stop - s.start) AS dense FROM s LEFT JOIN c USING (contig, start, stop)""")
def dense_segments(spark, d):
    s = regions(spark, d).withColumn("stop", F.col("stop") + 200)
    w = reads(spark, d).select("contig", (F.floor(F.col("start") / 30) * 30).alias("start")).distinct().withColumn("stop", F.col("start") + 30)
    return L.dense_segments(s, w)


@query(f"WITH {COV} SELECT round(median(counts), 6) AS median, round(100 * avg((counts < 3)::INTEGER), 6) AS percent_low, median(counts) >= 3 AS enough FROM cov")
def low_coverage_guard(spark, d):
    out = L.coverage_check(cov(spark, d), "counts", 3)
    return out.withColumns({"median": F.round("median", 6), "percent_low": F.round("percent_low", 6)})


def _all(rules):
    return "coalesce(nullif(concat_ws(';', " + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in rules) + "), ''), 'PASS')"


PHASED = _all([("blocklisted", "l_partkey % 17 = 0"), ("min_alt_counts", "l_quantity < 8"), ("base_quality", "l_suppkey % 40 < 10"), ("map_quality", "l_linenumber < 2"), ("allele_fraction", "l_discount < 0.02 OR l_discount > 0.08")])


@query(f"SELECT {PHASED} AS failures, count(*) AS n FROM lineitem GROUP BY 1")
def phased_filter(spark, d):
    c = F.col
    f = L.phased_failures(c("l_partkey") % 17 == 0, c("l_quantity"), c("l_discount"), c("l_linenumber"), c("l_suppkey") % 40, 8, 10, 2, 0.02, 0.08)
    return table(spark, d, "lineitem").groupBy(f.alias("failures")).agg(F.count("*").alias("n"))


TE = _all([("map_quality", "l_linenumber < 2"), ("base_quality", "l_suppkey % 40 < 10"), ("weighted_counts", "l_quantity < CASE WHEN l_partkey % 9 = 0 THEN 4 ELSE 6 + l_linenumber END"), ("ml_score", "l_tax < 0.02"), ("blocklisted", "l_partkey % 17 = 0"), ("allele_fraction", "l_discount < 0.03")])


@query(f"SELECT {TE} AS failures, count(*) AS n FROM lineitem GROUP BY 1")
def enrichment_variant_filter(spark, d):
    c = F.col
    f = L.variant_failures(c("l_linenumber"), c("l_suppkey") % 40, c("l_quantity"), 6 + c("l_linenumber"), c("l_partkey") % 9 == 0, 4, c("l_tax"), c("l_partkey") % 17 == 0, c("l_discount"), 2, 10, 0.02, 0.03)
    return table(spark, d, "lineitem").groupBy(f.alias("failures")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN l_quantity < 5 THEN 'tumor_support' WHEN l_linenumber > 5 THEN 'normal_support' WHEN l_discount < 0.02 THEN 'tumor_af' WHEN (l_quantity / 20) / nullif((l_suppkey % 30) / 15.0, 0) NOT BETWEEN 0.5 AND 3 THEN 'dp_ratio' ELSE 'PASS' END AS filter, count(*) AS n FROM lineitem GROUP BY 1""")
def somatic_hard_filters(spark, d):
    c = F.col
    f = L.somatic_failure(c("l_quantity"), c("l_linenumber"), c("l_discount"), c("l_quantity"), (c("l_suppkey") % 30).cast("double"), F.lit(20.0), F.lit(15.0), 5, 5, 0.02, (0.5, 3.0))
    return table(spark, d, "lineitem").groupBy(f.alias("filter")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_suppkey % 10 AS sample, l_discount AS vaf, l_quantity AS dp, l_tax AS other, CASE WHEN l_quantity < 5 THEN 'low_depth' WHEN l_tax > 0.06 THEN 'other_alts' WHEN l_discount > 0.08 THEN 'high_vaf' WHEN l_partkey % 17 = 0 THEN 'blocklisted' ELSE 'pass' END AS status FROM lineitem)
    SELECT sample, status, count(*) AS sites, round(2 * avg(greatest(vaf * dp - other * dp / 2, 0) / dp), 6) AS fraction FROM f GROUP BY sample, status""")
def tumor_fraction(spark, d):
    """Per status so that each filter shows; the tumor fraction is that of the passing sites."""
    from plexframe.operators.variants import tumor_fraction as fraction

    c = F.col
    status = L.fraction_status(low_depth=c("l_quantity") < 5, other_alts=c("l_tax") > 0.06, high_vaf=c("l_discount") > 0.08, blocklisted=c("l_partkey") % 17 == 0)
    s = table(spark, d, "lineitem").select((c("l_suppkey") % 10).alias("sample"), status.alias("status"), (c("l_discount") * c("l_quantity")).alias("alt"), (c("l_tax") * c("l_quantity")).alias("other"), c("l_quantity").alias("depth"))
    return fraction(s, ["sample", "status"]).withColumn("fraction", F.round("fraction", 6))


@query(f"""WITH {READS}, {REGIONS} SELECT g.contig, g.start, g.stop FROM regions g WHERE NOT (g.contig % 5 = 0 AND g.start < 900 AND g.stop > 300)""")
def par_removal(spark, d):
    pars = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("contig"), F.lit(300).cast("long").alias("start"), F.lit(900).cast("long").alias("stop"))
    return L.without_pars(regions(spark, d), pars)


@query("WITH s AS (SELECT user_id, event_id AS place, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, coalesce(min((before <= value)::INTEGER), 1) = 1 AS sorted FROM s GROUP BY user_id")
def sortedness(spark, d):
    return L.is_sorted(table(spark, d, "events").select("user_id", F.col("event_id").alias("place"), "value"), ["user_id"], "value")


@query("SELECT (l_quantity > 10) AS assigned, (l_tax > 0.05) AS failed, count(*) FILTER (l_quantity <= 10 OR l_tax > 0.05) AS strict, count(*) FILTER (l_tax > 0.05) AS with_unassigned FROM lineitem GROUP BY 1, 2")
def demux_skip_rule(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_quantity") > 10).alias("assigned"), (F.col("l_tax") > 0.05).alias("failed"))
    n = lambda a, b: F.sum(L.skip_record(F.col("assigned"), F.col("failed"), a, b).cast("int"))
    return r.groupBy("assigned", "failed").agg(n(False, False).alias("strict"), n(True, False).alias("with_unassigned"))


@query(f"""WITH {REGIONS}, l AS (SELECT s_suppkey AS contig FROM supplier), o AS (SELECT contig, k AS rank FROM (SELECT contig, row_number() OVER (ORDER BY contig DESC) AS k FROM l) WHERE k <= 5), u AS (SELECT contig, 5 + row_number() OVER (ORDER BY contig) AS rank FROM l WHERE contig NOT IN (SELECT contig FROM o))
    SELECT g.contig, g.start, r.rank FROM regions g JOIN (FROM o UNION ALL FROM u) r USING (contig)""")
def genome_order(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("contig"))
    top = s.orderBy(F.desc("contig")).limit(5)
    order = top.select("contig", (F.lit(s.agg(F.max("contig")).first()[0]) - F.col("contig") + 1).alias("rank"))
    return I.contig_rank(regions(spark, d), order).select("contig", "start", "rank")
