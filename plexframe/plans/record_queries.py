"""Record, feature, copy-number pipeline and function queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plexframe.functions import numbers as N, sequences as S
from plexframe.operators import copynumber as CN, records as R, reads as RD
from plexframe.plans.copy_queries import COV, LOGPDF, LOGR, SEG, cov, seg
from plexframe.plans.demux_queries import PARTS, parts
from plexframe.plans.views import READS, REGIONS, SIGNAL, query, reads, regions, signal, table
from plexframe.session import dealt

FLAGGED = f"{READS}, f AS (SELECT *, (CASE cls WHEN 'A' THEN 256 WHEN 'R' THEN 2048 ELSE 0 END) | (CASE WHEN errors = 8 THEN 4 ELSE 0 END) | (CASE WHEN mapq > 5 THEN 1024 ELSE 0 END) AS flag FROM reads)"


def flagged(spark, d):
    f = F.when(F.col("cls") == "A", 256).when(F.col("cls") == "R", 2048).otherwise(0)
    return reads(spark, d).withColumn("flag", f.bitwiseOR(F.when(F.col("errors") == 8, 4).otherwise(0)).bitwiseOR(F.when(F.col("mapq") > 5, 1024).otherwise(0)))


@query(f"WITH {READS}, {REGIONS} SELECT r.read_id, r.contig, r.start FROM reads r WHERE EXISTS (SELECT 1 FROM regions g WHERE g.contig = r.contig AND r.start < g.stop AND r.stop > g.start)")
def reads_in_regions(spark, d):
    return R.in_regions(reads(spark, d), regions(spark, d)).select("read_id", "contig", "start")


@query(f"WITH {FLAGGED}, p AS (SELECT DISTINCT molecule FROM f WHERE flag & 2304 = 0 AND flag & 1024 > 0) SELECT read_id, CASE WHEN flag & 2048 > 0 AND molecule IN (SELECT molecule FROM p) THEN flag | 1024 ELSE flag END::BIGINT AS flag FROM f")
def supplementary_duplicates(spark, d):
    return R.propagate_duplicates(flagged(spark, d), "molecule").select("read_id", F.col("flag").cast("long").alias("flag"))


@query(f"""WITH {FLAGGED}, lost AS (SELECT DISTINCT molecule FROM f WHERE flag & 2304 = 0 AND flag & 4 > 0), g AS (SELECT molecule, min(read_id) AS read_id FROM f WHERE flag & 256 > 0 AND flag & 4 = 0 AND stop > start AND mapq / (stop - start) >= 0.05 AND molecule IN (SELECT molecule FROM lost) GROUP BY molecule)
    SELECT read_id, flag::BIGINT AS flag, false AS rescued FROM f WHERE flag & 256 = 0 UNION ALL SELECT f.read_id, flag::BIGINT, true FROM f JOIN g USING (molecule, read_id) WHERE flag & 256 > 0""")
def secondary_rescue(spark, d):
    r = flagged(spark, d).withColumns({"score": F.col("mapq"), "length": F.col("stop") - F.col("start")})
    return R.rescue_secondaries(r, "read_id", "molecule", least=0.05).select("read_id", F.col("flag").cast("long").alias("flag"), "rescued")


@query("SELECT l_orderkey * 10 + l_linenumber AS read_id, s_nationkey AS sample FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 4 > 0")
def read_group_samples(spark, d):
    groups = table(spark, d, "supplier").where("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("rg"), F.col("s_nationkey").alias("sample"))
    r = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.col("l_suppkey").alias("rg"))
    return R.samples_of_groups(r, groups).select("read_id", "sample")


@query(f"WITH {READS}, r AS (SELECT *, CASE WHEN errors = 8 THEN NULL ELSE contig END AS place FROM reads) SELECT count(*) AS reads, sum(stop - start)::BIGINT AS bases, count(*) FILTER (place IS NOT NULL AND mapq > 3) AS placed FROM r")
def unplaced_reads(spark, d):
    r = reads(spark, d).withColumn("contig", F.when(F.col("errors") < 8, F.col("contig")))
    bases = F.col("stop") - F.col("start")
    placed = r.where("contig IS NOT NULL").agg(F.count("*").alias("reads"), F.sum(bases).alias("bases"), RD.count_if(F.col("mapq") > 3).alias("placed"))
    return R.with_unplaced(placed, r, {"reads": F.lit(1), "bases": bases})


@query(f"WITH {READS}, b AS (SELECT *, read_id = first_value(read_id) OVER (PARTITION BY molecule ORDER BY mapq DESC, read_id) AS best, count(*) OVER (PARTITION BY molecule) AS n FROM reads) SELECT read_id, CASE WHEN best OR molecule % 7 = 0 THEN 0 ELSE 1024 END::BIGINT AS flag, CASE WHEN molecule % 7 > 0 THEN n END AS cluster_size FROM b")
def duplicate_marking(spark, d):
    r = reads(spark, d)
    best = r.groupBy("molecule").agg(F.min_by("read_id", F.struct(-F.col("mapq"), "read_id")).alias("best_id"))
    r = r.join(best, "molecule").select("read_id", F.when(F.col("molecule") % 7 > 0, F.col("molecule")).alias("cluster"), (F.col("read_id") == F.col("best_id")).alias("best"), F.lit(0).cast("long").alias("flag"))
    return R.mark_duplicates(r, ["cluster"], "best").select("read_id", "flag", "cluster_size")


@query("""WITH v AS (SELECT DISTINCT l_partkey AS pos, l_returnflag AS alt FROM lineitem), f AS (SELECT l_partkey AS pos, l_returnflag AS alt, count(*) AS support FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL), r AS (SELECT l_partkey AS pos, count(*) AS ref_support FROM lineitem WHERE l_linenumber < 2 GROUP BY ALL)
    SELECT pos, alt, support, ref_support, support IS NULL OR ref_support IS NULL AS missing FROM v LEFT JOIN f USING (pos, alt) LEFT JOIN r USING (pos)""")
def feature_lookup(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("alt"), "l_linenumber")
    f = t.where("l_linenumber > 2").groupBy("pos", "alt").agg(F.count("*").alias("support"))
    r = t.where("l_linenumber < 2").groupBy("pos").agg(F.count("*").alias("ref_support"))
    return R.attach_features(t.select("pos", "alt").distinct(), f, r, ["pos", "alt"], ["pos"], ["support", "ref_support"])


@query(f"""WITH {READS}, s AS (SELECT part, count(*) FILTER (cls = 'N') AS support, count(*) FILTER (cls = 'N' AND mapq < 4) AS low_count, coalesce(sum(mapq) FILTER (cls = 'N'), 0) AS mapq_sum, coalesce(sum(mapq) FILTER (cls = 'N' AND errors > 2), 0) AS nonhp_sum FROM reads GROUP BY part)
    SELECT part, support, round(low_count / nullif(support, 0), 6) AS low_ratio, round(mapq_sum / nullif(support, 0), 6) AS mapq_mean, round(nonhp_sum / nullif(support, 0), 6) AS nonhp_mean FROM s""")
def reference_features(spark, d):
    own = F.col("cls") == "N"
    s = reads(spark, d).groupBy("part").agg(RD.count_if(own).alias("support"), RD.count_if(own & (F.col("mapq") < 4)).alias("low_count"), F.sum(F.when(own, F.col("mapq")).otherwise(0)).alias("mapq_sum"), F.sum(F.when(own & (F.col("errors") > 2), F.col("mapq")).otherwise(0)).alias("nonhp_sum"))
    out = R.derived_features(s, ["low"], ["mapq", "nonhp"])
    return out.select("part", "support", *[F.round(c, 6).alias(c) for c in ("low_ratio", "mapq_mean", "nonhp_mean")])


@query(f"""WITH {READS}, v AS (SELECT part, cls, count(*) AS support FROM reads WHERE cls <> 'N' GROUP BY ALL), r AS (SELECT part, count(*) AS ref FROM reads WHERE cls = 'N' GROUP BY ALL), t AS (SELECT part, sum(support) AS total FROM v GROUP BY part)
    SELECT part, cls, support, (total + coalesce(ref, 0))::BIGINT AS dp, round(support / (total + coalesce(ref, 0)), 6) AS af, round(abs(support - coalesce(ref, 0)) / (support + coalesce(ref, 0)), 6) AS adt, round(log10(support + coalesce(ref, 0)) * abs(support - coalesce(ref, 0)) / (support + coalesce(ref, 0)), 6) AS adtl FROM v JOIN t USING (part) LEFT JOIN r USING (part)""")
def allele_depth_shares(spark, d):
    r = reads(spark, d)
    v = r.where("cls <> 'N'").groupBy("part", "cls").agg(F.count("*").alias("support"))
    ref = r.where("cls = 'N'").groupBy("part").agg(F.count("*").alias("ref"))
    out = R.allele_shares(v, ref, ["part"], "support", "ref")
    return out.select("part", "cls", "support", "dp", *[F.round(c, 6).alias(c) for c in ("af", "adt", "adtl")])


@query(f"WITH {READS}, m AS (SELECT strand, contig, median(errors) AS m FROM reads GROUP BY ALL) SELECT strand, round(median(m), 6) AS median, round(sum(m), 6) AS total FROM m WHERE m > 0 GROUP BY strand")
def median_of_medians(spark, d):
    out = R.median_depths(reads(spark, d), ["strand"], "contig", "errors")
    return out.select("strand", F.round("median", 6).alias("median"), F.round("total", 6).alias("total"))


@query(f"WITH {READS}, c AS (SELECT contig, start AS pos, max(stop) AS stop, max(CASE WHEN cls = 'A' THEN stop END) AS reach FROM reads GROUP BY ALL) SELECT contig, pos, coalesce(max(reach) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= pos, false) AS beneath FROM c")
def deletion_spans(spark, d):
    c = reads(spark, d).groupBy("contig", F.col("start").alias("pos")).agg(F.max(F.when(F.col("cls") == "A", F.col("stop"))).alias("reach"))
    return R.deletion_span(c, ["contig"], "pos", "reach", F.col("reach").isNotNull()).select("contig", "pos", "beneath")


@query("""WITH r AS (SELECT l_partkey AS pos, l_linestatus AS alt, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS label, l_orderkey * 10 + l_linenumber AS id FROM lineitem), n AS (SELECT label, count(*) AS n FROM r GROUP BY label), m AS (SELECT label FROM n WHERE n > (SELECT sum(n) // count(*) FROM n))
    SELECT pos, alt, label, id FROM r WHERE label NOT IN (SELECT label FROM m) UNION ALL SELECT pos, alt, label, CASE WHEN pos % 2 = 0 THEN max(id) ELSE min(id) END FROM r WHERE label IN (SELECT label FROM m) GROUP BY pos, alt, label""")
def training_downsampling(spark, d):
    t = table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    r = t.select(F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("alt"), label.alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return R.training_rows(r, ["pos", "alt"], "label", "pos", "id")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag <> 'R' AND l_discount >= 0.03 THEN CASE l_returnflag WHEN 'A' THEN '0/1' ELSE '1/1' END ELSE '0/0' END AS tagged FROM lineitem")
def germline_tagging(spark, d):
    gt = F.when(F.col("l_returnflag") == "A", "0/1").when(F.col("l_returnflag") == "N", "1/1").otherwise("0/0")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), R.germline_tag(gt, F.col("l_discount"), 0.03).alias("tagged"))


@query("""WITH r AS (SELECT CASE WHEN l_partkey % 11 = 0 THEN '*' WHEN l_partkey % 7 = 0 THEN 'A' || repeat('C', 60) ELSE 'T' END AS alt, l_linenumber = 7 AS missing, CASE WHEN l_quantity < 5 THEN 'tumor_support' ELSE 'PASS' END AS hard, CASE WHEN l_suppkey % 6 > 0 THEN l_tax END AS score FROM lineitem)
    SELECT CASE WHEN alt = '*' THEN 'unsupported_allele' WHEN length(alt) - 1 > 50 THEN 'indel_length' WHEN missing THEN 'missing_feature' WHEN hard <> 'PASS' THEN hard WHEN coalesce(score, 0) < 0.03 THEN 'low_score' ELSE 'PASS' END AS filter, count(*) AS n FROM r GROUP BY 1""")
def somatic_records(spark, d):
    c = F.col
    alt = F.when(c("l_partkey") % 11 == 0, "*").when(c("l_partkey") % 7 == 0, F.concat(F.lit("A"), F.repeat(F.lit("C"), 60))).otherwise("T")
    f = R.somatic_result(alt, F.lit("A"), c("l_linenumber") == 7, F.when(c("l_quantity") < 5, "tumor_support").otherwise("PASS"), F.when(c("l_suppkey") % 6 > 0, c("l_tax")), 0.03)
    return table(spark, d, "lineitem").groupBy(f.alias("filter")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS contig, l_partkey AS pos FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT DISTINCT l_suppkey AS contig, l_partkey AS pos FROM lineitem WHERE l_partkey % 5 = 0), x AS (SELECT DISTINCT l_suppkey AS contig, l_partkey AS pos FROM lineitem WHERE l_quantity > 20)
    SELECT contig, pos, false AS forced FROM r UNION ALL SELECT contig, pos, true FROM f WHERE (contig, pos) IN (SELECT (contig, pos) FROM x) AND (contig, pos) NOT IN (SELECT (contig, pos) FROM r)""")
def forced_calls(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), "l_returnflag", "l_quantity")
    pick = lambda cond: t.where(cond).select("contig", "pos").distinct()
    return R.with_forced_calls(pick("l_returnflag = 'A'"), pick("pos % 5 = 0"), pick("l_quantity > 20"), ["contig", "pos"])


@query("""WITH e AS (SELECT event_id, event_id % 3 AS best, [[value, 1.0, 0.5], [2.0, value / 2, 0.25], [value * 2, 3.0, 0.125]] AS c FROM events) SELECT event_id, unnest(['a', 'b', 'bias']) AS feature, round(unnest(c[best + 1]), 6) AS value FROM e""")
def contribution_rows(spark, d):
    v = F.col("value")
    rows = F.array(F.array(v, F.lit(1.0), F.lit(0.5)), F.array(F.lit(2.0), v / 2, F.lit(0.25)), F.array(v * 2, F.lit(3.0), F.lit(0.125)))
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("best"), rows.alias("c"))
    return R.contribution_rows(e, ["event_id"], "best", "c", ["a", "b"]).withColumn("value", F.round("value", 6))


@query("""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS base, l_linenumber AS qual, CASE WHEN l_partkey % 3 = 0 THEN 'A' ELSE 'N' END AS r2, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'N' END AS graph, l_partkey % 10 = 0 AS excluded FROM lineitem), s AS (SELECT *, base <> graph AND r2 = graph AND NOT excluded AS switched FROM b)
    SELECT id, CASE WHEN switched THEN graph ELSE base END AS base, CASE WHEN switched THEN 22 ELSE qual END::INTEGER AS qual, switched FROM s""")
def graph_base_repick(spark, d):
    c = F.col
    b = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_returnflag").alias("base"), c("l_linenumber").alias("qual"), F.when(c("l_partkey") % 3 == 0, "A").otherwise("N").alias("r2"), F.when(c("l_suppkey") % 2 == 0, "A").otherwise("N").alias("graph"), (c("l_partkey") % 10 == 0).alias("excluded"))
    return R.repick(b).select("id", "base", F.col("qual").cast("int").alias("qual"), "switched")


@query(f"WITH {READS}, {REGIONS} SELECT r.read_id, g.start // 90 AS located FROM reads r LEFT JOIN regions g ON r.contig = g.contig AND r.start >= g.start AND r.start < g.stop")
def interval_location(spark, d):
    g = regions(spark, d).withColumn("number", F.floor(F.col("start") / 90))
    return R.locate(reads(spark, d).select("read_id", "contig", F.col("start").alias("pos")), g).select("read_id", "located")


@query("""WITH s AS (SELECT event_id AS pos, user_id AS contig, event_type AS ref, event_id % 4 AS context FROM events WHERE event_id % 97 = 0), k AS (SELECT DISTINCT ref, context FROM s), c AS (SELECT event_id AS pos, user_id % 20 AS contig, event_type AS ref, event_id % 4 AS context FROM events), t AS (SELECT contig % 20 AS contig, pos FROM s)
    SELECT contig, pos, ref, context FROM c WHERE (ref, context) IN (SELECT (ref, context) FROM k) AND NOT EXISTS (SELECT 1 FROM t WHERE t.contig = c.contig AND abs(t.pos - c.pos) < 200) ORDER BY md5(concat_ws(':', contig, pos)), contig, pos LIMIT 500""")
def noise_probes(spark, d):
    e = table(spark, d, "events")
    make = lambda contig: e.select(F.col("event_id").alias("pos"), contig.alias("contig"), F.col("event_type").alias("ref"), (F.col("event_id") % 4).alias("context"))
    sites = make(F.col("user_id") % 20).where("pos % 97 = 0")
    return R.probe_sites(sites, make(F.col("user_id") % 20), 200, 500).select("contig", "pos", "ref", "context")


# Functions.


@query("SELECT event_id, round(CASE WHEN p >= 1 THEN 255 WHEN p <= 0 THEN 0 ELSE least(255, -10 * log10(1 - p)) END)::INTEGER AS gq, round(CASE WHEN q >= 1 THEN 255 WHEN q <= 0 THEN 0 ELSE least(255, -10 * log10(1 - q)) END, 2) + 0.0 AS qual FROM (SELECT event_id, (event_id % 103) / 101.0 AS p, greatest((event_id % 7) / 20.0, 0) + greatest((event_id % 11 - 3) / 20.0, 0) AS q FROM events)")
def call_qualities(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 103) / 101.0).alias("p"), F.lit(0.5).alias("p0"), ((F.col("event_id") % 7) / 20.0).alias("p1"), ((F.col("event_id") % 11 - 3) / 20.0).alias("p2"))
    return e.select("event_id", N.genotype_quality("p").alias("gq"), N.variant_quality(["p0", "p1", "p2"]).alias("qual"))


PAIRS = "[a || b FOR a IN ['A','C','G','T'] FOR b IN ['A','C','G','T']]"


@query(f"""WITH {PARTS}, p AS (SELECT id, seq, (id % 18 - 1) AS pos FROM parts), c AS (SELECT *, CASE WHEN pos > 0 AND pos + 1 < length(seq) THEN substring(seq, pos, 1) || substring(seq, pos + 2, 1) ELSE '' END AS context FROM p)
    SELECT id, pos, context, CASE WHEN context = '' THEN 17 ELSE 1 + 4 * (position(substring(context, 1, 1) IN 'ACGT') - 1) + position(substring(context, 2, 1) IN 'ACGT') - 1 END::INTEGER AS idx, greatest(pos - 3, 0) AS lo, least(pos + 4, length(seq)) AS hi FROM c""")
def contexts(spark, d):
    p = parts(spark, d).select("id", "seq", (F.col("id") % 18 - 1).alias("pos")).withColumn("context", S.context("seq", F.col("pos").cast("int")))
    b = N.window_bounds("pos", F.length("seq"), 3)
    return p.select("id", "pos", "context", S.context_index("context").alias("idx"), b["start"].alias("lo"), b["stop"].cast("long").alias("hi"))


@query(f"""WITH {PARTS}, p AS (SELECT id, seq, i, substring(seq, i, 1) AS b FROM parts, range(1, 17) AS t(i)), f AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY id ORDER BY i) = b THEN 0 ELSE 1 END AS f FROM p), r AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY i) AS run FROM f), s AS (SELECT *, min(i) OVER (PARTITION BY id, run) - 1 AS start, count(*) OVER (PARTITION BY id, run) AS n FROM r)
    SELECT id, (id % 16)::INTEGER AS pos, CASE WHEN n >= 2 THEN start END::INTEGER AS start FROM s WHERE i = id % 16 + 1""")
def homopolymer_at_position(spark, d):
    p = parts(spark, d).select("id", "seq", (F.col("id") % 16).cast("int").alias("pos"))
    return p.select("id", "pos", S.homopolymer_over("seq", "pos", 2).alias("start"))


@query(f"WITH {PARTS} SELECT id, 1.0 * (id % 9) AS number, (id % 2 = 0)::INTEGER::DOUBLE AS flag, CASE id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 END AS genotype, length(seq)::DOUBLE AS size, list_reduce(list_transform(string_split(substring(seq, 1, 6), ''), lambda c: (position(c IN 'ACGT') - 1)::DOUBLE), lambda a, x: a * 4 + x) AS bits FROM parts")
def numeric_features(spark, d):
    gt = F.element_at(F.array(*map(F.lit, ("0/0", "0|1", "1/1", "2/1", "./."))), (F.col("id") % 5 + 1).cast("int"))
    p = parts(spark, d)
    return p.select("id", S.numeric(F.col("id") % 9, "number").alias("number"), S.numeric(F.col("id") % 2 == 0, "boolean").alias("flag"), S.numeric(gt, "genotype").alias("genotype"), S.numeric("seq", "length").alias("size"), S.numeric(F.substring("seq", 1, 6), "sequence").alias("bits"))


_DIGIT = "substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+_', ((n >> {}) & 63)::INTEGER + 1, 1)"


@query("SELECT event_id, " + " || ".join(_DIGIT.format(6 * k) for k in range(5, -1, -1)) + " AS digits FROM (SELECT event_id, event_id * 4294967 % 4294967296 AS n FROM events)")
def compact_identifiers(spark, d):
    return table(spark, d, "events").select("event_id", N.base64_of((F.col("event_id") * 4294967) % 4294967296).alias("digits"))


@query("""WITH b AS (SELECT event_id, event_id * 2654435761 % 4294967296 AS n, event_id % 17 AS len FROM events)
    SELECT event_id, substring(array_to_string(list_transform(range(15, -1, -1), lambda k: substring('ACGT', ((n >> (2 * k)) & 3)::INTEGER + 1, 1)), ''), 1, len::INTEGER) AS bases, substring(array_to_string(list_transform(range(15, -1, -1), lambda k: substring('+5?I', ((n >> (2 * k)) & 3)::INTEGER + 1, 1)), ''), 1, len::INTEGER) AS quals FROM b""")
def packed_reads(spark, d):
    n = (F.col("event_id") * 2654435761) % 4294967296
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 17).alias("len"), F.unhex(F.lpad(F.hex(n), 8, "0")).alias("packed"))
    return e.select("event_id", S.unpacked_bases("packed", "len").alias("bases"), S.unpacked_qualities("packed", "len").alias("quals"))


# Copy-number pipeline.


@query(f"WITH {COV} SELECT contig, bin, tumor::DOUBLE AS tumor, normal::DOUBLE AS normal FROM cov")
def aligned_coverage(spark, d):
    c = cov(spark, d)
    pick = lambda x: c.select("contig", "bin", F.col(x).cast("double").alias("v"))
    return CN.aligned_coverage(pick("tumor"), pick("normal"), ["contig", "bin"], "v").select("contig", "bin", "tumor", "normal")


@query(f"""WITH {REGIONS}, s AS (SELECT contig, start, stop, lag(stop) OVER w AS b, lead(start) OVER w AS a FROM regions WINDOW w AS (PARTITION BY contig ORDER BY start)) SELECT contig, coalesce(b + (start - b) // 2, start) AS start, coalesce(stop + (a - stop) // 2, stop) AS stop FROM s""")
def breakpoint_midpoints(spark, d):
    return CN.midpoints(regions(spark, d))


@query(f"""WITH {SEG}, p AS (SELECT unnest({CN.grid_axis(CN.PURITY_GRID)}::DOUBLE[]) AS purity), q AS (SELECT unnest({CN.grid_axis(CN.PLOIDY_GRID)}::DOUBLE[]) AS ploidy), g AS (SELECT purity, ploidy FROM p, q),
    s AS (SELECT contig, mean_log_ratio, CASE WHEN contig % 6 > 0 THEN baf / 4 END AS mbaf FROM seg WHERE contig % 8 = 0), l AS (SELECT purity, ploidy, contig, mbaf, k, {LOGPDF("mean_log_ratio", LOGR("k", "purity", "ploidy"), "0.3")} + ln(CASE WHEN k = 2 THEN 2.0 ELSE 1.0 END / 9) AS l FROM s, g, range(8) AS t(k)),
    b AS (SELECT purity, ploidy, contig, mbaf, max(l) AS l, arg_max(k, ROW(l, -k)) AS tcn FROM l GROUP BY ALL), m AS (SELECT purity, ploidy, contig, max({LOGPDF("mbaf", "((purity * k + (1 - purity)) / (purity * tcn + 2 * (1 - purity)))", "0.2")}) AS lb FROM b, range(4) AS t(k) WHERE 2 * k <= tcn AND mbaf IS NOT NULL GROUP BY ALL)
    SELECT purity, ploidy, round(sum(l), 4) AS logr, round(coalesce(sum(lb), 0), 4) AS baf, round(sum(l + coalesce(lb, 0)), 4) AS joint FROM b LEFT JOIN m USING (purity, ploidy, contig) GROUP BY purity, ploidy""")
def purity_ploidy_joint_grid(spark, d):
    """All 3,680 points of the grid, for a sample's segments (every eighth contig is one)."""
    s = seg(spark, d).where("contig % 8 = 0").withColumn("mbaf", F.when(F.col("contig") % 6 > 0, F.col("baf") / 4))
    g = CN.joint_grid(s, "mean_log_ratio", 0.3, "mbaf", 0.1, CN.grid_axis(CN.PURITY_GRID), CN.grid_axis(CN.PLOIDY_GRID))
    return g.select("purity", "ploidy", *[F.round(c, 4).alias(c) for c in ("logr", "baf", "joint")])


@query("SELECT (c_custkey % 80 * 0.01 + 0.15)::DOUBLE AS purity, round(c_custkey % 46 * 0.1 + 1.4, 6) AS ploidy, round(c_acctbal / 100)::BIGINT AS loglik FROM customer ORDER BY loglik DESC, ploidy, purity LIMIT 1")
def purity_grid_argmax(spark, d):
    g = table(spark, d, "customer").select((F.col("c_custkey") % 80 * F.lit(0.01) + F.lit(0.15)).alias("purity"), F.round(F.col("c_custkey") % 46 * F.lit(0.1) + F.lit(1.4), 6).alias("ploidy"), F.round(F.col("c_acctbal") / 100).cast("long").alias("loglik"))
    return CN.grid_best(g)


@query("""WITH s AS (SELECT l_suppkey AS segment, l_partkey AS site, count(*) FILTER (l_returnflag = 'A') AS alt, count(*) FILTER (l_returnflag <> 'A') AS ref FROM lineitem GROUP BY ALL)
    SELECT segment, round(sqrt(sum(sqrt(ref + alt) * power(least(ref, alt) / (ref + alt) - 0.1, 2)) / (sum(sqrt(ref + alt)) - 1)), 6) AS sd FROM s GROUP BY segment""")
def weighted_mirrored_sd(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("segment"), F.col("l_partkey").alias("site")).agg(n(F.col("l_returnflag") == "A").alias("alt"), n(F.col("l_returnflag") != "A").alias("ref")).withColumn("mean", F.lit(0.1))
    return CN.weighted_baf_sd(s, ["segment"], "ref", "alt", "mean").withColumn("sd", F.round("sd", 6))


@query("WITH s AS (SELECT event_id % 20 AS segment, stddev_samp(value) AS sd FROM events WHERE event_id % 20 > 1 GROUP BY 1) SELECT round(avg(sd), 6) AS sd FROM s")
def mean_segment_deviation(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 20).alias("segment"), "value")
    return CN.mean_segment_sd(e, ["segment"], "value", F.col("segment") > 1).withColumn("sd", F.round("sd", 6))


@query("""WITH g AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' ELSE 'chr1' END AS contig, c_custkey % 4 < 2 AS allosome, c_custkey % 3 = 0 AND c_custkey % 4 < 2 AS par FROM customer), k AS (
    SELECT 'unknown germline' AS kind, id FROM g WHERE NOT allosome UNION ALL SELECT 'female somatic', id FROM g WHERE contig <> 'chrY' UNION ALL SELECT 'male germline', id FROM g WHERE NOT (contig = 'chrY' AND par) UNION ALL SELECT 'male somatic', id FROM g WHERE NOT (allosome AND (contig = 'chrY' OR NOT par))) SELECT kind, id FROM k""")
def seed_segments(spark, d):
    k = F.col("c_custkey")
    g = table(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, "chrX").when(k % 4 == 1, "chrY").otherwise("chr1").alias("contig"), (k % 4 < 2).alias("allosome"), ((k % 3 == 0) & (k % 4 < 2)).alias("par"))
    out = None
    for sex, mode in (("unknown", "germline"), ("female", "somatic"), ("male", "germline"), ("male", "somatic")):
        own = CN.seeds(g, sex, mode).select(F.lit(f"{sex} {mode}").alias("kind"), "id")
        out = own if out is None else out.unionByName(own)
    return out


@query("WITH c AS (SELECT count(*) FILTER (l_suppkey % 30 > 0) AS x, count(*) FILTER (l_suppkey % 30 = 0) AS y FROM lineitem) SELECT x, y, CASE WHEN x / y > 25 THEN 'female' WHEN x / y > 20 THEN 'unknown' ELSE 'male' END AS sex FROM c")
def sex_from_index_counts(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.when(F.col("l_suppkey") % 30 > 0, "chrX").otherwise("chrY").alias("contig")).agg(F.count("*").alias("reads"))
    return CN.index_sex(c)


_STATUS = "(['gain','loss','cnLOH','gainLOH','ref'])[c_custkey % 5 + 1]"


@query(f"""WITH s AS (SELECT {_STATUS} AS status, CASE WHEN c_custkey % 3 = 0 THEN 'cnvLength' ELSE 'PASS' END AS filter FROM customer), k AS (SELECT unnest(['gain','loss','cnLOH','gainLOH']) AS k)
    SELECT 'segments' AS metric, count(*) AS value FROM s UNION ALL SELECT k, (SELECT count(*) FROM s WHERE status = k) FROM k UNION ALL SELECT 'passing ' || k, (SELECT count(*) FROM s WHERE status = k AND filter = 'PASS') FROM k""")
def call_metrics(spark, d):
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("gain", "loss", "cnLOH", "gainLOH", "ref"))), (k % 5 + 1).cast("int"))
    return CN.call_metrics(table(spark, d, "customer").select(status.alias("status"), F.when(k % 3 == 0, "cnvLength").otherwise("PASS").alias("filter")), True)


@query(f"""WITH {SEG}, c AS (SELECT contig, baf / 4 AS mbaf, greatest((power(2, mean_log_ratio) * (0.8 * 2.2 + 0.4) - 0.4) / 0.8, 0) AS copies, n FROM seg) SELECT contig FROM c WHERE contig % 9 > 0 AND n >= 5 AND n % 3 + 10 >= 5 AND contig % 7 > 0 AND copies BETWEEN 0.9 AND 1.1 AND mbaf < 0.45""")
def one_copy_candidates(spark, d):
    s = seg(spark, d).withColumns({"mbaf": F.col("baf") / 4, "snps": F.col("n") % 3 + 10, "dense": F.col("contig") % 7 > 0})
    return CN.deletion_candidates(s, F.col("contig") % 9 > 0, 0.8, 2.2, 5).select("contig")


@query()
def doubling_check(spark, d):
    """Per sample (contigs by their remainder) whether the candidates' fractions have two peaks; tested by its kernel."""
    s = seg(spark, d).select((F.col("contig") % 10).alias("sample"), "contig", (F.col("baf") / 4).alias("mbaf"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample": f["sample"].iloc[:1], "doubled": [CN.doubled(np.sort(f["mbaf"].to_numpy()), 0.8)]})

    return s.groupBy("sample").applyInPandas(run, "sample long, doubled boolean")


@query()
def two_round_segments(spark, d):
    """Log ratios by contig first, then the shifts inside each piece; random permutations, so tested on made signals."""
    s = signal(spark, d)
    out = CN.two_rounds(s, s.withColumn("value", F.abs(F.col("value") - 20)), ["contig"], "pos", "value")
    return out.withColumn("mean", F.round("mean", 6))


@query(f"""WITH len AS (SELECT s_suppkey AS contig FROM supplier), w AS (SELECT contig, k * 90 AS s FROM len, range(0, 44) AS t(k)), track AS (SELECT contig, s AS start, s + 90 AS stop, (s // 90 + contig) % 4 / 4.0 AS score, (s // 90 + 2 * contig) % 8 / 8.0 AS gc FROM w),
    p AS (SELECT contig, unnest(range(start, stop)) AS p, score, gc FROM track), b AS (SELECT * FROM p WHERE score > 0 AND NOT (contig % 3 = 0 AND p BETWEEN 500 AND 699)), i AS (SELECT *, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS isl FROM b),
    o AS (SELECT *, p - min(p) OVER (PARTITION BY contig, isl) AS off, min(p) OVER (PARTITION BY contig, isl) AS first FROM i), win AS (SELECT contig, first + off // 60 * 60 AS start, count(*) AS n, avg(score) AS m, avg(gc) AS gc FROM o GROUP BY ALL)
    SELECT contig, start::BIGINT AS start, (start + 60)::BIGINT AS stop, round(m, 6) AS mappability, round(gc, 6) AS gc FROM win WHERE n = 60 AND m >= CASE WHEN contig % 9 > 0 THEN 0.5 ELSE 0.9 END AND gc BETWEEN 0.15 AND 0.75""")
def genome_intervals(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("contig"))
    lengths = s.withColumn("length", F.lit(44 * 90))
    track = s.withColumn("k", F.explode(F.expr("sequence(0L, 43L)"))).select("contig", (F.col("k") * 90).alias("start"), (F.col("k") * 90 + 90).alias("stop"), ((F.col("k") + F.col("contig")) % 4 / 4.0).alias("score"), ((F.col("k") + 2 * F.col("contig")) % 8 / 8.0).alias("gc"))
    blocked = s.where("contig % 3 = 0").select("contig", F.lit(500).cast("long").alias("start"), F.lit(700).cast("long").alias("stop"))
    out = CN.genome_intervals(lengths, blocked, track, track, 60, F.col("contig") % 9 > 0, 0.5, 0.9)
    return out.withColumns({"mappability": F.round("mappability", 6), "gc": F.round("gc", 6)})


@query("""WITH o AS (SELECT 'a' AS part, event_id AS pos, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'b', event_id, value FROM events WHERE event_id % 3 = 0) SELECT part, count(*) AS n, round(sum(value), 4) AS total FROM o GROUP BY part""")
def union_of_observations(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), "value")
    both = e.where("pos % 2 = 0").withColumn("part", F.lit("a")).unionByName(e.where("pos % 3 = 0").withColumn("part", F.lit("b")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


from plexframe.plans.consensus_queries import CLUSTER, SEQ, cluster_table  # noqa: E402
from plexframe.plans.demux_queries import dna  # noqa: E402


@query(f"""WITH {CLUSTER}, t AS (SELECT DISTINCT l_orderkey AS cluster, ({SEQ}) || ({SEQ}) AS target FROM lineitem), r AS (SELECT rd.*, target, row_number() OVER () AS rid FROM rd JOIN t USING (cluster)), k AS (SELECT *, unnest(range(0, 16)) AS q FROM r),
    b AS (SELECT rid, cluster, read, q, CASE cigar WHEN '16M' THEN 0 WHEN '6M2I8M' THEN CASE WHEN q < 6 THEN 0 WHEN q < 8 THEN 1 ELSE 2 END ELSE CASE WHEN q < 5 THEN 0 ELSE 2 END END AS part, CASE cigar WHEN '16M' THEN start + q WHEN '6M2I8M' THEN CASE WHEN q < 6 THEN start + q ELSE start + q - 2 END ELSE CASE WHEN q < 5 THEN start + q ELSE start + q + 3 END END AS pos, substring(seq, q + 1, 1) AS base, target FROM k),
    m AS (SELECT rid, cluster, read, q, part, pos, base = substring(target, (pos + 1)::INTEGER, 1) AS same FROM b WHERE part <> 1), i AS (SELECT *, q - row_number() OVER (PARTITION BY rid, part, same ORDER BY q) AS isl FROM m),
    o AS (SELECT cluster, read, 'match' AS op, count(*) AS len, min(pos) AS pos, min(q) AS read_pos FROM i WHERE same GROUP BY rid, cluster, read, part, isl UNION ALL SELECT cluster, read, 'mismatch', 1, pos, q FROM m WHERE NOT same UNION ALL SELECT cluster, read, 'insertion', 2, start + 5, 6 FROM r WHERE cigar = '6M2I8M' UNION ALL SELECT cluster, read, 'deletion', 3, start + 5, 5 FROM r WHERE cigar = '5M3D11M')
    SELECT cluster, read, op, len::BIGINT AS len, pos::BIGINT AS pos, read_pos::BIGINT AS read_pos FROM o""")
def alignment_operations(spark, d):
    c = F.col
    s = F.concat(dna(c("cluster") * 7919), dna(c("cluster") * 104729))
    r = cluster_table(spark, d).withColumn("target", F.concat(s, s))
    return R.alignment_ops(r, ["cluster", "read"]).drop("at")


@query(f"""WITH {PARTS}, p AS (SELECT id, seq, (id % 14 + 1) AS pos FROM parts), w AS (SELECT *, substring(seq, (greatest(pos - 4, 0) + 1)::INTEGER, (least(pos + 5, 16) - greatest(pos - 4, 0))::INTEGER) AS a, substring(seq, (pos + 2)::INTEGER) AS behind FROM p)
    SELECT id, pos, substring(seq, pos::INTEGER, 1) || substring(seq, (pos + 2)::INTEGER, 1) AS context, round((length(a) - length(replace(replace(a, 'G', ''), 'C', ''))) / length(a), 6) AS gc, len(list_distinct(list_transform(range(1, length(a) - 1), lambda i: substring(a, i, 3))))::INTEGER AS kmers, length(regexp_extract(behind, '^(AA+|CC+|GG+|TT+)', 1))::INTEGER AS run FROM w""")
def reference_contexts(spark, d):
    p = parts(spark, d).withColumn("pos", F.col("id") % 14 + 1)
    return R.reference_context(p, "seq", "pos", 4).select("id", "pos", "context", F.round("gc", 6).alias("gc"), "kmers", "run")


@query("""WITH v AS (SELECT DISTINCT 'c' || (l_suppkey % 9) AS contig, l_partkey * 10 + l_linenumber AS pos, CASE l_partkey % 3 WHEN 0 THEN ['C', 'G'] WHEN 1 THEN ['CA'] ELSE ['T'] END AS alts, l_linenumber / 2.0 AS qual, l_linenumber AS n FROM lineitem), e AS (SELECT *, unnest(range(1, len(alts) + 1)) AS allele FROM v)
    SELECT contig, pos, alts[allele] AS alt, allele::INTEGER AS allele, qual::DOUBLE AS qual, n::INTEGER AS dp, 3::INTEGER AS ref_ad, CASE WHEN allele = 1 THEN n END::INTEGER AS alt_ad, CASE WHEN allele = 1 THEN round(n / (3 + n), 6) END AS af, CASE WHEN n > 3 THEN 1 ELSE 2 END::INTEGER AS gt FROM e""")
def record_features(spark, d):
    from plexframe.plans.source_queries import _vcf

    out = R.record_features(_vcf(spark, d))
    return out.select("contig", "pos", "alt", F.col("allele").cast("int").alias("allele"), "qual", "dp", "ref_ad", "alt_ad", F.round("af", 6).alias("af"), "gt")


@query(f"""WITH {REGIONS}, h AS (SELECT contig, start + 38 AS a, start + 43 AS b FROM regions WHERE contig % 2 = 0), p AS (SELECT contig, start, unnest([start, CASE WHEN contig % 2 = 0 THEN start + 43 ELSE start + 40 END, start + 80]) AS s, unnest([CASE WHEN contig % 2 = 0 THEN start + 43 ELSE start + 40 END, start + 80, stop]) AS e FROM regions) SELECT contig, s AS start, e AS stop FROM p""")
def homopolymer_aware_partition(spark, d):
    from plexframe.operators import intervals as I

    g = regions(spark, d)
    runs = g.where("contig % 2 = 0").select("contig", (F.col("start") + 38).alias("start"), (F.col("start") + 43).alias("stop"))
    return I.partition(g, 40, runs)


@query()
def somatic_segmentation(spark, d):
    """Random permutations, so no SQL; tested on made signals. Every user's values are one signal."""
    s = signal(spark, d)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        x, pos = f["value"].to_numpy(float), f["pos"].to_numpy()
        pieces = CN.somatic_segments(x, permutations=1000)
        return pd.DataFrame({"contig": f["contig"].iloc[0], "first": [pos[a] for a, _ in pieces], "last": [pos[b - 1] for _, b in pieces], "n": [b - a for a, b in pieces]})

    # Little data and much work: a stated number of partitions is not coalesced to a few.
    return dealt(s.select("contig", "pos", "value"), "contig").groupBy("contig").applyInPandas(run, "contig long, first long, last long, n long")


@query()
def denoised_sample(spark, d):
    """The first of twelve samples against the others; its parts have oracles, the projection a test."""
    c = cov(spark, d).groupBy((F.col("contig") % 12).alias("sample"), "bin").agg(F.sum("counts").alias("counts")).withColumns({"start": F.col("bin") * 100, "stop": F.col("bin") * 100 + 100})
    on = F.col("bin") % 3 > 0
    out = CN.denoised_sample(c.where("sample = 0").drop("sample"), c.where("sample > 0"), ["bin", "start", "stop"], "counts", on, 50, 1, 1, components=3)
    return out.select("bin", "on_target", F.round("log_ratio", 6).alias("log_ratio"), F.round("denoised", 6).alias("denoised"))


_SUBS = "['AC', 'AG', 'AT', 'CA', 'CG', 'CT', 'GA', 'GC', 'GT', 'ID', 'TA', 'TC', 'TG']"


@query(f"""WITH p AS (SELECT DISTINCT substring('ACGTN', (l_partkey % 5 + 1)::INTEGER, 1) AS ref, substring('ACGTN', (l_suppkey % 5 + 1)::INTEGER, 1) || CASE WHEN l_linenumber > 5 THEN 'A' ELSE '' END AS alt FROM lineitem)
    SELECT ref, alt, regexp_full_match(ref, '[ACGT]+') AS acgt, CASE WHEN length(alt) > 1 THEN 10 ELSE nullif(list_position({_SUBS}, ref || alt), 0) END::INTEGER AS idx FROM p""")
def substitution_indexes(spark, d):
    pick = lambda c: F.expr(f"substring('ACGTN', cast({c} % 5 + 1 as int), 1)")
    p = table(spark, d, "lineitem").select(pick("l_partkey").alias("ref"), F.concat(pick("l_suppkey"), F.when(F.col("l_linenumber") > 5, "A").otherwise("")).alias("alt")).distinct()
    return p.select("ref", "alt", S.is_acgt("ref").alias("acgt"), S.substitution_index("ref", "alt").alias("idx"))


@query("""WITH p AS (SELECT DISTINCT 'A' || repeat('C', (l_partkey % 4)::INTEGER) AS ref, 'A' || repeat('G', (l_suppkey % 2)::INTEGER) || repeat('C', (l_linenumber % 3)::INTEGER) AS alt, l_partkey % 4 AS a, l_suppkey % 2 AS g, l_linenumber % 3 AS b FROM lineitem), k AS (SELECT *, CASE WHEN g = 0 THEN least(a, b) ELSE least(a, b) END AS n FROM p)
    SELECT DISTINCT ref, alt, substring(ref, 1, (length(ref) - n)::INTEGER) AS ref_trimmed, substring(alt, 1, (length(alt) - n)::INTEGER) AS alt_trimmed FROM k""")
def trimmed_alleles(spark, d):
    c = F.col
    p = table(spark, d, "lineitem").select(F.concat(F.lit("A"), F.expr("repeat('C', cast(l_partkey % 4 as int))")).alias("ref"), F.concat(F.lit("A"), F.expr("repeat('G', cast(l_suppkey % 2 as int))"), F.expr("repeat('C', cast(l_linenumber % 3 as int))")).alias("alt")).distinct()
    a, b = S.trim_common_suffix("ref", "alt")
    return p.select(c("ref"), c("alt"), a.alias("ref_trimmed"), b.alias("alt_trimmed"))


@query("WITH q AS (SELECT l_orderkey AS id, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS q FROM lineitem GROUP BY 1) SELECT id, array_to_string(CASE WHEN list_min(q) <= 1 THEN list_transform(q, lambda x: list_min(q)) ELSE q END, ',') AS quals FROM q")
def homopolymer_masking(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("q"))
    return q.select("id", F.array_join(RD.masked_quality(F.lit(None), "q", 1).cast("array<string>"), ",").alias("quals"))


@query("""WITH n AS (SELECT DISTINCT l_partkey % 18 AS f, l_linenumber AS p, l_suppkey % 5 AS m FROM lineitem) SELECT f, p, m, CASE WHEN f < 16 THEN f & 1 > 0 END AS umi3, CASE WHEN f < 16 THEN f & 8 > 0 END AS sid5, p::INTEGER AS plus, m::INTEGER AS minus, (p + m)::INTEGER AS size,
    CASE WHEN m = 0 THEN 'full' WHEN p = 0 THEN 'partial' ELSE 'mixed' END AS kind, CASE WHEN f = 0 THEN 'forward' ELSE 'mixed' END AS way FROM n""")
def read_names(spark, d):
    c = F.col
    n = table(spark, d, "lineitem").select((c("l_partkey") % 18).alias("f"), c("l_linenumber").alias("p"), (c("l_suppkey") % 5).alias("m")).distinct()
    flags = S.umi_flags(F.concat(F.lit("read|"), c("f").cast("string")))
    counts = S.family_counts(F.concat_ws("-", F.lit("1:2"), F.lit("a"), F.lit("b"), c("p").cast("string"), c("m").cast("string"), (c("p") + c("m")).cast("string")))
    kind, way = S.cluster_kind("p", F.when(c("f") > 0, 1).otherwise(0), "m", F.lit(0))
    return n.select("f", "p", "m", flags["umi3"].alias("umi3"), flags["sid5"].alias("sid5"), counts["plus"].alias("plus"), counts["minus"].alias("minus"), counts["size"].alias("size"), kind.alias("kind"), way.alias("way"))


@query("SELECT n, CASE WHEN n >= 1e9 THEN printf('%.1fG', round(n / 1e9, 1)) WHEN n >= 1e6 THEN printf('%.1fM', round(n / 1e6, 1)) WHEN n >= 1e3 THEN printf('%.1fk', round(n / 1e3, 1)) ELSE n::VARCHAR END AS text FROM (SELECT event_id * event_id * 37 AS n FROM events)")
def metric_suffixes(spark, d):
    return table(spark, d, "events").select((F.col("event_id") * F.col("event_id") * 37).alias("n")).select("n", N.metric_suffix("n").alias("text"))
