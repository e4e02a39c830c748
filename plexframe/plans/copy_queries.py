"""Copy-number queries: events as ordered signals, lineitem as coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plexframe.functions import numbers as N
from plexframe.operators import copynumber as CN
from plexframe.operators.intervals import merge_adjacent
from plexframe.plans.views import READS, query, reads, signal, table

COV = "cov AS (SELECT l_suppkey AS contig, l_partkey % 40 AS bin, count(*) AS counts, count(*) FILTER (l_linestatus = 'O') AS tumor, count(*) FILTER (l_linestatus <> 'O') AS normal FROM lineitem GROUP BY ALL)"


def cov(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") % 40).alias("bin")).agg(F.count("*").alias("counts"), n(F.col("l_linestatus") == "O").alias("tumor"), n(F.col("l_linestatus") != "O").alias("normal"))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {COV}, m AS (SELECT median(counts) AS m FROM cov WHERE contig % 10 <> 0) SELECT contig, bin, counts, round(greatest(log2(counts) - log2(m), -6.643856), 6) AS log_ratio FROM cov, m")
def self_logr(spark, d):
    return rounded(CN.self_log_ratio(cov(spark, d), "counts", F.col("contig") % 10 != 0).drop("tumor", "normal"), "log_ratio")


@query(f"""WITH {COV}, s AS (SELECT sum(tumor) AS t, sum(normal) AS n FROM cov), r AS (SELECT contig, bin, CASE WHEN tumor > 0 AND normal > 0 THEN log2((tumor / t) / (normal / n)) END AS raw, normal FROM cov, s),
    f AS (SELECT contig, bin, CASE WHEN normal > 0 THEN coalesce(raw, (SELECT min(raw) FROM r)) END AS raw FROM r) SELECT contig, bin, round(raw - (SELECT median(raw) FROM f), 6) AS log_ratio FROM f""")
def pair_logr(spark, d):
    return rounded(CN.pair_log_ratio(cov(spark, d), "tumor", "normal").select("contig", "bin", "log_ratio"), "log_ratio")


@query(f"""WITH {COV}, p AS (SELECT contig AS sample, bin, counts FROM cov WHERE contig > 20), t AS (SELECT sample, sum(counts) AS total FROM p GROUP BY sample), m AS (SELECT bin, median(counts / total) AS panel FROM p JOIN t USING (sample) GROUP BY bin),
    s AS (SELECT bin, sum(counts) AS counts FROM cov WHERE contig <= 20 GROUP BY bin) SELECT bin, counts::BIGINT AS counts, round(log2(greatest(counts / (SELECT sum(counts) FROM s), 1e-9) / greatest(panel, 1e-9)), 6) AS log_ratio FROM s JOIN m USING (bin)""")
def panel_logr(spark, d):
    c = cov(spark, d)
    m = CN.panel_medians(c.where("contig > 20").withColumnRenamed("contig", "sample"), ["bin"], "sample", "counts")
    s = c.where("contig <= 20").groupBy("bin").agg(F.sum("counts").alias("counts"))
    return rounded(CN.panel_log_ratio(s, m, ["bin"], "counts").select("bin", "counts", "log_ratio"), "log_ratio")


@query("""WITH d AS (SELECT event_type AS kind, value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS diff FROM events), c AS (SELECT kind, median(diff) AS c FROM d GROUP BY kind)
    SELECT kind, round(1.4826 / sqrt(2) * median(abs(diff - c)), 6) AS sd FROM d JOIN c USING (kind) WHERE diff IS NOT NULL GROUP BY kind""")
def mad_diff_sd(spark, d):
    return rounded(CN.difference_sd(signal(spark, d), ["kind"], "pos", "value"), "sd")


@query("WITH q AS (SELECT event_type AS kind, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT event_id AS pos, kind, round(least(greatest(value, lo - 1.5 * (hi - lo)), hi + 1.5 * (hi - lo)), 6) AS value FROM events JOIN q ON event_type = kind")
def outlier_clamp(spark, d):
    return rounded(CN.clamp_outliers(signal(spark, d), ["kind"], "value").select("pos", "kind", "value"), "value")


@query(f"WITH {COV} SELECT contig, round(avg(counts), 6) AS mean, round(stddev_samp(counts), 6) AS sd, count(*) AS n FROM cov GROUP BY contig")
def contig_mean_sd(spark, d):
    return rounded(cov(spark, d).groupBy("contig").agg(F.avg("counts").alias("mean"), F.stddev_samp("counts").alias("sd"), F.count("*").alias("n")), "mean", "sd")


@query("""WITH c AS (SELECT o_custkey % 25 AS sample, CASE WHEN o_orderkey % 5 < 3 THEN 'chrX' ELSE 'chrY' END AS contig, o_totalprice / CASE WHEN o_orderkey % 5 < 3 THEN 1 ELSE 10 + o_custkey % 25 END AS v FROM orders),
    q AS (SELECT sample, contig, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(*) AS m FROM c GROUP BY ALL),
    k AS (SELECT c.* FROM c JOIN q USING (sample, contig) WHERE m < 5 OR v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    s AS (SELECT sample, count(*) FILTER (contig = 'chrY') AS n, median(v) FILTER (contig = 'chrX') AS mx, median(v) FILTER (contig = 'chrY') AS my, avg(v) FILTER (contig = 'chrX') AS ax, avg(v) FILTER (contig = 'chrY') AS ay FROM k GROUP BY sample),
    r AS (SELECT sample, CASE WHEN n < 10 THEN mx ELSE ax END AS x_mean, coalesce(CASE WHEN n < 10 THEN my ELSE ay END, 0) AS y_mean FROM s), f AS (SELECT *, x_mean / (y_mean + 0.0001) AS ratio FROM r)
    SELECT sample, round(x_mean, 4) AS x_mean, round(y_mean, 4) AS y_mean, round(ratio, 6) AS ratio, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio > 25 THEN 'female' WHEN ratio > 20 THEN 'unknown' ELSE 'male' END AS sex FROM f""")
def sex_ratio_rule(spark, d):
    x = F.col("o_orderkey") % 5 < 3
    c = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("sample"), F.when(x, "chrX").otherwise("chrY").alias("contig"), (F.col("o_totalprice") / F.when(x, 1).otherwise(10 + F.col("o_custkey") % 25)).alias("v"))
    r = CN.xy_ratio(c, ["sample"], "contig", "v")
    return r.select("sample", F.round("x_mean", 4).alias("x_mean"), F.round("y_mean", 4).alias("y_mean"), F.round("ratio", 6).alias("ratio"), CN.sex_of_ratio(F.col("ratio")).alias("sex"))


@query(f"WITH {COV}, m AS (SELECT contig, median(tumor) AS t, median(normal) AS n FROM cov GROUP BY contig) SELECT contig, round(t, 6) AS t, round(n, 6) AS n, CASE WHEN t / nullif(n, 0) > 0.5 AND t / nullif(n, 0) < 2.5 THEN CASE WHEN round(t / n) = 1 THEN 'female' ELSE 'male' END ELSE 'unknown' END AS sex FROM m")
def median_dp_by_group(spark, d):
    m = cov(spark, d).groupBy("contig").agg(F.percentile("tumor", F.lit(0.5)).alias("t"), F.percentile("normal", F.lit(0.5)).alias("n"))
    return rounded(m.withColumn("sex", CN.sex_of_depth(F.col("t"), F.col("n"))), "t", "n")


SEG = """seg AS (SELECT user_id AS contig, avg(value) / 60 - 0.8 AS mean_log_ratio, 0.2 + stddev_pop(value) / 500 AS sd, avg(value) / 250 AS baf, count(*) AS n, min(event_id) AS start, max(event_id) AS stop, avg(event_id % 60) AS mean_mapq FROM events GROUP BY user_id)"""


def seg(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("contig")).agg((F.avg("value") / 60 - 0.8).alias("mean_log_ratio"), (0.2 + F.stddev_pop("value") / 500).alias("sd"), (F.avg("value") / 250).alias("baf"), F.count("*").alias("n"), F.min("event_id").alias("start"), F.max("event_id").alias("stop"), F.avg(F.col("event_id") % 60).alias("mean_mapq"))


T5 = "(lgamma(3.0) - lgamma(2.5) - 0.5 * ln(5 * pi()))"
LOGPDF = lambda x, m, s: f"({T5} - ln({s}) - 3.0 * ln(1 + power(({x} - {m}) / {s}, 2) / 5))"
LOGR = lambda k, p, q: f"greatest(log2(({p} * {k} + (1 - {p}) * 2) / ({p} * {q} + (1 - {p}) * 2)), -6.643856)"


@query(f"""WITH {SEG}, l AS (SELECT contig, k, {LOGPDF("mean_log_ratio", LOGR("k", 0.7, 2.1), "sd")} AS l FROM seg, range(21) AS t(k)), b AS (SELECT contig, k, row_number() OVER (PARTITION BY contig ORDER BY round(l, 9) DESC, k) AS r FROM l) SELECT contig, k::BIGINT AS tcn FROM b WHERE r = 1""")
def tcn_argmax(spark, d):
    return CN.best_copies(seg(spark, d), ["contig"], "mean_log_ratio", "sd", 0.7, 2.1).select("contig", F.col("tcn").cast("long").alias("tcn"))


@query(f"""WITH {SEG}, t AS (SELECT contig, baf, 1 + n % 5 AS tcn FROM seg), l AS (SELECT contig, tcn, k, {LOGPDF("baf", "((0.7 * k + 0.3) / (0.7 * tcn + 0.6))", "0.1")} AS l FROM t, range(11) AS r(k) WHERE 2 * k <= tcn),
    b AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY round(l, 9) DESC, k) AS r FROM l) SELECT contig, tcn, k::BIGINT AS mcn FROM b WHERE r = 1""")
def minor_copy_argmax(spark, d):
    s = seg(spark, d).select("contig", "baf", (1 + F.col("n") % 5).alias("tcn"))
    return CN.best_minor(s, "tcn", "baf", 0.1, 0.7).select("contig", "tcn", F.col("mcn").cast("long").alias("mcn"))


PURITIES, PLOIDIES = [0.15 + 0.1 * k for k in range(8)], [1.4 + 0.5 * k for k in range(9)]


@query(f"""WITH {SEG}, g AS (SELECT purity, ploidy FROM (SELECT unnest({[round(p, 2) for p in PURITIES]}::DOUBLE[]) AS purity), (SELECT unnest({[round(p, 1) for p in PLOIDIES]}::DOUBLE[]) AS ploidy)),
    l AS (SELECT purity, ploidy, contig, max({LOGPDF("mean_log_ratio", LOGR("k", "purity", "ploidy"), "sd")}) AS l FROM seg, g, range(8) AS t(k) GROUP BY ALL) SELECT purity, ploidy, round(sum(l), 4) AS loglik FROM l GROUP BY purity, ploidy""")
def purity_ploidy_grid(spark, d):
    g = CN.purity_ploidy_grid(seg(spark, d), "mean_log_ratio", "sd", [round(p, 2) for p in PURITIES], [round(p, 1) for p in PLOIDIES])
    return g.withColumn("loglik", F.round("loglik", 4))


STATUS = "CASE WHEN m = 0 AND t = 2 THEN 'cnLOH' WHEN m = 0 AND t > 2 THEN 'gainLOH' WHEN t > 2 THEN 'gain' WHEN t < 2 THEN 'loss' ELSE 'ref' END"


@query(f"""WITH {SEG}, s AS (SELECT *, n % 5 AS t, n % 3 AS m, greatest((power(2, mean_log_ratio) * (0.7 * 2.1 + 0.6) - 0.6) / 0.7, 0) AS r FROM seg)
    SELECT contig, t AS tcn, {STATUS} AS status, coalesce(nullif(concat_ws(';', CASE WHEN mean_mapq < 28 AND t <> 0 THEN 'lowMmMapq' END, CASE WHEN (t = 1 AND NOT r BETWEEN 0.7 AND 1.3) OR (t = 0 AND r > 0.3) THEN 'nonIntegerTcn' END, CASE WHEN stop - start < 8000 THEN 'cnvLength' END, CASE WHEN contig % 7 = 0 THEN 'chrYFemale' END), ''), 'PASS') AS flags FROM s""")
def cnv_status_flags(spark, d):
    s = seg(spark, d).withColumns({"tcn": F.col("n") % 5, "mcn": F.col("n") % 3})
    out = CN.flags(s, 28, 8000, 0.7, 2.1, F.col("contig") % 7 == 0)
    return out.select("contig", "tcn", N.cnv_status(F.col("tcn"), F.col("mcn")).alias("status"), "flags")


@query("""WITH w AS (SELECT user_id AS contig, event_id AS pos, (value > 40)::BIGINT AS tcn, value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events),
    l AS (SELECT *, CASE WHEN lag(tcn) OVER (PARTITION BY contig ORDER BY pos) = tcn THEN 0 ELSE 1 END AS f FROM w WHERE nx IS NOT NULL), i AS (SELECT *, sum(f) OVER (PARTITION BY contig ORDER BY pos) AS island FROM l)
    SELECT contig, tcn, min(pos) AS start, max(nx) AS stop, count(*) AS n FROM i GROUP BY contig, tcn, island""")
def merge_equal_copies(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("contig").orderBy("pos")
    s = signal(spark, d).select("contig", F.col("pos").alias("start"), F.lead("pos").over(w).alias("stop"), (F.col("value") > 40).cast("long").alias("tcn")).where("stop IS NOT NULL")
    return merge_adjacent(s, same=("tcn",))


@query("""WITH e AS (SELECT l_partkey AS site, count(*) FILTER (l_returnflag = 'A') AS alt, count(*) FILTER (l_returnflag = 'N') AS ref FROM lineitem GROUP BY 1)
    SELECT site, CASE WHEN ref + alt > 0 THEN round(alt / (ref + alt), 6) END AS baf, CASE WHEN ref + alt > 0 THEN round(2 * abs(alt / (ref + alt) - 0.5), 6) END AS dh FROM e WHERE ref + alt > 0""")
def baf_and_shift(spark, d):
    n = lambda x: F.sum(F.when(F.col("l_returnflag") == x, 1).otherwise(0))
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site")).agg(n("A").alias("alt"), n("N").alias("ref")).where("ref + alt > 0")
    b = N.baf("ref", "alt")
    return e.select("site", F.round(b, 6).alias("baf"), F.round(N.heterozygosity_shift(b), 6).alias("dh"))


@query("SELECT l_linenumber::BIGINT AS k, l_quantity::BIGINT AS n, count(*) AS m, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.3) + (n - k) * ln(0.7), 6) AS logp FROM lineitem WHERE l_linenumber <= l_quantity GROUP BY 1, 2")
def binomial_log_pmf(spark, d):
    c = table(spark, d, "lineitem").where("l_linenumber <= l_quantity").groupBy(F.col("l_linenumber").cast("long").alias("k"), F.col("l_quantity").cast("long").alias("n")).agg(F.count("*").alias("m"))
    return c.withColumn("logp", F.round(N.log_binomial_pmf("k", "n", 0.3), 6))


@query(f"WITH {READS} SELECT contig, round(2 * least(greatest(quantile_disc(mapq / 20.0, 0.5), 0), 0.495), 6) AS purity, round(100.0 * count(*) FILTER (mapq / 10.0 < 0.03 OR mapq / 10.0 > 0.97) / count(*), 6) AS extreme FROM reads GROUP BY contig")
def purity_from_vafs(spark, d):
    v = F.col("mapq") / 20.0
    extreme = F.sum(F.when((F.col("mapq") / 10.0 < 0.03) | (F.col("mapq") / 10.0 > 0.97), 1).otherwise(0))
    m = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY mapq / 20.0)")
    return reads(spark, d).groupBy("contig").agg(F.round(2 * F.least(F.greatest(m, F.lit(0.0)), F.lit(0.495)), 6).alias("purity"), F.round(100.0 * extreme / F.count("*"), 6).alias("extreme"))


# Order-dependent kernels: no SQL; tests compare them with brute force.


@query()
def loess_gc(spark, d):
    r = cov(spark, d).withColumns({"gc": (F.col("bin") + 10) / 60.0, "coverage": F.col("counts") / 10.0, "counts": F.col("counts").cast("double"), "start": F.col("bin") * 100, "stop": F.col("bin") * 100 + 100 + F.col("contig") % 9, "on_target": F.col("bin") % 2 == 0, "mappability": F.when(F.col("contig") % 11 == 0, 0.9).otherwise(1.0)})
    out = None
    for on in (True, False):
        own = CN.ideal_intervals(r, F.col("contig") % 10 != 0).where(F.col("on_target") == on)
        own = CN.gc_correct(own, "gc", "coverage", ["counts"], F.col("valid"), F.col("ideal"))
        out = own if out is None else out.unionByName(own)
    return rounded(out.select("contig", "bin", "valid", "ideal", F.col("counts").alias("corrected")), "corrected")


@query(f"""WITH {COV}, r AS (SELECT contig, bin, counts / 10.0 AS coverage, (bin + 10) / 60.0 AS gc, bin % 2 = 0 AS on_target, 100 + contig % 9 AS size, CASE WHEN contig % 11 = 0 THEN 0.9 ELSE 1.0 END AS mappability FROM cov),
    q AS (SELECT on_target, quantile_cont(coverage, 0.99) AS c, quantile_cont(gc, 0.001) AS lo, quantile_cont(gc, 0.999) AS hi, quantile_cont(size, 0.1) AS s FROM r WHERE coverage > 0 AND gc >= 0 GROUP BY 1)
    SELECT contig, bin, coverage > 0 AND gc >= 0 AS valid, coverage > 0 AND gc >= 0 AND contig % 10 <> 0 AND coverage <= c AND gc BETWEEN lo AND hi AND CASE WHEN on_target THEN mappability >= 1 ELSE size >= s END AS ideal FROM r JOIN q USING (on_target)""")
def ideal_intervals(spark, d):
    r = cov(spark, d).withColumns({"gc": (F.col("bin") + 10) / 60.0, "coverage": F.col("counts") / 10.0, "start": F.col("bin") * 100, "stop": F.col("bin") * 100 + 100 + F.col("contig") % 9, "on_target": F.col("bin") % 2 == 0, "mappability": F.when(F.col("contig") % 11 == 0, 0.9).otherwise(1.0)})
    return CN.ideal_intervals(r, F.col("contig") % 10 != 0).select("contig", "bin", "valid", "ideal")


@query()
def cbs_segments(spark, d):
    return rounded(CN.segment(signal(spark, d), ["contig"], "pos", "value"), "mean", "median")


@query()
def hclust_prune(spark, d):
    s = seg(spark, d).select((F.col("contig") % 20).alias("genome"), "contig", "mean_log_ratio", "baf")
    return CN.prune(s, ["genome"], "contig", ["mean_log_ratio", "baf"]).select("genome", "contig", "pruned")


@query()
def kde_peak(spark, d):
    sites = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("segment"), F.col("l_partkey").alias("site")).agg(F.count("*").alias("depth"), F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("alt"))
    e = sites.groupBy("segment", "depth", "alt").agg(F.count("*").alias("sites"))  # sites of equal depths count together

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": f["segment"].iloc[:1], "peak": [round(CN.mirrored_peak((f["depth"] - f["alt"]).to_numpy(), f["alt"].to_numpy(), times=f["sites"].to_numpy()), 6)]})

    return e.groupBy("segment").applyInPandas(run, "segment long, peak double")


@query()
def low_mapq_merge(spark, d):
    s = table(spark, d, "events").select((F.col("user_id") % 50).alias("contig"), (F.col("event_id") % 9 == 0).alias("in_par"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("stop"), F.when(F.col("event_id") % 13 > 0, (F.col("event_id") % 60).cast("double")).alias("mean_mapq"), (F.col("value") / 100).alias("mean_log_ratio"), (F.col("value") > 30).cast("long").alias("tcn"), (1 + F.col("event_id") % 4).alias("n"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = f.sort_values("start").astype(object).where(f.notna(), None).to_dict("records")
        return pd.DataFrame(CN.merge_low_quality(rows, 10.0), columns=f.columns)

    return rounded(s.groupBy("contig").applyInPandas(run, s.schema), "mean_mapq", "mean_log_ratio")


@query()
def svd_denoise(spark, d):
    """A panel is samples by bins; every sample is denoised against the others' components."""
    c = cov(spark, d).groupBy((F.col("contig") % 12).alias("sample"), "bin").agg(F.sum("counts").alias("counts"))
    total = c.groupBy("sample").agg(F.sum("counts").alias("total"))
    logs = c.join(total, "sample").withColumn("log_ratio", F.log2(F.col("counts") / F.col("total")))
    middle = logs.groupBy("bin").agg(F.percentile("log_ratio", F.lit(0.5)).alias("m"))  # a panel's samples are few
    panel = logs.join(middle, "bin").select("sample", "bin", (F.col("log_ratio") - F.col("m")).alias("log_ratio"))
    return rounded(CN.denoise_panel(panel, ["bin"], "sample", "log_ratio", 3).select(F.col("sample").cast("long").alias("sample"), F.col("bin").cast("long").alias("bin"), "log_ratio"), "log_ratio")
