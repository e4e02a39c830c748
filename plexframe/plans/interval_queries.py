"""Interval and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexframe.operators import coverage as C, intervals as I
from plexframe.plans.views import LENGTH, READS, REGIONS, lengths, query, reads, regions

CLIP = """clip AS (SELECT r.contig, r.read_id, r.mapq, greatest(r.start, g.start) AS start, least(r.stop, g.stop) AS stop, g.start AS gs
    FROM reads r JOIN regions g ON r.contig = g.contig AND r.start < g.stop AND r.stop > g.start)"""
HIST = f"""WITH {READS}, {REGIONS}, {CLIP},
    pos AS (SELECT contig, unnest(range(start, stop)) AS p FROM clip),
    dep AS (SELECT contig, p, count(*) AS depth FROM pos GROUP BY ALL),
    cov AS (SELECT depth, count(*) AS positions FROM dep GROUP BY depth),
    hist AS (SELECT depth, positions FROM cov UNION ALL
             SELECT 0, (SELECT sum(stop - start) FROM regions) - (SELECT sum(positions) FROM cov))"""


@query(HIST + " SELECT depth::BIGINT AS depth, positions::BIGINT AS positions FROM hist WHERE positions > 0")
def coverage_histogram(spark, d):
    return C.histogram(reads(spark, d), regions(spark, d))


@query(HIST + """, c AS (SELECT depth, sum(positions) OVER (ORDER BY depth) AS cum, sum(positions) OVER () AS total FROM hist WHERE positions > 0)
    SELECT p::DOUBLE AS percent, min(depth)::BIGINT AS value FROM c, (VALUES (0), (10), (20), (25), (50), (75), (90), (100)) AS t(p)
    WHERE cum * 100 >= total * p GROUP BY p""")
def coverage_stats_nearest_rank(spark, d):
    return C.nearest_rank(C.histogram(reads(spark, d), regions(spark, d)), [0, 10, 20, 25, 50, 75, 90, 100])


@query(HIST + """ SELECT sum(positions)::BIGINT AS count, round(sum(depth * positions) / sum(positions), 6) AS mean,
    round(sqrt(sum(depth * depth * positions) / sum(positions) - power(sum(depth * positions) / sum(positions), 2)), 6) AS sd,
    min(depth)::BIGINT AS least, max(depth)::BIGINT AS most FROM hist WHERE positions > 0""")
def coverage_moments(spark, d):
    out = C.moments(C.histogram(reads(spark, d), regions(spark, d)))
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(HIST + """ SELECT c::BIGINT AS cutoff, sum(CASE WHEN depth >= c THEN positions ELSE 0 END)::BIGINT AS positions,
    round(100.0 * sum(CASE WHEN depth >= c THEN positions ELSE 0 END) / sum(positions), 6) AS percent
    FROM hist, (VALUES (1), (5), (10), (20), (30)) AS t(c) GROUP BY c""")
def coverage_cutoffs(spark, d):
    out = C.at_least(C.histogram(reads(spark, d), regions(spark, d)), [1, 5, 10, 20, 30])
    return out.select(F.col("cutoff").cast("long").alias("cutoff"), "positions", F.round("percent", 6).alias("percent"))


@query(HIST + """, m AS (SELECT sum(depth * positions) / sum(positions) AS mean, sum(positions) AS n FROM hist),
    c AS (SELECT depth, sum(positions) OVER (ORDER BY depth) AS cum, sum(positions) OVER () AS total FROM hist WHERE positions > 0)
    SELECT round(max(mean), 6) AS mean, round(max(mean) / nullif((SELECT min(depth) FROM c WHERE cum * 100 >= total * 20), 0), 6) AS fold80,
    round(sum(CASE WHEN depth BETWEEN floor(mean / 2) AND floor(mean * 2) THEN positions ELSE 0 END) * 100.0 / max(n), 6) AS within FROM hist, m""")
def coverage_uniformity(spark, d):
    return C.uniformity(C.histogram(reads(spark, d), regions(spark, d))).select(*[F.round(c, 6).alias(c) for c in ("mean", "fold80", "within")])


@query(HIST + """ SELECT CASE WHEN depth > 8 THEN '8+' ELSE depth::VARCHAR END AS depth, sum(positions)::BIGINT AS positions FROM hist WHERE positions > 0 GROUP BY 1""")
def coverage_histogram_capped(spark, d):
    return C.cap(C.histogram(reads(spark, d), regions(spark, d)), 8)


@query(HIST + """, c AS (SELECT depth, sum(positions) OVER (ORDER BY depth) AS cum, sum(positions) OVER () AS total FROM hist WHERE positions > 0),
    p AS (SELECT min(CASE WHEN cum * 100 >= total * 10 THEN depth END) AS p10, min(CASE WHEN cum * 100 >= total * 50 THEN depth END) AS p50, min(CASE WHEN cum * 100 >= total * 90 THEN depth END) AS p90 FROM c)
    SELECT round(p90 / nullif(p10, 0), 6) AS ratio_90_10, round(p50 / nullif(p10, 0), 6) AS ratio_50_10, round(p90 / nullif(p50, 0), 6) AS ratio_90_50 FROM p""")
def percentile_ratios(spark, d):
    p = C.nearest_rank(C.histogram(reads(spark, d), regions(spark, d)), [10, 50, 90]).groupBy().pivot("percent", [10.0, 50.0, 90.0]).agg(F.first("value"))
    ratio = lambda a, b: F.round(F.col(f"`{a}`") / F.nullif(F.col(f"`{b}`"), F.lit(0)), 6)
    return p.select(ratio("90.0", "10.0").alias("ratio_90_10"), ratio("50.0", "10.0").alias("ratio_50_10"), ratio("90.0", "50.0").alias("ratio_90_50"))


@query(f"""WITH {READS}, {REGIONS}, {CLIP} SELECT g.contig, g.start, g.stop, count(c.read_id) AS reads, coalesce(sum(c.stop - c.start), 0)::BIGINT AS bases,
    round(avg(c.mapq), 6) AS mean_mapq, round(coalesce(sum(c.stop - c.start), 0) / (g.stop - g.start), 6) AS avg_depth
    FROM regions g LEFT JOIN clip c ON g.contig = c.contig AND g.start = c.gs GROUP BY g.contig, g.start, g.stop""")
def bedcov_windows(spark, d):
    out = C.interval_coverage(reads(spark, d), regions(spark, d))
    return out.withColumns({"mean_mapq": F.round("mean_mapq", 6), "avg_depth": F.round("avg_depth", 6)})


@query(f"WITH {READS}, {REGIONS} SELECT g.contig, g.start, count(*) AS n FROM reads r JOIN regions g ON r.contig = g.contig AND r.start < g.stop AND r.stop > g.start GROUP BY ALL")
def range_join_count(spark, d):
    return I.range_join(reads(spark, d), regions(spark, d)).groupBy("contig", F.col("r_start").alias("start")).agg(F.count("*").alias("n"))


@query(f"""WITH {READS}, {REGIONS} SELECT r.read_id, r.contig, r.start, EXISTS (SELECT 1 FROM regions g WHERE r.contig = g.contig AND r.start < g.stop AND r.stop > g.start) AS overlaps FROM reads r""")
def overlap_semi_anti(spark, d):
    return I.overlap_flag(reads(spark, d).select("read_id", "contig", "start", "stop"), regions(spark, d)).drop("stop")


@query(f"""WITH {READS}, {REGIONS}, j AS (SELECT r.read_id, g.start AS r_start, g.stop AS r_stop, abs(r.start - g.start) AS distance,
    row_number() OVER (PARTITION BY r.read_id ORDER BY abs(r.start - g.start), CASE WHEN r.start >= g.start AND r.start < g.stop THEN 0 ELSE 1 END, g.start, g.stop) AS k
    FROM reads r JOIN regions g ON r.contig = g.contig AND r.start < g.stop AND r.stop > g.start) SELECT read_id, r_start, r_stop, distance FROM j WHERE k = 1""")
def closest_region(spark, d):
    return I.closest(reads(spark, d), regions(spark, d), "read_id")


def _merge_sql(joins: str) -> str:
    return f"""WITH {READS}, s AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads),
    i AS (SELECT *, sum(CASE WHEN {joins} THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop, read_id) AS island FROM s)
    SELECT contig, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY contig, island"""


@query(_merge_sql("start < reach"))
def interval_merge_strict(spark, d):
    return I.merge(reads(spark, d), None)


@query(_merge_sql("start <= reach"))
def interval_merge_touching(spark, d):
    return I.merge(reads(spark, d), 0)


@query(_merge_sql("start <= reach + 10"))
def interval_merge_distance(spark, d):
    return I.merge(reads(spark, d), 10)


@query(f"""WITH {REGIONS}, {READS}, {CLIP}, free AS (SELECT contig, start AS gs, unnest(range(start, stop)) AS p FROM regions),
    pos AS (SELECT DISTINCT contig, unnest(range(start, stop)) AS p FROM clip),
    left_ AS (SELECT f.contig, f.gs, f.p FROM free f ANTI JOIN pos USING (contig, p)),
    i AS (SELECT *, p - row_number() OVER (PARTITION BY contig, gs ORDER BY p) AS g FROM left_)
    SELECT contig, min(p)::BIGINT AS start, (max(p) + 1)::BIGINT AS stop FROM i GROUP BY contig, gs, g""")
def interval_subtract(spark, d):
    g = regions(spark, d).withColumn("key", F.concat_ws(":", "contig", "start"))
    return I.subtract(g, reads(spark, d).select("contig", "start", "stop"), "key").drop("key")


@query(f"""WITH {READS}, pos AS (SELECT DISTINCT contig, unnest(range(start, stop)) AS p FROM reads), al AS (SELECT s_suppkey AS contig, p FROM supplier, range({LENGTH}) AS t(p)),
    free AS (SELECT contig, p FROM al ANTI JOIN pos USING (contig, p)), i AS (SELECT *, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS g FROM free)
    SELECT contig, min(p)::BIGINT AS start, (max(p) + 1)::BIGINT AS stop FROM i GROUP BY contig, g""")
def interval_complement(spark, d):
    return I.complement(reads(spark, d), lengths(spark, d))


@query(f"WITH {REGIONS} SELECT contig, p AS start, least(p + 40, stop) AS stop FROM (SELECT contig, stop, unnest(range(start, stop, 40)) AS p FROM regions)")
def window_split(spark, d):
    return I.split_windows(regions(spark, d), 40)


@query(f"WITH {REGIONS} SELECT contig, start + i * (stop - start) // 3 AS start, start + (i + 1) * (stop - start) // 3 AS stop FROM regions, range(3) AS t(i)")
def window_split_equal(spark, d):
    return I.split_equal(regions(spark, d), 40)


@query(f"""WITH {READS}, w AS (SELECT contig, greatest(start - 25, 0) AS start, least(stop + 25, {LENGTH}) AS stop, read_id FROM reads),
    s AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
    i AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop, read_id) AS island FROM s)
    SELECT contig, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop, count(*) AS n FROM i GROUP BY contig, island""")
def interval_pad_merge(spark, d):
    return I.pad_merge(reads(spark, d), 25, lengths(spark, d))


@query(f"""WITH {REGIONS}, w AS (SELECT contig, start, stop, start // 270 AS state FROM (SELECT contig, p AS start, p + 30 AS stop FROM (SELECT contig, stop, unnest(range(start, stop, 30)) AS p FROM regions))),
    l AS (SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY contig ORDER BY start, stop) = start AND lag(state) OVER (PARTITION BY contig ORDER BY start, stop) = state THEN 0 ELSE 1 END AS f FROM w),
    i AS (SELECT *, sum(f) OVER (PARTITION BY contig ORDER BY start, stop) AS island FROM l) SELECT contig, state::BIGINT AS state, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY contig, island, state""")
def merge_adjacent_equal_state(spark, d):
    w = I.split_windows(regions(spark, d), 30).withColumn("state", F.floor(F.col("start") / 270))
    return I.merge_adjacent(w, same=("state",))


@query("""WITH w AS (SELECT user_id AS contig, event_id AS pos, (1 + event_id % 7)::BIGINT AS weight FROM events),
    c AS (SELECT contig, pos, coalesce(sum(weight) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(weight) OVER (PARTITION BY contig) AS total FROM w)
    SELECT contig, pos, least(floor(done * 4 / total), 3)::BIGINT AS part FROM c""")
def balanced_partition(spark, d):
    from plexframe.plans.views import table

    w = table(spark, d, "events").select(F.col("user_id").alias("contig"), F.col("event_id").alias("pos"), (1 + F.col("event_id") % 7).alias("weight"))
    return I.balanced_cuts(w, 4).drop("weight")
