"""Demultiplexing, sequence-function, model and event queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from plexframe.functions import numbers as N, sequences as S
from plexframe.operators import demux as D, model as M, variants as V
from plexframe.plans.views import SIGNAL, query, signal, table

#: A text of bases for every part and supplier, from the digits of a number.
DNA = "translate(lpad({}::VARCHAR, 8, '0'), '0123456789', 'ACGTACGTAC')"


def dna(c):
    return F.translate(F.lpad(c.cast("string"), 8, "0"), "0123456789", "ACGTACGTAC")


BAR = "bar AS (SELECT s_suppkey AS barcode_id, " + DNA.format("(s_suppkey * 7919 + 1234567)") + " AS sequence FROM supplier)"
LINE = "line AS (SELECT l_orderkey AS o, l_linenumber::BIGINT AS k, l_partkey AS p, " + DNA.format("(l_suppkey * 7919 + 1234567 + l_linenumber % 3)") + " AS s5, " + DNA.format("(l_suppkey * 7919 + 1234567 + (l_linenumber + l_partkey) % 4)") + " AS s3 FROM lineitem)"


def barcodes(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("barcode_id"), dna(F.col("s_suppkey") * 7919 + 1234567).alias("sequence"))


def lines(spark, d):
    base = F.col("l_suppkey") * 7919 + 1234567
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_partkey").alias("p"), dna(base + F.col("l_linenumber") % 3).alias("s5"), dna(base + (F.col("l_linenumber") + F.col("l_partkey")) % 4).alias("s3"))


def _assigned(col: str, name: str) -> str:
    return f"""{name} AS (SELECT q.s AS s, min(b.barcode_id) FILTER (dist = m) AS barcode_id, max(m) AS distance, count(*) FILTER (dist = m) > 1 AS ambiguous FROM (
        SELECT u.s, barcode_id, levenshtein(u.s, sequence) AS dist, min(levenshtein(u.s, sequence)) OVER (PARTITION BY u.s) AS m
        FROM (SELECT DISTINCT {col} AS s FROM line) u, bar WHERE levenshtein(u.s, sequence) <= 1) q JOIN bar b USING (barcode_id) GROUP BY q.s)"""


@query(f"WITH {BAR}, {LINE}, {_assigned('s5', 'a')} SELECT s AS s5, barcode_id, distance, ambiguous FROM a")
def barcode_lut_join(spark, d):
    seqs = lines(spark, d).select("s5").distinct()
    return D.assign(seqs, D.lookup(barcodes(spark, d), 1), "s5", ["s5"])


@query(f"WITH {BAR}, {LINE}, {_assigned('s5', 'a')} SELECT s AS s5, barcode_id, distance, ambiguous FROM a")
def barcode_distance_join(spark, d):
    seqs = lines(spark, d).select("s5").distinct()
    return D.by_distance(seqs, barcodes(spark, d), "s5", ["s5"], 1)


ENDS = f"{BAR}, {LINE}, {_assigned('s5', 'a5')}, {_assigned('s3', 'a3')}, e AS (SELECT l.*, a5.barcode_id AS id5, a5.distance AS d5, a3.barcode_id AS id3, a3.distance AS d3 FROM line l LEFT JOIN a5 ON l.s5 = a5.s LEFT JOIN a3 ON l.s3 = a3.s)"
CHOSEN = """c AS (SELECT *, CASE WHEN id5 IS NOT NULL AND (id3 IS NULL OR d5 <= d3) THEN id5 ELSE id3 END AS barcode,
    CASE WHEN id5 IS NULL AND id3 IS NULL THEN 'unassigned' WHEN id5 IS NULL THEN 'partial3' WHEN id3 IS NULL THEN 'partial5' WHEN id5 = id3 THEN 'full' ELSE 'discordant' END AS status FROM e)"""


def ends(spark, d):
    """Distinct sequences are assigned once, not read by read."""
    lut = D.lookup(barcodes(spark, d), 1)
    r = lines(spark, d)
    for s, x in (("s5", "5"), ("s3", "3")):
        a = D.assign(r.select(s).distinct(), lut, s, [s]).select(s, F.col("barcode_id").alias("id" + x), F.col("distance").alias("d" + x))
        r = r.join(a, s, "left")
    return r


@query(f"WITH {ENDS}, {CHOSEN} SELECT status, count(*) AS reads, count(DISTINCT barcode) AS barcodes, coalesce(sum(d5), 0)::BIGINT AS edits FROM c GROUP BY status")
def sid_assignment(spark, d):
    b, s = D.choose_end("id5", "d5", "id3", "d3")
    c = ends(spark, d).withColumns({"barcode": b, "status": s})
    return c.groupBy("status").agg(F.count("*").alias("reads"), F.countDistinct("barcode").alias("barcodes"), F.coalesce(F.sum("d5"), F.lit(0)).alias("edits"))


@query(f"WITH {ENDS}, {CHOSEN} SELECT barcode, count(*) AS reads, count(*) FILTER (status = 'full') AS \"full\", count(*) FILTER (status LIKE 'partial%') AS partial, count(*) FILTER (status = 'discordant') AS hopping, count(*) FILTER (d5 = 0 AND d3 = 0) AS perfect, round(count(*) FILTER (status = 'full') / count(*), 6) AS full_share FROM c GROUP BY barcode")
def demux_sample_metrics(spark, d):
    b, s = D.choose_end("id5", "d5", "id3", "d3")
    return D.sample_metrics(ends(spark, d).withColumns({"barcode": b, "status": s})).withColumn("full_share", F.round("full_share", 6))


@query(f"""WITH {ENDS}, n AS (SELECT id5, id3, count(*) AS reads FROM e WHERE id5 IS NOT NULL AND id3 IS NOT NULL GROUP BY ALL), t AS (SELECT id5, sum(reads) AS total FROM n GROUP BY id5)
    SELECT a.barcode_id AS id5, b.barcode_id AS id3, coalesce(reads, 0) AS reads, round(CASE WHEN total > 0 THEN 100.0 * coalesce(reads, 0) / total END, 6) AS percent
    FROM bar a CROSS JOIN bar b LEFT JOIN n ON n.id5 = a.barcode_id AND n.id3 = b.barcode_id LEFT JOIN t ON t.id5 = a.barcode_id""")
def collision_matrix(spark, d):
    return D.collision_matrix(ends(spark, d), barcodes(spark, d)).withColumn("percent", F.round("percent", 6))


@query("""WITH c AS (SELECT (CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END + CASE WHEN l_tax > 0.02 THEN 2 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 4 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 8 ELSE 0 END) AS code FROM lineitem)
    SELECT i AS code, count(c.code) AS reads FROM range(16) AS t(i) LEFT JOIN c ON c.code = i GROUP BY i""")
def adapter_code_16(spark, d):
    found = {"s5": F.col("l_quantity") > 10, "s3": F.col("l_tax") > 0.02, "u5": F.col("l_discount") > 0.05, "u3": F.col("l_quantity") > 40}
    return D.adapter_codes(table(spark, d, "lineitem"), found)


PARTS = "parts AS (SELECT p_partkey AS id, " + DNA.format("(p_partkey * 104729 + 31415926)") + " || " + DNA.format("(p_partkey * 33331)") + " AS seq FROM part)"


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(dna(F.col("p_partkey") * 104729 + 31415926), dna(F.col("p_partkey") * 33331)).alias("seq"))


@query(f"WITH {PARTS} SELECT id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq), 6) AS gc, len(list_distinct(list_transform(range(1, length(seq) - 1), lambda i: substring(seq, i, 3))))::INTEGER AS kmers FROM parts")
def sequence_features(spark, d):
    return parts(spark, d).select("id", "seq", S.reverse_complement("seq").alias("rc"), F.round(S.gc_fraction("seq"), 6).alias("gc"), S.distinct_kmers("seq", 3).alias("kmers"))


@query(f"""WITH {PARTS} SELECT id, length(regexp_extract(seq, '^(AA+|CC+|GG+|TT+)', 1))::INTEGER AS homopolymer,
    (WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE substring(seq, 2 * n + 1, 2) = substring(seq, 1, 2)) SELECT CASE WHEN max(n) > 1 THEN max(n) ELSE 0 END FROM r)::INTEGER AS repeat2 FROM parts""")
def repeat_counts(spark, d):
    return parts(spark, d).select("id", S.homopolymer_at_start("seq").alias("homopolymer"), S.repeats_at_start("seq", 2).alias("repeat2"))


@query("""WITH t AS (SELECT l_orderkey AS o, l_linenumber::BIGINT AS k, l_partkey AS p, (l_linenumber % 4)::VARCHAR || '+' || (l_quantity::BIGINT)::VARCHAR || repeat('E', (l_partkey % 3 + 1)::INTEGER) || (l_suppkey % 9)::VARCHAR || '-' || (l_partkey % 5)::VARCHAR AS yc, l_linenumber % 4 + l_partkey % 5 AS simplex, l_quantity::BIGINT + l_suppkey % 9 AS c, l_partkey % 3 + 1 AS x, l_suppkey % 9 AS w, l_quantity::BIGINT AS q FROM lineitem)
    SELECT o, k, p, yc, simplex::INTEGER AS simplex, c::INTEGER AS concordant, x::INTEGER AS discordant, round(x / (c + x), 6) AS rate FROM t""")
def yc_base_type_counts(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_partkey").alias("p"), F.concat((F.col("l_linenumber") % 4).cast("string"), F.lit("+"), F.col("l_quantity").cast("long").cast("string"), F.expr("repeat('E', cast(l_partkey % 3 + 1 as int))"), (F.col("l_suppkey") % 9).cast("string"), F.lit("-"), (F.col("l_partkey") % 5).cast("string")).alias("yc"))
    c = S.yc_counts("yc")
    return t.select("o", "k", "p", "yc", c["simplex"].alias("simplex"), c["concordant"].alias("concordant"), c["discordant"].alias("discordant"), F.round(S.duplex_error_rate("yc"), 6).alias("rate"))


@query("""WITH t AS (SELECT DISTINCT l_quantity::BIGINT AS m, l_partkey % 7 AS s FROM lineitem) SELECT m, s, (s::VARCHAR || 'S' || m::VARCHAR || 'M2I' || (m + 1)::VARCHAR || 'M3D') AS cigar, (2 * m + 4)::INTEGER AS ref_len, (s + 2 * m + 3)::INTEGER AS query_len, (2 * m + 3)::INTEGER AS aligned FROM t""")
def cigar_lengths(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("m"), (F.col("l_partkey") % 7).alias("s")).distinct()
    t = t.withColumn("cigar", F.concat(F.col("s").cast("string"), F.lit("S"), F.col("m").cast("string"), F.lit("M2I"), (F.col("m") + 1).cast("string"), F.lit("M3D")))
    return t.select("m", "s", "cigar", S.reference_length("cigar").alias("ref_len"), S.query_length("cigar").alias("query_len"), S.query_length("cigar", False).alias("aligned"))


@query("""WITH t AS (SELECT DISTINCT l_returnflag AS ref, l_linestatus || repeat('A', (l_linenumber % 3)::INTEGER) AS alt FROM lineitem) SELECT ref, alt, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) > length(alt) AND length(alt) = 1 THEN 'deletion' WHEN length(ref) < length(alt) AND length(ref) = 1 THEN 'insertion' ELSE 'unknown' END AS kind, 'chr1_' || lpad('77', 10, '0') || '_' || ref || '_' || alt AS key FROM t""")
def variant_types(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("ref"), F.concat("l_linestatus", F.expr("repeat('A', cast(l_linenumber % 3 as int))")).alias("alt")).distinct()
    return t.select("ref", "alt", S.variant_type("ref", "alt").alias("kind"), S.variant_key(F.lit("chr1"), F.lit(77), "ref", "alt", 10).alias("key"))


@query("SELECT event_id, CASE WHEN value >= 1e3 THEN 'big' ELSE 'small' END AS kind, round(CASE WHEN (event_id % 101) / 100.0 = 0 THEN 93 ELSE least(93, -10 * log10((event_id % 101) / 100.0)) END, 6) + 0.0 AS phred, round(event_id / 7)::BIGINT AS rounded FROM events")
def number_functions(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.when(F.col("value") >= 1e3, "big").otherwise("small").alias("kind"), F.round(N.phred((F.col("event_id") % 101) / 100.0), 6).alias("phred"), N.rounded_division("event_id", 7).alias("rounded"))


@query()
def kmer_strand(spark, d):
    """Reads of both strands against a reference index; checked in tests."""
    p = parts(spark, d)
    reads = p.select("id", F.when(F.col("id") % 2 == 0, F.col("seq")).otherwise(S.reverse_complement("seq")).alias("seq"))
    return D.strand_votes(reads, D.strand_index(p, "seq", 9), "id", "seq", 9)


@query()
def duplex_consensus(spark, d):
    """Both strands of each part, the second with one base changed; checked in tests."""
    p = parts(spark, d).withColumn("other", F.concat(F.substring("seq", 1, 4), F.lit("T"), F.substring("seq", 6, 20)))

    def run(frames):
        for f in frames:
            out = D.duplex_consensus_all(f["seq"].tolist(), f["other"].tolist())
            yield f[["id"]].assign(bases=[x for x, _ in out], kinds=[x for _, x in out])

    return p.mapInPandas(run, "id long, bases string, kinds string")


@query()
def model_score(spark, d):
    """Trees over document features against the quality labels."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("n"), F.regexp_count("text", F.lit(r"\s")).cast("double").alias("spaces"), F.regexp_count("text", F.lit(r"[^\w\s]")).cast("double").alias("marks"))
    rows = docs.join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")), "doc_id")
    features = ["n", "spaces", "marks"]
    scored = M.score(M.train(rows, features, "label"), docs, features)
    return scored.select("doc_id", F.round(F.col("probabilities")[1], 6).alias("score"))


@query(f"WITH {SIGNAL} SELECT contig, kind, count(*) AS n, round(sum(value), 4) AS total FROM signal GROUP BY ROLLUP (contig, kind)")
def event_rollup(spark, d):
    return signal(spark, d).rollup("contig", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = e.withColumn("f", F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)).withColumn("k", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("k")


@query("WITH a AS (SELECT DISTINCT l_partkey AS pos FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS pos FROM lineitem WHERE l_returnflag = 'R') SELECT 'both' AS part, count(*) AS n FROM (SELECT pos FROM a INTERSECT SELECT pos FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT pos FROM a EXCEPT SELECT pos FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT pos FROM b EXCEPT SELECT pos FROM a)")
def key_set_operations(spark, d):
    t = table(spark, d, "lineitem")
    a, b = (t.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("pos")) for x in "AR")
    # One aggregation in place of three set operations.
    both = a.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.withColumn("a", F.lit(0)).withColumn("b", F.lit(1))).groupBy("pos").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = both.agg(F.coalesce(n(F.expr("a + b = 2")), F.lit(0)).alias("both"), F.coalesce(n(F.expr("a > b")), F.lit(0)).alias("first"), F.coalesce(n(F.expr("b > a")), F.lit(0)).alias("second"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("n")) for p in ("both", "first", "second")])).alias("x")).select("x.*")


@query("SELECT contig, start, stop FROM (SELECT l_suppkey AS contig, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS pos FROM lineitem), LATERAL (SELECT greatest(pos - 5, 0)::BIGINT AS start, (pos + 2 + 3)::BIGINT AS stop)")
def records_to_intervals(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.expr("cast(datediff(to_date(l_shipdate), date'1992-01-01') as bigint)").alias("pos"), F.lit("AC").alias("ref"))
    return V.to_intervals(r, 5, 3).select("contig", F.col("start").cast("long").alias("start"), "stop")


@query(f"""WITH {PARTS}, w AS (SELECT id, seq, e, min(levenshtein(substring(seq, b + 1, e - b), 'GTAC')) AS dist FROM parts, range(1, 17) AS t(e), range(0, 17) AS u(b) WHERE b <= e GROUP BY id, seq, e),
    k AS (SELECT id, e, dist, row_number() OVER (PARTITION BY id ORDER BY dist, e) AS k FROM w WHERE dist <= 1) SELECT id, e::BIGINT AS stop, dist::BIGINT AS errors FROM k WHERE k = 1""")
def approximate_search(spark, d):
    def run(frames):
        for f in frames:
            hits = [D.bitap(s, "GTAC", 1) for s in f["seq"]]
            yield f[["id"]].assign(stop=[h and h[0] for h in hits], errors=[h and h[1] for h in hits]).dropna().astype("int64")

    return parts(spark, d).mapInPandas(run, "id long, stop long, errors long")


@query(f"""WITH {PARTS}, f AS (SELECT id, seq, unnest(list_transform(range(1, 9), lambda i: substring(seq, i, 9))) AS kmer FROM parts), x AS (SELECT DISTINCT kmer FROM f UNION SELECT DISTINCT reverse(translate(kmer, 'ACGT', 'TGCA')) FROM f),
    s AS (SELECT kmer, EXISTS (SELECT 1 FROM f WHERE f.kmer = x.kmer) AS fwd, EXISTS (SELECT 1 FROM f WHERE reverse(translate(f.kmer, 'ACGT', 'TGCA')) = x.kmer) AS rev FROM x),
    r AS (SELECT id, unnest(list_transform(range(1, 9), lambda i: substring(CASE WHEN id % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END, i, 9))) AS kmer, unnest(range(1, 9)) AS i FROM parts),
    v AS (SELECT r.id, count(*) FILTER (fwd <> rev) AS n, coalesce(sum(CASE WHEN fwd AND NOT rev THEN 1 WHEN rev AND NOT fwd THEN -1 ELSE 0 END), 0) AS diff FROM r LEFT JOIN s USING (kmer) GROUP BY r.id)
    SELECT id, CASE WHEN n < 3 OR abs(diff) <= 2 * sqrt(n) THEN 'unknown' WHEN diff > 0 THEN 'forward' ELSE 'reverse' END AS strand FROM v""")
def strand_classification(spark, d):
    """By all k-mers of a read, exactly; a filter has false hits, and stops at the first significant difference."""
    p = parts(spark, d)
    reads = p.select("id", F.when(F.col("id") % 2 == 0, F.col("seq")).otherwise(S.reverse_complement("seq")).alias("seq"))
    return D.strands_of_votes(reads, D.strand_index(p, "seq", 9), "id", "seq", 9)
