"""Duplex tag, adapter and demultiplexing-metric queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plexframe.functions import duplex as X
from plexframe.operators import adapters as A, demux as D
from plexframe.plans.demux_queries import DNA, PARTS, dna, parts
from plexframe.plans.views import READS, query, reads, table

CODES = "ACEHKRV"
#: A tag of every line: overhangs of the first and the second strand, a code between two runs.
TAGS = f"""t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 4 AS a, l_partkey % 3 + 2 AS m, l_suppkey % 3 + 1 AS n, l_partkey % 4 AS b, substring('{CODES}', (l_partkey % 7 + 1)::INTEGER, 1) AS c, {DNA.format('(l_orderkey * 7919)')} || {DNA.format('(l_partkey * 104729)')} AS s FROM lineitem),
    y AS (SELECT *, CASE WHEN a > 0 THEN a::VARCHAR ELSE '' END || '+' || m::VARCHAR || c || n::VARCHAR || '-' || CASE WHEN b > 0 THEN b::VARCHAR ELSE '' END AS yc, substring(s, 1, (a + m + 1 + n + b)::INTEGER) AS seq FROM t)"""


def tags(spark, d):
    c = F.col
    t = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_linenumber") % 4).alias("a"), (c("l_partkey") % 3 + 2).alias("m"), (c("l_suppkey") % 3 + 1).alias("n"), (c("l_partkey") % 4).alias("b"), F.expr(f"substring('{CODES}', cast(l_partkey % 7 + 1 as int), 1)").alias("c"), F.concat(dna(c("l_orderkey") * 7919), dna(c("l_partkey") * 104729)).alias("s"))
    text = lambda x: F.when(c(x) > 0, c(x).cast("string")).otherwise("")
    return t.select("id", "a", "m", "n", "b", "c", F.concat(text("a"), F.lit("+"), c("m").cast("string"), "c", c("n").cast("string"), F.lit("-"), text("b")).alias("yc"), F.expr("substring(s, 1, cast(a + m + 1 + n + b as int))").alias("seq"))


def _table(codes: dict[str, str]) -> str:
    return "CASE c " + " ".join(f"WHEN '{k}' THEN '{codes[k]}'" for k in CODES) + " END"


SAME = [c for c in CODES if X.FIRST[c] == X.SECOND[c]]


@query(f"""WITH {TAGS} SELECT id, substring(seq, 1, (a + m)::INTEGER) || replace({_table(X.FIRST)}, '-', '') || substring(seq, (a + m + 2)::INTEGER, n::INTEGER) AS r1,
    substring(seq, (a + 1)::INTEGER, m::INTEGER) || replace({_table(X.SECOND)}, '-', '') || substring(seq, (a + m + 2)::INTEGER, (n + b)::INTEGER) AS r2, repeat('s', a::INTEGER) || repeat('c', m::INTEGER) || CASE WHEN c IN ({", ".join(repr(c) for c in SAME) or "''"}) THEN 'c' ELSE 'd' END || repeat('c', n::INTEGER) || repeat('s', b::INTEGER) AS types FROM y""")
def duplex_strands(spark, d):
    return tags(spark, d).select("id", X.decoded("seq", "yc").alias("x")).select("id", "x.*")


@query(f"""WITH {TAGS}, z AS (SELECT *, CASE WHEN b > 0 THEN b::VARCHAR ELSE '' END AS bt, CASE WHEN c IN ({", ".join(repr(c) for c in SAME) or "''"}) THEN (m + 1 + n)::VARCHAR ELSE m::VARCHAR || 'X' || n::VARCHAR END AS body FROM y)
    SELECT id, bt || '-' || n::VARCHAR || {_table(X.REVERSED)} || m::VARCHAR || '+' || CASE WHEN a > 0 THEN a::VARCHAR ELSE '' END AS reversed, '+' || (m - 1)::VARCHAR || c || CASE WHEN n > 1 THEN (n - 1)::VARCHAR ELSE '' END || '-' AS trimmed, CASE WHEN a > 0 THEN a::VARCHAR ELSE '' END || '+' || body || '+' || bt AS again FROM z""")
def duplex_tag_forms(spark, d):
    return tags(spark, d).select("id", X.transformed("yc", F.col("a") + 1, F.col("b") + 1).alias("x")).select("id", "x.*")


@query(f"""WITH {READS}, r AS (SELECT read_id, start, mapq % 4 AS s, 5 + errors AS m, part % 12 AS lead, molecule % 5 AS tail FROM reads), k AS (SELECT *, lead - s AS inside FROM r)
    SELECT read_id, start + CASE WHEN lead <= s THEN 0 WHEN inside < m THEN inside WHEN inside = m THEN m + 2 ELSE inside + 2 END AS start, CASE WHEN lead = 0 AND tail = 0 THEN 0 ELSE lead END AS first FROM k""")
def alignment_trim(spark, d):
    """A clip, a match, a deletion of two and a match of thirty: the start moves over what is cut."""
    c = F.col
    r = reads(spark, d).select("read_id", "start", (c("mapq") % 4).alias("s"), (5 + c("errors")).alias("m"), (c("part") % 12).alias("lead"), (c("molecule") % 5).alias("tail"))
    cigar = F.concat(F.when(c("s") > 0, F.concat(c("s").cast("string"), F.lit("S"))).otherwise(""), c("m").cast("string"), F.lit("M2D30M"))
    return r.select("read_id", X.trimmed_alignment("start", cigar, "lead", "tail").alias("x")).select("read_id", "x.start", "x.first")


SIDES = """s AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 5 > 0 THEN l_suppkey % 6 END AS s5, l_linenumber % 3 AS e5, CASE WHEN l_partkey % 3 > 0 THEN 'u' || (l_partkey % 4) END AS u5, CASE WHEN l_suppkey % 4 > 0 THEN l_orderkey % 6 END AS s3, l_partkey % 3 AS e3, CASE WHEN l_orderkey % 3 > 0 THEN 'v' || (l_orderkey % 4) END AS u3 FROM lineitem)"""


@query(f"""WITH {SIDES}, k AS (SELECT *, s5 IS NOT NULL AND s3 IS NOT NULL AS both_, coalesce(s5 IS NOT NULL AND s3 IS NOT NULL AND e3 < e5, false) AS three FROM s), a AS (SELECT *, both_ AND s5 <> s3 AS apart FROM k)
    SELECT id, CASE WHEN u5 IS NOT NULL OR u3 IS NOT NULL THEN CASE WHEN s5 IS NOT NULL AND NOT three THEN s5 ELSE coalesce(s3, s5) END END AS barcode, CASE WHEN coalesce(apart AND three, false) THEN NULL ELSE u5 END AS umi5, CASE WHEN coalesce(apart AND NOT three, false) THEN NULL ELSE u3 END AS umi3,
    s5 IS NOT NULL AND NOT coalesce(apart AND three, false) AS trim5, s3 IS NOT NULL AND NOT coalesce(apart AND NOT three, false) AS trim3 FROM a""")
def umi_assignment(spark, d):
    c = F.col
    s = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.when(c("l_partkey") % 5 > 0, c("l_suppkey") % 6).alias("s5"), (c("l_linenumber") % 3).alias("e5"), F.when(c("l_partkey") % 3 > 0, F.concat(F.lit("u"), c("l_partkey") % 4)).alias("u5"), F.when(c("l_suppkey") % 4 > 0, c("l_orderkey") % 6).alias("s3"), (c("l_partkey") % 3).alias("e3"), F.when(c("l_orderkey") % 3 > 0, F.concat(F.lit("v"), c("l_orderkey") % 4)).alias("u3"))
    out = A.with_umis(c("s5"), c("e5"), c("u5"), c("s3"), c("e3"), c("u3"), True)
    return s.select("id", *[v.alias(k) for k, v in out.items()])


HITS = "h AS (SELECT l_orderkey AS read, CASE WHEN l_linestatus = 'O' THEN 5 ELSE 3 END AS side, l_suppkey % 4 AS barcode, (l_quantity - 10)::BIGINT AS score, l_partkey % 50 AS pos FROM lineitem)"


@query(f"""WITH {HITS}, b AS (SELECT read, side, barcode, max(ROW(score, pos)) AS b FROM h GROUP BY ALL), five AS (SELECT read, barcode, b[1] AS s5, b[2] AS p5 FROM b WHERE side = 5), three AS (SELECT read, barcode, b[1] AS s3, b[2] AS p3 FROM b WHERE side = 3), j AS (SELECT * FROM five FULL JOIN three USING (read, barcode)),
    g AS (SELECT read, max(CASE WHEN p5 < p3 AND s5 + s3 >= 14 THEN ROW(s5 + s3, -barcode) END) AS pr, max(CASE WHEN s5 >= 14 THEN ROW(s5, -barcode) END) AS f, max(CASE WHEN s5 IS NULL AND s3 >= 14 THEN ROW(s3, -barcode) END) AS t, max(s5) AS t5, max(s3) AS t3 FROM j GROUP BY read),
    w AS (SELECT *, pr IS NOT NULL AND pr[1] >= coalesce(t5, -1000) AND pr[1] >= coalesce(t3, -1000) AS pair, f IS NOT NULL AND (t IS NULL OR f[1] >= t[1]) AS five FROM g)
    SELECT read, CASE WHEN pair THEN -pr[2] WHEN five THEN -f[2] ELSE -t[2] END AS barcode, CASE WHEN pair THEN 'pair' WHEN five THEN 'five' ELSE 'three' END AS side, CASE WHEN pair THEN pr[1] WHEN five THEN f[1] ELSE t[1] END AS score FROM w WHERE pair OR five OR t IS NOT NULL""")
def scored_assignment(spark, d):
    c = F.col
    h = table(spark, d, "lineitem").select(c("l_orderkey").alias("read"), F.when(c("l_linestatus") == "O", 5).otherwise(3).alias("side"), (c("l_suppkey") % 4).alias("barcode"), (c("l_quantity") - 10).cast("long").alias("score"), (c("l_partkey") % 50).alias("pos"), F.lit(100).alias("length"))
    return A.best_assignment(h, ["read"], 12 + A.space_penalty(c("length"), 4, 4).cast("long") + 1, True)


@query("""WITH h AS (SELECT l_orderkey AS read, l_linestatus AS s, l_suppkey % 4 AS barcode, l_linenumber % 3 AS edits, l_partkey % 9 - 4 AS off FROM lineitem), j AS (SELECT a.read, a.barcode, ([0, 2, 4])[a.edits + 1] + CASE WHEN a.edits > 0 THEN abs(a.off) ELSE 0 END + 2 * CASE WHEN b.off < 0 THEN 1 - b.off ELSE b.off END + ([0, 2, 4])[b.edits + 1] AS error FROM h a JOIN h b ON a.read = b.read AND a.barcode = b.barcode AND a.s = 'O' AND b.s = 'F')
    SELECT read, barcode, error::BIGINT AS error FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY error, barcode) AS k FROM j) WHERE k = 1 AND error <= 7""")
def hairpin_barcode_pairs(spark, d):
    c = F.col
    h = table(spark, d, "lineitem").select(c("l_orderkey").alias("read"), c("l_linestatus").alias("s"), (c("l_suppkey") % 4).alias("barcode"), (c("l_linenumber") % 3).alias("edits"), (c("l_partkey") % 9 - 4).alias("off"))
    return A.best_pairs(h.where("s = 'O'"), h.where("s = 'F'"), ["read"])


LOOP = "GATTACAGGCAT"


@query(f"""WITH {PARTS} SELECT id, 'exact' AS method, (16 + id % 5)::BIGINT AS start, (28 + id % 5)::BIGINT AS stop FROM parts""")
def hairpin_exact(spark, d):
    """A loop between a part's bases and their reverse complement, behind a few other ones."""

    def run(frames):
        for f in frames:
            out = [A.find_hairpin("C" * (k % 5) + s + LOOP + A.reverse_complement(s), LOOP) for k, s in zip(f["id"], f["seq"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "method": [m for m, _, _ in out], "start": [a for _, a, _ in out], "stop": [b for _, _, b in out]})

    return parts(spark, d).mapInPandas(run, "id long, method string, start long, stop long")


@query()
def flank_scores(spark, d):
    """Flanks against a fixed reference, an automaton of scores; tested against plain alignment."""

    def run(frames):
        for f in frames:
            out = [A.classify(s, "ACGTAC", 12) for s in f["seq"]]
            yield pd.DataFrame({"id": f["id"], "pos": [o["best"][0] for o in out], "score": [o["best"][1] for o in out], "remaining": [o["remaining"] for o in out], "finish": [o["end"] for o in out]})

    return parts(spark, d).mapInPandas(run, "id long, pos long, score long, remaining long, finish string")


BARCODES = {"ACGTAC": 1, "GTACGT": 2, "CCATGA": 3}


@query(f"""WITH {PARTS}, b AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {k})" for s, k in BARCODES.items())}) AS b(sequence, barcode)), w AS (SELECT id, i AS start, i + n AS stop, n, b.barcode, levenshtein(substring(seq, i + 1, n), b.sequence) AS e FROM parts, range(0, 12) AS t(i), range(5, 8) AS u(n), b WHERE i + n <= length(seq)),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, e, n DESC, barcode) AS k FROM w WHERE e <= 1) SELECT id, start::BIGINT AS start, stop::BIGINT AS stop, barcode::BIGINT AS barcode, e::BIGINT AS edits FROM k WHERE k = 1""")
def free_barcode_scan(spark, d):
    forms: dict[str, tuple[int, int]] = {}
    for s, k in BARCODES.items():
        for form, e in D.edited(s, 1).items():
            forms[form] = min(forms.get(form, (k, e)), (k, e), key=lambda x: (x[1], x[0]))

    def run(frames):
        for f in frames:
            rows = [(k, *hit) for k, s in zip(f["id"], f["seq"], strict=True) if (hit := A.scan(s, forms, (5, 7)))]
            yield pd.DataFrame(rows, columns=["id", "start", "stop", "barcode", "edits"]).astype("int64")

    return parts(spark, d).mapInPandas(run, "id long, start long, stop long, barcode long, edits long")


@query(f"""WITH {PARTS}, u AS (SELECT * FROM (VALUES ('ACG', 1), ('GTA', 2), ('CCA', 3)) AS u(s, umi)), w AS (SELECT id, umi, i AS start, abs(i - 4) AS off FROM parts, u, range(1, 8) AS t(i) WHERE substring(seq, i + 1, 3) = s) SELECT id, umi::BIGINT AS umi, start::BIGINT AS start, 0::BIGINT AS edits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off, start) AS k FROM w) WHERE k = 1""")
def umi_near_expected(spark, d):
    def run(frames):
        for f in frames:
            rows = [(k, *hit) for k, s in zip(f["id"], f["seq"], strict=True) if (hit := A.trim_umi(s, {"ACG": (1, 0), "GTA": (2, 0), "CCA": (3, 0)}, 3, 4, 3))]
            yield pd.DataFrame(rows, columns=["id", "umi", "start", "edits"]).astype("int64")

    return parts(spark, d).mapInPandas(run, "id long, umi long, start long, edits long")


@query("""WITH c AS (SELECT DISTINCT a, b FROM (SELECT substring('ACGT', (l_partkey % 4 + 1)::INTEGER, 1) AS a, substring('ACGT', (l_suppkey % 4 + 1)::INTEGER, 1) AS b FROM lineitem)) SELECT a, b, CASE WHEN a = 'T' AND b = 'C' THEN 'C' WHEN a = 'A' AND b = 'G' THEN 'G' ELSE a END AS converted FROM c""")
def methyl_conversion(spark, d):
    pick = lambda c: F.expr(f"substring('ACGT', cast({c} % 4 + 1 as int), 1)")
    c = table(spark, d, "lineitem").select(pick("l_partkey").alias("a"), pick("l_suppkey").alias("b")).distinct()
    return c.select("a", "b", A.methyl_converted(F.col("a"), F.col("b")).alias("converted"))


_M = """m AS (SELECT l_suppkey % 8 AS sample, l_quantity AS length, ([NULL, 'exact', 'exact', 'global', 'local'])[l_partkey % 5 + 1] AS hairpin, l_linenumber < 6 AS assigned, l_tax > 0.06 AS failed, l_quantity - 2 AS trimmed, l_quantity - l_linenumber AS conc, l_linenumber AS disc FROM lineitem)"""
_COUNTS = {"reads": "count(*)", "bases": "sum(length)", "assigned": "count(*) FILTER (assigned)", "failed": "count(*) FILTER (failed)", "passing": "count(*) FILTER (assigned AND NOT failed)", "no_hairpin": "count(*) FILTER (hairpin IS NULL)"} | {f"hairpin_{k}": f"count(*) FILTER (hairpin = '{k}')" for k in ("exact", "global", "local")} | {"passing_bases": "coalesce(sum(trimmed) FILTER (assigned AND NOT failed), 0)", "concordant": "coalesce(sum(conc) FILTER (assigned AND NOT failed), 0)", "discordant": "coalesce(sum(disc) FILTER (assigned AND NOT failed), 0)"}
_SHARES = {f"percent_{a}": f"round(100 * {a} / nullif({b}, 0), 6)" for a, b in (("assigned", "reads"), ("failed", "reads"), ("passing", "reads"), ("no_hairpin", "reads"), ("hairpin_exact", "reads"), ("hairpin_global", "reads"), ("hairpin_local", "reads"), ("passing_bases", "bases"))} | {"percent_discordant": "round(100 * discordant / nullif(concordant + discordant, 0), 6)"}


@query(f"""WITH {_M}, c AS (SELECT sample, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _COUNTS.items())} FROM m GROUP BY sample), x AS (SELECT sample, unnest([{", ".join(repr(k) for k in (*_COUNTS, *_SHARES))}]) AS metric, unnest([{", ".join((*_COUNTS, *_SHARES.values()))}]) AS value FROM c) SELECT * FROM x""")
def duplex_run_metrics(spark, d):
    c = F.col
    hairpin = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("exact", "exact", "global", "local"))), (c("l_partkey") % 5 + 1).cast("int"))
    r = table(spark, d, "lineitem").select((c("l_suppkey") % 8).alias("sample"), c("l_quantity").alias("length"), hairpin.alias("hairpin"), (c("l_linenumber") < 6).alias("assigned"), (c("l_tax") > 0.06).alias("failed"), (c("l_quantity") - 2).alias("trimmed"), (c("l_quantity") - c("l_linenumber")).alias("concordant"), c("l_linenumber").alias("discordant"))
    return A.duplex_metrics(r, "sample")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, 'r' || l_orderkey || ' ' || coalesce((CASE WHEN l_partkey % 4 > 0 THEN l_suppkey % 6 END)::VARCHAR, '*') || '|' || (CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 10 THEN 2 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 4 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 8 ELSE 0 END)::VARCHAR || '|' || CASE WHEN l_discount > 0.05 THEN 'ACG' ELSE '*' END || '|*' AS header FROM lineitem")
def demux_headers(spark, d):
    c = F.col
    found = [c("l_tax") > 0.02, c("l_quantity") > 10, c("l_discount") > 0.05, c("l_quantity") > 40]
    h = A.header(F.concat(F.lit("r"), c("l_orderkey")), F.when(c("l_partkey") % 4 > 0, c("l_suppkey") % 6), found, F.when(c("l_discount") > 0.05, "ACG"), F.lit(None).cast("string"))
    return table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), h.alias("header"))


@query("WITH r AS (SELECT l_suppkey % 8 AS sample, CASE WHEN l_quantity > 30 THEN '30+' ELSE l_quantity::BIGINT::VARCHAR END AS length FROM lineitem) SELECT sample, length, count(*) AS reads FROM r GROUP BY ALL")
def demux_length_distribution(spark, d):
    from plexframe.operators.reads import capped

    r = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("sample"), F.col("l_quantity").cast("long").alias("n"))
    return r.groupBy("sample", capped("n", 30).alias("length")).agg(F.count("*").alias("reads"))


@query()
def repeat_genotypes(spark, d):
    """Two repeat counts per locus (supplier) from its spanning, flanking and inside reads; tested on made loci."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        kinds = {k: dict(zip(g["count"], g["n"], strict=True)) for k, g in f.groupby("kind")}
        a, b = A.repeat_genotype(kinds.get("span", {}), kinds.get("flank", {}), sum(kinds.get("inside", {}).values()))
        return pd.DataFrame({"locus": f["locus"].iloc[:1], "first": [a], "second": [b]})

    c = F.col
    t = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("locus"), F.when(c("l_returnflag") == "N", "span").when(c("l_returnflag") == "A", "flank").otherwise("inside").alias("kind"), (c("l_suppkey") % 9 + c("l_partkey") % 2 * 3).alias("count")).agg(F.count("*").alias("n"))
    return t.groupBy("locus").applyInPandas(run, "locus long, first long, second long")


@query(f"""WITH {PARTS}, b AS (SELECT * FROM (VALUES ('ACGTAC', 1), ('GTACGT', 2), ('CCATGA', 3)) AS b(s, k)), w AS (SELECT id, o, k, list_sum(list_transform(range(1, 7), lambda i: (substring(seq, o + i, 1) <> substring(s, i, 1))::INTEGER)) AS d FROM parts, b, range(0, 4) AS t(o)),
    m AS (SELECT id, min(d) AS d FROM w WHERE d <= 1 GROUP BY id), g AS (SELECT w.id, w.d, count(DISTINCT k) AS n, min(ROW(o, k)) AS b FROM w JOIN m ON w.id = m.id AND w.d = m.d GROUP BY ALL) SELECT id, b[2]::BIGINT AS barcode_id, b[1]::BIGINT AS "offset", d::BIGINT AS distance FROM g WHERE n = 1""")
def fast_barcode_match(spark, d):
    """All forms of six bases: substitutions, and an insertion with a deletion counts as two edits, so only one-edit forms of equal length match."""
    b = spark.createDataFrame([(k, s) for s, k in BARCODES.items()], "barcode_id long, sequence string")
    return D.fast_match(parts(spark, d), b, "seq", ["id"], range(4))
