"""Round trips of readers and writers: every query writes files to the shared folder and returns what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexframe.plans.consensus_queries import CLUSTER, cluster_table
from plexframe.plans.demux_queries import PARTS, parts
from plexframe.plans.views import LENGTH, REGIONS, lengths, query, regions, table
from plexframe.session import Scratch, dealt
from plexframe.sources import binary, readers, writers


def place(spark, name: str) -> str:
    return f"{Scratch(spark).root}/{name}"


@query(f"WITH {REGIONS} SELECT 'chr' || contig AS contig, start, stop, 'g' || (start // 90) AS extra FROM regions")
def bed_round_trip(spark, d):
    path = place(spark, "a.bed")
    writers.bed(regions(spark, d).select(F.concat(F.lit("chr"), "contig").alias("contig"), "start", "stop", F.concat(F.lit("g"), F.floor(F.col("start") / 90)).alias("name")), path, ["name"])
    return readers.bed(spark, path, True).select("contig", "start", "stop", F.col("extra")[0].alias("extra"))


@query(f"WITH {REGIONS} SELECT contig::VARCHAR AS contig, start, stop FROM regions")
def region_strings(spark, d):
    text = regions(spark, d).select(F.when(F.col("start") % 180 == 0, F.format_string("%d:%,d-%d", "contig", F.col("start") + 1, "stop")).otherwise(F.format_string("%d\t%d\t%d", "contig", "start", "stop")).alias("t"))
    return text.select(readers.region(F.col("t")).alias("r")).select("r.*")


@query(f"SELECT s_suppkey::VARCHAR AS contig, (row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT AS rank, {LENGTH}::BIGINT AS length FROM supplier")
def contig_index(spark, d):
    path = place(spark, "a.fai")
    rows = lengths(spark, d)
    writers.write_text(writers.ordered_lines(rows.select(writers.row_text(["contig", "length"]).alias("value"), "contig"), [], ["contig"]).coalesce(1), path)
    return readers.contig_lengths(spark, path).select("contig", "rank", "length")


@query(f"WITH {REGIONS} SELECT contig, start, least(stop, 3000)::BIGINT AS stop FROM regions WHERE start < 3000")
def regions_on_contigs(spark, d):
    known = lengths(spark, d).withColumn("length", F.lit(3000).cast("long"))
    return readers.on_contigs(regions(spark, d).where("start < 3000"), known)


@query(f"SELECT s_suppkey::VARCHAR AS contig, 0::BIGINT AS start, {LENGTH}::BIGINT AS stop FROM supplier UNION ALL SELECT NULL, 0, 0")
def target_regions(spark, d):
    return readers.collapser_regions(lengths(spark, d))


@query(f"WITH {PARTS} SELECT id, substring(seq, 3, 9) AS seq, 16::BIGINT AS length FROM parts")
def fasta_slices(spark, d):
    path = place(spark, "a.fa")
    p = parts(spark, d)
    text = F.concat(F.lit(">c"), "id", F.lit(" x\n"), F.lower(F.substring("seq", 1, 7)), F.lit("\n"), F.substring("seq", 8, 20))
    writers.write_text(p.select(text.alias("value")), path)
    pieces = readers.fasta(spark, path)
    where = p.select(F.concat(F.lit("c"), "id").alias("contig"), F.lit(2).cast("long").alias("start"), F.lit(11).cast("long").alias("stop"), "id")
    size = pieces.groupBy("contig").agg(F.sum(F.length("seq")).alias("length"))
    return readers.slice_sequence(pieces, where.drop("id")).join(size, "contig").select(F.substring("contig", 2, 20).cast("long").alias("id"), "seq", "length")


@query(f"WITH {PARTS} SELECT 'r' || id AS name, seq, repeat('I', 16) AS qual FROM parts")
def fastq_round_trip(spark, d):
    path = place(spark, "fastq")
    writers.fastq(parts(spark, d).select(F.concat(F.lit("r"), "id").alias("name"), "seq", F.expr("repeat('I', 16)").alias("qual")), path)
    return readers.fastq(spark, path)


@query(f"WITH {PARTS} SELECT (id % 3)::INTEGER AS sample, count(*) AS reads, sum(length(seq))::BIGINT AS bases FROM parts GROUP BY 1")
def fastq_by_sample(spark, d):
    path = place(spark, "samples")
    writers.fastq(parts(spark, d).select(F.concat(F.lit("r"), "id").alias("name"), "seq", F.expr("repeat('I', 16)").alias("qual"), (F.col("id") % 3).alias("sample")), path, "sample")
    out = None
    for k in range(3):
        own = readers.fastq(spark, f"{path}/sample={k}").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases")).select(F.lit(k).alias("sample"), "reads", "bases")
        out = own if out is None else out.unionByName(own)
    return out


def _sam(spark, d):
    c = cluster_table(spark, d)
    return c.select(F.concat_ws("-", F.lit("q"), "cluster", "read").alias("qname"), F.when(F.col("forward"), 0).otherwise(16).alias("flag"), (F.col("cluster") % 7).cast("string").alias("contig"), (F.col("start") + F.col("cluster") % 50).cast("long").alias("pos"), (F.col("read") * 9).cast("int").alias("mapq"), "cigar", "seq", F.expr("repeat('I', 16)").alias("qual"), F.create_map(F.lit("NM"), F.col("read").cast("string"), F.lit("YC"), F.lit("2+12-2")).alias("tags"))


SAM = f"WITH {CLUSTER} SELECT 'q-' || cluster || '-' || read AS qname, CASE WHEN forward THEN 0 ELSE 16 END::INTEGER AS flag, (cluster % 7)::VARCHAR AS contig, (start + cluster % 50)::BIGINT AS pos, (read * 9)::INTEGER AS mapq, cigar, seq, repeat('I', 16) AS qual, read::INTEGER AS nm, '2+12-2' AS yc FROM rd"


def _read(a):
    return a.select("qname", "flag", "contig", "pos", "mapq", "cigar", "seq", "qual", readers.tag(F.col("tags"), "NM", "int").alias("nm"), readers.tag(F.col("tags"), "YC").alias("yc"))


def _contigs(spark):
    return spark.createDataFrame([(str(k), 1000, k) for k in range(7)], "contig string, length long, rank long")


@query(SAM)
def sam_round_trip(spark, d):
    path = place(spark, "a.sam")
    writers.sam(_sam(spark, d), path, _contigs(spark))
    return _read(readers.alignments(spark, path))


@query(SAM)
def bam_round_trip(spark, d):
    """Blocks of compressed members, encoded and decoded partition by partition."""
    return _read(binary.decode(binary.encode(dealt(_sam(spark, d)), [(str(k), 1000) for k in range(7)])))


_ALT = "CASE l_partkey % 3 WHEN 0 THEN 'C,G' WHEN 1 THEN 'CA' ELSE 'T' END"
VCF = f"""v AS (SELECT DISTINCT 'c' || (l_suppkey % 9) AS contig, l_partkey * 10 + l_linenumber AS pos, 'A' AS ref, {_ALT} AS alts, l_linenumber / 2.0 AS qual, CASE WHEN l_linenumber > 3 THEN 'PASS' ELSE 'q10;low' END AS filter, l_linenumber AS dp FROM lineitem)"""


def _vcf(spark, d):
    c = F.col
    alts = F.when(c("l_partkey") % 3 == 0, F.array(F.lit("C"), F.lit("G"))).when(c("l_partkey") % 3 == 1, F.array(F.lit("CA"))).otherwise(F.array(F.lit("T")))
    dp = F.array(c("l_linenumber").cast("string"))
    own = table(spark, d, "lineitem").select((c("l_suppkey") % 9).alias("k"), "l_partkey", "l_linenumber").distinct()  # all that a record is made of
    return own.select(
        F.concat(F.lit("c"), "k").alias("contig"), (c("l_partkey") * 10 + c("l_linenumber")).alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("A").alias("ref"), alts.alias("alts"), (c("l_linenumber") / 2.0).alias("qual"), F.when(c("l_linenumber") > 3, F.array(F.lit("PASS"))).otherwise(F.array(F.lit("q10"), F.lit("low"))).alias("filters"),
        F.create_map(F.lit("DP"), dp, F.lit("DB"), F.array().cast("array<string>")).alias("info"), F.array(F.struct(F.lit("s1").alias("name"), F.create_map(F.lit("GT"), F.array(F.when(c("l_linenumber") > 3, "0/1").otherwise("1|1")), F.lit("AD"), F.array(F.lit("3"), c("l_linenumber").cast("string"))).alias("format"))).alias("samples"))


HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="x">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="x">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">', '##FILTER=<ID=low,Description="x">', *[f"##contig=<ID=c{k},length=9000000>" for k in range(9)]]


def _written(spark, d) -> str:
    path = place(spark, "a.vcf")
    order = spark.createDataFrame([(f"c{k}", k) for k in range(9)], "contig string, rank long")
    writers.vcf(_vcf(spark, d), path, HEAD, order, ["s1"])
    return path


@query(f"WITH {VCF} SELECT contig, pos, ref, alts, qual::DOUBLE AS qual, filter AS filters, dp::INTEGER AS dp, true AS db, CASE WHEN dp > 3 THEN '0/1' ELSE '1|1' END AS gt, '3,' || dp AS ad FROM v")
def vcf_round_trip(spark, d):
    v = readers.vcf(spark, _written(spark, d), ["s1"])
    own = F.col("samples")[0]["format"]
    return v.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), "qual", F.array_join("filters", ";").alias("filters"), readers.info_values(F.col("info"), "DP", "int")[0].alias("dp"), readers.info_values(F.col("info"), "DB", "flag").alias("db"), own["GT"][0].alias("gt"), F.array_join(own["AD"], ",").alias("ad"))


@query("SELECT unnest(['AD', 'DB', 'DP', 'GT']) AS id, unnest(['R', '0', '1', '1']) AS number, unnest(['Integer', 'Flag', 'Integer', 'String']) AS type")
def vcf_metadata(spark, d):
    head = readers.vcf_header(spark, _written(spark, d))
    return spark.createDataFrame([(k, *v) for k, v in {**head["info"], **head["format"]}.items()], "id string, number string, type string")


@query(f"WITH {VCF} SELECT contig || '_' || (pos + 1) || '_A_' || alt AS key FROM (SELECT DISTINCT contig, pos, unnest(string_split(alts, ',')) AS alt FROM v)")
def hotspot_keys(spark, d):
    return readers.hotspots(readers.vcf(spark, _written(spark, d)))


@query(f"WITH {VCF} SELECT contig, pos, alts FROM v WHERE contig = 'c3' AND pos < 900 AND pos + 1 > 100")
def vcf_region(spark, d):
    return readers.in_region(readers.vcf(spark, _written(spark, d)), "c3", 100, 900).select("contig", "pos", F.array_join("alts", ",").alias("alts"))


@query(f"WITH {VCF} SELECT DISTINCT CASE WHEN dp > 3 THEN '0/1' ELSE '1/1' END AS gt, contig || '_' || (pos + 1) || '_A_' || string_split(alts, ',')[1] AS key FROM v")
def truth_sets(spark, d):
    return readers.genotype_sets(readers.vcf(spark, _written(spark, d), ["s1"]))


def _table(spark, d, name, df, schema, order):
    path = place(spark, name)
    writers.tsv(df, path, {"command": "x"}, order)
    return readers.table(spark, path, schema)


NUMBERS = f"WITH {REGIONS} SELECT contig::VARCHAR AS contig, start, stop"


@query(NUMBERS + ", start / 4.0 AS counts, start / 2.0 AS total_coverage, start % 180 = 0 AS on_target, (contig % 60)::DOUBLE AS mean_mapq FROM regions")
def coverage_table(spark, d):
    g = regions(spark, d).select("contig", "start", "stop", (F.col("start") / 4.0).alias("counts"), (F.col("start") / 2.0).alias("total_coverage"), (F.col("start") % 180 == 0).alias("on_target"), (F.col("contig") % 60).cast("double").alias("mean_mapq"))
    return _table(spark, d, "cov.tsv", g, readers.COVERAGE, ["contig", "start"])


@query(NUMBERS + ", (start % 100) / 100.0 AS gc, 1.0 AS mappability, contig % 2 = 0 AS on_target FROM regions")
def interval_table(spark, d):
    g = regions(spark, d).select("contig", "start", "stop", (F.col("start") % 100 / 100.0).alias("gc"), F.lit(1.0).alias("mappability"), (F.col("contig") % 2 == 0).alias("on_target"))
    return _table(spark, d, "int.tsv", g, readers.INTERVALS, ["contig", "start"])


@query(NUMBERS + ", start / 8.0 AS value FROM regions")
def observation_table(spark, d):
    return _table(spark, d, "obs.tsv", regions(spark, d).withColumn("value", F.col("start") / 8.0), readers.OBSERVATIONS, ["contig", "start"])


@query(NUMBERS + ", (start % 30)::INTEGER AS ref_ad, (contig % 30)::INTEGER AS alt_ad FROM regions")
def depth_table(spark, d):
    g = regions(spark, d).select("contig", "start", "stop", (F.col("start") % 30).cast("int").alias("ref_ad"), (F.col("contig") % 30).cast("int").alias("alt_ad"))
    return _table(spark, d, "baf.tsv", g, readers.DEPTHS, ["contig", "start"])


SEGS = f"WITH {REGIONS} SELECT 's' || start AS id, contig::VARCHAR AS contig, start, stop, start % 40 AS num_log_ratio, start % 7 AS num_snp, start / 64.0 AS mean_log_ratio, contig / 64.0 AS mean_dh, (start % 5)::INTEGER AS tcn, (start % 3)::INTEGER AS mcn FROM regions"


def _segs(spark, d):
    s, k = F.col("start"), F.col("contig")
    return regions(spark, d).select(F.concat(F.lit("s"), s).alias("id"), k.cast("string").alias("contig"), s, "stop", (s % 40).alias("num_log_ratio"), (s % 7).alias("num_snp"), (s / 64.0).alias("mean_log_ratio"), (k / 64.0).alias("mean_dh"), (s % 5).cast("int").alias("tcn"), (s % 3).cast("int").alias("mcn"))


@query(SEGS)
def segment_table(spark, d):
    path, names = place(spark, "a.seg"), [c.split()[0] for c in readers.SEGMENTS.split(", ")]
    writers.segments(_segs(spark, d), path, names)
    return readers.segments(spark, path)


@query(f"WITH s AS ({SEGS}) SELECT contig, start AS pos, stop AS \"end\", CASE WHEN tcn > 2 THEN '<DUP>' WHEN tcn < 2 THEN '<DEL>' ELSE '' END AS alt, tcn::VARCHAR AS cn FROM s")
def segment_vcf(spark, d):
    s = _segs(spark, d).select("contig", "start", "stop", "tcn", "mcn", F.when(F.col("tcn") > 2, "gain").when(F.col("tcn") < 2, "loss").otherwise("ref").alias("status"), F.lit("PASS").alias("flags"))
    r = writers.segment_records(s)
    path = place(spark, "seg.vcf")
    order = s.select("contig").distinct().withColumn("rank", F.col("contig").cast("long"))
    writers.vcf(r, path, ["##fileformat=VCFv4.2"], order, ["sample"])
    v = readers.vcf(spark, path, ["sample"])
    return v.select("contig", "pos", F.col("info")["END"][0].cast("long").alias("end"), F.array_join("alts", ",").alias("alt"), F.col("samples")[0]["format"]["CN"][0].alias("cn"))


@query(f"WITH {REGIONS}, t AS (SELECT contig, start, stop, (start % 7) / 8.0 AS score FROM regions) SELECT g.contig, g.start + 40 AS start, g.stop + 300 AS stop, round(sum((least(g.stop + 300, t.stop) - greatest(g.start + 40, t.start)) * t.score) / sum(least(g.stop + 300, t.stop) - greatest(g.start + 40, t.start)), 6) AS mean FROM regions g JOIN t ON g.contig = t.contig AND g.start + 40 < t.stop AND g.stop + 300 > t.start GROUP BY g.contig, g.start, g.stop")
def track_means(spark, d):
    path = place(spark, "a.bedgraph")
    g = regions(spark, d)
    writers.bedgraph(g.withColumn("score", F.col("start") % 7 / 8.0), path, "score")
    track = readers.table(spark, path, "contig long, start long, stop long, score double", header=False)
    wide = g.select("contig", (F.col("start") + 40).alias("start"), (F.col("stop") + 300).alias("stop"))
    return readers.track_mean(wide, track).withColumn("mean", F.round("mean", 6))


@query("SELECT l_quantity::BIGINT AS q, CASE WHEN l_quantity > 20 THEN '20+' ELSE l_quantity::BIGINT::VARCHAR END AS length, count(*) AS reads FROM lineitem GROUP BY ALL HAVING q < 0 UNION ALL SELECT -1, CASE WHEN l_quantity > 20 THEN '20+' ELSE l_quantity::BIGINT::VARCHAR END, count(*) FROM lineitem GROUP BY 2")
def histogram_file(spark, d):
    path = place(spark, "hist.tsv")
    h = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("length")).agg(F.count("*").alias("reads"))
    writers.histogram(h, path, "length", "reads", 20, {"command": "x"})
    return readers.table(spark, path, "length string, reads long").select(F.lit(-1).cast("long").alias("q"), "length", "reads")


@query("SELECT 0::BIGINT AS rows, 'contig,start,stop' AS names")
def empty_outputs(spark, d):
    path = place(spark, "none.tsv")
    writers.empty_like(regions(spark, d), path, {"command": "x"})
    lines = spark.read.text(path).where("NOT value LIKE '##%'")
    return lines.agg((F.count("*") - 1).alias("rows"), F.max(F.translate("value", "\t", ",")).alias("names"))


@query("SELECT 'n' || n_nationkey AS sample_name, (n_nationkey * 3)::VARCHAR AS sample_sid FROM nation")
def sample_sheet(spark, d):
    path = place(spark, "sheet.csv")
    writers.sheet(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("sample_name"), (F.col("n_nationkey") * 3).cast("string").alias("sample_sid")), path)
    return readers.sample_sheet(spark, path)


@query("SELECT DISTINCT 'c1_' || l_partkey || '_A_C' AS key FROM lineitem")
def block_list(spark, d):
    path = place(spark, "block.txt")
    writers.write_text(table(spark, d, "lineitem").select(F.concat(F.lit("c1_"), "l_partkey", F.lit("_A_C ")).alias("value")), path)
    return readers.block_list(spark, path)


FEATURES = "SELECT 'c' || (l_suppkey % 9) AS chrom, l_partkey AS pos, 'A' AS ref, 'C' AS alt, l_discount AS duplex_af, (l_linenumber * 10)::DOUBLE AS mapq_mean FROM lineitem"


@query(FEATURES)
def feature_table(spark, d):
    path = place(spark, "features.tsv")
    f = table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 9).alias("chrom"), F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit(1).alias("more"), F.col("l_discount").alias("duplex_af"), (F.col("l_linenumber") * 10).alias("mapq_mean"))
    writers.tsv(f, path, {"command": "x"}, ["chrom", "pos"])
    return readers.features(spark, path, ["chrom", "pos", "ref", "alt", "duplex_af", "mapq_mean"])


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS motif FROM customer")
def json_document(spark, d):
    path = place(spark, "loci.json")
    table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("motif")).write.json(path)
    return spark.read.schema("id long, name string, motif long").json(path)


@query("SELECT count(*) AS rows FROM nation")
def expanded_inputs(spark, d):
    root = place(spark, "tree")
    t = table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("part"))
    t.write.partitionBy("part").text(root)
    return spark.read.text(readers.expanded(spark, [root])).where("length(value) > 0").agg(F.count("*").alias("rows"))


@query("SELECT o_custkey % 6 AS sample, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS succeeded, count(*) FILTER (o_orderstatus <> 'F')::BIGINT AS failed, count(*) AS total FROM orders GROUP BY 1")
def sample_status(spark, d):
    """Per sample how many of its steps succeeded."""
    good = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 6).alias("sample")).agg(F.sum(good.cast("long")).alias("succeeded"), F.sum((~good).cast("long")).alias("failed"), F.count("*").alias("total"))
