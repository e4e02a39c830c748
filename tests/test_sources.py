import gzip

import pytest

from plexframe.sources import config, readers, writers
from plexframe.streaming import counters


def put(path, text):
    path.write_text(text)
    return str(path)


def test_bed(spark, tmp_path):
    p = put(tmp_path / "a.bed", "track x\n#c\nchr1\t0\t10\tgene\t5\nchr2\t3\t4\n")
    assert [tuple(r) for r in readers.bed(spark, p, True).orderBy("contig").collect()] == [("chr1", 0, 10, ["gene", "5"]), ("chr2", 3, 4, [])]
    for bad in ("chr1\t5\t5\n", "chr1\t-1\t5\n", "chr1\t5\n", "chr1\tx\t9\n"):
        with pytest.raises(Exception, match="bad interval"):
            readers.bed(spark, put(tmp_path / "b.bed", bad)).collect()


def test_region(spark):
    df = spark.createDataFrame([("chr1:1-10",), ("chr1\t1\t10",), ("x",)], "s string")
    assert [r[0] and tuple(r[0]) for r in df.select(readers.region(df.s)).collect()] == [("chr1", 0, 10), ("chr1", 1, 10), None]


def test_fastq_round_trip(spark, tmp_path):
    records = [(f"r{k}", "ACGT" * (k % 5 + 1), "I@+!" * (k % 5 + 1)) for k in range(200)]
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text(text)
    with gzip.open(tmp_path / "in/b.fastq.gz", "wt") as f:
        f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = readers.fastq(spark, str(tmp_path / "in"))
        assert sorted(map(tuple, df.collect())) == sorted(records * 2)
        writers.fastq(df, str(tmp_path / "out"))
        assert sorted(map(tuple, readers.fastq(spark, str(tmp_path / "out")).collect())) == sorted(records * 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="bad FASTQ"):
        readers.fastq(spark, put(tmp_path / "c.fastq", "@a\nACGT\n+\nII\n")).collect()


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "r.fa", ">c1 x\nacgt\nAC\n>c2\nGG\n")
    pieces = readers.fasta(spark, p)
    assert sorted(map(tuple, pieces.collect())) == [("c1", 0, "ACGT"), ("c1", 4, "AC"), ("c2", 0, "GG")]
    where = spark.createDataFrame([("c1", 2, 6)], "contig string, start long, stop long")
    assert readers.slice_sequence(pieces, where).first()["seq"] == "GTAC"
    fai = readers.contig_lengths(spark, put(tmp_path / "r.fai", "chrX\t6\nchr1\t9\n"))
    assert sorted((r["rank"], r.contig, r.length) for r in fai.collect()) == [(0, "chrX", 6), (1, "chr1", 9)]


VCF = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##FILTER=<ID=low,Description="x">
##contig=<ID=c1,length=100>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1
c1\t5\t.\tA\tC,*\t30.5\tPASS\tAF=0.5,.;DB\tGT:AD\t1/2:3,4
c1\t2\trs\tAC\tA\t.\t.\t.\tGT\t1
"""


def test_vcf_round_trip(spark, tmp_path):
    p = put(tmp_path / "a.vcf", VCF)
    head = readers.vcf_header(spark, p)
    assert head == {"info": {"AF": ("A", "Float"), "DB": ("0", "Flag")}, "format": {}, "filter": ["low"], "samples": ["s1"], "contigs": {"c1": 100}}
    df = readers.vcf(spark, p, head["samples"])
    a, b = df.orderBy("pos").collect()[::-1]
    assert (a.pos, a.alts, a.qual, a.info, a.samples[0].name, a.samples[0].format) == (4, ["C", "*"], 30.5, {"AF": ["0.5", "."], "DB": []}, "s1", {"GT": ["1/2"], "AD": ["3", "4"]})
    assert (b.id, b.qual, b.filters, b.info) == ("rs", None, [], {})
    assert df.where("pos = 4").select(readers.info_values(df.info, "AF"), readers.info_values(df.info, "DB", "flag"), readers.info_values(df.info, "NO")).first() == ([0.5, None], True, [])
    order = spark.createDataFrame([("c1", 0)], "contig string, rank long")
    writers.vcf(df, str(tmp_path / "out"), ["##fileformat=VCFv4.2"], order, ["s1"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == sorted(x for x in VCF.splitlines() if not x.startswith("##") or "fileformat" in x)
    assert sorted(r.key for r in readers.hotspots(df).collect()) == ["c1_2_AC_A", "c1_5_A_*", "c1_5_A_C"]


def test_tables(spark, tmp_path):
    p = put(tmp_path / "a.seg", "#x\nid\tcontig\tstart\tstop\nq\tc1\t1\t9\n")
    df = readers.segments(spark, p, "id string, contig string, start long, stop long")
    assert tuple(df.first()) == ("q", "c1", 0, 9)
    writers.segments(df, str(tmp_path / "seg"), ["id", "contig", "start", "stop"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "seg")).collect()) == ["id\tcontig\tstart\tstop", "q\tc1\t1\t9"]
    f = readers.features(spark, put(tmp_path / "f.tsv", "##m\nchrom\tpos\tx\ty\nc\t3\t1.5\t2\nc\t4\n"), ["chrom", "pos", "y"])
    assert [tuple(r) for r in f.collect()] == [("c", 3, 2.0)]
    with pytest.raises(ValueError, match="missing"):
        readers.features(spark, str(tmp_path / "f.tsv"), ["z"])
    sam = put(tmp_path / "a.sam", "@HD\tVN:1\nr1\t16\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tYF:i:1\tAS:i:3\n")
    assert readers.alignments(spark, sam).first()["tags"] == {"YF": "1", "AS": "3"}


def test_config():
    base = {"a": {"b": 1, "c": True}, "d": "x"}
    assert config.override(config.load('{"d": "y"}', base), "a.b=5") == {"a": {"b": 5, "c": True}, "d": "y"}
    assert config.override(base, "a.c=false")["a"]["c"] is False
    for bad in ("a.z=1", "a.b", "a.c=maybe"):
        with pytest.raises((KeyError, ValueError)):
            config.override(base, bad)
    with pytest.raises(KeyError):
        config.load('{"z": 1}', base)
    assert config.group_by_size({"a": 5, "b": 4, "c": 3, "d": 2}, 2) == [["a", "d"], ["b", "c"]]
    assert config.unique_name("run", {"run", "run-2"}) == "run-3"
    assert "a&amp;b" in writers.session_xml(["a&b"])


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = counters.windowed(counters.read_stream(spark, str(tmp_path / "in"), events), "ts", ["event_type"], "value")
    counters.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.agg({"n": "sum"}).first()[0] <= events.count()
    want = {(r["start"], r.event_type): r.n for r in events.selectExpr("date_trunc('day', ts) AS start", "event_type").groupBy("start", "event_type").count().withColumnRenamed("count", "n").collect()}
    assert all(want[(r.start, r.event_type)] == r.n for r in got.collect())
