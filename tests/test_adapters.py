"""Duplex tags, trimming, scored flanks, hairpins, repeats, binary alignments and launch settings, against plain computations."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from plexframe.functions import duplex as X, sequences as S
from plexframe.operators import adapters as A, demux as D
from plexframe.sources import binary, config, readers, writers


def made_tag(rnd):
    ops, last = [], None
    for _ in range(rnd.randrange(5)):
        op = ("", rnd.randrange(1, 5)) if last != "" and rnd.random() < 0.5 else ((c := rnd.choice("ACEHKRVZacehk")), int(c.isupper()))
        ops.append(op)
        last = op[0]
    return X.Tag(rnd.randrange(4), rnd.random() < 0.5, ops, rnd.random() < 0.5, rnd.randrange(4))


def test_documented_tag():
    tag = X.Tag.parse("5+6E7-8")
    assert tag.decode("AAAAACCCCCCTCCCCCCCGGGGGGGG") == ("AAAAACCCCCCTCCCCCCC", "CCCCCCCCCCCCCCGGGGGGGG")
    assert "".join(t[0] for t in tag.types()) == "s" * 5 + "c" * 6 + "d" + "c" * 7 + "s" * 8
    for bad in ("", "5", "5+6", "1+2-3-4", "x+2-3", "1+2N-3", "1+2?-3"):
        with pytest.raises(ValueError, match="duplex tag"):
            X.Tag.parse(bad)
    assert X.discordant_rate("5+6E7-8") == 1 / 14 and X.discordant_rate(None) is None and X.discordant_rate("5++3") is None


def test_tag_transforms():
    rnd = random.Random(41)
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    rc = lambda s: "".join(comp[c] for c in reversed(s))
    for _ in range(500):
        tag = made_tag(rnd)
        assert X.Tag.parse(str(tag)) == tag or str(X.Tag.parse(str(tag))) == str(tag)
        assert str(tag.reverse().reverse()) == str(tag) and tag.reverse().types() == tag.types()[::-1]
        n = len(tag.types())
        seq = "".join(rnd.choice("ACGT") for _ in range(n))
        one, two = tag.decode(seq)
        back = tag.reverse().decode(rc(seq))
        assert back == (rc(one), rc(two))
        a, b = rnd.randrange(n + 2), rnd.randrange(n + 2)
        assert tag.trim(a, b).types() == (tag.types()[a : n - b] if a + b < n else [])
        assert X.Tag.of_types(tag.types()).types() == tag.types()


def walk(start, cigar):
    """(read base, reference position or None) of every base of a read."""
    out, q = [], 0
    for n, op in __import__("re").findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                out.append((q, start))
                q, start = q + 1, start + 1
            elif op in "IS":
                out.append((q, None))
                q += 1
            elif op in "DN":
                start += 1
    return out


def test_trimmed_alignments():
    rnd = random.Random(42)
    for _ in range(500):
        cigar = rnd.choice(["", "3S"]) + rnd.choice(["10M", "5M2I6M", "4M3D6M", "6=1X5="]) + rnd.choice(["", "2I4M", "2D5M"]) + rnd.choice(["", "4S"])
        whole = walk(100, cigar)
        a, b = rnd.randrange(8), rnd.randrange(8)
        start, first, short = X.trim_alignment(100, cigar, a, b)
        kept = [(q - first, r) for q, r in whole[a : len(whole) - b]] if a + b < len(whole) else []
        assert walk(start, short) == kept
    assert X.trim_alignment(7, "5M", 3, 2) == (7, 0, "") and X.trim_alignment(7, "5M", 0, 0) == (7, 0, "5M")


def best_score(flank, ref):
    """The best of all alignments of prefixes of both, by plain dynamic programming."""
    d = [[0.0] * (len(ref) + 1) for _ in range(len(flank) + 1)]
    for i in range(len(flank) + 1):
        for j in range(len(ref) + 1):
            options = [0] if not i and not j else []
            if i and j:
                options.append(d[i - 1][j - 1] + (A.MATCH if flank[i - 1] == ref[j - 1] else A.SUBSTITUTION))
            if i:
                options.append(d[i - 1][j] + A.INSERTION)
            if j:
                options.append(d[i][j - 1] + A.DELETION)
            d[i][j] = max(options)
    return max(max(row) for row in d)


def test_scored_flanks():
    assert A.classify("ACGTACGG", "ACGTAC", 12) == {"best": (6, 12), "last": (6, 12), "remaining": 0, "end": "found"}
    assert A.classify("TTTTTTTT", "AAAA", 8)["best"] == (0, 0) and A.classify("", "ACG", 8) == {"best": (0, 0), "last": None, "remaining": 3, "end": "input"}
    rnd = random.Random(43)
    for _ in range(300):
        ref = "".join(rnd.choice("ACGT") for _ in range(6))
        flank = "".join(c if rnd.random() > 0.15 else rnd.choice("ACGT") for c in ref)[: rnd.randrange(3, 7)]
        got = A.classify(flank, ref, 100)
        assert got["best"][1] == max(0, best_score(flank, ref))


def test_hairpins_and_scans():
    rnd = random.Random(44)
    loop = "GATTACAGGCATCC"
    for _ in range(40):
        s = "".join(rnd.choice("ACGT") for _ in range(40))
        read = s + loop + A.reverse_complement(s)
        assert A.find_hairpin(read, loop) == ("exact", read.find(loop), read.find(loop) + 14)
        at = rnd.randrange(14)
        other = loop[:at] + rnd.choice([c for c in "ACGT" if c != loop[at]]) + loop[at + 1 :]
        method, a, b = A.find_hairpin(s + other + A.reverse_complement(s), loop)
        assert method in ("global", "local") and abs(a - 40) <= 1 and abs(b - 54) <= 1
    assert A.find_hairpin("".join(rnd.choice("AC") for _ in range(80)), loop) is None
    forms = {form: (7, e) for form, e in D.edited("ACGTACG", 1).items()}
    assert A.scan("TTTACGTACGTTT", forms, (6, 8)) == (3, 10, 7, 0) or A.scan("TTTACGTACGTTT", forms, (6, 8))[2:] == (7, 1)
    assert A.scan("TTTACGTACGTTT", forms, (6, 8), five=False)[2] == 7 and A.scan("TTTT", forms, (6, 8)) is None
    assert A.trim_umi("GGACGT", {"ACG": (1, 0), "GAC": (2, 1)}, 3, 2, 2) == (1, 2, 0) and A.trim_umi("GGTTT", {"ACG": (1, 0)}, 3, 1, 2) is None
    assert A.left_align("AC-CG", "ACCCG") == ("A-CCG", "ACCCG") and A.left_align("ACG", "ACG") == ("ACG", "ACG")


def test_repeat_genotypes():
    assert A.repeat_genotype({10: 20, 15: 18}, {}, 0) == (10, 15)
    assert A.repeat_genotype({12: 30, 11: 1}, {8: 4}, 0) == (12, 12)
    assert A.repeat_genotype({10: 15}, {30: 12}, 9)[1] == 60 and A.repeat_genotype({}, {}, 0) == (0, 0)


def test_binary_alignments(spark, tmp_path):
    rows = [("a", 16, "c2", 5, 60, "3M1D2M", "ACGTN", "IIII!", {"NM": "3", "YC": "1+2-3", "XX": "-5"}), ("b", 4, None, -1, 0, "*", "*", "*", {})]
    data = binary.pack(iter(rows), [("c1", 10), ("c2", 20)], "@HD\tVN:1.6\n")
    assert data.endswith(binary.END_BLOCK) and __import__("gzip").decompress(data) == binary.inflate(data)
    assert binary.header(binary.inflate(data))[:2] == ("@HD\tVN:1.6\n", [("c1", 10), ("c2", 20)])
    assert list(binary.records(data)) == rows
    block = struct.unpack_from("<H", data, 16)[0] + 1
    assert data[block:] == binary.END_BLOCK
    assert [x[0] for x in binary.records(binary.pack((("r%d" % k, 0, "c1", k, 1, "4M", "ACGT", "IIII", {}) for k in range(5000)), [("c1", 9999)]))] == [f"r{k}" for k in range(5000)]
    (tmp_path / "x.bam").write_bytes(data)
    got = binary.bam(spark, str(tmp_path / "x.bam"))
    assert got.orderBy("qname").collect()[0].asDict()["tags"]["YC"] == "1+2-3" and binary.bam_header(spark, str(tmp_path / "x.bam")) == [("c1", 10), ("c2", 20)]
    parts = binary.encode(got.repartition(2, "qname"), [("c1", 10), ("c2", 20)])
    assert sorted(r[0] for r in binary.records(binary.joined(parts))) == ["a", "b"]
    with pytest.raises(ValueError, match="BAM"):
        binary.header(b"nope")


def test_names_and_launch(spark, tmp_path):
    assert S.unsupported_names(["a", "tumor_a", "b", "normal_c"], {"a"}, ("tumor_", "normal_")) == ["b", "normal_c"]
    assert config.file_type("duplex", "hairpin") == "duplex" and config.file_type("simplex", "x") == "simplex"
    with pytest.raises(ValueError, match="file type"):
        config.file_type("other", None)
    assert config.submit_command("run.py", {"b": [1], "a": "x"}, "local[2]")[-2:] == ["--a=x", "--b=[1]"]
    assert config.output_name(["/x/run1_a.fq.gz", "/x/run1_b.fq"], 3) == "run1.0003" and config.sheet_rows({"s": "1"}) == [("s", "1")]
    (tmp_path / "in.list").write_text(f"{tmp_path}/a.txt\n\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.txt").write_text("x")
    assert [p.rsplit("/", 1)[1] for p in readers.expanded(spark, [f"{tmp_path}/in.list", f"{tmp_path}/d"])] == ["a.txt", "b.txt"]
    head = "".join(f"##contig=<ID=c{k}>\n" for k in range(2500)) + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    (tmp_path / "big.vcf").write_text(head + "c1\t1\t.\tA\tC\t.\t.\t.\n" * 3000)
    assert len(readers.vcf_header(spark, str(tmp_path / "big.vcf"))["contigs"]) == 2500
    with pytest.raises(Exception, match="outside its contig"):
        readers.on_contigs(spark.createDataFrame([("c", 50, 60)], "contig string, start long, stop long"), spark.createDataFrame([("c", 10)], "contig string, length long")).collect()
    writers.metrics(spark.createDataFrame([("x", 1)], "metric string, value long"), str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ["metric\tvalue", "x\t1"]
    df = spark.createDataFrame([("T", "C"), ("A", "G"), ("G", "A")], "a string, b string")
    assert [r[0] for r in df.select(A.methyl_converted(F.col("a"), F.col("b"))).collect()] == ["C", "G", "G"]
