import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexframe.functions import numbers as N, sequences as S
from plexframe.operators import clusters, copynumber as CN, demux as D, intervals as I, reads as R
from plexframe.operators.components import connected_components


def closure(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_chance(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)]
    df = spark.createDataFrame([*edges, (None, 5), (9, None)], "a long, b long").repartition(3)
    want = closure(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_positional_clusters_against_brute_force(spark):
    rnd = random.Random(2)
    reads = [(1, "F", s, s + rnd.choice((10, 11, 12, 20))) for s in (rnd.randrange(200) for _ in range(120))]
    df = spark.createDataFrame(reads, "contig long, strand string, start long, stop long")
    nodes = sorted(set(reads))
    near = [(i, j) for i in range(len(nodes)) for j in range(i) if abs(nodes[i][2] - nodes[j][2]) + abs(nodes[i][3] - nodes[j][3]) <= 2]
    want = closure(near, range(len(nodes)))
    got = {(r.contig, r.strand, r.start, r.stop): r.cluster for r in clusters.positional(df, 2).collect()}
    groups = lambda of: sorted(sorted(k for k in nodes if of(k) == g) for g in {of(k) for k in nodes})
    assert groups(lambda k: got[k]) == groups(lambda k: want[nodes.index(k)])


def test_interval_edges(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (1, 35, 36), (2, 5, 5)], "contig long, start long, stop long")
    at = lambda d: sorted((r.contig, r.start, r.stop) for r in d.collect())
    assert at(I.merge(df, None).where("contig = 1")) == [(1, 0, 10), (1, 10, 20), (1, 30, 40)]
    assert at(I.merge(df, 0).where("contig = 1")) == [(1, 0, 20), (1, 30, 40)]
    assert at(I.merge(df, 10).where("contig = 1")) == [(1, 0, 40)]
    one = spark.createDataFrame([(1, 0, 50, "k")], "contig long, start long, stop long, key string")
    assert at(I.subtract(one, df, "key")) == [(1, 20, 30), (1, 40, 50)]
    assert I.range_join(one, df.limit(0)).count() == 0
    assert at(I.split_equal(one, 20)) == [(1, 0, 16), (1, 16, 33), (1, 33, 50)]


@pytest.mark.parametrize("text, want", [("ACGTN*x", "N*NACGT"), ("", ""), ("acgt", "ACGT"), (None, None)])
def test_reverse_complement(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(S.reverse_complement("s")).first()[0] == want


def test_sequence_functions(spark):
    one = lambda text, *cs: tuple(spark.createDataFrame([text], ", ".join(f"c{k} string" for k in range(len(text)))).select(*cs).first())
    assert one(("AAAT",), S.homopolymer_at_start("c0")) == (3,)
    assert one(("ACACACG",), S.repeats_at_start("c0", 2)) == (3,)
    assert tuple(one(("ACACACACG",), S.repeat_unit("c0"))[0]) == (2, 4)
    assert one(("GATTA", "CTTA"), *S.trim_common_suffix("c0", "c1")) == ("GA", "C")
    assert one(("A", "CA"), *S.trim_common_suffix("c0", "c1")) == ("A", "CA")
    assert tuple(one(("5+6E7-8",), S.yc_counts("c0"))[0]) == (13, 13, 1)
    assert one(("5+6",), S.yc_counts("c0")) == (None,)
    assert one(("1/0",), S.genotype_number("c0")) == (1,)
    assert tuple(one(("AT", "A", "ATTG", "A"), S.common_ref("c0", "c1", "c2", "c3"))[0]) == ("ATTG", "ATG", "A")
    assert tuple(one(("name|5",), S.umi_flags("c0"))[0]) == (True, False, True, False)


def test_numbers(spark):
    row = spark.range(1).select(N.phred(F.lit(0.001)), N.phred(F.lit(0.0)), N.phred_of_probability(F.lit(1.0)), N.rounded_division(F.lit(5), F.lit(2)), N.metric_suffix(F.lit(1234567))).first()
    assert [round(row[0], 6), row[1], row[2], row[3], row[4]] == [30.0, 93.0, 255.0, 3, "1.2M"]
    with pytest.raises(Exception, match="error rate"):
        spark.range(1).select(N.phred(F.lit(1.5))).collect()


def test_segmentation_finds_a_step_and_leaves_noise():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, 150), rng.normal(4, 1, 100), rng.normal(0, 1, 150)]
    pieces = CN.binary_segments(x)
    assert any(abs(a - 150) <= 3 for a, _ in pieces) and any(abs(b - 250) <= 3 for _, b in pieces)
    assert CN.binary_segments(rng.normal(0, 1, 60), seed=5) == [(0, 60)]
    assert CN.undo(lambda p: float(np.median(x[p[0] : p[1]])), [(0, 70), (70, 150), (150, 250), (250, 400)], 1.0) == [(0, 150), (150, 250), (250, 400)]


def test_segmentation_tests_against_plain_loops():
    rng = np.random.default_rng(4)
    for n, most in ((30, 0), (60, 0), (130, 25)):
        x = rng.normal(0, 1, n)
        total, best = x.sum(), (0.0, 0, 0)
        for i in range(n - 1):
            for j in range(i + 2, n if not most else min(n, i + most)):
                if i + n - j >= 2:
                    one = x[i:j].sum()
                    best = max(best, ((one / (j - i) - (total - one) / (n - j + i)) ** 2 / (1 / (j - i) + 1 / (n - j + i)), i, j))
        got = [v[0] for v in CN.arc_squares(x[None], 2, most)]
        assert got[0] == pytest.approx(best[0]) and tuple(got[1:]) == best[1:]
    assert [round(CN.student_p(t, df), 4) for t, df in ((2.0, 10), (0.5, 3), (2.576, 1000), (0.0, 5))] == [0.0734, 0.6514, 0.0101, 1.0]
    a, b = rng.normal(0, 1, 80), rng.normal(0, 1, 12)
    assert not CN.pieces_differ(a, a[::-1] + 0.1, 0.01, 10_000, 7.0, rng) and CN.pieces_differ(a, a + 1, 0.01, 10_000, 7.0, rng)
    assert not CN.pieces_differ(a, b - b.mean() + a.mean(), 0.01, 10_000, 7.0, rng) and CN.pieces_differ(a, b + 4, 0.01, 10_000, 7.0, rng)


def test_segmentation_takes_whole_contigs(spark):
    from plexframe.plans.copy_queries import cbs_segments
    from plexframe.plans.views import signal

    got = cbs_segments(spark, "/root/testdata/sf0.001").groupBy("contig").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect()
    want = signal(spark, "/root/testdata/sf0.001").groupBy("contig").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_small_kernels():
    assert CN.local_maxima(np.array([3, 1, 2, 2, 2, 1, 5.0])) == [0, 3]
    assert CN.local_maxima(np.array([0, 1, 1, 0, 5.0])) == [2] and CN.local_maxima(np.array([2, 2, 1, 0, 0, 3.0])) == [1]
    assert CN.local_maxima(np.array([2.0, 1.0])) == [0] and CN.local_maxima(np.array([1.0])) == []
    assert CN.local_maxima(np.array([0, 2, 1, 3, 4.0])) == [1]
    names = CN.complete_linkage(np.array([[0, 0], [0.1, 0], [1, 1], [1.1, 1.0]]), 0.25)
    assert names[0] == names[1] != names[2] == names[3]
    peak = CN.mirrored_peak(np.full(200, 70.0), np.full(200, 30.0))
    assert abs(peak - 0.3) < 0.02
    x = np.linspace(0, 1, 50)
    assert np.allclose(CN.loess(x, 1 + 2 * x + 3 * x * x, x[5:45], 0.3), (1 + 2 * x + 3 * x * x)[5:45])
    seg = lambda start, stop, tcn, mapq, par=False, n=10: {"contig": 1, "in_par": par, "start": start, "stop": stop, "tcn": tcn, "mean_mapq": mapq, "mean_log_ratio": 0.1 * tcn, "n": n}
    s = [seg(0, 10, 2, 50), seg(10, 12, 3, 5, n=5), seg(12, 30, 2, 50)]
    merged, = CN.merge_low_quality(s, 10)
    assert (merged["start"], merged["stop"], merged["tcn"], merged["n"]) == (0, 30, 2, 25) and merged["mean_mapq"] == (500 + 25 + 500) / 25 and abs(merged["mean_log_ratio"] - (2 + 1.5 + 2) / 25) < 1e-12
    assert len(CN.merge_low_quality(s, 0)) == 3 and len(CN.merge_low_quality([s[0], seg(10, 12, 0, 5), s[2]], 10)) == 3
    assert len(CN.merge_low_quality([seg(0, 10, 2, 50, True), *s[1:]], 10)) == 3 and len(CN.merge_low_quality([seg(0, 10, 2, None), *s[1:]], 10)) == 3


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_demux_kernels():
    forms = D.edited("ACG", 2)
    assert all(edit("ACG", s) == d for s, d in forms.items())
    assert len(D.edited("ACGT", 1)) == 1 + len({s for s in D.edited("ACGT", 1) if edit("ACGT", s) == 1})
    rnd = random.Random(4)
    for _ in range(200):
        text, pattern = ("".join(rnd.choice("AC") for _ in range(n)) for n in (12, 4))
        hit = D.bitap(text, pattern, 1)
        ends = [(min(edit(text[i:j], pattern) for i in range(j + 1)), j) for j in range(1, 13)]
        least, end = min(ends)
        assert hit == ((end, least) if least <= 1 else None)
        a, b = text, "".join(rnd.choice("AC") for _ in range(10))
        assert sum(c != "=" for c in D.align(a, b)) == edit(a, b)
    assert D.bitap("ACGAxxACGT", "ACGT", 1) == (10, 0)
    assert D.duplex_consensus("ACGT", "AGGT") == ("ACGT", "cdcc")
    assert D.duplex_consensus("ACGT", "ACT") == ("ACGT", "ccdc")
    assert D.duplex_consensus("ACGT", "AGGT", True)[0] == "ANGT"
    f = D.StrandFilter(1 << 12)
    for k in ("AAA", "CCC", "GGG", "AAC"):
        f.add(k)
    assert f.strand(["AAA", "CCC", "GGG", "AAC", "AAA", "CCC"]) == "forward" and f.strand(["TTT"]) == "unknown"


def test_strands_and_duplex_queries(spark):
    from plexframe.plans.catalog import QUERIES

    votes = QUERIES["kmer_strand"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.forward >= r.reverse if r.id % 2 == 0 else r.reverse >= r.forward for r in votes)
    assert {r.kinds for r in QUERIES["duplex_consensus"](spark, "/root/testdata/sf0.001").collect()} <= {"c" * 16, "ccccd" + "c" * 11}


def test_runs_and_rules(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("AABBBA")], "c long, pos long, v string")
    assert sorted((r.first, r.length, r.v) for r in R.runs(df, "v", ["c"], "pos").collect()) == [(0, 2, "A"), (2, 3, "B"), (5, 1, "A")]
    votes = spark.createDataFrame([(1, "A"), (1, "C"), (2, "-"), (2, "G"), (3, "N")], "col long, b string")
    got = {r.col: (r.winner, r.dropped) for r in clusters.vote(votes, ["col"], "b", ["A", "C", "G", "T", "-"], "-").collect()}
    assert got == {1: ("A", False), 2: ("G", False)}


def test_rules_of_genotypes_and_alleles(spark):
    from plexframe.functions.sequences import common_ref
    from plexframe.operators import variants as V

    pairs = [("ATTGG", "A", "ATT", "A", ("ATTGG", "A", "AGG")), ("ACTGG", "A", "A", "ATTTT", ("ACTGG", "A", "ATTTTCTGG")), ("ACTGG", "A", "A", "G", ("ACTGG", "A", "GCTGG")), ("A", "G", "A", "C", ("A", "G", "C")),
             ("A", "G", "C", "T", None), ("AT", "A", "*", "*", ("AT", "A", "*")), ("AT", "*", "AG", "A", ("AG", "*", "A")), ("AC", "GT", "A", "C", None)]
    df = spark.createDataFrame([p[:4] for p in pairs], "ra string, aa string, rb string, ab string")
    got = [r.c and tuple(r.c) for r in df.select(common_ref("ra", "aa", "rb", "ab").alias("c")).collect()]
    assert got == [p[4] for p in pairs]
    calls = [(1, "A", "C", "1/2", False), (2, "A", "C", "1/2", True), (3, "A", "C", "1/1", True), (4, "A", "C", "0/0", False), (5, "A", "C", "1/2", False), (5, "G", "T", "1/2", False), (6, "AT", "A", "0/1", False), (6, "A", "G", "0/1", False),
             (7, "A", "C", "0/1", False), (7, "A", "G", "0/1", False), (8, "A", "C", "1/1", False), (8, "A", "G", "0/0", False)]
    df = spark.createDataFrame(calls, "pos int, ref string, alt string, gt string, wild boolean")
    got = sorted((r.pos, r.ref, r.alt, r.resolved) for r in V.reconcile_diploid(df, ["pos"], "gt", wildcard="wild").collect())
    want = {1: ["FAIL"], 2: ["1/2"], 3: ["1/2"], 4: ["FAIL"], 5: ["FAIL", "FAIL"], 6: ["1/2", "1/2"], 7: ["FAIL", "FAIL"], 8: ["1/1", "FAIL"]}
    assert {p: [r for q, _, _, r in got if q == p] for p in want} == want


def test_closest_region_and_downsampling(spark):
    from plexframe.operators import intervals as I

    left = spark.createDataFrame([(1, 1, 100, 120), (2, 1, 50, 70)], "id int, contig int, start long, stop long")
    right = spark.createDataFrame([(1, 80, 130), (1, 110, 200), (1, 99, 101), (1, 40, 60), (1, 60, 90)], "contig int, start long, stop long")
    got = {r.id: (r.r_start, r.distance) for r in I.closest(left, right, "id").collect()}
    assert got == {1: (99, 1), 2: (40, 10)}
    rows = spark.createDataFrame([(k, k % 4 != 3, k < 8) for k in range(12)], "k int, full boolean, forward boolean").withColumn("c", F.lit(1))
    kept = clusters.downsample(rows, ["c"], 7, F.col("full"), F.col("forward"), "k").collect()
    assert sum(r.full and r.forward for r in kept) == 4 and sum(r.full and not r.forward for r in kept) == 3 and len(kept) == 7
    assert clusters.downsample(rows, ["c"], 50, F.col("full"), F.col("forward"), "k").count() == 12


def test_qualities_of_votes(spark):
    """Values worked out by hand from the curves."""
    from plexframe.operators.clusters import consensus_quality, legacy_quality

    cases = [(5, 5, 0, 0), (3, 3, 3, 3), (10, 10, 10, 10), (10, 6, 10, 5), (1, 0, 1, 1), (40, 40, 40, 40)]
    df = spark.createDataFrame(cases, "f int, fv int, r int, rv int")
    got = [r[0] for r in df.select(consensus_quality(F.col("f"), F.col("fv"), F.col("r"), F.col("rv"))).collect()]

    def by_hand(f, fv, r, rv):
        import math

        n, v = f + r, fv + rv
        duplex = f and r and fv / f >= 0.5 and rv / r >= 0.5 and n > 5
        pen, shift, low, high = (0.7, 0.06, 20, 50) if duplex else (1.4, 0.03, 10, 40)
        ratio, obs = v / (n + pen), max(0.5, min(0.4 * math.log10(n) + 0.3, 0.8))
        if ratio < 0.5:
            return 5
        m = 3 * n + 70
        q = (m * math.log10(obs + shift) + 45) / (obs - 0.5) * (ratio - 0.5) if ratio < obs else m * math.log10(ratio + shift) + 45 - (5 * (max(f, r) * 2 / n - 1) if duplex else 0)
        return int(math.floor(min(max(q, low), high) / 10 + 0.5) * 10)

    assert got == [by_hand(*c) for c in cases]
    legacy = spark.createDataFrame([(1, 1), (3, 5), (5, 5), (0, 4)], "v int, n int").select(legacy_quality(F.col("v"), F.col("n"))).collect()
    assert [r[0] for r in legacy] == [20, 40, 40, 0]


def test_denoise_panel_matches_singular_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 9)) + np.outer(rng.normal(size=40), rng.normal(size=9)) * 4
    df = spark.createDataFrame([(s, b, float(x[b, s])) for b in range(40) for s in range(9)], "sample int, bin int, v double").repartition(4)
    got = np.empty_like(x)
    for r in CN.denoise_panel(df, ["bin"], "sample", "v", 3).collect():
        got[r.bin, r.sample] = r.v
    want = np.column_stack([CN.denoise(np.delete(x, k, 1), x[:, k], 3) for k in range(9)])
    assert np.allclose(got, want, atol=1e-6)


def test_intervals_across_tiles_and_levels(spark, monkeypatch):
    from plexframe.operators import intervals as I

    monkeypatch.setattr(I, "TILE", 50)
    rnd = random.Random(3)
    rows = [(c, s, s + rnd.choice((1, 3, 20, 400))) for c in (1, 2) for s in (rnd.randrange(2000) for _ in range(60))]
    big = [(1, 100, 90_000), (2, 5, 30_000)]
    df = spark.createDataFrame(rows, "contig int, start long, stop long")
    long = spark.createDataFrame(big, "contig int, start long, stop long")
    pairs = sorted((r.contig, r.start, r.stop, r.r_start, r.r_stop) for r in I.range_join(df, long.unionByName(df)).collect())
    assert pairs == sorted((*a, *b[1:]) for a in rows for b in big + rows if a[0] == b[0] and a[1] < b[2] and a[2] > b[1])
    covered = {c: sorted({p for d, s, e in rows if d == c for p in range(s, e)}) for c in (1, 2)}

    def islands(points):
        out = []
        for p in points:
            if out and p == out[-1][1]:
                out[-1][1] = p + 1
            else:
                out.append([p, p + 1])
        return [tuple(x) for x in out]

    for c in (1, 2):
        assert sorted((r.start, r.stop) for r in I.merge(df, 0).collect() if r.contig == c) == islands(covered[c])
        gaps = sorted((r.start, r.stop) for r in I.complement(df, spark.createDataFrame([(1, 3000), (2, 3000)], "contig int, length long")).collect() if r.contig == c)
        assert gaps == islands(sorted(set(range(3000)) - set(covered[c])))
        left = spark.createDataFrame([(7, c, 10, 2500)], "key int, contig int, start long, stop long")
        assert sorted((r.start, r.stop) for r in I.subtract(left, df, "key").collect()) == islands(sorted(set(range(10, 2500)) - set(covered[c])))
    w = I.split_windows(spark.createDataFrame([(1, 0, 500)], "contig int, start long, stop long"), 30).withColumn("state", F.floor(F.col("start") / 120))
    assert [(r.start, r.stop) for r in sorted(I.merge_adjacent(w, same=("state",)).collect())] == [(0, 120), (120, 240), (240, 360), (360, 480), (480, 500)]


def test_quantiles_of_any_size(spark):
    from plexframe.operators.ranks import quantile, quantiles

    rng = np.random.default_rng(9)
    rows = [("a", float(x)) for x in rng.lognormal(0, 3, 4000)] + [("b", 2.0)] * 50 + [("c", float(x)) for x in rng.integers(0, 5, 301)] + [(None, 1.0), (None, 4.0), ("d", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in quantiles(df, ["g"], "v", [0.01, 0.5, 0.99]).collect()}
    for g in ("a", "b", "c", None):
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert np.allclose(got[g], np.quantile(own, [0.01, 0.5, 0.99]), rtol=1e-12)
    assert "d" not in got and quantile(df.limit(0), "v", 0.5) is None and quantile(df.where("g = 'b'"), "v", 0.3) == 2.0


def test_differences_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(CN, "STRETCH", 7)
    rng = np.random.default_rng(10)
    pos = np.sort(rng.choice(200, 60, replace=False))
    v = rng.normal(size=60)
    df = spark.createDataFrame([("k", int(p), float(x)) for p, x in zip(pos, v)], "k string, pos long, v double").repartition(3)
    got = sorted((r["pos"], r["diff"]) for r in CN.first_differences(df, ["k"], "pos", "v").collect())
    assert [p for p, _ in got] == pos[1:].tolist() and np.allclose([d for _, d in got], np.diff(v))
