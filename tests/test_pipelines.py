"""Clustering, duplex votes, doubling and two rounds of segmentation, against brute force and values worked out by hand."""

import random

import numpy as np

from plexframe.operators import clusters as K, consensus as C, copynumber as CN


def brute_clusters(reads, wiggle):
    full = [r for r in reads if not r["partial"]]
    part = [r for r in reads if r["partial"]]
    key = lambda r: (r["contig"], r["strand"], r["umi5"], r["umi3"])
    name = {r["read"]: r["read"] for r in full}
    near = lambda a, b: key(a) == key(b) and abs(a["start"] - b["start"]) + abs(a["stop"] - b["stop"]) <= wiggle
    changed = True
    while changed:
        changed = False
        for a in full:
            for b in full:
                if near(a, b) and name[a["read"]] != name[b["read"]]:
                    low = min(name[a["read"]], name[b["read"]])
                    name[a["read"]] = name[b["read"]] = low
                    changed = True
    groups = {}
    for r in full:
        groups.setdefault(name[r["read"]], []).append(r)
    out = {r["read"]: ("f", name[r["read"]]) for r in full}
    for r in part:
        best = []
        for c, own in groups.items():
            if key(own[0]) != key(r):
                continue
            mean = lambda x: sum(o[x] for o in own) / len(own)
            if r["five_complete"]:
                d, fits = abs(r["start"] - mean("start")), r["stop"] <= max(o["stop"] for o in own) + wiggle
            else:
                d, fits = abs(r["stop"] - mean("stop")), r["start"] >= max(min(o["start"] for o in own) - wiggle, 0)
            if d <= wiggle and fits:
                best.append((d, c))
        best.sort()
        out[r["read"]] = ("f", best[0][1]) if best and (len(best) == 1 or best[0][0] < best[1][0]) else None
    left = sorted((r for r in part if out[r["read"]] is None), key=lambda r: (key(r), r["five_complete"], r["start"] if r["five_complete"] else r["stop"], r["read"]))
    last, at, n = None, 0, 0
    for r in left:
        pos = r["start"] if r["five_complete"] else r["stop"]
        if last != (key(r), r["five_complete"]) or pos > at + 4:
            n += 1
        last, at = (key(r), r["five_complete"]), pos
        out[r["read"]] = ("p", n)
    return out


def test_clustered_reads_against_brute_force(spark):
    rnd = random.Random(31)
    reads = [dict(read=k, contig=1, strand=rnd.choice("+-"), umi5=rnd.randrange(2), umi3=0, start=(s := rnd.randrange(60)), stop=s + 30 + rnd.randrange(6), partial=rnd.random() < 0.4, five_complete=rnd.random() < 0.5) for k in range(150)]
    df = spark.createDataFrame([tuple(r.values()) for r in reads], "read long, contig int, strand string, umi5 int, umi3 int, start long, stop long, partial boolean, five_complete boolean").repartition(3)
    got = {r["read"]: r["cluster"] for r in C.cluster_reads(df, 3, 4, partial_clusters=True).collect()}
    want = brute_clusters(reads, 3)
    assert set(got) == set(want)
    pairs = {(got[k], want[k]) for k in got}
    assert len({g for g, _ in pairs}) == len(pairs) == len({w for _, w in pairs})
    none = {r["read"]: r["cluster"] for r in C.cluster_reads(df, 3, 4).collect()}
    assert {k for k, v in none.items() if v is None} == {k for k, v in want.items() if v[0] == "p"}
    assert all(r["cluster"] is None for r in C.cluster_reads(df, 3, 4, exclude_partial=True).collect() if reads[r["read"]]["partial"])


def cells(spark, rows):
    return spark.createDataFrame(rows, "cluster int, col long, ins int, base string, forward boolean, part string, kind string, hp string")


def vote(spark, rows, library):
    got = C.vote_columns(cells(spark, rows), ["cluster", "col", "ins"], part="part", kind="kind", homopolymer="hp", library=library).collect()
    return {r["cluster"]: (r["base"], r["quality"]) for r in got}


def test_duplex_votes_by_hand(spark):
    both = lambda c, a, b, kind="concordant", hp="none": [(c, 0, 0, a, True, "R1", kind, hp), (c, 0, 0, b, True, "R2", kind, hp)]
    rows = both(1, "A", "A") * 4 + both(2, "C", "A", "discordant")  # four agreeing pairs; a lone pair that differs: R1's base
    rows += [(3, 0, 0, "G", True, "S", "simplex", "none")] * 3  # simplex only
    rows += both(4, "A", "T") * 3  # the parts disagree
    rows += both(5, "A", "-", hp="in") * 2  # tied with a gap in a homopolymer
    rows += [(6, 0, 0, "T", True, "S", "simplex", "none")]  # a lone read
    got = vote(spark, rows, "parent_daughter")
    assert got[1][0] == "A" and got[1][1] in (30, 40) and got[2] == ("C", K.LOW) and got[3] == ("G", K.SIMPLEX_ONLY)
    assert got[4][1] == K.LOW and got[5][0] == "A" and got[5][1] == K.LOW and got[6] == ("T", K.SINGLETON)
    # Both strands of parent reads: a gap that one strand ties with a base is called in a homopolymer only.
    pair = lambda c, a, b, hp: [(c, 0, 0, a, True, "R1", "concordant", hp), (c, 0, 0, b, False, "R2", "concordant", hp)]
    rows = pair(1, "-", "-", "in") + pair(1, "T", "-", "in") + pair(2, "-", "-", "none") + pair(2, "T", "-", "none")
    got = vote(spark, rows, "parent_parent")
    assert got[1][0] == "-" and got[2][0] == "T"
    assert vote(spark, pair(3, "A", "-", "none") + pair(3, "A", "-", "none") + [(3, 0, 0, "-", False, "R2", "concordant", "none")], "parent_parent")[3][0] == "A"


def test_trimming_and_sizes(spark):
    calls = spark.createDataFrame([(1, "ACGT", [40, 40, 40, 40], [1, 3, 2, 1]), (2, "AC", [5, 5], [1, 1]), (3, "", [], [])], "cluster int, seq string, quals array<int>, depths array<long>")
    got = {r["cluster"]: (r["seq"], r["depths"]) for r in C.trim_ends(calls, 2).collect()}
    assert got == {1: ("CG", [3, 2]), 2: ("", []), 3: ("", [])}
    assert [r[0] for r in calls.select(C.effective_size(calls.depths)).collect()] == [2, 1, 0]


def test_doubling():
    rng = np.random.default_rng(2)
    one, two = rng.normal(0.1, 0.01, 40), np.r_[rng.normal(0.05, 0.01, 20), rng.normal(0.4, 0.01, 20)]
    assert not CN.doubled(one, 0.8) and CN.doubled(two, 0.8) and not CN.doubled(two, 0.2) and not CN.doubled(two[:4], 0.8)


def test_breaks_at_observations():
    starts, ends = np.arange(0, 100, 10), np.arange(10, 110, 10)
    outer = [{"contig": 1, "start": 0, "stop": 100}]
    inner = [{"contig": 1, "start": 2, "stop": 33}, {"contig": 1, "start": 47, "stop": 96}]
    assert CN.break_by(outer, inner, starts, ends) == [{"contig": 1, "start": 0, "stop": 30}, {"contig": 1, "start": 30, "stop": 100}]
    assert CN.break_by(outer, inner[:1], starts, ends) == outer and CN.break_by(outer, [], starts, ends) == []


def test_two_rounds_split_by_the_second_signal(spark):
    rng = np.random.default_rng(4)
    ratio = np.r_[np.zeros(60), np.ones(60)] + rng.normal(0, 0.05, 120)
    shift = np.r_[np.zeros(90), np.ones(30)] + rng.normal(0, 0.05, 120)
    make = lambda v: spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(v)], "contig int, pos long, value double")
    got = sorted((r["first"], r["last"], r["n"]) for r in CN.two_rounds(make(ratio), make(shift), ["contig"], "pos", "value").collect())
    assert len(got) == 3 and got[0][0] == 0 and got[-1][1] == 119 and abs(got[0][1] - 59) <= 2 and abs(got[1][1] - 89) <= 2 and sum(n for *_, n in got) == 120


def test_somatic_segments():
    rng = np.random.default_rng(6)
    x = np.r_[np.zeros(40), np.full(40, 1.5), np.zeros(40)] + rng.normal(0, 0.2, 120)
    got = CN.somatic_segments(x, permutations=500)
    assert len(got) == 3 and all(abs(a - b) <= 2 for (a, _), b in zip(got, (0, 40, 80), strict=True))
    assert CN.somatic_segments(rng.normal(0, 1, 60), permutations=500) == [(0, 60)] and CN.somatic_segments(np.zeros(30)) == [(0, 30)] and CN.somatic_segments(np.zeros(0)) == []
    for _ in range(20):  # the best arc by plain loops
        y = rng.normal(0, 1, 14)
        best = 0.0
        for i in range(len(y)):
            for j in range(i + 2, len(y) + 1):
                v, w = y[i:j], np.r_[y[:i], y[j:]]
                if len(w) >= 2:
                    pooled = np.sqrt(((len(v) - 1) * v.var() + (len(w) - 1) * w.var()) / (len(y) - 2))
                    best = max(best, abs(v.mean() - w.mean()) / (pooled * np.sqrt(1 / len(v) + 1 / len(w))))
        assert np.isclose(CN.somatic_arcs(y[None], 2)[0][0], best)
