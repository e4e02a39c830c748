"""Joins, mixing, packing, neighbours, chat, reputation and the pipeline."""

import collections
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexframe.llm import chat, jaccard, language, mixing, neighbours, packing, pii, queries, reputation, tokens
from plexframe.session import Scratch
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def shingles(text):
    w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(240):
        w = list(base[i % 3])
        for _ in range(rnd.choice((0, 1, 1, 2, 2, 3))):
            w[rnd.randrange(60)] = f"zz{rnd.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows + [(1000 + k, t) for k, t in enumerate((None, "", " \n", "a", "A", "a b", "a b c d e f g", "x " * 30_000))]


def test_jaccard_against_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == want
    kept = jaccard.representatives(df.withColumn("fp", F.lit(1)))
    wordless = {i for i, t in rows if not shingles(t)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for n, c in want.values() if n} | wordless)
    assert jaccard.join(df.limit(0)).count() == jaccard.representatives(df.limit(0)).count() == 0


def test_jaccard_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(7, "a b c d e f")] * 3 + [(None, "A b c d e f"), (None, "q r s t u v"), (5, None), (5, None)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == {(7, 2, 7): 3, (None, 2, 7): 1, (None, 2, None): 1, (5, 0, 5): 2}
    assert sorted((r.text or "") for r in jaccard.representatives(df).collect()) == ["", "", "a b c d e f", "q r s t u v"]


def test_jaccard_very_long_texts(spark):
    words = [f"w{k}" for k in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:75_000], "other", *words[75_001:]])), (4, "short text of a few words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (149_996, 1), 2: (149_996, 1), 4: (2, 4)}


def test_jaccard_long_lists_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 7)
    monkeypatch.setattr(jaccard, "STARS", 0)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == brute_components(rows)
    clash = df.withColumns({c: F.lit("own") for c in ("keep_id", "keep_hash", "mark_id", "own_0", "fp", "th")})
    kept = jaccard.representatives(clash)
    assert kept.columns == clash.columns and {r.keep_hash for r in kept.collect()} == {"own"}
    monkeypatch.setattr(jaccard, "MARK_BYTES", 0)
    assert sorted(r.doc_id for r in jaccard.representatives(clash).collect()) == sorted(r.doc_id for r in kept.collect())


def test_jaccard_repeated_rows_keep_the_same_one(spark):
    df = spark.createDataFrame([(7, "a b c d e f", f"s{k}") for k in range(5)] + [(8, "a b c d e f", "x")], "doc_id long, text string, source string")
    one = [tuple(r) for r in jaccard.representatives(df).collect()]
    assert len(one) == 1 and one == [tuple(r) for r in jaccard.representatives(df.repartition(4)).collect()]


def test_jaccard_leaves_no_scratch_tables(spark):
    import glob

    from plexframe import session

    root = session.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{root}/plexframe-*"))
    with session.temporary():
        assert jaccard.join(spark.createDataFrame(near_copies(), "doc_id long, text string")).count() == 248
    assert set(glob.glob(f"{root}/plexframe-*")) == before


def test_jaccard_signatures_never_lose_a_link(spark):
    rnd = np.random.default_rng(16)
    sets, links = [], []
    for _ in range(200):
        n = int(rnd.integers(1, 80))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rnd.random(len(a)) < 0.92], rnd.integers(0, 2**63, int(rnd.integers(0, 5))).astype(np.uint64)])
        if len(b):
            sets += [a, b]
            links.append(jaccard.linked(a, b))
    rows = [(k, len(s), *(x for seed in jaccard.ORDERS for x in (lambda kept, rest: (kept.tolist(), rest))(*jaccard.signature(s, seed)))) for k, s in enumerate(sets)]
    signed = spark.createDataFrame(rows, "fp long, n int, one array<int>, rest_one int, two array<int>, rest_two int")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(links))], "a long, b long")
    kept = {r.a // 2 for r in jaccard.sifted(pairs, signed, 80, 10).collect()}
    assert {k for k, x in enumerate(links) if x} <= kept
    other = spark.createDataFrame([(2 * k, (2 * k + 3) % len(sets)) for k in range(len(links))], "a long, b long")
    assert jaccard.sifted(other, signed, 80, 10**9).count() == 0


def test_jaccard_prefix_never_loses_a_link():
    rnd = np.random.default_rng(6)
    for _ in range(300):
        n = int(rnd.integers(1, 60))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rnd.random(len(a)) < 0.9], rnd.integers(0, 2**63, int(rnd.integers(0, 6))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        link = bool(both) and 100 * both >= 80 * (len(a) + len(b) - both)
        assert jaccard.linked(a, b) == link
        for seed in jaccard.ORDERS if link else ():
            one, other = (np.sort(jaccard.mix(x, seed))[: jaccard.prefix_size(len(x))] for x in (a, b))
            assert len(np.intersect1d(one, other))


def test_mixing_reaches_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.plan(docs).groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("ss"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("copies")).orderBy("source").collect()
    sizes = [r["size"] for r in got]
    assert [r["target"] for r in got] == pytest.approx(mixing.shares(sizes))
    assert sum(r["target"] for r in got) == pytest.approx(sum(sizes))
    assert all(r["ss"] == r["size"] and r["copies"] <= 3 and abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got)
    again = mixing.plan(docs.repartition(5)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixing.plan(docs).select("doc_id", "taken").collect()))


def test_mixing_shares():
    assert mixing.shares([100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    assert mixing.shares([1, 1000]) == pytest.approx([3.0, 998.0])
    assert mixing.shares([0, 10]) == pytest.approx([0.0, 10.0]) and mixing.shares([]) == [] and mixing.shares([0, 0]) == [0.0, 0.0]


def greedy(rows, budget):
    """The rows that a plain pass in key order takes: the first that doesn't fit ends it, and what is left goes to smaller rows behind."""
    taken, left, most, floor = set(), budget, float("inf"), (-1, -1)
    for _ in range(mixing.ROUNDS):
        if left < 1 or floor is None:
            break
        bound = None
        for h, g, size in sorted(rows):
            if (h, g) <= floor or size > most:
                continue
            if size > left:
                bound = (h, g)
                break
            taken.add((h, g))
            left -= size
        floor, most = bound, left
    return taken


@pytest.mark.parametrize("shift", [0, 48])
def test_mixing_thresholds_against_a_greedy_pass(spark, shift):
    """Keys spread out, and keys that agree in all but their last bits."""
    rng = np.random.default_rng(20)
    rows = [(k, int(s), int(h) >> shift, int(g)) for k in range(6) for s, h, g in zip(rng.integers(0, 60, 400), rng.integers(0, 1 << 60, 400), rng.integers(0, 1 << 60, 400))]
    rows += [(6, 9, 5, g) for g in range(20)] + [(7, 0, 1, 1), (7, 5, 2, 2)]
    budget = {k: float(b) for k, b in enumerate([1, 17, 500, 3000.5, 11_000, 10**6, 50, 5])}
    df = spark.createDataFrame(rows, "mix_k int, mix_size long, mix_h long, mix_g long").repartition(5)
    rules = {r.mix_k: r.mix_rules for r in mixing.thresholds(df, budget, Scratch(spark)).collect()}
    for k, b in budget.items():
        own = [(h, g, s) for j, s, h, g in rows if j == k]
        assert {(h, g) for h, g, s in own if any((h, g) < (r.h, r.g) and s <= r.most for r in rules[k])} == greedy(own, b), k


def test_mixing_plan_sorts_no_rows(spark):
    rows = spark.createDataFrame([(0, 1, 2, 3, 4.0, 0)], "mix_k int, mix_size long, mix_h long, mix_g long, budget double, path long")
    plan = mixing.histogram(rows, 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "x")] * 300 + [(None, None, None)] * 3 + [(2, "q " * 50, "y"), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"Taken": F.lit("old"), "mix_h": F.lit(1), "mix_mine": F.lit("kept"), "own_1": F.lit(2)})
    got = {r["source"]: (r["taken"], r["target"], r["copies"]) for r in mixing.plan(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("copies")).collect()}
    assert {"mix_h", "mix_mine", "own_1"} <= set(mixing.plan(df).columns) and "Taken" not in mixing.plan(df).columns
    assert got[None] == (0, 0.0, 0) and abs(got["x"][0] - got["x"][1]) <= 3 and got["y"][0] == 150
    out = mixing.mix(df)
    assert out.columns == df.columns and out.where("source = 'y' AND doc_id = 2").count() == 3
    assert mixing.plan(df.limit(0)).count() == 0


def check_packed(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, 0), (-2, "word " * 9000, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = packing.pack_documents(docs).collect()
    n = check_packed(rows, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    words, zlib = tokens.words(), __import__("zlib")
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d in docs.collect():
        ids = words.ids(d.text or "") + b"\x01\0\0\0"
        pieces = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 16384)))
        for r in pieces:
            own = ids[4 * r.start : 4 * (r.start + r.length)]
            assert r.start == 4096 * r.piece and zlib.crc32(own) == r.ids_crc32
        assert sum(r.length for r in pieces) == len(ids) // 4


def test_packing_by_islands(spark, monkeypatch):
    rng = np.random.default_rng(7)
    sizes = [int(x) for _ in range(60) for a, b in [rng.integers(26, 48, 2)] for x in (a, b, 100 - a - b)]
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    table = Scratch(spark).write(spark.createDataFrame([(k, s) for k, s in enumerate(sizes)] + [(0, sizes[0])], "id long, length long").withColumn("Offset", F.lit("old")).repartition(3))
    rows = packing.pack(table, 100).collect()
    assert sorted((r.id, r.length) for r in rows) == sorted([*enumerate(sizes), (0, sizes[0])])
    assert 60 <= check_packed(rows, 100) <= 62
    assert packing.pack(Scratch(spark).write(table.limit(0)), 100).count() == 0


def test_packing_whatever_partitions_are_read(spark, monkeypatch):
    """The scan's partitions change between the solution and the placing, as when an executor is lost."""
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 101, 600).tolist()
    table = Scratch(spark).write(spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "id long, length long").repartition(12))
    packed, keys = packing.pack(table, 100), {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = packed.collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.id, r.length) for r in rows) == list(enumerate(sizes))
    check_packed(rows, 100)


def fewest(sizes, capacity):
    """The fewest bins, by trying all subsets."""
    n = len(sizes)
    best = [(0, 0)] + [None] * (2**n - 1)  # items taken: bins closed, room used of the last
    for mask in range(1, 2**n):
        options = []
        for k in range(n):
            if mask >> k & 1:
                bins, used = best[mask ^ 1 << k]
                options.append((bins, used + sizes[k]) if bins and used + sizes[k] <= capacity else (bins + 1, sizes[k]))
        best[mask] = min(options)
    return best[-1][0]


def test_packing_against_all_packings():
    rng = np.random.default_rng(21)
    for _ in range(40):
        sizes = np.sort(rng.integers(1, 14, 9))[::-1]
        assert packing.evolve(sizes, [], 20, seed=3).max() + 1 == fewest(sizes.tolist(), 20)


def test_packing_triplets_within_one_percent():
    rng = np.random.default_rng(22)
    sizes = [x for a, b in rng.integers(1100, 1500, (1000, 2)).tolist() for x in (a, b, 4096 - a - b)]
    sizes = np.sort(np.array(sizes))[::-1]
    best = packing.evolve(sizes, [], 4096, seed=1)
    assert (np.bincount(best, weights=sizes) <= 4096).all() and len(packing.best_fit(sizes, 4096)) == 3000
    assert best.max() + 1 <= 1010 < max(packing.best_fit(sizes, 4096)) + 1


def test_packing_kernels():
    rng = np.random.default_rng(8)
    for _ in range(30):
        sizes = np.sort(rng.integers(1, 60, 80))[::-1]
        first = np.array(packing.best_fit(sizes, 100))
        best = packing.evolve(sizes, [], 100, seed=1)
        assert (np.bincount(best, weights=sizes) <= 100).all()
        assert packing.lower_bound(sizes, 100) <= best.max() + 1 <= first.max() + 1
        filled = packing.exact_fill(sizes, 100, rng)
        assert (filled >= 0).all() and (np.bincount(filled, weights=sizes) <= 100).all()
        child = packing.crossover(first, best, sizes, 100, rng)
        assert (child >= 0).all() and (np.bincount(child, weights=sizes) <= 100).all()


def test_neighbours_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = neighbours.search(rows, rows.where("vec_id % 20 = 0")).collect()
    table = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids, x = np.array(list(table)), np.stack(list(table.values()))
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(r.score == pytest.approx(float(table[q] @ table[r.vec_id]), abs=1e-12) for r in found)
        score = x @ table[q]
        score[ids == q] = -np.inf
        hit += len({r.vec_id for r in found} & set(ids[np.lexsort((ids, -score))[:20]]))
    assert len(by) == sum(i % 20 == 0 for i in table) and hit >= 0.9 * 20 * len(by)


def test_neighbours_leaves_grow_with_the_rows(spark, monkeypatch):
    for name, value in (("SAMPLE_ROWS", 400), ("LEAF_ROWS", 60), ("SPLIT_SAMPLE", 300)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(23)
    x = rng.normal(size=(6000, 8)) + 6 * rng.normal(size=(12, 8))[rng.integers(0, 12, 6000)]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    index = rows.selectExpr("vec_id AS id", "embedding AS v")
    tree = neighbours.fit(x[:400], float((x * x).sum(1).max()), 12)
    leaf = tree.assign(x)
    counts = {int(k): int((leaf == k).sum()) for k in np.unique(leaf)}
    of = spark.createDataFrame([(k, int(v)) for k, v in enumerate(leaf)], "id long, leaf int")
    grown = neighbours.deepen(tree, index.join(of, "id"), counts)
    sizes = np.unique(grown.assign(x), return_counts=True)[1]
    assert len(sizes) > 60 and sizes.sum() == 6000 and sizes.max() < max(counts.values()) / 3
    got = collections.defaultdict(set)
    for r in neighbours.search(rows, rows.where("vec_id % 100 = 0"), k=10).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(found & set(np.argsort(-score)[:10].tolist()))
    assert len(got) == 60 and hit >= 0.9 * 600


def test_neighbours_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [1.0, None]), (180, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = neighbours.search(df, df.where("vec_id % 20 = 0")).collect()
    assert {r.query_id for r in got} == {0, 20}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0][:19] == list(range(1, 20))
    few = df.where("vec_id < 4")
    assert neighbours.search(few, few).count() == 12
    assert neighbours.search(df.limit(0), df).count() == neighbours.search(df, df.limit(0)).count() == 0


CHAT = [
    (1, 0, "user", 'hi "x"\n'),
    (1, 1, "assistant", '{"content":"c","tool_calls":[{"id":"a","name":"search","arguments":{"query":"q","limit":3}},{"id":"b","name":"search","arguments":{"limit":"3","z":{"b":1,"a":[2]}}},{"id":"d","name":"nope","arguments":{}}]}'),
    (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'), (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'), (1, 0, "tool", '{"tool_call_id":"b","content":"early"}'), (1, 5, "tool", '{"tool_call_id":"zz"}'),
    (2, 0, "tool", "{bad"), (None, 0, None, None), (1, 3, "assistant", '{"x":1}'), (2, 1, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":"no object"}]}'), (3, 0, "user", ""),
]


def test_chat_links(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumns({"json": F.lit(1), "id": F.lit(2)})
    rows = sorted(chat.link(df).collect(), key=lambda r: (r.conv_id or 0, r.sort_turn, r.sort_step, r.turn))
    assert len(rows) == len(CHAT)
    calls = next(r for r in rows if r.n_calls == 3)
    assert (calls.n_linked, calls.n_invalid) == (2, 2)
    assert json.loads(calls.json)["tool_calls"][1] == {"arguments": {"limit": "3", "z": {"a": [2], "b": 1}}, "id": "b", "name": "search"}
    assert '{"limit":3,"query":"q"}' in calls.json and '"z":{"a":[2],"b":1}' in calls.json
    early = next(r for r in rows if "early" in r.json)
    assert (early.sort_turn, early.sort_step, early.n_linked) == (1, 1, 1) and rows.index(early) > rows.index(calls)
    assert [r.n_linked for r in rows if r.turn == 5] == [0] and sum(r.json.count('"r"') for r in rows) == 2
    assert next(r for r in rows if r.conv_id == 2 and r.n_calls == 1).n_invalid == 1
    assert chat.link(df.limit(0)).count() == 0


def brute_chat(rows):
    """(turn, n_calls, n_linked, n_invalid) by plain loops over parsed messages."""
    def parsed(role, text):
        try:
            x = json.loads(text or "")
        except ValueError:
            return None
        return x if isinstance(x, dict) and role in ("assistant", "tool") else None

    known = {name: (set(s["properties"]), s["required"]) for name, s in chat.TOOLS.items()}
    calls, results = collections.defaultdict(list), set()
    for conv, turn, role, text in rows:
        x = parsed(role, text) or {}
        for c in x.get("tool_calls", []) if role == "assistant" else []:
            if c.get("id") is not None:
                calls[conv, c["id"]].append(turn)
        if role == "tool" and x.get("tool_call_id") is not None:
            results.add((conv, x["tool_call_id"]))
    out = []
    for conv, turn, role, text in rows:
        x = parsed(role, text) or {}
        own = x.get("tool_calls", []) if role == "assistant" else []
        bad = sum(not (c["name"] in known and set(c["arguments"]) <= known[c["name"]][0] and set(known[c["name"]][1]) <= set(c["arguments"]) and all(isinstance(c["arguments"][k], str) for k in known[c["name"]][1])) for c in own)
        sort = turn
        if role == "tool" and x.get("tool_call_id") is not None:
            hit = calls.get((conv, x["tool_call_id"]))
            out.append((conv, max([turn, min(hit)]) if hit else sort, 0, int(bool(hit)), 0))
        else:
            out.append((conv, sort, len(own), sum((conv, c.get("id")) in results for c in own), bad))
    return sorted(out)


def test_chat_against_brute_force(spark):
    rnd = random.Random(14)
    rows = []
    for k in range(600):
        conv, turn, name = rnd.randrange(25), rnd.randrange(30), rnd.choice(["search", "calculator", "nope"])
        if k % 3 == 0:
            own = [{k: v for k, v in {"id": rnd.choice(["a", "b", "c", None]), "name": name, "arguments": rnd.choice([{"query": "q"}, {"expression": "1"}, {"query": 3}, {}, {"expression": "x", "more": 1}])}.items() if v is not None} for _ in range(rnd.randrange(1, 4))]
            rows.append((conv, turn, "assistant", json.dumps({"content": "c", "tool_calls": own})))
        elif k % 3 == 1:
            rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rnd.choice("abcd"), "content": "r"})))
        else:
            rows.append((conv, turn, "user", rnd.choice(["hello", "{}", '{"tool_calls":[]}'])))
    rows += rows[:5] + [(7, 400 + k, "tool", '{"tool_call_id":"a"}') for k in range(300)]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    assert sorted((r.conv_id, r.sort_turn, r.n_calls, r.n_linked, r.n_invalid) for r in got.collect()) == brute_chat(rows)


def test_chat_keeps_text_behind_json_and_counts_every_call(spark):
    call = '{"name":"search","arguments":{"limit":1}}'
    whole = '{"content":"c","tool_calls":[' + call + "]}"
    cases = {whole: True, whole + " \n": True, whole + "x": False, whole + ',"b":1': False, whole + "}": False, whole + ',"a":2': False, whole + ',"z":"s"}': False, "{": False, whole + whole: False}
    df = spark.createDataFrame(list(cases.items()), "text string, ok boolean")
    assert df.where(chat.whole_object(F.col("text")) != F.col("ok")).collect() == []
    rows = [(1, 0, "assistant", whole + " trailing junk"), (1, 1, "assistant", f'{{"tool_calls":[{call},{call},{call}]}}'), (1, 2, "assistant", '{"tool_calls":[{"arguments":{}}]}')]
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert json.loads(got[0].json) == {"content": rows[0][3], "role": "assistant"} and got[0].n_calls == 0
    assert (got[1].n_calls, got[1].n_invalid, got[1].n_linked) == (3, 3, 0)
    assert json.loads(got[2].json)["tool_calls"] == [{"arguments": {}}]


def test_chat_schemas(spark):
    cases = [
        ("get_weather", {"city": "x", "unit": "celsius"}, True), ("get_weather", {"city": "x", "unit": "kelvin"}, False),
        ("search", {"query": "q", "filters": ["a", "b"]}, True), ("search", {"query": "q", "filters": ["a", 1]}, False), ("search", {"query": "q", "filters": "a"}, False), ("search", {"query": "q", "filters": []}, True),
        ("fetch", {"url": "u", "retry": {"times": 2}}, True), ("fetch", {"url": "u", "retry": {"times": "2"}}, False), ("fetch", {"url": "u", "retry": {}}, False), ("fetch", {"url": "u", "headers": {"any": 1}}, True),
    ]
    df = spark.createDataFrame([(n, json.dumps(a), ok) for n, a, ok in cases], "name string, arguments string, ok boolean")
    assert df.where(chat.valid(F.col("name"), F.col("arguments")) != F.col("ok")).collect() == []


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.SQL[name])


def test_reputation_rules_and_bounds(spark):
    pages = [(k, f"http://bad.example.net/x/{k}") for k in range(40)] + [(100 + k, f"http://good.example.net/x/{100 + k}") for k in range(40)]
    pages += [(200, "HTTP://A.example.ORG/es/1"), (201, "x://org"), (202, None), (203, "no scheme"), (204, "http://b.com/de/9?q#f"), (205, "http://b.com/fr/?x"), (206, "http://example.org/en/12#t"), (207, "http://notexample.org/es/2"), (208, "http://bad.example.net?x")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({"Host": F.lit(1), "bad": F.lit(2)})
    labels = spark.createDataFrame([(k, 0, 0) for k in range(40)] + [(0, 1, 0), (None, 0, 1)] + [(100 + k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge(df, labels).collect()}
    assert len(got) == len(pages)
    assert got[3] == ("bad.example.net", "/x/3", None, "block") and got[208] == ("bad.example.net", "", None, "block") and got[103][3] == "allow"
    assert got[200] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[201] == ("org", "", None, "allow")
    assert got[202] == got[203] == ("", "", None, "allow")
    assert got[204][1:] == ("/de/9", "com/de/", "block") and got[205][1:] == ("/fr/", "com/fr/", "allow")
    assert got[206][2:] == ("example.org/en/1", "block") and got[207][2:] == ("org/", "allow")
    assert reputation.judge(df, labels.limit(0)).where("verdict = 'block'").count() == 3
    assert reputation.judge(df.limit(0), labels).count() == 0


def test_reputation_clashing_columns_and_suffixes(spark):
    pages = [(k, f"http://{'bad' if k % 2 else 'good'}.co.uk/x/{k}") for k in range(60)] + [(100, "http://www.bad.co.uk/"), (101, "http://www.good.co.uk/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("own") for c in ("said", "number", "n", "bound", "Rule")})
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    out = reputation.judge(df, labels, suffixes=("co.uk",))
    assert out.columns == ["page_id", "url", "said", "number", "n", "bound", "host", "path", "rule", "verdict"]
    got = {r.page_id: r for r in out.collect()}
    assert got[100].said == "own" and got[100].verdict == "block" and got[101].verdict == "allow"
    names = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.uk",), ("",)], "host string").select(reputation.suffix_of(F.col("host"), ("co.uk",))).collect()
    assert [r[0] for r in names] == ["co.uk", "co.uk", "uk", ""]


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(9)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in near_copies() if i < 1005]
    rows += [(2000 + k, " ".join(rnd.choice(("the", "cat", "and", "hat", "dog")) + rnd.choice(("s", "", "ing")) for _ in range(80)) + f" mail m{k}@x.org", "en", "s1", 9) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scratch, seen = Scratch(spark), {}
    at = docs
    for name, stage in P.STAGES:
        at = seen[name] = scratch.write(stage(spark, at, str(tmp_path)), name)
        assert name == "packing" or at.columns == docs.columns
    known = {i: t for i, t, *_ in rows if language.has_letter(t)}
    assert {r.doc_id for r in seen["language"].collect()} == set(known)
    want = {c for n, c in brute_components(list(known.items())).values()}
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == want
    for r in seen["personal_data"].collect():
        assert r.text == pii.redact(known[r.doc_id], pii.find(known[r.doc_id])) and r.n_chars == len(r.text) and "@" not in r.text
    mixed = collections.Counter(r.doc_id for r in seen["mixture"].collect())
    plan = mixing.plan(seen["personal_data"]).collect()
    assert mixed == collections.Counter({r.doc_id: r.copies for r in plan if r.copies})
    check_packed(seen["packing"].collect(), 4096)
    assert collections.Counter(r.doc_id for r in seen["packing"].where("piece = 0").collect()) == mixed
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packing"]
    assert P.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids, sources and texts, repeated rows and columns that clash with the stages' own go through all stages; so does an empty table."""
    import corpus_pipeline as P

    text = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river " * 3
    rows = [(1, text, "en", "a", 9)] * 3 + [(None, text + " again", "en", None, 9), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "b", 5), (4, "call +1 2345678 or mail me@x.org " + text[::-1], "en", "b", 9), (5, "der alte Hund schläft im Garten unter dem großen Baum", "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("spans", "text_redacted", "lang_pred", "score", "fp", "th", "mark_id", "own_0", "mix_h", "size", "copies", "taken", "n_email")})
    scratch, at = Scratch(spark), docs
    for name, stage in P.STAGES[:-1]:
        at = scratch.write(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns and {r["fp"] for r in at.collect()} <= {"own fp"} and {r["size"] for r in at.collect()} <= {"own size"}
        kept = collections.Counter(r["doc_id"] for r in at.collect())
        if name == "language":
            assert kept == collections.Counter({1: 3, None: 1, 4: 1, 5: 1})
        if name == "near_duplicates":
            assert kept == collections.Counter({1: 1, 4: 1, 5: 1}) or kept == collections.Counter({1: 1, None: 1, 4: 1, 5: 1})
        if name == "personal_data":
            assert all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in at.collect())
    assert check_packed(P.STAGES[-1][1](spark, at, str(tmp_path)).collect(), 4096) >= 1
    empty = docs.limit(0)
    for name, stage in P.STAGES[:-1]:
        empty = scratch.write(stage(spark, empty, str(tmp_path)), name)
        assert empty.columns == docs.columns and empty.isEmpty()
    assert P.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_mixture_starts_no_other_python_workers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    rules = mixing.thresholds(spark.createDataFrame([], "mix_k int, mix_size long, mix_h long, mix_g long"), {}, Scratch(spark))
    assert rules.collect() == [] and rules.schema.simpleString() == "struct<mix_k:int,mix_rules:array<struct<h:bigint,g:bigint,most:bigint>>>"


def test_workers_let_go_of_their_words(spark):
    def kept(batches):
        import os

        import pyarrow as pa

        from plexframe.llm import tokens

        list(batches)
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "tables": [tokens.words.cache_info().currsize]})

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(16)
    assert packing.tokenize(docs).count() > 0
    got = spark.range(64).repartition(64).mapInArrow(kept, "pid long, tables long").collect()
    assert len(got) >= 16 and max(r.tables for r in got) == 0
