"""N-gram Jaccard join by prefix filtering under several global token orders.

Two texts link when the Jaccard similarity of their shingle sets reaches the
threshold. Under any global order of the shingles, two such sets share one
among the first n - ceil(t * n) + 1 of each (their prefixes), so:

1. A sketch of fixed size counts, over all texts, how often each shingle
   hash occurs. It only has to be a function of the shingle to serve as a
   global order; rare ones come first. A shingle whose counter is 1 occurs
   in no other text and needs no posting.
2. Rows of equal sets form a class. The remaining prefix shingles of the
   classes are posted; a shingle that several classes share makes them
   candidates, if sizes and positions leave room for enough overlap.
3. Two further orders filter the candidates by a join with the classes'
   prefixes under each: a pair stays if, under both, the shared prefix
   shingles and what lies behind the prefixes leave room for enough overlap
   (so one must be shared). No text has moved until here.
4. What passes all orders is verified exactly, on whole sets.
5. Links are found in rounds: first every posted class against a hub of
   each of its shingles, then the pairs between different components, a growing band
   of pair hashes at a time. Pairs that earlier links have joined drop out,
   so a large group of near copies costs about its size, and each pair that
   could still join two components is verified in its band.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plexframe.llm.batches import lean, slices, tidy
from plexframe.llm.shingles import WIDTH, fingerprint, mix, shingle_hashes, shingle_sets
from plexframe.operators.components import connected_components
from plexframe.session import Scratch

#: Similarity of at least this percentage links.
PERCENT = 80
#: The sketch has a counter of four bits for each of 2 ** bits buckets; it is broadcast, 64 MB at most.
MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 27, 16
#: Seeds of the further orders.
ORDERS = (101, 202)
#: Classes that a task remembers, so as to post equal sets once.
SEEN = 200_000
GROUP_PAIRS, HUB_PAIRS = 2_000, 500
#: Rounds against hubs; pairs of the first band behind them, or one to so many postings, or 2 % of all that are left:
#: bands grow with the table, so that their number doesn't.
STARS, BAND_PAIRS, BAND_SHARE = 3, 10_000, 8
#: Postings of a shingle that one task pairs with as many others; a longer list is cut into blocks.
LIST = 2000
#: Bytes of marked rows that are broadcast at most, and pairs or labels (16 bytes each); more are joined by a shuffle.
MARK_BYTES, SMALL = 32 << 20, 1_000_000
FAN_IN = 1024
#: Text bytes that are shingled at once: the hashes take some twenty times as much.
SHINGLE_BYTES = 2 << 20


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _level(total: np.ndarray) -> np.ndarray:
    """Four bits of a count: exact to 4, then by powers of two."""
    big = 4 + np.floor(np.log2(np.maximum(total, 4) / 4)).astype(np.int64)
    return np.minimum(np.where(total <= 4, total, big), 15).astype(np.uint8)


def _small(total: np.ndarray) -> np.ndarray:
    """A sum in one byte: exact to 127, then eight steps to a doubling."""
    return np.where(total < 128, total, np.minimum(128 + 8 * np.log2(np.maximum(total, 128) / 128), 255)).astype(np.uint8)


def _large(small: np.ndarray) -> np.ndarray:
    wide = small.astype(np.int64)
    return np.where(wide < 128, wide, (128 * 2 ** ((wide - 128) / 8)).astype(np.int64))


def sketch(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, int]:
    """Counter levels, two to a byte, and the bits of a bucket number.

    Every task adds min(3, its count) per bucket; sums go up in two steps,
    FAN_IN tasks each first, so that no group grows with all of them.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(MIN_BITS, min(MAX_BITS, math.ceil(math.log2(max(2, size / 6)))))
    per = 1 << BLOCK_BITS

    def count(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, n = [], 0

        def flush():
            at, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(at, np.arange(0, (1 << bits) + per, per))
            for k in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[k], cuts[k + 1])
                low, more = (at[own] & (per - 1)).astype(np.uint16), times[own]
                yield int(k), part // FAN_IN, low[more == 1].tobytes(), low[more == 2].tobytes(), low[more > 2].tobytes()

        def rows():
            nonlocal held, n
            for whole in batches:
                for batch in slices(whole, "text", SHINGLE_BYTES):
                    h, offsets = shingle_hashes(batch.column("text"), width)
                    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(offsets))
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
                    held.append((h[new] >> np.uint64(64 - bits)).astype(np.uint32))
                    n += len(held[-1])
                    if n > 4_000_000:
                        yield from flush()
                        held, n = [], 0
            if held:
                yield from flush()

        for chunk in _chunks(rows(), 512):
            cols = list(zip(*chunk, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["block", "part", "one", "two", "three"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for name, times in (("one", 1), ("two", 2), ("three", 3)):
            for v in table[name].to_pylist():
                total[np.frombuffer(v, np.uint16)] += times
        return pa.table({"block": table["block"][:1], "counts": pa.array([_small(total).tobytes()], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        level = _level(sum(_large(np.frombuffer(v, np.uint8)) for v in table["counts"].to_pylist()))
        return pa.table({"block": table["block"][:1], "levels": pa.array([(level[::2] | level[1::2] << 4).tobytes()], pa.binary())})

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "block int, part int, one binary, two binary, three binary")
    sums = parts.groupBy("block", "part").applyInArrow(add, "block int, counts binary").groupBy("block").applyInArrow(total, "block int, levels binary").toArrow()
    out = np.zeros(1 << bits >> 1, np.uint8)
    for k, v in zip(sums["block"].to_pylist(), sums["levels"].to_pylist(), strict=True):
        out[k * per // 2 : (k + 1) * per // 2] = np.frombuffer(v, np.uint8)
    return out, bits


def _chunks(rows, n: int):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def levels(table: np.ndarray, bits: int, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    return table[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


def prefix(own: np.ndarray, table: np.ndarray, bits: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings of a set (sorted hashes): the shingles of its prefix that others may have, and their positions."""
    level = levels(table, bits, own)
    order = np.argsort(level.astype(np.uint64) << np.uint64(60) | own >> np.uint64(4), kind="stable")[: prefix_size(len(own), percent)]
    at = np.flatnonzero(level[order] > 1)
    return own[order[at]], at


def signature(own: np.ndarray, seed: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """A set's prefix under a further order, and how many common shingles may lie elsewhere.

    The prefix is kept as distinct halves of the hashes; what falls together
    counts as lying elsewhere, so that a bound by them loses no link.
    """
    take = prefix_size(len(own), percent)
    ranked = mix(own, seed)
    if take < len(ranked):
        ranked = np.partition(ranked, take - 1)[:take]
    kept = np.unique((ranked >> np.uint64(32)).astype(np.uint32)).view(np.int32)
    return kept, len(own) - len(kept)


#: kind of a row -> its columns.
_KINDS = {0: ["doc_id", "th", "n", "fp"], 1: ["token", "fp", "n", "pos"], 2: ["fp", "n", "text", "one", "rest_one", "two", "rest_two"]}


def _post(docs: DataFrame, id_col: str, text_col: str, table: np.ndarray, bits: int, width: int, percent: int) -> DataFrame:
    """kind 0: each row's id, text hash, set size and class; kind 1: postings; kind 2: texts and signatures of posted classes."""
    handle = docs.sparkSession.sparkContext.broadcast((table, bits))
    id_type = docs.schema[id_col].dataType.simpleString()
    ints = pa.list_(pa.int32())
    schema = {"kind": pa.int32(), "doc_id": None, "th": pa.int64(), "n": pa.int32(), "fp": pa.int64(), "token": pa.int64(), "pos": pa.int32(), "text": pa.string(), "one": ints, "rest_one": pa.int32(), "two": ints, "rest_two": pa.int32()}

    def run(batches):
        table, bits = handle.value
        seen: set[int] = set()

        def made(kind: int, rows: int, id_kind, **columns) -> pa.RecordBatch:
            types = schema | {"doc_id": id_kind}
            columns = {"kind": np.full(rows, kind)} | columns
            arrays = [pa.nulls(rows, t) if (c := columns.get(name)) is None else c if isinstance(c, pa.Array) else pa.array(c, t) for name, t in types.items()]
            return pa.RecordBatch.from_arrays(arrays, names=list(types))

        for whole in batches:
            for batch in slices(whole, "text", SHINGLE_BYTES):
                sets = shingle_sets(batch.column("text"), width)
                fps = [fingerprint(s) if len(s) else 0 for s in sets]
                own_rows, post, signed = [], [], []
                for k, (own, fp) in enumerate(zip(sets, fps, strict=True)):
                    if not len(own) or fp in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(fp)
                    tokens, at = prefix(own, table, bits, percent)
                    if len(tokens):
                        own_rows.append(k)
                        post.append((tokens.view(np.int64), at, np.full(len(at), k)))
                        signed.append([signature(own, seed, percent) for seed in ORDERS])
                size = np.array([len(s) for s in sets], np.int32)
                fps = np.array(fps, np.int64)
                id_kind = batch.schema.field("id").type
                yield made(0, len(sets), id_kind, doc_id=batch.column("id"), th=batch.column("th"), n=size, fp=fps)
                if post:
                    tokens, at, k = (np.concatenate(x) for x in zip(*post, strict=True))
                    yield made(1, len(tokens), id_kind, n=size[k], fp=fps[k], token=tokens, pos=at)
                    k = np.array(own_rows)
                    lists = {}
                    for j, name in enumerate(("one", "two")):
                        kept, rest = zip(*(x[j] for x in signed), strict=True)
                        lists[name] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in kept])], pa.int32()), pa.array(np.concatenate(kept)))
                        lists["rest_" + name] = np.array(rest)
                    yield made(2, len(k), id_kind, n=size[k], fp=fps[k], text=batch.column("text").take(pa.array(k)).cast(pa.string()), **lists)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"kind int, doc_id {id_type}, th long, n int, fp long, token long, pos int, text string, one array<int>, rest_one int, two array<int>, rest_two int")


def small(table: DataFrame, rows: int) -> DataFrame:
    """The table, broadcast if it has no more than SMALL rows, so that texts stay where they are."""
    return F.broadcast(table) if rows <= SMALL else table


def sifted(pairs: DataFrame, signed: DataFrame, percent: int, n_pairs: int) -> DataFrame:
    """The pairs (a, b) whose prefixes under every further order leave room for enough overlap."""
    fields = ("n", "one", "rest_one", "two", "rest_two")
    of = lambda c: signed.select(F.col("fp").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in fields])
    # The signatures of either side are picked by the pairs first, then the two halves meet.
    half = lambda c: of(c).join(small(pairs, n_pairs), c)
    out = half("a").join(half("b"), ["a", "b"])
    for order in ("one", "two"):
        out = out.withColumn("shared", F.size(F.array_intersect(f"a_{order}", f"b_{order}"))).where(F.expr(f"shared > 0 AND (shared + CAST(greatest(a_rest_{order}, b_rest_{order}) AS long)) * {100 + percent} >= {percent}L * (CAST(a_n AS long) + b_n)"))
    return out.select("a", "b")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets (sorted) reach the threshold."""
    both = _shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int, n_pairs: int) -> DataFrame:
    """The pairs (a, b) of classes that link, both texts' sets compared in one task.

    A hub of many pairs is split, so that a group holds GROUP_PAIRS or so.
    """
    groups = max(1, n_pairs // GROUP_PAIRS)
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    salted = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / HUB_PAIRS))).withColumn("bucket", F.pmod(F.xxhash64("a", "salt"), F.lit(groups))).select("bucket", "a", "b")
    other = texts.select(F.col("fp").alias("b"), "text").join(small(salted, n_pairs), "b").select("bucket", "a", "b", "text")
    hub = texts.select(F.col("fp").alias("a"), "text").join(small(salted.select("bucket", "a").distinct(), n_pairs), "a").select("bucket", "a", F.lit(None).cast("long").alias("b"), "text")

    def run(table: pa.Table) -> pa.Table:
        lean()
        a, b = table["a"].to_pylist(), table["b"].to_pylist()
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch, "text", SHINGLE_BYTES):
                sets += shingle_sets(part.column("text"), width)
        hubs = {x: s for x, y, s in zip(a, b, sets, strict=True) if y is None}
        good = [(x, y) for x, y, s in zip(a, b, sets, strict=True) if y is not None and linked(hubs[x], s, percent)]
        return pa.table({"a": pa.array([x for x, _ in good], pa.int64()), "b": pa.array([y for _, y in good], pa.int64())})

    return hub.unionByName(other).groupBy("bucket").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): every row's doc_id, th (text hash), n and fp (its class), and fp -> component of the linked classes."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    table, bits = sketch(docs, text_col, width)
    rows, posts, posted = scratch.split(_post(docs, id_col, text_col, table, bits, width, percent), "kind", _KINDS, "posted")
    held = scratch.write(_shared_lists(posts.withColumn("c", F.col("fp"))).dropDuplicates(["token", "fp"]), "lists")
    scratch.drop(posts)
    scratch.settle()
    texts = scratch.write(posted.join(held.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "texts")
    scratch.drop(posted)
    scratch.settle()

    links: list[DataFrame] = []
    labels, named_classes = spark.createDataFrame([], "node long, component long"), 0

    def check(pairs: DataFrame) -> None:
        nonlocal labels, named_classes
        pairs = scratch.write(pairs, "pairs")
        kept = scratch.write(sifted(pairs, texts, percent, pairs.count()), "sifted")
        if n := kept.count():
            links.append(scratch.write(verify(kept, texts, width, percent, n), "links"))
            last, labels = labels, scratch.write(connected_components(reduce(DataFrame.union, links), scratch), "labels")
            named_classes = labels.count()
            scratch.drop(last)
        scratch.drop(pairs, kept)
        scratch.settle()

    # In long: products of int sizes pass 2^31 from 119,305 shingles on.
    near = lambda x, y: F.expr(f"100L * least({x}.n - {x}.pos, {y}.n - {y}.pos) * {100 + percent} >= 100L * {percent} * (CAST({x}.n AS long) + {y}.n)") & F.expr(f"100L * least({x}.n, {y}.n) >= {percent}L * greatest({x}.n, {y}.n)")

    def alive() -> DataFrame:
        """Postings with their components, of the shingles that still join two; a shingle that no longer does stays out."""
        nonlocal held
        named = held.drop("c", "blocks").join(small(labels, named_classes), F.col("fp") == F.col("node"), "left").select("token", "fp", "n", "pos", F.coalesce("component", "fp").alias("c"))
        last, held = held, scratch.write(_shared_lists(named), "named")
        scratch.drop(last)
        return held

    for k in range(STARS):  # one hub for all shingles of a group first, then one of each shingle's own
        named = held if k == 0 else alive()
        rank = F.xxhash64(F.lit(k), "fp") if k == 0 else F.xxhash64(F.lit(k), "fp", "token")
        hubs = named.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "fp", "n", "pos", "c")).alias("h")).select("token", "h.*")
        check(named.alias("x").join(hubs.alias("y"), "token").where((F.col("x.c") != F.col("y.c")) & near("x", "y")).select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b")).distinct())

    low, budget = 0, BAND_PAIRS
    full = 1 << 62
    while low < full:
        named = alive()
        # Blocks ascend with fp, so the smaller class of a pair lies in the same block or an earlier one: x comes
        # once for its own and every later block of y, y once for its own and every earlier block of x.
        block = F.shiftright((F.shiftright("fp", 32) + F.lit(1 << 31)) * F.col("blocks"), 32)
        cut = named.withColumn("own", block)
        x = cut.withColumnRenamed("own", "i").withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1))).alias("x")
        y = cut.withColumnRenamed("own", "j").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j")))).alias("y")
        hash_ = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("x.fp"), F.col("y.fp")), 2)
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        cross = x.join(y, same & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.c") != F.col("y.c")) & near("x", "y") & (hash_ >= low))
        # How many there are decides how wide a band this round takes.
        n = cross.where(F.pmod(hash_, F.lit(1 << 4)) == 0).count() * 16
        budget = max(budget, 2 * n // 100, named.count() // BAND_SHARE if low == 0 else 0)
        high = full if n <= budget else low + int((full - low) * (budget / n))
        a = F.when(F.col("x.n") <= F.col("y.n"), F.struct(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))).otherwise(F.struct(F.col("y.fp").alias("a"), F.col("x.fp").alias("b")))
        check(cross.where(hash_ < high).select(a.alias("p")).select("p.*").distinct())
        low, budget = high, budget * 2
    scratch.drop(held, texts, *links)
    return rows, labels


def _shared_lists(posts: DataFrame) -> DataFrame:
    """The postings of shingles that join two components, with the number of ``blocks`` that their list is cut into.

    Postings are dealt by shingle once, for the summary and for the join
    with it: the summary looks at every column, so that both read the same
    exchange.
    """
    dealt = posts.repartition("token")
    every = F.least(F.min("fp").isNotNull().cast("int"), F.min("n"), F.min("pos") + 1)
    live = dealt.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("many"), every.alias("every")).where("low < high AND every > 0").select("token", F.ceil(F.col("many") / LIST).alias("blocks"))
    return dealt.join(live.hint("shuffle_merge"), "token")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the smallest doc_id that links reach; rows of the same
    set are linked. Rows without words (null text too) are linked with
    nothing, so their component is themselves. Null ids are passed over for
    the smallest; a component of null ids only has null. Repeated rows each
    return. An empty table stays empty. Other columns of ``docs`` are not
    read.
    """
    rows, labels = classes(docs, id_col, text_col, width, percent)
    sets = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = sets.join(labels, sets.fp == labels.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    found = rows.where("n > 0").join(named.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which one per component stays: the one of the smallest id, nulls last.

    Rows without words (null text too) all stay. Of rows of the same id and
    text one stays, whose other columns hash least (maps aside). An empty table
    stays empty; columns of any names are returned as they are. The choice
    is made on ids and hashes; texts are then filtered where they lie, by a
    broadcast of the rows that go if these are few (MARK_BYTES).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows, labels = classes(docs, id_col, text_col, width, percent, scratch)
    rows = rows.where("n > 0").groupBy("fp", "doc_id", "th").agg(F.count("*").alias("times"))
    sets = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")).alias("first"))
    named = sets.join(labels, sets.fp == labels.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    first = named.join(named.groupBy("c").agg(F.min("first").alias("least")), "c").select("fp", "least")
    keeper = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    marked = rows.join(first, "fp").select(F.col("doc_id").alias("mark_id"), F.col("th").alias("mark_th"), keeper.alias("stays"), "times").where("NOT stays OR times > 1")
    marked = scratch.write(marked, "marked")
    size = marked.agg(F.sum(16 + F.coalesce(F.octet_length(F.col("mark_id").cast("string")), F.lit(0)))).first()[0] or 0
    marks = F.broadcast(marked) if size <= MARK_BYTES else marked
    own = docs.toDF(*[f"own_{k}" for k in range(len(docs.columns))])
    at = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    th = F.xxhash64(at[text_col])
    same = (th == F.col("mark_th")) & F.col(at[id_col]).eqNullSafe(F.col("mark_id"))
    out = own.join(marks, same, "left_anti")
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        plain = [f.name for f in own.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        some = own.join(F.broadcast(repeated) if size <= MARK_BYTES else repeated, same).select(*own.columns, "mark_th", "mark_id")
        one = some.groupBy("mark_id", "mark_th").agg(F.min_by(F.struct(*own.columns), F.xxhash64(*plain)).alias("r"))
        out = out.unionByName(one.select("r.*"))
    return out.toDF(*docs.columns)
