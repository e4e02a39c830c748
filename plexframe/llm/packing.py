"""Best-fit packing of token sequences by a grouping genetic algorithm.

Items are dealt to shards of bounded size. Only a shard's histogram of
lengths takes part in the search, so its state is small whatever the texts
are. Best-fit decreasing gives the first solution; where it needs as many
bins as the total length demands, it is optimal and the shard is done.
Every other shard evolves on several islands, each a row of its own that any
executor may hold. An island's first population has best fits and exact
fills in orders that chance has changed. Crossover injects some whole
well-filled bins of one parent into the other, takes out the bins that hold
the same items, lets displaced items replace smaller ones where that fills a
bin better, and puts the rest back by best fit; of what is still in bins with
room, and some others, chance then lets a part be filled anew. After each
epoch an island's elite moves on to the next island; epochs end when none
has gained.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plexframe.llm import tokens
from plexframe.llm.batches import slices, tidy
from plexframe.session import Scratch

CAPACITY = 4096
#: Id at the end of every document.
END_ID = 1
SHARD_ITEMS = 50_000
#: Islands and epochs at most; generations an island goes on without a gain, and at most; parents it holds.
ISLANDS, EPOCHS, PATIENCE, GENERATIONS, POPULATION = 3, 4, 25, 200, 6


def best_fit(sizes: np.ndarray, capacity: int, room: list[int] | None = None) -> list[int]:
    """The bin of each size in the order given; ``room`` has the bins there already and is extended.

    Bins are kept by the room left in them; a bit mask of the rooms that
    occur finds the tightest that fits.
    """
    room = [] if room is None else room
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        by_room[r].append(b)
        mask |= 1 << r
    out = []
    for size in sizes.tolist():
        high = mask >> size
        if high:
            r = size + (high & -high).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        r -= size
        room[b] = r
        by_room[r].append(b)
        mask |= 1 << r
        out.append(b)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by total length, and by items that can't share a bin."""
    return max(-(-int(sizes.sum()) // capacity), int((sizes > capacity // 2).sum()))


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones beside emptier ones."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return len(fill), -float((fill * fill).sum())


def exact_fill(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """The bin of each size (descending), bin by bin: the largest that is left, then again and again the one or two that fill it best.

    Chance, if given, decides between pairs that fill it equally well.
    """
    values, first, left = np.unique(sizes, return_index=True, return_counts=True)
    held, left, n, bin_, top = left.copy(), left.copy(), len(sizes), 0, len(values) - 1
    out = np.empty(len(sizes), np.int64)

    def take(k: int) -> int:
        nonlocal n
        left[k] -= 1
        n -= 1
        out[first[k] + held[k] - left[k] - 1] = bin_
        return int(values[k])

    while n:
        while not left[top]:
            top -= 1
        room = capacity - take(top)
        while n:
            own = np.flatnonzero(left[: np.searchsorted(values, room, "right")])
            if not len(own):
                break
            one, v = own[-1], values[own]
            pick = [one]
            if values[one] < room:
                other = np.searchsorted(v, room - v, "right") - 1
                other -= (other == np.arange(len(v))) & (left[own] < 2)
                sums = np.where(other >= 0, v + v[np.maximum(other, 0)], 0)
                best = sums.max()
                if best > values[one]:
                    equal = np.flatnonzero(sums == best)
                    k = int(equal[rng.integers(len(equal))] if rng is not None else equal[0])
                    pick = [own[k], own[other[k]]]
            for k in pick:
                room -= take(k)
        bin_ += 1
    return out


def replace(bins: np.ndarray, displaced: list[int], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[int]:
    """Puts one or two displaced items in the place of one or two that are smaller, where a bin's room allows; returns what is displaced now."""
    placed = np.flatnonzero(bins >= 0)
    fill = np.bincount(bins[placed], weights=sizes[placed]).astype(np.int64)
    open_ = np.flatnonzero(fill < capacity)
    at = placed[np.argsort(bins[placed], kind="stable")]
    ends = np.cumsum(np.bincount(bins[placed], minlength=len(fill)))
    out = sorted(displaced, key=lambda k: sizes[k])
    for b in rng.permutation(open_):
        if not out:
            break
        items = at[ends[b - 1] if b else 0 : ends[b]][:24].tolist()
        room, v = capacity - int(fill[b]), sizes[out]
        best = (0, None, None)
        for gone in [(i,) for i in items] + [(i, j) for x, i in enumerate(items) for j in items[x + 1 :]]:
            size = int(sum(sizes[i] for i in gone))
            other = np.searchsorted(v, size + room - v, "right") - 1
            other -= other == np.arange(len(v))
            sums = np.where(other >= 0, v + v[np.maximum(other, 0)], 0)
            k = int(sums.argmax())
            single = int(np.searchsorted(v, size + room, "right")) - 1
            for gain, come in ((int(sums[k]) - size, [k, int(other[k])]), (int(v[single]) - size if single >= 0 else 0, [single])):
                if gain > best[0]:
                    best = (gain, gone, come)
            if best[0] == room:
                break
        gain, gone, come = best
        if gain:
            for k in come:
                bins[out[k]] = b
            for i in gone:
                bins[i] = -1
            out = sorted([x for k, x in enumerate(out) if k not in come] + list(gone), key=lambda k: sizes[k])
    return out


def _named(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def crossover(host: np.ndarray, donor: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``host`` with some of the fullest bins of ``donor`` put in; sizes are in descending order."""
    fill = np.bincount(donor, weights=sizes)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = rng.choice(full, size=max(1, min(len(full), 1 + int(len(fill) * rng.uniform(0, 0.1)))), replace=False)
    injected = np.isin(donor, chosen)
    hit = np.unique(host[injected])
    # The host's emptiest bin goes too, so that its items get a chance elsewhere.
    hit = np.union1d(hit, [np.bincount(host, weights=sizes).argmin()])
    displaced = np.isin(host, hit) & ~injected
    kept = ~injected & ~displaced
    child = np.full(len(sizes), -1)
    names, child[kept] = np.unique(host[kept], return_inverse=True)
    mine, into = np.unique(donor[injected], return_inverse=True)
    child[injected] = into + len(names)
    rest = replace(child, np.flatnonzero(displaced).tolist(), sizes, capacity, rng)
    rest = np.array(sorted(rest), int)
    room = (capacity - np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=len(names) + len(mine))).astype(int).tolist()
    child[rest] = best_fit(sizes[rest], capacity, room)
    return _named(child)


def refill(bins: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The bins with room and as many others by chance, filled anew if that takes no more of them."""
    fill = np.bincount(bins, weights=sizes)
    open_ = np.flatnonzero(fill < capacity)
    full = np.flatnonzero(fill == capacity)
    again = np.r_[open_, rng.choice(full, size=min(len(full), len(open_) * int(rng.integers(1, 6))), replace=False)]
    own = np.flatnonzero(np.isin(bins, again))
    anew = exact_fill(sizes[own], capacity, rng)
    out = bins.copy()
    out[own] = len(fill) + anew
    out = _named(out)
    return out if fitness(out, sizes, capacity) <= fitness(bins, sizes, capacity) else bins


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION, patience: int = PATIENCE) -> np.ndarray:
    """The best assignment of items (sizes descending) to bins that an island finds."""
    least = lower_bound(sizes, capacity)
    best = min(elites, key=lambda x: fitness(x, sizes, capacity)) if elites else np.array(best_fit(sizes, capacity))
    if best.max(initial=-1) + 1 <= least:
        return best
    rng = np.random.default_rng(seed)
    pool = [*(elites or [best])]
    while len(pool) < population:
        if len(pool) % 2:
            pool.append(exact_fill(sizes, capacity, rng))
        else:  # best fit in an order that chance has changed a little
            order = np.argsort(-sizes * rng.uniform(0.9, 1.1, len(sizes)), kind="stable")
            one = np.empty(len(sizes), int)
            one[order] = best_fit(sizes[order], capacity)
            pool.append(one)
    score = [fitness(x, sizes, capacity) for x in pool]
    idle = 0
    for _ in range(generations):
        before = min(score)
        if before[0] <= least or idle >= patience:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        child = refill(crossover(pool[a], pool[b], sizes, capacity, rng), sizes, capacity, rng)
        own, worst = fitness(child, sizes, capacity), max(range(len(pool)), key=score.__getitem__)
        if own < score[worst] and own not in score:
            pool[worst], score[worst] = child, own
        idle = 0 if min(score)[0] < before[0] else idle + 1
    return pool[min(range(len(pool)), key=score.__getitem__)]


_STATE = "shard long, island int, sizes array<int>, counts array<int>, elites array<array<int>>, bins int, least int"


def _epoch(capacity: int, epoch: int):
    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                sizes = np.repeat(np.asarray(r.sizes, int), np.asarray(r.counts, int))
                best = evolve(sizes, [np.asarray(x, int) for x in r.elites], capacity, seed=(epoch << 32) + (int(r.island) << 24) + int(r.shard) % (1 << 24))
                out.append((r.shard, r.island, r.sizes, r.counts, [best.tolist()], int(best.max(initial=-1)) + 1, lower_bound(sizes, capacity)))
            yield pd.DataFrame(out, columns=["shard", "island", "sizes", "counts", "elites", "bins", "least"])

    return run


def _slots(shard: pa.Table, best: pa.Table) -> pa.Table:
    """Gives a shard's items (one task holds SHARD_ITEMS or so) the bins of the solution, item by item of a size."""
    sizes = shard["length"].to_numpy()
    order = np.lexsort((shard["pack_place"].to_numpy(), -sizes))
    bins = np.empty(len(sizes), np.int64)
    bins[order] = np.asarray(best["elites"][0].as_py()[0], np.int64)
    by_bin = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[by_bin])
    first = np.r_[True, np.diff(bins[by_bin]) != 0]
    begin = (ends - sizes[by_bin])[np.flatnonzero(first)]
    offset = np.empty(len(sizes), np.int64)
    offset[by_bin] = ends - sizes[by_bin] - begin[np.cumsum(first) - 1]
    sequence = (shard["pack_shard"].to_numpy() << 32) + bins
    return shard.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).drop_columns(["pack_place", "pack_shard"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Appends sequence_id and offset to rows with a ``length`` from 0 to ``capacity``.

    Shards are packed by themselves, so each may leave one bin more than all
    together would need.

    The rows are numbered as they are written, once: how a table is read
    again depends on the cores of the moment, and a row's shard must not.
    Rows of the full capacity are sequences by themselves. Equal lengths are
    interchangeable, repeated rows are packed once each, an empty table stays
    empty. Columns sequence_id, offset, pack_place and pack_shard of ``pieces`` are replaced.
    """
    scratch = scratch or Scratch(pieces.sparkSession)
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset", "pack_place", "pack_shard")])
    numbered = scratch.write(pieces.withColumn("pack_place", F.monotonically_increasing_id()), "pieces")
    n = numbered.where(F.col("length") < capacity).count()
    shards = max(1, math.ceil(n / SHARD_ITEMS))
    full = numbered.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("pack_place"), "offset": F.lit(0).cast("long")})
    dealt = numbered.where(F.col("length") < capacity).withColumn("pack_shard", F.pmod(F.xxhash64("pack_place"), F.lit(shards)).cast("long"))
    histogram = dealt.groupBy("pack_shard", "length").agg(F.count("*").cast("int").alias("n")).groupBy("pack_shard")
    cells = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("length").cast("int").alias("size"), "n"))))  # a cell per length at most
    start = histogram.agg(cells.alias("cells")).select(F.col("pack_shard").alias("shard"), F.lit(0).alias("island"), F.col("cells.size").alias("sizes"), F.col("cells.n").alias("counts"), F.expr("array() :: array<array<int>>").alias("elites"))
    spread = max(1, min(shards, 4096))
    state = scratch.write(start.repartition(spread, "shard").mapInPandas(_epoch(capacity, 0), _STATE), "seeded")
    total = None
    for epoch in range(1, EPOCHS + 1):
        open_ = state.where("bins > least")
        now = open_.groupBy("shard").agg(F.min("bins").alias("n")).agg(F.sum("n")).first()[0]
        if now is None or total is not None and now >= total:
            break  # all are optimal, or no island has gained in the last epoch
        total = now
        if epoch == 1:
            islands = open_.drop("island").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).select(*[c.split()[0] for c in _STATE.split(", ")])
        else:  # each island also gets the elite of the one before
            come = state.select("shard", F.expr(f"(island + 1) % {ISLANDS}").alias("island"), F.col("elites").alias("more"))
            islands = open_.join(come, ["shard", "island"], "left").withColumn("elites", F.concat("elites", F.coalesce("more", F.array().cast("array<array<int>>")))).drop("more")
        islands = islands.repartition(spread * ISLANDS, "shard", "island").mapInPandas(_epoch(capacity, epoch), _STATE)
        grown = scratch.write(islands.unionByName(state), "epoch")
        last, state = state, scratch.write(grown.groupBy("shard", "island").agg(*[F.min_by(c, "bins").alias(c) for c in ("sizes", "counts", "elites")], F.min("bins").alias("bins"), F.min("least").alias("least")), "best")
        scratch.drop(last, grown)
    best = state.groupBy("shard").agg(F.min_by("elites", "bins").alias("elites"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = dealt.groupBy("pack_shard").cogroup(best.withColumnRenamed("shard", "pack_shard").groupBy("pack_shard")).applyInArrow(_slots, schema)
    return full.select(*schema.names).unionByName(placed)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each document's ids and END_ID, cut where they exceed ``capacity``.

    Null text counts as empty and is one piece of length 1; a document with
    a null id is treated like any other.
    """

    def run(batches):
        words = tokens.words(vocabulary)
        end = END_ID.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = words.ids(text or "") + end
                    rows += [(doc, k, at // 4, min(capacity, (len(ids) - at) // 4), zlib.crc32(ids[at : at + 4 * capacity])) for k, at in enumerate(range(0, len(ids), 4 * capacity))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = pa.string() if docs.schema[id_col].dataType == T.StringType() else pa.int64()
    name = "string" if kind == pa.string() else "long"
    rows = docs.select(F.col(id_col).cast(name).alias("id"), F.col(text_col).alias("text"))
    # Not tidy(run, "tokens"): idle workers would each keep a table of words beside those of the stages' own.
    return rows.mapInArrow(tidy(run), f"doc_id {name}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes, cuts and packs whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenize(docs, id_col, text_col, capacity), capacity)
