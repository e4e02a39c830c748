"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is then assigned to its
leaf. Leaves that get very many rows are split by trees fitted on samples of
their own rows, so that the tree grows with the table. To search by inner product, rows get one more coordinate that makes
all of one length, so nearness on the tree means a large product. A query
walks the tree with a priority queue of nodes by distance and so lists the
leaves best first. How many it visits is calibrated: for a sample of queries
the true neighbours are found by brute force, and visits widen until the
wanted share of them lies in visited leaves. Scores are exact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from plexframe.session import Scratch

#: Bounds: rows and bytes of the fitting sample, queries that calibrate, the recall they are to reach.
SAMPLE_ROWS, SAMPLE_BYTES, CALIBRATION, RECALL = 20_000, 64 << 20, 256, 0.93
BRANCH, LEAF_SAMPLE = 8, 32
#: A leaf of more rows is split once more, by a sample of its own; leaves there may be at most (the tree is broadcast).
LEAF_ROWS, SPLIT_SAMPLE, MAX_LEAVES = 4096, 4096, 16_384
#: Rows and queries that a search task takes at most; queries that walk the tree in one task.
BLOCK, QUERY_BLOCK, WALK = 8192, 4096, 256


@dataclass
class Tree:
    """Nodes in one list; a leaf has no children. ``norm2`` is the squared length that rows are padded to."""

    centres: np.ndarray
    children: list[list[int]]
    norm2: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        x = self.pad(x.astype(np.float64))
        node = np.zeros(len(x), np.int64)
        todo = [0]
        while todo:
            k = todo.pop()
            if self.children[k] and len(own := np.flatnonzero(node == k)):
                kids = np.array(self.children[k])
                c = self.centres[kids]
                node[own] = kids[((c * c).sum(1) - 2 * x[own] @ c.T).argmin(1)]
                todo += self.children[k]
        return node

    def visits(self, query: np.ndarray, counts: dict[int, int], leaves: int, least: int) -> list[int]:
        """Leaves best first: ``leaves`` of them, and on until they hold ``least`` rows; empty ones don't count."""
        q = np.append(query, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or held < least):
            _, k = heapq.heappop(queue)
            if not self.children[k]:
                if counts.get(k):
                    out.append(k)
                    held += counts[k]
                continue
            away = self.centres[self.children[k]] - q
            for d, child in zip((away * away).sum(1), self.children[k], strict=True):
                heapq.heappush(queue, (float(d), child))
        return out


def fit(sample: np.ndarray, norm2: float, leaves: int, seed: int = 1) -> Tree:
    """A tree of about ``leaves`` leaves; the largest node is split next."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), [[]], norm2)
    x = tree.pad(sample.astype(np.float64))
    centres = [x.mean(0) if len(x) else np.zeros(sample.shape[1] + 1)]
    heap = [(-len(x), 0, np.arange(len(x)))]
    n = 1
    while heap and n < leaves:
        size, k, own = heapq.heappop(heap)
        if -size < 2 * LEAF_SAMPLE:
            break
        groups = _kmeans(x[own], min(BRANCH, leaves - n + 1), rng)
        if groups is None:
            continue  # all rows are alike
        for c, part in groups:
            tree.children[k].append(len(centres))
            tree.children.append([])
            heapq.heappush(heap, (-len(part), len(centres), own[part]))
            centres.append(c)
        n += len(groups) - 1
    tree.centres = np.array(centres)
    return tree


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8):
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        used = np.unique(near)
        c = np.array([x[near == j].mean(0) for j in used])
    near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
    used = np.unique(near)
    return [(c[j], np.flatnonzero(near == j)) for j in used] if len(used) > 1 else None


def deepen(tree: Tree, index: DataFrame, counts: dict[int, int]) -> Tree:
    """The tree with every leaf of more than LEAF_ROWS rows split, as far as MAX_LEAVES allows.

    ``index`` has v and leaf. Each such leaf sends SPLIT_SAMPLE rows or so to
    a task, which fits a tree below it; the driver gets centres only.
    """
    large = {k: n for k, n in counts.items() if n > LEAF_ROWS}
    free = MAX_LEAVES - len(counts)
    if not large or free <= 0:
        return tree
    wanted = {k: -(-n // LEAF_ROWS) * 2 for k, n in large.items()}
    shrink = min(1.0, free / sum(wanted.values()))
    plan = [(k, max(2, int(wanted[k] * shrink)), min(1.0, SPLIT_SAMPLE / n)) for k, n in large.items()]
    spark = index.sparkSession
    plan = F.broadcast(spark.createDataFrame(plan, "leaf int, leaves int, share double"))  # a row per leaf
    some = index.join(plan, "leaf").where((F.shiftrightunsigned(F.xxhash64(F.lit(13), "id"), 11) / float(1 << 53)) < F.col("share"))

    def split(rows: pa.Table) -> pa.Table:
        below = fit(matrix(rows["v"]), tree.norm2, rows["leaves"][0].as_py(), seed=rows["leaf"][0].as_py())
        parent = np.full(len(below.children), -1)
        for k, kids in enumerate(below.children):
            parent[kids] = k
        return pa.table({"leaf": pa.array([rows["leaf"][0].as_py()] * len(parent), pa.int32()), "node": pa.array(np.arange(len(parent)), pa.int32()), "parent": pa.array(parent, pa.int32()), "centre": pa.array(below.centres.tolist(), pa.list_(pa.float64()))})

    got = some.groupBy("leaf").applyInArrow(split, "leaf int, node int, parent int, centre array<double>").toArrow()
    children, centres = [list(c) for c in tree.children], tree.centres.tolist()
    names: dict[tuple[int, int], int] = {}
    for leaf, node, parent, centre in sorted(zip(*(got[c].to_pylist() for c in ("leaf", "node", "parent", "centre")), strict=True)):
        if parent < 0:
            names[leaf, node] = leaf  # the root below is the leaf itself
            continue
        names[leaf, node] = len(centres)
        children[names[leaf, parent]].append(len(centres))
        centres.append(centre)
        children.append([])
    return Tree(np.array(centres), children, tree.norm2)


def matrix(column) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def top(query_ids, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """(query, row, score) of each query's k best rows but itself; ties go to smaller ids.

    Of equal vectors only the k + 1 smallest ids can matter. A matrix
    product picks the candidates; their scores are then summed one way, so
    that equal vectors score the same in every block.
    """
    order = np.lexsort((ids, *rows.T[::-1])) if len(rows) else np.zeros(0, int)
    ids, rows = ids[order], rows[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)] if len(rows) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    keep = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)])) <= k
    ids, rows = ids[keep], rows[keep]
    out_q, out_r, out_s = [], [], []
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        rough = part @ rows.T
        for q, own, near in zip(query_ids[start : start + 256], part, rough, strict=True):
            take = min(len(near), k + 1)
            floor = np.partition(near, len(near) - take)[len(near) - take] if take else 0
            slack = 1e-9 * (1 + np.abs(near).max(initial=0))
            at = np.flatnonzero((near >= floor - slack) & (ids != q))
            score = (rows[at] * own).sum(1)
            best = np.lexsort((ids[at], -score))[:k]
            out_q.append(np.full(len(best), q))
            out_r.append(ids[at][best])
            out_s.append(score[best])
    return [np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_r, out_s)]


def _result(q, r, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(r.astype(np.int64)), pa.array(s.astype(np.float64))], names=["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of the rows that take part: id not null, the commonest dimension, finite components, not zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each query.

    ``queries`` are rows like ``vectors``; a query isn't its own neighbour
    (rows compare by id). Rows that ``usable`` rejects take no part.
    Repeated query ids count once, with the least of their vectors; repeated
    rows are candidates each. Ties go to smaller ids. Fewer than k candidates:
    all of them. No candidates or no queries: no rows. Other columns of either
    table are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = usable(vectors, id_col, vec_col)
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm2")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, d = shape["n"], shape["d"]
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    part = max(1, -(-n // size))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(part)) == 0).limit(size).select("v").toArrow()
    sample = matrix(sample["v"]) if sample.num_rows else np.zeros((0, d))
    tree = fit(sample, shape["norm2"], leaves=max(1, min(int(n**0.5), len(sample) // LEAF_SAMPLE)))
    kind = rows.schema["v"].dataType.simpleString()

    def indexed(source: DataFrame, tree: Tree) -> tuple:
        handle = spark.sparkContext.broadcast(tree)  # at most SAMPLE_ROWS / LEAF_SAMPLE leaves at first, MAX_LEAVES in the end

        def assign(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(handle.value.assign(matrix(b.column("v"))).astype(np.int32))], names=["id", "v", "leaf"])

        index = scratch.write(source.mapInArrow(assign, f"id long, v {kind}, leaf int"), "index")
        return handle, index, {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}

    handle, index, counts = indexed(rows, tree)
    if max(counts.values()) > LEAF_ROWS and (grown := deepen(tree, index, counts)) is not tree:
        tree, last = grown, index
        handle, index, counts = indexed(index.select("id", "v"), tree)
        scratch.drop(last)
    asked = usable(queries, id_col, vec_col).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    leaves = _calibrate(index, asked, tree, counts, k, recall)

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("id").to_numpy(), matrix(b.column("v"))
            lists = [handle.value.visits(q, counts, leaves, k + 1) for q in x]
            at = np.repeat(np.arange(len(ids)), [len(v) for v in lists])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), b.column("v").take(pa.array(at)), pa.array([y for v in lists for y in v], pa.int32())], names=["q", "qv", "leaf"])

    walks = max(1, -(-asked.count() // WALK))
    visits = scratch.write(asked.repartition(walks, "id").mapInArrow(visit, f"q long, qv {kind}, leaf int"), "visits")
    plan = [(r["leaf"], -(-counts[r["leaf"]] // BLOCK), -(-r["count"] // QUERY_BLOCK)) for r in visits.groupBy("leaf").count().collect()]
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = F.broadcast(spark.createDataFrame(plan, "leaf int, blocks int, query_blocks int"))  # a row per leaf
    cut = lambda c, n: F.pmod(F.xxhash64(F.lit(11), c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(blocks, "leaf").withColumn("qb", cut("q", "query_blocks")).withColumn("vb", every("blocks")).select("leaf", "qb", "vb", "q", "qv")
    right = index.join(blocks, "leaf").withColumn("vb", cut("id", "blocks")).withColumn("qb", every("query_blocks")).select("leaf", "qb", "vb", "id", "v")

    def find(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches([_result(*top(asked["q"].to_numpy(), matrix(asked["qv"]), rows["id"].to_numpy(), matrix(rows["v"]), k))])

    keys = ["leaf", "qb", "vb"]
    return _best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, _FOUND), k)


def brute_force(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The true k nearest rows of a bounded number of queries, row blocks against all queries."""
    handle = index.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches):
        ids, queries = handle.value
        for b in batches:
            if b.num_rows:
                yield _result(*top(ids, queries, b.column("id").to_numpy(), matrix(b.column("v")), k))

    return _best(index.select("id", "v").mapInArrow(run, _FOUND), k)


def _calibrate(index: DataFrame, asked: DataFrame, tree: Tree, counts: dict[int, int], k: int, recall: float) -> int:
    """Leaves to visit so that the calibrating queries' true neighbours are found to the wanted share."""
    some = asked.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return 1
    ids, x = some["id"].to_numpy(), matrix(some["v"])
    true = brute_force(index, ids, x, k).join(index.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()
    place = {q: {leaf: j for j, leaf in enumerate(tree.visits(v, counts, len(counts), 0))} for q, v in zip(ids.tolist(), x, strict=True)}
    ranks = sorted(place[r["query_id"]][r["leaf"]] for r in true)
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1
