"""Mixing sources to target weights with hash-threshold histograms.

Each row has a pseudo-random key, and a source takes its rows in key order
until its budget is spent. No rows are sorted: a histogram sums the words by
source and key bucket, the bucket in which the budget runs out is found, and
only that bucket is refined by the next key bits, until it holds one row.
What a row gets then follows from comparing its key with the threshold.

Budgets above a source's size nest: every row is taken floor(target / size)
times, and the threshold decides who is taken once more. The row at the
threshold is skipped if it doesn't fit; what is left of the budget then goes
to smaller rows behind it by a second threshold, and so on (ROUNDS at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from plexframe.session import Scratch, local_table

#: Words are runs of other characters than these.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BITS, KEY_BITS = 12, 60
ROUNDS = 4
#: Sources are collected to the driver and broadcast; more than this is an error.
MAX_SOURCES = 100_000


def shares(sizes: list[int], weights: tuple = WEIGHTS, most: float = MAX_REPEATS) -> list[float]:
    """Targets of the sources in their order: the total by weight, none above ``most`` times its size."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    target, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = rest / sum(weight[k] for k in open_)
        full = {k for k in open_ if unit * weight[k] > most * sizes[k]}
        for k in full or open_:
            target[k] = float(most * sizes[k]) if full else unit * weight[k]
            rest -= target[k]
        open_ -= full or open_
    return target


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Columns mix_source, mix_size, mix_h and mix_g beside those of ``docs``.

    The key is (h, g): h hashes id and text; g tells identical rows apart.
    """
    unsigned = lambda c: F.shiftrightunsigned(c, 64 - KEY_BITS)
    return docs.withColumns(
        {
            "mix_source": F.col(source_col).cast("string"),
            "mix_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long"),
            "mix_h": unsigned(F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col))),
            "mix_g": unsigned(F.xxhash64(F.lit(29), F.monotonically_increasing_id())),
        }
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS) -> DataFrame:
    """Appends size, source_size, target, taken and copies to every row.

    Sources count by code point, null last; ``weights`` repeat along them.
    Null text has size 0; very long texts are counted whole. A source of size
    0 gets nothing. Rows of the same id and text are told apart by their
    place in the input. Columns of these names in ``docs`` are replaced, all
    others returned as they are. An empty table stays empty.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "taken", "copies")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    at = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    own, own_cols = docs.toDF(*at.values()), (at[id_col], at[text_col], at[source_col])
    scratch = Scratch(spark)
    rows = scratch.write(keyed(own.select(*own_cols), *own_cols).select("mix_source", "mix_size", "mix_h", "mix_g"), "keys")
    sources = rows.groupBy("mix_source").agg(F.sum("mix_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(sources, key=lambda r: (r[0] is None, r[0]))
    target = shares([r[1] for r in sources], weights)
    copies = [min(MAX_REPEATS, int(t / r[1] + 1e-9)) if r[1] else 0 for t, r in zip(target, sources, strict=True)]
    budget = {k: t - c * r[1] for k, (t, c, r) in enumerate(zip(target, copies, sources, strict=True)) if r[1]}
    names = local_table(spark, [(k, r[0], int(r[1]), t, c) for k, (r, t, c) in enumerate(zip(sources, target, copies, strict=True))], "mix_k int, mix_name string, source_size long, target double, mix_copies int")
    named = lambda df: df.join(F.broadcast(names), F.col("mix_source").eqNullSafe(F.col("mix_name")))
    rules = thresholds(named(rows).select("mix_k", "mix_size", "mix_h", "mix_g"), {k: b for k, b in budget.items() if b >= 1}, scratch)
    scratch.drop(rows)
    once = F.exists("mix_rules", lambda r: _before(r["h"], r["g"]) & (F.col("mix_size") <= r["most"]))
    out = named(keyed(own, *own_cols)).join(F.broadcast(rules), "mix_k", "left")
    out = out.withColumn("copies", F.col("mix_copies") + F.coalesce(once, F.lit(False)).cast("int"))
    return out.select(*at.values(), F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("copies")).alias("taken"), "copies").toDF(*at, *added)


def _before(h, g):
    return (F.col("mix_h") < h) | ((F.col("mix_h") == h) & (F.col("mix_g") < g))


def thresholds(rows: DataFrame, budget: dict[int, float], scratch: Scratch) -> DataFrame:
    """Per source the rules (key bound, largest size): a row that fits any of them is taken.

    ``rows`` has mix_k, mix_size and the key. One rule is made a round; each
    round spends what the one before left on rows behind its bound. A round
    reads all rows once, for the first level; the rows of the boundary
    buckets, one in 2 ** BITS or so, are then written and refined alone.
    """
    spark = rows.sparkSession
    rules: dict[int, list[tuple[int, int, int]]] = {k: [] for k in budget}
    floor = {k: (-1, -1) for k in budget}  # rows behind this key are still open
    left = dict(budget)
    end = (1 << KEY_BITS, 0)
    for _ in range(ROUNDS):
        now = {k: b for k, b in left.items() if b >= 1 and floor[k] != end}
        if not now:
            break
        most = {k: int(min(b, 1 << 62)) if rules[k] else 1 << 62 for k, b in now.items()}
        path = {k: 0 for k in now}
        depth, found, here = 0, {}, rows
        while path:
            state = F.broadcast(local_table(spark, [(k, path[k], float(now[k]), most[k], *floor[k]) for k in path], "mix_k int, path long, budget double, most long, fh long, fg long"))
            open_ = here.join(state, "mix_k").where((F.col("mix_size") <= F.col("most")) & ((F.col("mix_h") > F.col("fh")) | ((F.col("mix_h") == F.col("fh")) & (F.col("mix_g") > F.col("fg")))))
            if depth:  # the path names the bucket of the level before
                open_ = open_.where(F.col("path") == path_id(depth))
            if depth == 1:
                here = scratch.write(open_.select("mix_k", "mix_size", "mix_h", "mix_g"), "boundary")
                open_ = here.join(state, "mix_k")
            crossed = {r["mix_k"]: r for r in histogram(open_, depth).collect()}
            for k in list(path):
                r = crossed.get(k)
                now[k] -= r["before"] if r else 0
                if r is None or r["path"] is None:
                    found[k] = end
                elif r["n"] == 1 or (depth + 1) * BITS >= 2 * KEY_BITS:
                    found[k] = (r["h"], r["g"])
                else:
                    path[k] = r["path"]
                    continue
                del path[k]
            depth += 1
        if depth > 1:
            scratch.drop(here)
        for k, bound in found.items():
            rules[k].append((*bound, most[k]))
            floor[k], left[k] = bound, now[k]
    return local_table(spark, [(k, [dict(zip(("h", "g", "most"), r, strict=True)) for r in x]) for k, x in rules.items()], "mix_k int, mix_rules array<struct<h: long, g: long, most: long>>")


def histogram(open_rows: DataFrame, depth: int) -> DataFrame:
    """Per source the bucket in which its budget runs out: before (words in front of it), path, n, and the key h, g if it is one.

    A path of null means that all fits, and ``before`` is all there is. A
    source has at most 2 ** BITS cells, whatever its rows; the least h and
    least g are taken each by itself, as they are used where a cell holds
    one key only.
    """
    per = KEY_BITS // BITS
    word, level = ("mix_h", depth) if depth < per else ("mix_g", depth - per)
    here = F.shiftright(word, KEY_BITS - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1).cast("int")
    w = Window.partitionBy("mix_k").orderBy("bucket")
    cells = open_rows.groupBy("mix_k", "budget", here.alias("bucket")).agg(F.sum("mix_size").alias("words"), F.count("*").alias("n"), F.min("mix_h").alias("h"), F.min("mix_g").alias("g"), F.min(path_id(depth + 1)).alias("path"))
    cells = cells.withColumn("upto", F.sum("words").over(w)).withColumn("last", F.lead("bucket").over(w).isNull())
    crossing = (F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget"))
    all_fits = F.col("last") & (F.col("upto") <= F.col("budget"))
    return cells.where(crossing | all_fits).select("mix_k", (F.col("upto") - F.when(all_fits, 0).otherwise(F.col("words"))).alias("before"), F.when(~all_fits, F.col("path")).alias("path"), "n", "h", "g")


def path_id(depth: int):
    """The key bits of the first ``depth`` levels, hashed to one value once they exceed a word."""
    per = KEY_BITS // BITS
    if depth <= per:
        return F.shiftright("mix_h", KEY_BITS - BITS * depth)
    return F.xxhash64("mix_h", F.shiftright("mix_g", KEY_BITS - BITS * (depth - per)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS) -> DataFrame:
    """The mixed rows: every row as often as ``plan`` takes it, with the columns of ``docs``."""
    at = {c: f"mixed_{k}" for k, c in enumerate(docs.columns)}
    planned = plan(docs.toDF(*at.values()), at[id_col], at[text_col], at[source_col], weights)
    repeated = planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*at.values()).toDF(*at)
