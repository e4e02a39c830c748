"""Exact quantiles of groups of any size: histograms of fixed size narrow the range in which a rank lies.

``percentile`` holds a group's distinct values in one task. Here every pass
counts each group's values in CELLS cells of its range, in which the wanted
rank's cell becomes the next range, until it holds one value;
only counts reach the driver, CELLS per group and rank at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

CELLS, MAX_GROUPS = 512, 1000


def quantiles(rows: DataFrame, keys: list[str], value: str | Column, shares: list[float]) -> DataFrame:
    """keys, q0, q1, ...: the quantiles of each group, interpolated between neighbours as ``percentile`` does; nulls and NaN don't count.

    More than MAX_GROUPS groups are an error: ``percentile`` serves groups
    that are many and small.
    """
    spark = rows.sparkSession
    names = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {rows.select(k).schema[0].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    base = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = base.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0").limit(MAX_GROUPS + 1).collect()
    if len(ends) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    found: dict[tuple, float] = {}
    todo: dict[tuple, tuple[int, float, float]] = {}  # (group, rank) -> rank within the range, range
    for r in ends:
        group = tuple(r[n] for n in names)
        for s in shares:
            h = (r["n"] - 1) * s
            for k in {math.floor(h), math.ceil(h)}:
                todo[group, k] = (k, r["lo"], r["hi"])
    head = (kinds + ", " if kinds else "") + "rank long, lo double, hi double"
    while todo:
        state = F.broadcast(spark.createDataFrame([(*g, k, lo, hi) for (g, k), (_, lo, hi) in todo.items()], head).withColumnsRenamed({n: "s" + n for n in names}))
        on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        for n in names:
            on &= F.col(n).eqNullSafe(F.col("s" + n))
        inside = base.join(state, on)
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        cells = inside.groupBy(*names, "rank", F.when(F.col("hi") > F.col("lo"), cell).otherwise(0).alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        seen: dict[tuple, list] = {}
        for r in cells.collect():
            seen.setdefault((tuple(r[n] for n in names), r["rank"]), []).append((r["cell"], r["n"], r["lo"], r["hi"]))
        for key, (k, _, _) in list(todo.items()):
            for _, n, lo, hi in sorted(seen[key]):
                if k < n:
                    break
                k -= n
            if lo == hi:
                found[key] = lo
                del todo[key]
            else:
                todo[key] = (k, lo, hi)
    out = []
    for r in ends:
        group, line = tuple(r[n] for n in names), []
        for s in shares:
            h = (r["n"] - 1) * s
            a, b = found[group, math.floor(h)], found[group, math.ceil(h)]
            line.append(a + (b - a) * (h - math.floor(h)))
        out.append((*group, *line))
    schema = ", ".join([*(f"`{k}` {c.split(' ', 1)[1]}" for k, c in zip(keys, kinds.split(", ") if kinds else [], strict=True)), *(f"q{i} double" for i in range(len(shares)))])
    return spark.createDataFrame(out, schema)


def quantile(rows: DataFrame, value: str | Column, share: float) -> float | None:
    """One quantile of all rows; null without any."""
    got = quantiles(rows, [], value, [share]).first()
    return got["q0"] if got else None
