"""Adapters of reads: scored flanks, free barcode scans, assignment rules with UMIs, hairpins, trimming and their metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: The scores of a match, a substitution, an insertion and a deletion.
MATCH, SUBSTITUTION, INSERTION, DELETION = 2, -4, -3, -5
#: What an edit distance of 0, 1, 2 costs a pair of barcodes, and the dearest pair that is accepted.
EDIT_PENALTY, MOST_PAIR_ERROR = (0, 2, 4), 7


def classify(flank: str, reference: str, drop: int, insertions: int = 2) -> dict:
    """Scores a flank base by base against a reference from its start on.

    The state holds, for every place of the reference, how far its best path
    lies below the leading one; paths more than ``drop`` below are pruned.
    Returned: best (position, score), last (position and score of the last
    base that raised the score, or None), remaining (bases of the reference
    behind that), end (found: the reference's end leads, pruned: no path is
    left, dropped: the score fell too far, input: the flank ended).
    """
    n = len(reference)
    away = [0 if i == 0 else None for i in range(n + 1)]
    for i in range(n):  # the reference may begin with deleted bases
        if away[i] is not None and away[i] + DELETION >= -drop:
            away[i + 1] = away[i] + DELETION
    score = top = place = 0
    best, last, remaining, end = (0, 0), None, n, "input"
    for pos, base in enumerate(flank, 1):
        new: list[int | None] = [None] * (n + 1)

        def reach(i: int, value: int, new=new) -> None:
            if new[i] is None or value > new[i]:
                new[i] = value

        for i, a in enumerate(away):
            if a is None:
                continue
            if pos - i <= insertions + n:
                reach(i, a + INSERTION)
            if i < n:
                reach(i + 1, a + (MATCH if reference[i] == base else SUBSTITUTION))
        for i in range(n):
            if new[i] is not None:
                reach(i + 1, new[i] + DELETION)
        peak = max((v for v in new if v is not None), default=None)
        if peak is None:
            end = "pruned"
            break
        away = [None if v is None or v - peak < -drop else v - peak for v in new]
        score += peak
        place = max(i for i, v in enumerate(away) if v == 0)
        if score > top:
            top, best = score, (pos, score)
        if peak > 0:
            last, remaining = (pos, score), n - place
        if away[n] == 0:
            end = "found"
            break
        if top - score > drop:
            end = "dropped"
            break
    return {"best": best, "last": last, "remaining": remaining, "end": end}


def scan(seq: str, barcodes: dict[str, tuple[int, int]], lengths: tuple[int, int], five: bool = True) -> tuple[int, int, int, int] | None:
    """(start, stop, barcode, edits) of the first barcode from the 5' end on, or the last one's from the 3' end.

    ``barcodes`` has every edited form with (barcode, edits). At each start
    all lengths are looked up and the fewest edits win, the longer form on
    ties; from the 3' end the search goes by stops, and a longer form of the
    same stop wins as well.
    """
    low, high = lengths
    places = range(len(seq) - low + 1) if five else range(len(seq), low - 1, -1)
    for p in places:
        found = []
        for n in range(low, high + 1):
            a, b = (p, p + n) if five else (p - n, p)
            if a >= 0 and b <= len(seq) and seq[a:b] in barcodes:
                barcode, edits = barcodes[seq[a:b]]
                found.append((edits, -n, a, b, barcode))
        if found:
            edits, _, a, b, barcode = min(found)
            return a, b, barcode, edits
    return None


def with_umis(sid5: Column, edits5: Column, umi5: Column, sid3: Column, edits3: Column, umi3: Column, partial: bool) -> dict[str, Column]:
    """barcode, umi5, umi3 and trim5, trim3 (whether a side is trimmed) of reads with barcodes and UMIs at both ends.

    A barcode counts only with a UMI (either side in partial mode, both
    otherwise); of two the one of fewer edits counts, the 5' one on ties.
    Where they differ the losing side is neither trimmed nor keeps its UMI.
    """
    both = sid5.isNotNull() & sid3.isNotNull()
    three = both & (edits3 < edits5)
    has_umi = umi5.isNotNull() | umi3.isNotNull() if partial else umi5.isNotNull() & umi3.isNotNull()
    apart = both & (sid5 != sid3)
    barcode = F.when(has_umi, F.when(sid5.isNotNull() & ~three, sid5).otherwise(F.coalesce(sid3, sid5)))
    lost5, lost3 = F.coalesce(apart & three, F.lit(False)), F.coalesce(apart & ~three, F.lit(False))
    return {"barcode": barcode, "umi5": F.when(~lost5, umi5), "umi3": F.when(~lost3, umi3), "trim5": sid5.isNotNull() & ~lost5, "trim3": sid3.isNotNull() & ~lost3}


def space_penalty(length: Column, candidates: int, bases: int) -> Column:
    """What chance adds to a score's threshold: the rounded up log2 of the hits that a read of this length would have by chance."""
    expected = length * candidates / float(4**bases)
    return F.greatest(F.ceil(F.log2(expected)), F.lit(0))


def best_assignment(hits: DataFrame, read: list[str], threshold: Column, partial: bool) -> DataFrame:
    """read, barcode, side (pair, five, three), score of the scored hits (side 5 or 3, barcode, score, pos, length, least) of each read.

    The best pair of one barcode whose 5' end lies before its 3' start wins if
    its sum reaches the threshold and both single scores; else, in partial
    mode, the best single side that reaches it, the 5' one on ties. A 3' hit
    counts alone only if its barcode wasn't found at 5'.
    """
    best = hits.groupBy(*read, "side", "barcode").agg(F.max(F.struct("score", "pos")).alias("b"), F.first("length").alias("length")).select(*read, "side", "barcode", "b.*", "length")
    five, three = (best.where(F.col("side") == s).select(*read, "barcode", F.col("score").alias(f"s{s}"), F.col("pos").alias(f"p{s}"), F.col("length").alias(f"l{s}")) for s in (5, 3))
    j = five.join(three, [*read, "barcode"], "full").withColumn("length", F.coalesce("l5", "l3"))
    limit = threshold
    pair = F.when((F.col("p5") < F.col("p3")) & (F.col("s5") + F.col("s3") >= limit), F.struct((F.col("s5") + F.col("s3")).alias("score"), (-F.col("barcode")).alias("b")))
    alone5 = F.when(F.col("s5").isNotNull() & (F.col("s5") >= limit), F.struct(F.col("s5").alias("score"), (-F.col("barcode")).alias("b")))
    alone3 = F.when(F.col("s5").isNull() & (F.col("s3") >= limit), F.struct(F.col("s3").alias("score"), (-F.col("barcode")).alias("b")))
    g = j.groupBy(*read).agg(F.max(pair).alias("pair"), F.max(alone5).alias("five"), F.max(alone3).alias("three"), F.max("s5").alias("top5"), F.max("s3").alias("top3"))
    wins = F.col("pair").isNotNull() & (F.col("pair.score") >= F.coalesce("top5", F.lit(-(1 << 30)))) & (F.col("pair.score") >= F.coalesce("top3", F.lit(-(1 << 30))))
    single5 = F.col("five").isNotNull() & (F.coalesce(F.col("five.score") >= F.col("three.score"), F.lit(True)))
    rest = F.when(F.lit(partial), F.when(single5, F.struct(F.lit("five").alias("side"), F.col("five.score").alias("score"), (-F.col("five.b")).alias("barcode"))).when(F.col("three").isNotNull(), F.struct(F.lit("three").alias("side"), F.col("three.score").alias("score"), (-F.col("three.b")).alias("barcode"))))
    out = F.when(wins, F.struct(F.lit("pair").alias("side"), F.col("pair.score").alias("score"), (-F.col("pair.b")).alias("barcode"))).otherwise(rest)
    return g.withColumn("o", out).where("o IS NOT NULL").select(*read, "o.barcode", "o.side", "o.score")


def pair_error(edits5: Column, off5: Column, edits3: Column, off3: Column) -> Column:
    """What a pair of barcodes around a hairpin's loop costs: by edits, the 5' one's distance if it has any, twice the 3' one's, more before the loop's end."""
    cost = lambda e: F.element_at(F.array(*map(F.lit, EDIT_PENALTY)), e.cast("int") + 1)
    left = cost(edits5) + F.when(edits5 > 0, F.abs(off5)).otherwise(0)
    return left + 2 * F.when(off3 < 0, 1 - off3).otherwise(off3) + cost(edits3)


def best_pairs(five: DataFrame, three: DataFrame, read: list[str]) -> DataFrame:
    """read, barcode, error of the cheapest pair of one barcode (edits, off) that is accepted; smaller barcodes win ties."""
    j = five.select(*read, "barcode", F.col("edits").alias("e5"), F.col("off").alias("o5")).join(three.select(*read, "barcode", F.col("edits").alias("e3"), F.col("off").alias("o3")), [*read, "barcode"])
    cost = pair_error(F.col("e5"), F.col("o5"), F.col("e3"), F.col("o3")).alias("error")
    best = j.groupBy(*read).agg(F.min(F.struct(cost, "barcode")).alias("b"))
    return best.where(F.col("b.error") <= MOST_PAIR_ERROR).select(*read, F.col("b.barcode").alias("barcode"), F.col("b.error").cast("long").alias("error"))


def reverse_complement(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def symmetry_centre(seq: str, least: int) -> int | None:
    """Where a read is folded: the place between two bases around which most bases, no further than ends allow, are complements; the first of equal ones.

    At least ``least`` pairs must fit, with at most one misfit to four pairs.
    """
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    best, at = least - 1, None
    for c in range(1, len(seq)):
        reach = min(c, len(seq) - c)
        if reach <= best:
            continue
        good = sum(pair.get(seq[c - 1 - k]) == seq[c + k] for k in range(reach))
        if good > best and 5 * good >= 4 * reach:
            best, at = good, c
    return at


def find_hairpin(seq: str, loop: str, most: int = 2, least: int = 12) -> tuple[str, int, int] | None:
    """(method, start, stop) of the loop between a read's two strands.

    The loop's text is looked for first; then, around the read's centre of
    symmetry, approximately; then everywhere approximately, where what
    follows is the reverse complement of what comes before for ``least``
    bases or more.
    """
    from plexframe.operators.demux import bitap

    at = seq.find(loop)
    if at >= 0:
        return "exact", at, at + len(loop)
    centre = symmetry_centre(seq, least)
    if centre is not None:
        low = max(0, centre - 2 * len(loop))
        hit = bitap(seq[low : centre + 2 * len(loop)], loop, most)
        if hit:
            stop = low + hit[0]
            return "global", max(0, stop - len(loop)), stop
    for stop in range(len(loop), len(seq) - least + 1):
        start = stop - len(loop)
        before, after = seq[max(0, start - least) : start], seq[stop : stop + least]
        if len(before) == len(after) == least and sum(a == b for a, b in zip(reverse_complement(before), after)) >= least - 1:
            hit = bitap(seq[start:stop], loop, most + 2)
            if hit:
                return "local", start, stop
    return None


def trim_umi(seq: str, umis: dict[str, tuple[int, int]], length: int, expected: int, off: int) -> tuple[int, int, int] | None:
    """(umi, start, edits) of the UMI nearest its expected start, at most ``off`` bases away: fewest edits first, then nearest, then leftmost."""
    found = []
    for a in range(max(0, expected - off), expected + off + 1):
        hit = umis.get(seq[a : a + length]) if a + length <= len(seq) else None
        if hit:
            found.append((hit[1], abs(a - expected), a, hit[0]))
    if not found:
        return None
    edits, _, a, umi = min(found)
    return umi, a, edits


def left_align(a: str, b: str) -> tuple[str, str]:
    """Two gapped sequences with every gap moved as far left as the bases allow."""
    x, y = list(a), list(b)
    moved = True
    while moved:
        moved = False
        for s, o in ((x, y), (y, x)):
            k = 1
            while k < len(s):
                if s[k] == "-" and s[k - 1] != "-":
                    end = k
                    while end + 1 < len(s) and s[end + 1] == "-":
                        end += 1
                    # The gap's run moves over the base before it if that still meets the same base at the run's end.
                    if s[k - 1] == o[end] and o[k - 1] != "-":
                        s[end], s[k - 1] = s[k - 1], "-"
                        moved = True
                k += 1
    return "".join(x), "".join(y)


def methyl_converted(base: Column, other: Column) -> Column:
    """The base where one strand reads T for the other's C, or A for its G, as conversion leaves it: the unconverted one; else its own."""
    return F.when((base == "T") & (other == "C"), "C").when((base == "A") & (other == "G"), "G").otherwise(base)


def duplex_metrics(reads: DataFrame, sample: str | None = None) -> DataFrame:
    """metric, value (and the sample's column) of demultiplexed duplex reads: counts, bases and percentages of their totals.

    ``reads`` has length, hairpin (exact, global, local or null), assigned,
    failed, trimmed and concordant, discordant bases.
    """
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("double")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    passing = F.col("assigned") & ~F.col("failed")
    counts = {"reads": F.count("*").cast("double"), "bases": total("length"), "assigned": n(F.col("assigned")), "failed": n(F.col("failed")), "passing": n(passing), "no_hairpin": n(F.col("hairpin").isNull())}
    counts |= {f"hairpin_{m}": n(F.col("hairpin") == m) for m in ("exact", "global", "local")}
    counts |= {"passing_bases": total(F.when(passing, F.col("trimmed"))), "concordant": total(F.when(passing, F.col("concordant"))), "discordant": total(F.when(passing, F.col("discordant")))}
    row = (reads.groupBy(sample) if sample else reads).agg(*[c.alias(k) for k, c in counts.items()])
    share = lambda a, b: F.round(100 * F.col(a) / F.nullif(F.col(b), F.lit(0.0)), 6)
    shares = {f"percent_{a}": share(a, b) for a, b in (("assigned", "reads"), ("failed", "reads"), ("passing", "reads"), ("no_hairpin", "reads"), ("hairpin_exact", "reads"), ("hairpin_global", "reads"), ("hairpin_local", "reads"), ("passing_bases", "bases"))}
    shares["percent_discordant"] = F.round(100 * F.col("discordant") / F.nullif(F.col("concordant") + F.col("discordant"), F.lit(0.0)), 6)
    cells = [F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in counts] + [F.struct(F.lit(k).alias("metric"), c.alias("value")) for k, c in shares.items()]
    keys = [sample] if sample else []
    return row.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")


def header(name: Column, sid: Column, found: list[Column], umi5: Column, umi3: Column) -> Column:
    """A written read's name: name, barcode, a number of bits of the parts found (lowest first) and the UMIs, * for none."""
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(found)), F.lit(0)).cast("string")
    return F.concat(name, F.lit(" "), F.concat_ws("|", F.coalesce(sid.cast("string"), F.lit("*")), bits, F.coalesce(umi5, F.lit("*")), F.coalesce(umi3, F.lit("*"))))


def sid_score(edits: Column, length: int) -> Column:
    """A barcode's log-likelihood score: matches of its bases, substitutions for its edits."""
    return MATCH * (F.lit(length) - edits) + SUBSTITUTION * edits


def repeat_genotype(spanning: dict[int, int], flanking: dict[int, int], inside: int, most: int = 60, slip: float = 0.05, depth: float = 30.0) -> tuple[int, int]:
    """The two repeat counts of greatest likelihood from reads that span the repeat (count -> reads), end in it (at least count -> reads) or lie inside it.

    A spanning read shows its allele's count, or one off by slippage; a
    flanking one shows any count up to its allele's; reads inside come from
    alleles as long as what all reads hold.
    """
    options = sorted({*spanning, *flanking, *[k + 1 for k in flanking], *([most] if inside else [])})

    def of(allele: int) -> list[float]:
        span = [math.log(1 - slip if c == allele else slip / 2 if abs(c - allele) == 1 else 1e-9) for c in spanning]
        flank = [math.log(1 / (allele + 1) if c <= allele else 1e-9) for c in flanking]
        return span + flank

    weights = [*spanning.values(), *flanking.values()]
    best, pair = -math.inf, (0, 0)
    longest = max(options, default=0)
    for i, a in enumerate(options):
        for b in options[i:]:
            both = sum(w * math.log((math.exp(x) + math.exp(y)) / 2) for w, x, y in zip(weights, of(a), of(b), strict=True))
            reach = 1.0 if b >= longest and inside else 1e-3 if inside else 1.0
            score = both + inside * math.log(reach) - (0.5 if a != b else 0.0)
            if score > best + 1e-12:
                best, pair = score, (a, b)
    return pair
