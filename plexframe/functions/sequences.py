"""Sequence, CIGAR, read-name and duplex-tag functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_col = lambda c: F.col(c) if isinstance(c, str) else c


def reverse_complement(seq) -> Column:
    """Upper case; * stays, any other character than ACGT becomes N."""
    up = F.regexp_replace(F.upper(_col(seq)), "[^ACGT*]", "N")
    return F.reverse(F.translate(up, "ACGT", "TGCA"))


def is_acgt(seq) -> Column:
    """Every character is an upper-case base (an empty text is not)."""
    return _col(seq).rlike("^[ACGT]+$")


def gc_fraction(seq) -> Column:
    """G and C among the ACGT bases; 0 without any."""
    s = _col(seq)
    acgt = F.length(F.regexp_replace(s, "[^ACGT]", ""))
    return F.when(acgt > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / acgt).otherwise(0.0)


def distinct_kmers(seq, k: int) -> Column:
    """The number of distinct substrings of length k; 0 for shorter texts."""
    s = _col(seq)
    return F.when(F.length(s) >= k, F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))))).otherwise(0)


def homopolymer_at_start(seq) -> Column:
    """Length of the run of the first base; a run of one, or of another character, counts 0."""
    n = F.length(F.regexp_extract(_col(seq), r"^(A{2,}|C{2,}|G{2,}|T{2,})", 1))
    return F.coalesce(n, F.lit(0))


def repeats_at_start(seq, k: int) -> Column:
    """Copies of the leading k bases; a single copy counts 0."""
    n = F.length(F.regexp_extract(_col(seq), rf"^([ACGT]{{{k}}})(\1+)", 2))
    return F.when(n > 0, n / k + 1).otherwise(0).cast("int")


def repeat_unit(seq) -> Column:
    """(unit length, copies) of the leading repeat of 2-4 bases that covers most; shorter units win ties."""
    s = _col(seq)
    options = F.array(*[F.struct((repeats_at_start(s, k) * k).alias("covered"), F.lit(-k).alias("order"), F.lit(k).alias("unit"), repeats_at_start(s, k).alias("copies")) for k in (2, 3, 4)])
    best = F.array_max(options)
    return F.when(best["covered"] > 0, F.struct(best["unit"].alias("unit"), best["copies"].alias("copies"))).otherwise(F.struct(F.lit(0).alias("unit"), F.lit(0).alias("copies")))


def two_bit(seq) -> Column:
    """The bases as digits of base four (A C G T = 0 1 2 3), as a double; null with other characters."""
    digits = F.split(F.translate(_col(seq), "ACGT", "0123"), "")
    return F.when(is_acgt(seq), F.aggregate(digits, F.lit(0.0), lambda a, x: a * 4 + x.cast("double")))


def trim_common_suffix(ref, alt) -> tuple[Column, Column]:
    """Both alleles without their common suffix, if both are longer than one base; neither becomes empty."""
    a, b = _col(ref), _col(alt)
    limit = F.least(F.length(a), F.length(b)) - 1
    same = F.when(limit > 0, F.size(F.filter(F.sequence(F.lit(1), limit), lambda i: F.substring(a, F.length(a) - i + 1, i) == F.substring(b, F.length(b) - i + 1, i)))).otherwise(0)
    cut = lambda s: F.substring(s, F.lit(1), F.length(s) - same)
    return cut(a), cut(b)


def variant_type(ref, alt) -> Column:
    """snv, deletion, insertion or unknown, by the lengths."""
    a, b = F.length(_col(ref)), F.length(_col(alt))
    return F.when((a == 1) & (b == 1), "snv").when((a > b) & (b == 1), "deletion").when((a < b) & (a == 1), "insertion").otherwise("unknown")


def substitution_index(ref, alt) -> Column:
    """1-9 and 11-13 for the twelve base changes in order, 10 for indels, null otherwise."""
    a, b = _col(ref), _col(alt)
    out = F.when(F.length(a) != F.length(b), F.lit(10))
    changes = [(x, y) for x in "ACGT" for y in "ACGT" if x != y]
    for k, (x, y) in enumerate(changes):
        out = out.when((a == x) & (b == y), F.lit(k + 1 + (k >= 9)))
    return out


def common_ref(ref_a, alt_a, ref_b, alt_b) -> Column:
    """(ref, alt_a, alt_b) of two variants of one position over one reference; null if they can't be written so.

    A wildcard allele * takes the other's reference. Equal references are
    kept (two SNVs and an SNV with an insertion must have them). An SNV with
    a deletion, or two variants that begin with the same anchor base, are
    trimmed and written over the longer reference.
    """
    ra, aa, rb, ab = (_col(c) for c in (ref_a, alt_a, ref_b, alt_b))
    three = lambda r, x, y: F.struct(r.alias("ref"), x.alias("alt_a"), y.alias("alt_b"))
    kind_a, kind_b = variant_type(ra, aa), variant_type(rb, ab)
    plain = (kind_a == "snv") & kind_b.isin("snv", "insertion") | (kind_a == "insertion") & (kind_b == "snv")
    first = lambda c: F.substring(c, 1, 1)
    anchored = (first(ra) == first(aa)) & (first(rb) == first(ab)) & (first(ra) == first(rb))
    mixed = (kind_a == "snv") & (kind_b == "deletion") | (kind_a == "deletion") & (kind_b == "snv") | anchored
    ta, xa = trim_common_suffix(ra, aa)
    tb, xb = trim_common_suffix(rb, ab)
    rest = lambda long, short: F.substring(long, F.length(short) + 1, F.length(long))
    longer = F.when(F.length(ta) > F.length(tb), three(ta, xa, F.concat(xb, rest(ta, tb)))).otherwise(three(tb, F.concat(xa, rest(tb, ta)), xb))
    empty = (F.length(ra) == 0) | (F.length(aa) == 0) | (F.length(rb) == 0) | (F.length(ab) == 0)
    out = F.when(empty, F.lit(None)).when(aa == "*", three(rb, F.lit("*"), ab)).when(ab == "*", three(ra, aa, F.lit("*")))
    return out.when(plain, F.when(ra == rb, three(ra, aa, ab))).when(mixed, F.when(ra == rb, three(ra, aa, ab)).otherwise(longer))


def variant_key(contig, pos, ref, alt, width: int = 0) -> Column:
    p = _col(pos).cast("string")
    return F.concat_ws("_", _col(contig).cast("string"), F.lpad(p, width, "0") if width else p, _col(ref), _col(alt))


def genotype_number(gt) -> Column:
    """0/0 0, 0/1 1, 1/1 2, 1/2 3; phase and allele order don't count, others are null."""
    alleles = F.array_join(F.array_sort(F.split(_col(gt), "[/|]")), "/")
    return F.when(alleles == "0/0", 0).when(alleles == "0/1", 1).when(alleles == "1/1", 2).when(alleles == "1/2", 3)


# CIGAR: text such as 5S90M2I3M.


def cigar_ops(cigar) -> Column:
    """array of (len, op)."""
    parts = F.regexp_extract_all(_col(cigar), F.lit("([0-9]+)([MIDNSHP=X])"), 0)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def _consumed(cigar, ops: str) -> Column:
    chosen = F.filter(cigar_ops(cigar), lambda o: F.lit(ops).contains(o["op"]))
    return F.aggregate(chosen, F.lit(0), lambda a, o: a + o["len"])


def reference_length(cigar) -> Column:
    return _consumed(cigar, "MDN=X")


def query_length(cigar, clips: bool = True) -> Column:
    """Bases of the read; without soft clips if asked."""
    return _consumed(cigar, "MIS=X" if clips else "MI=X")


# Read names.


def umi_flags(name) -> Column:
    """Of the name form with one pipe: (3' UMI, 5' UMI, 3' SID, 5' SID) from the four-bit flag behind it; null for others."""
    flag = F.regexp_extract(_col(name), r"^[^|]*\|([0-9]+)", 1)
    bits = F.when(F.regexp_count(_col(name), F.lit(r"\|")) == 1, F.nullif(flag, F.lit("")).cast("int"))
    return F.when(bits.between(0, 15), F.struct(*[(bits.bitwiseAND(1 << k) > 0).alias(x) for k, x in enumerate(("umi3", "umi5", "sid3", "sid5"))]))


def family_counts(name) -> Column:
    """Plus and minus counts and the family size of a consensus name of six parts joined by dashes; null for others."""
    p = F.split(_col(name), "-")
    return F.when(F.size(p) == 6, F.struct(F.try_element_at(p, F.lit(4)).cast("int").alias("plus"), F.try_element_at(p, F.lit(5)).cast("int").alias("minus"), F.try_element_at(p, F.lit(6)).cast("int").alias("size")))


def cluster_kind(full_fwd, full_rev, part_fwd, part_rev) -> tuple[Column, Column]:
    """(full | partial | mixed, forward | reverse | mixed) of the four counts."""
    full, part = _col(full_fwd) + _col(full_rev), _col(part_fwd) + _col(part_rev)
    fwd, rev = _col(full_fwd) + _col(part_fwd), _col(full_rev) + _col(part_rev)
    kind = F.when(part == 0, "full").when(full == 0, "partial").otherwise("mixed")
    return kind, F.when(rev == 0, "forward").when(fwd == 0, "reverse").otherwise("mixed")


# Duplex tag: left overhang, + or -, concordant run lengths and discordance codes, + or -, right overhang.


def yc_parts(yc) -> Column:
    """(left, body, right) of a duplex tag; null unless it has exactly two delimiters."""
    return F.when(F.regexp_count(_col(yc), F.lit("[+-]")) == 2, F.struct(*[F.regexp_extract(_col(yc), r"^([^+-]*)[+-]([^+-]*)[+-]([^+-]*)$", k).alias(x) for k, x in ((1, "left"), (2, "body"), (3, "right"))]))


def yc_counts(yc) -> Column:
    """simplex (overhang) bases, concordant and discordant duplex bases of a tag of decimal overhangs, runs and one-letter codes."""
    p = yc_parts(yc)
    number = lambda s: F.coalesce(F.nullif(s, F.lit("")).cast("int"), F.lit(0))
    runs = F.aggregate(F.regexp_extract_all(p["body"], F.lit("[0-9]+"), 0), F.lit(0), lambda a, x: a + x.cast("int"))
    codes = F.length(F.regexp_replace(p["body"], "[0-9]", ""))
    return F.when(p.isNotNull(), F.struct((number(p["left"]) + number(p["right"])).alias("simplex"), runs.alias("concordant"), codes.alias("discordant")))


def duplex_error_rate(yc) -> Column:
    """discordant / (concordant + discordant); null without duplex bases."""
    c = yc_counts(yc)
    n = c["concordant"] + c["discordant"]
    return F.when(n > 0, c["discordant"] / n)


# Contexts and homopolymers of a reference sequence; positions count from 0.


def context(seq, pos) -> Column:
    """The bases before and after a position; empty at the ends and beside other characters than ACGT."""
    s, p = _col(seq), _col(pos)
    two = F.concat(F.substring(s, p, F.lit(1)), F.substring(s, p + 2, F.lit(1)))
    return F.when((p > 0) & (p + 1 < F.length(s)) & two.rlike("^[ACGT]{2}$"), two).otherwise("")


def context_index(two) -> Column:
    """1-16 for the pairs of bases in order, 17 for an empty context, null for others."""
    t = _col(two)
    out = F.when(t == "", F.lit(17))
    for k, (a, b) in enumerate((a, b) for a in "ACGT" for b in "ACGT"):
        out = out.when(t == a + b, F.lit(k + 1))
    return out


def homopolymer_over(seq, pos, least: int) -> Column:
    """The start of the run of equal bases over a position if it is at least ``least`` long, else null."""
    s, p = _col(seq), _col(pos)
    base = F.substring(s, p + 1, F.lit(1))
    before = F.length(F.regexp_extract(F.reverse(F.substring(s, F.lit(1), p + 1)), r"^(.)\1*", 0))
    after = F.length(F.regexp_extract(F.substring(s, p + 1, F.length(s)), r"^(.)\1*", 0))
    run = before + after - 1
    return F.when((p >= 0) & (p < F.length(s)) & (base != "") & (run >= least) & F.lit(least >= 2), p + 1 - before)


def numeric(value, kind: str) -> Column:
    """A feature as a double by its kind: number, boolean, genotype, context, sequence or text length."""
    v = _col(value)
    return {"number": lambda: v.cast("double"), "boolean": lambda: v.cast("int").cast("double"), "genotype": lambda: genotype_number(v).cast("double"), "context": lambda: context_index(v).cast("double"), "sequence": lambda: two_bit(v), "length": lambda: F.length(v).cast("double")}[kind]()


def unpacked_bases(packed, n) -> Column:
    """``n`` bases from bytes that hold four each, the first in the highest bits (A C G T = 0 1 2 3)."""
    return _unpacked(packed, n, "ACGT")


def unpacked_qualities(packed, n) -> Column:
    """``n`` binned qualities from bytes that hold four each: the characters + 5 ? I."""
    return _unpacked(packed, n, "+5?I")


def _unpacked(packed, n, letters: str) -> Column:
    h = F.hex(_col(packed))  # two bases to a digit
    pairs = [a + b for a in letters for b in letters]
    digits = F.transform(F.split(h, ""), lambda d: F.element_at(F.array(*map(F.lit, pairs)), F.conv(d, 16, 10).cast("int") + 1))
    return F.substring(F.array_join(digits, ""), F.lit(1), _col(n).cast("int"))


def unsupported_names(names: list[str], supported: set[str], prefixes: tuple[str, ...] = ()) -> list[str]:
    """The requested names that aren't supported, with or without one of the prefixes, in their order."""
    plain = lambda x: next((x[len(p) :] for p in prefixes if x.startswith(p)), x)
    return [x for x in names if x not in supported and plain(x) not in supported]
