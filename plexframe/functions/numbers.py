"""Quality scores, likelihoods and copy-number formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_col = lambda c: F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, (int, float)) else c


def phred(rate, most: float = 93.0) -> Column:
    """-10 log10 of an error rate, ``most`` at most and for 0; outside [0, 1] an error."""
    r = _col(rate)
    return F.when((r < 0) | (r > 1), F.raise_error("error rate outside [0, 1]").cast("double")).when(r == 0, F.lit(most)).otherwise(F.least(F.lit(most), -10 * F.log10(r)))


def rounded_division(a, b) -> Column:
    """Half away from zero; a zero denominator is an error."""
    return F.when(_col(b) == 0, F.raise_error("division by zero").cast("long")).otherwise(F.round(_col(a) / _col(b)).cast("long"))


def phred_of_probability(p, most: float = 255.0) -> Column:
    """-10 log10(1 - p) between 0 and ``most``."""
    return F.when(_col(p) <= 0, 0.0).when(_col(p) >= 1, most).otherwise(F.least(F.lit(most), -10 * F.log10(1 - _col(p))))


def ratio(a, b) -> Column:
    return _col(a) / F.nullif(_col(b), F.lit(0))


def baf(ref, alt) -> Column:
    """alt / (ref + alt); NaN without depth."""
    n = _col(ref) + _col(alt)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(_col(alt) / n)


def heterozygosity_shift(b) -> Column:
    return 2 * F.abs(_col(b) - 0.5)


#: The logarithms of the first factorials: exact where Stirling's series would be off by a rounding.
LOG_FACTORIALS = [math.lgamma(k + 1) for k in range(171)]


def log_gamma(x) -> Column:
    """Of small whole numbers by table, else Stirling's series after a shift by eight, to about 1e-12."""
    z = _col(x).cast("double")
    whole = (z == F.floor(z)) & (z >= 1) & (z <= len(LOG_FACTORIALS))
    return F.when(whole, F.element_at(F.array(*map(F.lit, LOG_FACTORIALS)), F.when(whole, z).otherwise(1.0).cast("int"))).otherwise(_stirling(z))


def _stirling(z: Column) -> Column:
    shift = z
    product = F.lit(0.0)
    for _ in range(8):
        product = product + F.ln(shift)
        shift = shift + 1
    s = (shift - 0.5) * F.ln(shift) - shift + 0.5 * math.log(2 * math.pi)
    s = s + 1 / (12 * shift) - 1 / (360 * shift * shift * shift) + 1 / (1260 * F.pow(shift, 5))
    return s - product


def log_binomial_pmf(k, n, p) -> Column:
    """For real k and n."""
    k, n, p = _col(k), _col(n), _col(p)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.ln(p) + (n - k) * F.ln(1 - p)


def log_student_pdf(x, location, scale, df: float = 5.0) -> Column:
    """Location-scale t density; the constant is folded for the fixed degrees of freedom."""
    z = (_col(x) - _col(location)) / _col(scale)
    constant = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return F.lit(constant) - F.ln(_col(scale)) - (df + 1) / 2 * F.log1p(z * z / df)


def expected_log_ratio(tcn, purity, ploidy, normal: float = 2.0) -> Column:
    """log2 of the mixture's copies over the mixture's mean copies."""
    p = _col(purity)
    return F.log2((p * _col(tcn) + (1 - p) * normal) / (p * _col(ploidy) + (1 - p) * normal))


def copies_of_log_ratio(log_ratio, purity, ploidy, normal: float = 2.0) -> Column:
    """The copy number that a log ratio stands for under purity and ploidy, 0 at least."""
    p = _col(purity)
    return F.greatest((F.pow(F.lit(2.0), _col(log_ratio)) * (p * _col(ploidy) + (1 - p) * normal) - (1 - p) * normal) / p, F.lit(0.0))


def expected_baf(tcn, minor, purity) -> Column:
    """Allele fraction of the minor allele in the mixture with a diploid normal."""
    p = _col(purity)
    return (p * _col(minor) + (1 - p)) / (p * _col(tcn) + 2 * (1 - p))


def cnv_status(tcn, minor, base=2, somatic: bool = True) -> Column:
    """germline: ref, gain, loss against the baseline; somatic adds cnLOH and gainLOH."""
    t, m, b = _col(tcn), _col(minor), _col(base)
    if somatic:
        return F.when((m == 0) & (t == b) & (b > 1), "cnLOH").when((m == 0) & (t > b), "gainLOH").when(t > b, "gain").when(t < b, "loss").otherwise("ref")
    return F.when(t > b, "gain").when(t < b, "loss").otherwise("ref")


def metric_suffix(n) -> Column:
    """1234567 -> 1.2M."""
    n = _col(n)
    form = lambda d, s: F.format_string(f"%.1f{s}", F.round(n / d, 1))
    return F.when(n >= 1e9, form(1e9, "G")).when(n >= 1e6, form(1e6, "M")).when(n >= 1e3, form(1e3, "k")).otherwise(n.cast("string"))


def genotype_quality(p) -> Column:
    """The Phred score of a probability, rounded."""
    return F.round(phred_of_probability(p)).cast("int")


def variant_quality(probabilities: list[str]) -> Column:
    """The Phred score, to two places, of any class but the first (the reference); negative probabilities don't count."""
    total = sum((F.greatest(F.col(p), F.lit(0.0)) for p in probabilities[1:]), F.lit(0.0))
    return F.round(phred_of_probability(total), 2)


def window_bounds(pos, length, half: int = 100) -> Column:
    """(start, stop) of the bases within ``half`` of a position, clipped to the sequence."""
    p, n = _col(pos), _col(length)
    return F.struct(F.greatest(p - half, F.lit(0)).alias("start"), F.least(p + half + 1, n).alias("stop"))


#: The digits of compact identifiers, in order.
DIGITS_64 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+_"


def base64_of(n) -> Column:
    """An unsigned 32-bit number as six digits to base 64, the most significant first."""
    v = _col(n).cast("long")
    digit = lambda k: F.substring(F.lit(DIGITS_64), F.shiftright(v, 6 * k).bitwiseAND(63).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(k) for k in range(5, -1, -1)])
