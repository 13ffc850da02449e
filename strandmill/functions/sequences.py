"""Sequence functions as column expressions: complements, windows, k-mers, composition."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC complements.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTUNRYSWKMBDHV", "TGCAANYRSWMKVHDB"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), COMPLEMENT_FROM + COMPLEMENT_FROM.lower(), COMPLEMENT_TO + COMPLEMENT_TO.lower())


def step_of(window: int, overlap: int) -> int:
    if window <= 0 or overlap >= window:
        raise ValueError(f"overlap {overlap} must be below window {window}, which must be positive")
    return window - overlap


def n_windows(length: Column, window: int, step: int, tail: int | None = None, least: int | None = None) -> Column:
    """Windows of a sequence of that length; one end window more if what is left is over ``tail``."""
    n = F.floor((length - window) / step).cast("long") + 1
    if tail is not None:
        n = n + ((length - window) % step > tail).cast("long")
    out = F.when(length <= window, F.lit(1).cast("long")).otherwise(n)
    return out if least is None else F.when(length < least, F.lit(0).cast("long")).otherwise(out)


def window_starts(length: Column, window: int, step: int, tail: int | None = None, least: int | None = None) -> Column:
    strided = F.sequence(F.lit(0), length - window, F.lit(step))
    if tail is not None:
        strided = F.when((length - window) % step > tail, F.concat(strided, F.array(length - window))).otherwise(strided)
    out = F.when(length <= window, F.array(F.lit(0))).otherwise(strided)
    return out if least is None else F.when(length < least, F.array().cast("array<int>")).otherwise(out)


def query_starts(length: Column, window: int) -> Column:
    """Starts of chunks without overlap, the short tail included; none for an empty query."""
    return F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(window))).otherwise(F.array().cast("array<int>"))


def kmers(seq: Column, k: int) -> Column:
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def k_of_identity(cutoff: float) -> int:
    """The longest k that a match of that identity must share: errors as evenly spread as can be leave runs one shorter than their distance."""
    spacing = round(1 / (1 - cutoff), 9)  # 1 / (1 - 0.9) is a little over 10 in floats
    return math.ceil(spacing) - 1


def gc_fraction(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GCgc]", "")) / F.length(seq)


def bin_label(identity: Column, edges: tuple[float, ...] = (0.90, 0.95, 0.99)) -> Column:
    """Bins closed below; without an identity "unaligned"."""
    edges = sorted(edges)
    out = F.when(identity.isNull(), "unaligned").when(identity < edges[0], f"lt{edges[0]:.2f}")
    for low, high in zip(edges, edges[1:]):
        out = out.when(identity < high, f"{low:.2f}-{high:.2f}")
    return out.otherwise(f"ge{edges[-1]:.2f}")


def cigar_matches(cigar: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)="), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def contained(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first interval lies within the second."""
    return (s2 <= s1) & (e2 >= e1)


def beta_parameters(mean: float, sd: float, top: float) -> tuple[float, float]:
    """Of the Beta distribution with this mean and deviation after scaling by top."""
    m, v = mean / top, (sd / top) ** 2
    scale = m * (1 - m) / v - 1
    if scale <= 0:
        raise ValueError("the deviation is too large for a Beta distribution")
    return m * scale, (1 - m) * scale
