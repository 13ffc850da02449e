"""Composition of sequences, in one pass over whole texts: k-mer entropy, low-complexity score, runs, shares of characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

COMPOSITION = "struct<length:bigint,n_kmers:bigint,entropy:double,dust:double,longest_run:bigint,top_share:double>"


def describe(text: str, k: int) -> tuple:
    """length, distinct k-mers, their entropy in bits, DUST's score of pairs of equal k-mers, longest run and the share of the commonest character."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(codes)
    if not n:
        return 0, 0, None, 0.0, 0, None
    edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
    top = float(np.unique(codes, return_counts=True)[1].max() / n)
    run = int(np.diff(edges).max())
    if n < k:
        return n, 0, None, 0.0, run, top
    _, codes = np.unique(codes, return_inverse=True)
    base = int(codes.max()) + 1
    if base**k >= 1 << 62:
        raise ValueError(f"k is too large for {base} different characters")
    words = sum(codes[i : n - k + 1 + i] * base ** (k - 1 - i) for i in range(k))
    counts = np.unique(words, return_counts=True)[1]
    total = n - k + 1
    p = counts / total
    return n, len(counts), float(-(p * np.log2(p)).sum()), float((counts * (counts - 1) / 2).sum() / (total - 1)) if total > 1 else 0.0, run, top


def composition(k: int = 3):
    """``describe`` as an Arrow function; null for null."""

    @F.arrow_udf(COMPOSITION)
    def run(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else describe(t, k) for t in (x.as_py() for x in texts)]
        columns = list(zip(*[r or (None,) * 6 for r in rows], strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        fields = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(fields, ["length", "n_kmers", "entropy", "dust", "longest_run", "top_share"], mask=pa.array([r is None for r in rows]))

    return run
