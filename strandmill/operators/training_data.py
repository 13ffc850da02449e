"""Training pairs: crops, flanking negatives, mutations. Every row draws from a generator seeded by its own id."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequences import beta_parameters
from strandmill.operators import ordering

BASES = "ACGT"


@dataclass(frozen=True)
class PairRules:
    """Lengths of crops, the least share of the longer one that both must have in common, how often crops are nested, and the identity of the mutated part."""

    least: int = 40
    most: int = 120
    overlap: float = 0.5
    nested: float = 0.5
    mean: float = 0.95
    sd: float = 0.025
    top: float = 0.99
    kinds: tuple[float, float, float] = (0.4, 0.3, 0.3)
    mutated: bool = True

    @property
    def beta(self) -> tuple[float, float]:
        return beta_parameters(self.mean, self.sd, self.top)


@functools.cache
def _shares(weights: tuple[float, float, float]) -> np.ndarray:
    upto = np.cumsum(weights)
    return upto / upto[-1]


def mutate(seq: str, identity: float, rng: np.random.Generator, kinds: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> tuple[str, float]:
    """round(len * (1 - identity)) places, each substituted, preceded by an insertion, or deleted; with the identity that comes of it."""
    n = min(round(len(seq) * (1 - identity)), len(seq))
    if n <= 0:
        return seq, 1.0
    out = list(seq)
    places = rng.choice(len(seq), size=n, replace=False).tolist()
    # the draws that choice makes from weights and from short lists, without its checks
    for at, kind in zip(places, _shares(kinds).searchsorted(rng.random(n), side="right").tolist(), strict=True):
        if kind == 0:
            others = [b for b in BASES if b != out[at]]
            out[at] = others[rng.integers(len(others))]
        else:
            out[at] = BASES[rng.integers(len(BASES))] + out[at] if kind == 1 else ""
    text = "".join(out)
    return text, 1 - n / max(len(seq), len(text))


def crop_places(size: int, rules: PairRules, rng: np.random.Generator) -> tuple[tuple[int, int], tuple[int, int]]:
    """Two stretches of a window of that size: one within the other, or overlapping at both ends."""
    most = min(rules.most, size)
    one = int(rng.integers(rules.least, most + 1))
    two = int(rng.integers(max(rules.least, math.ceil(one * rules.overlap)), min(most, math.floor(one / rules.overlap)) + 1))
    short, long = sorted((one, two))
    shared = max(math.ceil(rules.overlap * long), rules.least, one + two - size)
    if long >= size or rng.random() < rules.nested or shared >= short:
        at = int(rng.integers(0, size - long + 1))
        inner = at + int(rng.integers(0, long - short + 1))
        return (at, at + long), (inner, inner + short)
    common = int(rng.integers(shared, short))
    at = int(rng.integers(0, size - (one + two - common) + 1))
    return (at, at + one), (at + one - common, at + one - common + two)


def flank(size: int, taken: tuple[int, int], rules: PairRules, rng: np.random.Generator) -> tuple[int, int] | None:
    """A stretch outside the taken one, on a side that has room; None if neither has."""
    sides = [(a, b) for a, b in ((0, taken[0]), (taken[1], size)) if b - a >= rules.least]
    if not sides:
        return None
    a, b = sides[int(rng.integers(len(sides)))]
    n = int(rng.integers(rules.least, min(rules.most, b - a) + 1))
    at = a + int(rng.integers(0, b - a - n + 1))
    return at, at + n


def pair(seq: str, rules: PairRules, rng: np.random.Generator) -> tuple[str, str, str | None, float]:
    """query, ref, negative and the identity of what query and ref share; either of them may be the mutated one, and either may be the query."""
    a, b = rules.beta
    both = crop_places(len(seq), rules, rng)
    start, end = max(x[0] for x in both), min(x[1] for x in both)
    away = flank(len(seq), (min(x[0] for x in both), max(x[1] for x in both)), rules, rng)
    texts, identity = [seq[x:y] for x, y in both], 1.0
    if rules.mutated:
        at = int(rng.integers(2))
        changed, identity = mutate(seq[start:end], float(rng.beta(a, b)) * rules.top, rng, rules.kinds)
        texts[at] = seq[both[at][0] : start] + changed + seq[end : both[at][1]]
    if rng.random() < 0.5:
        texts.reverse()
    return texts[0], texts[1], None if away is None else seq[away[0] : away[1]], identity


def pairs(windows: DataFrame, seed: int = 0, rules: PairRules = PairRules()) -> DataFrame:
    """(window_id, query, ref, negative, identity) of windows(window_id, seq); shorter ones than a crop are left out."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *pair(seq, rules, np.random.default_rng([seed, int(i) & (2**63 - 1)]))) for i, seq in zip(f["window_id"], f["seq"], strict=True)]
            yield pd.DataFrame(rows, columns=["window_id", "query", "ref", "negative", "identity"])

    return windows.where(F.length("seq") >= rules.least).select("window_id", "seq").mapInPandas(run, "window_id long, query string, ref string, negative string, identity double")


#: Windows of a piece of text; a place in a string costs its distance from the start, so windows are cut from pieces.
PIECE_WINDOWS = 40


def full_windows(contigs: DataFrame, width: int, step: int) -> DataFrame:
    """(contig, start, seq): the full windows of contigs(contig, sequence), in upper case; a tail that fills none is left."""
    n = F.floor((F.length("sequence") - width) / step)
    whole = contigs.where(F.length("sequence") >= width).select("contig", F.upper("sequence").alias("sequence"), n.alias("last"), F.explode(F.sequence(F.lit(0), F.floor(n / PIECE_WINDOWS))).alias("p"))
    first = F.col("p") * PIECE_WINDOWS
    pieces = whole.select("contig", first.alias("first"), F.least("last", first + PIECE_WINDOWS - 1).alias("last"), F.substring("sequence", (first * step + 1).cast("int"), F.lit((PIECE_WINDOWS - 1) * step + width)).alias("piece"))
    starts = pieces.select("contig", "first", "piece", F.explode(F.sequence("first", "last")).alias("no"))
    return starts.select("contig", (F.col("no") * step).alias("start"), F.substring("piece", ((F.col("no") - F.col("first")) * step + 1).cast("int"), F.lit(width)).alias("seq"))


def batches(df: DataFrame, key: str, size: int, ranks: int, seed: int, epoch: int, save) -> DataFrame:
    """df in an epoch's shuffled order, dealt to ranks in full batches; what is left over is dropped."""
    placed = ordering.running(df, [F.xxhash64(F.col(key), F.lit(seed + epoch)), F.col(key)], F.lit(1), "_at", save)
    n = df.count() // (size * ranks) * size * ranks
    placed = placed.where(F.col("_at") < n)
    return placed.withColumns({"rank": (F.col("_at") % ranks).cast("int"), "batch": F.floor(F.col("_at") / (size * ranks)).cast("long")}).drop("_at")
