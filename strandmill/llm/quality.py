"""Quality rules with risk-controlled thresholds.

Four text ratios are measured for each document. Levels run from lax to strict, each
with one cutoff for every ratio; a document is rejected at a level when any of its
ratios is above its cutoff. Labelled holdout rows of good quality decide, for each
stratum (language), how strict a level may be: levels are tried from lax to strict
(fixed-sequence testing), and one is accepted while the exact binomial
(Clopper-Pearson) upper bound of its false rejection rate, by all rules together,
stays below ``risk``. The error is split over the strata (Bonferroni), so with
probability 1 - ``error`` every stratum loses at most ``risk`` of its good documents.
No stratum borrows another's rows: one whose own rows prove no level, about 220 good ones
at least for these numbers, gets none, and nothing is rejected there beyond the base rule.
The output's ``level`` says which level a row was judged by, null for none.

Defined results: a null or empty text has no words and fails the base rule. A null
language is a stratum of its own, apart from an empty one. Repeated rows are judged
alike. A labelled doc_id counts once, as rejected if any of its rows is, however often
it or its label is repeated. Empty tables give empty results. Only the named columns are
read, so further columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, gram_hashes, mix, row_sums, span_hashes, spans, table, text_chunks, words

#: Cutoffs of each rule from lax to strict: a document is rejected when its ratio is above the cutoff. Level t takes the entry t of each, or its last.
CUTOFFS = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "word_length": (30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0),
}
RISK, ERROR = 0.02, 0.05

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row."""
    starts, ends, first = words(data, offsets)
    rows = len(offsets) - 1
    chars = row_sums(((data & 0xC0) != 0x80) & ~_SPACES[data], offsets)
    symbols = row_sums(_SYMBOL[data], offsets)
    # lines that have a word, told apart by row and content
    ls, le, lf = spans(data == 10, offsets)
    filled = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    row = np.repeat(np.arange(rows), np.diff(lf))[filled]
    key = mix(span_hashes(data, ls, le)[filled] + mix(row.astype(np.uint64)))
    lines = np.bincount(row, minlength=rows)
    _, once = np.unique(key, return_index=True)
    dup_lines = lines - np.bincount(row[once], minlength=rows)
    # words inside a 3-word window that its text has twice or more
    repeated = np.zeros(len(starts), bool)
    row = np.repeat(np.arange(rows), np.diff(first))
    if len(starts) > 2:
        whole = row[2:] == row[:-2]
        key = mix(gram_hashes(span_hashes(data, starts, ends), 3) + mix(row[:-2].astype(np.uint64)))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = whole & (count[back] > 1)
        for i in range(3):
            repeated[i : len(repeated) - 2 + i] |= twice
    return [np.diff(first), chars, symbols, lines, dup_lines, row_sums(repeated, first)]


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        parts = [measure(data, offsets) for _, _, data, offsets in text_chunks(batch.column("text"))]
        if parts:
            found = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *found], ["doc_id", "lang", *names])


def features(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and the ratios that the rules look at."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = docs.select("doc_id", F.col("lang").cast("string"), "text").mapInArrow(
        _measure_batches, f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.withColumns({
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "word_length": ratio("word_chars", "n_words"),
    })


def upper_bound(bad: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound of a rate of which bad of n were seen: P(X <= bad | bound) = level."""
    if n == 0 or bad >= n:
        return 1.0

    def below(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(bad + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = bad / n, 1.0
    for _ in range(60):
        at = (lo + hi) / 2
        lo, hi = (at, hi) if at < 1 and below(at) > level else (lo, at)
    return hi


LEVELS = max(map(len, CUTOFFS.values()))


def cutoffs_at(level: int) -> dict[str, float]:
    return {rule: tried[min(level, len(tried) - 1)] for rule, tried in CUTOFFS.items()}


def choose(counts: dict[str, tuple[int, list[int]]], risk: float, error: float) -> dict[str, int]:
    """The strictest accepted level of each stratum that proves one. counts: good rows, and of those the rejected ones at each level."""
    share, found = error / max(1, len(counts)), {}
    for s, (n, bad) in counts.items():
        for level, x in enumerate(bad):
            if upper_bound(x, n, share) > risk:
                break
            found[s] = level
    return found


def stratum():
    """The language as text; null and every language are told apart by their first character."""
    return F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang")))


def rejected_at(level: int):
    out = F.lit(False)
    for rule, cutoff in cutoffs_at(level).items():
        out = out | (F.col(rule) > cutoff)
    return out


def fit(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, int]:
    """Levels from the rows labelled as good. One aggregate row for each stratum comes to the driver."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    flags = [F.max(rejected_at(t).cast("int")).alias(f"at_{t}") for t in range(LEVELS)]
    once = measured.where(~base_failed()).join(good, "doc_id").groupBy("doc_id", stratum().alias("stratum")).agg(*flags)
    rows = once.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(f"at_{t}").alias(f"at_{t}") for t in range(LEVELS)]).collect()
    return choose({r["stratum"]: (r["n"], [r[f"at_{t}"] for t in range(LEVELS)]) for r in sorted(rows, key=lambda r: r["stratum"])}, risk, error)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(levels: dict[str, int]):
    """True where the level of the row's stratum doesn't reject it."""
    rejected = F.lit(False)
    for own, level in levels.items():
        rejected = rejected | ((stratum() == own) & rejected_at(level))
    return ~rejected


def level_of(levels: dict[str, int]):
    """The level of the row's stratum, null if it has none."""
    out = F.lit(None).cast("int")
    for own, level in levels.items():
        out = F.when(stratum() == own, F.lit(level)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, scratch: Scratch, risk: float = RISK, error: float = ERROR) -> DataFrame:
    measured = scratch.save(features(docs), "measured")
    levels = fit(measured, labels, risk, error)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(levels)).withColumn("level", level_of(levels))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level", *CUTOFFS)
