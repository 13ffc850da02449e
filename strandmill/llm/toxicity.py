"""Toxicity by compression distance.

zstandard's trainer makes two dictionaries from a bounded sample of labelled
documents: one from windows of ordinary text, one from what toxic text has and ordinary
text hasn't. The latter's samples are the words of toxic documents whose start (a space
and 3 to 9 bytes) is in ``LEAST_DOCS`` toxic documents or more and has there ``LIFT`` times
its share of ordinary documents, cut ``MORE`` bytes after that start. Both dictionaries are
loaded as content, and the ordinary one also stands behind the toxic one, so that
ordinary matches have equal distances and lengths in both: a window's two compressed
lengths differ only by what is toxic in it. Every window of about ``WINDOW`` bytes, cut at
spaces, is compressed with both. From the byte savings a document gets three figures
(the largest, their sum, the number of windows) and a logistic curve, fitted on the
labelled documents that the dictionaries weren't trained on, turns them into a score that
passes 0.5 at the calibrated threshold.

Sample: at most about ``SAMPLE_DOCS`` labelled documents of each class, chosen by hash
of doc_id, and of those the first in order of the hash that have ``SAMPLE_BYTES`` of text
together. Three of four train the dictionaries, which have at most ``ORDINARY_BYTES`` and
``TOXIC_BYTES``, the fourth calibrates.

Defined results: a null or empty text, and any text when the labels lack a class,
scores the base rate, below 0.5. Null labels teach nothing; a doc_id that is labelled
0 and 1 teaches both classes, and its repeated rows each teach. Repeated rows score alike; a text's score doesn't depend on any other row or column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.base import table, text_chunks

WINDOW = 48
SAMPLE_DOCS = 3000
SAMPLE_BYTES = 40_000_000  # of text that come to the driver at most
ORDINARY_BYTES, TOXIC_BYTES = 16_000, 1000
LEAST_DOCS, LIFT, MORE = 3, 25, 4
_SPACES = bytes([9, 10, 11, 12, 13, 32])
_PARAMS = {"window_log": 17, "chain_log": 17, "hash_log": 17, "search_log": 7, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY}
_FRAME = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}


def pieces(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Windows of at least size bytes, each ending at a space; the last may be short."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.find(b" ", end)
            end = min(len(text), end + size if space < 0 else space, end + size)
        out.append(text[at:end])
        at = end
    return out


class Distance:
    """Saved bytes of windows under the toxic dictionary against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.tools: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def _tools(self) -> tuple:
        if self.tools is None:
            params = zstandard.ZstdCompressionParameters(**_PARAMS, **_FRAME)
            made = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress)
            self.tools = tuple(made)
        return self.tools

    def figures(self, text: bytes) -> tuple[float, float, float]:
        """Of a text: the largest saving of a window, all savings over a byte together, the number of windows."""
        ordinary, toxic = self._tools()
        saved = [len(ordinary(w)) - len(toxic(w)) for w in pieces(text.lower())]
        if not saved:
            return 0.0, 0.0, 0.0
        return float(max(saved)), float(sum(s - 1 for s in saved if s > 1)), float(len(saved))


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary by zstandard's trainer, or the samples themselves if they are too few or too uniform to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def starts(text: bytes) -> set[bytes]:
    """A space and the first 3 to 9 bytes of every word."""
    led = {b" " + w for w in set(text.lower().split())}
    return {w[:n] for w in led for n in range(4, min(len(w), 10) + 1)}


def telling(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """The shortest starts of words that toxic documents have LIFT times as often."""
    seen, usual = (Counter(x for t in texts for x in starts(t)) for texts in (toxic, ordinary))
    least = LIFT * (len(toxic) + 1.0) / (len(ordinary) + 1.0)
    good = {x for x, n in seen.items() if n >= LEAST_DOCS and n >= least * (usual[x] + 0.5)}
    return {x for x in good if not any(x[:n] in good for n in range(4, len(x)))}


def fragments(texts: list[bytes], marks: set[bytes]) -> list[bytes]:
    """For each text the words with a telling start, cut MORE bytes after it."""
    out = []
    for t in texts:
        found = []
        for w in t.lower().split():
            w = b" " + w
            found += [w[: n + MORE] for n in range(4, min(len(w), 10) + 1) if w[:n] in marks]
        if found:
            out.append(b"".join(found))
    return out


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Distance:
    base = _trained([w for t in ordinary for w in pieces(t.lower())], ORDINARY_BYTES)
    marked = fragments(toxic, telling(toxic, ordinary))
    return Distance(base, _trained(marked, TOXIC_BYTES, k=48, d=8) if marked else b"")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps, in a fixed order of rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.array([1.0] * (len(w) - 1) + [0.0])
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _inputs(figures: np.ndarray) -> np.ndarray:
    most, total, windows = figures.T
    return np.column_stack([np.clip(most, 0, 10), np.log1p(total) * 2, np.log1p(100 * total / np.maximum(windows, 1)), np.log1p(windows)])


class Scorer:
    def __init__(self, distance: Distance | None, weights: np.ndarray | None, floor: float):
        self.distance, self.weights, self.floor = distance, weights, floor

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.distance is None or not texts:
            return np.full(len(texts), self.floor)
        x = _inputs(np.array([self.distance.figures(t) for t in texts]))
        out = 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))
        return np.where(np.array([len(t) for t in texts]) > 0, out, self.floor)


def sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """(toxic, text) of a bounded sample of labelled rows, in order of a hash of doc_id, and how many rows each label has."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit(4))
    chosen = F.lit(False)
    for value, n in counts.items():
        chosen = chosen | ((F.col("toxic") == value) & (F.pmod(h, F.lit(1_000_000)) < round(min(1.0, sample_docs / n) * 1_000_000)))
    picked = known.where(chosen).dropDuplicates(["doc_id", "toxic"])
    # at most about 2 * sample_docs rows by the shares above, so this side is small
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(h.alias("h"), "doc_id", "toxic", "text")
    out, size = [], 0
    for r in rows.orderBy("h", "doc_id", "toxic", "text").toLocalIterator():
        out.append((r["toxic"], r["text"].encode()))
        size += len(out[-1][1])
        if size > SAMPLE_BYTES:
            break
    return out, counts


def train(rows: list[tuple[int, bytes]], known: dict[int, int] | None = None) -> Scorer:
    """Dictionaries from three of four rows of the sample, the logistic curve from the rest. known: labelled rows of each class, of which rows is a sample."""
    parts = {y: [t for v, t in rows if v == y] for y in (0, 1)}
    known = known or {y: len(t) for y, t in parts.items()}
    rate = (known.get(1, 0) + 0.5) / (sum(known.values()) + 1.0)
    floor = min(0.4, rate)
    if min(len(parts[0]), len(parts[1])) < 4:
        return Scorer(None, None, floor)
    taught = {y: [t for i, t in enumerate(texts) if i % 4 != 3] for y, texts in parts.items()}
    distance = train_dictionaries(taught[1], taught[0])
    rest = [(y, t) for y in (0, 1) for t in parts[y][3::4]]
    x = _inputs(np.array([distance.figures(t) for _, t in rest]))
    share = {y: max(known[y], 1) / len(t) for y, t in parts.items()}
    y = np.array([y for y, _ in rest])
    weight = np.where(y == 1, share[1], share[0])
    return Scorer(distance, fit_logistic(x, y.astype(float), weight / weight.mean()), floor)


def score_column(spark: SparkSession, scorer: Scorer):
    """A function from a text column to its score."""
    sent = spark.sparkContext.broadcast(scorer)  # under 100 KB

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own = sent.value
        out = []
        for _, _, data, offsets in text_chunks(texts):
            raw = data.tobytes()
            out.append(own.score([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Scorer:
    return train(*sample(docs, labels.where(fold() != 0)))


def fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def reject_toxic(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents whose score is below 0.5, with their own columns."""
    score = score_column(docs.sparkSession, scorer)
    return docs.where(score("text") < 0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = score_column(spark, learn(spark, docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
