"""Language identification by partial matching (PPM, escape method C).

For every language a variable-order tree of byte contexts (orders 3 to 0, then
uniform) is counted on a bounded sample of labelled documents and then frozen. A
text is coded under each tree; the language with the shortest code wins. The code
length of a byte is -log2 of its probability in the longest context that has seen
it, plus the escape from every longer context. Bytes are case-folded (A-Z) and the
rare ones share one class, so contexts are small integers and the trees are tables.

Sample: at most about ``SAMPLE_DOCS`` documents for each language, chosen by hash of
doc_id, and whole texts of them. The statistics thus have a bounded size, whatever
the input.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Ties
go to the language first in order. Without any learned language all is ``und``. A
null language teaches nothing. Rows with a null doc_id are predicted but not
learned from. Repeated rows get equal results; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.base import table, text_chunks

SAMPLE_DOCS = 1500
CLASSES = 48
_SPACE_CLASS = 0


def _classes() -> np.ndarray:
    """Class of each byte: letters a class each, then the bytes of two-byte Latin letters, the rest by kind."""
    of = np.full(256, 27, np.uint8)  # other ASCII
    of[[9, 10, 11, 12, 13, 32]] = _SPACE_CLASS
    for i in range(26):
        of[97 + i] = of[65 + i] = 1 + i
    of[0x80:] = 28  # other bytes beyond ASCII
    of[0xC3] = 29
    for i, low in enumerate((0x9F, 0xA0, 0xA1, 0xA2, 0xA4, 0xA7, 0xA8, 0xA9, 0xAA, 0xAB, 0xAD, 0xAE, 0xAF, 0xB1, 0xB3, 0xB4, 0xB6)):
        of[low] = of[low - 0x20] = 30 + i
    of[0xB9:0xBD] = of[0x99:0x9D] = 47  # u with any accent
    return of


BYTE_CLASS = _classes()


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order-3 grams (context and symbol) of every byte, rows led by three spaces; the row offsets in them."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + 3 * rows, _SPACE_CLASS, np.uint8)
    at = np.arange(len(data)) + 3 * (np.repeat(np.arange(rows), np.diff(offsets)) + 1)
    padded[at] = BYTE_CLASS[data]
    c = padded.astype(np.int32)
    gram = np.zeros(len(c), np.int32)
    gram[3:] = ((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:]
    return gram[at], padded, offsets


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of order-3 grams by language of a whole partition; at most CLASSES**4 for each language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            texts = batch.column("text").filter(pa.array(langs == lang))
            for _, _, data, offsets in text_chunks(texts):
                if len(data):
                    seen, n = np.unique(codes(data, offsets)[0], return_counts=True)
                    if lang not in total:
                        total[lang] = np.zeros(CLASSES**4, np.int32)
                    total[lang][seen] += n.astype(np.int32)
    for lang, counts in total.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen].astype(np.int64))], ["lang", "gram", "n"])


def count_grams(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(lang, gram, n) over the sample: doc_id hashes below a share that leaves about sample_docs of each language."""
    usable = docs.where("lang is not null and doc_id is not null and text is not null").select(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)).alias("h"), F.col("lang").cast("string"), "text")
    shares = {r["lang"]: min(1.0, sample_docs / r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return docs.sparkSession.createDataFrame([], "lang string, gram int, n long")
    chosen = F.lit(False)
    for lang, share in shares.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_000)) < round(share * 1_000_000)))
    return usable.where(chosen).select("lang", "text").mapInArrow(_count_batches, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths. ``grams`` are the order-3 grams that any language has, ``bits`` their lengths by language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        k, grams = CLASSES, np.array(sorted({r[1] for r in rows}), np.int64)
        self.grams, self.bits = grams, np.zeros((len(self.langs), len(grams)), np.float32)
        self.escape = np.zeros((len(self.langs), k**3), np.float32)
        self.lower = np.zeros((len(self.langs), k**3), np.float32)
        for i, lang in enumerate(self.langs):
            counts = np.zeros(k**4)
            for r in (r for r in rows if r[0] == lang):
                counts[r[1]] = r[2]
            below = np.full((1, k), np.log2(k))
            for order in range(4):
                c = counts.reshape(k ** (3 - order), -1, k).sum(0)  # contexts of this order, symbol
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = -np.log2(c / (total + kinds))
                    escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                shorter = np.tile(below, (len(c) // len(below), 1))
                if order == 3:
                    self.escape[i] = escape[:, 0]
                    self.lower[i] = below.reshape(-1)
                    ctx, sym = np.divmod(grams, k)
                    self.bits[i] = np.where(c[ctx, sym] > 0, seen[ctx, sym], escape[ctx, 0] + shorter[ctx, sym])
                else:
                    below = np.where(c > 0, seen, escape + shorter)
        self.index: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        if self.index is None:
            self.index = np.full(CLASSES**4, -1, np.int32)
            self.index[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        gram = codes(data, offsets)[0]
        state = self.index[gram]
        new = np.flatnonzero(state < 0)
        new_gram = gram[new]
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        filled = np.flatnonzero(np.diff(offsets))
        if not len(filled):
            return out
        for i in range(len(self.langs)):
            bits = self.bits[i][state]
            bits[new] = self.escape[i][new_gram // CLASSES] + self.lower[i][new_gram % CLASSES**3]
            out[filled, i] = np.add.reduceat(bits, offsets[filled], dtype=np.float64)
        return out


_LOADED: dict[int, Model] = {}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score: the share of the winner in 2^-bits, lengths taken for at most 64 bytes."""
    langs = [*model.langs]
    if not langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, by the number of classes and languages
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array(langs, object)
        for batch in batches:
            preds, scores = [], []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                bits = own.lengths(data, offsets)
                scale = np.minimum(1.0, 64.0 / np.maximum(np.diff(offsets), 1))[:, None]
                odds = np.exp2(-(bits - bits.min(1, keepdims=True)) * scale)
                preds.append(names[bits.argmin(1)])
                scores.append(1.0 / odds.sum(1))
            if preds:
                und = ~np.array(batch.column("letters").to_pylist(), bool)
                pred, value = np.concatenate(preds), np.concatenate(scores)
                pred[und], value[und] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(value)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model; its counts (languages times seen grams) come to the driver."""
    return Model([(r["lang"], r["gram"], r["n"]) for r in count_grams(docs, sample_docs).toLocalIterator()])


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(remainder(4) != 2))
    return predict(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
