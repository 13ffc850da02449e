"""How short a read may be and still find its source: nested crops by length, rate and draw, and the table of what survives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import vectors as fv
from strandmill.operators import blocks


def _hashed(*parts: Column) -> Column:
    """A whole number below 2^32 from the parts' texts, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def substituted(sequence: Column, rate: Column, alphabet: str, *seed: Column) -> Column:
    """Each character of the alphabet is replaced by another one of it with that chance; the draw is a hash of seed and place."""
    n, letters = len(alphabet), F.lit(alphabet)

    def one(c: Column, i: Column) -> Column:
        at, h = F.instr(letters, c), _hashed(*seed, i)
        other = F.substring(letters, ((at - 1 + 1 + h % (n - 1)) % n + 1).cast("int"), F.lit(1))
        return F.when((at > 0) & (_hashed(*seed, F.lit("x"), i) < rate * 4294967296), other).otherwise(c)

    return F.array_join(F.transform(F.regexp_extract_all(sequence, F.lit("(?s)(.)"), F.lit(1)), one), "")


def nested_reads(parents: DataFrame, lengths: list[int], rates: list[float], draws: int, width: int, alphabet: str = "ACGT", seed: int = 0) -> DataFrame:
    """(query_id, parent_id, length, rate, draw, sequence) of parents(parent_id, sequence) of ``width`` or more.

    All reads of a parent begin at one place, drawn from its id, so a shorter read is the beginning of a
    longer one. The clean read is there once, ``draws`` mutated ones for every other rate.
    """
    if max(lengths) > width:
        raise ValueError("a read is longer than the width")
    own = parents.where(F.length("sequence") >= width)
    start = _hashed(F.lit(seed), F.col("parent_id")) % (F.length("sequence") - width + 1)
    anchored = own.select("parent_id", F.substring("sequence", (start + 1).cast("int"), F.lit(width)).alias("window"))
    levels = [F.struct(F.lit(float(r)).alias("rate"), F.lit(d).alias("draw")) for r in rates for d in range(draws if r else 1)]
    each = anchored.select("parent_id", "window", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length")).select("parent_id", "length", F.substring("window", F.lit(1), F.col("length")).alias("clean"), F.inline(F.array(*levels)))
    # a draw is over places of the window, so that reads of one draw are nested as well
    text = F.when(F.col("rate") == 0, F.col("clean")).otherwise(substituted(F.col("clean"), F.col("rate"), alphabet, F.lit(seed), F.col("parent_id"), F.rint(F.col("rate") * 10000).cast("int"), F.col("draw")))
    name = F.format_string("%s_L%d_r%.2f_d%d", F.col("parent_id").cast("string"), "length", "rate", "draw")
    return each.select(name.alias("query_id"), "parent_id", "length", "rate", "draw", text.alias("sequence"))


class _Within:
    """A block of queries and the vectors within reach of each."""

    def __init__(self, asked: pa.RecordBatch, least: float):
        self.own, self.q, self.least, self.held = asked.column("query_id"), fv.matrix(asked.column("embedding")).astype(np.float64), least, []

    def add(self, part: pa.RecordBatch) -> None:
        s = self.q @ fv.matrix(part.column("embedding")).astype(np.float64).T
        q, v = np.nonzero(s >= self.least)
        if len(q):
            self.held.append(pa.RecordBatch.from_arrays([self.own.take(pa.array(q)), part.column("accession").take(pa.array(v)), pa.array(s[q, v]), part.column("vector_id").take(pa.array(v))], ["query_id", "accession", "score", "vector_id"]))

    def result(self) -> Iterator[pa.RecordBatch]:
        yield from self.held


def within(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(query_id, accession, score, vector_id) of all pairs whose product reaches ``least``."""
    kind = queries.schema["query_id"].dataType.simpleString()
    return blocks.scan(queries.select("query_id", "embedding"), vectors.select("vector_id", "accession", "embedding"), lambda a, _: _Within(a, least), f"query_id {kind}, accession string, score double, vector_id long")


def relevant(parents: DataFrame, vectors: DataFrame, least: float = 0.97) -> DataFrame:
    """(parent_id, accession): the parents' own accessions, and those that hold a near duplicate of their window's vector.

    parents(parent_id, accession, embedding)
    """
    twins = within(parents.select(F.col("parent_id").alias("query_id"), "embedding"), vectors, least).select(F.col("query_id").alias("parent_id"), "accession")
    return parents.select("parent_id", "accession").unionByName(twins).distinct()


def survival(found: DataFrame, reads: DataFrame, sources: DataFrame, ks: list[int]) -> DataFrame:
    """(length, rate, n_reads, found_k ..): the share of reads with one of their sources among the first k accessions.

    found(query_id, accession, rank), sources(parent_id, accession); a read without hits counts as lost.
    """
    hit = found.join(reads.select("query_id", "parent_id"), "query_id").join(sources, ["parent_id", "accession"]).groupBy("query_id").agg(F.min("rank").alias("_first"))
    own = reads.select("query_id", "length", "rate").join(hit, "query_id", "left")
    return own.groupBy("length", "rate").agg(F.count("*").alias("n_reads"), *[F.avg(F.coalesce(F.col("_first") <= k, F.lit(False)).cast("int")).alias(f"found_{k}") for k in ks])
