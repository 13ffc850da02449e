"""Exact top-k inner products by branch and bound over a vertical layout.

Vectors are packed into blocks of up to ``ROWS``, one row each, whose bytes hold the
components dimension by dimension. Queries are packed likewise, ``QUERIES`` to a block.
Every block of queries meets every block of vectors once, through an equi-join on the
slice that the vectors' block belongs to; nothing is broadcast and nothing but counts
goes through the driver. Within a task a query takes its dimensions in order of falling
weight, ``STEP`` at a time: products of a step are added for the candidates that are
left, and by Cauchy and Schwarz what the other dimensions can still add is at most the
product of the two remaining masses. Candidates that can't reach the query's k-th best
score so far are dropped and the others compacted, block after block of a slice.

A slice keeps k rows for each query, so the last step ranks k rows for each query and slice.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part, neither do rows with a null id. Only vectors of one dimension are compared. Rows
that repeat a query's id count as one query, with the smallest vector; as candidates
repeated rows stand for themselves, and none has the query's own id. Equal scores go by
the smaller id. Scores are exact as long as sums of absolute products stay below 2^53.
Queries without a candidate have no rows; empty tables give none. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, table

#: Vectors and queries of a block, blocks of vectors of a slice, dimensions of a step.
ROWS, QUERIES, SLICE, STEP = 1024, 256, 32, 16
#: Slack for rounding of the masses, relative to their product.
SLACK = 1e-9

_BLOCK = "dims int, ids array<long>, cells binary"


def usable(v: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dims, ids, cells) of (id, v), v array<double>: up to ``rows`` vectors of one dimension, components dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(d: int, n: int) -> pa.RecordBatch:
            ids, x = np.concatenate([p[0] for p in held[d]]), np.concatenate([p[1] for p in held[d]])
            held[d] = [(ids[n:], x[n:])]
            cells = np.ascontiguousarray(x[:n].T).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids[:n]], pa.list_(pa.int64())), pa.array([cells], pa.binary())], ["dims", "ids", "cells"])

        for b in batches:
            v, ids = b.column("v"), b.column("id").to_numpy(zero_copy_only=False)
            flat = v.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                held.setdefault(d, []).append((ids[at], flat[starts[at][:, None] + np.arange(d)]))
                while sum(len(p[0]) for p in held[d]) >= rows:
                    yield packed(d, rows)
        for d in held:
            if sum(len(p[0]) for p in held[d]):
                yield packed(d, rows)

    return vectors.select("id", "v").mapInArrow(run, _BLOCK)


class _Query:
    """One query's k best rows so far and its dimensions in order of falling weight."""

    def __init__(self, x: np.ndarray, own: int, k: int):
        self.own, self.k = own, k
        self.order = np.argsort(-np.abs(x), kind="stable")
        self.x = x[self.order]
        self.rest = np.sqrt(np.append(np.cumsum((self.x * self.x)[::-1])[::-1], 0.0))
        self.score, self.vid = np.zeros(0), np.zeros(0, np.int64)

    def meet(self, ids: np.ndarray, cells: np.ndarray, mass: np.ndarray) -> None:
        """cells: dimensions x vectors; mass: their squared lengths."""
        left, sums, seen = None, np.zeros(len(ids)), np.zeros(len(ids))
        for at in range(0, len(self.x), STEP):
            part = cells[self.order[at : at + STEP]] if left is None else cells[np.ix_(self.order[at : at + STEP], left)]
            sums = sums + self.x[at : at + STEP] @ part
            if at + STEP >= len(self.x):
                break
            if len(self.score) == self.k:
                seen = seen + np.einsum("ij,ij->j", part, part)
                all_mass = mass if left is None else mass[left]
                most = self.rest[at + STEP] * np.sqrt(np.maximum(all_mass - seen, 0.0) + SLACK * all_mass)
                stay = np.flatnonzero(sums + most * (1 + SLACK) + SLACK >= self.score[-1])
                if len(stay) < len(sums):
                    left, sums, seen = stay if left is None else left[stay], sums[stay], seen[stay]
        vid = ids if left is None else ids[left]
        may = vid != self.own
        if len(self.score) == self.k:
            may &= sums >= self.score[-1]
        score, vid = np.append(self.score, sums[may]), np.append(self.vid, vid[may])
        if len(score) > 8 * self.k:  # only what reaches the k-th best is sorted
            reach = score >= np.partition(score, -self.k)[-self.k]
            score, vid = score[reach], vid[reach]
        best = np.lexsort((vid, -score))[: self.k]
        self.score, self.vid = score[best], vid[best]


def _slices(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each slice. Blocks of one slice and query block that follow each other are searched together."""

    def found(held: list[_Query]) -> pa.RecordBatch:
        q = np.concatenate([np.full(len(h.vid), h.own) for h in held])
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([h.vid for h in held]), pa.int64()), pa.array(np.concatenate([h.score for h in held]))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                d = b.column("dims")[i].as_py()
                mine = (b.column("slice")[i].as_py(), b.column("asked")[i].as_py())
                if mine != key:
                    if held:
                        yield found(held)
                    own = b.column("q_ids")[i].values.to_numpy()
                    x = np.frombuffer(b.column("q_cells")[i].as_buffer(), np.float64).reshape(d, -1)
                    key, held = mine, [_Query(np.ascontiguousarray(x[:, j]), int(own[j]), k) for j in range(len(own))]
                ids = b.column("ids")[i].values.to_numpy()
                cells = np.frombuffer(b.column("cells")[i].as_buffer(), np.float64).reshape(d, -1)
                mass = np.einsum("ij,ij->j", cells, cells)
                for h in held:
                    first = 0 if len(h.score) == h.k else 8 * h.k  # a few rows alone, so that the others can be bounded
                    if first:
                        h.meet(ids[:first], cells[:, :first], mass[:first])
                    h.meet(ids[first:], cells[:, first:], mass[first:])
        if held:
            yield found(held)

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and vectors of (id, v): the k highest inner products with other ids."""
    part = lambda df: df.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", F.col("v").cast("array<double>").alias("v"))
    packed = scratch.save(blocks(part(vectors), ROWS).withColumn("block", F.monotonically_increasing_id()), "vectors")
    asked = part(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = scratch.save(blocks(asked, QUERIES).withColumn("asked", F.monotonically_increasing_id()), "queries")
    slices = -(-packed.count() // SLICE) or 1
    packed = packed.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).repartition(max(slices, 2), "slice", "dims")
    spread = asked.select("dims", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), "asked", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    pairs = packed.hint("shuffle_hash").join(spread, ["slice", "dims"])  # blocks, not rows; a slice's blocks are hashed, and follow each other for each block of queries
    best = _slices(pairs, k)  # Spark sends workers 64 MB at a time, whatever the number of rows
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.when(usable(F.col("embedding")), cell)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), finite.alias("v"))
    found = top_k(v.where("id % 50 = 0"), v, 5, Scratch(spark, "top-k"))
    return found.withColumn("score", F.col("score").cast("long"))


ORACLE = """
WITH x AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
u AS (SELECT r, vec_id, list(floor(256 * c) ORDER BY i) AS v, bool_and(c IS NOT NULL AND isfinite(c)) AS fine
      FROM (SELECT r, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS c, unnest(range(len(embedding))) AS i FROM (SELECT *, row_number() OVER () AS r FROM x)) GROUP BY ALL),
w AS (SELECT vec_id, v FROM u WHERE fine)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, w.v) DESC, w.vec_id) AS INT) AS rank, w.vec_id, CAST(list_inner_product(q.v, w.v) AS BIGINT) AS score
FROM w q JOIN w ON q.vec_id % 50 = 0 AND q.vec_id <> w.vec_id QUALIFY rank <= 5
"""
