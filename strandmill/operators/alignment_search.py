"""Seed-and-extend search: shared k-mers by diagonal choose targets, banded alignments score them.

Queries go to the scan of the targets in blocks of bounded size, so a target's text stays where
it is read: a task finds the k-mers that a text shares with each query and strand, counts
them in windows of diagonals and gives the best window. The ``max_seqs`` targets with most
seeds are extended, and only their windows of text are cut out for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.alignment import banded_alignments
from strandmill.functions.sequences import reverse_complement
from strandmill.operators.hits import top_k
from strandmill.operators.kmer_search import kmer_hashes

#: Characters of the queries of a block, both strands counted once; a block goes to all tasks.
BLOCK_CHARS = 2_000_000
#: Diagonals of a seed window (two half windows) and what the band has on each side of it.
HALF, MARGIN = 16, 24
#: Pairs that are aligned at once.
TOGETHER = 128


class _Seeds:
    """All k-mers of a block of queries, sorted by hash."""

    def __init__(self, texts: list[str], k: int):
        made = [kmer_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32), k) for t in texts]
        h = np.concatenate([np.zeros(0, np.uint64), *made])
        order = np.argsort(h, kind="stable")
        self.k, self.h = k, h[order]
        self.query = np.concatenate([np.zeros(0, np.int64), *[np.full(len(m), i) for i, m in enumerate(made)]])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(m)) for m in made]])[order]

    def windows(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries that share a k-mer with the text, each with its best window of diagonals and the seeds there."""
        h = kmer_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), self.k)
        first, last = np.searchsorted(self.h, h), np.searchsorted(self.h, h, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query, half = self.query[at], (np.repeat(np.arange(len(h)), n) - self.place[at]) // HALF
        key = np.concatenate([query, query]) << 32 | np.concatenate([half, half - 1]) + (1 << 31)
        key, count = np.unique(key, return_counts=True)
        order = np.lexsort((key, -count, key >> 32))
        order = order[np.r_[True, np.diff(key[order] >> 32) > 0]] if len(order) else order
        return key[order] >> 32, (key[order] & 0xFFFFFFFF) - (1 << 31), count[order]


def _candidates(queries: list, contigs: DataFrame, k: int) -> DataFrame:
    """(query_id, strand, accession, contig, half, seeds) of one block of queries (query_id, strand, sequence)."""
    kinds = {f.name: f.dataType.simpleString() for f in contigs.schema}
    sent = contigs.sparkSession.sparkContext.broadcast(([(r["query_id"], r["strand"]) for r in queries], [r["sequence"] for r in queries]))  # BLOCK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts = sent.value
        ids, strands = pa.array([str(i) for i, _ in own], pa.string()), pa.array([s for _, s in own], pa.string())
        seeds = _Seeds(texts, k)
        for b in batches:
            found = [seeds.windows(t.as_py() or "") for t in b.column("sequence")]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(f[0]) for f in found]))
            q, half, n = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(3))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), strands.take(pa.array(q)), b.column("accession").take(at), b.column("contig").take(at), pa.array(half), pa.array(n)], ["query_id", "strand", "accession", "contig", "half", "seeds"])

    return contigs.select("accession", "contig", "sequence").mapInArrow(run, f"query_id string, strand string, accession {kinds['accession']}, contig {kinds['contig']}, half long, seeds long")


def candidates(queries: DataFrame, contigs: DataFrame, k: int, max_seqs: int, save) -> DataFrame:
    """The max_seqs contigs with most seeds in a window for each query; equal counts go by contig. query_id becomes a string."""
    own = queries.where(F.length("sequence") >= k)
    both = own.select(F.col("query_id").cast("string").alias("query_id"), F.lit("+").alias("strand"), "sequence")
    both = both.unionByName(own.select(F.col("query_id").cast("string").alias("query_id"), F.lit("-").alias("strand"), reverse_complement(F.col("sequence")).alias("sequence")))
    parts = -(-(own.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]) // BLOCK_CHARS)
    best = Window.partitionBy("query_id", "contig").orderBy(F.desc("seeds"), "strand", "half")
    most = Window.partitionBy("query_id").orderBy(F.desc("seeds"), "contig")
    found = None
    for part in range(max(1, parts)):
        block = both.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))) == part).orderBy("query_id", "strand").collect()  # BLOCK_CHARS, about
        each = _candidates(block, contigs, k).withColumn("_n", F.row_number().over(best)).where("_n = 1")
        each = save(each.withColumn("_n", F.row_number().over(most)).where(F.col("_n") <= max_seqs).drop("_n"), f"candidates{part}")
        found = each if found is None else found.unionByName(each)
    return found


def extended(found: DataFrame, queries: DataFrame, contigs: DataFrame) -> DataFrame:
    """found with score, identity, coverage and the aligned places of the query's strand and of the contig."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("sequence").alias("q"))
    low = F.col("half") * HALF - MARGIN
    begin = F.greatest(low, F.lit(0))
    cut = F.substring("sequence", (begin + 1).cast("int"), (low + 2 * HALF + 2 * MARGIN + F.length("q") - begin).cast("int"))
    pairs = found.join(asked, "query_id").join(contigs.select("contig", "sequence"), "contig")
    pairs = pairs.select("query_id", "strand", "accession", "contig", "seeds", F.when(F.col("strand") == "+", F.col("q")).otherwise(reverse_complement(F.col("q"))).alias("q"), cut.alias("window"), begin.alias("begin"), low.alias("low"))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, w = b.column("q").to_pylist(), b.column("window").to_pylist()
            begin, low = b.column("begin").to_numpy(), b.column("low").to_numpy()
            order, out = sorted(range(b.num_rows), key=lambda i: len(q[i])), [None] * b.num_rows
            for at in range(0, len(order), TOGETHER):
                own = order[at : at + TOGETHER]
                for i, r in zip(own, banded_alignments([q[i] for i in own], [w[i] for i in own], [int(low[i] - begin[i]) for i in own], 2 * HALF + 2 * MARGIN), strict=True):
                    out[i] = r
            x = np.array(out, np.int64).reshape(-1, 7)
            sizes = np.array([len(a) for a in q])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("query_id", "strand", "accession", "contig", "seeds")], pa.array(x[:, 0].astype(np.float64)), pa.array(x[:, 1] / np.maximum(x[:, 2], 1)), pa.array((x[:, 4] - x[:, 3]) / np.maximum(sizes, 1)), pa.array(x[:, 3]), pa.array(x[:, 4]), pa.array(x[:, 5] + begin), pa.array(x[:, 6] + begin)],
                ["query_id", "strand", "accession", "contig", "seeds", "score", "identity", "coverage", "q_start", "q_end", "t_start", "t_end"],
            )

    return pairs.mapInArrow(run, f"query_id string, strand string, accession {kinds['accession']}, contig {kinds['contig']}, seeds long, score double, identity double, coverage double, q_start long, q_end long, t_start long, t_end long")


def search(queries: DataFrame, contigs: DataFrame, k: int, max_seqs: int, most: int, save) -> DataFrame:
    """(query_id, rank, accession, score, contig, strand, identity, coverage): the best alignment of each accession, ``most`` a query.

    queries(query_id, sequence), contigs(accession, contig, sequence), contig ids unique. ``save`` writes a table and reads it back.
    """
    each = extended(candidates(queries, contigs, k, max_seqs, save), queries, contigs).where("score > 0")
    of = Window.partitionBy("query_id", "accession").orderBy(F.desc("score"), "contig", "strand")
    best = each.withColumn("_n", F.row_number().over(of)).where("_n = 1").drop("_n")
    return top_k(best, most, tie="accession").select("query_id", "rank", "accession", "score", "contig", "strand", "identity", "coverage")
