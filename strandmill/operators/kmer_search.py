"""Search by shared k-mers, and k-mer counts ahead of alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.alignment import infix_distance_udf
from strandmill.functions.sequences import canonical, kmers, reverse_complement
from strandmill.operators.hits import top_k

PIECE = 256
#: Distinct k-mers of the queries up to which they are sent to all tasks; beyond it they are joined.
ASKED = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive code points, by doubling spans."""
    h, size, out, at, left = codes.astype(np.uint64) * _BASE + np.uint64(1), 1, np.zeros(max(0, len(codes) - k + 1), np.uint64), 0, k
    while left and len(out):
        if left & 1:
            out = _mixed(out * _BASE + h[at : at + len(out)])
            at += size
        left >>= 1
        if left:
            h, size = _mixed(h[: len(h) - size] * _BASE + h[size:]), 2 * size
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _matches(asked: np.ndarray, k: int):
    """(accession, kmer) of each batch whose hash is in ``asked`` (sorted), each pair once a batch. The join on text follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            for accession, text in zip(batch.column("accession").to_pylist(), batch.column("sequence").to_pylist(), strict=True):
                h = kmer_hashes(np.frombuffer((text or "").encode("utf-32-le"), np.uint32), k)
                if len(h) and len(asked):
                    at = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, h), len(asked) - 1)] == h)
                    at = at[np.unique(h[at], return_index=True)[1]]
                    found.update(dict.fromkeys((accession, text[i : i + k]) for i in at.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["accession", "kmer"])

    return run


def kmer_counts(queries: DataFrame, contigs: DataFrame, k: int, most: int = 100, both_strands: bool = True) -> DataFrame:
    """(query_id, accession, score, rank): query positions whose k-mer the accession has.

    queries(query_id, sequence), contigs(accession, sequence). Contigs are scanned for the
    hashes of the queries' k-mers, so only k-mers that match leave the scan. Beyond ASKED
    distinct k-mers, those of the contigs are made distinct and joined instead.
    """
    form = canonical if both_strands else (lambda x: x)
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.length("sequence") - k, F.lit(0)), F.lit(PIECE))).alias("at")

    def pieces(df: DataFrame, name: str) -> DataFrame:
        """Pieces that overlap by k - 1: finding a place in a long string costs its distance from the start."""
        return df.select(name, "sequence", places).select(name, F.substring("sequence", F.col("at") + 1, F.lit(PIECE + k - 1)).alias("piece"))

    asked = pieces(queries, "query_id").select("query_id", F.explode(kmers(F.col("piece"), k)).alias("kmer")).select("query_id", form(F.col("kmer")).alias("kmer")).groupBy("query_id", "kmer").agg(F.count("*").alias("n"))
    wanted = asked.select("kmer").distinct()
    if both_strands:
        wanted = wanted.select(F.explode(F.array("kmer", reverse_complement(F.col("kmer")))).alias("kmer")).distinct()
    wanted = [r[0] for r in wanted.limit(ASKED + 1).toLocalIterator()]  # bounded by ASKED
    if len(wanted) <= ASKED:
        hashes = np.unique(np.array([kmer_hashes(np.frombuffer(w.encode("utf-32-le"), np.uint32), k)[0] for w in wanted], np.uint64))
        held = contigs.select("accession", "sequence").mapInArrow(_matches(hashes, k), "accession string, kmer string")
    else:
        held = pieces(contigs, "accession").select("accession", F.explode(F.array_distinct(kmers(F.col("piece"), k))).alias("kmer"))
    held = held.select("accession", form(F.col("kmer")).alias("kmer")).distinct()
    counts = asked.join(held, "kmer").groupBy("query_id", "accession").agg(F.sum("n").cast("double").alias("score"))
    return top_k(counts, most, tie="accession")


def _shared_grams(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query_id, target_id, q, t, size, shared) of pairs that share a k-mer: places of the shorter text whose k-mer the longer has, of ``size`` places."""
    grams = lambda df, name: df.select(name, F.explode(kmers(F.col("sequence"), k)).alias("kmer")).groupBy(name, "kmer").agg(F.count("*").alias(f"n_{name}"))
    left = grams(queries, "query_id")
    pairs = left.join(grams(targets, "target_id"), "kmer").groupBy("query_id", "target_id").agg(F.sum("n_query_id").alias("of_query"), F.sum("n_target_id").alias("of_target"))
    both = pairs.join(queries.select("query_id", F.col("sequence").alias("q")), "query_id").join(targets.select("target_id", F.col("sequence").alias("t")), "target_id")
    short = F.length("q") <= F.length("t")
    return both.select("query_id", "target_id", F.when(short, F.col("q")).otherwise(F.col("t")).alias("q"), F.when(short, F.col("t")).otherwise(F.col("q")).alias("t"), F.when(short, F.col("of_query")).otherwise(F.col("of_target")).alias("shared"))


def _least_distance(k: int):
    """An edit changes k k-mers at most, so what isn't shared takes that many edits."""
    return F.greatest(F.lit(0), F.ceil((F.length("q") - k + 1 - F.col("shared")) / k))


def infix_filter(queries: DataFrame, targets: DataFrame, k: int, identity: float) -> DataFrame:
    """(query_id, target_id, distance) of pairs whose shorter text lies in the longer with that identity, sharing a k-mer by the q-gram lemma."""
    cap = F.floor(F.length("q") * F.lit(1 - identity) + 1e-9).cast("bigint")
    pairs = _shared_grams(queries, targets, k).where(_least_distance(k) <= cap)
    return pairs.withColumn("distance", infix_distance_udf()("q", "t", cap)).where(F.col("distance").isNotNull()).select("query_id", "target_id", "distance")


def hard_negatives(anchors: DataFrame, pool: DataFrame, q: int, k: int) -> DataFrame:
    """(query_id, rank, target_id, distance, score): of the texts that share a k-mer with an anchor, the k of highest infix identity.

    anchors(query_id, sequence), pool(target_id, sequence); an anchor isn't its own negative. The count of shared
    k-mers bounds the identity from above: the 2k pairs of highest bound are aligned first, and
    of the others those whose bound reaches an anchor's k-th identity, capped there.
    """
    size = F.length("q")
    pairs = _shared_grams(anchors, pool, q).where(F.col("query_id") != F.col("target_id")).withColumn("most", 1 - _least_distance(q) / size)
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "target_id")
    pairs = pairs.withColumn("place", F.row_number().over(order))
    scored = lambda df, cap: df.withColumn("distance", infix_distance_udf()("q", "t", cap)).where("distance is not null").withColumn("score", 1 - F.col("distance") / size).select("query_id", "target_id", "distance", "score")
    first = scored(pairs.where(F.col("place") <= 2 * k), F.lit(None).cast("bigint"))
    reach = top_k(first, k, tie="target_id").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("reach"))
    rest = pairs.where(F.col("place") > 2 * k).join(reach, "query_id").where(F.col("most") >= F.col("reach") - 1e-9)
    rest = scored(rest, F.floor((1 - F.col("reach")) * size + 1e-6).cast("bigint"))
    return top_k(first.unionByName(rest), k, tie="target_id")
