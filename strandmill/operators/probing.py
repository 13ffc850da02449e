"""What a search could find at best: cells in probe order, windows over aligned spans, decoys for alignments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import vectors as fv
from strandmill.functions.sequences import contained, overlap
from strandmill.operators import hits, metrics, ordering, search

# --- inverted files without codes -------------------------------------------------------


def probe_ranks(found: DataFrame, chunks: DataFrame, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with ``probe_rank``: how many cells are nearer to the query than the hit's own, by its best chunk.

    found(query_id, vector_id, ..), chunks(query_id, embedding), vectors(vector_id, embedding). One scan serves every number of probes.
    """
    @F.arrow_udf("int")
    def nearer(q: pa.Array, cell: pa.Array) -> pa.Array:
        s = fv.matrix(q).astype(np.float64) @ centroids.T.astype(np.float64)
        return pa.array((s > s[np.arange(len(s)), cell.to_numpy()][:, None]).sum(1).astype(np.int32))

    cells = search.assign_cells(vectors.select("vector_id", "embedding"), centroids).select("vector_id", "cell")
    placed = found.select("query_id", "vector_id").join(cells, "vector_id").join(chunks.select("query_id", "embedding"), "query_id")
    ranks = placed.select("query_id", "vector_id", nearer("embedding", "cell").alias("r")).groupBy("query_id", "vector_id").agg(F.min("r").alias("probe_rank"))
    return found.join(ranks, ["query_id", "vector_id"])


def scanned_shares(chunks: DataFrame, vectors: DataFrame, centroids: np.ndarray, nprobes: list[int]) -> DataFrame:
    """(nprobe, scanned): the mean share of the vectors that lie in the first cells of a chunk's probe order."""
    sizes = np.zeros(len(centroids))
    for r in search.assign_cells(vectors.select("vector_id", "embedding"), centroids).groupBy("cell").count().collect():  # a row for each cell
        sizes[r["cell"]] = r["count"]
    shares = sizes / max(sizes.sum(), 1)

    @F.arrow_udf("array<double>")
    def run(q: pa.Array) -> pa.Array:
        order = np.argsort(-(fv.matrix(q).astype(np.float64) @ centroids.T.astype(np.float64)), axis=1, kind="stable")
        at = np.cumsum(shares[order], axis=1)[:, [p - 1 for p in nprobes]]
        return pa.array(at.tolist(), pa.list_(pa.float64()))

    each = chunks.select(F.posexplode(run("embedding")).alias("i", "share"))
    named = F.array(*[F.lit(p) for p in nprobes])
    return each.groupBy(F.element_at(named, F.col("i") + 1).alias("nprobe")).agg(F.avg("share").alias("scanned"))


def probe_table(placed: DataFrame, shares: DataFrame, nprobes: list[int], tops: list[int], queries: DataFrame, accessions: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(nprobe, scanned, top_t.., r_precision): coverage of the first t hits and the accuracy that the covered hits allow.

    placed: exact hits (query_id, rank, accession, score, vector_id, probe_rank). queries, accessions and truth are those of the run.
    """
    levels = F.explode(F.array(*[F.lit(p) for p in nprobes])).alias("nprobe")
    each = placed.select("*", levels)
    kept = F.col("probe_rank") < F.col("nprobe")
    covered = each.groupBy("nprobe").agg(*[F.avg(F.when(F.col("rank") <= t, kept.cast("int"))).alias(f"top_{t}") for t in tops])
    at = F.struct("nprobe", "query_id").alias("query_id")
    asked = queries.select("query_id", levels)
    results = hits.regroup(each.where(kept).select(at, "accession", "score", "vector_id", "rank"), asked.select(at), accessions, k)
    scores = metrics.r_precision(metrics.judged(results, truth.select("query_id", "accession", levels).select(at, "accession")))
    ceiling = scores.groupBy(F.col("query_id.nprobe").alias("nprobe")).agg(F.avg("r_precision").alias("r_precision"))
    return covered.join(shares, "nprobe").join(ceiling, "nprobe")


# --- windows over aligned spans ---------------------------------------------------------


def window_cover(spans: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """spans(.., contig, s, e) with every window of ``width`` that overlaps them: vector_id, start, overlap, contains.

    An equi-join on contig and stretch of ``width``: a window begins in one stretch, so no pair is made twice,
    and a long contig is dealt out by stretch.
    """
    stretches = F.sequence(F.floor((F.col("s") - width + 1) / width), F.floor((F.col("e") - 1) / width))
    asked = spans.where("e > s").withColumn("_stretch", F.explode(stretches))
    own = windows.select("vector_id", "contig", "start", F.floor(F.col("start") / width).alias("_stretch"))
    end = F.col("start") + width
    both = asked.join(own, ["contig", "_stretch"]).where((F.col("start") < F.col("e")) & (end > F.col("s"))).drop("_stretch")
    return both.withColumns({"overlap": overlap(F.col("s"), F.col("e"), F.col("start"), end), "contains": contained(F.col("s"), F.col("e"), F.col("start"), end)})


def best_cover(cover: DataFrame, *by: str) -> DataFrame:
    """(by, vector_id, overlap): the window that covers most of each span, the smaller id of equal ones."""
    best = cover.groupBy(*by).agg(F.max(F.struct("overlap", -F.col("vector_id"))).alias("m"))
    return best.select(*by, (-F.col("m.col2")).alias("vector_id"), "m.overlap")


def window_recall(found: DataFrame, spans: DataFrame, windows: DataFrame, width: int, ks: list[int], share: float = 0.5) -> DataFrame:
    """(query_id, accession, acc_k, win_k, contain_k ..) of every pair of spans(query_id, accession, contig, s, e) whose query was searched.

    acc: a hit of the accession among the first k; win: its window overlaps an aligned span by ``share`` of
    the shorter of both; contain: it covers the span, or is covered where the span is longer.
    """
    cover = window_cover(spans, windows, width)
    size = F.col("e") - F.col("s")
    cover = cover.withColumn("win", F.col("overlap") >= share * F.least(size, F.lit(width))).withColumn("contain", F.col("contains") | ((size > width) & (F.col("overlap") >= width)))
    cover = cover.groupBy("query_id", "accession", "vector_id").agg(F.bool_or("win").alias("win"), F.bool_or("contain").alias("contain"))
    own = found.select("query_id", "accession", "vector_id", "rank").join(cover, ["query_id", "accession", "vector_id"], "left")
    first = lambda c: F.min(F.when(c, F.col("rank")))
    ranks = own.groupBy("query_id", "accession").agg(F.min("rank").alias("acc"), first(F.col("win")).alias("win"), first(F.col("contain")).alias("contain"))
    pairs = spans.select("query_id", "accession").distinct().join(found.select("query_id").distinct(), "query_id", "left_semi")
    return pairs.join(ranks, ["query_id", "accession"], "left").select("query_id", "accession", *[F.coalesce(F.col(c) <= k, F.lit(False)).alias(f"{c}_{k}") for k in ks for c in ("acc", "win", "contain")])


def window_recall_table(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_queries, means): pairs averaged within a query, then over queries."""
    flags = [c for c in pairs.columns if c.rsplit("_", 1)[0] in ("acc", "win", "contain")]
    each = pairs.groupBy(*by, "query_id").agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in flags])
    return each.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in flags])


# --- decoys ------------------------------------------------------------------------------


def decoys(rows: DataFrame, rate: str, seed: int, save) -> DataFrame:
    """rows(row_id, rate, query_id, ..) with ``decoy``, the row_id of a row of the same rate and another query.

    Rows of a rate stand in an order that keeps a query's together and is shuffled otherwise; each
    gets the row that stands as many places on as a query has rows at most. That is never its own
    query where no query has more than half of a rate's rows; elsewhere decoy is null.
    """
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")))
    order = [F.col(rate), mixed, F.col("query_id"), F.col("row_id")]
    placed = ordering.running(rows.select("row_id", rate, "query_id"), order, F.lit(1), "_at", save)
    sizes = placed.groupBy(rate, "query_id").agg(F.count("*").alias("n")).groupBy(rate).agg(F.max("n").alias("_step"), F.sum("n").alias("_all"))
    begins = placed.groupBy(rate).agg(F.min("_at").alias("_begin"))
    asked = placed.join(F.broadcast(sizes.join(begins, rate)), rate)  # a row for each rate
    asked = asked.withColumn("_at", F.col("_begin") + (F.col("_at") - F.col("_begin") + F.col("_step")) % F.col("_all"))
    other = placed.select("_at", F.col("row_id").alias("decoy"), F.col("query_id").alias("_other"))
    paired = asked.join(other, "_at").select("row_id", F.when(F.col("_other") != F.col("query_id"), F.col("decoy")).alias("decoy"))
    return rows.join(paired, "row_id")


def audit_summary(aligned: DataFrame, by: list[str], least_coverage: float, save) -> DataFrame:
    """(by, n_hits, pass_share, id_median, id_p10, id_p90, share_75, share_95) of aligned(by, identity, coverage).

    Identities are those of alignments that cover at least that share of the query.
    """
    passes = F.coalesce(F.col("coverage") >= least_coverage, F.lit(False))
    own = aligned.withColumn("_id", F.when(passes, F.col("identity")))
    reach = lambda x: F.avg(F.when(passes, (F.col("identity") >= x).cast("int")))
    table = own.groupBy(*by).agg(F.count("*").alias("n_hits"), F.avg(passes.cast("int")).alias("pass_share"), reach(0.75).alias("share_75"), reach(0.95).alias("share_95"))
    levels = ordering.percentiles(own, by, "_id", [0.1, 0.5, 0.9], save)
    wide = levels.groupBy(*by).agg(*[F.max(F.when(F.col("share") == p, F.col("_id"))).alias(name) for p, name in ((0.5, "id_median"), (0.1, "id_p10"), (0.9, "id_p90"))])
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    on: Column = same[0]
    for s in same[1:]:
        on = on & s
    return table.alias("x").join(wide.alias("y"), on, "left").select(*[F.col(f"x.{c}") for c in table.columns], "id_median", "id_p10", "id_p90")


def identity_histogram(aligned: DataFrame, by: list[str], least_coverage: float, edges: tuple[float, ...] = (0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """A row for each ``by`` and a column for each range of identity, closed above, and for alignments of too little coverage."""
    low = [f"under_{round(100 * e)}" for e in edges] + ["under_100"]
    bin_ = F.when(~F.coalesce(F.col("coverage") >= least_coverage, F.lit(False)), "fail")
    for name, e in zip(low, edges, strict=False):
        bin_ = bin_.when(F.col("identity") <= e, name)
    names = ["fail", *low]
    return aligned.withColumn("_bin", bin_.otherwise(low[-1])).groupBy(*by).agg(*[F.count_if(F.col("_bin") == n).alias(n) for n in names])
