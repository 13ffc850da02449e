"""Hits and results: long form inside, nested lists at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.schemas import MISS_SCORE

_EMPTY = F.array


def top_k(flat: DataFrame, k: int, by: str = "query_id", tie: str = "vector_id") -> DataFrame:
    """The k best rows of each query with rank from 1: score descending, then ``tie``."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def build_hits(flat: DataFrame, k: int) -> DataFrame:
    """Long hits(query_id, accession, score, vector_id) of real vectors, the best score of each vector, k a query."""
    best = flat.where("vector_id >= 0").groupBy("query_id", "vector_id").agg(F.max("score").alias("score"), F.min("accession").alias("accession"))
    return top_k(best, k)


def nest(flat: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each query with its hits as a list; [] for those without."""
    item = F.struct("rank", F.struct("accession", "score", "vector_id").alias("hit"))
    lists = flat.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["hit"]).alias("hits"))
    empty = F.array().cast("array<struct<accession:string,score:double,vector_id:bigint>>")
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("hits", empty).alias("hits"))


def flatten(nested: DataFrame) -> DataFrame:
    return nested.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), "hit.*")


def merge_hits(parts: list[DataFrame], k: int) -> DataFrame:
    """Hits of disjoint shards together; ids aren't compared across them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out.drop("rank"), k)


def merge_partials(parts: list[DataFrame], queries: DataFrame, accessions: DataFrame) -> DataFrame:
    """Exhaustive results (query_id, accession, score) of shards of accessions, each query's as one list in order of accession. A query that lacks an accession, or has one twice, raises."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lists = out.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("accession", "score"))).alias("results"))
    size = accessions.agg(F.countDistinct("accession").alias("n_all"))  # one row
    own = queries.select("query_id").join(lists, "query_id", "left").crossJoin(F.broadcast(size))
    whole = F.coalesce(F.size(F.array_distinct(F.transform("results", lambda x: x["accession"]))) == F.col("n_all"), F.lit(False)) & (F.size("results") == F.col("n_all"))
    return own.withColumn("ok", F.assert_true(whole, F.lit("a query hasn't one score for each accession"))).where(F.col("ok").isNull()).select("query_id", "results")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, which raises where rows share the keys, such as contigs of one name in two accessions."""
    twice = F.count("*").over(Window.partitionBy(*keys)) > 1
    checked = df.withColumn("_ok", F.assert_true(~twice, F.concat(F.lit(f"rows share {', '.join(keys)}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))))
    return checked.where(F.col("_ok").isNull()).drop("_ok")


def regroup(flat: DataFrame, queries: DataFrame, accessions: DataFrame, k: int) -> DataFrame:
    """(query_id, accession, score) of every pair: the best of the first k hits, misses at MISS_SCORE. Unknown accessions raise."""
    best = flat.where(F.col("rank") <= k).groupBy("query_id", "accession").agg(F.max("score").alias("score"))
    known = accessions.select("accession", F.lit(True).alias("known"))
    best = best.join(known, "accession", "left").withColumn("ok", F.assert_true(F.col("known").isNotNull(), F.lit("a hit names an accession that isn't indexed")))
    best = best.where(F.col("ok").isNull()).select("query_id", "accession", "score")
    grid = queries.select("query_id").crossJoin(accessions.select("accession"))  # the result is this grid
    return grid.join(best, ["query_id", "accession"], "left").withColumn("score", F.coalesce("score", F.lit(MISS_SCORE)))


def apply_cutoff(results: Column, cutoff: float) -> Column:
    return F.transform(results, lambda x: F.struct(x["accession"].alias("accession"), F.when(x["score"] >= cutoff, x["score"]).otherwise(F.lit(MISS_SCORE)).alias("score")))


def merge_indexes(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """The k best accessions of two result sets, each with its better score."""
    best = one.unionByName(two).groupBy("query_id", "accession").agg(F.max("score").alias("score"))
    return top_k(best, k, tie="accession")


def reusable(cached: DataFrame, queries: DataFrame) -> bool:
    """Whether cached hits cover every query."""
    return queries.select("query_id").join(cached.select("query_id").distinct(), "query_id", "left_anti").limit(1).count() == 0


def resolve_contigs(flat: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the contig and start of their window, from chunks(vector_id, contig, start). An id without a window raises."""
    of = chunks.select("vector_id", "contig", "start", F.lit(True).alias("known"))
    out = flat.join(of, "vector_id", "left").withColumn("ok", F.assert_true(F.col("known").isNotNull(), F.lit("a hit names a vector that has no window")))
    return out.where(F.col("ok").isNull()).drop("ok", "known")
