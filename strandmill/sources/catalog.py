"""Stored artifacts: their identity as JSON beside them on the store that Spark reads, and searches that were kept."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import vectors as fv
from strandmill.operators import hits
from strandmill.sources import store

#: Parts of an identity that don't change what a smaller search would find.
LOOSE = ("top_k", "num_queries", "seed")


def canonical(identity: dict) -> str:
    return json.dumps(identity, sort_keys=True, separators=(",", ":"))


def record(spark: SparkSession, folder: str, identity: dict) -> None:
    store.write_text(spark, f"{folder}/config.json", canonical(identity))


def ensure(spark: SparkSession, folder: str, identity: dict) -> bool:
    """True if the folder holds this artifact; raises if it holds another or one without identity."""
    if not store.names(spark, folder):
        return False
    if not store.exists(spark, f"{folder}/config.json"):
        raise ValueError(f"{folder} has no config.json")
    found = store.read_text(spark, f"{folder}/config.json")
    if canonical(json.loads(found)) != canonical(identity):
        raise ValueError(f"{folder} holds another artifact: {found}")
    return True


def built(spark: SparkSession, folder: str, identity: dict, build: Callable[[str], None]) -> str:
    """The artifact's folder, built first if it isn't there; its identity is written last, so half of one is never taken for it."""
    if store.names(spark, folder) and not store.exists(spark, f"{folder}/config.json"):
        store.delete(spark, folder)
    if not ensure(spark, folder, identity):
        build(folder)
        record(spark, folder, identity)
    return folder


def kept_searches(spark: SparkSession, root: str, identity: dict) -> list[tuple[int, str]]:
    """(top_k, folder) of kept hits that differ from identity in LOOSE parts alone, the largest top_k first."""
    tight = lambda x: canonical({k: v for k, v in x.items() if k not in LOOSE})
    out = []
    for name in store.names(spark, root):
        config = f"{root}/{name}/config.json"
        if store.exists(spark, config):
            found = json.loads(store.read_text(spark, config))
            if tight(found) == tight(identity):
                out.append((int(found["top_k"]), f"{root}/{name}"))
    return sorted(out, reverse=True)


def searched(spark: SparkSession, root: str, identity: dict, queries: DataFrame, search: Callable[[int], DataFrame]) -> DataFrame:
    """The first ``identity["top_k"]`` hits of each query: of kept hits if some hold as many and cover all queries, else of a search that is kept."""
    k = identity["top_k"]
    for held, folder in kept_searches(spark, root, identity):
        if held < k:
            break
        kept = spark.read.parquet(f"{folder}/hits")
        if hits.reusable(spark.read.parquet(f"{folder}/queries"), queries):
            return kept.join(queries.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= k)
    folder = f"{root}/{store.key(canonical(identity))}"
    if store.names(spark, folder):
        store.delete(spark, folder)
    search(k).write.parquet(f"{folder}/hits")
    queries.select("query_id").write.parquet(f"{folder}/queries")
    record(spark, folder, identity)
    return spark.read.parquet(f"{folder}/hits")


def differences(one: DataFrame, two: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: rows of each side without a partner of equal keys, repeated rows counted, and for each value the largest absolute difference."""
    number = lambda df: df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(v).alias(v) for v in values])
    a, b = number(one), number(two)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.alias("a").join(b.alias("b"), on, "full_outer")
    n = lambda x: F.coalesce(F.col(f"{x}._n"), F.lit(0))
    return both.agg(
        F.sum(F.greatest(n("a") - n("b"), F.lit(0))).alias("only_one"), F.sum(F.greatest(n("b") - n("a"), F.lit(0))).alias("only_two"),
        *[F.max(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}"))).alias(f"diff_{v}") for v in values],
    )


def vector_differences(one: DataFrame, two: DataFrame, key: str = "vector_id") -> DataFrame:
    """One row over two builds of the same vectors: how many are in one build only, equal bit for bit, apart, and by how many representable floats at most."""
    both = one.select(key, F.col("embedding").alias("_a")).join(two.select(key, F.col("embedding").alias("_b")), key, "full_outer")
    ulps = both.withColumn("_u", fv.vector_ulps(F.col("_a"), F.col("_b")))
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    return ulps.agg(F.count_if(alone).alias("n_alone"), F.count_if(F.col("_u") == 0).alias("n_equal"), F.count_if(~alone & ~(F.coalesce(F.col("_u"), F.lit(1)) == 0)).alias("n_apart"), F.max("_u").alias("most_ulps"))
