"""Searches by name, and runs of them: index built once, hits kept, results as one annotated tree."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.tables import model_key
from strandmill.operators import hits, inverted_file, search
from strandmill.sources import catalog, store

#: Columns of the results tree, in the order they are stored.
RESULTS_TREE = "query_id string, accession string, score double, dataset string, checkpoint string, max_len long, avg_time double, index_size_gb double, encoder string, index string, search string, mutation_rate double"


@dataclass(frozen=True)
class Engine:
    """``build(vectors, path, params)`` writes what a search needs, if anything; ``find(spark, path, queries, vectors, k, params)`` gives hits."""

    find: Callable
    build: Callable | None = None
    #: parameters of the index, and of a search over it, with what they are by default
    index: dict = field(default_factory=dict)
    search: dict = field(default_factory=dict)


def _plain(find: Callable) -> Callable:
    return lambda spark, path, q, v, k, p: find(q, v, k, **p)


def _net(spark: SparkSession, path: str, q: DataFrame, v: DataFrame, k: int, p: dict) -> DataFrame:
    return search.exact(q, spark.read.parquet(f"{path}/net"), k)


def _merged(spark: SparkSession, path: str, q: DataFrame, v: DataFrame, k: int, p: dict) -> DataFrame:
    return search.merged_net_search(q, spark.read.parquet(f"{path}/net"), k).withColumn("vector_id", F.lit(None).cast("long"))


def _one_bit(spark: SparkSession, path: str, q: DataFrame, v: DataFrame, k: int, p: dict) -> DataFrame:
    n, total, _ = search.moments(v)
    center = (total / n).astype("float32")
    return search.rabitq(q, spark.read.parquet(f"{path}/codes"), center, k, p["mode"], vectors=v, head=p["head"])


def _one_bit_codes(v: DataFrame, path: str, p: dict) -> None:
    n, total, _ = search.moments(v)
    search.rabitq_encode(v, (total / n).astype("float32")).write.parquet(f"{path}/codes")


ENGINES = {
    "exact": Engine(_plain(search.exact)),
    "quantized_exact": Engine(_plain(search.quantized_exact), search={"kind": "bf16"}),
    "pca": Engine(_plain(search.pca), search={"dim": 32, "head": 200}),
    "whitened": Engine(_plain(search.whitened), search={"alpha": 0.25}),
    "rabitq": Engine(_one_bit, _one_bit_codes, search={"head": 200, "mode": "reference"}),
    "ivf_rabitq": Engine(lambda s, path, q, v, k, p: inverted_file.search_cells(s, path, q, k, p["nprobe"], p["head"]), lambda v, path, p: inverted_file.build_cells(v, path, p["cells"]), {"cells": 128}, {"nprobe": 64, "head": 200}),
    "ivf_pq": Engine(lambda s, path, q, v, k, p: inverted_file.search_shards(s, path, q, v, k, p["nprobe"], p["head"], p["parts"]), lambda v, path, p: inverted_file.build_shards(v, path, p["shards"], p["lists"], p["parts"], p["codes"]), {"shards": 2, "lists": 128, "parts": 16, "codes": 256}, {"nprobe": 64, "head": 100}),
    "epsilon_net": Engine(_net, lambda v, path, p: search.greedy_net(v, p["epsilon"]).write.parquet(f"{path}/net"), {"epsilon": 0.5}),
    "merged_epsilon_net": Engine(_merged, lambda v, path, p: search.merged_net(search.greedy_net(v, p["epsilon"]), p["merged"]).write.parquet(f"{path}/net"), {"epsilon": 0.5, "merged": 0.5}),
    "random_sample": Engine(_net, lambda v, path, p: search.random_sample(v, p["ratio"]).write.parquet(f"{path}/net"), {"ratio": 10.0}),
}


def make_engine(name: str, **params) -> tuple[Engine, dict, dict]:
    """The engine of that name with the parameters of its index and its search. Unknown names and parameters raise."""
    if name not in ENGINES:
        raise ValueError(f"no engine {name}; there are {', '.join(sorted(ENGINES))}")
    engine = ENGINES[name]
    unknown = set(params) - set(engine.index) - set(engine.search)
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    pick = lambda own: {k: params.get(k, v) for k, v in own.items()}
    return engine, pick(engine.index), pick(engine.search)


def label(name: str, params: dict) -> str:
    return "-".join([name, *[f"{k}{v}" for k, v in sorted(params.items())]])


def run(spark: SparkSession, root: str, vectors: DataFrame, queries: DataFrame, name: str, k: int, about: dict, rates: list[float], **params) -> DataFrame:
    """Builds, searches and regroups queries(query_id, rate, embedding), a rate at a time, and writes each rate's results.

    about: dataset and encoder, with checkpoint and max_len if there are any. An index that is there
    isn't built again and kept hits of as many or more are reused. Returns the run's results as they are stored.
    """
    engine, of_index, of_search = make_engine(name, **params)
    base = {"dataset": about["dataset"], "encoder": about["encoder"]}
    index, found_by = label(name, of_index), label("search", of_search)
    path = f"{root}/index/{about['dataset']}/{about['encoder']}/{index}"
    if engine.build is not None:
        catalog.built(spark, path, base | {"engine": name, **of_index}, lambda p: engine.build(vectors, p, of_index))
    accessions = vectors.select("accession").distinct()
    for rate in rates:
        own = queries.where(F.col("rate") == rate)
        identity = base | {"engine": name, **of_index, **of_search, "rate": rate, "top_k": k}
        kept = catalog.searched(spark, f"{root}/hits", identity, own, lambda n, own=own: engine.find(spark, path, own, vectors, n, of_index | of_search if engine.build is not None else of_search))
        write_results(hits.regroup(kept, own, accessions, k), f"{root}/results", about | {"index": index, "search": found_by, "mutation_rate": rate})
    return read_results(spark, f"{root}/results").where((F.col("index") == index) & (F.col("search") == found_by) & (F.col("encoder") == about["encoder"]))


def sweep(spark: SparkSession, root: str, vectors: DataFrame, queries: DataFrame, name: str, k: int, about: dict, grid: dict[str, list], **params) -> DataFrame:
    """(parameters of the grid, n_found, recall): for every combination of search parameters the share of the exact first k that it finds, over one index."""
    engine, of_index, _ = make_engine(name, **params)
    path = f"{root}/index/{about['dataset']}/{about['encoder']}/{label(name, of_index)}"
    if engine.build is not None:
        catalog.built(spark, path, {"dataset": about["dataset"], "encoder": about["encoder"], "engine": name, **of_index}, lambda p: engine.build(vectors, p, of_index))
    wanted = search.exact(queries, vectors, k).select("query_id", "vector_id", F.lit(1).alias("wanted"))
    out = None
    for values in itertools.product(*grid.values()):
        chosen = dict(zip(grid, values, strict=True))
        of_search = make_engine(name, **params, **chosen)[2]
        found = engine.find(spark, path, queries, vectors, k, of_index | of_search if engine.build is not None else of_search)
        row = wanted.join(found.select("query_id", "vector_id", F.lit(1).alias("hit")), ["query_id", "vector_id"], "left").agg(F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
        row = row.select(*[F.lit(v).alias(c) for c, v in chosen.items()], "n_found", "recall")
        out = row if out is None else out.unionByName(row)
    return out


def write_results(results: DataFrame, path: str, about: dict) -> None:
    """results(query_id, accession, score) with what is known of the run, as one folder of the tree; other runs stay."""
    columns = [c.split() for c in RESULTS_TREE.split(", ")]
    own = results.select(*[F.col(c).cast(kind).alias(c) if c in results.columns else F.lit(about.get(c)).cast(kind).alias(c) for c, kind in columns])
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("encoder", "index", "search", "mutation_rate").parquet(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Results of all trees with the declared columns and ``model``; ``hits``, ``partials_..`` and other folders aren't listed."""
    out = None
    for path in paths:
        parts = [f"{path}/{n}" for n in store.names(spark, path) if n.startswith("encoder=")]
        tree = spark.read.schema(RESULTS_TREE).option("basePath", path).parquet(*parts)
        out = tree if out is None else out.unionByName(tree)
    return out.withColumn("model", model_key(F.col("encoder"), F.col("index"), F.col("search")))
