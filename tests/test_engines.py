"""Engines by name, runs that reuse what is kept, the results tree, and expressions over tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import tables
from strandmill.operators import engines, metrics, ordering, probing, search, training_data
from strandmill.sources import store


def rows_of(n, d=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    v = spark.createDataFrame([(i, f"a{i % 4}", r.tolist()) for i, r in enumerate(rows_of(300))], "vector_id long, accession string, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", rate, r.tolist()) for rate in (0.0, 0.1) for i, r in enumerate(rows_of(5, seed=1 + int(rate * 10)))], "query_id string, rate double, embedding array<float>")
    return v, q


def test_unknown_engines_and_parameters():
    with pytest.raises(ValueError, match="no engine"):
        engines.make_engine("magic")
    with pytest.raises(ValueError, match="no parameter depth"):
        engines.make_engine("pca", depth=3)
    assert engines.make_engine("ivf_rabitq", cells=8, nprobe=4)[1:] == ({"cells": 8}, {"nprobe": 4, "head": 200})


SMALL = {
    "exact": {}, "quantized_exact": {}, "pca": {"dim": 8, "head": 80}, "whitened": {}, "rabitq": {"head": 150}, "ivf_rabitq": {"cells": 8, "nprobe": 8, "head": 150},
    "ivf_pq": {"shards": 2, "lists": 4, "parts": 4, "codes": 32, "nprobe": 4, "head": 100}, "epsilon_net": {"epsilon": 0.3}, "merged_epsilon_net": {"epsilon": 0.3, "merged": 0.4}, "random_sample": {"ratio": 2.0},
}


@pytest.mark.parametrize("name", sorted(engines.ENGINES))
def test_every_engine_runs(spark, data, tmp_path, name):
    v, q = data
    got = engines.run(spark, f"file://{tmp_path}", v, q, name, 10, {"dataset": "d", "encoder": "e-1"}, [0.0], **SMALL[name])
    rows = got.collect()
    assert len(rows) == 5 * 4 and {r["mutation_rate"] for r in rows} == {0.0} and all(r["model"].startswith(f"e-1/{name}") for r in rows)
    if name not in ("epsilon_net", "merged_epsilon_net", "random_sample", "whitened"):
        want = {(r["query_id"], r["accession"]) for r in search.exact(q.where("rate = 0"), v, 10).collect()}
        found = {(r["query_id"], r["accession"]) for r in rows if r["score"] > -2}
        assert len(want & found) >= 0.9 * len(want)


def test_a_second_run_builds_and_searches_nothing(spark, data, tmp_path, monkeypatch):
    v, q = data
    root, about, params = f"file://{tmp_path}", {"dataset": "d", "encoder": "e", "max_len": 256}, {"cells": 8, "nprobe": 8, "head": 50}
    first = engines.run(spark, root, v, q, "ivf_rabitq", 10, about, [0.0, 0.1], **params)
    want = sorted(map(tuple, first.collect()), key=repr)
    assert first.count() == 40

    def never(*_):
        raise AssertionError("built or searched again")

    engine = engines.ENGINES["ivf_rabitq"]
    monkeypatch.setitem(engines.ENGINES, "ivf_rabitq", engines.Engine(never, never, engine.index, engine.search))
    again = engines.run(spark, root, v, q, "ivf_rabitq", 10, about, [0.0, 0.1], **params)
    assert sorted(map(tuple, again.collect()), key=repr) == want
    fewer = engines.run(spark, root, v, q, "ivf_rabitq", 3, about, [0.1], **params)
    assert fewer.where("mutation_rate = 0.1 and score > -2").count() <= 5 * 3
    engines.run(spark, root, v, q, "exact", 5, about, [0.0])
    assert {r["index"] for r in engines.read_results(spark, f"{root}/results").select("index").distinct().collect()} == {"ivf_rabitq-cells8", "exact"}


def test_hits_and_partials_are_not_results(spark, tmp_path):
    one = spark.createDataFrame([("q", "a", 0.5)], "query_id string, accession string, score double")
    about = {"dataset": "d", "encoder": "e", "index": "i", "search": "s", "mutation_rate": 0.0}
    engines.write_results(one, f"{tmp_path}/tree/results", about)
    for other in ("hits", "partials_7"):
        engines.write_results(one, f"{tmp_path}/tree/results/{other}", about)
    got = engines.read_results(spark, f"{tmp_path}/tree/results")
    paths = {p for p in got.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} if got.count() else set()
    assert got.count() == 1 and len(paths) == 1


def test_bootstrap_margin_is_near_the_plain_one(spark):
    x = np.random.default_rng(0).random(300)
    df = spark.createDataFrame([(f"q{i}", float(v)) for i, v in enumerate(x)] + [("none", None)], "query_id string, v double")
    row = metrics.bootstrap_margins(df, [], "query_id", "v", 400).first()
    assert row["n"] == 300 and row["mean"] == pytest.approx(x.mean()) and row["margin"] == pytest.approx(1.96 * x.std() / np.sqrt(300), rel=0.15)


def test_running_ranks_and_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500), strict=True)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    numbered = ordering.running(df.where("v is not null"), [F.col("v")], F.lit(1), "at", store.scratch(spark, "t")).collect()
    values = [r["v"] for r in sorted(numbered, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in numbered) == list(range(500)) and values == sorted(values)
    got = {(r["g"], r["share"]): r["v"] for r in ordering.percentiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.975, 1.0], store.scratch(spark, "t")).collect()}
    for g in range(3):
        own = [v for h, v in rows if h == g and v is not None]
        for p in (0.0, 0.1, 0.5, 0.975, 1.0):
            assert got[g, p] == pytest.approx(np.percentile(own, 100 * p))
    assert ordering.percentiles(df.limit(0), ["g"], "v", [0.5], store.scratch(spark, "t")).collect() == []


def test_batches(spark):
    got = training_data.batches(spark.range(103).withColumnRenamed("id", "k"), "k", 5, 2, 0, 1, store.scratch(spark, "t")).collect()
    assert len(got) == len({r["k"] for r in got}) == 100
    for rank in range(2):
        for batch in range(10):
            assert sum(r["rank"] == rank and r["batch"] == batch for r in got) == 5
    other = training_data.batches(spark.range(103).withColumnRenamed("id", "k"), "k", 5, 2, 0, 2, store.scratch(spark, "t")).collect()
    assert {(r["k"], r["batch"]) for r in got} != {(r["k"], r["batch"]) for r in other}


def test_decoys(spark):
    rows = [(i, i % 2 / 10, f"q{i % 7 if i < 60 else 0}") for i in range(140)]
    df = spark.createDataFrame(rows, "row_id long, rate double, query_id string")
    of = {i: (r, q) for i, r, q in rows}
    got = probing.decoys(df.where("row_id < 60"), "rate", 1, store.scratch(spark, "t")).collect()
    assert len(got) == 60 and sorted(r["decoy"] for r in got) == list(range(60))
    assert all(of[r["decoy"]][0] == r["rate"] and of[r["decoy"]][1] != r["query_id"] for r in got)
    many = probing.decoys(df, "rate", 1, store.scratch(spark, "t")).collect()  # q0 has more than half: some have none, none their own
    assert any(r["decoy"] is None for r in many) and all(r["decoy"] is None or of[r["decoy"]][1] != r["query_id"] for r in many)


def test_mutations_and_pairs():
    rng = np.random.default_rng(0)
    seq = "".join(rng.choice(list("ACGT"), 400))
    same, identity = training_data.mutate(seq, 1.0, rng)
    assert same == seq and identity == 1.0
    changed, identity = training_data.mutate(seq, 0.9, rng, (1, 0, 0))
    assert sum(a != b for a, b in zip(seq, changed, strict=True)) == 40 and identity == pytest.approx(0.9)
    longer, identity = training_data.mutate("AAAA", 0.0, rng, (0, 1, 0))
    assert len(longer) == 8 and longer[1::2] == "AAAA" and identity == pytest.approx(0.5)  # inserted before its base
    assert training_data.mutate("ACGT", 0.0, rng, (0, 0, 1)) == ("", 0.0)
    rules = training_data.PairRules(mutated=False)
    kinds = set()
    for i in range(300):
        one, two = training_data.crop_places(256, rules, np.random.default_rng(i))
        shared = min(one[1], two[1]) - max(one[0], two[0])
        sizes = sorted((one[1] - one[0], two[1] - two[0]))
        assert 40 <= sizes[0] <= sizes[1] <= 120 and shared >= rules.overlap * sizes[1] - 1e-9 and min(one[0], two[0]) >= 0 and max(one[1], two[1]) <= 256
        kinds.add(shared == sizes[0])
        away = training_data.flank(256, (min(one[0], two[0]), max(one[1], two[1])), rules, np.random.default_rng(i))
        assert away is None or away[1] <= min(one[0], two[0]) or away[0] >= max(one[1], two[1])
    assert kinds == {True, False}
    text = "".join(rng.choice(list("ACGT"), 256))
    made = [training_data.pair(text, training_data.PairRules(), np.random.default_rng(i)) for i in range(200)]
    assert {(q in text, r in text) for q, r, _, _ in made} >= {(True, False), (False, True)}
    assert all(n is None or n in text for _, _, n, _ in made) and 0.93 < np.mean([m[3] for m in made]) < 0.97


def test_expressions(spark):
    with pytest.raises(ValueError):
        tables.cut(F.lit(1), [2, 1], ["a", "b", "c"])
    row = spark.range(1).select(
        tables.cut(F.lit(None).cast("double"), [1], ["a", "b"]).alias("n"), tables.cut(F.lit(1.0), [1], ["a", "b"]).alias("at"), tables.cut(F.lit(1.01), [1], ["a", "b"]).alias("over"),
        tables.rate_of(F.lit("x/timing.parquet")).alias("none"), tables.any_of(F.lit(None).cast("boolean"), F.lit(False)).alias("no"), tables.model_key(F.lit(None).cast("string"), F.lit("i"), F.lit("s")).alias("m"), tables.compression_ratio(F.lit(0), F.lit(3)).alias("c"),
    ).first()
    assert tuple(row) == (None, "a", "b", None, False, "i/s", None)


def test_sweep(spark, data, tmp_path):
    v, q = data
    own = q.where("rate = 0").select("query_id", "embedding")
    rows = engines.sweep(spark, f"file://{tmp_path}", v, own, "ivf_rabitq", 10, {"dataset": "d", "encoder": "e"}, {"nprobe": [2, 8], "head": [20, 300]}, cells=8).collect()
    got = {(r["nprobe"], r["head"]): r["recall"] for r in rows}
    assert got[8, 300] == 1.0 and got[2, 300] <= got[8, 300] and got[8, 20] <= got[8, 300] and got[2, 20] <= got[2, 300] < 1.0
