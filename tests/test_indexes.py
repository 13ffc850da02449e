"""Block scans, nets, inverted files and probes against plain recounts."""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandmill.functions import vectors as fv
from strandmill.operators import blocks, inverted_file, search
from strandmill.plans import registry
from strandmill.sources import store

SF = "/root/testdata/sf0.001"


def rows_of(n, d=16, groups=6, seed=0, noise=0.12):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, d))
    x = centers[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def near(x, n, seed=1):
    """Queries of the rows' own distribution."""
    rng = np.random.default_rng(seed)
    q = x[rng.permutation(len(x))[:n]] + 0.1 * rng.standard_normal((n, x.shape[1]))
    return (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, accession=lambda i: f"a{i % 3}"):
    return spark.createDataFrame([(i, accession(i), v.tolist()) for i, v in enumerate(x)], "vector_id long, accession string, embedding array<float>").repartition(3)


def top(x, q, k):
    s = q.astype(np.float64) @ x.astype(np.float64).T
    return [np.lexsort((np.arange(len(x)), -r))[:k].tolist() for r in s]


def ids(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vector_id"])
    return out


def asked(spark, q):
    return spark.createDataFrame([(f"q{i:03}", v.tolist()) for i, v in enumerate(q)], "query_id string, embedding array<float>")


@pytest.mark.parametrize("broadcast", [True, False])
def test_scan_in_blocks(spark, monkeypatch, broadcast):
    for name, n in (("ROWS", 16), ("QUERIES", 8), ("SLICE", 2), ("BROADCAST_QUERIES", 100 if broadcast else 0)):
        monkeypatch.setattr(blocks, name, n)
    x = rows_of(300)
    q = rows_of(40, seed=3)
    plan = search.exact(asked(spark, q), frame(spark, x), 7)
    assert list(ids(plan).values()) == top(x, q, 7)


def test_plan_does_not_grow_with_queries(spark):
    x = frame(spark, rows_of(50))
    size = lambda n: len(search.exact(asked(spark, rows_of(n, seed=1)), x, 3)._jdf.queryExecution().executedPlan().toString().splitlines())
    assert size(5) == size(600)


def test_scan_of_nothing(spark):
    x, none = frame(spark, rows_of(20)), frame(spark, rows_of(20)).limit(0)
    assert search.exact(asked(spark, rows_of(2)), none, 3).collect() == []
    assert search.exact(asked(spark, rows_of(2)).limit(0), x, 3).collect() == []


def test_net_is_small_and_covers(spark):
    x = rows_of(900)
    v = frame(spark, x)
    net = search.greedy_net(v, 0.5)
    kept = {r["vector_id"]: r["accession"] for r in net.collect()}
    assert len(kept) <= 3 * 6 * 2 and all(kept[i] == f"a{i % 3}" for i in kept)
    for i, row in enumerate(x):
        assert max(row @ x[j] for j in kept if j % 3 == i % 3) >= 0.5 - 1e-5
    assert all(r["n_bare"] == 0 and r["n_centers"] < r["n_rows"] for r in search.net_cover(v, net, 0.5).collect())


def test_net_of_split_groups(spark, monkeypatch):
    """Parts of 50 rows are joined again, and rows that lose their centre get one."""
    monkeypatch.setattr(search, "NET_ROWS", 50)
    x = rows_of(700, groups=25, noise=0.2, seed=4)
    v = frame(spark, x, lambda i: "one")
    net = [r["vector_id"] for r in search.greedy_net(v, 0.3).collect()]
    whole = search._greedy_rows(x, 0.3, 0, 4096)
    assert (x @ x[net].T).max(1).min() >= 0.7 - 1e-5 and len(net) == len(set(net)) and len(net) <= 2 * len(whole) < 350


def test_net_keeps_rows_far_apart():
    x = rows_of(500, groups=20, noise=0.3)
    kept = search._greedy_rows(x, 0.4, 1, 64)
    s = x[kept] @ x[kept].T - 2 * np.eye(len(kept))
    assert s.max() < 0.6 + 1e-6 and (x @ x[kept].T).max(1).min() >= 0.6 - 1e-6


def test_merged_net(spark):
    x = rows_of(600)
    net = search.greedy_net(frame(spark, x), 0.2)
    merged = search.merged_net(net, 0.6).collect()
    centers = [r["vector_id"] for r in merged if r["is_center"]]
    assert len(merged) == net.count() and len(centers) < len(merged) / 2
    for r in merged:
        s = {c: float(x[r["vector_id"]] @ x[c]) for c in centers}
        assert s[r["center"]] >= max(s.values()) - 1e-6 >= 0.4 - 1e-5


def test_pca_head(spark):
    x = rows_of(400, d=16, groups=40, noise=0.4)
    q = rows_of(20, d=16, groups=40, noise=0.4, seed=2)
    want = top(x, q, 10)
    got = list(ids(search.pca(asked(spark, q), frame(spark, x), 10, 8, 80)).values())
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want, strict=True)]) >= 0.9


@pytest.fixture(scope="module")
def cells(spark):
    x = rows_of(800, d=16, groups=30, noise=0.3)
    path = store.shared(spark, "cells")
    inverted_file.build_cells(frame(spark, x), path, 16, 6)
    return x, path


def test_cells_find_and_prune(spark, cells):
    x, path = cells
    q = near(x, 25)
    want = top(x, q, 10)
    got = ids(inverted_file.search_cells(spark, path, asked(spark, q), 10, 8, 60))
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.values(), want, strict=True)]) >= 0.9
    assert list(ids(inverted_file.search_cells(spark, path, asked(spark, q), 10, 16, 800)).values()) == want
    one = inverted_file.search_cells(spark, path, asked(spark, q[:1]), 5, 2, 20)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(|PartitionFilters: \[[^\]]*\(cell#\d+ = ", p) for p in plan.split("\n") if "FileScan parquet" in p and ("codes" in p or "vectors" in p))
    read = inverted_file._only(spark.read.parquet(f"{path}/vectors"), [3, 4]).inputFiles()
    every = {re.search(r"cell=(\d+)", f)[1] for f in spark.read.parquet(f"{path}/vectors").inputFiles()}
    assert len(every) == 16 and read


def test_hot_cell_is_dealt_out(spark, cells, monkeypatch):
    x, path = cells
    monkeypatch.setattr(inverted_file, "CELL_BLOCKS", 1)
    q = rows_of(6, d=16, groups=30, noise=0.3, seed=8)
    assert list(ids(inverted_file.search_cells(spark, path, asked(spark, q), 10, 16, 800)).values()) == top(x, q, 10)


def test_one_bit_estimates(spark, cells):
    """The codes' estimate of a product has no more error than its bits allow, and none for a vector at a centre."""
    x, _ = cells
    c = x[:4]
    v = spark.createDataFrame([(i, "a", i % 4, r.tolist()) for i, r in enumerate(x)], "vector_id long, accession string, cell int, embedding array<float>")
    turn, error = fv.rotation(16), []
    for r in inverted_file.residual_codes(v, c).collect():
        signs = fv.unpack_signs(np.frombuffer(bytes(r["code"]), np.uint8).reshape(1, -1))[0]
        q = x[(r["vector_id"] + 1) % len(x)]
        guess = q @ c[r["cell"]] + (q @ turn) @ signs * r["gain"]
        error.append(abs(guess - q @ x[r["vector_id"]]))
        if r["vector_id"] < 4:
            assert error[-1] < 1e-5
    assert np.mean(error) < 0.35


def test_shards(spark):
    x = rows_of(900, d=16, groups=30, noise=0.3)
    path, v = store.shared(spark, "shards"), frame(spark, x)
    inverted_file.build_shards(v, path, 3, 8, 4, 32, sample=200, rounds=5)
    models = spark.read.parquet(f"{path}/models").collect()
    assert sorted(m["shard"] for m in models) == [0, 1, 2] and len({bytes(m["books"]) for m in models}) == 3
    q = near(x, 25)
    want = top(x, q, 10)
    got = ids(inverted_file.search_shards(spark, path, asked(spark, q), v, 10, 4, 100, 4))
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.values(), want, strict=True)]) >= 0.9
    # estimates are those of decoded vectors
    flat = {}
    for r in spark.read.parquet(f"{path}/codes").collect():
        m = next(m for m in models if m["shard"] == r["shard"])
        c, books = np.frombuffer(m["centroids"], np.float32).reshape(-1, 16), np.frombuffer(m["books"], np.float32).reshape(4, -1, 4)
        for i, code in zip(r["vector_id"], r["code"], strict=True):
            flat[i] = c[r["cell"]] + np.concatenate([b[k] for b, k in zip(books, bytes(code), strict=True)])
    assert len(flat) == 900
    for r in inverted_file.search_shards(spark, path, asked(spark, q), v, 5, 8, 0, 4).collect():
        assert r["score"] == pytest.approx(float(q[int(r["query_id"][1:])] @ flat[r["vector_id"]]), abs=1e-4)


@pytest.mark.parametrize("name", ["_cells_found", "_shards_found", "_pca_found"])
def test_recall_of_queries(spark, name):
    got = registry.recall_of(spark, SF, getattr(registry, name)).first()
    assert got["reached"] and got["n_wanted"] == 10 * got["n_queries"]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/x/y.json"
    assert not store.exists(spark, path)
    store.write_text(spark, path, "äb")
    store.write_text(spark, path, "äc")
    assert store.read_text(spark, path) == "äc" and os.listdir(tmp_path / "x") and [n for n in store.names(spark, f"file://{tmp_path}/x") if not n.endswith(".crc")] == ["y.json"]
    store.delete(spark, path)
    assert not store.exists(spark, path)


@pytest.mark.parametrize("name", ["_pca_found", "_cells_found"])
def test_recall_of_larger_tables(spark, name, tmp_path):
    """A head that is a smaller share of a larger table still lets nine tenths of the best through."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((10_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = pa.table({"vec_id": np.arange(len(x)), "embedding": fv.lists(x), "label": pa.array(np.arange(len(x)) % 10, pa.int32())})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    got = registry.recall_of(spark, str(tmp_path), getattr(registry, name)).first()
    assert got == (500, 5000, True)


def test_tiles_are_bounded(spark):
    """A task's rows don't grow with the table, and there are tasks enough for the cores."""
    for vectors, queries in ((10_256, 1_026), (102_564, 10_258), (615_384, 61_540), (6_000_000, 300_000)):
        s, g = blocks.tiles(vectors, queries, 36)
        assert vectors / s <= blocks.ROWS * blocks.SLICE and queries / g <= blocks.QUERIES * blocks.SLICE
        assert s * g >= min(36, vectors // (2 * blocks.ROWS) * max(1, queries // (2 * blocks.QUERIES)))


@pytest.mark.parametrize("name", ["run_outcomes", "validation", "run_overlap", "exhaustive_scores"])
def test_blocks_of_many_queries_meet_in_tiles(spark, monkeypatch, name):
    """Beyond the queries of a few blocks no row is a pair of blocks."""
    monkeypatch.setattr(blocks, "BROADCAST_QUERIES", 1)
    met, pairs = [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda *a: met.append(a[2]) or pairs(*a))
    plain = registry.queries()[name](spark, SF).collect()
    monkeypatch.undo()
    assert met and set(met) == {("slice", "group")} and sorted(map(repr, plain)) == sorted(map(repr, registry.queries()[name](spark, SF).collect()))


def test_cells_meet_in_blocks(spark):
    plan = registry.ivf_search(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "MergeJoin [cell" not in plan
