"""Small functions: composition, floats, merges of hits, checks, sinks for queries and their answers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandmill.functions import composition, sequences as sq, vectors as fv
from strandmill.operators import hits, kmer_search, search
from strandmill.plans import registry
from strandmill.sources import fbin, store


def plain_composition(s, k):
    grams = Counter(s[i : i + k] for i in range(len(s) - k + 1))
    total = sum(grams.values())
    run = best = 0
    for i, c in enumerate(s):
        run = run + 1 if i and c == s[i - 1] else 1
        best = max(best, run)
    entropy = -sum(n / total * math.log2(n / total) for n in grams.values()) if total else None
    dust = sum(n * (n - 1) / 2 for n in grams.values()) / (total - 1) if total > 1 else 0.0
    return len(s), len(grams), entropy, dust, best, max(Counter(s).values()) / len(s) if s else None


def test_composition(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choices("ACGé😀", k=rng.randint(1, 60))) for _ in range(50)] + ["", "A", "AA", "AAA", "A" * 300, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", composition.composition(3)("t").alias("c")).collect():
        if texts[r["i"]] is None:
            assert r["c"] is None
        else:
            got, want = tuple(r["c"]), plain_composition(texts[r["i"]], 3)
            assert got[:2] == want[:2] and got[4] == want[4]
            assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-12) for a, b in zip(got, want, strict=True))


def test_ulp_distance(spark):
    one = np.float32(1)
    rows = [(1.0, 1.0), (1.0, float(np.nextafter(one, np.float32(2)))), (0.0, -0.0), (float(np.float32(1e-45)), float(np.float32(-1e-45))), (float("nan"), 1.0), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a float, b float").coalesce(1).select(fv.ulp_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [0, 1, 0, 2, None, None]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(fv.normalise(F.col("v")).alias("n"), fv.l2_norm(F.col("v")).alias("l")).first()
    assert row["n"] == pytest.approx([0.6, 0.8]) and row["l"] == 5.0
    assert sq.step_of(256, 150) == 106 and sq.k_of_identity(0.9) == 9 and sq.k_of_identity(0.95) == 19
    with pytest.raises(ValueError):
        sq.step_of(10, 10)


def frame(spark, rows):
    return spark.createDataFrame(rows, "query_id string, accession string, score double, vector_id long")


def test_merging_hits(spark):
    one, two = frame(spark, [("q", "a", 0.5, 1), ("q", "b", 0.2, 2)]), frame(spark, [("q", "c", 0.3, 1), ("r", "a", 0.1, 4)])
    got = hits.merge_hits([one.withColumn("rank", F.lit(1)), two.withColumn("rank", F.lit(1))], 2).collect()
    assert sorted((r["query_id"], r["rank"], r["accession"]) for r in got) == [("q", 1, "a"), ("q", 2, "c"), ("r", 1, "a")]
    other = frame(spark, [("q", "b", 0.9, 7), ("q", "a", 0.1, 8)])
    got = hits.merge_indexes(one.select("query_id", "accession", "score"), other.select("query_id", "accession", "score"), 5).collect()
    assert sorted((r["rank"], r["accession"], r["score"]) for r in got) == [(1, "b", 0.9), (2, "a", 0.5)]
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    nested = hits.nest(hits.top_k(one, 5), asked)
    assert sorted((r["query_id"], r["rank"], r["accession"], r["vector_id"]) for r in hits.flatten(nested).collect()) == [("q", 1, "a", 1), ("q", 2, "b", 2)]


def test_partials_in_order_of_accession(spark):
    part = lambda *rows: spark.createDataFrame(rows, "query_id string, accession string, score double")
    asked, all_ = spark.createDataFrame([("q",)], "query_id string"), spark.createDataFrame([("a",), ("b",), ("c",)], "accession string")
    got = hits.merge_partials([part(("q", "c", 0.3)), part(("q", "b", 0.9), ("q", "a", 0.1))], asked, all_).first()
    assert [tuple(x) for x in got["results"]] == [("a", 0.1), ("b", 0.9), ("c", 0.3)]
    for bad in (part(("q", "c", 0.3)), part(("q", "a", 0.1), ("q", "b", 0.1), ("q", "b", 0.2), ("q", "c", 0.3))):
        with pytest.raises(PySparkException):
            hits.merge_partials([bad], asked, all_).collect()


def test_unique(spark):
    df = spark.createDataFrame([("a", "c1"), ("b", "c2")], "accession string, contig string")
    assert hits.unique(df, "contig").count() == 2
    with pytest.raises(PySparkException, match="rows share contig: c1"):
        hits.unique(df.unionByName(spark.createDataFrame([("z", "c1")], df.schema)), "contig").collect()


def test_ground_truth_and_query_bundle(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((30, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, "a", r.tolist()) for i, r in enumerate(x)], "vector_id long, accession string, embedding array<float>")
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:6])], "query_id long, embedding array<float>")
    found = search.exact(q, v, 3).withColumnRenamed("query_id", "query_no")
    fbin.write_ground_truth(found, str(tmp_path / "gt.bin"), 3)
    ids, scores = fbin.read_ground_truth(str(tmp_path / "gt.bin"))
    s = x[:6] @ x.T
    assert (ids == np.argsort(-s, axis=1)[:, :3]).all() and np.allclose(scores, np.sort(s, axis=1)[:, ::-1][:, :3], atol=1e-5)
    with pytest.raises(PySparkException):
        fbin.write_ground_truth(found.where("not (query_no = 2 and rank = 3)"), str(tmp_path / "bad.bin"), 3)
    assert not (tmp_path / "bad.bin").exists()
    rows = [(f"q{i}", strand, c, x[i * 4 + 2 * n + c].tolist()) for i in range(3) for n, strand in enumerate("+-") for c in range(2)]
    fbin.write_query_bundle(spark.createDataFrame(rows, "query_id string, strand string, chunk int, embedding array<float>").repartition(4), str(tmp_path / "b"), 4, store.scratch(spark, "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "b" / "query_meta")).collect())) == [("q0", 0, 4, 2), ("q1", 4, 4, 2), ("q2", 8, 4, 2)]
    got = fbin.read_fbin(spark, str(tmp_path / "b" / "query")).orderBy("vector_id").collect()
    assert np.allclose([r["embedding"] for r in got], x[:12])


def test_kmer_counts_beyond_the_bound(spark, monkeypatch):
    """More k-mers of queries than are sent are joined, with equal counts."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, registry.kmer_top(spark, sf).collect()))
    monkeypatch.setattr(kmer_search, "ASKED", 50)
    assert sorted(map(tuple, registry.kmer_top(spark, sf).collect())) == want


def test_whitened_sweep(spark):
    sf = "/root/testdata/sf0.001"
    q, v = registry.query_vectors(spark, sf), registry.vectors(spark, sf)
    got = search.whitened_sweep(q, v, 5, (0.0, 0.25))
    for alpha in (0.0, 0.25):
        one = {(r["query_id"], r["rank"]): r["vector_id"] for r in search.whitened(q, v, 5, alpha).collect()}
        assert {(r["query_id"], r["rank"]): r["vector_id"] for r in got.where(F.col("alpha") == alpha).collect()} == one


def test_code_slices(spark, tmp_path):
    codes = search.rabitq_encode(registry.vectors(spark, "/root/testdata/sf0.001"), np.zeros(64, np.float32))
    search.write_codes(codes, str(tmp_path / "codes"), 100)
    stored = spark.read.parquet(str(tmp_path / "codes"))
    part = search.code_slice(stored, 150, 305, 100)
    assert sorted(r["vector_id"] for r in part.collect()) == list(range(150, 305))
    filters = [x for x in part._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
    assert filters and all("shard" in x.split("PartitionFilters: [")[1].split("]")[0] for x in filters)
    whole = {r["vector_id"]: bytes(r["code"]) for r in codes.collect()}
    assert all(bytes(r["code"]) == whole[r["vector_id"]] for r in part.collect())


def test_vector_differences(spark):
    from strandmill.sources import catalog

    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, -1.0]), (3, [0.0]), (4, [1.0])], "vector_id long, embedding array<float>")
    step = float(np.nextafter(np.float32(1), np.float32(2)))
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [step, -step]), (3, [0.0, 1.0]), (9, [1.0])], "vector_id long, embedding array<float>")
    assert tuple(catalog.vector_differences(one, two).first()) == (2, 1, 2, 1)
