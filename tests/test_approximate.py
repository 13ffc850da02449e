"""Approximate searches against exact ones, and window lookup against a plain recount."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from strandmill.operators import hits, search
from strandmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_ivf_pq_recall(spark):
    want = {(r["query_id"], r["vector_id"]) for r in registry.found(spark, SF).collect()}
    got = {(r["query_id"], r["vector_id"]) for r in registry.ivf_pq_search(spark, SF).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_merged_net_brute_force(spark):
    net = search.greedy_net(registry.vectors(spark, SF), registry.EPSILON)
    merged = search.merged_net(net, registry.EPSILON).collect()
    centers = {r["vector_id"]: np.array(r["embedding"]) for r in merged if r["is_center"]}
    assert len(merged) == net.count() < 500 and 0 < len(centers) < len(merged)
    for r in merged:
        x = np.array(r["embedding"])
        assert x @ centers[r["center"]] >= max(x @ c for c in centers.values()) - 1e-5
    top = registry.merged_net_top(spark, SF).where("rank = 1").collect()
    of = {}
    for r in merged:
        of.setdefault(r["center"], set()).add(r["accession"])
    q = {r["query_id"]: np.array(r["embedding"]) for r in registry.query_vectors(spark, SF).collect()}
    for r in top:
        assert r["score"] == pytest.approx(max(q[r["query_id"]] @ centers[c] for c in of), abs=1e-5)


def test_hit_contigs(spark):
    rows = sorted(registry.chunk_windows(spark, SF).select("accession", "contig", "no", "start").collect(), key=lambda r: (r["accession"], r["contig"], r["no"]))
    got = registry.hit_contigs(spark, SF).collect()
    assert len(got) == registry.found(spark, SF).count()
    for r in got:
        w = rows[r["vector_id"]]
        assert (r["contig"], r["start"]) == (w["contig"], w["start"])


def test_unknown_window_raises(spark):
    flat = spark.createDataFrame([("q", 1, 7)], "query_id string, rank int, vector_id long")
    chunks = spark.createDataFrame([(1, 1, 0)], "vector_id long, contig long, start int")
    with pytest.raises(PySparkException):
        hits.resolve_contigs(flat, chunks).collect()
