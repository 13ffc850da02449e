"""Each step of Python in a stage holds a worker for every core; the searches have one in a stage."""

import re

import numpy as np
import pyarrow as pa
import pytest

from strandmill.operators import blocks, inverted_file
from strandmill.plans import registry

SF = "/root/testdata/sf0.001"


def most_steps(df):
    """Steps of Python that follow each other without an exchange, at most."""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"[A-Za-z]|$", line).start()
        while above and above[-1][0] >= depth:
            above.pop()
        n = 0 if "Exchange" in line else (above[-1][1] if above else 0) + bool(re.search(r"InArrow|ArrowEvalPython|InPandas", line))
        above.append((depth, n))
        most = max(most, n)
    return most


@pytest.mark.parametrize("name", ["ivf_pq_search", "rabitq_search", "pca_search", "run_overlap"])
def test_one_step_in_a_stage(spark, monkeypatch, name):
    packed, pack = [], blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda df, *a: packed.append(most_steps(df)) or pack(df, *a))
    assert most_steps(registry.queries()[name](spark, SF)) == 1
    assert max(packed, default=0) <= 1


def test_few_queries_meet_rows_as_they_are_read(spark, monkeypatch):
    """All rows of a partition, a bounded part at a time, and all queries, in one step."""
    class Seen:
        """Rows of each meeting."""

        def __init__(self, asked):
            self.asked, self.rows = asked, []

        def add(self, part):
            self.rows.append(part.num_rows)

        def result(self):
            yield pa.RecordBatch.from_arrays([pa.array([len(self.asked)]), pa.array([sum(self.rows)]), pa.array([max(self.rows)])], ["queries", "rows", "most"])

    monkeypatch.setattr(blocks, "ROWS", 16)
    monkeypatch.setattr(blocks, "QUERIES", 8)
    rows = spark.range(500).coalesce(1).selectExpr("id as vector_id")
    met = blocks.scan(spark.range(20).selectExpr("id as query_id"), rows, lambda asked, _: Seen(asked), "queries long, rows long, most long")
    assert most_steps(met) == 1
    assert sorted(map(tuple, met.collect())) == [(4, 500, 16), (8, 500, 16), (8, 500, 16)]


def test_probes_of_all_shards(spark):
    """Every query has the lists of highest product of every shard, however the queries are dealt."""
    rng = np.random.default_rng(2)
    q, c = rng.standard_normal((30, 8)).astype(np.float32), rng.standard_normal((3, 6, 8)).astype(np.float32)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, embedding array<float>")
    models = spark.createDataFrame([(s, 8, bytearray(x.tobytes())) for s, x in enumerate(c)], "shard int, dims int, centroids binary")
    got = {(r["shard"], r["cell"], r["query_id"]): (r["base"], r["embedding"]) for r in inverted_file.shard_probes(asked, 1000, models, 2).collect()}
    s = np.einsum("ij,skj->sik", q, c)
    assert set(got) == {(a, int(k), f"q{i}") for a in range(3) for i in range(30) for k in np.argsort(-s[a, i])[:2]}
    for (a, k, i), (base, own) in got.items():
        assert abs(base - s[a, int(i[1:]), k]) < 1e-5 and own == q[int(i[1:])].tolist()
