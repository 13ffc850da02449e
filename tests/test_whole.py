"""Queries over whole tables and texts, against plain recounts."""

import pyarrow.parquet as pq
import pytest

from strandmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_training_pairs_whole_texts(spark):
    """Every full window has a pair, of which one side at least is the window's own text, and the negative is a stretch beside both."""
    want = {}
    for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        text = (r["text"] or "").upper()
        want |= {r["doc_id"] * 2**20 + k: text[k * 256 : k * 256 + 256] for k in range(len(text) // 256)}
    got = registry.training_pairs(spark, SF).collect()
    assert sorted(r["window_id"] for r in got) == sorted(want)
    for r in got:
        text = want[r["window_id"]]
        assert r["query"] in text or r["ref"] in text
        assert r["negative"] is None or (40 <= len(r["negative"]) <= 120 and r["negative"] in text)
        assert 0.8 < r["identity"] <= 1
    assert sum(r["query"] not in want[r["window_id"]] for r in got) > len(got) / 4 < sum(r["ref"] not in want[r["window_id"]] for r in got)


def test_kmers_of_whole_texts(spark):
    n = {r["doc_id"]: len({t[k : k + 3] for t in [r["text"] or ""] for k in range(len(t) - 2)}) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    assert {r["contig"]: r["n_kmers"] for r in registry.queries()["kmer_entropy"](spark, SF).collect()} == {i: k for i, k in n.items() if k}
    items = pq.read_table(f"{SF}/benchmark.parquet")["item_id"].to_pylist()
    assert registry.queries()["edit_distances"](spark, SF).count() == sum(i % 20 == 0 for i in items) * (len(items) - 1)


def test_all_rows(spark):
    rows = registry.window_counts(spark, SF).groupBy().sum("num_rows").first()[0]
    assert {r["row_id"] for r in registry.queries()["resolve_rows"](spark, SF).collect()} == set(range(rows))
    of = {}
    for r in pq.read_table("/root/testdata/sf0.01/events.parquet", columns=["user_id", "event_id"]).to_pylist():
        of.setdefault(r["user_id"], []).append(r["event_id"])
    want = {(a, b) for ids in of.values() for a in ids for b in ids if a < b and abs(a % 97 - b % 97) < 10}
    assert {(r["one"], r["two"]) for r in registry.queries()["interval_overlap"](spark, "/root/testdata/sf0.01").collect()} == want


@pytest.mark.parametrize("name", ["ivf_search", "rabitq_search", "ivf_rabitq_search", "ivf_pq_search", "pca_search"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall(spark, sf, name):
    want = {(r["query_id"], r["vector_id"]) for r in registry.found(spark, sf).collect()}
    got = {(r["query_id"], r["vector_id"]) for r in registry.queries()[name](spark, sf).collect()}
    assert len(want & got) >= 0.9 * len(want)
