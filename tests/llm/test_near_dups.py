"""Near duplicates against all pairs compared in plain Python."""

import random

import pytest

from strandmill.llm import near_dups
from strandmill.llm.base import Scratch, table

SF = "/root/testdata/sf0.001"


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def brute(texts, size):
    """{doc_id: (set size, smallest reachable doc_id)}"""
    sets = sets_of(texts, size)
    comp = {i: i for i in texts}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {i: new if c == old else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in texts}


def found(spark, docs, size):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, Scratch(spark, "t"), size=size).collect()]


@pytest.mark.parametrize("size", [2, 5])
def test_all_pairs(spark, size):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert sorted(found(spark, docs, size)) == [(i, *x) for i, x in sorted(brute(texts, size).items())]


def copies(seed: int, n: int, words: int, changed: int) -> list[str]:
    """Copies of one text with some words changed in each, so that pairs lie around the threshold."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(1000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randrange(changed)):
            w[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rounds,part", [(1, 7), (3, 250)])
def test_large_group(spark, monkeypatch, rounds, part):
    """Also where nearly all is left to the blocks, and those are many."""
    monkeypatch.setattr(near_dups, "ROUNDS", rounds)
    monkeypatch.setattr(near_dups, "PART", part)
    texts = dict(enumerate(copies(1, 120, 100, 16) + copies(2, 60, 60, 14)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(found(spark, docs, 2)) == [(i, *x) for i, x in sorted(brute(texts, 2).items())]


def test_odd_rows(spark):
    long = " ".join(f"w{k % 5003}" for k in range(60_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g h"), (2, "A b C d e f g"), (None, "a b c d e f g"), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, long), (9, long + " end"), (9, long + " end")]
    docs = spark.createDataFrame([(i, t, "x", 1, "c") for i, t in rows], "doc_id long, text string, key string, component long, n_shingles string")
    got = found(spark, docs, 2)
    assert sorted(x for x in got if x[0] is not None) == [(1, 6, 1, True), (1, 6, 1, True), (2, 6, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 5003, 8, True), (9, 5004, 8, False), (9, 5004, 8, False)]
    assert sorted((x for x in got if x[0] is None), key=str) == [(None, 0, None, True), (None, 6, None, True)]
    left = near_dups.drop_near_duplicates(docs, Scratch(spark, "t"), 2)
    assert left.columns == docs.columns and left.count() == 9


def test_empty_and_text_ids(spark):
    assert found(spark, spark.createDataFrame([], "doc_id long, text string"), 5) == []
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "q")], "doc_id string, text string")
    assert sorted(found(spark, docs, 2)) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 1, "c", True)]
