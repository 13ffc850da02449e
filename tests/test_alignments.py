"""Alignment search, infix distances and hard negatives against plain dynamic programming."""

import random

import pytest

from strandmill.functions.alignment import banded_alignments, infix_distance, smith_waterman
from strandmill.operators import alignment_search, kmer_search
from strandmill.plans import registry
from strandmill.sources import store

SF = "/root/testdata/sf0.001"


def plain_infix(q, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(q, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def changed(rng, text, n):
    x = list(text)
    for _ in range(n):
        i = rng.randrange(len(x))
        x[i] = rng.choice(["", rng.choice("ACGT"), x[i] + rng.choice("ACGT")])
    return "".join(x)


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def test_infix_distance():
    rng = random.Random(1)
    for _ in range(400):
        q, t = dna(rng, rng.randint(0, 12)), dna(rng, rng.randint(0, 20))
        d = plain_infix(q, t)
        assert infix_distance(q, t) == d
        assert [infix_distance(q, t, c) for c in range(5)] == [d if d <= c else None for c in range(5)]


def test_banded_alignments():
    rng = random.Random(2)
    for _ in range(60):
        qs = [dna(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        ts = [dna(rng, rng.randint(0, 20)) + changed(rng, q, rng.randint(0, 5)) + dna(rng, rng.randint(0, 10)) for q in qs]
        for q, t, (score, same, columns, a, b, c, d) in zip(qs, ts, banded_alignments(qs, ts, [-30] * len(qs), 100), strict=True):
            assert score == smith_waterman(q, t) == smith_waterman(q[a:b], t[c:d])
            gaps = 2 * columns - (b - a) - (d - c)
            assert 2 * same - 3 * (columns - gaps - same) - 5 * gaps <= score <= 2 * same - 3 * (columns - gaps - same) - 2 * gaps


def test_band_excludes_other_diagonals():
    assert banded_alignments(["ACGTACGT"], ["TTTTTTTTTTACGTACGT"], [0], 8)[0][0] < 16 == banded_alignments(["ACGTACGT"], ["TTTTTTTTTTACGTACGT"], [8], 8)[0][0]


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(3)
    contigs = [(f"acc{i % 4}", i, dna(rng, rng.choice([60, 400, 900]))) for i in range(24)]
    contigs += [("acc9", 30, None), ("acc9", 31, "")]
    queries = []
    for i in range(12):
        text = contigs[i * 2][2]
        at = rng.randrange(max(1, len(text) - 120))
        piece = changed(rng, text[at : at + 120], 6)
        queries.append((i, piece if i % 2 else piece[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return [*queries, (50, "ACG"), (51, "")], contigs


@pytest.mark.parametrize("chars", [2_000_000, 300])
def test_search_brute_force(spark, reads, monkeypatch, chars):
    """Every alignment that shares seeds has the score of whole dynamic programming, on its strand; other block sizes change nothing."""
    monkeypatch.setattr(alignment_search, "BLOCK_CHARS", chars)
    queries, contigs = reads
    q = spark.createDataFrame(queries, "query_id long, sequence string")
    c = spark.createDataFrame(contigs, "accession string, contig long, sequence string")
    got = alignment_search.search(q, c, 8, 30, 10, store.scratch(spark, "t")).collect()
    text = {i: t for _, i, t in contigs}
    best = {}
    for r in got:
        sequence = dict(queries)[int(r["query_id"])]
        strand = sequence if r["strand"] == "+" else sequence[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r["score"] <= smith_waterman(strand, text[r["contig"]])
        if r["rank"] == 1:
            best[int(r["query_id"])] = r
    for i in range(12):
        r = best[i]
        assert r["contig"] == i * 2 and r["strand"] == ("+" if i % 2 else "-") and r["identity"] > 0.85 and r["coverage"] > 0.85
        whole = max(smith_waterman(s, text[i * 2]) for s in (queries[i][1], queries[i][1][::-1].translate(str.maketrans("ACGT", "TGCA"))))
        assert r["score"] == whole
    assert {int(r["query_id"]) for r in got} <= set(range(12))


def test_most_seeds_are_extended(spark, reads):
    queries, contigs = reads
    q = spark.createDataFrame(queries, "query_id long, sequence string")
    c = spark.createDataFrame(contigs, "accession string, contig long, sequence string")
    found = alignment_search.candidates(q, c, 6, 3, store.scratch(spark, "t")).collect()
    for i in range(12):
        own = [r for r in found if r["query_id"] == str(i)]
        assert len(own) == 3 and max(own, key=lambda r: r["seeds"])["contig"] == i * 2
    for r in found:  # seeds of the window, counted plainly
        sequence = dict(queries)[int(r["query_id"])]
        s = sequence if r["strand"] == "+" else sequence[::-1].translate(str.maketrans("ACGT", "TGCA"))
        t = {x: y for _, x, y in contigs}[r["contig"]]
        low = r["half"] * alignment_search.HALF
        assert r["seeds"] == sum(s[i : i + 6] == t[j : j + 6] and low <= j - i < low + 2 * alignment_search.HALF for i in range(len(s) - 5) for j in range(len(t) - 5))


def test_hard_negatives_brute_force(spark):
    rows = {r["item_id"]: r["text"] for r in registry.table(spark, SF, "benchmark").collect()}
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    want = []
    for a in (i for i in rows if i % 20 == 0):
        scored = []
        for b in rows:
            q, t = sorted((rows[a], rows[b]), key=len) if len(rows[a]) != len(rows[b]) else (rows[a], rows[b])
            if a != b and grams(q) & grams(t):
                d = infix_distance(q, t)
                scored.append((-(1 - d / len(q)), b, d))
        want += [(a, n + 1, b, d) for n, (_, b, d) in enumerate(sorted(scored)[:5])]
    got = registry.hard_negatives(spark, SF).collect()
    assert sorted((r["query_id"], r["rank"], r["target_id"], r["distance"]) for r in got) == want


def test_hard_negatives_small_k(spark):
    """The second step finds what the first, by bounds alone, ranked too low."""
    rng = random.Random(7)
    texts = [(i, dna(rng, rng.randint(20, 60))) for i in range(60)]
    pool = spark.createDataFrame(texts, "target_id long, sequence string")
    got = kmer_search.hard_negatives(spark.createDataFrame(texts, "query_id long, sequence string"), pool, 3, 2).collect()
    for a, x in texts:
        scored = []
        for b, y in texts:
            q, t = (x, y) if len(x) <= len(y) else (y, x)
            if a != b and {q[i : i + 3] for i in range(len(q) - 2)} & {t[i : i + 3] for i in range(len(t) - 2)}:
                scored.append((-(1 - plain_infix(q, t) / len(q)), b))
        assert [(r["target_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == a] == [b for _, b in sorted(scored)[:2]]


def test_infix_filter(spark):
    rng = random.Random(8)
    long = [(i, dna(rng, 80)) for i in range(10)]
    short = [(i, changed(rng, t[10:50], rng.randint(0, 6))) for i, t in long] + [(20, dna(rng, 40))]
    got = kmer_search.infix_filter(spark.createDataFrame(short, "query_id long, sequence string"), spark.createDataFrame(long, "target_id long, sequence string"), 7, 0.9).collect()
    want = {(i, j, plain_infix(q, t)) for i, q in short for j, t in long if plain_infix(q, t) <= int(len(q) * 0.1 + 1e-9)}
    assert {(r["query_id"], r["target_id"], r["distance"]) for r in got} == want and want
