"""Passages against every repeated window of plain Python, and the recall of near ones."""

import random

import numpy as np
import pyarrow as pa

from strandmill.llm import passages
from strandmill.llm.base import Scratch, table

WORDS = passages.PASSAGE_WORDS


def repeated_windows(texts):
    """(doc_id, place) of each window of WORDS words that another document has too."""
    seen = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        for k in range(len(w) - WORDS + 1):
            seen.setdefault(tuple(w[k : k + WORDS]), set()).add((i, k))
    return {x for places in seen.values() if len({i for i, _ in places}) > 1 for x in places}


def uncovered(want, got):
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    return [(i, k) for i, k in want if not any(a <= k and k + WORDS <= b for a, b in spans.get(i, ()))]


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def check_rows(texts, got):
    """Every row's similarity holds on the texts."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    for r in got:
        one, two = shingles(words[r.doc_id][r.start_word : r.end_word]), shingles(words[r.other_id][r.other_start : r.other_end])
        assert r.doc_id != r.other_id and len(one & two) >= 0.8 * len(one | two) and abs(len(one & two) / len(one | two) - r.similarity) < 1e-9


def test_every_exact_window(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = passages.repeated_passages(docs, Scratch(spark, "t")).collect()
    want = repeated_windows(texts)
    assert want and not uncovered(want, got)
    check_rows(texts, got)


def test_exact_windows_among_similar_ones(spark):
    """Many documents share parts of one passage, so that groups hold windows that aren't equal."""
    rng = random.Random(3)
    common = [f"c{k}" for k in range(120)]
    texts = {}
    for i in range(60):
        a = rng.randrange(60)
        part = common[a : a + rng.randrange(40, 60)]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = f"y{rng.randrange(10**6)}"
        texts[i] = " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(80))] + part + [f"u{rng.randrange(10**6)}" for _ in range(60)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = passages.repeated_passages(docs, Scratch(spark, "t")).collect()
    assert not uncovered(repeated_windows(texts), got)
    check_rows(texts, got)


def test_near_recall(spark):
    """Passages of 80 words at a similarity of 0.8 or more, with words replaced, removed or inserted."""
    rng = random.Random(4)
    rows, pairs = [], 0
    for i in range(240):
        p = [f"p{i}_{k}" for k in range(80)]
        q = list(p)
        for at in rng.sample(range(80), rng.randrange(4)):
            q[at] = rng.choice([f"z{i}_{at}", "", q[at] + f" z{i}_{at}"])
        q = " ".join(q).split()
        if len(shingles(p) & shingles(q)) >= 0.8 * len(shingles(p) | shingles(q)):
            pairs += 1
            rows += [(2 * i + s, " ".join([f"u{rng.randrange(10**7)}" for _ in range(90)] + x + [f"u{rng.randrange(10**7)}" for _ in range(90)])) for s, x in enumerate((p, q))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(docs, Scratch(spark, "t")).collect()
    found = {r.doc_id // 2 for r in got if r.other_id // 2 == r.doc_id // 2 and r.end_word - r.start_word >= 40}
    print("near recall", len(found) / pairs)
    assert len(found) >= 0.9 * pairs
    check_rows(dict(rows), got)


def test_recall_in_groups(spark):
    """Forty near variants of one passage: documents with a partner at 0.8 or more are reported, and such pairs hang together."""
    rng = random.Random(11)
    rows, variants = [], {}
    for g in range(4):
        base = [f"g{g}_{k}" for k in range(80)]
        for i in range(40):
            q = list(base)
            for at in rng.sample(range(80), rng.randrange(4)):
                q[at] = rng.choice([f"z{g}_{i}_{at}", "", f"{q[at]} z{g}_{i}_{at}"])
            variants[40 * g + i] = q = " ".join(q).split()
            rows.append((40 * g + i, " ".join([f"u{rng.randrange(10**7)}" for _ in range(60)] + q + [f"u{rng.randrange(10**7)}" for _ in range(60)])))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    root = {i: i for i in variants}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        root[top(r.doc_id)] = top(r.other_id)
    sets = {i: shingles(q) for i, q in variants.items()}
    near = [(i, j) for i in variants for j in variants if i < j and i // 40 == j // 40 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    own, reported = {i for p in near for i in p}, {r.doc_id for r in got}
    print("documents in groups", len(own & reported), len(own), "pairs together", sum(top(i) == top(j) for i, j in near), len(near))
    assert len(own & reported) >= 0.95 * len(own) and sum(top(i) == top(j) for i, j in near) >= 0.95 * len(near)
    check_rows(dict(rows), got)


def test_odd_rows(spark):
    p = " ".join(f"p{k}" for k in range(70))
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [(1, p), (1, "z " + p), (2, p.upper()), (None, p), (3, None), (4, ""), (5, p + " " + p), (6, long), (7, "x " + long), (7, "x " + long)]
    docs = spark.createDataFrame([(i, t, 1, "k", 0) for i, t in rows], "doc_id long, text string, key long, l string, at long")
    got = passages.repeated_passages(docs, Scratch(spark, "t")).collect()
    texts = {1: p, 2: p.upper(), 5: p + " " + p, 6: long, 7: "x " + long}
    assert not uncovered(repeated_windows(texts), got) and {r.doc_id for r in got} == set(texts)
    check_rows(texts, got)
    assert passages.repeated_passages(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_groups_hang_together(spark):
    """Variants that differ widely from the smallest and the largest: any two runs of a key that are alike hang together, also where blocks are small."""
    rng = random.Random(21)
    rows = []
    for g in range(2):
        base = [f"g{g}_{k}" for k in range(80)]
        for i in range(24):
            q = list(base)
            for at in rng.sample(range(80), rng.randrange(10)):
                q[at] = f"z{g}_{i // 2}_{at}" if rng.randrange(2) else f"y{g}_{i}_{at}"
            rows.append((24 * g + i, " ".join([f"u{rng.randrange(10**7)}" for _ in range(60)] + q + [f"u{rng.randrange(10**7)}" for _ in range(60)])))
    rows += [(100 + i, "same " * 30 + f"v{i} " + "same " * 60) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    tokens = {r["doc_id"]: np.frombuffer(r["tokens"], np.uint32) for b in passages._token_batches([batch]) for r in b.to_pylist()}
    groups = {}
    for b in passages._window_batches([batch]):
        for r in b.to_pylist():
            groups.setdefault(r["key"], []).append((r["doc_id"], r["place"]))
    alike = set()
    for runs in groups.values():
        for a, x in runs:
            for b, y in runs:
                if a < b and (a, b) not in alike:
                    (l, r, at, _), (m, s, to, _) = (passages.places(np.array([z])) for z in (x, y))
                    v, w = max(0, l[0] - passages.WINDOW), max(0, m[0] - passages.WINDOW)
                    one, two = tokens[a][v : r[0] + passages.WINDOW + 1], tokens[b][w : s[0] + passages.WINDOW + 1]
                    if passages.verify(one, two, np.array([[l[0] - v, r[0] - v, at[0] - v, m[0] - w, s[0] - w, to[0] - w]])):
                        alike.add((a, b))
    old = getattr(passages, "TILE", None)
    for size in (old, 5):
        passages.TILE = size
        try:
            got = passages.repeated_passages(docs, Scratch(spark, "t")).collect()
        finally:
            passages.TILE = old
        root = {i: i for i, _ in rows}

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for r in got:
            root[top(r.doc_id)] = top(r.other_id)
        apart = [p for p in alike if top(p[0]) != top(p[1])]
        print("alike", len(alike), "apart", len(apart))
        assert len(alike) > 80 and not apart
        check_rows(dict(rows), got)


def test_tiles_verify_few_pairs(monkeypatch):
    """Of runs that share tokens, ``verify`` sees nearly only those in which it finds passages, and all of them."""
    rng, pair = np.random.default_rng(5), passages.verify
    base = np.arange(1000, 1140, dtype=np.uint32)
    slices = []
    for i in range(40):
        x = base.copy()
        at = rng.choice(140, 24 if i % 4 else 4, replace=False)
        x[at] = 10_000 + 200 * i + at
        slices.append(x)
    link = np.array([47, 100, 70])
    places = [int(47 << 23 | 53 << 8 | 23 << 2)] * 40
    t = pa.table({"key": [1] * 40, "k1": [2] * 40, "b1": [0] * 40, "k2": [2] * 40, "b2": [0] * 40, "doc_id": range(40), "place": places, "part": range(40), "begin": [0] * 40, "tokens": [x.tobytes() for x in slices]})
    alike = [(i, j) for i in range(40) for j in range(i + 1, 40) if pair(slices[i], slices[j], np.concatenate([link, link])[None, :])]
    seen = []
    monkeypatch.setattr(passages, "verify", lambda *a: seen.append(pair(*a)) or seen[-1])
    rows = passages._join_tiles(t, t)
    near = {i: near for i, near, _ in passages._alike(slices, np.tile(link, (40, 1)), slices, np.full(40, 70), np.unique(np.concatenate(slices)))}
    assert alike and all(j in near.get(i, ()) for i, j in alike)
    assert rows and sum(bool(x) for x in seen) > 0.5 * len(seen)
