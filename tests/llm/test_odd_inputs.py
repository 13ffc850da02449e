"""Every operator on empty tables, nulls, repeats, very long texts and columns whose names clash; and what the mixing draws."""

import hashlib
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import decontamination, language, mixing, passages, quality, secrets, sharding, toxicity, url_filter
from strandmill.llm.base import Scratch, text_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASH = "*", "1 AS kept", "'x' AS score", "2 AS blob", "3 AS hub", "4 AS node", "5 AS shard", "6 AS words", "'y' AS topic", "7 AS stratum", "8 AS fp", "9 AS spans"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        own = ("der die das und nicht" if i % 2 else "the of and with not").split() + [f"{'s' if i % 2 else 't'}{k}ly" for k in range(60)]
        words = [rng.choice(own) for _ in range(70)]
        if i % 4 == 0:
            words[::9] = ["horridword"] * len(words[::9])
        rows.append((i, " ".join(words), "de" if i % 2 else "en", f"s{i % 3}", 1))
    long = " ".join(rng.choice(["the", "of", "and", "house", "token=abcdefgh"]) for _ in range(60_000))
    rows += [(500, long, "en", "s1", 1), (501, "x" * 300_000, None, None, 1), (502, None, "en", None, None), (503, "", None, "s0", 0), (None, rows[2][1], "en", "s1", 1), (7, rows[7][1], "de", "s1", 1), (7, rows[7][1], "de", "s1", 1), (8, "other text for the same id", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr(*CLASH)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, None, None)], LABELS).selectExpr("*", "'z' AS text", "'q' AS lang")
    items = spark.createDataFrame([(1, rows[5][1]), (1, rows[5][1]), (2, None), (3, "horridword"), (None, "the of")], "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS words", "3 AS n")
    return rows, docs, labels, items


def scratch(spark):
    return Scratch(spark, "t")


OPERATORS = {
    "quality": lambda s, d, l, b: quality.quality_rules(d, l, scratch(s)),
    "language": lambda s, d, l, b: language.predict(d, language.train(d)),
    "decontamination": lambda s, d, l, b: decontamination.decontaminate(d, b, scratch(s)),
    "mixing": lambda s, d, l, b: mixing.mix(d, scratch(s)).select("row.doc_id", "prob", "kept"),
    "sharding": lambda s, d, l, b: sharding.shard(d, scratch(s), 4),
    "secrets": lambda s, d, l, b: secrets.scan_incremental(d, scratch(s))[0],
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(spark, tables, name):
    rows, docs, labels, items = tables
    got = OPERATORS[name](spark, docs, labels, items).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    repeated = [tuple(x for k, x in sorted(r.asDict().items()) if k not in ("slot", "shard")) for r in got if r["doc_id"] == 7]
    assert len(repeated) == 3 and len(set(map(str, repeated))) == 1  # alike but for their places


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, tables, name):
    _, docs, labels, items = tables
    assert OPERATORS[name](spark, docs.limit(0), labels.limit(0), items.limit(0)).collect() == []
    if name not in ("language", "mixing", "sharding", "secrets"):
        assert OPERATORS[name](spark, docs.limit(5), labels.limit(0), items.limit(0)).count() == 5


def test_toxicity_tables(spark, tables):
    rows, docs, labels, _ = tables
    scorer = toxicity.learn(spark, docs, labels)
    left = toxicity.reject_toxic(docs, scorer)
    assert left.columns == docs.columns
    kept = {str(r["doc_id"]) for r in left.collect()}
    assert {"502", "503"} <= kept and sum(str(i) in kept for i in range(0, 160, 4)) <= 4 and sum(str(i) in kept for i in range(160) if i % 4) >= 110
    assert toxicity.reject_toxic(docs.limit(0), scorer).count() == 0


def test_passages_empty(spark, tables):
    assert passages.repeated_passages(tables[1].limit(0), scratch(spark)).collect() == []


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/x"), (1, "http://bad.com/x"), (2, None), (3, "://"), (4, "http://" + "a" * 100_000 + "/p")], "page_id long, url string").selectExpr("*", "'h' AS host", "'v' AS verdict", "1 AS rule", "2 AS canonical", "3 AS block")
    listed = spark.createDataFrame([("bad.com/x",), ("bad.com/x",), (None,)], "canonical string")
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.filter_urls(pages, listed, scratch(spark)).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "allow")]
    assert url_filter.filter_urls(pages.limit(0), listed, scratch(spark)).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0), scratch(spark)).collect()} == {"allow"}


def test_code_lengths_against_plain_ppm(spark):
    """Bits of texts under each language by a recursion over contexts, from the longest to none, with escapes."""
    texts = {"en": "the quick brown fox jumps over the lazy dog and the cat. ÄÖ", "de": "der schnelle braune fuchs springt über den faulen hund und die katze"}
    d = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = language.train(d)
    k = language.CLASSES

    def symbols(text):
        return [0, 0, 0, *(int(language.BYTE_CLASS[b]) for b in text.encode())]

    counts = {}
    for lang, text in texts.items():
        own = counts[lang] = {}
        c = symbols(text)
        for i in range(3, len(c)):
            for order in range(4):
                key = (order, tuple(c[i - order : i]))
                own.setdefault(key, {}).setdefault(c[i], 0)
                own[key][c[i]] += 1

    def bits(own, context, symbol):
        if context is None:
            return math.log2(k)
        seen = own.get((len(context), context), {})
        shorter = context[1:] if context else None
        if symbol in seen:
            return -math.log2(seen[symbol] / (sum(seen.values()) + len(seen)))
        escape = -math.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else 0.0
        return escape + bits(own, shorter, symbol)

    asked = ["the dog and the fox", "hund und katze", "", "xyz 123 über", "a"]
    data, offsets = text_bytes(pa.array(asked))
    got = model.lengths(data, offsets)
    for row, text in zip(got, asked, strict=True):
        c = symbols(text)
        for i, lang in enumerate(model.langs):
            want = sum(bits(counts[lang], tuple(c[j - 3 : j]), c[j]) for j in range(3, len(c)))
            assert row[i] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_bloom_false_positives_are_removed(spark, monkeypatch):
    """With a bit for each URL many unlisted ones pass the filter; the exact join takes all of them out again, and no listed one is lost."""
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 1)
    listed = spark.createDataFrame([(f"site{i}.com/a",) for i in range(2000)], "canonical string")
    pages = spark.createDataFrame([(i, f"http://site{i}.com/a/") for i in range(4000)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, listed, scratch(spark)).collect()}
    assert got == {i: "block" if i < 2000 else "allow" for i in range(4000)}
    n_blocks = 2000 // url_filter.BLOCK_BITS + 1
    asked = spark.createDataFrame([(f"site{i}.com/a", i) for i in range(4000)], "canonical string, i long")
    masks = [m.alias(f"q{k}") for k, m in enumerate(url_filter._masks(F.xxhash64("canonical", F.lit(7))))]
    looked = asked.select("i", F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).alias("block"), *masks).join(url_filter.bloom(listed, n_blocks), "block")
    for k in range(4):
        looked = looked.where(F.col(f"m{k}").bitwiseAND(F.col(f"q{k}")) == F.col(f"q{k}"))
    passed = {r["i"] for r in looked.collect()}
    assert passed >= set(range(2000)) and len(passed) > 2500


def test_secrets_of_one_text_with_many_matches(spark):
    text = " ".join(f"token=abcdefg{i}" for i in range(1500))
    got = secrets.scan_incremental(spark.createDataFrame([(1, text)], "doc_id long, text string"), scratch(spark))[0].first()
    assert len(got["spans"]) == 1500 and [text[s["start"] : s["end"]] for s in got["spans"]] == text.split(" ")
    assert bytes(got["blob"]) == hashlib.sha256(text.encode()).digest()


def test_pipeline_of_nothing(spark, tables):
    docs = tables[1].select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch(spark).save(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.count() == 0


def test_quality_level_is_said(spark, tables):
    """Too few good rows for a level: the output says so, and only the base rule rejects."""
    _, docs, labels, _ = tables
    for r in quality.quality_rules(docs, labels, scratch(spark)).collect():
        assert r["level"] is None and r["kept"] == (not r["base_failed"])


def test_mixing_draws(spark):
    """Expected tokens use up the budget, those of cells below 1 are spread as wanted, and the draw follows them."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(20, 200), rng.choices(["en", "de", "fr"], [8, 1, 1])[0], rng.choices("abc", [6, 3, 1])[0]) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    own = scratch(spark)
    cells = own.save(mixing.cells_of(d), "cells")
    raked = mixing.rake(cells, own)
    assert mixing.residual(raked) <= 2 * mixing.TOLERANCE
    prob = mixing.probabilities(raked, own).collect()
    total = sum(r.mass for r in prob)
    assert sum(r.mass * r.prob for r in prob) == pytest.approx(mixing.BUDGET * total, rel=1e-6)
    below = [r for r in prob if r.prob < 1]
    ratios = [r.mass * r.prob / r.weight for r in below]
    assert below and max(ratios) == pytest.approx(min(ratios), rel=1e-6)  # one scale for all that aren't full
    assert all(r.mass / r.weight <= max(ratios) * (1 + 1e-6) for r in prob if r.prob == 1)
    mixed = mixing.mix(d, scratch(spark)).collect()
    expected, drawn = sum(r.prob * r.n_tokens for r in mixed), sum(r.n_tokens for r in mixed if r.kept)
    assert drawn == pytest.approx(expected, rel=0.05) and len({r.residual for r in mixed}) == 1 and mixed[0].residual == pytest.approx(mixing.residual(raked), abs=1e-9)
    assert mixing.mix(d, scratch(spark)).where("kept").select(F.col("row.doc_id")).exceptAll(spark.createDataFrame([(r.row.doc_id,) for r in mixed if r.kept], "doc_id long")).count() == 0


def test_shards_of_one_hot_text(spark):
    """A third of all rows are one text: split to the quota, counts stay even, every other group whole."""
    texts = ["hot"] * 400 + [f"pair {i // 2}" for i in range(300)] + [f"own {i}" for i in range(500)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch(spark), 8).collect()
    counts = [sum(r.shard == s for r in got) for s in range(8)]
    assert counts == [150] * 8
    of = {}
    for r in got:
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(of["hot"]) <= 4 and sum(len(v) > 1 for k, v in of.items() if k.startswith("pair")) <= 2
