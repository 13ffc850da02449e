"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every run of ``WINDOW - GRAM + 1`` consecutive word k-grams the smallest hash is kept
as a fingerprint, for documents and benchmark items alike. Two texts that share 13
consecutive words share such a run, hence a fingerprint, so the join of fingerprints
misses no window. The documents it finds are read again and their hits extended:
every 13-word run of theirs is compared as text with the items' windows, which
leaves no false hit. Items of fewer than 13 words are one window each and are
looked up by their first-k-gram at their own length.

The fingerprints of the benchmark and the ids of found documents are broadcast only
after a count; beyond the bound the joins shuffle.

Defined results: null, empty and wordless texts have no words and no hits; items
without words never occur. Repeated items count once for each item_id, repeated
document rows give equal rows each. Rows with a null doc_id are returned with their
word counts and no hits found. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, sized, table

WINDOW, GRAM = 13, 7
#: What stands between words, after and before lower-casing. Splitting is linear, whereas each match of
#: regexp_extract_all and regexp_count copies the text in current Java versions.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text):
    """A-Z lower-cased and nothing else; the slow way only for texts with other capitals."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def with_words(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), BREAK), "").alias("words"))


def _grams(hashes, size: int, least: int):
    """Hashes of every ``size`` consecutive entries, none when there are fewer than ``least``."""
    n = F.size(hashes)
    return F.when(n >= least, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, fp): the winnowed k-gram hashes of texts of at least WINDOW words."""
    hashed = with_words(df, *keep).select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))  # no filter here: it would be pushed below and split the text again
    grams = hashed.select(*keep, _grams(F.col("h"), GRAM, WINDOW).alias("g"))
    run = WINDOW - GRAM + 1
    least = F.when(F.size("g") >= run, F.transform(F.sequence(F.lit(1), F.size("g") - run + 1), lambda i: F.array_min(F.slice("g", i, F.lit(run)))))
    return grams.select(*keep, F.explode(F.array_distinct(least)).alias("fp"))


def _runs(n: int):
    """Every n consecutive words as text."""
    return F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, F.lit(n)), " "))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, window): the windows of every item as text, of n words each."""
    w = with_words(items.where("item_id is not null"), "item_id").where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    texts = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    return w.select("item_id", n.alias("n"), F.explode(F.array_distinct(texts)).alias("window")).distinct()


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_hit, n_items, items_sha256 of the documents with a hit."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    windows = scratch.save(item_windows(items), "windows")
    marks = sized(scratch.save(fingerprints(items, "item_id").select("fp").distinct(), "fingerprints"))
    found = fingerprints(docs, "doc_id").join(marks, "fp", "left_semi").select("doc_id")
    short = [r["n"] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # 1 to 12
    if short:
        hashed = with_words(docs, "doc_id").select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
        looked = hashed.select("doc_id", F.explode(F.array_distinct(F.concat(*[_grams(F.col("h"), n, n) for n in sorted(short)]))).alias("fp"))
        own = windows.where(F.col("n") < WINDOW).select(F.xxhash64(F.transform(F.split("window", " "), lambda w: F.xxhash64(w))).alias("fp")).distinct()
        found = found.unionByName(looked.join(sized(own), "fp", "left_semi").select("doc_id"))
    found = scratch.save(found.distinct(), "found")
    lengths = sorted({*short, WINDOW})
    again = with_words(docs.join(sized(found, 2_000_000), "doc_id", "left_semi"), "doc_id")
    runs = None
    for n in lengths:
        part = again.select("doc_id", F.posexplode(F.when(F.size("words") >= n, _runs(n))).alias("at", "window")).withColumn("n", F.lit(n))
        runs = part if runs is None else runs.unionByName(part)
    hits = scratch.save(runs.join(sized(windows), ["n", "window"]).select("doc_id", "at", "n", "item_id"), "hits")
    by_place = hits.groupBy("doc_id", "at").agg(F.max("n").alias("n"))
    covered = by_place.select("doc_id", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    listed = hits.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return scratch.save(covered.join(listed, "doc_id"), "contamination")


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hits = sized(contamination(docs, items, scratch))
    counted = docs.select("doc_id", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAK_ANY_CASE), "")).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = counted.join(hits, "doc_id", "left").select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    gone = scratch.save(decontaminate(docs, items, scratch).where("contaminated and doc_id is not null").select("doc_id").distinct(), "gone")
    return docs.join(sized(gone, 2_000_000), "doc_id", "left_anti").select(docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[i : i + least(len(words), 13) - 1], ' ') AS win
       FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i FROM b WHERE len(words) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, ns WHERE len(words) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""
