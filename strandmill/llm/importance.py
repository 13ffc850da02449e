"""Importance resampling towards a target corpus: hashed n-gram weights and a Gumbel top draw.

Every document becomes one array of feature buckets, made by higher-order functions. The
counts of a corpus are totals for each bucket, added up in the map tasks, so at most
``BUCKETS`` rows leave a task. The gains of all buckets travel as one literal array, and a
document's weight is an aggregate over its own array; nothing is exploded for it and no
text is shuffled. Texts are read twice, once for the totals and once for the weights, so
no table of buckets, larger than the texts, is written.

The draw takes the highest of weight plus Gumbel noise from a hash of the id. A histogram
of 4,096 equal score ranges tells which rows can be drawn; only those are sorted, in
range partitions whose sizes give the ranks.

Defined results: null, empty and wordless texts have no features and weight 0. Repeated
rows are documents of their own, with equal scores and ranks next to each other. Rows
with a null doc_id get a weight but no score, aren't counted among the documents to
draw from and are never drawn. An empty target or an empty corpus gives gains by the
same formula. Extra columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, table
from strandmill.llm.decontamination import with_words

BUCKETS = 10_000
LEAST_WORDS, PERCENT = 20, 5
#: Score ranges that the draw counts before it sorts.
RANGES = 4096


def with_buckets(df: DataFrame, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """(keep, n_words, buckets): a bucket for each run of 1 to 3 consecutive words, repeats included."""
    n = F.size("words")
    shorter = lambda by: F.greatest(n - by, F.lit(0))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    pairs = F.zip_with(F.slice("words", F.lit(1), shorter(1)), F.slice("words", F.lit(2), shorter(1)), joined)
    triples = F.zip_with(F.slice("pairs", F.lit(1), shorter(2)), F.slice("words", F.lit(3), shorter(2)), joined)
    bucket = lambda a: F.transform(a, lambda f: (F.crc32(f) % buckets).cast("int"))
    made = with_words(df, *keep).withColumn("pairs", pairs)
    return made.select(*keep, n.cast("long").alias("n_words"), F.concat(bucket("words"), bucket("pairs"), bucket(triples)).alias("buckets"))


def bucket_totals(df: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket; the driver gets one row for each bucket."""
    out = [0] * buckets
    each = with_buckets(df, buckets=buckets).select(F.explode_outer("buckets").alias("b"))  # for explode Spark would add a filter that makes the arrays once more
    for r in each.groupBy("b").agg(F.count("*").alias("n")).collect():
        if r["b"] is not None:
            out[r["b"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of smoothed frequencies, rounded down."""
    buckets, s_all, t_all = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log(((t + 1.0) * (s_all + buckets)) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(corpus, target, strict=True)]


def weight_of(buckets: str, gain: list[int]) -> Column:
    """Sum of the gains of an array's buckets; the gains become one folded literal."""
    all_gains = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(all_gains, b + 1))


def noise_of(key: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise from a hash of the key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs."""
    gain = gains(bucket_totals(docs), bucket_totals(target))
    out = with_buckets(docs, "doc_id").select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight_of("buckets", gain).alias("weight"))
    return out.withColumn("score", F.col("weight") + noise_of(F.col("doc_id"), seed))


def drawn(scores: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores, a saved table, with ``rank``: 1 for the highest score, null for what isn't drawn."""
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    low, high, n = scores.where(may).agg(F.min("score"), F.max("score"), F.count("*")).first()
    wanted = n * percent // 100
    if not wanted:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    at = F.floor((F.col("score") - low) / F.lit(float(high - low + 1)) * RANGES)
    left, least = wanted, RANGES
    for r in sorted(scores.where(may).groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["at"]):  # RANGES rows
        least, left = r["at"], left - r["n"]
        if left <= 0:
            break
    head = may & (at >= least)
    parts = max(2, scores.sparkSession.sparkContext.defaultParallelism)
    sorted_head = scores.where(head).repartitionByRange(parts, F.desc("score"), "doc_id").withColumn("_part", F.spark_partition_id())
    sorted_head = scratch.save(sorted_head, "head")
    before, offsets = 0, []
    for r in sorted_head.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each range partition
        offsets += [F.lit(r["_part"]), F.lit(before)]
        before += r["n"]
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("score"), "doc_id")) + F.create_map(*offsets)[F.col("_part")]
    ranked = sorted_head.withColumn("rank", rank.cast("long")).drop("_part")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scores.where(~F.coalesce(head, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "importance")
    scores = scratch.save(scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "scores")
    return drawn(scores, scratch).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its linearity: the code of n bytes is that of n zero bytes, combined by xor with one entry for each byte and its place from the end.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
f AS (SELECT r, array_to_string(words[i : i + n - 1], ' ') AS f FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(words) >= n)),
g AS (SELECT array_to_string(words[i : i + n - 1], ' ') AS f FROM (SELECT words, n, unnest(range(1, len(words) - n + 2)) AS i FROM b, (SELECT unnest([1, 2, 3]) AS n) WHERE len(words) >= n)),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
t1 AS (SELECT 0 AS k, CAST(v AS BIGINT) AS v, CAST(v AS BIGINT) AS c FROM (SELECT unnest(range(256)) AS v) UNION ALL SELECT k + 1, v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t1 WHERE k < 8),
t0 AS (SELECT v, c FROM t1 WHERE k = 8),
tab AS (SELECT list(c ORDER BY v) AS tab FROM t0),
p AS (SELECT CAST(0 AS BIGINT) AS k, v, c FROM t0 UNION ALL SELECT k + 1, v, xor(tab[(c & 255) + 1], c >> 8) FROM p, tab WHERE k + 1 < (SELECT max(len(x)) // 2 FROM u)),
z AS (SELECT CAST(0 AS BIGINT) AS n, 4294967295 AS c UNION ALL SELECT n + 1, xor(tab[(c & 255) + 1], c >> 8) FROM z, tab WHERE n < (SELECT max(len(x)) // 2 FROM u)),
y AS (SELECT f, len(x) // 2 AS n, i, CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT) AS v FROM (SELECT f, x, unnest(range(len(x) // 2)) AS i FROM u)),
e AS (SELECT f, any_value(n) AS n, bit_xor(c) AS c FROM y JOIN p ON p.k = n - 1 - i AND p.v = y.v GROUP BY f),
k AS (SELECT f, xor(xor(e.c, z.c), 4294967295) % 10000 AS bucket FROM e JOIN z ON z.n = e.n),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (f) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM g) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
d AS (SELECT r, count(*) AS n_features, sum(gain) AS weight FROM f JOIN k USING (f) JOIN gain USING (bucket) GROUP BY 1),
o AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN d USING (r)),
m AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS rn FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND rn <= (SELECT count(*) FROM o WHERE n_words >= 20) * 5 // 100 THEN rn END AS rank FROM m
"""
