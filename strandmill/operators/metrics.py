"""Retrieval metrics as set operations over results(query_id, accession, score) and truth(query_id, accession)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import ordering
from strandmill.schemas import MISS_SCORE


def judged(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results with rel (0 or 1) and n_rel, queries without a relevant accession left out."""
    rel = truth.select("query_id", "accession").distinct().withColumn("rel", F.lit(1))
    own = results.join(rel, ["query_id", "accession"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return own.withColumn("n_rel", F.sum("rel").over(Window.partitionBy("query_id"))).where("n_rel > 0")


def ranked(judgements: DataFrame) -> DataFrame:
    """With rn from 1: score descending, then accession."""
    return judgements.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "accession")))


def recall_at(judgements: DataFrame, k: int) -> DataFrame:
    """Share of relevant accessions among the first k; misses never count."""
    hit = F.when((F.col("rn") <= k) & (F.col("score") > MISS_SCORE), F.col("rel")).otherwise(0)
    return ranked(judgements).groupBy("query_id").agg((F.sum(hit) / F.max("n_rel")).alias("recall"))


def r_precision(judgements: DataFrame) -> DataFrame:
    hit = F.when((F.col("rn") <= F.col("n_rel")) & (F.col("score") > MISS_SCORE), F.col("rel")).otherwise(0)
    return ranked(judgements).groupBy("query_id").agg((F.sum(hit) / F.max("n_rel")).alias("r_precision"))


def average_precision(judgements: DataFrame) -> DataFrame:
    """Each distinct score is one threshold; misses are the last, all tied."""
    steps = judgements.groupBy("query_id", "score").agg(F.count("*").alias("n"), F.sum("rel").alias("r"))
    upto = Window.partitionBy("query_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumns({"cn": F.sum("n").over(upto), "cr": F.sum("r").over(upto)})
    return curve.groupBy("query_id").agg((F.sum(F.col("r").cast("double") * F.col("cr") / F.col("cn")) / F.sum("r")).alias("ap"))


def recall_curve(judgements: DataFrame, depth: int) -> DataFrame:
    """(k, recall): mean recall over queries at every k up to depth."""
    own = ranked(judgements).where(F.col("rn") <= depth)
    hit = F.when(F.col("score") > MISS_SCORE, F.col("rel")).otherwise(0)
    run = own.withColumn("recall", F.sum(hit).over(Window.partitionBy("query_id").orderBy("rn")) / F.col("n_rel"))
    return run.groupBy(F.col("rn").alias("k")).agg(F.avg("recall").alias("recall"))


def per_query(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Best score, best relevant score, returned accessions, and the margin of best relevant over best irrelevant."""
    rel = truth.select("query_id", "accession").distinct().withColumn("rel", F.lit(True))
    own = results.join(rel, ["query_id", "accession"], "left")
    hit = F.col("score") > MISS_SCORE
    best = lambda c: F.max(F.when(c, F.col("score")))
    out = own.groupBy("query_id").agg(best(hit).alias("best"), best(hit & F.col("rel").isNotNull()).alias("best_relevant"), best(hit & F.col("rel").isNull()).alias("best_irrelevant"), F.sum(hit.cast("long")).alias("n_returned"))
    return out.withColumn("margin", F.col("best_relevant") - F.col("best_irrelevant"))


#: Shares of Poisson(1) draws up to 0, 1, 2 ..; fixed values.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def bootstrap_margins(values: DataFrame, by: list[str], key: str, column: str, samples: int = 1000, seed: int = 0) -> DataFrame:
    """(by, n, mean, margin): the mean and 1.96 deviations of resampled means, nulls left out.

    A row takes part in a sample as often as a Poisson draw says, from a hash of its key
    and the sample's number, so samples are added up where the rows are. A sample that drew no row is left out.
    """
    own = values.where(F.col(column).isNotNull()).select(*by, key, F.col(column).cast("double").alias("_v"))
    drawn = own.withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_s").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
    times = sum(((u > p).cast("int") for p in POISSON), F.lit(0))
    means = drawn.withColumn("_w", times).groupBy(*by, "_s").agg(F.sum("_w").alias("_n"), (F.sum(F.col("_w") * F.col("_v")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    spread = means.groupBy(*by).agg((1.96 * F.stddev_pop("_m")).alias("margin"))
    plain = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    if not by:
        return plain.crossJoin(spread)  # one row each
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    return plain.alias("x").join(spread.alias("y"), on).select(*[F.col(f"x.{c}") for c in plain.columns], "margin")


def wide_margins(margins: DataFrame, row: str, column: str, labels: list[str], digits: int = 3) -> DataFrame:
    """A row for each value of ``row`` and a column for each label of ``column``: the mean and its margin as text, null where there is none."""
    text = F.format_string(f"%.{digits}f±%.{digits}f", "mean", "margin")
    return margins.groupBy(row).agg(*[F.max(F.when(F.col(column) == c, text)).alias(c) for c in labels])


def paired_deltas(one: DataFrame, base: DataFrame, column: str) -> DataFrame:
    """(query_id, delta) over the queries both have; ``bootstrap_margins`` gives its margin."""
    return one.select("query_id", F.col(column).alias("_one")).join(base.select("query_id", F.col(column).alias("_base")), "query_id").select("query_id", (F.col("_one") - F.col("_base")).alias("delta"))


def binned_report(values: DataFrame, bins: DataFrame, column: str) -> DataFrame:
    """(bin, n_queries, n_scored, mean) for each bin of bins(query_id, bin) and for "all". A scored query without a bin raises."""
    own = values.select("query_id", F.col(column).alias("_v"), F.lit(True).alias("scored")).join(bins.select("query_id", "bin"), "query_id", "full")
    own = own.withColumn("ok", F.assert_true(F.col("bin").isNotNull(), F.lit("a scored query has no bin"))).where(F.col("ok").isNull())
    both = own.withColumn("bin", F.explode(F.array("bin", F.lit("all"))))
    return both.groupBy("bin").agg(F.count("*").alias("n_queries"), F.count("scored").alias("n_scored"), F.avg("_v").alias("mean"))


def spearman(df: DataFrame, x: str, y: str, save) -> DataFrame:
    """(rho): rank correlation with average ranks of ties. Ranks come from sorted ranges; ``save`` writes a table and reads it back."""
    own = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null")
    ranked_ = own.join(ordering.average_ranks(own, "_x", "rx", save), "_x").join(ordering.average_ranks(own, "_y", "ry", save), "_y")
    return ranked_.agg(F.corr("rx", "ry").alias("rho"))
