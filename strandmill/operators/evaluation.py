"""Reports over several runs: cutoffs at false-positive rates, margins, outcomes, timings, identity bins.

Results are long, (query_id, accession, score), with misses at MISS_SCORE. ``by`` names
the columns that tell runs apart, such as model and rate; there are few of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.sequences import bin_label
from strandmill.functions.tables import cut
from strandmill.operators import metrics, ordering
from strandmill.schemas import MISS_SCORE
from strandmill.sources import store


def _next_up(c: Column) -> Column:
    return F.java_method(F.lit("java.lang.Math"), F.lit("nextUp"), c).cast("double")


def _cutoff(score: Column, passing: Column) -> Column:
    """Just above the best negative where none may pass, any hit where that is the rank's score."""
    return F.when(passing == 0, _next_up(score)).when(score <= MISS_SCORE, _next_up(F.lit(MISS_SCORE))).otherwise(score)


def _counts(negatives: DataFrame, rates: list[float], by: list[str]):
    n = negatives.groupBy(*by).agg(F.count("*").alias("n"))
    return [(tuple(r[c] for c in by), fpr, r["n"], int(np.floor(fpr * r["n"]))) for r in n.collect() for fpr in rates]  # a row for each run


def _scores_at(negatives: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """wanted(by, at, ..), a row for each run and rank asked for, with the score of rank ``at``, the best being 1. Scores are counted in sorted ranges."""
    counts = negatives.groupBy(*by, "score").agg(F.count("*").alias("_n"))
    placed = ordering.running(counts, [*[F.col(c) for c in by], F.desc("score")], F.col("_n"), "_before", store.scratch(negatives.sparkSession, "cutoffs"))
    starts = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_before").alias("_start"))
    asked = wanted.join(starts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).withColumn("_at", F.col("_start") + F.col("at"))
    inside = (F.col("_at") > F.col("x._before")) & (F.col("_at") <= F.col("x._before") + F.col("x._n"))
    on = inside
    for c in by:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y._{c}"))
    return placed.alias("x").join(F.broadcast(asked).alias("y"), on).select(*[F.col(f"y.{c}").alias(c) for c in wanted.columns], "x.score")


def cutoffs(negatives: DataFrame, rates: list[float], by: list[str]) -> DataFrame:
    """(by, fpr, n_negatives, cutoff, realized, no_hit_fraction) of negatives(by, score), for all runs and rates at once.

    At most floor(fpr * n) negatives score the cutoff or more, unless scores tie there. A run without negatives has no row.
    """
    asked = _counts(negatives, rates, by)
    schema = f"{negatives.select(*by).schema.simpleString()[7:-1]}, fpr double, n_negatives long, passing long, at int"
    wanted = negatives.sparkSession.createDataFrame([(*g, f, n, m, max(1, m)) for g, f, n, m in asked], schema)
    at = _scores_at(negatives, wanted, by)
    at = at.select(*by, "fpr", "n_negatives", _cutoff(F.col("score"), F.col("passing")).alias("cutoff"))
    share = lambda c: F.avg(c.cast("int"))
    return negatives.join(F.broadcast(at), by).groupBy(*by, "fpr", "n_negatives", "cutoff").agg(share(F.col("score") >= F.col("cutoff")).alias("realized"), share(F.col("score") <= MISS_SCORE).alias("no_hit_fraction"))  # a row for each run and rate


def cutoff_intervals(negatives: DataFrame, rates: list[float], by: list[str], samples: int = 1000, seed: int = 0) -> DataFrame:
    """(by, fpr, ci_low, ci_high): 95 % of the cutoffs of resampled negatives.

    The m-th best of n rows drawn with replacement has a rank in the original order
    of ceil(n * u), u from Beta(m, n + 1 - m). So only ranks are resampled, and the
    negatives stay where they are.
    """
    rng = np.random.default_rng(seed)
    asked = []
    for group, fpr, n, m in sorted(_counts(negatives, rates, by), key=repr):
        ranks = np.ceil(n * rng.beta(max(1, m), n + 1 - max(1, m), samples)).clip(1, n)
        high, low = np.percentile(ranks, [2.5, 97.5], method="nearest").astype(int).tolist()
        asked += [(*group, fpr, m, low, "ci_low"), (*group, fpr, m, high, "ci_high")]
    schema = f"{negatives.select(*by).schema.simpleString()[7:-1]}, fpr double, passing long, at int, side string"
    wanted = negatives.sparkSession.createDataFrame(asked, schema)
    at = _scores_at(negatives, wanted, by)
    at = at.select(*by, "fpr", "side", _cutoff(F.col("score"), F.col("passing")).alias("cutoff"))
    return at.groupBy(*by, "fpr").agg(*[F.max(F.when(F.col("side") == s, F.col("cutoff"))).alias(s) for s in ("ci_low", "ci_high")])


def true_positive_rates(positives: DataFrame, cuts: DataFrame, fixed_rate: float) -> DataFrame:
    """(model, rate, fpr, n_positives, cutoff_fixed, tpr_fixed, cutoff_matched, tpr_matched).

    Of positives(model, rate, best_relevant) at the cutoffs cuts(model, rate, fpr, cutoff)
    of ``fixed_rate`` and of their own rate; null where there is no such cutoff. A
    positive that retrieved nothing relevant, or null, passes no cutoff.
    """
    levels = cuts.select("fpr").distinct()
    runs = positives.groupBy("model", "rate").agg(F.count("*").alias("n_positives")).crossJoin(F.broadcast(levels))  # runs by rates
    fixed = cuts.where(F.col("rate") == fixed_rate).select("model", "fpr", F.col("cutoff").alias("cutoff_fixed"))
    matched = cuts.select("model", "rate", "fpr", F.col("cutoff").alias("cutoff_matched"))
    runs = runs.join(fixed, ["model", "fpr"], "left").join(matched, ["model", "rate", "fpr"], "left")
    share = lambda c: F.when(F.col(c).isNotNull(), F.avg(F.coalesce(F.col("best_relevant") >= F.col(c), F.lit(False)).cast("int")))
    keys = ["model", "rate", "fpr", "n_positives", "cutoff_fixed", "cutoff_matched"]
    return positives.join(F.broadcast(runs), ["model", "rate"]).groupBy(*keys).agg(share("cutoff_fixed").alias("tpr_fixed"), share("cutoff_matched").alias("tpr_matched"))


def accession_recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): share of the relevant accessions that were reached, of queries in the results."""
    reached = results.where(F.col("score") > MISS_SCORE).select("query_id", "accession", F.lit(1).alias("hit")).distinct()
    asked = truth.select("query_id", "accession").distinct().join(results.select("query_id").distinct(), "query_id", "left_semi")
    return asked.join(reached, ["query_id", "accession"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def oracle_results(alignments: DataFrame) -> DataFrame:
    """Results as a perfect search would give them: the best identity of each query and accession."""
    return alignments.groupBy("query_id", "accession").agg(F.max("identity").alias("score"))


def systems_table(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean index size and time of runs(by, index_size_gb, avg_time)."""
    return runs.groupBy(*by).agg(F.avg("index_size_gb").alias("index_size_gb"), F.avg("avg_time").alias("avg_time"))


def recall_by_time(per_query: DataFrame, timings: DataFrame, by: list[str], rate: float) -> DataFrame:
    """(by, recall, avg_time): mean of per_query(by, rate, r_precision) at ``rate``, with the mean time above 0 at rate 0.

    Parameters that a method lacks are null in ``by`` and match each other; a method without a time has no row.
    """
    recall = per_query.where(F.col("rate") == rate).groupBy(*by).agg(F.avg("r_precision").alias("recall"))
    times = timings.where("rate = 0 and avg_time > 0").groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.avg("avg_time").alias("avg_time"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return recall.join(times, same).select(*by, "recall", "avg_time")


def margin_summary(per_query: DataFrame, by: list[str], save) -> DataFrame:
    """Quantiles of the best irrelevant and best relevant scores and their margin, and how often the relevant one wins.

    A query without one of them takes no part in its quantiles and doesn't win. Quantiles are
    exact; a run's scores are counted in ranges. ``save`` writes a table and reads it back.
    """
    wins = F.coalesce(F.col("best_relevant") > F.col("best_irrelevant"), F.lit(False)).cast("int")
    out = per_query.groupBy(*by).agg(F.avg(wins).alias("true_wins"))
    asked = {"best_irrelevant": {0.5: "floor_med", 0.9: "floor_p90"}, "best_relevant": {0.5: "true_med"}, "margin": {0.5: "margin_med"}}
    for column, shares in asked.items():
        part = ordering.percentiles(per_query.select(*by, column), by, column, list(shares), lambda df, name, c=column: save(df, f"{name}{c}"))
        wide = part.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.max(F.when(F.col("share") == p, F.col(column))).alias(name) for p, name in shares.items()])
        out = out.join(wide, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])
    return out.select(*by, "floor_med", "floor_p90", "true_med", "margin_med", "true_wins")


def validation(results: DataFrame, truth: DataFrame, rates: DataFrame, k: int = 10) -> DataFrame:
    """(rate, n_queries, recall): mean recall among the first k for each rate of rates(query_id, rate)."""
    each = metrics.recall_at(metrics.judged(results, truth), k).join(rates.select("query_id", "rate"), "query_id")
    return each.groupBy("rate").agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"))


def rank_substituted(results: DataFrame, ranks: DataFrame) -> DataFrame:
    """results in another run's order: the accession at each of a query's places of ranks(query_id, accession, rank) gets the score held at that place.

    Scores stay as they are spread; only who has them changes. Accessions that the other run doesn't place follow in their own order.
    """
    own = results.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "accession")))
    placed = results.select("query_id", "accession").join(ranks.select("query_id", "accession", F.col("rank").alias("_r")), ["query_id", "accession"], "left").join(own.select("query_id", "accession", F.col("_at").alias("_own")), ["query_id", "accession"])
    to = placed.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_r"), "_own"))).select("query_id", "_at", "accession")
    return to.join(own.select("query_id", "_at", "score"), ["query_id", "_at"]).drop("_at")


def ratio_table(windows: DataFrame, edges: list[float], labels: list[str]) -> DataFrame:
    """(ratio, n, mean_score, above_floor) of windows(ratio, score, floor) by ranges of their ratio, closed above: how often the score beats the best irrelevant one."""
    own = windows.groupBy(cut(F.col("ratio"), edges, labels).alias("ratio"))
    return own.agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg((F.col("score") > F.col("floor")).cast("int")).alias("above_floor"))


def first_relevant(judgements: DataFrame) -> DataFrame:
    """(query_id, first_rank): rank of the first relevant accession that was reached, null if none was."""
    reached = (F.col("rel") == 1) & (F.col("score") > MISS_SCORE)
    return metrics.ranked(judgements).groupBy("query_id").agg(F.min(F.when(reached, F.col("rn"))).alias("first_rank"))


def outcomes(one: DataFrame, base: DataFrame, column: str, least: float) -> DataFrame:
    """(outcome, n) over the queries of both: which fail, with ``column`` below ``least``, in one run or the other."""
    fails = lambda df, name: df.select("query_id", (F.col(column) < least).alias(name))
    both = fails(one, "now").join(fails(base, "before"), "query_id")
    name = F.when(F.col("now") & F.col("before"), "fails twice").when(F.col("before"), "mended").when(F.col("now"), "broken").otherwise("holds")
    return both.groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))


def hits_accuracy(judgements: DataFrame) -> DataFrame:
    """One row: mean average precision, R-precision and recall among the first 7."""
    each = metrics.average_precision(judgements).join(metrics.r_precision(judgements), "query_id").join(metrics.recall_at(judgements, 7), "query_id")
    return each.agg(F.avg("ap").alias("auprc"), F.avg("r_precision").alias("rprec"), F.avg("recall").alias("recall7"))


def substituted(results: DataFrame, better: DataFrame) -> DataFrame:
    """results with the scores of better(query_id, accession, score) where it has one: the ceiling a substitute could reach."""
    other = better.groupBy("query_id", "accession").agg(F.max("score").alias("_score"))
    return results.join(other, ["query_id", "accession"], "left").withColumn("score", F.coalesce("_score", "score")).drop("_score")


def set_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """(query_id, overlap): shared vectors by the smaller set's size, of queries with hits in both."""
    n = lambda df, name: df.groupBy("query_id").agg(F.countDistinct("vector_id").alias(name))
    ids = lambda df: df.select("query_id", "vector_id").distinct()
    both = ids(one).join(ids(two), ["query_id", "vector_id"]).groupBy("query_id").agg(F.count("*").alias("both"))
    sizes = n(one, "n_one").join(n(two, "n_two"), "query_id").join(both, "query_id", "left")
    return sizes.select("query_id", (F.coalesce("both", F.lit(0)) / F.least("n_one", "n_two")).alias("overlap"))


def top_k_accuracy(outputs: DataFrame, ks: list[int]) -> DataFrame:
    """One row, top_k in percent for each k, of outputs(output array, target). Of equal outputs the earlier ranks first."""
    own = F.col("output")[F.col("target")]
    ahead = F.size(F.filter("output", lambda x, i: (x > own) | ((x == own) & (i < F.col("target")))))
    return outputs.select(ahead.alias("ahead")).agg(*[F.round(100 * F.avg((F.col("ahead") < k).cast("int")), 6).alias(f"top_{k}") for k in ks])


def identity_bins(queries: DataFrame, alignments: DataFrame, edges: tuple[float, ...] = (0.90, 0.95, 0.99)) -> DataFrame:
    """queries(query_id) with their best alignment and its bin.

    Best: identity, then matches, then primary, then the smallest accession. Bins are
    closed below; a query without an alignment is "unaligned".
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("identity"), F.desc("matches"), F.desc("is_primary"), "accession")
    best = alignments.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return queries.select("query_id").join(best, "query_id", "left").withColumn("bin", bin_label(F.col("identity"), edges))


def bin_table(bins: DataFrame, row: str, labels: list[str]) -> DataFrame:
    """A row for each value of ``row``, a column for each label, with the number of queries."""
    return bins.groupBy(row).agg(*[F.count_if(F.col("bin") == label).alias(label) for label in labels])
