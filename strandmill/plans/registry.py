"""Queries over the driver's tables, and their SQL. Accessions are labels, queries are the vectors whose id is divisible by 20."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import composition
from strandmill.functions import sequences as sq
from strandmill.functions import tables
from strandmill.functions import vectors as fv
from strandmill.operators import alignment_search, engines, evaluation, hits, inverted_file, kmer_search, metrics, ordering, probing, search, survival, training_data
from strandmill.sources import catalog, store

K = 10
#: Cells of an inverted file, and the reach of a net's centres, for vectors as spread as these.
CELLS, EPSILON = 128, 0.75


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), F.concat(F.lit("acc"), "label").alias("accession"), "embedding")


def query_vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "embedding", "label")


def accessions(spark, sf) -> DataFrame:
    return vectors(spark, sf).select("accession").distinct()


def truth(spark, sf) -> DataFrame:
    return query_vectors(spark, sf).select("query_id", F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10)).alias("l")).select("query_id", F.concat(F.lit("acc"), "l").alias("accession"))


def found(spark, sf, k: int = K) -> DataFrame:
    return search.exact(query_vectors(spark, sf), vectors(spark, sf), k)


def results(spark, sf) -> DataFrame:
    return hits.regroup(found(spark, sf), query_vectors(spark, sf), accessions(spark, sf), K)


def flagship(spark, sf) -> DataFrame:
    return rounded(metrics.r_precision(metrics.judged(results(spark, sf), truth(spark, sf))), "r_precision")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def contigs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("contig"), F.col("source").alias("accession"), F.coalesce("text", F.lit("")).alias("sequence"))


_V = "v AS (SELECT vec_id AS vector_id, 'acc' || label AS accession, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT 'q' || vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 20 = 0)"
_HITS = f"{_V}, s AS (SELECT query_id, accession, list_inner_product(q.e, v.e) AS score, vector_id FROM q, v), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM s QUALIFY rank <= {K})"
_RESULTS = f"{_HITS}, b AS (SELECT query_id, accession, max(score) AS score FROM h GROUP BY ALL), r AS (SELECT q.query_id, a.accession, coalesce(b.score, -2.0) AS score FROM q CROSS JOIN (SELECT DISTINCT accession FROM v) a LEFT JOIN b ON b.query_id = q.query_id AND b.accession = a.accession)"
_JUDGED = f"{_RESULTS}, t AS (SELECT query_id, 'acc' || unnest([label, (label + 1) % 10]) AS accession FROM q), j0 AS (SELECT r.*, CASE WHEN t.accession IS NULL THEN 0 ELSE 1 END AS rel FROM r LEFT JOIN t USING (query_id, accession)), j AS (SELECT *, sum(rel) OVER (PARTITION BY query_id) AS n_rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, accession) AS rn FROM j0 QUALIFY n_rel > 0)"


def judged(spark, sf) -> DataFrame:
    return metrics.judged(results(spark, sf), truth(spark, sf))


def _strands(spark, sf) -> DataFrame:
    """Two chunks of two strands: the vector and its reverse."""
    q = query_vectors(spark, sf)
    both = q.select("query_id", F.lit("+").alias("strand"), "embedding").unionByName(q.select("query_id", F.lit("-").alias("strand"), F.reverse("embedding").alias("embedding")))
    return both.select("query_id", "strand", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"), "embedding")


def search_strands(spark, sf) -> DataFrame:
    q = query_vectors(spark, sf)
    both = q.select("query_id", "embedding").unionByName(q.select(F.concat("query_id", F.lit("-")).alias("query_id"), F.reverse("embedding").alias("embedding")))
    flat = search.exact(both, vectors(spark, sf), K).select(F.regexp_replace("query_id", "-$", "").alias("query_id"), "accession", "score", "vector_id")
    return rounded(hits.build_hits(flat, K).select("query_id", "rank", "accession", "score", "vector_id"), "score")


def masked_cutoffs(spark, sf) -> DataFrame:
    """Top-k for several filters in one pass over the pairs."""
    lengths = vectors(spark, sf).withColumn("length", F.col("vector_id") % 300)
    best = search.masked_top_k(query_vectors(spark, sf), lengths, 5, (0, 64, 128, 256))
    return rounded(best.select("query_id", "cutoff", "rank", "vector_id", "score"), "score")


def nested_hits(spark, sf) -> DataFrame:
    n = hits.nest(hits.build_hits(found(spark, sf), K), query_vectors(spark, sf))
    return n.select("query_id", F.size("hits").alias("n"), F.element_at("hits", 1)["vector_id"].alias("first_vector"), F.array_join(F.transform("hits", lambda x: x["vector_id"].cast("string")), ",").alias("ids"))


def participation_ratio(spark, sf) -> DataFrame:
    """(trace C)^2 / sum of squares of the covariance, from partial moments."""
    n, total, second = search.moments(vectors(spark, sf))
    mean = total / n
    cov = second / n - mean[:, None] * mean[None, :]
    return rounded(spark.createDataFrame([(float(cov.trace() ** 2 / (cov * cov).sum()), float(cov.trace()))], "participation_ratio double, trace double"), "participation_ratio", "trace")


#: Window starts of a piece of text; a place in a string costs its distance from the start, so windows are cut from pieces.
STARTS = 40


def chunk_windows(spark, sf) -> DataFrame:
    return windows_of(contigs(spark, sf)).select("contig", "accession", "no", "start", F.length("window").alias("length"), F.md5(F.col("window").cast("binary")).alias("digest"))


def windows_of(c: DataFrame) -> DataFrame:
    """(contig, accession, no, start, window): windows of 256 that overlap by 150, and an end window for a tail over 50."""
    starts, stretch = sq.window_starts(F.length("sequence"), 256, 106, 50), 106 * STARTS
    last = F.element_at(starts, -1)
    pieces = c.select("contig", "accession", F.length("sequence").alias("n"), F.explode(F.sequence(F.lit(0), F.floor(last / stretch).cast("int"))).alias("p"), "sequence")
    pieces = pieces.select("contig", "accession", "n", "p", F.substring("sequence", F.col("p") * stretch + 1, F.lit(stretch + 256)).alias("piece"))
    # the strided starts of a piece, and the end window's start where it falls in it
    full = F.floor((F.col("n") - 256) / 106).cast("int")
    low, high = F.col("p") * STARTS, F.least((F.col("p") + 1) * STARTS - 1, full)
    strided = F.when(F.col("n") <= 256, F.array(F.struct(F.lit(0).alias("no"), F.lit(0).alias("start")))).when(low <= high, F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("no"), (i * 106).alias("start")))).otherwise(F.array().cast("array<struct<no:int,start:int>>"))
    tail = (F.col("n") > 256) & ((F.col("n") - 256) % 106 > 50) & (F.floor((F.col("n") - 256) / stretch) == F.col("p"))
    both = F.when(tail, F.concat(strided, F.array(F.struct((full + 1).alias("no"), (F.col("n") - 256).alias("start"))))).otherwise(strided)
    each = pieces.select("contig", "accession", "p", "piece", F.inline(both))
    return each.select("contig", "accession", "no", "start", F.substring("piece", F.col("start") - F.col("p") * stretch + 1, F.lit(256)).alias("window"))


def window_counts(spark, sf) -> DataFrame:
    n = sq.n_windows(F.length("sequence"), 256, 106, 50, 45)
    return contigs(spark, sf).groupBy("accession").agg(F.sum(n).alias("num_rows"))


def row_ranges(spark, sf) -> DataFrame:
    """meta: start_row by exclusive prefix sum over accessions."""
    before = Window.orderBy("accession").rowsBetween(Window.unboundedPreceding, -1)
    return window_counts(spark, sf).withColumn("start_row", F.coalesce(F.sum("num_rows").over(before), F.lit(0)))


def resolve_rows(spark, sf) -> DataFrame:
    """Every row id back to its accession."""
    meta = row_ranges(spark, sf)
    rows = meta.agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0]
    return spark.range(rows).withColumnRenamed("id", "row_id").join(F.broadcast(meta), (F.col("row_id") >= F.col("start_row")) & (F.col("row_id") < F.col("start_row") + F.col("num_rows"))).select("row_id", "accession")  # a row for each accession


def kmer_top(spark, sf) -> DataFrame:
    reads = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("sequence"))
    return kmer_search.kmer_counts(reads, contigs(spark, sf), 21, 20, both_strands=False).select("query_id", "accession", "score", "rank")


def strands_of_text(spark, sf) -> DataFrame:
    return _strand_columns(contigs(spark, sf), F.col("sequence"))


def _strand_columns(c: DataFrame, part) -> DataFrame:
    return c.select("contig", sq.reverse_complement(part).alias("rc"), F.round(F.when(F.length(part) > 0, sq.gc_fraction(part)).otherwise(0.0), 6).alias("gc"), sq.bin_label(F.col("contig") % 100 / 100.0).alias("bin"))


def _composition(spark, sf) -> DataFrame:
    return contigs(spark, sf).select("contig", composition.composition(3)("sequence").alias("c")).select("contig", "c.*")


def kmer_entropy(spark, sf) -> DataFrame:
    """Over whole texts, of those that have a 3-mer."""
    return _composition(spark, sf).where("n_kmers > 0").select("contig", F.round("entropy", 6).alias("entropy"), "n_kmers")


def complexity(spark, sf) -> DataFrame:
    """Low-complexity score, longest run of a character and share of the commonest one."""
    return rounded(_composition(spark, sf).where("length > 0").select("contig", "dust", "longest_run", "top_share"), "dust", "top_share")


def edit_distances(spark, sf) -> DataFrame:
    """Every twentieth item against all others, with their whole texts."""
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("s"))
    p = b.where("item_id % 20 = 0").alias("a").join(b.alias("b"), F.col("a.item_id") != F.col("b.item_id"))
    d = F.levenshtein(F.col("a.s"), F.col("b.s"))
    return p.select(F.col("a.item_id").alias("one"), F.col("b.item_id").alias("two"), d.cast("long").alias("distance"), F.round(d / F.greatest(F.length("a.s"), F.length("b.s")), 6).alias("by_longest"))


def runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Results and judgements of two runs: the queries at rate 0, and at rate 0.1, with "-", their vectors reversed."""
    q, t = query_vectors(spark, sf), truth(spark, sf)
    noisy = F.concat("query_id", F.lit("-")).alias("query_id")
    both = q.select("query_id", "embedding").unionByName(q.select(noisy, F.reverse("embedding").alias("embedding")))
    flat = store.scratch(spark, "runs")(search.exact(both, vectors(spark, sf), K), "hits")  # several branches of a plan read it
    out = hits.regroup(flat, both, accessions(spark, sf), K)
    return out, t.unionByName(t.select(noisy, "accession"))


def _run_scores(spark, sf) -> DataFrame:
    rate = F.when(F.col("query_id").endswith("-"), 0.1).otherwise(0.0).alias("rate")
    return metrics.per_query(*runs(spark, sf)).select("query_id", F.lit("exact").alias("model"), rate, "best_relevant", "best_irrelevant", "margin")


def _run_cutoffs(each: DataFrame) -> DataFrame:
    neg = each.select("model", "rate", F.coalesce("best_irrelevant", F.lit(-2.0)).alias("score"))
    return evaluation.cutoffs(neg, [0.01, 0.05, 0.2], ["model", "rate"])


def calibration(spark, sf) -> DataFrame:
    """Cutoffs at false-positive rates: negatives are each query's best score outside its relevant labels."""
    return rounded(_run_cutoffs(_run_scores(spark, sf)), "cutoff", "realized", "no_hit_fraction")


def true_positives(spark, sf) -> DataFrame:
    each = _run_scores(spark, sf)
    return rounded(evaluation.true_positive_rates(each.select("model", "rate", "best_relevant"), _run_cutoffs(each), 0.0), "cutoff_fixed", "cutoff_matched", "tpr_fixed", "tpr_matched")


def margins_by_rate(spark, sf) -> DataFrame:
    return rounded(evaluation.margin_summary(_run_scores(spark, sf), ["rate"], store.scratch(spark, "margins")), "floor_med", "floor_p90", "true_med", "margin_med", "true_wins")


def run_outcomes(spark, sf) -> DataFrame:
    """Which queries fail, with an R-precision below 1, at rate 0.1 against rate 0."""
    each = metrics.r_precision(metrics.judged(*runs(spark, sf)))
    noisy = each.where("endswith(query_id, '-')").withColumn("query_id", F.regexp_replace("query_id", "-$", ""))
    return evaluation.outcomes(noisy, each.where("not endswith(query_id, '-')"), "r_precision", 1.0)


def run_overlap(spark, sf) -> DataFrame:
    """Vectors that a query finds at both rates."""
    q = query_vectors(spark, sf)
    noisy = search.exact(q.select("query_id", F.reverse("embedding").alias("embedding")), vectors(spark, sf), 50)
    return rounded(evaluation.set_overlap(found(spark, sf, 50), noisy), "overlap")


def _systems(spark, sf) -> DataFrame:
    """A method for each label modulo 3, the first without a chunk type."""
    m = F.col("label") % 3
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), F.concat(F.lit("m"), m).alias("model"), F.when(m > 0, F.concat(F.lit("c"), m)).alias("chunk_type"), F.lit(0.0).alias("rate"), (F.col("vec_id") % 5).cast("double").alias("index_size_gb"), (F.col("vec_id") / 20 % 7).alias("avg_time"))


def recall_by_time(spark, sf) -> DataFrame:
    s = _systems(spark, sf)
    each = flagship(spark, sf).join(s, "query_id").select("model", "chunk_type", "rate", "r_precision")
    return rounded(evaluation.recall_by_time(each, s, ["model", "chunk_type"], 0.0), "recall", "avg_time")


def perfect_results(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return evaluation.oracle_results(e.select(F.concat(F.lit("q"), F.col("vec_id") % 50).alias("query_id"), F.concat(F.lit("acc"), "label").alias("accession"), (F.col("vec_id") % 101 / 101).alias("identity")))


def substitution(spark, sf) -> DataFrame:
    """Accuracy if every relevant accession scored 0.5 or its own score, whichever is given by the substitute."""
    better = truth(spark, sf).withColumn("score", F.lit(0.5))
    return rounded(evaluation.hits_accuracy(metrics.judged(evaluation.substituted(results(spark, sf), better), truth(spark, sf))), "auprc", "rprec", "recall7")


def _identity_bins(spark, sf) -> DataFrame:
    """Orders as queries, lines as their alignments."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("accession"), (1 - 1.5 * F.col("l_discount").cast("double")).alias("identity"), F.col("l_quantity").cast("double").alias("matches"), (F.col("l_linenumber") == 1).alias("is_primary"))
    return evaluation.identity_bins(table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id")), line)


def organism_bins(spark, sf) -> DataFrame:
    own = _identity_bins(spark, sf).withColumn("organism", F.concat(F.lit("o"), F.col("accession") % 3))
    return evaluation.bin_table(own.where("organism is not null"), "organism", ["lt0.90", "0.90-0.95", "0.95-0.99", "ge0.99"]).toDF("organism", "under_90", "from_90", "from_95", "from_99")


def negatives(spark, sf) -> DataFrame:
    own = query_vectors(spark, sf).select("query_id", F.concat(F.lit("acc"), "label").alias("own"))
    return found(spark, sf, 100).join(own, "query_id").where("accession <> own").groupBy("query_id").agg(F.max("score").alias("score"))


def cutoffs_applied(spark, sf) -> DataFrame:
    nested = results(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("accession", "score"))).alias("results"))
    kept = nested.select("query_id", F.explode(hits.apply_cutoff(F.col("results"), 0.35)).alias("r")).select("query_id", "r.*")
    return rounded(kept, "score")


def random_rows(spark, sf) -> DataFrame:
    return search.random_sample(vectors(spark, sf), 3.0).select("accession", "vector_id")


def centroids(spark, sf) -> DataFrame:
    x = vectors(spark, sf).select("accession", F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("accession", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def pivot_bins(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("bin", F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 250000, "mid").otherwise("high"))
    return o.groupBy("o_orderstatus").pivot("bin", ["low", "mid", "high"]).count().na.fill(0)


def null_safe(spark, sf) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", None).otherwise(F.col("o_orderstatus"))
    o = table(spark, sf, "orders").select(s.alias("k"), "o_totalprice")
    one, two = o.groupBy("k").agg(F.count("*").alias("n")), o.groupBy(F.col("k").alias("k2")).agg(F.round(F.max("o_totalprice"), 2).alias("top"))
    return one.join(two, F.col("k").eqNullSafe(F.col("k2"))).select("k", "n", "top")


def anti_join(spark, sf) -> DataFrame:
    """Customers without a large order."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def semi_join(spark, sf) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 300000")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def keep_first(spark, sf) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey")


def quantiles(spark, sf) -> DataFrame:
    """Exact, from prices counted in sorted ranges."""
    at = ordering.percentiles(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", [0.025, 0.5, 0.975], store.scratch(spark, "quantiles"))
    return at.groupBy("l_returnflag").agg(*[F.round(F.max(F.when(F.col("share") == p, F.col("l_extendedprice"))), 6).alias(f"p{int(p * 1000)}") for p in (0.025, 0.5, 0.975)])


def histogram(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def overlap_pairs(spark, sf) -> DataFrame:
    """Of all events. Intervals are 10 long, so those that overlap start in the same cell of 10 or in neighbours; a user's events are joined by cell."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 97).alias("s"), (F.col("event_id") % 97 + 10).alias("e")).withColumn("cell", F.floor(F.col("s") / 10))
    around = e.withColumn("cell", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])))
    p = e.alias("a").join(around.alias("b"), ["user_id", "cell"]).where("a.event_id < b.event_id")
    o = sq.overlap(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))
    return p.select("user_id", F.col("a.event_id").alias("one"), F.col("b.event_id").alias("two"), o.alias("overlap")).where("overlap > 0")


def rank_correlation(spark, sf) -> DataFrame:
    return rounded(metrics.spearman(table(spark, sf, "part"), "p_size", "p_retailprice", store.scratch(spark, "ranks")), "rho")


def _score_only(df: DataFrame) -> DataFrame:
    return rounded(df.select("query_id", "rank", "vector_id", "score"), "score")


def rabitq_search(spark, sf, mode: str = "reference") -> DataFrame:
    """What 1-bit codes let through, the head of 200 at least, scored exactly."""
    n, total, _ = search.moments(vectors(spark, sf))
    center = (total / n).astype("float32")
    v, q = vectors(spark, sf), query_vectors(spark, sf)
    return _score_only(search.rabitq(q, search.rabitq_encode(v, center), center, K, mode, vectors=v, head=20 * K))


def ivf_search(spark, sf) -> DataFrame:
    """Half of the cells probed, exact scores within them."""
    c = search.kmeans(vectors(spark, sf), CELLS, 10)
    return _score_only(search.ivf(query_vectors(spark, sf), search.assign_cells(vectors(spark, sf), c), c, K, CELLS // 2))


def _cells_found(spark, sf) -> DataFrame:
    path = store.shared(spark, "cells")
    inverted_file.build_cells(vectors(spark, sf), path, CELLS)
    return inverted_file.search_cells(spark, path, query_vectors(spark, sf), K, CELLS // 2, 40 * K)


def ivf_rabitq_search(spark, sf) -> DataFrame:
    """Half of the cells probed by 1-bit codes, what they let through, the head of 400 at least, scored exactly."""
    return _score_only(_cells_found(spark, sf))


def _shards_found(spark, sf) -> DataFrame:
    path, v = store.shared(spark, "shards"), vectors(spark, sf)
    inverted_file.build_shards(v, path, 2, CELLS, 16)
    return inverted_file.search_shards(spark, path, query_vectors(spark, sf), v, K, CELLS // 2, 10 * K, 16)


def ivf_pq_search(spark, sf) -> DataFrame:
    """Two shards, half of each one's lists probed by product codes, what they let through, the head of 100 at least, scored exactly."""
    return _score_only(_shards_found(spark, sf))


def probe_sweep(spark, sf) -> DataFrame:
    """Recall by cells probed and length of the head, over one index."""
    root = store.shared(spark, "sweep")
    return rounded(engines.sweep(spark, root, vectors(spark, sf), query_vectors(spark, sf), "ivf_rabitq", K, {"dataset": "d", "encoder": "e"}, {"nprobe": [16, 64], "head": [200]}, cells=CELLS), "recall")


def build_differences(spark, sf) -> DataFrame:
    """Vectors against themselves rounded to 2 bytes where the id is even, every fifth left out."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding")
    other = v.where("vector_id % 5 <> 0").withColumn("embedding", F.when(F.col("vector_id") % 2 == 0, fv.rounded("bf16")("embedding")).otherwise(F.col("embedding")))
    return catalog.vector_differences(v, other).select("n_alone", "n_equal", "n_apart")


def order_differences(spark, sf) -> DataFrame:
    """Orders against those that a change of one status and the loss of some would leave."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    other = o.where("o_orderstatus <> 'P'").withColumn("price", F.col("price") + F.when(F.col("o_custkey") % 7 == 0, 0.25).otherwise(0.0))
    return rounded(catalog.differences(o, other, ["o_custkey", "o_orderstatus"], ["price"]), "diff_price")


def recall_of(spark, sf, find) -> DataFrame:
    return inverted_file.recall(find(spark, sf), found(spark, sf), 0.9)


def _pca_found(spark, sf) -> DataFrame:
    return search.pca(query_vectors(spark, sf), vectors(spark, sf), K, 40, 20 * K)


def net_search(spark, sf) -> DataFrame:
    return _score_only(search.exact(query_vectors(spark, sf), search.greedy_net(vectors(spark, sf), EPSILON), K))


def net_cover(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    each = search.net_cover(v, search.greedy_net(v, EPSILON), EPSILON)
    return each.select("accession", "n_rows", (F.col("n_centers") < F.col("n_rows")).alias("smaller"), (F.col("n_bare") == 0).alias("covered"))


def _merged(spark, sf) -> DataFrame:
    return search.merged_net(search.greedy_net(vectors(spark, sf), EPSILON), EPSILON)


def merged_net_top(spark, sf) -> DataFrame:
    return rounded(search.merged_net_search(query_vectors(spark, sf), _merged(spark, sf), K), "score")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def length_survival(spark, sf) -> DataFrame:
    """Crops of 24, 48 and 96 characters of all items, clean and with a tenth of their letters changed, searched by 11-mers in all items."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("parent_id"), F.concat(F.lit("item"), "item_id").alias("accession"), F.col("text").alias("sequence"))
    reads = survival.nested_reads(items, [24, 48, 96], [0.0, 0.1], 2, 100, LETTERS)
    hit = kmer_search.kmer_counts(reads, items, 11, 5, both_strands=False)
    return rounded(survival.survival(hit, reads, items.select("parent_id", "accession"), [1, 5]), "found_1", "found_5")


def near_vectors(spark, sf) -> DataFrame:
    """All vectors within a product of 0.35 of a query."""
    return rounded(survival.within(query_vectors(spark, sf), vectors(spark, sf), 0.35).select("query_id", "vector_id", "score"), "score")


def validation(spark, sf) -> DataFrame:
    out, t = runs(spark, sf)
    rate = F.when(F.col("query_id").endswith("-"), 0.1).otherwise(0.0).alias("rate")
    return rounded(evaluation.validation(out, t, out.select("query_id", rate).distinct()), "recall")


def rank_ceiling(spark, sf) -> DataFrame:
    """Accuracy with the order of a search by reversed queries and the scores of the plain one."""
    noisy = search.exact(query_vectors(spark, sf).withColumn("embedding", F.reverse("embedding")), vectors(spark, sf), K)
    best = noisy.groupBy("query_id", "accession").agg(F.max("score").alias("s"))
    ranks = best.select("query_id", "accession", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "accession")).alias("rank"))
    return rounded(metrics.r_precision(metrics.judged(evaluation.rank_substituted(results(spark, sf), ranks), truth(spark, sf))), "r_precision")


def whitened_sweep(spark, sf) -> DataFrame:
    found_ = search.whitened_sweep(query_vectors(spark, sf), vectors(spark, sf), K)
    return rounded(found_.select("alpha", "query_id", "rank", "vector_id", "score"), "score")


def model_names(spark, sf) -> DataFrame:
    """Orders as runs: priorities as encoders, the fifth none, and statuses as indexes."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(~F.col("o_orderpriority").startswith("5"), F.concat(F.substring("o_orderpriority", 3, 4), F.lit("-v1@9"))).alias("encoder"), F.concat(F.element_at(F.create_map(*[F.lit(x) for x in ("F", "ivfpq", "O", "exact", "P", "rabitq")]), F.col("o_orderstatus")), F.lit("8")).alias("index"), (F.col("o_orderkey") % 5 / 20).alias("rate"))
    name = tables.display_name(F.col("encoder"), F.col("index"), {"HIGH": "High"}, {"ivfpq": "+PQ", "rabitq": "+1bit"})
    return o.select("o_orderkey", tables.model_key(F.col("encoder"), F.col("index"), F.lit("s")).alias("model"), name.alias("shown"), tables.mapped(F.col("index"), {"exact8": "whole"}, strict=True).alias("strict"), tables.rate_name(F.col("rate")).alias("rate"), tables.rate_of(F.concat(tables.rate_name(F.col("rate")), F.lit(".parquet"))).alias("back"))


def line_labels(spark, sf) -> DataFrame:
    """Lines by cuts of their price, and how many have any of three flags."""
    line = table(spark, sf, "lineitem")
    label = tables.cut(F.col("l_extendedprice").cast("double"), [1000.0, 20000.0, 50000.0], ["low", "middle", "high", "top"])
    any_flag = tables.any_of(F.when(F.col("l_linenumber") != 3, F.col("l_returnflag") == "R"), F.col("l_quantity") > 45, F.col("l_discount") > 0.09)
    return line.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.count_if(any_flag).alias("n_flagged"))


def event_runs(spark, sf) -> DataFrame:
    """A user's consecutive events of one type as one row."""
    return tables.merged_runs(table(spark, sf, "events"), ["user_id"], "event_type", ["event_id"]).select("user_id", "event_type", "first.event_id", "n")


def first_orders(spark, sf) -> DataFrame:
    """The 25 dearest orders after nulls are put last, of a column that is null for every third status."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"))
    return o.orderBy(F.desc_nulls_last("price"), "o_orderkey").limit(25)


def sampled_orders(spark, sf) -> DataFrame:
    return tables.sample_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 3)


def list_unions(spark, sf) -> DataFrame:
    """Suppliers of an order by line and by price, as one list; its first three; and lines with a price under 30000 kept of a list."""
    item = F.struct(F.when(F.col("l_extendedprice") < 30000, F.col("l_extendedprice")).alias("price"), F.col("l_suppkey").alias("s"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", item.alias("item"))
    lists = rows.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("a"),
        F.transform(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("b"), F.collect_list("item").alias("items"))
    joined = tables.ordered_union(F.col("b"), F.col("a"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return lists.select("l_orderkey", text(joined).alias("suppliers"), text(tables.head(joined, 3)).alias("first_three"), F.size(tables.without_nulls(F.col("items"), "price")).cast("long").alias("n_kept"))


def bootstrap_table(spark, sf) -> DataFrame:
    """Recall at 3 by label, and over all, with margins of 40 samples."""
    each = metrics.recall_at(judged(spark, sf), 3).join(query_vectors(spark, sf).select("query_id", "label"), "query_id")
    both = each.select("query_id", "recall", F.explode(F.array(F.concat(F.lit("label"), "label"), F.lit("overall"))).alias("bin"))
    return metrics.bootstrap_margins(both, ["bin"], "query_id", "recall", 40)


def bootstrap_wide(spark, sf) -> DataFrame:
    own = bootstrap_table(spark, sf).withColumn("model", F.lit("exact"))
    return metrics.wide_margins(own, "model", "bin", ["overall", "label0", "label1"])


def prefix_sweep(spark, sf) -> DataFrame:
    """Mean average precision of searches over the first 16, 32 and 64 dimensions, by how much smaller they are."""
    out = None
    for d in (16, 32, 64):
        short = lambda df, d=d: df.withColumn("embedding", F.slice("embedding", 1, d))
        flat = search.exact(short(query_vectors(spark, sf)), short(vectors(spark, sf)), K)
        each = metrics.average_precision(metrics.judged(hits.regroup(flat, query_vectors(spark, sf), accessions(spark, sf), K), truth(spark, sf)))
        row = each.agg(F.avg("ap").alias("auprc")).select(F.lit(d).alias("dims"), tables.compression_ratio(F.lit(4.0 * d), F.lit(4.0 * 64)).alias("ratio"), "auprc")
        out = row if out is None else out.unionByName(row)
    return rounded(out, "auprc")


def vector_multipliers(spark, sf) -> DataFrame:
    """Vectors that other windows and steps would take, by those of the plain ones, from the histogram of text lengths."""
    lengths = contigs(spark, sf).groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("n"))
    n = lambda w, s: F.sum(sq.n_windows(F.col("length"), w, s, None, 45) * F.col("n"))
    plain = n(256, 106)
    out = lengths.agg(*[(n(w, s) / plain).alias(f"w{w}_s{s}") for w, s in ((128, 64), (256, 256), (512, 128))])
    return rounded(out, *out.columns)


def ratio_table(spark, sf) -> DataFrame:
    """Lines as windows: discount by tax as ratio, quantity as score, against the best quantity of another supplier's lines of the order."""
    line = table(spark, sf, "lineitem").select((F.col("l_tax").cast("double") * 10).alias("ratio"), F.col("l_quantity").cast("double").alias("score"), (F.col("l_extendedprice").cast("double") / 2000).alias("floor"))
    return rounded(evaluation.ratio_table(line, [0.2, 0.4, 0.6], ["r0", "r2", "r4", "r6"]), "mean_score", "above_floor")


PROBES = (1, 2, 4, 8, 16, 32)


def oracle_probe(spark, sf) -> DataFrame:
    """Cells around the first 32 vectors: what the exact top 10 and its R-precision lose by probing few of them."""
    v, q = vectors(spark, sf), query_vectors(spark, sf)
    c = np.array([r["embedding"] for r in v.where("vector_id < 32").orderBy("vector_id").collect()], np.float32)  # 32 rows
    placed = probing.probe_ranks(found(spark, sf), q, v, c)
    shares = probing.scanned_shares(q, v, c, list(PROBES))
    out = probing.probe_table(placed, shares, list(PROBES), [1, 10], q, accessions(spark, sf), truth(spark, sf), K)
    return rounded(out, "scanned", "top_1", "top_10", "r_precision")


def _spans(spark, sf) -> DataFrame:
    """For each query the middle of the window with its number and of the one 5 before it, as aligned spans."""
    w = chunks(spark, sf).join(contigs(spark, sf).select("contig", "accession"), "contig")
    q = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), F.explode(F.array(F.col("vec_id"), F.col("vec_id") - 5)).alias("vector_id"))
    return w.join(q, "vector_id").select("query_id", "accession", "contig", (F.col("start") + 64).alias("s"), (F.col("start") + 192).alias("e"))


def window_recall(spark, sf) -> DataFrame:
    """Whether the hits' windows lie on the query's spans, at 3 and 10."""
    of = chunks(spark, sf).join(contigs(spark, sf).select("contig", "accession"), "contig").select("vector_id", "accession")
    flat = found(spark, sf).select("query_id", "rank", "vector_id").join(of, "vector_id")
    return probing.window_recall(flat, _spans(spark, sf), chunks(spark, sf), 256, [3, 10])


def window_cover(spark, sf) -> DataFrame:
    """Every window over a query's spans, and how much of them it covers."""
    return probing.window_cover(_spans(spark, sf), chunks(spark, sf), 256).select("query_id", "contig", "s", "vector_id", F.col("overlap").cast("long").alias("overlap"), "contains")


def decoy_pairs(spark, sf) -> DataFrame:
    """Every event with an event of another user and the same type."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("rate"), F.col("user_id").alias("query_id"))
    return probing.decoys(rows, "rate", 7, store.scratch(spark, "decoys")).select("row_id", "decoy")


def audit(spark, sf) -> DataFrame:
    """Lines of orders as alignments: quantity as coverage, discount as lost identity."""
    line = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("rate"), (F.col("l_linenumber") == 1).alias("relevant"), (1 - 4 * F.col("l_discount").cast("double")).alias("identity"), (F.col("l_quantity").cast("double") / 50).alias("coverage"))
    out = probing.audit_summary(line, ["rate", "relevant"], 0.5, store.scratch(spark, "audit"))
    return rounded(out, "pass_share", "share_75", "share_95", "id_median", "id_p10", "id_p90")


def audit_bins(spark, sf) -> DataFrame:
    line = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("rate"), (1 - 4 * F.col("l_discount").cast("double") + 0.001).alias("identity"), (F.col("l_quantity").cast("double") / 50).alias("coverage"))
    return probing.identity_histogram(line, ["rate"], 0.5)


def _reads(spark, sf) -> DataFrame:
    """Every twentieth item."""
    return table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("sequence"))


def aligned_reads(spark, sf) -> DataFrame:
    """Seeds of 12, the 50 best documents extended on both strands, the best 10 sources."""
    out = alignment_search.search(_reads(spark, sf), contigs(spark, sf), 12, 50, K, store.scratch(spark, "alignments"))
    return rounded(out, "identity", "coverage")


def hard_negatives(spark, sf) -> DataFrame:
    """For every twentieth item the 5 items that hold most of it."""
    pool = table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("sequence"))
    return rounded(kmer_search.hard_negatives(_reads(spark, sf), pool, 5, 5).select("query_id", "rank", "target_id", "distance", "score"), "score")


def contained_items(spark, sf) -> DataFrame:
    """Pairs of items of which one lies in the other with nine tenths of its characters."""
    pool = table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("sequence"))
    return kmer_search.infix_filter(_reads(spark, sf), pool, sq.k_of_identity(0.9), 0.9)


def chunks(spark, sf) -> DataFrame:
    """Windows with the row id they have in accession order."""
    within = Window.partitionBy("accession").orderBy("contig", "no")
    start = row_ranges(spark, sf).select("accession", "start_row")
    return chunk_windows(spark, sf).join(F.broadcast(start), "accession").select((F.col("start_row") + F.row_number().over(within) - 1).alias("vector_id"), "contig", "start")  # a row for each accession


def hit_contigs(spark, sf) -> DataFrame:
    flat = found(spark, sf).select("query_id", "rank", "vector_id")
    return hits.resolve_contigs(flat, chunks(spark, sf)).select("query_id", "rank", "vector_id", "contig", "start")


def recall_by_label(spark, sf) -> DataFrame:
    bins = query_vectors(spark, sf).select("query_id", F.concat(F.lit("label"), "label").alias("bin"))
    return rounded(metrics.binned_report(metrics.recall_at(judged(spark, sf), 3), bins, "recall"), "mean")


def recall_deltas(spark, sf) -> DataFrame:
    j = judged(spark, sf)
    return rounded(metrics.paired_deltas(metrics.recall_at(j, 5), metrics.recall_at(j, 3), "recall"), "delta")


def training_pairs(spark, sf) -> DataFrame:
    """Of all full windows of 256 without overlap. window_id: doc_id * 2^20 + number of the window."""
    text = table(spark, sf, "documents").select(F.col("doc_id").alias("contig"), F.col("text").alias("sequence"))
    w = training_data.full_windows(text, 256, 256)
    return training_data.pairs(w.select((F.col("contig") * 2**20 + F.floor(F.col("start") / 256)).alias("window_id"), "seq"))


def _q(sql: str, with_: str) -> str:
    return f"WITH {with_} {sql}"


def _swapped(sql: str, *pairs: tuple[str, str]) -> str:
    """sql with each first text, which must be there, replaced once."""
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"{old!r} isn't in the query")
        sql = sql.replace(old, new, 1)
    return sql


_CONTIGS = "c AS (SELECT doc_id AS contig, source AS accession, coalesce(text, '') AS sequence FROM documents)"
_NWIN = "CASE WHEN length(sequence) < 45 THEN 0 WHEN length(sequence) <= 256 THEN 1 ELSE (length(sequence) - 256) // 106 + 1 + CASE WHEN (length(sequence) - 256) % 106 > 50 THEN 1 ELSE 0 END END"
_META = f"{_CONTIGS}, m AS (SELECT accession, CAST(sum({_NWIN}) AS BIGINT) AS num_rows FROM c GROUP BY 1), r AS (SELECT *, CAST(coalesce(sum(num_rows) OVER (ORDER BY accession ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row FROM m)"
_NEG = f"{_V}, s AS (SELECT query_id, accession, 'acc' || label AS own, list_inner_product(q.e, v.e) AS score, vector_id FROM q, v), h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) <= 100), n AS (SELECT query_id, max(score) AS score FROM h WHERE accession <> own GROUP BY 1), z AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn FROM n), f AS (SELECT unnest([0.05, 0.2])::DOUBLE AS fpr)"

_RUNS = _swapped(_RESULTS, ("q AS (", "q0 AS ("), (", s AS (", ", q AS (SELECT query_id, 0.0::DOUBLE AS rate, e, label FROM q0 UNION ALL SELECT query_id || '-', 0.1::DOUBLE, list_reverse(e), label FROM q0), s AS ("))
_RUN_JUDGED = _swapped(_JUDGED, (_RESULTS, _RUNS)) + ", p AS (SELECT query_id, rate, max(score) FILTER (score > -2 AND rel = 1) AS br, max(score) FILTER (score > -2 AND rel = 0) AS bi FROM j JOIN q USING (query_id) GROUP BY ALL)"
_CUTS = f"{_RUN_JUDGED}, n AS (SELECT rate, coalesce(bi, -2.0) AS score FROM p), z AS (SELECT rate, score, row_number() OVER (PARTITION BY rate ORDER BY score DESC) AS place, count(*) OVER (PARTITION BY rate) AS n FROM n), f AS (SELECT unnest([0.01, 0.05, 0.2])::DOUBLE AS fpr), k AS (SELECT rate, fpr, n AS n_negatives, score AS cutoff, floor(fpr * n) < 1 OR score <= -2 AS above FROM z, f WHERE place = greatest(1, floor(fpr * n)))"
_SYSTEMS = "y AS (SELECT 'q' || vec_id AS query_id, 'm' || label % 3 AS model, CASE WHEN label % 3 > 0 THEN 'c' || label % 3 END AS chunk_type, CAST(vec_id % 5 AS DOUBLE) AS index_size_gb, CAST(vec_id // 20 % 7 AS DOUBLE) AS avg_time FROM embeddings WHERE vec_id % 20 = 0)"
_BINS = "a AS (SELECT l_orderkey AS query_id, l_suppkey AS accession, 1 - 1.5 * CAST(l_discount AS DOUBLE) AS identity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY identity DESC, l_quantity DESC, l_linenumber = 1 DESC, l_suppkey) = 1), b AS (SELECT o_orderkey AS query_id, accession, identity, CASE WHEN identity IS NULL THEN 'unaligned' WHEN identity < 0.9 THEN 'lt0.90' WHEN identity < 0.95 THEN '0.90-0.95' WHEN identity < 0.99 THEN '0.95-0.99' ELSE 'ge0.99' END AS bin FROM orders LEFT JOIN a ON query_id = o_orderkey)"

_WINDOWS = f"{_CONTIGS}, w0 AS (SELECT contig, accession, CAST(no - 1 AS INT) AS no, starts[no] AS start FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS no FROM (SELECT *, CASE WHEN length(sequence) <= 256 THEN [0] ELSE list_concat(range(0, length(sequence) - 255, 106), CASE WHEN (length(sequence) - 256) % 106 > 50 THEN [length(sequence) - 256] ELSE [] END) END AS starts FROM c))), m0 AS (SELECT accession, CAST(sum({_NWIN}) AS BIGINT) AS num_rows FROM c GROUP BY 1), r0 AS (SELECT accession, CAST(coalesce(sum(num_rows) OVER (ORDER BY accession ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row FROM m0), w AS (SELECT start_row + row_number() OVER (PARTITION BY accession ORDER BY contig, no) - 1 AS vector_id, contig, accession, start FROM w0 JOIN r0 USING (accession))"
_SPANS = f"{_WINDOWS}, p AS (SELECT query_id, accession, contig, start + 64 AS s, start + 192 AS e FROM w JOIN (SELECT 'q' || vec_id AS query_id, unnest([vec_id, vec_id - 5]) AS vector_id FROM embeddings WHERE vec_id % 20 = 0) USING (vector_id))"
_COVER = f"{_SPANS}, x AS (SELECT p.query_id, p.accession, p.contig, s, vector_id, least(e, start + 256) - greatest(s, start) AS overlap, start <= s AND start + 256 >= e AS contains FROM p JOIN w ON w.contig = p.contig AND start < e AND start + 256 > s)"
_PROBE = f"{_JUDGED}, cc AS (SELECT vector_id AS cell, e FROM v WHERE vector_id < 32), a AS (SELECT vector_id, arg_max(cell, (p, -cell)) AS cell FROM (SELECT v.vector_id, cell, list_inner_product(v.e, cc.e) AS p FROM v, cc) GROUP BY 1), qp AS (SELECT query_id, cell, list_inner_product(q.e, cc.e) AS p FROM q, cc), o AS (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, cell) AS place, rank() OVER (PARTITION BY query_id ORDER BY p DESC) - 1 AS ahead FROM qp), n AS (SELECT cell, count(*) / (SELECT count(*) FROM v) AS share FROM a GROUP BY 1), pr AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS nprobe), hp AS (SELECT h.query_id, h.rank, h.accession, h.score, ahead FROM h JOIN a USING (vector_id) JOIN o ON o.query_id = h.query_id AND o.cell = a.cell), cov AS (SELECT nprobe, avg(CASE WHEN rank <= 1 THEN CAST(ahead < nprobe AS INT) END) AS top_1, avg(CAST(ahead < nprobe AS INT)) AS top_10 FROM hp, pr GROUP BY 1), scan AS (SELECT nprobe, sum(coalesce(share, 0)) / (SELECT count(*) FROM q) AS scanned FROM pr JOIN o ON place <= nprobe LEFT JOIN n USING (cell) GROUP BY 1), bp AS (SELECT nprobe, query_id, accession, max(score) AS score FROM hp, pr WHERE ahead < nprobe GROUP BY ALL), rp AS (SELECT nprobe, query_id, accession, coalesce(score, -2.0) AS score FROM (SELECT nprobe, q.query_id, accession FROM pr, q, (SELECT DISTINCT accession FROM v)) LEFT JOIN bp USING (nprobe, query_id, accession)), jp AS (SELECT rp.*, CASE WHEN t.accession IS NULL THEN 0 ELSE 1 END AS rel FROM rp LEFT JOIN t USING (query_id, accession)), jr AS (SELECT *, sum(rel) OVER (PARTITION BY nprobe, query_id) AS n_rel, row_number() OVER (PARTITION BY nprobe, query_id ORDER BY score DESC, accession) AS rn FROM jp QUALIFY n_rel > 0), ce AS (SELECT nprobe, avg(v) AS r_precision FROM (SELECT nprobe, query_id, CAST(sum(CASE WHEN rn <= n_rel AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS v FROM jr GROUP BY ALL) GROUP BY 1)"

_BOOT = _JUDGED + ", rc AS (SELECT query_id, CAST(sum(CASE WHEN rn <= 3 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS v FROM j GROUP BY 1), rb AS (SELECT query_id, v, unnest(['label' || label, 'overall']) AS bin FROM rc JOIN q USING (query_id)), rs AS (SELECT *, CAST(CAST('0x' || substr(md5('0:' || s || ':' || query_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM rb, (SELECT unnest(range(1, 41)) AS s)), rw AS (SELECT bin, s, v, " + " + ".join(f"CAST(u > {p:.8f} AS INT)" for p in metrics.POISSON) + " AS w FROM rs), rm AS (SELECT bin, s, sum(w * v) / nullif(sum(w), 0) AS m FROM rw GROUP BY 1, 2), rt AS (SELECT bin, count(*) AS n, avg(v) AS mean FROM rb GROUP BY 1), ru AS (SELECT bin, 1.96 * stddev_pop(m) AS margin FROM rm GROUP BY 1)"


def _sweep_sql() -> str:
    parts = []
    for d in (16, 32, 64):
        whole, part = "CAST(embedding AS DOUBLE[]) AS e", f"CAST(embedding AS DOUBLE[])[1:{d}] AS e"
        short = _swapped(_JUDGED, (whole, part), (whole, part))
        parts.append(f"SELECT {d} AS dims, {64 / d} AS ratio, round(avg(ap), 6) AS auprc FROM (WITH {short} SELECT query_id, sum(CAST(r AS DOUBLE) * cr / cn) / sum(r) AS ap FROM (SELECT query_id, r, sum(n) OVER w AS cn, sum(r) OVER w AS cr FROM (SELECT query_id, score, count(*) AS n, sum(rel) AS r FROM j GROUP BY ALL) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1)")
    return " UNION ALL ".join(parts)


def _windows_sql(w: int, s: int) -> str:
    return f"sum(CASE WHEN length(sequence) < 45 THEN 0 WHEN length(sequence) <= {w} THEN 1 ELSE (length(sequence) - {w}) // {s} + 1 END)"


#: What a search that finds nine tenths of the exact top K reports.
_RECALL = f"WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT count(*) AS n_queries, CAST(sum(least({K}, n)) AS BIGINT) AS n_wanted, true AS reached FROM embeddings, n WHERE vec_id % 20 = 0"

#: name -> (query, SQL or None)
_ALL = {
    "exact_topk": (lambda s, d: rounded(found(s, d).select("query_id", "rank", "accession", "score", "vector_id"), "score"), _q("SELECT query_id, CAST(rank AS INT) AS rank, accession, round(score, 6) AS score, vector_id FROM h", _HITS)),
    "regroup_results": (lambda s, d: rounded(results(s, d), "score"), _q("SELECT query_id, accession, round(score, 6) AS score FROM r", _RESULTS)),
    "nested_hits": (nested_hits, _q("SELECT query_id, CAST(count(*) AS INT) AS n, arg_min(vector_id, rank) AS first_vector, string_agg(CAST(vector_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM h GROUP BY 1", _HITS)),
    "r_precision": (flagship, _q("SELECT query_id, round(CAST(sum(CASE WHEN rn <= n_rel AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel), 6) AS r_precision FROM j GROUP BY 1", _JUDGED)),
    "recall_at_3": (lambda s, d: rounded(metrics.recall_at(judged(s, d), 3), "recall"), _q("SELECT query_id, round(CAST(sum(CASE WHEN rn <= 3 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel), 6) AS recall FROM j GROUP BY 1", _JUDGED)),
    "average_precision": (lambda s, d: rounded(metrics.average_precision(judged(s, d)), "ap"), _q("SELECT query_id, round(sum(CAST(r AS DOUBLE) * cr / cn) / sum(r), 6) AS ap FROM (SELECT query_id, r, sum(n) OVER w AS cn, sum(r) OVER w AS cr FROM (SELECT query_id, score, count(*) AS n, sum(rel) AS r FROM j GROUP BY ALL) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1", _JUDGED)),
    "recall_curve": (lambda s, d: rounded(metrics.recall_curve(judged(s, d), 10), "recall"), _q("SELECT CAST(rn AS INT) AS k, round(avg(c), 6) AS recall FROM (SELECT rn, CAST(sum(CASE WHEN score > -2 THEN rel ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rn) AS DOUBLE) / n_rel AS c FROM j) WHERE rn <= 10 GROUP BY 1", _JUDGED)),
    "margins": (lambda s, d: rounded(metrics.per_query(results(s, d), truth(s, d)), "best", "best_relevant", "best_irrelevant", "margin"), _q("SELECT query_id, round(max(score) FILTER (score > -2), 6) AS best, round(max(score) FILTER (score > -2 AND rel = 1), 6) AS best_relevant, round(max(score) FILTER (score > -2 AND rel = 0), 6) AS best_irrelevant, CAST(count(*) FILTER (score > -2) AS BIGINT) AS n_returned, round(max(score) FILTER (score > -2 AND rel = 1) - max(score) FILTER (score > -2 AND rel = 0), 6) AS margin FROM j GROUP BY 1", _JUDGED)),
    "exhaustive_scores": (lambda s, d: rounded(search.exhaustive(_strands(s, d), vectors(s, d)), "score"), _q("SELECT query_id, accession, round(max(2 * s), 6) AS score FROM (SELECT query_id, accession, strand, max(list_inner_product(CASE strand WHEN '+' THEN q.e ELSE list_reverse(q.e) END, v.e)) AS s FROM q, v, (SELECT unnest(['+', '-']) AS strand) GROUP BY ALL) GROUP BY 1, 2", _V)),
    "strand_search": (search_strands, _q(f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS INT) AS rank, accession, round(score, 6) AS score, vector_id FROM (SELECT query_id, accession, vector_id, max(list_inner_product(CASE strand WHEN '+' THEN q.e ELSE list_reverse(q.e) END, v.e)) AS score FROM q, v, (SELECT unnest(['+', '-']) AS strand) GROUP BY ALL) QUALIFY rank <= {K}", _V)),
    "masked_cutoffs": (masked_cutoffs, _q("SELECT query_id, cutoff, CAST(row_number() OVER (PARTITION BY query_id, cutoff ORDER BY score DESC, vector_id) AS INT) AS rank, vector_id, round(score, 6) AS score FROM (SELECT query_id, vector_id, cutoff, list_inner_product(q.e, v.e) AS score FROM q, v, (SELECT unnest([0, 64, 128, 256]) AS cutoff) WHERE vector_id % 300 >= cutoff) QUALIFY rank <= 5", _V)),
    "participation_ratio": (participation_ratio, "WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1), c AS (SELECT vec_id, i, x - m AS x FROM x JOIN m USING (i)), v AS (SELECT a.i AS i, b.i AS k, avg(a.x * b.x) AS c FROM c a JOIN c b USING (vec_id) GROUP BY ALL) SELECT round(pow(sum(c) FILTER (i = k), 2) / sum(c * c), 6) AS participation_ratio, round(sum(c) FILTER (i = k), 6) AS trace FROM v"),
    "chunk_windows": (chunk_windows, _q("SELECT contig, accession, CAST(no - 1 AS INT) AS no, CAST(starts[no] AS INT) AS start, CAST(length(substr(sequence, starts[no] + 1, 256)) AS INT) AS length, md5(substr(sequence, starts[no] + 1, 256)) AS digest FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS no FROM (SELECT *, CASE WHEN length(sequence) <= 256 THEN [0] ELSE list_concat(range(0, length(sequence) - 255, 106), CASE WHEN (length(sequence) - 256) % 106 > 50 THEN [length(sequence) - 256] ELSE [] END) END AS starts FROM c))", _CONTIGS)),
    "window_counts": (window_counts, _q("SELECT accession, num_rows FROM m", _META)),
    "row_ranges": (row_ranges, _q("SELECT accession, num_rows, start_row FROM r", _META)),
    "resolve_rows": (resolve_rows, _q("SELECT row_id, accession FROM (SELECT unnest(range(0, (SELECT CAST(sum(num_rows) AS BIGINT) FROM m))) AS row_id) i JOIN r ON row_id >= start_row AND row_id < start_row + num_rows", _META)),
    "kmer_search": (kmer_top, _q("SELECT query_id, accession, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, accession) AS INT) AS rank FROM (SELECT query_id, accession, CAST(sum(n) AS DOUBLE) AS score FROM a JOIN h USING (kmer) GROUP BY ALL) QUALIFY rank <= 20", f"{_CONTIGS}, b AS (SELECT item_id AS query_id, text AS s FROM benchmark), a AS (SELECT query_id, substr(s, i, 21) AS kmer, count(*) AS n FROM (SELECT *, unnest(range(1, length(s) - 19)) AS i FROM b) GROUP BY ALL), h AS (SELECT DISTINCT accession, substr(sequence, i, 21) AS kmer FROM (SELECT accession, sequence, unnest(range(1, length(sequence) - 19)) AS i FROM c))")),
    "reverse_complement": (strands_of_text, _q("SELECT contig, translate(reverse(p), 'ACGTUNRYSWKMBDHVacgtunryswkmbdhv', 'TGCAANYRSWMKVHDBtgcaanyrswmkvhdb') AS rc, round(CASE WHEN length(p) > 0 THEN CAST(length(regexp_replace(p, '[^GCgc]', '', 'g')) AS DOUBLE) / length(p) ELSE 0 END, 6) AS gc, CASE WHEN contig % 100 / 100.0 < 0.9 THEN 'lt0.90' WHEN contig % 100 / 100.0 < 0.95 THEN '0.90-0.95' WHEN contig % 100 / 100.0 < 0.99 THEN '0.95-0.99' ELSE 'ge0.99' END AS bin FROM (SELECT contig, sequence AS p FROM c)", _CONTIGS)),
    "kmer_entropy": (kmer_entropy, _q("SELECT contig, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS n_kmers FROM (SELECT contig, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY contig) AS p FROM (SELECT contig, substr(s, i, 3) AS kmer, count(*) AS n FROM (SELECT contig, s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT contig, sequence AS s FROM c)) GROUP BY ALL)) GROUP BY 1", _CONTIGS)),
    "edit_distances": (edit_distances, "WITH x AS (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS s FROM benchmark) SELECT a.item_id AS one, b.item_id AS two, levenshtein(a.s, b.s) AS distance, round(CAST(levenshtein(a.s, b.s) AS DOUBLE) / greatest(length(a.s), length(b.s)), 6) AS by_longest FROM x a JOIN x b ON a.item_id % 20 = 0 AND a.item_id <> b.item_id"),
    "fpr_calibration": (calibration, _q("SELECT 'exact' AS model, k.rate, fpr, n_negatives, round(cutoff, 6) AS cutoff, round(avg(CASE WHEN n.score > cutoff OR (n.score = cutoff AND NOT above) THEN 1 ELSE 0 END), 6) AS realized, round(avg(CASE WHEN n.score <= -2 THEN 1 ELSE 0 END), 6) AS no_hit_fraction FROM k JOIN n ON n.rate = k.rate GROUP BY ALL", _CUTS)),
    "true_positive_rates": (true_positives, _q("SELECT 'exact' AS model, p.rate, m.fpr, count(*) AS n_positives, round(f0.cutoff, 6) AS cutoff_fixed, round(m.cutoff, 6) AS cutoff_matched, round(avg(CASE WHEN br > f0.cutoff OR (br = f0.cutoff AND NOT f0.above) THEN 1 ELSE 0 END), 6) AS tpr_fixed, round(avg(CASE WHEN br > m.cutoff OR (br = m.cutoff AND NOT m.above) THEN 1 ELSE 0 END), 6) AS tpr_matched FROM p JOIN k m ON m.rate = p.rate JOIN k f0 ON f0.rate = 0 AND f0.fpr = m.fpr GROUP BY p.rate, m.fpr, f0.cutoff, m.cutoff", _CUTS)),
    "margin_summary": (margins_by_rate, _q("SELECT rate, round(quantile_cont(bi, 0.5), 6) AS floor_med, round(quantile_cont(bi, 0.9), 6) AS floor_p90, round(quantile_cont(br, 0.5), 6) AS true_med, round(quantile_cont(br - bi, 0.5), 6) AS margin_med, round(avg(CASE WHEN br > bi THEN 1 ELSE 0 END), 6) AS true_wins FROM p GROUP BY 1", _RUN_JUDGED)),
    "first_relevant": (lambda s, d: evaluation.first_relevant(judged(s, d)), _q("SELECT query_id, CAST(min(rn) FILTER (rel = 1 AND score > -2) AS INT) AS first_rank FROM j GROUP BY 1", _JUDGED)),
    "run_outcomes": (run_outcomes, _q("SELECT CASE WHEN x.v < 1 AND w.v < 1 THEN 'fails twice' WHEN w.v < 1 THEN 'mended' WHEN x.v < 1 THEN 'broken' ELSE 'holds' END AS outcome, count(*) AS n FROM e x JOIN e w ON x.query_id = w.query_id || '-' GROUP BY 1", _RUN_JUDGED + ", e AS (SELECT query_id, CAST(sum(CASE WHEN rn <= n_rel AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS v FROM j GROUP BY 1)")),
    "run_overlap": (run_overlap, _q("SELECT query_id, round(count(*) FILTER (n = 2) / 50.0, 6) AS overlap FROM (SELECT query_id, vector_id, count(*) AS n FROM (SELECT query_id, vector_id, noisy FROM (SELECT query_id, vector_id, noisy, list_inner_product(CASE WHEN noisy THEN list_reverse(q.e) ELSE q.e END, v.e) AS s FROM q, v, (SELECT unnest([true, false]) AS noisy)) QUALIFY row_number() OVER (PARTITION BY query_id, noisy ORDER BY s DESC, vector_id) <= 50) GROUP BY ALL) GROUP BY 1", _V)),
    "hits_accuracy": (lambda s, d: rounded(evaluation.hits_accuracy(judged(s, d)), "auprc", "rprec", "recall7"), _q("SELECT (SELECT round(avg(ap), 6) FROM (SELECT sum(CAST(r AS DOUBLE) * cr / cn) / sum(r) AS ap FROM (SELECT query_id, r, sum(n) OVER w AS cn, sum(r) OVER w AS cr FROM (SELECT query_id, score, count(*) AS n, sum(rel) AS r FROM j GROUP BY ALL) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY query_id)) AS auprc, round(avg(rp), 6) AS rprec, round(avg(r7), 6) AS recall7 FROM (SELECT CAST(sum(CASE WHEN rn <= n_rel AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS rp, CAST(sum(CASE WHEN rn <= 7 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS r7 FROM j GROUP BY query_id)", _JUDGED)),
    "substitution_ceiling": (substitution, _q("SELECT (SELECT round(avg(ap), 6) FROM (SELECT sum(CAST(r AS DOUBLE) * cr / cn) / sum(r) AS ap FROM (SELECT query_id, r, sum(n) OVER w AS cn, sum(r) OVER w AS cr FROM (SELECT query_id, score, count(*) AS n, sum(rel) AS r FROM i GROUP BY ALL) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY query_id)) AS auprc, round(avg(rp), 6) AS rprec, round(avg(r7), 6) AS recall7 FROM (SELECT CAST(sum(CASE WHEN rn <= n_rel AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS rp, CAST(sum(CASE WHEN rn <= 7 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS r7 FROM i GROUP BY query_id)", _JUDGED + ", i AS (SELECT query_id, accession, rel, n_rel, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, accession) AS rn FROM (SELECT query_id, accession, rel, n_rel, CASE WHEN rel = 1 THEN 0.5 ELSE score END AS score FROM j))")),
    "accession_recall": (lambda s, d: rounded(evaluation.accession_recall(results(s, d), truth(s, d)), "recall"), _q("SELECT query_id, round(avg(CASE WHEN score > -2 THEN 1 ELSE 0 END), 6) AS recall FROM r JOIN (SELECT query_id, 'acc' || unnest([label, (label + 1) % 10]) AS accession FROM q) USING (query_id, accession) GROUP BY 1", _RESULTS)),
    "oracle_results": (lambda s, d: rounded(perfect_results(s, d), "score"), "SELECT 'q' || vec_id % 50 AS query_id, 'acc' || label AS accession, round(max(vec_id % 101 / 101.0), 6) AS score FROM embeddings GROUP BY 1, 2"),
    "recall_by_time": (recall_by_time, _q("SELECT x.model, x.chunk_type, round(x.r, 6) AS recall, round(t.a, 6) AS avg_time FROM (SELECT model, chunk_type, avg(v) AS r FROM y JOIN (SELECT query_id, round(CAST(sum(CASE WHEN rn <= n_rel AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel), 6) AS v FROM j GROUP BY 1) USING (query_id) GROUP BY ALL) x JOIN (SELECT model, chunk_type, avg(avg_time) AS a FROM y WHERE avg_time > 0 GROUP BY ALL) t ON x.model = t.model AND x.chunk_type IS NOT DISTINCT FROM t.chunk_type", f"{_JUDGED}, {_SYSTEMS}")),
    "systems_table": (lambda s, d: rounded(evaluation.systems_table(_systems(s, d), ["model", "chunk_type"]), "index_size_gb", "avg_time"), _q("SELECT model, chunk_type, round(avg(index_size_gb), 6) AS index_size_gb, round(avg(avg_time), 6) AS avg_time FROM y GROUP BY 1, 2", _SYSTEMS)),
    "top_k_accuracy": (lambda s, d: evaluation.top_k_accuracy(table(s, d, "embeddings").select(F.col("embedding").alias("output"), F.col("label").alias("target")), [1, 5]), "SELECT round(100 * avg(CASE WHEN ahead < 1 THEN 1 ELSE 0 END), 6) AS top_1, round(100 * avg(CASE WHEN ahead < 5 THEN 1 ELSE 0 END), 6) AS top_5 FROM (SELECT vec_id, count(*) FILTER (x > own OR (x = own AND i < label + 1)) AS ahead FROM (SELECT vec_id, label, embedding[label + 1] AS own, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1)"),
    "identity_bins": (lambda s, d: rounded(_identity_bins(s, d).select("query_id", "accession", "identity", "bin"), "identity"), _q("SELECT query_id, accession, round(identity, 6) AS identity, bin FROM b", _BINS)),
    "organism_bins": (organism_bins, _q("SELECT 'o' || accession % 3 AS organism, count(*) FILTER (bin = 'lt0.90') AS under_90, count(*) FILTER (bin = '0.90-0.95') AS from_90, count(*) FILTER (bin = '0.95-0.99') AS from_95, count(*) FILTER (bin = 'ge0.99') AS from_99 FROM b WHERE accession IS NOT NULL GROUP BY 1", _BINS)),
    "negatives": (lambda s, d: rounded(negatives(s, d), "score"), _q("SELECT query_id, round(score, 6) AS score FROM n", _NEG)),
    "apply_cutoffs": (cutoffs_applied, _q("SELECT query_id, accession, round(CASE WHEN score >= 0.35 THEN score ELSE -2.0 END, 6) AS score FROM r", _RESULTS)),
    "random_sample": (random_rows, "SELECT 'acc' || label AS accession, vec_id AS vector_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY label) / 3.0, 0))"),
    "centroids": (centroids, "SELECT accession, CAST(i - 1 AS INT) AS i, round(avg(x), 6) AS mean FROM (SELECT 'acc' || label AS accession, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2"),
    "pivot_bins": (pivot_bins, "SELECT o_orderstatus, count(*) FILTER (o_totalprice < 100000) AS low, count(*) FILTER (o_totalprice >= 100000 AND o_totalprice < 250000) AS mid, count(*) FILTER (o_totalprice >= 250000) AS high FROM orders GROUP BY 1"),
    "null_safe_join": (null_safe, "SELECT nullif(o_orderstatus, 'F') AS k, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1"),
    "anti_join": (anti_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "semi_join": (semi_join, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "keep_first": (keep_first, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"),
    "quantiles": (quantiles, "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p500, round(quantile_cont(l_extendedprice, 0.975), 6) AS p975 FROM lineitem GROUP BY 1"),
    "histogram": (histogram, "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1"),
    "interval_overlap": (overlap_pairs, "SELECT a.user_id, a.event_id AS one, b.event_id AS two, least(a.event_id % 97, b.event_id % 97) + 10 - greatest(a.event_id % 97, b.event_id % 97) AS overlap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE least(a.event_id % 97, b.event_id % 97) + 10 > greatest(a.event_id % 97, b.event_id % 97)"),
    "spearman": (rank_correlation, "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS y FROM part) SELECT round(corr(x, y), 6) AS rho FROM r"),
    "quantized_search": (lambda s, d: _score_only(search.quantized_exact(query_vectors(s, d), vectors(s, d), K)), None),
    "pca_search": (lambda s, d: _score_only(_pca_found(s, d)), None),
    "whitened_search": (lambda s, d: _score_only(search.whitened(query_vectors(s, d), vectors(s, d), K, 0.25)), None),
    "rabitq_search": (rabitq_search, None),
    "ivf_search": (ivf_search, None),
    "epsilon_net_search": (net_search, None),
    "merged_net_search": (merged_net_top, None),
    "ivf_pq_search": (ivf_pq_search, None),
    "ivf_rabitq_search": (ivf_rabitq_search, None),
    "ivf_rabitq_recall": (lambda s, d: recall_of(s, d, _cells_found), _RECALL),
    "ivf_pq_recall": (lambda s, d: recall_of(s, d, _shards_found), _RECALL),
    "pca_recall": (lambda s, d: recall_of(s, d, _pca_found), _RECALL),
    "oracle_probe": (oracle_probe, _q("SELECT nprobe, round(scanned, 6) AS scanned, round(top_1, 6) AS top_1, round(top_10, 6) AS top_10, round(r_precision, 6) AS r_precision FROM cov JOIN scan USING (nprobe) JOIN ce USING (nprobe)", _PROBE)),
    "window_cover": (window_cover, _q("SELECT query_id, contig, s, vector_id, overlap, contains FROM x", _COVER)),
    "window_recall": (window_recall, _q("SELECT query_id, accession, " + ", ".join(f"coalesce({f} <= {k}, false) AS {c}_{k}" for k in (3, 10) for c, f in (("acc", "acc"), ("win", "win"), ("contain", "con"))) + " FROM (SELECT DISTINCT query_id, accession FROM p) LEFT JOIN (SELECT f.query_id, f.accession, min(rank) AS acc, min(rank) FILTER (w2) AS win, min(rank) FILTER (c2) AS con FROM f LEFT JOIN (SELECT query_id, accession, vector_id, bool_or(overlap >= 64) AS w2, bool_or(contains) AS c2 FROM x GROUP BY ALL) z USING (query_id, accession, vector_id) GROUP BY ALL) USING (query_id, accession) WHERE query_id IN (SELECT query_id FROM f)", f"{_HITS}, {_COVER}, f AS (SELECT query_id, rank, vector_id, w.accession FROM h JOIN w USING (vector_id))")),
    "decoy_pairs": (decoy_pairs, "WITH r AS (SELECT event_id AS row_id, event_type AS rate, user_id AS query_id FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY rate ORDER BY md5('7:' || query_id), query_id, row_id) - 1 AS place, count(*) OVER (PARTITION BY rate) AS n FROM r), s AS (SELECT rate, max(c) AS step FROM (SELECT rate, query_id, count(*) AS c FROM r GROUP BY ALL) GROUP BY 1) SELECT x.row_id, CASE WHEN y.query_id <> x.query_id THEN y.row_id END AS decoy FROM o x JOIN s USING (rate) JOIN o y ON y.rate = x.rate AND y.place = (x.place + step) % x.n"),
    "alignment_audit": (audit, "SELECT rate, relevant, count(*) AS n_hits, round(avg(CAST(c >= 0.5 AS INT)), 6) AS pass_share, round(avg(CAST(i >= 0.75 AS INT)) FILTER (c >= 0.5), 6) AS share_75, round(avg(CAST(i >= 0.95 AS INT)) FILTER (c >= 0.5), 6) AS share_95, round(quantile_cont(i, 0.5) FILTER (c >= 0.5), 6) AS id_median, round(quantile_cont(i, 0.1) FILTER (c >= 0.5), 6) AS id_p10, round(quantile_cont(i, 0.9) FILTER (c >= 0.5), 6) AS id_p90 FROM (SELECT l_returnflag AS rate, l_linenumber = 1 AS relevant, 1 - 4 * CAST(l_discount AS DOUBLE) AS i, CAST(l_quantity AS DOUBLE) / 50 AS c FROM lineitem) GROUP BY 1, 2"),
    "audit_bins": (audit_bins, "SELECT rate, count(*) FILTER (c < 0.5) AS fail, " + ", ".join(f"count(*) FILTER (c >= 0.5 AND i > {low} AND i <= {high if high < 1 else 9}) AS under_{round(100 * high)}" for low, high in zip((-9, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95), (0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1))) + " FROM (SELECT l_returnflag AS rate, 1 - 4 * CAST(l_discount AS DOUBLE) + 0.001 AS i, CAST(l_quantity AS DOUBLE) / 50 AS c FROM lineitem) GROUP BY 1"),
    "model_names": (model_names, "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority[1] <> '5' THEN substr(o_orderpriority, 3, 4) END AS base, CASE o_orderstatus WHEN 'F' THEN 'ivfpq8' WHEN 'O' THEN 'exact8' ELSE 'rabitq8' END AS index, o_orderkey % 5 / 20.0 AS rate FROM orders) SELECT o_orderkey, concat_ws('/', base || '-v1@9', index, 's') AS model, CASE WHEN base = 'HIGH' THEN 'High' ELSE coalesce(base, index) END || CASE WHEN index = 'ivfpq8' THEN '+PQ' WHEN index = 'rabitq8' THEN '+1bit' ELSE '' END AS shown, CASE WHEN index = 'exact8' THEN 'whole' END AS strict, printf('mut%.2f', CAST(rate AS DOUBLE)) AS rate, CAST(printf('%.2f', CAST(rate AS DOUBLE)) AS DOUBLE) AS back FROM o"),
    "line_labels": (line_labels, "SELECT CASE WHEN l_extendedprice <= 1000 THEN 'low' WHEN l_extendedprice <= 20000 THEN 'middle' WHEN l_extendedprice <= 50000 THEN 'high' ELSE 'top' END AS label, count(*) AS n, count(*) FILTER ((l_linenumber <> 3 AND l_returnflag = 'R') OR l_quantity > 45 OR l_discount > 0.09) AS n_flagged FROM lineitem GROUP BY 1"),
    "event_runs": (event_runs, "SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY user_id, event_type, g"),
    "first_orders": (first_orders, "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 25"),
    "sampled_orders": (sampled_orders, "SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 100"),
    "list_unions": (list_unions, "WITH b AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_suppkey) AS p FROM lineitem), u AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(p)) AS p FROM b GROUP BY 1, 2) SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY p) AS suppliers, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY p) FILTER (p <= 3) AS first_three, (SELECT count(*) FROM lineitem k WHERE k.l_orderkey = u.l_orderkey AND l_extendedprice < 30000) AS n_kept FROM u GROUP BY 1"),
    "bootstrap_margins": (lambda s, d: rounded(bootstrap_table(s, d), "mean", "margin"), _q("SELECT bin, n, round(mean, 6) AS mean, round(margin, 6) AS margin FROM rt JOIN ru USING (bin)", _BOOT)),
    "binned_margins_wide": (bootstrap_wide, _q("SELECT 'exact' AS model, " + ", ".join(f"max(t) FILTER (bin = '{b}') AS \"{b}\"" for b in ("overall", "label0", "label1")) + " FROM (SELECT bin, printf('%.3f±%.3f', mean, margin) AS t FROM rt JOIN ru USING (bin))", _BOOT)),
    "prefix_sweep": (prefix_sweep, _sweep_sql()),
    "vector_multipliers": (vector_multipliers, _q("SELECT " + ", ".join(f"round({_windows_sql(w, s)} / {_windows_sql(256, 106)}, 6) AS w{w}_s{s}" for w, s in ((128, 64), (256, 256), (512, 128))) + " FROM c", _CONTIGS)),
    "ratio_table": (ratio_table, "SELECT CASE WHEN r <= 0.2 THEN 'r0' WHEN r <= 0.4 THEN 'r2' WHEN r <= 0.6 THEN 'r4' ELSE 'r6' END AS ratio, count(*) AS n, round(avg(l_quantity), 6) AS mean_score, round(avg(CAST(l_quantity > l_extendedprice / 2000 AS INT)), 6) AS above_floor FROM (SELECT *, CAST(l_tax AS DOUBLE) * 10 AS r FROM lineitem) GROUP BY 1"),
    "complexity": (complexity, _q("SELECT d.contig, round(coalesce(dust, 0), 6) AS dust, longest_run, round(top_share, 6) AS top_share FROM (SELECT contig, CAST(max(n) AS BIGINT) AS longest_run FROM (SELECT contig, count(*) AS n FROM (SELECT contig, c, i - row_number() OVER (PARTITION BY contig, c ORDER BY i) AS g FROM ch) GROUP BY contig, c, g) GROUP BY 1) d JOIN (SELECT contig, max(n) / sum(n) AS top_share FROM (SELECT contig, c, count(*) AS n FROM ch GROUP BY 1, 2) GROUP BY 1) t USING (contig) LEFT JOIN (SELECT contig, CASE WHEN sum(n) > 1 THEN sum(n * (n - 1) / 2) / (sum(n) - 1) ELSE 0 END AS dust FROM (SELECT contig, substr(sequence, i, 3) AS w, count(*) AS n FROM (SELECT contig, sequence, unnest(range(1, length(sequence) - 1)) AS i FROM c) GROUP BY 1, 2) GROUP BY 1) u USING (contig)", f"{_CONTIGS}, ch AS (SELECT contig, i, substr(sequence, i, 1) AS c FROM (SELECT contig, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM c))")),
    "length_survival": (length_survival, "WITH p AS (SELECT item_id AS parent_id, text AS s FROM benchmark WHERE length(text) >= 100), a AS (SELECT parent_id, substr(s, 1 + CAST('0x' || substr(md5('0:' || parent_id), 1, 8) AS BIGINT) % (length(s) - 99), 100) AS w FROM p), l AS (SELECT parent_id, w, unnest([24, 48, 96]) AS length FROM a), v AS (SELECT 0.0::DOUBLE AS rate, 0 AS draw UNION ALL SELECT 0.1, 0 UNION ALL SELECT 0.1, 1), c AS (SELECT parent_id, length, rate, draw, i, substr(w, i + 1, 1) AS c FROM (SELECT *, unnest(range(length)) AS i FROM l, v)), m AS (SELECT *, strpos('abcdefghijklmnopqrstuvwxyz', c) AS at_, concat_ws(':', '0', parent_id, CAST(round(rate * 10000) AS INT), draw) AS key FROM c), n AS (SELECT parent_id, length, rate, draw, i, CASE WHEN rate > 0 AND at_ > 0 AND CAST('0x' || substr(md5(key || ':x:' || i), 1, 8) AS BIGINT) < rate * 4294967296 THEN substr('abcdefghijklmnopqrstuvwxyz', CAST((at_ + CAST('0x' || substr(md5(key || ':' || i), 1, 8) AS BIGINT) % 25) % 26 + 1 AS INT), 1) ELSE c END AS c FROM m), r AS (SELECT parent_id, length, rate, draw, string_agg(c, '' ORDER BY i) AS s FROM n GROUP BY ALL), k AS (SELECT parent_id, length, rate, draw, substr(s, i, 11) AS w, count(*) AS n FROM (SELECT *, unnest(range(1, length(s) - 9)) AS i FROM r) GROUP BY ALL), h AS (SELECT DISTINCT item_id, substr(text, i, 11) AS w FROM (SELECT item_id, text, unnest(range(1, length(text) - 9)) AS i FROM benchmark)), f AS (SELECT parent_id, length, rate, draw, item_id, row_number() OVER (PARTITION BY parent_id, length, rate, draw ORDER BY sum(n) DESC, 'item' || item_id) AS rank FROM k JOIN h USING (w) GROUP BY parent_id, length, rate, draw, item_id QUALIFY rank <= 5) SELECT r.length, r.rate, count(*) AS n_reads, round(avg(CAST(coalesce(rank <= 1, false) AS INT)), 6) AS found_1, round(avg(CAST(coalesce(rank <= 5, false) AS INT)), 6) AS found_5 FROM r LEFT JOIN f ON f.parent_id = r.parent_id AND f.length = r.length AND f.rate = r.rate AND f.draw = r.draw AND f.item_id = r.parent_id GROUP BY 1, 2"),
    "near_vectors": (near_vectors, _q("SELECT query_id, vector_id, round(s, 6) AS score FROM (SELECT query_id, vector_id, list_inner_product(q.e, v.e) AS s FROM q, v) WHERE s >= 0.35", _V)),
    "validation": (validation, _q("SELECT rate, count(*) AS n_queries, round(avg(v), 6) AS recall FROM (SELECT query_id, CAST(sum(CASE WHEN rn <= 10 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS v FROM j GROUP BY 1) JOIN q USING (query_id) GROUP BY 1", _RUN_JUDGED)),
    "rank_ceiling": (rank_ceiling, _q("SELECT query_id, round(CAST(sum(CASE WHEN pl <= n_rel AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel), 6) AS r_precision FROM (SELECT j1.query_id, j1.rel, j1.n_rel, z.pl, w.score FROM j j1 JOIN z USING (query_id, accession) JOIN (SELECT query_id, rn, score FROM j) w ON w.query_id = z.query_id AND w.rn = z.pl) GROUP BY 1", _JUDGED + ", nz AS (SELECT query_id, accession, max(s) AS s FROM (SELECT query_id, v.accession, list_inner_product(list_reverse(q.e), v.e) AS s, vector_id FROM q, v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) <= 10) GROUP BY ALL), z AS (SELECT j.query_id, j.accession, row_number() OVER (PARTITION BY j.query_id ORDER BY nz.s DESC NULLS LAST, CASE WHEN nz.s IS NULL THEN rn END, j.accession) AS pl FROM j LEFT JOIN nz USING (query_id, accession))")),
    "whitened_sweep": (whitened_sweep, None),
    "probe_sweep": (probe_sweep, None),
    "build_differences": (build_differences, "SELECT count(*) FILTER (vec_id % 5 = 0) AS n_alone, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 2 = 1) AS n_equal, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 2 = 0) AS n_apart FROM embeddings"),
    "order_differences": (order_differences, "SELECT count(*) FILTER (o_orderstatus = 'P') AS only_one, CAST(0 AS BIGINT) AS only_two, round(max(CASE WHEN o_orderstatus <> 'P' AND o_custkey % 7 = 0 THEN 0.25 ELSE 0 END), 6) AS diff_price FROM orders"),
    "alignment_search": (aligned_reads, None),
    "hard_negatives": (hard_negatives, None),
    "contained_items": (contained_items, None),
    "epsilon_net_cover": (net_cover, "SELECT 'acc' || label AS accession, count(*) AS n_rows, true AS smaller, true AS covered FROM embeddings GROUP BY 1"),
    "hit_contigs": (hit_contigs, None),
    "binned_report": (recall_by_label, _q("SELECT b.bin, count(*) AS n_queries, count(x.recall) AS n_scored, round(avg(x.recall), 6) AS mean FROM (SELECT query_id, unnest(['label' || label, 'all']) AS bin FROM q) b LEFT JOIN (SELECT query_id, CAST(sum(CASE WHEN rn <= 3 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) AS recall FROM j GROUP BY 1) x USING (query_id) GROUP BY 1", _JUDGED)),
    "paired_deltas": (recall_deltas, _q("SELECT query_id, round(CAST(sum(CASE WHEN rn <= 5 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel) - CAST(sum(CASE WHEN rn <= 3 AND score > -2 THEN rel ELSE 0 END) AS DOUBLE) / max(n_rel), 6) AS delta FROM j GROUP BY 1", _JUDGED)),
    "training_pairs": (training_pairs, None),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
