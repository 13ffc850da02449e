"""Cutoffs against a plain recount and resampling; text tables against written files."""

import numpy as np
from pyspark.sql import functions as F

from strandmill.operators import evaluation as ev
from strandmill.schemas import MISS_SCORE
from strandmill.sources import text_tables as tt


RUNS = {"many": np.random.default_rng(3).normal(size=400).tolist(), "few": [0.3, 0.1, 0.1], "ties": [0.5] * 20 + [0.2] * 20, "misses": [0.4] + [MISS_SCORE] * 30}
RATES = [0.01, 0.05, 0.2]


def negatives(spark):
    return spark.createDataFrame([(m, x) for m, xs in RUNS.items() for x in xs], "model string, score double")


def test_cutoffs(spark):
    got = {(r["model"], r["fpr"]): r for r in ev.cutoffs(negatives(spark), RATES, ["model"]).collect()}
    assert set(got) == {(m, f) for m in RUNS for f in RATES}
    for (m, f), r in got.items():
        x, cut, may = np.array(RUNS[m]), r["cutoff"], int(np.floor(f * len(RUNS[m])))
        below = np.nextafter(cut, -np.inf)
        reach = lambda c, x=x: int((x >= c).sum())
        assert (x > cut).sum() < max(1, may)  # fewer than may pass lie above it
        assert reach(cut) <= may or (x == cut).sum() > 1  # more reach it only where scores tie
        assert reach(below) > reach(cut) or (x == cut).any()  # and no smaller value lets as few pass
        assert cut > MISS_SCORE  # a miss never passes
        assert r["n_negatives"] == len(x) and abs(r["realized"] - reach(cut) / len(x)) < 1e-12 and abs(r["no_hit_fraction"] - np.mean(x <= MISS_SCORE)) < 1e-12
    # by hand: none may pass, two tie with the second best, and all that may pass are misses
    assert got["few", 0.05]["cutoff"] == np.nextafter(0.3, 1) and got["few", 0.05]["realized"] == 0
    assert got["ties", 0.05]["cutoff"] == 0.5 and got["ties", 0.05]["realized"] == 0.5
    assert got["misses", 0.2]["cutoff"] == np.nextafter(-2.0, 0) and got["misses", 0.2]["realized"] == 1 / 31
    assert ev.cutoffs(negatives(spark).where("false"), RATES, ["model"]).count() == 0


def test_cutoff_intervals(spark):
    rng = np.random.default_rng(4)
    for r in ev.cutoff_intervals(negatives(spark), RATES, ["model"], 4000).collect():
        x = np.array(RUNS[r["model"]])
        place = max(1, int(np.floor(r["fpr"] * len(x))))
        draws = [np.sort(rng.choice(x, len(x)))[-place] for _ in range(4000)]
        low, high = np.percentile(draws, [2.5, 97.5])
        wide = 0.25 if r["model"] == "many" else 1e-9
        assert abs(r["ci_low"] - low) < wide and abs(r["ci_high"] - high) < wide


def test_true_positive_rates(spark):
    cuts = spark.createDataFrame([("a", 0.0, 0.05, 0.5), ("a", 0.1, 0.05, 0.4)], "model string, rate double, fpr double, cutoff double")
    pos = spark.createDataFrame([("a", 0.1, x) for x in (0.6, 0.45, 0.1, None)] + [("a", 0.2, 0.5), ("b", 0.1, 1.0)], "model string, rate double, best_relevant double")
    got = {(r["model"], r["rate"]): (r["n_positives"], r["tpr_fixed"], r["tpr_matched"]) for r in ev.true_positive_rates(pos, cuts, 0.0).collect()}
    assert got == {("a", 0.1): (4, 0.25, 0.5), ("a", 0.2): (1, 1.0, None), ("b", 0.1): (1, None, None)}


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:c\tLN:9\nq1\t0\tc\t11\t60\t8=2X\t*\t0\t0\tACGT\n q\t4\t*\t0\t0\t*\t*\n".replace("\n q", "\nq0") + "q1\t256\td\t5\t0\t9=1I\t*\nq2\t16\tc\t1\t9\t3=1X4=\t*\nq2\t272\ta\t1\t9\t7=\t*\n")
    records = tt.read_sam(spark, str(tmp_path / "a.sam"))
    assert records.count() == 4
    lengths = spark.createDataFrame([("q1", 10), ("q2", 8)], "query_id string, read_length long")
    best = {r["query_id"]: (r["target"], r["target_pos"], r["strand"], r["is_primary"], r["matches"], r["identity"]) for r in tt.best_alignments(records, lengths).collect()}
    assert best == {"q1": ("d", 4, "+", False, 9, 0.9), "q2": ("c", 0, "-", True, 7, 0.875)}
    (tmp_path / "a.tsv").write_text('x\t1\n"y\t\n')
    assert [tuple(r) for r in tt.read_tsv(spark, str(tmp_path / "a.tsv"), "k string, n int").collect()] == [("x", 1), ('"y', None)]
    (tmp_path / "a.jsonl").write_text('{"k": "x", "n": 2}\n{"k": "y"}\n')
    assert [tuple(r) for r in tt.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k string, n int").collect()] == [("x", 2), ("y", None)]
    (tmp_path / "a.txt").write_text(" one\n\ntwo \n")
    assert sorted(map(tuple, tt.read_list(spark, str(tmp_path / "a.txt")).collect())) == [(0, "one"), (1, "two")]
    runs = spark.createDataFrame([("q", 0.0), ("q", 0.1)], "query_id string, rate double")
    tt.write_runs(runs, str(tmp_path / "runs"))
    assert tt.read_runs(spark, str(tmp_path / "runs"), "query_id string, rate double").where("rate = 0.1").count() == 1
    tt.write_metrics(runs, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


def test_top_k_accuracy(spark):
    out = spark.createDataFrame([([0.1, 0.9, 0.5], 2), ([0.3, 0.3, 0.1], 0), ([0.3, 0.3, 0.1], 1)], "output array<double>, target int")
    got = ev.top_k_accuracy(out, [1, 2]).first()
    assert (round(got["top_1"], 4), got["top_2"]) == (33.3333, 100.0)


def test_substituted(spark):
    res = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.2)], "query_id string, accession string, score double")
    better = res.where("accession = 'a'").withColumn("score", F.lit(0.9))
    assert {(r["accession"], r["score"]) for r in ev.substituted(res, better).collect()} == {("a", 0.9), ("b", 0.2)}
