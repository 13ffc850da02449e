"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted into cells (source, language, topic) with their tokens. The
token weights of the cells are raked, one marginal after the other, until no source,
language or topic share is more than ``TOLERANCE`` (relative) off its target, or ``ROUNDS`` are over. Each document then stays with the
probability wanted tokens / present tokens of its cell, scaled to the token budget,
at most 1, decided by a hash of its doc_id so that a rerun keeps the same ones.

Targets: sources get equal shares of the smoothed kind (share to the power
``SOURCE_POWER``), languages ``LANGUAGE_SHARES`` with what is left over going to the other
languages by their tokens, topics their present shares. Targets of values that have no
tokens are spread over the rest.

Defined results: null source, language or topic are values of their own. A null or
empty text has one token, so that every document can be drawn. Rows with a null
doc_id share one draw. Repeated rows of a doc_id stay or go together. An empty table
gives an empty result. The input's columns travel as one struct, so none can clash with
those that the operator adds, and ``keep_mixed`` returns them untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, sized, table

SOURCE_POWER, BUDGET, ROUNDS, PASSES, TOLERANCE = 0.5, 0.6, 20, 50, 0.005
LANGUAGE_SHARES = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
MARGINALS = ("source", "lang", "topic")
SEED = 6


def topic():
    """A coarse topic from the text's form: table, symbol-laden, list of lines, prose."""
    text = F.coalesce("text", F.lit(""))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(text.rlike(r"[#*$%&]{3}"), "symbols").when(F.length(text) < 300, "short").otherwise("prose")


def tokens():
    """Whitespace words, one at least."""
    return F.greatest(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")), F.lit(1)).cast("long")


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, n_docs, mass): documents and tokens of each cell."""
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic().alias("topic"), tokens().alias("t")).groupBy(*MARGINALS).agg(F.count("*").alias("n_docs"), F.sum("t").alias("mass"))


def targets_of(cells: DataFrame, column: str) -> DataFrame:
    """(column, target): the wanted share of each value; the shares add up to 1."""
    values = cells.groupBy(column).agg(F.sum("mass").cast("double").alias("m"))
    if column == "source":
        wish = F.pow("m", F.lit(SOURCE_POWER))
    elif column == "lang":
        wish = F.lit(None).cast("double")
        for lang, share in LANGUAGE_SHARES.items():
            wish = F.when(F.col("lang") == lang, F.lit(share)).otherwise(wish)
        wish = F.coalesce(wish, F.lit(0.02))
    else:
        wish = F.col("m")
    wished = values.select(column, wish.alias("wish"))
    total = wished.agg(F.sum("wish").alias("total"))
    return wished.crossJoin(F.broadcast(total)).select(column, (F.col("wish") / F.col("total")).alias("target"))  # total is one row


def rake(cells: DataFrame, scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with weight, the wanted share of all tokens. Each round is written before the next; one number of each round comes to the driver."""
    targets = {c: scratch.save(targets_of(cells, c), f"target_{c}") for c in MARGINALS}

    def factors(state: DataFrame, c: str) -> DataFrame:
        now = state.groupBy(c).agg(F.sum("weight").alias("now")).withColumnRenamed(c, "value")
        return now.join(targets[c], F.col("value").eqNullSafe(F.col(c))).select("value", (F.col("target") / F.col("now")).alias("factor"))

    state = cells.withColumn("weight", F.col("mass").cast("double"))
    for step in range(rounds):
        for c in MARGINALS:
            state = state.join(factors(state, c), F.col(c).eqNullSafe(F.col("value"))).withColumn("weight", F.col("weight") * F.col("factor")).drop("value", "factor")
            state = scratch.save(state, f"round_{step}_{c}")  # the next step reads it twice
        gaps = [factors(state, c).agg(F.max(F.abs(F.col("factor") - 1)).alias("gap")) for c in MARGINALS[:-1]]  # the last one has just been met
        if (gaps[0].unionByName(gaps[1]).agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return state


def residual(raked: DataFrame) -> float:
    """How far the raked shares are from their targets, as the largest relative gap of a marginal's value."""
    worst = 0.0
    for c in MARGINALS:
        now = raked.groupBy(F.col(c).alias("value")).agg(F.sum("weight").alias("now"))
        total = raked.agg(F.sum("weight").alias("all"))
        gap = now.join(targets_of(raked, c), F.col("value").eqNullSafe(F.col(c))).crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("now") / F.col("all") / F.col("target") - 1)))  # total is one row
        worst = max(worst, gap.first()[0] or 0.0)
    return worst


def probabilities(raked: DataFrame, scratch: Scratch, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """Cells with prob: wanted tokens over present ones, scaled until those below 1 use up the budget (a share of all tokens).

    A pass may bring further cells to 1, which leaves more for the others; when none is brought there, the budget is met.
    """
    total = raked.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    state = raked.crossJoin(F.broadcast(total)).withColumn("ratio", F.col("weight") / F.col("all_weight") * F.col("all_mass") * budget / F.col("mass"))  # total is one row
    state = state.withColumn("prob", F.least("ratio", F.lit(1.0)))
    for step in range(passes):
        full = F.col("prob") >= 1
        left = state.agg((F.first("all_mass") * budget - F.coalesce(F.sum(F.when(full, F.col("mass"))), F.lit(0))).alias("left"), F.sum(F.when(~full, F.col("mass") * F.col("prob"))).alias("used"))
        grown = F.least(F.lit(1.0), F.col("prob") * F.greatest(F.lit(1.0), F.coalesce(F.col("left") / F.col("used"), F.lit(1.0))))
        state = state.crossJoin(F.broadcast(left)).withColumn("prob", F.when(full, 1.0).otherwise(grown)).drop("left", "used")  # left is one row
        state = scratch.save(state, f"pass_{step}")
        now = state.where("prob >= 1").count()
        if step and now == full_cells:
            break
        full_cells = now
    return scratch.save(state.select(*MARGINALS, "n_docs", "mass", "weight", "prob"), "probabilities")


def mix(docs: DataFrame, scratch: Scratch, budget: float = BUDGET) -> DataFrame:
    """(row, topic, n_tokens, prob, kept, residual) of every document; row has its own columns. residual, the same in all rows, says how closely the targets were met."""
    cells = scratch.save(cells_of(docs), "cells")
    raked = rake(cells, scratch)
    prob = probabilities(raked, scratch, budget).select(*[F.col(c).alias(f"of_{c}") for c in MARGINALS], "prob")
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic().alias("topic"), tokens().alias("n_tokens"), draw.alias("draw"))
    same = F.col("source").eqNullSafe(F.col("of_source")) & F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("topic") == F.col("of_topic"))
    return out.join(sized(prob), same).select("row", "topic", "n_tokens", "prob", (F.col("draw") < F.col("prob")).alias("kept"), F.lit(residual(raked)).alias("residual"))


def keep_mixed(docs: DataFrame, scratch: Scratch, budget: float = BUDGET) -> DataFrame:
    """The documents that stay, with their own columns."""
    return mix(docs, scratch, budget).where("kept").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, Scratch(spark, "mixing")).select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", "prob", "kept", "residual")
