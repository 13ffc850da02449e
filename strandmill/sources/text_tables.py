"""Text tables through Spark's readers: separated columns, JSON lines, lists, alignments; and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import sequences as sq


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """Tab-separated columns with a declared schema. Quotes are plain characters, empty fields null."""
    return spark.read.csv(path, schema=schema, sep="\t", header=header, quote="", mode="FAILFAST")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, with a declared schema, so that the file is read once; a broken line raises."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value) of the lines that aren't blank, trimmed, numbered from 0 in the order of files and lines."""
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select(split.alias("split"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value")).where("value <> ''")
    within = lines.withColumn("n", F.row_number().over(Window.partitionBy("split").orderBy("at")) - 1)
    sizes = lines.groupBy("split").agg(F.count("*").alias("n"))
    starts = sizes.select("split", F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for each split
    return within.join(F.broadcast(starts), "split").select((F.col("start") + F.col("n")).alias("row_id"), "value")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped records: query_id, target, target_pos (from 0), strand, is_primary, matches, cigar.

    ``matches`` counts the "=" of the CIGAR string. Header lines and unmapped records
    are left out; secondary and supplementary records stay, with is_primary false.
    """
    f = F.split("value", "\t", 7)
    flag = f[1].cast("int")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(f[0].alias("query_id"), flag.alias("flag"), f[2].alias("target"), (f[3].cast("long") - 1).alias("target_pos"), f[5].alias("cigar"))
    has = lambda bits: F.col("flag").bitwiseAND(F.lit(bits)) != 0
    rows = rows.where(~has(0x4))
    return rows.select("query_id", "target", "target_pos", F.when(has(0x10), "-").otherwise("+").alias("strand"), (~has(0x900)).alias("is_primary"), sq.cigar_matches(F.col("cigar")).cast("long").alias("matches"), "cigar")


def best_alignments(records: DataFrame, lengths: DataFrame) -> DataFrame:
    """The record of each query with most matches, a primary one where they tie, then the first target and position.

    ``identity`` is matches by the read's length, from lengths(query_id, read_length).
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("matches"), F.desc("is_primary"), "target", "target_pos")
    best = records.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return best.join(lengths.select("query_id", "read_length"), "query_id").withColumn("identity", F.col("matches") / F.col("read_length"))


def write_metrics(df: DataFrame, path: str, form: str = "csv") -> None:
    """A report of few rows as one CSV or JSON part, replacing what is there."""
    if form not in ("csv", "json"):
        raise ValueError(f"unknown form {form}")
    writer = df.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.json(path)


def write_runs(results: DataFrame, path: str) -> None:
    """Results of several runs as one tree, a folder for each rate."""
    results.write.mode("overwrite").partitionBy("rate").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tree of results with a declared schema, the rate as a column; a rate that is filtered on is read alone."""
    return spark.read.schema(schema).parquet(path)
