"""FASTA files: read in splits by Spark's text reader, written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contigs(accession, contig_ord, contig_id, sequence); the accession is the name of the file's folder.

    Records end where a line begins with ">", so large files are read in splits. A record's number in
    its file is its place within a split and the counts of the splits before, a row for each split.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("split")
    text = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n>").select("value", place, F.monotonically_increasing_id().alias("at"))
    records = text.where(F.trim(F.translate("value", "\r\n>", "")) != "")
    splits = records.groupBy("split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.aggregate(F.filter("all", lambda x: (x["split"]["file"] == F.col("split.file")) & (x["split"]["block"] < F.col("split.block"))), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    files = splits.groupBy("split.file").agg(F.collect_list(F.struct("split", "first", "n")).alias("all"))  # a list of a file's splits
    starts = files.select(F.explode("all").alias("own"), "all").select("own.*", "all").select("split", "first", before.alias("before"))
    own = records.join(F.broadcast(starts), "split")  # a row for each split of the input
    head = F.regexp_extract("value", r"^>?([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+", "")
    return own.select(F.element_at(F.split("split.file", "/"), -2).alias("accession"), (F.col("before") + F.col("at") - F.col("first")).alias("contig_ord"), head.alias("contig_id"), body.alias("sequence"))


def write_fasta(df: DataFrame, path: str, name: str = "query_id", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(sequence)).alias("value")).write.text(path)
