"""Expressions over tables of results: names of runs, labels, lists and runs of rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def model_key(encoder: Column, index: Column, search: Column) -> Column:
    """encoder/index/search, without the encoder where there is none."""
    return F.concat_ws("/", encoder, index, search)


def mapped(value: Column, names: dict[str, str], strict: bool = False) -> Column:
    """The name of a value; one without a name stays, or is null if ``strict``."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    found = F.create_map(*pairs)[value] if pairs else F.lit(None)
    return found if strict else F.coalesce(found, value)


def display_name(encoder: Column, index: Column, names: dict[str, str], codes: dict[str, str]) -> Column:
    """What a table shows for a run: the encoder's name up to "@" and "-", or the index without one, and the kind of codes.

    codes: a stretch of the index's name -> what it adds; the first that fits is taken.
    """
    base = mapped(F.coalesce(F.regexp_extract(encoder, r"^([^@-]*)", 1), index), names)
    out = None
    for part, added in codes.items():
        out = (F if out is None else out).when(index.contains(part), F.concat(base, F.lit(added)))
    return base if out is None else out.otherwise(base)


def rate_name(rate: Column) -> Column:
    return F.format_string("mut%.2f", rate)


def rate_of(name: Column) -> Column:
    """The rate in a name, null if it has none."""
    found = F.regexp_extract(name, r"mut(\d+\.\d+)", 1)
    return F.when(found != "", found.cast("double"))


def any_of(*flags: Column) -> Column:
    """Whether one of the flags is set; a null one isn't."""
    return reduce(or_, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval, closed above, that a value lies in; one label more than edges. Null has none."""
    if len(labels) != len(edges) + 1 or sorted(set(edges)) != list(edges):
        raise ValueError("edges must ascend and have one label more")
    out = F.when(value.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value <= edge, label)
    return out.otherwise(labels[-1])


def head(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def without_nulls(items: Column, field: str) -> Column:
    """Items whose field isn't null."""
    return F.filter(items, lambda x: x[field].isNotNull())


def ordered_union(*lists: Column) -> Column:
    """Items of all lists, each where it comes first."""
    return F.array_distinct(F.concat(*lists))


def compression_ratio(bytes_: Column, base_bytes: Column) -> Column:
    """How many times smaller than the base; null for what takes no room."""
    return F.when(bytes_ > 0, base_bytes / bytes_)


def merged_runs(df: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """(by, key, first, n): each run of rows of equal key, in order within by, with the first row's order columns."""
    rows = Window.partitionBy(*by).orderBy(*order)
    new = F.lag(F.lit(1)).over(rows).isNull() | ~F.lag(key).over(rows).eqNullSafe(F.col(key))
    runs = df.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run", key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).drop("_run")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of lowest hash of the key, the same in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
