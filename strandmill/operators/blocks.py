"""Rows in blocks: what Spark moves is a block of vectors, what a task computes is a matrix product.

``pack`` turns consecutive rows into one row whose columns are arrays, and vectors into
bytes. ``scan`` lets every block of queries meet every block of vectors: up to
``BROADCAST_QUERIES`` queries are broadcast as blocks and the vectors stay where they
are read; more are dealt to tiles, a slice of the vectors and a group of the queries
each. A task holds one tile, whose size is bounded, and no pair of blocks is a row, so
neither the plan nor the driver nor a task grows with their number. Each step of Python
in a stage has a worker of its own for every core, so a stage has one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandmill.functions import vectors as fv

#: Rows of a block of vectors and of queries, and blocks of either of a tile at most.
ROWS, QUERIES, SLICE = 1024, 256, 64
BROADCAST_QUERIES = 1024


def pack(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """(by, n, columns): up to ``rows`` consecutive rows of equal ``by`` as one; float lists, all of one length, become bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    lists = [c for c in df.columns if c not in by and kinds[c] == "array<float>"]
    rest = [c for c in df.columns if c not in by and c not in lists]
    schema = [f"{c} {kinds[c]}" for c in by] + ["n int"] + [f"{c} array<{kinds[c]}>" for c in rest] + [f"{c} binary" for c in lists]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        n = t.num_rows
        out = [t.column(c).chunk(0).slice(0, 1) for c in by] + [pa.array([n], pa.int32())]
        out += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(t.column(c).chunks)) for c in rest]
        out += [pa.array([np.ascontiguousarray(np.concatenate([fv.matrix(x) for x in t.column(c).chunks])).tobytes()], pa.binary()) for c in lists]
        return pa.RecordBatch.from_arrays(out, [*by, "n", *rest, *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, key = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            changes = np.zeros(b.num_rows - 1, bool)
            for c in by:
                x = b.column(c).to_numpy(zero_copy_only=False)
                changes |= x[1:] != x[:-1]
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), b.num_rows]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = [b.column(c)[lo].as_py() for c in by]
                if held and own != key:
                    yield block(held)
                    held, count = [], 0
                key = own
                while lo < hi:
                    size = min(rows - count, hi - lo)
                    held.append(b.slice(lo, size))
                    lo, count = lo + size, count + size
                    if count == rows:
                        yield block(held)
                        held, count = [], 0
        if held:
            yield block(held)

    return df.mapInArrow(run, ", ".join(schema))


def unpack(b: pa.RecordBatch, i: int, prefix: str = "") -> pa.RecordBatch:
    """The rows of block i of a batch, of the columns that start with the prefix; without one, of those that don't start with ``q_`` or ``m_``."""
    n = b.column(f"{prefix}n")[i].as_py()
    names, out = [], []
    for c, kind in zip(b.schema.names, b.schema.types, strict=True):
        if not c.startswith(prefix) or c == f"{prefix}n" or (not prefix and c.startswith(("q_", "m_"))):
            continue
        if pa.types.is_list(kind):
            out.append(b.column(c)[i].values)
        elif pa.types.is_binary(kind):
            out.append(fv.lists(np.frombuffer(b.column(c)[i].as_buffer(), np.float32).reshape(n, -1)))
        else:
            continue
        names.append(c.removeprefix(prefix))
    return pa.RecordBatch.from_arrays(out, names)


def spread(queries: DataFrame, vectors: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Blocks of up to ``BROADCAST_QUERIES`` queries, sent to all tasks, meet the vectors as a task reads them.

    ``make(queries, None)`` gives an object with ``add(vectors)`` and ``result()``, which yields batches.
    It holds Spark's batches of rows one at a time, however large the partition is.
    """
    rows, asked = ROWS, queries.toArrow().combine_chunks().to_batches(max_chunksize=QUERIES)  # as few as a broadcast join takes
    sent = queries.sparkSession.sparkContext.broadcast([b for b in asked if b.num_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            if b.num_rows and not held:
                held = [make(q, None) for q in sent.value]
            for lo in range(0, b.num_rows, rows):
                for x in held:
                    x.add(b.slice(lo, rows))
        for x in held:
            yield from x.result()

    return vectors.mapInArrow(run, schema)


def query_blocks(queries: DataFrame, rows: int, *by: str) -> DataFrame:
    """Packed queries, with columns ``q_..`` but for ``by``, and the number q_block."""
    packed = pack(queries, rows, *by)
    return packed.select(*by, *[F.col(c).alias(f"q_{c}") for c in packed.columns if c not in by], F.monotonically_increasing_id().alias("q_block"))


def meet(packed: DataFrame, asked: DataFrame, key: tuple[str, ...], make: Callable, schema: str) -> DataFrame:
    """Blocks of vectors and of queries of equal ``key``, met in one task; callers bound what a key has.

    ``make(queries, row)`` is as for ``spread``; ``row`` gives the other columns of the block of queries.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [unpack(b, i) for b in vectors.to_batches() for i in range(b.num_rows)]
        out: list[pa.RecordBatch] = []
        for b in queries.to_batches() if parts else ():
            for i in range(b.num_rows):
                own = make(unpack(b, i, "q_"), lambda c, b=b, i=i: b.column(c)[i])
                for p in parts:
                    own.add(p)
                out += own.result()
        return pa.Table.from_batches(out) if out else kinds.empty_table()

    return packed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, schema)


def by_cell(packed: DataFrame, asked: DataFrame, by: tuple[str, ...], n: int, large: int, make: Callable, schema: str, beside: DataFrame | None = None) -> DataFrame:
    """``meet`` within cells: packed(by, block, ..) of a stored table, asked(by, query_id, embedding) of ``n`` queries.

    A cell of more than ``large`` blocks is dealt to several tasks, and so are its queries beyond those of a tile.
    ``make`` can also ask for the columns of ``beside``, a row for each value of the first of ``by``.
    """
    groups = max(1, -(-n // (QUERIES * SLICE)))
    dealt = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    dealt = query_blocks(dealt.repartitionByRange(*by, "group", F.xxhash64("query_id")).sortWithinPartitions(*by, "group"), QUERIES, *by, "group")
    if beside is not None:
        dealt = dealt.join(beside, by[0])
    size = packed.groupBy(*by).agg(F.ceil(F.count("*") / large).cast("int").alias("parts")).where("parts > 1")  # large cells only
    packed = packed.join(size, list(by), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"), F.lit(0))).drop("parts", "block")
    dealt = dealt.join(size, list(by), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    packed = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return meet(packed, dealt, (*by, "part", "group"), make, schema)


def tiles(vectors: int, queries: int, least: int) -> tuple[int, int]:
    """Slices of the vectors and groups of the queries: tiles of bounded size, ``least`` of them if there are rows enough; what adds fewer copies is cut."""
    s, g = max(1, -(-vectors // (ROWS * SLICE))), max(1, -(-queries // (QUERIES * SLICE)))
    while s * g < least:
        if 2 * s * ROWS <= vectors and (queries * s <= vectors * g or 2 * g * QUERIES > queries):
            s *= 2
        elif 2 * g * QUERIES <= queries:
            g *= 2
        else:
            break
    return s, g


def scan(queries: DataFrame, vectors: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Every block of queries and every block of vectors, met one by one (see ``spread``)."""
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        return spread(queries, vectors, make, schema)
    slices, groups = tiles(vectors.count(), n, 3 * queries.sparkSession.sparkContext.defaultParallelism)
    packed = pack(vectors.repartition(slices), ROWS).withColumn("slice", F.spark_partition_id())
    asked = query_blocks(queries.repartition(groups), QUERIES).withColumn("group", F.spark_partition_id())
    packed = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return meet(packed, asked, ("slice", "group"), make, schema)
