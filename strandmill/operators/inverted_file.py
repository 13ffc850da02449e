"""Inverted files of coded vectors, kept as tables: 1-bit codes by cell, product codes by shard and cell.

An index is a folder of Parquet tables. Codes are stored as blocks of one cell, so a
search lets blocks meet: the queries that probe a cell, packed, and the cell's codes,
packed, and a task scores them as matrices. Those that the codes let through are scored
exactly from the vectors, which lie beside the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandmill.functions import vectors as fv
from strandmill.operators import blocks, search
from strandmill.operators.hits import top_k

#: Blocks of a cell that one task scores against all queries of that cell; a larger cell is dealt to several tasks.
CELL_BLOCKS = 64
#: Bytes of models that are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64_000_000
#: Rows of a shard that meet its model in one call.
CODED_ROWS = 16_384


def _by_cell(df: DataFrame, *by: str) -> DataFrame:
    """Rows in ranges of cells, sorted; a large cell lies in several ranges."""
    return df.repartitionByRange(*[F.col(c) for c in by], "vector_id").sortWithinPartitions(*by, "vector_id")


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class _Head:
    """A block of queries and the ``k`` best rows of each by estimates."""

    def __init__(self, asked: pa.RecordBatch, k: int, estimate):
        self.estimate = estimate
        self.own, self.q, self.best = asked.column("query_id"), fv.matrix(asked.column("embedding")), search._Best(k, len(asked))

    def add(self, part: pa.RecordBatch) -> None:
        self.best.add(self.estimate(part), part.column("vector_id").to_numpy(), part.column("accession"))

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.best.held:
            q, score, vid, accession = self.best.best()
            yield pa.RecordBatch.from_arrays([self.own.take(pa.array(q)), accession, pa.array(score), pa.array(vid)], ["query_id", "accession", "score", "vector_id"])


# --- 1-bit codes by cell ----------------------------------------------------------


def residual_codes(assigned: DataFrame, centroids: np.ndarray, seed: int = 0) -> DataFrame:
    """(cell, vector_id, accession, code, gain, embedding): signs of the turned residual, and the factor from a product with the signs to one with the residual."""
    turn = fv.rotation(centroids.shape[1], seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = fv.matrix(b.column("embedding")) - centroids[b.column("cell").to_numpy()]
                y = x @ turn
                gain = (x * x).sum(1) / np.maximum(np.abs(y).sum(1), 1e-30)
                yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("vector_id"), b.column("accession"), pa.array([c.tobytes() for c in fv.pack_signs(y)], pa.binary()), pa.array(gain.astype(np.float32)), b.column("embedding")], ["cell", "vector_id", "accession", "code", "gain", "embedding"])

    return assigned.select("cell", "vector_id", "accession", "embedding").mapInArrow(run, "cell int, vector_id long, accession string, code binary, gain float, embedding array<float>")


def build_cells(vectors: DataFrame, path: str, cells: int, rounds: int = 10, seed: int = 0) -> None:
    """Writes ``centroids``, ``codes`` and ``vectors``, the last two in a folder for each cell.

    The centroids, ``cells`` of them, come from all rows; they are what the driver and the tasks hold.
    """
    spark = vectors.sparkSession
    centroids = search.kmeans(vectors, cells, rounds, seed)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, embedding array<float>").coalesce(1).write.parquet(f"{path}/centroids")
    _by_cell(search.assign_cells(vectors.select("vector_id", "accession", "embedding"), centroids), "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    assigned = spark.read.parquet(f"{path}/vectors")
    packed = blocks.pack(_by_cell(residual_codes(assigned, centroids, seed), "cell"), blocks.ROWS, "cell")
    packed.withColumn("block", F.monotonically_increasing_id()).write.partitionBy("cell").parquet(f"{path}/codes")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # a row for each cell, a parameter of the index
    return np.array([r["embedding"] for r in rows], np.float32)


def _only(df: DataFrame, cells: list[int]) -> DataFrame:
    """Rows of those cells; a filter on the folder, so that no other is listed or read."""
    return df.where(F.col("cell").isin(cells)) if cells else df.limit(0)


class _Signs:
    """Estimates of a block of queries for codes of one cell."""

    def __init__(self, q: np.ndarray, center: np.ndarray, turn: np.ndarray):
        self.base, self.turned = q @ center, q @ turn

    def __call__(self, part: pa.RecordBatch) -> np.ndarray:
        signs = fv.unpack_signs(_bytes(part.column("code")))
        return (self.base[:, None] + self.turned @ signs.T * part.column("gain").to_numpy()).astype(np.float64)


def _searched(queries: DataFrame, k: int, head: int, run) -> DataFrame:
    """By the codes alone, or with a head by exact scores of those that they let through."""
    if head:
        return search.by_estimates(queries, k, head, run)
    kind = queries.schema["query_id"].dataType.simpleString()
    return top_k(run(queries, lambda asked, e: _Head(asked, k, e), f"query_id {kind}, accession string, score double, vector_id long"), k)


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, nprobe: int, head: int, seed: int = 0) -> DataFrame:
    """The k best of the ``nprobe`` nearest cells: what the codes let through, the ``head`` best by codes at least, scored exactly (``search.by_estimates``); head 0 gives the estimates."""
    centroids = _centroids(spark, path)
    turn = fv.rotation(centroids.shape[1], seed)

    def run(own: DataFrame, judge, schema: str) -> DataFrame:
        asked = search.probes(own, centroids, nprobe)
        probed = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # at most a row for each cell
        codes = _only(spark.read.parquet(f"{path}/codes"), probed).withColumn("cell", F.col("cell").cast("int"))
        make = lambda a, at: judge(a, _Signs(fv.matrix(a.column("embedding")), centroids[at("cell").as_py()], turn))
        return blocks.by_cell(codes, asked.select("cell", "query_id", "embedding"), ("cell",), own.count(), CELL_BLOCKS, make, schema)

    return _searched(queries, k, head, run)


# --- product codes by shard and cell ------------------------------------------------


def _means(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator, nearest) -> np.ndarray:
    """Lloyd's means of x from n of its rows; a mean without rows stays."""
    c = x[rng.permutation(len(x))[: min(n, len(x))]].astype(np.float64)
    for _ in range(rounds):
        to = nearest(x, c)
        count, total = np.bincount(to, minlength=len(c)), np.zeros(c.shape)
        np.add.at(total, to, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """In pieces of rows, so that the distances of a sample aren't held at once."""
    own = (c * c).sum(1)[None, :]
    return np.concatenate([(own - 2 * x[i : i + 8192] @ c.T).argmin(1) for i in range(0, max(len(x), 1), 8192)])


def _largest(dealt: DataFrame) -> int:
    """Rows of the largest shard."""
    return dealt.groupBy("shard").count().agg(F.max("count")).first()[0] or 1


def train_shards(dealt: DataFrame, lists: int, parts: int, codes: int, sample: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(shard, dims, centroids, books) of dealt(shard, vector_id, embedding), each shard's in a task of its own.

    A shard learns from about ``sample`` of its rows, taken by hash; a task holds no more.
    """
    most = _largest(dealt)
    share = min(1.0, sample / most)
    drawn = dealt.where(F.pmod(F.xxhash64("vector_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        x = fv.matrix(t.sort_by("vector_id").column("embedding"))
        if x.shape[1] % parts:
            raise ValueError("the dimension must be a multiple of parts")
        rng = np.random.default_rng([seed, key[0].as_py()])
        c = _means(x, lists, rounds, rng, _nearest)
        left = x - c[_nearest(x, c)]
        books = np.concatenate([np.pad(b := _means(p, codes, rounds, rng, _nearest), ((0, codes - len(b)), (0, 0)), "edge").ravel() for p in np.split(left, parts, axis=1)])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([x.shape[1]], pa.int32()), "centroids": pa.array([c.tobytes()], pa.binary()), "books": pa.array([books.astype(np.float32).tobytes()], pa.binary())})

    return drawn.select("shard", "vector_id", "embedding").groupBy("shard").applyInArrow(fit, "shard int, dims int, centroids binary, books binary")


class _Model:
    def __init__(self, dims: int, parts: int, centroids: pa.Scalar | None, books: pa.Scalar | None):
        self.c = None if centroids is None else np.frombuffer(centroids.as_buffer(), np.float32).reshape(-1, dims)
        self.books = None if books is None else np.frombuffer(books.as_buffer(), np.float32).reshape(parts, -1, dims // parts)


def _by_model(rows: DataFrame, models: DataFrame, key: str, pieces: int, run, schema: str) -> DataFrame:
    """Rows of a shard, dealt to ``pieces`` by a hash of ``key``, meet its model: ``run(shard, rows, model)`` gives a table."""
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int"))
    beside = models.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def met(own: pa.Table, model: pa.Table) -> pa.Table:
        return run(pa.array(np.full(len(own), model["shard"][0].as_py(), np.int32)), own, model) if len(own) and len(model) else empty

    return dealt.groupBy("shard", "piece").cogroup(beside.groupBy("shard", "piece")).applyInArrow(met, schema)


def _sized(models: DataFrame) -> DataFrame:
    size = models.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in models.columns if c in ("centroids", "books", "m_books")), F.lit(0))), F.lit(0))).first()[0]
    return F.broadcast(models) if size <= BROADCAST_BYTES else models


def build_shards(vectors: DataFrame, path: str, shards: int, lists: int, parts: int = 8, codes: int = 256, sample: int = 100_000, rounds: int = 10, seed: int = 0) -> None:
    """Writes ``models``, a row for each shard, and ``codes``, a folder for each shard with blocks sorted by cell.

    A shard is a range of vector ids with lists and codebooks of its own; every row is coded.
    """
    spark = vectors.sparkSession
    rows = (vectors.agg(F.max("vector_id")).first()[0] or 0) + 1
    dealt = vectors.withColumn("shard", F.floor(F.col("vector_id") * shards / rows).cast("int"))
    train_shards(dealt, lists, parts, codes, sample, rounds, seed).write.parquet(f"{path}/models")

    def encode(shard: pa.Array, rows: pa.Table, model: pa.Table) -> pa.Table:
        m, x = _Model(model["dims"][0].as_py(), parts, model["centroids"][0], model["books"][0]), fv.matrix(rows["embedding"])
        cell = _nearest(x, m.c)
        code = np.stack([_nearest(p, c) for p, c in zip(np.split(x - m.c[cell], parts, axis=1), m.books, strict=True)], axis=1).astype(np.uint8)
        return pa.table({"shard": shard, "cell": pa.array(cell.astype(np.int32)), "vector_id": rows["vector_id"], "accession": rows["accession"], "code": pa.array([c.tobytes() for c in code], pa.binary()), "embedding": rows["embedding"]})

    rows = dealt.select("shard", "vector_id", "accession", "embedding")
    coded = _by_model(rows, spark.read.parquet(f"{path}/models"), "vector_id", -(-_largest(dealt) // CODED_ROWS), encode, "shard int, cell int, vector_id long, accession string, code binary, embedding array<float>")
    blocks.pack(_by_cell(coded, "shard", "cell"), blocks.ROWS, "shard", "cell").withColumn("block", F.monotonically_increasing_id()).write.partitionBy("shard").parquet(f"{path}/codes")


class _Lookup:
    """Estimates from tables: a query's products with every codebook entry, added up by the bytes of a code."""

    def __init__(self, asked: pa.RecordBatch, books: np.ndarray):
        self.base = asked.column("base").to_numpy()
        self.table = np.stack([q @ b.T for q, b in zip(np.split(fv.matrix(asked.column("embedding")), len(books), axis=1), books, strict=True)])  # parts x queries x entries

    def __call__(self, part: pa.RecordBatch) -> np.ndarray:
        code, scores = _bytes(part.column("code")), np.repeat(self.base[:, None].astype(np.float64), len(part), axis=1)
        for m, t in enumerate(self.table):
            scores += t[:, code[:, m]]
        return scores


def shard_probes(queries: DataFrame, n: int, models: DataFrame, nprobe: int) -> DataFrame:
    """(shard, cell, query_id, base, embedding) of ``n`` queries: in every shard the lists of highest product, and that product."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(shard: pa.Array, asked: pa.Table, model: pa.Table) -> pa.Table:
        m = _Model(model["dims"][0].as_py(), 0, model["centroids"][0], None)
        s = fv.matrix(asked["embedding"]) @ m.c.T
        cell = np.argsort(-s, axis=1, kind="stable")[:, :nprobe]
        at = pa.array(np.arange(len(s) + 1, dtype=np.int32) * cell.shape[1])
        near = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (cell.astype(np.int32), np.take_along_axis(s, cell, 1))]
        return pa.table({"shard": shard, "query_id": asked["query_id"], "embedding": asked["embedding"], "cell": near[0], "base": near[1]})

    asked = queries.select("query_id", "embedding").crossJoin(F.broadcast(models.select(F.col("shard").alias("shard"))))  # a row for each shard
    found = _by_model(asked, models.select("shard", "dims", "centroids"), "query_id", max(1, -(-n // blocks.QUERIES)), run, f"shard int, query_id {kind}, embedding array<float>, cell array<int>, base array<float>")
    return found.select("shard", "query_id", "embedding", F.explode(F.arrays_zip("cell", "base")).alias("at")).select("shard", "at.cell", "query_id", "at.base", "embedding")


def search_shards(spark: SparkSession, path: str, queries: DataFrame, vectors: DataFrame | None, k: int, nprobe: int, head: int, parts: int = 8) -> DataFrame:
    """The k best over all shards, ``nprobe`` lists of each: what the codes let through, the ``head`` best by codes at least, scored exactly (``search.by_estimates``); head 0 gives the estimates.

    The index holds the vectors beside their codes, so ``vectors`` isn't read.
    """
    models = spark.read.parquet(f"{path}/models")
    codes = spark.read.parquet(f"{path}/codes").withColumn("shard", F.col("shard").cast("int"))
    books = _sized(models.select("shard", "dims", F.col("books").alias("m_books")))

    def run(own: DataFrame, judge, schema: str) -> DataFrame:
        make = lambda a, at: judge(a, _Lookup(a, _Model(at("dims").as_py(), parts, None, at("m_books")).books))
        n = own.count()
        return blocks.by_cell(codes, shard_probes(own, n, models, nprobe), ("shard", "cell"), n, CELL_BLOCKS, make, schema, books)

    return _searched(queries, k, head, run)


def recall(found: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """(n_queries, n_wanted, reached): whether that share of the wanted hits was found."""
    both = wanted.select("query_id", "vector_id").join(found.select("query_id", "vector_id").withColumn("hit", F.lit(1)), ["query_id", "vector_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_wanted"), (F.coalesce(F.sum("hit"), F.lit(0)) >= least * F.count("*")).alias("reached"))
