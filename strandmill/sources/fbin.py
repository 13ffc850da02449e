"""fbin files as a Spark data source: two uint32 (rows, dimension), then rows of values.

    spark.dataSource.register(FbinSource)
    spark.read.format("fbin").load(path)                  # one file, or a folder with a manifest
    df.write.format("fbin").mode("append").save(folder)   # see ``write_fbin``

A folder holds pieces of about ``PIECE_BYTES`` and ``manifest.json``, which says where each
piece begins. Tasks read stretches of pieces at their byte offsets. Filters on ``vector_id`` choose the
pieces and stretches before anything is opened (``spark.sql.python.filterPushdown.enabled`` must be set, as
``read_fbin`` does for its session), and so do the options ``start`` and ``end``. Files are opened by pyarrow's file systems, in
driver and executors, so paths must be of a store that it knows (local, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from strandmill.functions import vectors as fv
from strandmill.operators import ordering

PIECE_BYTES = 10**9
HEADER = 8
#: Stored kinds of a value.
KINDS = {"fp32": np.float32, "fp16": np.float16, "bf16": np.uint16}


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def _read_at(path: str, offset: int, size: int) -> bytes:
    store, at = open_fs(path)
    with store.open_input_file(at) as f:
        return f.read_at(size, offset)


def _values(data: bytes, kind: str, dim: int) -> np.ndarray:
    x = np.frombuffer(data, KINDS[kind]).reshape(-1, dim)
    return (x.astype(np.uint32) << 16).view(np.float32) if kind == "bf16" else x.astype(np.float32)


def _stored(x: np.ndarray, kind: str) -> bytes:
    if kind == "fp32":
        return np.ascontiguousarray(x, np.float32).tobytes()
    rounded = np.ascontiguousarray(fv.round_to(x, kind))
    return (rounded.view(np.uint32) >> 16).astype(np.uint16).tobytes() if kind == "bf16" else rounded.astype(np.float16).tobytes()


def manifest(path: str) -> dict:
    """dim, kind and pieces (path, start, rows) of a folder, or those of a single file by its header."""
    store, at = open_fs(path)
    if store.get_file_info(at).type != arrow_fs.FileType.Directory:
        n, d = np.frombuffer(_read_at(path, 0, HEADER), np.uint32).tolist()
        kind = next((k for k in KINDS if path.endswith(f".{k}bin")), "fp32")
        return {"dim": d, "kind": kind, "pieces": [{"path": path, "start": 0, "rows": n}]}
    with store.open_input_file(f"{at}/manifest.json") as f:
        out = json.loads(f.read())
    for p in out["pieces"]:
        if "://" not in p["path"] and not p["path"].startswith("/"):
            p["path"] = f"{path}/{p['path']}"
    return out


@dataclass
class Stretches(InputPartition):
    """Stretches (path, first row of the piece, first row, rows) that one task reads."""

    parts: list

    def __init__(self, parts: list):
        super().__init__(parts)
        self.parts = parts


class FbinReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.about = manifest(path)
        self.n = sum(p["rows"] for p in self.about["pieces"])
        self.start, self.end = int(options.get("start", 0)), min(self.n, int(options.get("end", self.n)))
        self.rows = int(options.get("rows", 100_000))
        self.sample, self.block, self.seed = int(options.get("sample", 0)), int(options.get("block", 8)), int(options.get("seed", 0))

    def pushFilters(self, filters):
        """Bounds of vector_id narrow what is read; what isn't such a bound stays with Spark."""
        for f in filters:
            bound = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("vector_id",) or not isinstance(bound, (int, tuple, list)):
                yield f
            elif isinstance(f, EqualTo):
                self.start, self.end = max(self.start, bound), min(self.end, bound + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.start = max(self.start, bound)
            elif isinstance(f, GreaterThan):
                self.start = max(self.start, bound + 1)
            elif isinstance(f, LessThanOrEqual):
                self.end = min(self.end, bound + 1)
            elif isinstance(f, LessThan):
                self.end = min(self.end, bound)
            else:
                if isinstance(f, In) and bound:
                    self.start, self.end = max(self.start, min(bound)), min(self.end, max(bound) + 1)
                yield f

    def _within(self, first: int, last: int) -> Iterator[tuple]:
        for p in self.about["pieces"]:
            a, b = max(first, p["start"]), min(last, p["start"] + p["rows"])
            if a < b:
                yield p["path"], p["start"], a, b - a

    def _blocks(self) -> list[int]:
        """First rows of seeded blocks that hold ``sample`` rows together."""
        blocks = max(0, self.end - self.start) // self.block
        want = min(blocks, -(-self.sample // self.block))
        return [self.start + self.block * b for b in sorted(random.Random(self.seed).sample(range(blocks), want))]

    def partitions(self):
        if self.sample and self.sample < self.end - self.start:
            firsts, each = self._blocks(), max(1, self.rows // self.block)
            return [Stretches([s for b in firsts[i : i + each] for s in self._within(b, b + self.block)]) for i in range(0, len(firsts), each)] or [Stretches([])]
        parts = [Stretches([(path, start, a, min(self.rows, first + n - a))]) for path, start, first, n in self._within(self.start, self.end) for a in range(first, first + n, self.rows)]
        return parts or [Stretches([])]

    def read(self, partition):
        dim, kind = self.about["dim"], self.about["kind"]
        width = dim * np.dtype(KINDS[kind]).itemsize
        for path, start, first, n in partition.parts:
            for at in range(first, first + n, 8192):
                rows = min(8192, first + n - at)
                data = _read_at(path, HEADER + (at - start) * width, rows * width)
                if len(data) != rows * width:
                    raise OSError(f"{path} ends before row {at + rows}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + rows, dtype=np.int64)), fv.lists(_values(data, kind, dim))], ["vector_id", "embedding"])


@dataclass
class Piece(WriterCommitMessage):
    pieces: list


class FbinWriter(DataSourceArrowWriter):
    """Rows sorted by piece and vector_id, every piece whole within a task; see ``write_fbin``."""

    def __init__(self, path: str, options: dict):
        self.path, self.kind, self.rows = path, options.get("kind", "fp32"), int(options["rows"])
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        store, root = open_fs(self.path)
        done, f, name, next_row, dim = [], None, None, 0, 0

        def close():
            f.close()
            with store.open_input_file(f"{root}/{name}") as check:
                size = check.size()
            rows = (size - HEADER) // (dim * np.dtype(KINDS[self.kind]).itemsize)
            if rows != done[-1]["rows"]:
                raise ValueError(f"piece {name} has {rows} rows, not {done[-1]['rows']}")

        for batch in iterator:
            piece, vid, size = (batch.column(c).to_numpy() for c in ("piece", "vector_id", "piece_rows"))
            x = fv.matrix(batch.column("embedding"))
            for p in np.unique(piece).tolist():
                at = np.flatnonzero(piece == p)
                if not done or done[-1]["piece"] != p:
                    if f is not None:
                        close()
                    dim, next_row = x.shape[1], p * self.rows
                    name = f".{self.job}-{uuid.uuid4().hex}.tmp"
                    f = store.open_output_stream(f"{root}/{name}")
                    f.write(np.array([size[at[0]], dim], np.uint32).tobytes())
                    done.append({"piece": p, "rows": int(size[at[0]]), "dim": dim, "name": name})
                if vid[at].tolist() != list(range(next_row, next_row + len(at))):
                    raise ValueError(f"vector ids around {next_row} aren't consecutive")
                next_row += len(at)
                f.write(_stored(x[at], self.kind))
        if f is not None:
            close()
        return Piece(done)

    def commit(self, messages):
        """Pieces get their names, then the manifest appears."""
        store, root = open_fs(self.path)
        pieces, start, dims = [], 0, set()
        for p in sorted((p for m in messages if m is not None for p in m.pieces), key=lambda p: p["piece"]):
            if p["piece"] != len(pieces):
                raise ValueError(f"piece {len(pieces)} is missing")
            name = f"embeddings-{p['piece']:05d}.{'f' if self.kind == 'fp32' else self.kind}bin"
            store.move(f"{root}/{p['name']}", f"{root}/{name}")
            pieces.append({"path": name, "start": start, "rows": p["rows"]})
            start, dims = start + p["rows"], dims | {p["dim"]}
        if len(dims) > 1:
            raise ValueError(f"vectors of several dimensions: {sorted(dims)}")
        put_manifest(self.path, {"n": start, "dim": max(dims, default=0), "kind": self.kind, "pieces": pieces})

    def abort(self, messages):
        store, root = open_fs(self.path)
        for info in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f".{self.job}-"):
                store.delete_file(info.path)


def put_manifest(path: str, about: dict) -> None:
    store, root = open_fs(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/.manifest.tmp") as f:
        f.write(json.dumps(about).encode())
    store.move(f"{root}/.manifest.tmp", f"{root}/manifest.json")


class FbinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return "vector_id long, embedding array<float>"

    def reader(self, schema):
        return FbinReader(self.options["path"], self.options)

    def writer(self, schema, overwrite):
        return FbinWriter(self.options["path"], self.options)


def read_fbin(spark: SparkSession, path: str, **options) -> DataFrame:
    """vector_id, embedding of a file or folder. Options: rows (of a task), start, end; sample, block, seed for seeded blocks of rows."""
    spark.dataSource.register(FbinSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("fbin").options(**options).load(path)


def write_fbin(vectors: DataFrame, folder: str, dim: int, kind: str = "fp32", piece_bytes: int = PIECE_BYTES) -> None:
    """vectors(vector_id from 0 without gaps, embedding) as a folder of pieces and a manifest, each piece written by one task."""
    store, root = open_fs(folder)
    store.create_dir(root, recursive=True)
    if store.get_file_info(f"{root}/manifest.json").type == arrow_fs.FileType.File:
        raise FileExistsError(f"{folder} has a manifest already")
    vectors.sparkSession.dataSource.register(FbinSource)
    rows = max(1, piece_bytes // (dim * np.dtype(KINDS[kind]).itemsize))
    n = vectors.count()
    pieces = max(1, -(-n // rows))
    dealt = vectors.select("vector_id", F.col("embedding").cast("array<float>").alias("embedding"), F.floor(F.col("vector_id") / rows).alias("piece"))
    dealt = dealt.withColumn("piece_rows", F.when(F.col("piece") == pieces - 1, n - (pieces - 1) * rows).otherwise(rows).cast("long"))
    dealt = dealt.repartition(min(pieces, 4096), "piece").sortWithinPartitions("piece", "vector_id")
    dealt.write.format("fbin").mode("append").options(kind=kind, rows=rows).save(folder)


def merge_fbin(folders: list[str], out: str) -> dict:
    """One manifest over the pieces of all folders, their rows numbered on; no piece is copied."""
    pieces, start, kinds = [], 0, set()
    for folder in folders:
        about = manifest(folder)
        kinds.add((about["dim"], about["kind"]))
        for p in about["pieces"]:
            pieces.append({"path": p["path"], "start": start + p["start"], "rows": p["rows"]})
        start += sum(p["rows"] for p in about["pieces"])
    if len(kinds) > 1:
        raise ValueError(f"folders differ in dimension or kind: {sorted(kinds)}")
    dim, kind = kinds.pop() if kinds else (0, "fp32")
    about = {"n": start, "dim": dim, "kind": kind, "pieces": pieces}
    put_manifest(out, about)
    return about


def merge_meta(metas: list[DataFrame]) -> DataFrame:
    """meta(accession, start_row, num_rows) of shards as one, every shard's rows shifted by those before it. An accession in two shards raises."""
    out, start = None, 0
    for m in metas:
        moved = m.select("accession", (F.col("start_row") + start).alias("start_row"), "num_rows")
        out = moved if out is None else out.unionByName(moved)
        start += m.agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0]
    twice = out.groupBy("accession").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"accession {twice[0]['accession']} is in several shards")
    return out


def centroid_estimate(spark: SparkSession, path: str, sample: int, block: int = 1000, seed: int = 0) -> np.ndarray:
    """Mean of seeded blocks of rows; of all rows if the sample covers them."""
    part = read_fbin(spark, path, sample=sample, block=block, seed=seed)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([fv.matrix(b.column("embedding")).astype(np.float64).sum(0).tolist()], pa.list_(pa.float64()))], ["n", "total"])

    sums = part.mapInArrow(run, "n long, total array<double>").select("n", F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()  # a row for each dimension
    return np.array([r["x"] / r["n"] for r in sums])


def write_ground_truth(found: DataFrame, path: str, k: int) -> None:
    """Hits (query_no from 0, rank from 1 to k, vector_id, score) as one file: uint32 queries and k, all ids as uint32, all scores as float32.

    One task writes the file, as its two parts follow each other; a query without k hits raises.
    """
    n = found.agg(F.coalesce(F.max("query_no"), F.lit(-1))).first()[0] + 1

    def run(batches):
        store, at = open_fs(path)
        scores, next_row = [], 0
        with store.open_output_stream(f"{at}.tmp") as f:
            f.write(np.array([n, k], np.uint32).tobytes())
            for b in batches:
                q, r = b.column("query_no").to_numpy(), b.column("rank").to_numpy()
                if (q * k + r - 1 != np.arange(next_row, next_row + len(q))).any():
                    raise ValueError(f"a query near {next_row // k} hasn't {k} hits")
                next_row += len(q)
                f.write(b.column("vector_id").to_numpy().astype(np.uint32).tobytes())
                scores.append(b.column("score").to_numpy().astype(np.float32))
            if next_row != n * k:
                raise ValueError(f"{next_row} hits, not {n * k}")
            for x in scores:
                f.write(x.tobytes())
        store.move(f"{at}.tmp", at)
        yield pa.RecordBatch.from_arrays([pa.array([next_row])], ["rows"])

    rows = found.select("query_no", "rank", "vector_id", "score").orderBy("query_no", "rank").coalesce(1).mapInArrow(run, "rows long")
    rows.collect()  # one row


def read_ground_truth(path: str) -> tuple[np.ndarray, np.ndarray]:
    n, k = np.frombuffer(_read_at(path, 0, HEADER), np.uint32).tolist()
    data = _read_at(path, HEADER, 8 * n * k)
    return np.frombuffer(data, np.uint32, n * k).reshape(n, k), np.frombuffer(data, np.float32, n * k, 4 * n * k).reshape(n, k)


def write_query_bundle(chunks: DataFrame, folder: str, dim: int, save) -> None:
    """chunks(query_id, strand, chunk, embedding) as ``query`` pieces, forward chunks of a query first, and ``query_meta``: query_id, start_row, num_rows, num_forward."""
    order = [F.col("query_id"), F.col("strand") != "+", F.col("chunk")]
    placed = ordering.running(chunks, order, F.lit(1), "vector_id", save)
    write_fbin(placed.select("vector_id", "embedding"), f"{folder}/query", dim)
    meta = placed.groupBy("query_id").agg(F.min("vector_id").alias("start_row"), F.count("*").alias("num_rows"), F.count_if(F.col("strand") == "+").alias("num_forward"))
    meta.write.parquet(f"{folder}/query_meta")
