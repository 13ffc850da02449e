"""What the operators share: table reading, intermediate tables, size checks, word hashing.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` (a
folder that driver and executors share) and read back, so a lost executor costs
the tasks it ran and never a whole lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes up to which a side of a join is broadcast. Beyond it a shuffle join is planned.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables of one run in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="checkpoints-")  # one machine, as in tests
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The table written and read back. Shuffle files that led to it are deleted, since nothing is computed from them again."""
        conf, old = self.spark.conf, self.spark.conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            conf.set(CLEAN_UP, old)
        return self.read(df.schema, name)

    def read(self, schema: StructType, *names: str) -> DataFrame:
        """Saved tables of one schema together, as one scan."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}" for name in names])

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone when the interpreter ends
            return


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a saved table, with a broadcast hint if it has no more than ``limit`` rows and BROADCAST_BYTES of strings (counted, not guessed)."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    heavy = F.sum(sum(wide[1:], wide[0])) if wide else F.lit(0)
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(heavy, F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df


def join_spread(pairs: DataFrame, side: DataFrame, key: str, other: str, scratch: Scratch, name: str, most: int = 256) -> DataFrame:
    """pairs joined with side, which has one row for each ``key``. A key of more than ``most`` pairs is dealt to several places by a hash of ``other``."""
    hot = pairs.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1")
    hot = sized(scratch.save(hot, f"{name}_hot"))
    salted = pairs.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    spread = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return salted.join(spread, [key, "_salt"]).drop("_salt")


# --- bytes and words of Arrow text columns -----------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column (null as empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column, most: int = _PIECE):
    """Slices of rows (first, last, bytes, offsets) with about ``most`` bytes each; a longer row stands alone."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(breaks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and, for each row, first index of the runs without a break; no run crosses rows."""
    n = len(breaks)
    inside = ~breaks
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than space and 09-0D."""
    return spans(_SPACE[data], offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of data[start:end] of ascending spans, in pieces of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        piece = data[base : int(ends[j - 1])]
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries of h."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return out


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the sum of mask between its offsets."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
