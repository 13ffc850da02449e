"""Vector functions: column expressions, and Arrow functions where bits are needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column) -> np.ndarray:
    """A list column of constant length as float32 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 0), np.float32)


def lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.astype(np.float32).ravel()))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def normalise(a: Column) -> Column:
    norm = l2_norm(a)
    return F.transform(a, lambda x: x.cast("double") / norm)


def round_to(rows: np.ndarray, kind: str) -> np.ndarray:
    """Rows as fp16 or bf16 store them (nearest, ties to even); overflow raises."""
    if kind == "fp16":
        with np.errstate(over="ignore"):
            out = rows.astype(np.float16).astype(np.float32)
    elif kind == "bf16":
        bits = rows.astype(np.float32).view(np.uint32).astype(np.uint64)
        bits = (bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000
        out = bits.astype(np.uint32).view(np.float32)
    else:
        raise ValueError(f"unknown kind {kind}")
    if not np.isfinite(out[np.isfinite(rows)]).all():
        raise OverflowError(f"a value is too large for {kind}")
    return out


def rounded(kind: str):
    @F.arrow_udf("array<float>")
    def run(vectors: pa.Array) -> pa.Array:
        return lists(round_to(matrix(vectors), kind))

    return run


def pack_signs(rows: np.ndarray) -> np.ndarray:
    if rows.shape[1] % 8:
        raise ValueError("the dimension must be a multiple of 8")
    return np.packbits(rows > 0, axis=1, bitorder="little")


def unpack_signs(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes, axis=1, bitorder="little").astype(np.float32) * 2 - 1


def rotation(d: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _line(x: np.ndarray) -> np.ndarray:
    """Floats as whole numbers in their order, neighbours one apart, both zeros at 0."""
    bits = x.astype(np.float32).view(np.uint32).astype(np.int64)
    return np.where(bits >> 31, -(bits & 0x7FFFFFFF), bits)


def ulp_distance(a: Column, b: Column) -> Column:
    """Representable floats between two floats, across zero too; null where one isn't a number."""
    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        x, y = (v.to_numpy(zero_copy_only=False).astype(np.float32) for v in (x, y))
        return pa.array(np.abs(_line(x) - _line(y)), mask=~(np.isfinite(x) & np.isfinite(y)))

    return run(a.cast("float"), b.cast("float"))


def vector_ulps(a: Column, b: Column) -> Column:
    """The largest distance of two vectors' components; null for vectors of other length."""
    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for u, v in zip(x, y, strict=True):
            same = u.is_valid and v.is_valid and len(u.values) == len(v.values)
            out.append(int(np.abs(_line(u.values.to_numpy()) - _line(v.values.to_numpy())).max(initial=0)) if same else None)
        return pa.array(out, pa.int64())

    return run(a, b)
