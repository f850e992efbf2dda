"""PCA whitening with an exact scatter from bit planes.

Entries are integers. Over a block of rows each dimension is shifted to start
at zero and cut into bit planes, packed across the rows into 64-bit words. The
AND of two planes has a one for each row with both bits, so cross-products are
sums of popcounts weighted by powers of two, exact whatever the order of the
blocks. They are centred as integers, before the eigenvectors are taken.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import materialize
from shoplens.llm.vectors import whole_vectors

#: Rows of a block: its planes (some 600 of 1 KB) stay in the cache.
BLOCK = 1 << 13
#: Share of the total variance below which a component has none.
NO_VARIANCE = 1e-12
#: Largest entry after scaling.
LARGEST = 1 << 53


# -- integers of a row ------------------------------------------------------

def pack(x: np.ndarray) -> bytes:
    """A row of integers: its width in bytes, then its entries. Equal rows
    give equal bytes."""
    top = max(int(x.max()), -int(x.min()) - 1, 0) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(b, f"<i{b[0]}", offset=1) for b in column.to_pylist()], np.int64).reshape(-1, dim)


# -- scatter ----------------------------------------------------------------

def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit) of the planes of a block of non-negative
    integers (row, dimension); a dimension has as many planes as it needs."""
    need = [int(v).bit_length() for v in u.max(axis=0)]
    dimension = np.repeat(np.arange(u.shape[1]), need)
    bit = np.concatenate([np.arange(n) for n in need]).astype(np.int64) if len(dimension) else np.empty(0, np.int64)
    bits = (u[:, dimension] >> bit.astype(np.uint64)) & np.uint64(1)
    packed = np.packbits(bits.astype(np.uint8).T, axis=1, bitorder="little")
    words = np.zeros((len(dimension), -(-packed.shape[1] // 8) * 8), np.uint8)
    words[:, :packed.shape[1]] = packed
    return words.view("<u8"), dimension, bit


def block_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of a block of integer rows, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    words, dimension, bit = bit_planes((x - low).astype(np.uint64))
    both = np.zeros((len(words), len(words)), np.int64)
    for p in range(len(words)):
        both[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
    wide = 2 * int(bit.max(initial=0)) + n.bit_length() > 62
    weight = np.array([1 << b for b in bit.tolist()], object if wide else np.int64)
    ones = np.diag(both).astype(weight.dtype) * weight
    both = (both + np.triu(both, 1).T).astype(weight.dtype) * weight[:, None] * weight
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    if len(words):
        starts = np.flatnonzero(np.diff(dimension, prepend=-1))
        some = dimension[starts]
        sums[some] = np.add.reduceat(ones, starts)
        cross[np.ix_(some, some)] = np.add.reduceat(np.add.reduceat(both, starts, axis=0), starts, axis=1)
    low = low.astype(object)
    return sums + n * low, cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def _scatter(fit: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, cross-products) of the packed rows ``fit(x)``: what comes
    to the driver has the size of the covariance."""
    up = np.triu_indices(dim)

    def run(batches):
        n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = unpack(b.column(0).slice(at, BLOCK), dim)
                s, c = block_scatter(x)
                n, sums, cross = n + len(x), sums + s, cross + c
        value = [Decimal(int(v)) for v in (n, *sums, *cross[up])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1] * (1 + dim) + up[0].tolist(), pa.int32()),
             pa.array([-1, *range(dim), *up[1].tolist()], pa.int32()), pa.array(value, pa.decimal128(38, 0))],
            names=["i", "j", "value"])

    got = {(r.i, r.j): int(r.value) for r in fit.select("x").mapInArrow(run, "i int, j int, value decimal(38,0)")
           .groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    cross = np.array([[got[min(i, j), max(i, j)] for j in range(dim)] for i in range(dim)], object)
    return got[-1, -1], np.array([got[-1, i] for i in range(dim)], object), cross.reshape(dim, dim)


def eigen(n: int, sums: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the
    covariance (divisor n), centred exactly: n * cross - sums x sums is whole."""
    centred = n * cross - np.outer(sums, sums)
    v = np.array([[c / (n * n) for c in row] for row in centred.tolist()], np.float64)
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1], float(sum(np.diag(centred).tolist()) / (n * n))


def squares(t: np.ndarray) -> list[int]:
    """Exact sum of squares of each row of integers."""
    top = max(int(t.max(initial=0)), -int(t.min(initial=0)))
    dim = t.shape[1]
    if dim * top * top < 1 << 62:
        return (t * t).sum(axis=1).tolist()
    if dim << 56 < 1 << 62 and top < 1 << 51:
        a, b = t >> 24, t & 0xFFFFFF
        parts = ((x * y).sum(axis=1).tolist() for x, y in ((a, a), (a, b), (b, b)))
        return [(x << 48) + (y << 25) + z for x, y, z in zip(*parts, strict=True)]
    return (t.astype(object) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, dim: int | None = None,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept input row and component: vec_id, component (from 1, by
    falling eigenvalue), n, deviation (decimal, exact), whitened, explained,
    identity_error.

    Rows whose vector is null or holds a null or non-finite entry go; entries
    c become x = floor(scale * c). The fit list is each distinct vector once,
    n in number; ``deviation`` is the sum of (n * x - S)^2 with S the sums of
    the fit list, ``whitened`` the centred vector on the component over the
    root of its eigenvalue, ``explained`` the eigenvalue's share of the trace,
    ``identity_error`` the largest absolute entry of the fit list's whitened
    covariance minus the identity.

    ``dim`` is the most frequent length in the fit list (of equally frequent
    ones the longest) unless given; rows of other lengths go too. Vectors of
    fewer entries than ``components`` have as many components as entries.
    Repeated rows each give their rows; a null id stays null. A component
    without variance (equal vectors, fewer vectors than components) has a null
    ``whitened``, and stands aside in ``identity_error``; without any variance
    this and ``explained`` are null. An empty table gives no rows. Entries of
    2^53 and more after scaling raise an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def integers(batches):
        for b in batches:
            at, size, values = whole_vectors(b.column(1))
            x = np.floor(scale * values)
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError(f"entries of {LARGEST / scale} and more are not whole numbers of 64 bits")
            x, past = x.astype(np.int64), np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(size, pa.int32()),
                 pa.array([pack(x[p - n:p]) for n, p in zip(size.tolist(), past.tolist(), strict=True)], pa.binary())],
                names=["vec_id", "size", "x"])

    kept = rows.mapInArrow(integers, f"vec_id {id_type}, size int, x binary").where("size > 0")
    fit = materialize(kept.select("size", "x").distinct(), "fit-list")
    sizes = fit.groupBy("size").count().orderBy(F.desc("count"), F.desc("size"))
    found = (sizes if dim is None else sizes.where(F.col("size") == dim)).first()
    schema = (f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    if found is None:
        return spark.createDataFrame([], schema)
    width = found["size"]
    fit = fit.where(F.col("size") == width)
    n, sums, cross = _scatter(fit, width)
    values, axes, trace = eigen(n, sums, cross)
    k = min(components, width)
    good = [i for i in range(k) if values[i] > NO_VARIANCE * trace]
    scaled = axes[:, good] / np.sqrt(values[good])  # centred vector -> whitened components

    def centred(x: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit integers where they fit."""
        top = max(int(np.abs(x).max(initial=0)), 1)
        if n * top + max(map(abs, sums)) < 1 << 62:
            return n * x - sums.astype(np.int64)
        return n * x.astype(object) - sums

    def moments(batches):
        total, square = np.zeros(len(good)), np.zeros((len(good), len(good)))
        for b in batches:
            w = (centred(unpack(b.column(0), width)) / n).astype(np.float64) @ scaled
            total, square = total + w.sum(axis=0), square + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*total, *square.ravel()]], pa.list_(pa.float64()))], names=["m"])

    error = None
    if good:
        g = len(good)
        parts = fit.select("x").mapInArrow(moments, "m array<double>")
        m = np.array(parts.agg(F.array(*[F.sum(F.col("m")[i]) for i in range(g + g * g)])).first()[0]) / n
        error = float(np.abs(m[g:].reshape(g, g) - np.outer(m[:g], m[:g]) - np.eye(g)).max())
    explained = [float(values[i] / trace) if i in good else 0.0 if trace else None for i in range(k)]

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                t = centred(unpack(some.column(1), width))
                rows = len(t)
                white = np.full((rows, k), np.nan)
                white[:, good] = (t / n).astype(np.float64) @ scaled
                deviation = pa.array([Decimal(int(v)) for v in squares(t)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                     pa.array(np.full(rows * k, n), pa.int64()), deviation.take(each),
                     pa.array(white.ravel(), pa.float64(), from_pandas=True),
                     pa.array(explained * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.where(F.col("size") == width).select("vec_id", "x").mapInArrow(project, schema)
