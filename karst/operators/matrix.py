"""Products with a matrix whose rows are a DataFrame (feature_idx, values).

A pass reads every row once, in Arrow batches, and multiplies in numpy. What a pass returns lives on
the driver and is N x l at most (N samples, l small). Partial sums are cut into blocks of samples
and added up by key, so that no task and no collect holds the partials of all partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: What a partial sum's piece, and the cells that are worked at a time, may take.
PIECE_BYTES = 4 << 20


def block(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix; nulls are nan."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat if flat.dtype != object else flat.astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, so that what a task makes of them doesn't grow with a batch; none is empty."""
    for batch in batches:
        step = max(1, len(batch) * PIECE_BYTES // max(batch.nbytes, 1))
        for a in range(0, len(batch), step):
            yield batch.slice(a, step)


def rows_batch(idx: pa.Array, x: np.ndarray, names: tuple[str, str] = ("feature_idx", "values")) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(x) + 1) * (x.shape[1] if len(x) else 0), pa.int32())
    return pa.RecordBatch.from_arrays([idx, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel()))], list(names))


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = None
    for x in table.column("data"):
        own = np.frombuffer(x.as_buffer(), "<f8")
        total = own.copy() if total is None else total + own
    return pa.table({"name": table.column("name")[:1], "at": table.column("at")[:1], "data": pa.array([total.tobytes()], pa.binary())})


def reduce_batches(table: DataFrame, add, shapes: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Sums over all partitions of the named arrays that add(batch, total) adds to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(s) for k, s in shapes.items()}
        for b in pieces(batches):
            add(b, total)
        for k, x in total.items():
            step = min(BLOCK_ROWS, max(1, PIECE_BYTES // (8 * max(x.shape[1], 1))))
            for i in range(0, len(x), step):
                data = pa.array([np.ascontiguousarray(x[i : i + step]).astype("<f8").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int64()), data], ["name", "at", "data"])

    parts = table.mapInArrow(run, "name string, at long, data binary")
    sums = parts.groupBy("name", "at").applyInArrow(_sum_blocks, "name string, at long, data binary").collect()
    out = {k: np.zeros(s) for k, s in shapes.items()}
    for r in sums:
        x = out[r["name"]]
        own = np.frombuffer(r["data"], "<f8").reshape(-1, x.shape[1])
        x[r["at"] : r["at"] + len(own)] = own
    return out


def reduce_arrays(rows: DataFrame, partial, shapes: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Sums over all partitions of the named arrays that partial(idx, x, total) adds to."""

    def add(b: pa.RecordBatch, total: dict[str, np.ndarray]) -> None:
        partial(b.column(0).to_numpy(), block(b.column(1)), total)

    return reduce_batches(rows.select("feature_idx", "values"), add, shapes)


def power_pass(rows: DataFrame, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: with G = X omega (a row per feature), H = X' G and G' G."""
    n, l_ = omega.shape
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(omega))

    def partial(_, x, total):
        g = x @ shared.value
        total["h"] += x.T @ g
        total["c"] += g.T @ g

    got = reduce_arrays(rows, partial, {"h": (n, l_), "c": (l_, l_)})
    return got["h"], got["c"]


def times(rows: DataFrame, m: np.ndarray, name: str = "pcs") -> DataFrame:
    """feature_idx and X m, a row per feature."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield rows_batch(b.column(0), block(b.column(1)) @ shared.value, ("feature_idx", name))

    return rows.select("feature_idx", "values").mapInArrow(run, f"feature_idx long, {name} array<double>")


def map_rows(rows: DataFrame, fn, shared: object) -> DataFrame:
    """Rows after fn(x, shared), block by block."""
    sent = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield rows_batch(b.column(0), fn(block(b.column(1)), sent.value))

    return rows.select("feature_idx", "values").mapInArrow(run, "feature_idx long, values array<double>")


def map_arrays(rows: DataFrame, fn, shared: object, schema: str) -> DataFrame:
    """Rows after fn(idx, columns, shared): each column but the first as a matrix (arrays; nulls are nan) or a vector.

    `fn` gives the new columns besides feature_idx, as matrices or vectors; no row is shuffled.
    """
    sent = rows.sparkSession.sparkContext.broadcast(shared)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cols = [block(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]
            out = [b.column(0)]
            for x in fn(*cols, sent.value):
                if x.ndim == 1:
                    out.append(pa.array(x))
                else:
                    ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                    out.append(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel())))
            yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, schema)


# --- measures of agreement ----------------------------------------------------------------------


def flip_signs(u: np.ndarray) -> np.ndarray:
    """1 or -1 for each column, so that its entry of largest size becomes positive."""
    top = u[np.abs(u).argmax(0), np.arange(u.shape[1])]
    return np.where(top < 0, -1.0, 1.0)


def align(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y with columns turned where they point against x's."""
    return y * np.where(np.abs(x - y).sum(0) > 2 * np.abs(x + y).sum(0), -1.0, 1.0)


def mev(x: np.ndarray, y: np.ndarray) -> float:
    """Mean over y's columns of the length of their projection on x's column space (orthonormal columns)."""
    return float(np.linalg.norm(x.T @ y, axis=0).mean())


def rmse(x: np.ndarray, y: np.ndarray) -> float:
    d = x - (align(x, y) if x.ndim == 2 else y)
    return float(np.sqrt(np.mean(d * d)))


def min_sse(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each column of x the least squared distance to any column of y or its negative."""
    a, b = (x * x).sum(0)[:, None], (y * y).sum(0)[None, :]
    return (a + b - 2 * np.abs(x.T @ y)).min(1)


def mev_rmse_by_k(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """mev and rmse of the leading 1, 2, ... columns."""
    return [(mev(x[:, :k], y[:, :k]), rmse(x[:, :k], y[:, :k])) for k in range(1, x.shape[1] + 1)]


def agreement(x: DataFrame, y: DataFrame, k: int) -> dict[str, float | np.ndarray]:
    """mev, rmse and min_sse of two tables (feature_idx, pcs) of k columns, from sums of k x k numbers over their rows."""

    def partial(_, both, total):
        a, b = both[:, :k], both[:, k:]
        total["dot"] += a.T @ b
        total["size"] += np.vstack([(a * a).sum(0), (b * b).sum(0), np.abs(a - b).sum(0), np.abs(a + b).sum(0), np.full(k, len(a))])

    rows = x.select("feature_idx", "pcs").join(y.select("feature_idx", F.col("pcs").alias("other")), "feature_idx")
    got = reduce_arrays(rows.select("feature_idx", F.concat("pcs", "other").alias("values")), partial, {"dot": (k, k), "size": (5, k)})
    dot, (xx, yy, apart, together, m) = got["dot"], got["size"]
    turned = np.where(apart > 2 * together, -1.0, 1.0)
    return {
        "mev": float(np.linalg.norm(dot, axis=0).mean()),
        "rmse": float(np.sqrt((xx + yy - 2 * turned * np.diag(dot)).sum() / max(m.sum(), 1))),
        "min_sse": (xx[:, None] + yy[None, :] - 2 * np.abs(dot)).min(1),
    }
