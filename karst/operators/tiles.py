"""A relation of samples (N x N, symmetric) as a table of tiles, and what can be asked of it.

A row is a tile on or above the diagonal: its first sample a, its first sample b, and the cells
between them. Tiles are made by tasks that add up all their rows before they say anything, so what
is shuffled depends on the tasks (as many as the cluster has cores) and on N^2, but not on the number
of features. A task's sums take SUM_BYTES at most; where all tiles together are larger, the rows are
read once for each band of tiles. Nothing of size N x N is in one place: products with a block of
vectors go through the table, and eigenvectors come from a block Lanczos iteration on them.

Where a matrix has few features and more samples (`slices.few`), the relation stays two factors
(`Factored`): products go through them, and tiles are made from slices where they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.lineage import cut
from karst.operators.matrix import block
from karst.operators.slices import Slices, few_features, pairs, slices

TILE = 512
SUM_BYTES = 128 << 20
#: Samples up to which a relation may be held whole (8 MB).
SMALL = 1024


def _bands(n: int, tile: int, sum_bytes: int) -> list[list[int]]:
    """First samples of the rows of tiles that are summed in one reading."""
    out, held = [[]], 0
    for a in range(0, n, tile):
        own = 8 * min(tile, n - a) * (n - a)
        if out[-1] and held + own > sum_bytes:
            out.append([])
            held = 0
        out[-1].append(a)
        held += own
    return out


def _add(table: pa.Table) -> pa.Table:
    total = None
    for x in table.column("data"):
        own = np.frombuffer(x.as_buffer(), "<f8")
        total = own.copy() if total is None else total + own
    return pa.table({"a": table.column("a")[:1], "b": table.column("b")[:1], "data": pa.array([total.tobytes()], pa.binary())})


def _sums(rows: DataFrame, n: int, tile: int, band: list[int]) -> DataFrame:
    """The tiles of one band from each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = block(batch.column(1))
                total = total or {a: np.zeros((min(tile, n - a), n - a)) for a in band}
                for a, own in total.items():
                    own += x[:, a : a + tile].T @ x[:, a:]
        for a, own in (total or {}).items():
            for b in range(a, n, tile):
                data = pa.array([np.ascontiguousarray(own[:, b - a : b - a + tile]).astype("<f8").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([b], pa.int64()), data], ["a", "b", "data"])

    return rows.mapInArrow(run, "a long, b long, data binary")


@dataclass
class Tiles:
    """a, b, data (float64, row by row) of the tiles a <= b of an n x n relation, times `scale`."""

    table: DataFrame
    n: int
    tile: int
    scale: float = 1.0

    def _map(self, fn: Callable, shared: object, schema: str) -> DataFrame:
        """fn(a, b, cells, shared) gives rows for each tile."""
        sent, n, tile = self.table.sparkSession.sparkContext.broadcast(shared), self.n, self.tile
        arrow = [(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                    cells = np.frombuffer(data, "<f8").reshape(min(tile, n - a), min(tile, n - b))
                    cols = fn(a, b, cells, sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, arrow)], [name for name, _ in arrow])

        return self.table.mapInArrow(run, schema)

    def product(self, q: np.ndarray) -> np.ndarray:
        """The relation times a block of vectors (n x l), added up by blocks of samples."""

        def part(a, b, cells, x):
            out = [(a, cells @ x[b : b + cells.shape[1]])]
            if a != b:
                out.append((b, cells.T @ x[a : a + cells.shape[0]]))
            return [at for at, _ in out], [at for at, _ in out], [np.ascontiguousarray(y).tobytes() for _, y in out]

        parts = self._map(part, np.ascontiguousarray(q), "a long, b long, data binary")
        out = np.zeros((self.n, q.shape[1]))
        for r in parts.groupBy("a", "b").applyInArrow(_add, "a long, b long, data binary").collect():
            own = np.frombuffer(r["data"], "<f8").reshape(-1, q.shape[1])
            out[r["a"] : r["a"] + len(own)] = own
        return out * self.scale

    def dense(self) -> np.ndarray:
        """All cells, of a small relation."""
        if self.n > SMALL:
            raise ValueError(f"{self.n} samples: a relation of more than {SMALL} isn't held whole")
        out = np.zeros((self.n, self.n))
        for r in self.table.collect():
            cells = np.frombuffer(r["data"], "<f8").reshape(min(self.tile, self.n - r["a"]), -1)
            out[r["a"] : r["a"] + len(cells), r["b"] : r["b"] + cells.shape[1]] = cells
        return (np.triu(out) + np.triu(out, 1).T) * self.scale

    def leading(self, k: int, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
        """The k largest eigenvalues and their vectors (n x k)."""
        k = min(k, self.n)
        if self.n <= SMALL:
            w, e = np.linalg.eigh(self.dense())
            return w[::-1][:k], e[:, ::-1][:, :k]
        return block_lanczos(self.product, self.n, k, tol)

    def scaled(self, by: float) -> Tiles:
        return Tiles(self.table, self.n, self.tile, self.scale * by)

    def with_diagonal(self, d: np.ndarray) -> Tiles:
        """The relation with another diagonal."""
        scale = self.scale

        def put(a, b, cells, x):
            if a == b:
                cells = cells.copy()
                np.fill_diagonal(cells, x[a : a + len(cells)] / scale)
            return [a], [b], [cells.tobytes()]

        return Tiles(cut(self._map(put, np.asarray(d, float), "a long, b long, data binary"), "tiles"), self.n, self.tile, scale)

    def cells(self, ids: list[int], digits: int | None = None) -> DataFrame:
        """i, j, c of all pairs of samples, by their ids; c with so many digits, ties away from zero, without a negative zero.

        A tile's row is followed by its mirror image, so that files compress the same cells to one copy.
        """
        scale = self.scale

        def both(a, b, cells, names):
            c = cells * scale
            if digits is not None:
                c = np.copysign(np.floor(np.abs(c) * 10.0**digits + 0.5) / 10.0**digits, c) + 0.0
            i, j = np.broadcast_arrays(names[a : a + c.shape[0], None], names[None, b : b + c.shape[1]])
            i, j, c = np.stack([i, j], 1), np.stack([j, i], 1), np.stack([c, c], 1)
            if a == b:
                once = np.stack([np.triu(np.ones(cells.shape, bool), k) for k in (0, 1)], 1)
                i, j, c = i[once], j[once], c[once]
            return i.ravel(), j.ravel(), c.ravel()

        return self._map(both, np.array(ids, np.int64), "i long, j long, c double")

    def lines(self) -> DataFrame:
        """i, values: the rows of the relation."""
        scale = self.scale

        def pieces(a, b, cells, _):
            out = [(a + i, b, np.ascontiguousarray(x * scale)) for i, x in enumerate(cells)]
            if a != b:
                out += [(b + j, a, np.ascontiguousarray(x * scale)) for j, x in enumerate(cells.T)]
            return zip(*((i, at, x.tobytes()) for i, at, x in out))

        def joined(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("at").to_numpy())
            raw = b"".join(table.column("data")[int(k)].as_py() for k in order)
            return pa.table({"i": table.column("i")[:1], "values": pa.array([np.frombuffer(raw, "<f8")], pa.list_(pa.float64()))})

        return self._map(pieces, None, "i long, at long, data binary").groupBy("i").applyInArrow(joined, "i long, values array<double>")


class Factored(Tiles):
    """X'X times `scale`, plus a diagonal if there is one, of a matrix in slices: values, and `rest` (what the diagonal has beside)."""

    def __init__(self, parts: Slices, scale: float = 1.0, tile: int = TILE):
        super().__init__(pairs(parts, tile), parts.n, tile, scale)
        self.parts = parts

    def product(self, q: np.ndarray) -> np.ndarray:
        y = self.parts.times(self.parts.broadcast(np.ascontiguousarray(q)))

        def own(at, cols, shared):
            g, q = shared
            x, *rest = cols
            return x.T @ g + (rest[0][0][:, None] * q[at : at + x.shape[1]] if rest else 0)

        return self.parts.scores(own, (y, q), q.shape[1]) * self.scale

    def leading(self, k: int, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
        k = min(k, self.n)
        if self.n <= SMALL:
            return super().leading(k, tol)
        # the iteration begins with what X'X alone would give
        w, e = np.linalg.eigh(self.parts.only("values").relation())
        start = self.parts.scores(lambda _, cols, m: cols[0].T @ m, e[:, ::-1][:, : k + 5], min(k + 5, len(w)))
        return block_lanczos(self.product, self.n, k, tol, start=start)

    def scaled(self, by: float) -> Tiles:
        return Factored(self.parts, self.scale * by, self.tile)

    def with_diagonal(self, d: np.ndarray) -> Tiles:
        scale = self.scale

        def put(at, *cols):
            x, shared = cols[0], cols[-1]
            return x, (shared[at : at + x.shape[1]] / scale - (x * x).sum(0))[None, :]

        return Factored(self.parts.map(put, np.asarray(d, float), ["values", "rest"]).written(), self.scale, self.tile)


def gram(rows: DataFrame, n: int, tile: int = TILE, sum_bytes: int = SUM_BYTES) -> Tiles:
    """X'X over samples of the rows (feature_idx, values)."""
    if n > tile:
        found = few_features(rows)
        if found:
            return Factored(slices(rows, *found, unit=tile), tile=tile)
    few = rows.select("feature_idx", "values").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    bands = [_sums(few, n, tile, band) for band in _bands(n, tile, sum_bytes)] if n else [_sums(few, 0, tile, [])]
    sums = reduce(DataFrame.unionByName, bands).groupBy("a", "b").applyInArrow(_add, "a long, b long, data binary")
    return Tiles(cut(sums, "tiles"), n, tile)


def inner(x: Tiles, y: Tiles) -> float:
    """The sum of products of all cells of two relations of the same samples."""

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            twice, one, other = batch.columns
            got = [float(np.frombuffer(p.as_buffer(), "<f8") @ np.frombuffer(q.as_buffer(), "<f8")) for p, q in zip(one, other)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(got) * np.where(twice.to_numpy(zero_copy_only=False), 2, 1), pa.float64())], ["dot"])

    both = x.table.join(y.table.withColumnRenamed("data", "other"), ["a", "b"]).select((F.col("a") != F.col("b")).alias("twice"), "data", "other")
    return float(both.mapInArrow(dots, "dot double").agg(F.sum("dot")).first()[0] or 0.0) * x.scale * y.scale


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, tol: float = 1e-9, width: int = 0, most: int = 500, seed: int = 1, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, and vectors, of a symmetric product, `width` vectors at a time.

    The basis is kept orthonormal against all of itself. When it is full, the wanted vectors and some
    beside them stay, and the iteration goes on from what is left over of those that aren't settled.
    """
    width = min(width or k + 5, n)
    full = min(n, 3 * k + 4 * width)
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    x, done = rng.standard_normal((n, width)) if start is None else start, 0
    while True:
        while basis.shape[1] < full:
            size = np.linalg.norm(x, axis=0)
            x = x / np.where(size > 0, size, 1)
            for _ in range(2):
                x = x - basis @ (basis.T @ x)
                u, s, _ = np.linalg.svd(x, full_matrices=False)
                x = u[:, s > 1e-10]
            x = x[:, : full - basis.shape[1]]
            if not x.shape[1]:
                x = rng.standard_normal((n, min(width, full - basis.shape[1])))
                continue
            y = product(x)
            done += 1
            basis, image, x = np.hstack([basis, x]), np.hstack([image, y]), y
        t = basis.T @ image
        w, e = np.linalg.eigh((t + t.T) / 2)
        w, e = w[::-1], e[:, ::-1]
        ritz, image_r = basis @ e, image @ e
        rest = np.linalg.norm(image_r[:, :k] - ritz[:, :k] * w[:k], axis=0)
        open_ = np.flatnonzero(rest > tol * max(abs(w[0]), 1e-300))
        if not len(open_) or basis.shape[1] >= n:
            return w[:k], ritz[:, :k]
        if done >= most:
            raise RuntimeError(f"only {k - len(open_)} of {k} pairs converged")
        keep = min(2 * k + width, full - width)
        x = image_r[:, open_[:width]] - ritz[:, open_[:width]] * w[open_[:width]]
        basis, image = ritz[:, :keep], image_r[:, :keep]
