"""Embedding whitening by polarisation (operator 11).

For two dimensions i and j,
    Var(x_i + x_j) = Var(x_i) + Var(x_j) + 2 Cov(x_i, x_j),
so the variances of all dimensions and of all sums of two dimensions give
every cross-covariance by differences.  Only squares of centred values are
ever summed, never a product of two dimensions.

1. Entries become integers: x = floor(``scale`` * c) + ``offset``.
2. One pass sums every dimension (S) and counts the vectors (n).
3. A second pass takes every vector relative to the whole part of the mean,
   y = x - (S div n), and sums y_i^2 and (y_i + y_j)^2 as integers.  With
   r = S mod n, the exact centred sum is
       sum of (n x - S)^2 = n^2 sum of y^2 - n r^2,
   so centring loses no digit however far the data lie from zero.
4. The driver turns d (d + 1) / 2 whole numbers (d: the dimensions, never the
   rows) into the covariance, each entry rounded once, and ``eigh`` gives
   the components.
5. A third pass projects y - r / n and adds up the whitened covariance, from
   which the error against the identity is taken; the last one returns rows.

Every task adds up its own rows in integers and emits one row per
dimension pair; Spark adds these up with partial sums.  No key is hot: the
number of vectors never shows in a shuffle.  A lost task is run again from
the table.

Defined cases: vectors that are null, hold a null, NaN or infinite entry, or
an entry that does not fit a long after scaling, are left out; of unlike
lengths the greatest is the dimension, and shorter vectors count as holding
nulls; null ids are kept; repeated rows count and are returned as often as
they stand there; equal eigenvalues keep the order ``eigh`` gives; a
component without variance (below 1e-13 of the trace) has a null
``whitened`` and is not part of ``identity_error``; a single vector or no
variance at all gives ``explained`` 0; an empty table gives an empty result;
other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermart.llm.common import col

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Numbers that a task works on at once.
BLOCK = 1 << 20
#: Greatest scaled entry that still counts as a long.
LONGEST = 2.0 ** 62
#: Share of the trace below which a component has no variance.
NO_VARIANCE = 1e-13


@dataclass
class Whitening:
    """A fitted transform; all but ``error`` is exact up to one rounding."""

    n: int
    sums: list[int]
    vectors: np.ndarray      # one component per column
    values: np.ndarray       # eigenvalues, falling
    trace: float
    error: float | None = None

    @property
    def whole(self) -> np.ndarray:
        """The whole part of the mean."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What is left of the sums, less than n."""
        return np.array([s % self.n for s in self.sums], dtype=np.int64)

    @property
    def varied(self) -> np.ndarray:
        return self.values > NO_VARIANCE * max(self.trace, 0.0)


# --- vectors of a batch -----------------------------------------------------

def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vec) of vectors whose entries are all finite and fit."""
    v = col(vector_col).cast("array<double>")
    # a null entry makes forall null, which filter drops
    fits = F.forall(v, lambda c: ~F.isnan(c) & (F.abs(c * scale) < LONGEST))
    return vectors.select(col(id_col).alias("id"), v.alias("vec")).filter(fits & (F.size("vec") > 0))


def _matrix(batch: pa.RecordBatch, scale: int, offset: int) -> np.ndarray:
    """The integer vectors of a batch, a row each."""
    flat = np.asarray(batch.column("vec").flatten(), dtype=np.float64)
    return (np.floor(flat * scale).astype(np.int64) + offset).reshape(batch.num_rows, -1)


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, BLOCK // max(1, x.shape[1]))
    for a in range(0, len(x), step):
        yield x[a:a + step]


def _exact(y: np.ndarray, total: int) -> np.ndarray:
    """``y`` in a type in which ``total`` squares of entries of twice its size add up exactly."""
    most = max(1, 2 * int(np.abs(y).max(initial=0)))
    return y if most * most * max(1, total) < 2 ** 62 else y.astype(object)


def _totals(add: Callable[[np.ndarray, np.ndarray], None], d: int, pairs: bool, scale: int, offset: int):
    """Per task: the integer totals that ``add`` gathers from its blocks.
    Row i of the table holds dimension i itself (0) and its sums with i + 1, ... ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object) if pairs else np.zeros((d, 1), dtype=object)
        any_rows = False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                for block in _blocks(_matrix(batch, scale, offset)):
                    add(total, block)
        if not any_rows:
            return
        at = [(i, j) for i in range(d) for j in (range(i, d) if pairs else (i,))]
        cells = [int(total[i, j - i]) for i, j in at]
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()),
            pa.array([str(c) for c in cells], pa.string())], ["i", "j", "total"])
    return run


def _gathered(rows: DataFrame, run) -> dict[tuple[int, int], int]:
    """The totals of all tasks; one per dimension or pair of dimensions."""
    told = rows.mapInArrow(run, "i int, j int, total string")
    summed = told.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in summed.collect()}


def _add_sums(total: np.ndarray, block: np.ndarray) -> None:
    most = int(np.abs(block).max())
    exact = block if most * len(block) < 2 ** 62 else block.astype(object)
    total[:, 0] += exact.sum(axis=0).astype(object)


def _add_squares(whole: np.ndarray):
    """Squares of every centred dimension and of every sum of two."""
    def add(total: np.ndarray, block: np.ndarray) -> None:
        y = _exact(block - whole, len(block)).T.copy()
        d = len(y)
        total[:, 0] += (y * y).sum(axis=1).astype(object)
        for i in range(d - 1):
            both = y[i + 1:] + y[i]
            squares = np.einsum("ij,ij->i", both, both) if both.dtype != object else (both * both).sum(axis=1)
            total[i, 1:d - i] += squares.astype(object)
    return add


# --- fitting ----------------------------------------------------------------

def covariance(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance (divisor n) from the sums of squares, by polarisation.
    Whole numbers until the one division of each entry."""
    d = len(sums)
    rest = [s % n for s in sums]

    def centred(i: int, j: int) -> int:
        """n^3 times the variance of dimension i (i = j) or of i + j."""
        r = rest[i] if i == j else rest[i] + rest[j]
        return n * n * squares[i, j] - n * r * r
    out, own = np.empty((d, d)), [centred(i, i) for i in range(d)]
    for i in range(d):
        out[i, i] = own[i] / n ** 3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (centred(i, j) - own[i] - own[j]) / (2 * n ** 3)
    return out


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS,
        scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The whitening transform of all usable vectors; None without any."""
    rows = usable(vectors, id_col, vector_col, scale)
    d = rows.agg(F.max(F.size("vec")).alias("d")).first()["d"]
    if d is None:
        return None
    rows = rows.filter(F.size("vec") == d)
    n = rows.count()
    first = _gathered(rows, _totals(_add_sums, d, False, scale, offset))
    sums = [first[i, i] for i in range(d)]
    whole = np.array([s // n for s in sums], dtype=np.int64)
    v = covariance(n, sums, _gathered(rows, _totals(_add_squares(whole), d, True, scale, offset)))
    values, u = np.linalg.eigh(v)
    order = np.arange(d)[::-1][:components]
    model = Whitening(n, sums, u[:, order], np.maximum(values[order], 0.0), float(np.trace(v)))
    model.error = _identity_error(rows, model, scale, offset)
    return model


def _white(block: np.ndarray, model: Whitening) -> np.ndarray:
    """The whitened coordinates of integer vectors, 0 without variance."""
    spread = np.where(model.varied, np.sqrt(np.where(model.varied, model.values, 1.0)), np.inf)
    return ((block - model.whole).astype(np.float64) - model.rest / model.n) @ (model.vectors / spread)


def _identity_error(rows: DataFrame, model: Whitening, scale: int, offset: int) -> float:
    """Greatest entry of the whitened rows' covariance minus the identity."""
    live = np.flatnonzero(model.varied)
    k = len(live)
    if k == 0:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, means = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                for block in _blocks(_matrix(batch, scale, offset)):
                    w = _white(block, model)[:, live]
                    total += w.T @ w
                    means += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.ravel().tolist() + means.tolist()])], ["at", "cells"])
    told = rows.mapInArrow(run, "at long, cells array<double>").select(F.posexplode("cells").alias("cell", "total"))
    cells = {r["cell"]: r["total"] for r in told.groupBy("cell").agg(F.sum("total").alias("total")).collect()}
    both = np.array([cells[c] for c in range(k * k)]).reshape(k, k) / model.n
    mean = np.array([cells[k * k + c] for c in range(k)]) / model.n
    return float(np.abs(both - np.outer(mean, mean) - np.eye(k)).max())


# --- applying ---------------------------------------------------------------

def _deviation(block: np.ndarray, model: Whitening) -> list[int]:
    """Per vector, the sum over dimensions of (n x - S)^2, exactly."""
    y = block - model.whole
    most = model.n * (int(np.abs(y).max(initial=0)) + 1)
    if most * most * block.shape[1] >= 2 ** 62:
        y = y.astype(object)
    far = y * model.n - model.rest
    return [int(s) for s in (far * far).sum(axis=1)]


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding", *,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every usable vector of
    the model's dimension."""
    rows = usable(vectors, id_col, vector_col, scale)
    kind = rows.schema["id"].dataType.simpleString()
    d = len(model.sums) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            for block in _blocks(_matrix(batch, scale, offset)):
                w = _white(block, model)
                cells = pa.array(w.ravel(), pa.float64(), mask=np.tile(~model.varied, len(w)))
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, len(w)), pa.array([str(x) for x in _deviation(block, model)], pa.string()),
                    pa.ListArray.from_arrays(ends, cells)], ["id", "deviation", "whitened"])
                at += len(w)
    out = rows.filter(F.size("vec") == d).mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias("vec_id"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
                        components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error),
    a row per usable vector and component."""
    model = fit(vectors, id_col, vector_col, components=components, scale=scale, offset=offset)
    rows = whiten(vectors, model, id_col, vector_col, scale=scale, offset=offset)
    shares = [] if model is None else [float(e) / model.trace if model.trace > 0 else 0.0 for e in model.values]
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("at"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
                      "deviation", "whitened", share.alias("explained"),
                      F.lit(model.error if model else 0.0).cast("double").alias("identity_error"))
