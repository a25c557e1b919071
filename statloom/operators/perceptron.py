"""Perceptron in primal and dual form, trained by whole passes.

All rows that are misclassified under the current plane update it together, with
step ``rate / rows``, so a pass is one aggregation and the result does not depend
on row order.  Weights travel as literals.

A row without a label, without a vector or with an entry that is missing or not
finite takes no part in training and has no score, whatever the width.  Vectors of different lengths are
an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import schemas
from statloom.functions.labels import sign_label
from statloom.functions.vectors import components, linear_score, misclassified
from statloom.storage import literal_table

# Up to here sums are one generated expression per dimension; beyond, array arithmetic.
UNROLLED_DIMS = 16


@dataclass(frozen=True)
class Plane:
    w: tuple[float, ...]
    b: float


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _array_sums(
    rows: DataFrame, dims: int, parts: int, terms: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]
) -> list[float]:
    """Add up vectors of ``parts`` numbers, one per Arrow batch, over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts)
        for batch in batches:
            total += terms(batch, _matrix(batch, dims))
        yield pa.RecordBatch.from_arrays([pa.array(range(parts)), pa.array(total)], names=["j", "total"])

    partials = rows.mapInArrow(partial, "j BIGINT, total DOUBLE")
    found = dict(partials.groupBy("j").agg(F.sum("total")).collect())
    return [found.get(j, 0.0) for j in range(parts)]


def _wide(rows: DataFrame, **extra: Column) -> DataFrame:
    columns = [c.cast("double").alias(name) for name, c in extra.items()]
    return rows.select(F.col("x").cast("array<double>").alias("x"), *columns)


def _sums(rows: DataFrame, dims: int, factor: Column) -> list[float]:
    """``sum(factor)`` and ``sum(factor * x_j)`` for every dimension j."""
    if dims <= UNROLLED_DIMS:
        totals = [F.sum("factor")] + [F.sum(F.col("factor") * x) for x in components("x", dims)]
        return [v or 0.0 for v in rows.select("x", factor.cast("double").alias("factor")).agg(*totals).first()]

    def terms(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        f = _numbers(batch, "factor")
        return np.concatenate(([f.sum()], f @ x))

    return _array_sums(_wide(rows, factor=factor), dims, dims + 1, terms)


def _wrong_sums(rows: DataFrame, dims: int, plane: Plane) -> tuple[int, list[float]]:
    """Misclassified rows: their number, ``sum(y)`` and ``sum(y * x_j)``, in one job."""
    if dims <= UNROLLED_DIMS:
        xs = components("x", dims)
        y = F.col("y").cast("double")
        wrong = rows.where(misclassified(xs, y, plane.w, plane.b))
        row = wrong.agg(F.count("*"), F.sum(y), *[F.sum(y * x) for x in xs]).first()
        return row[0], [v or 0.0 for v in row[1:]]
    w = np.array(plane.w)

    def terms(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        y = _numbers(batch, "y")
        y = np.where(y * (x @ w + plane.b) <= 0, y, 0.0)
        return np.concatenate(([np.count_nonzero(y), y.sum()], y @ x))

    count, *sums = _array_sums(_wide(rows, y=F.col("y")), dims, dims + 2, terms)
    return round(count), sums


def _whole_vector(dims: int) -> Column:
    """No entry is missing or not finite; vectors of ``dims`` entries are checked in generated code, as far as unrolled."""
    missing = F.exists(F.col("x").cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.col("x").isNotNull() & ~missing
    if 0 < dims <= UNROLLED_DIMS:
        # The difference of a finite number and itself is 0, of any other it is not a number.
        gone = reduce(add, [v - v for v in (F.get("x", F.lit(j)).cast("double") for j in range(dims))])
        whole = F.when(F.size("x") == dims, gone == 0.0).otherwise(whole)
    return F.coalesce(whole, F.lit(False))


def _usable(rows: DataFrame, given: str = "y") -> tuple[DataFrame, int, int]:
    """Rows that count, their number, and the length of their vectors."""
    known = rows.where(F.col(given).isNotNull())
    one = known.where(F.col("x").isNotNull()).select(F.size("x")).first()
    usable = known.where(_whole_vector(one[0] if one else 0))
    count, shortest, dims = usable.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != dims:
        raise ValueError(f"vectors have between {shortest} and {dims} entries")
    return usable, count, dims or 0


def _next(plane: Plane, step: float, sums: list[float]) -> Plane:
    moved = Plane(tuple(v + step * s for v, s in zip(plane.w, sums[1:])), plane.b + step * sums[0])
    if not all(math.isfinite(v) for v in (*moved.w, moved.b)):
        raise ValueError("the plane is no longer finite: the step is too large for these numbers")
    return moved


def train_primal(rows: DataFrame, epochs: int, rate: float = 1.0, step: float | None = None) -> DataFrame:
    """Train on ``rows(x ARRAY, y)`` with y = 1 or -1; one result row per pass.

    Result as in PERCEPTRON_SCHEMA: rows misclassified before the pass and the
    plane after it.  Ends early once nothing is misclassified.
    """
    rows, count, dims = _usable(rows)
    step = rate / max(count, 1) if step is None else step
    plane = Plane((0.0,) * dims, 0.0)
    history = []
    for epoch in range(1, epochs + 1):
        n_wrong, sums = _wrong_sums(rows, dims, plane)
        plane = _next(plane, step, sums)
        history.append((epoch, n_wrong, list(plane.w), plane.b))
        if n_wrong == 0:
            break
    return literal_table(rows.sparkSession, history, schemas.PERCEPTRON_SCHEMA)


def last_plane(model: DataFrame) -> Plane:
    row = model.orderBy(F.desc("epoch")).first()
    return Plane(tuple(row["w"]), row["b"])


def _plane_score(plane: Plane) -> Column:
    """``w . x + b``: one generated expression for few dimensions, array arithmetic for many."""
    dims = len(plane.w)
    if dims <= UNROLLED_DIMS:
        score = linear_score(components("x", dims), plane.w, plane.b)
    else:
        products = F.zip_with(F.col("x").cast("array<double>"), F.lit(list(plane.w)), lambda x, w: x * w)
        score = F.aggregate(products, F.lit(0.0), lambda total, p: total + p) + F.lit(float(plane.b))
    return F.when(_whole_vector(dims) & (F.size("x") == dims), score)


def predict(rows: DataFrame, plane: Plane) -> DataFrame:
    """Add ``score`` and ``predicted`` (+1 on the plane itself)."""
    return rows.withColumn("score", _plane_score(plane)).withColumn("predicted", sign_label("score"))


def weights_from_dual(rows: DataFrame, dims: int) -> list[float]:
    """``sum(alpha * y)`` and then ``sum(alpha * y * x_j)`` per dimension, over rows that took part."""
    return _sums(rows.where("alpha IS NOT NULL"), dims, F.col("alpha") * F.col("y"))


def train_dual(
    rows: DataFrame, epochs: int, rate: float = 1.0, step: float | None = None
) -> tuple[DataFrame, Plane]:
    """Train on ``rows(row_id, x, y)``; returns ``(row_id, x, y, alpha)`` and the plane.

    Each pass raises ``alpha`` of the misclassified rows by a step.  The score
    ``sum_j alpha_j y_j (x_j . x_i) + b`` is ``w . x_i + b`` with ``w = sum_j
    alpha_j y_j x_j``, and a pass adds ``step * y x`` of the misclassified rows
    to ``w``: the same numbers without a table of all pairs of rows.  How often a
    row was misclassified is counted once, at the end, from the passes' planes.
    Rows that take no part have no ``alpha``.
    """
    usable, count, dims = _usable(rows)
    step = rate / max(count, 1) if step is None else step
    planes = [Plane((0.0,) * dims, 0.0)]
    for _ in range(epochs):
        n_wrong, sums = _wrong_sums(usable, dims, planes[-1])
        if n_wrong == 0:
            break
        planes.append(_next(planes[-1], step, sums))
    used = planes[:-1] if len(planes) > epochs else planes
    w, b = np.array([p.w for p in used]).reshape(len(used), dims), np.array([p.b for p in used])

    def with_alpha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _numbers(batch, "known_y")
            x = batch.column("known_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.empty((len(y), 0))
            alpha = step * np.count_nonzero(y[:, None] * (x @ w.T + b) <= 0, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(alpha)], [*batch.schema.names[:-2], "alpha"])

    typed = rows.select("row_id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"))
    counts = _whole_vector(dims) & F.col("y").isNotNull()
    known = typed.withColumns({"known_x": F.when(counts, F.col("x")).otherwise(F.array_repeat(F.lit(0.0), dims)), "known_y": F.coalesce(F.col("y").cast("double"), F.lit(0.0))})
    schema = T.StructType([*typed.schema.fields, T.StructField("alpha", T.DoubleType())])
    state = known.mapInArrow(with_alpha, schema)
    return state.withColumn("alpha", F.when(counts, F.col("alpha"))), planes[-1]


def gram_product(rows: DataFrame, coefficient: Column) -> DataFrame:
    """Add ``product`` = ``sum_j c_j (x_j . x_i)``: the Gram matrix applied to ``c``.

    Two linear passes; the matrix itself is never built.  Rows without a whole
    vector or a coefficient add nothing; without a whole vector there is no product.
    """
    usable, _, dims = _usable(rows.withColumn("_c", coefficient), "_c")
    _, *w = _sums(usable, dims, F.col("_c"))
    return rows.withColumn("product", _plane_score(Plane(tuple(w), 0.0)))
