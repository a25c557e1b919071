import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import perceptron as p
from statloom.operators import scaling

# Separable points.
POSITIVE = [(1, 3), (2, 2), (3, 8), (2, 6)]
NEGATIVE = [(2, 1), (4, 1), (6, 2), (7, 3)]


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, [float(a), float(b)], y) for i, (a, b, y) in enumerate([(*q, 1) for q in POSITIVE] + [(*q, -1) for q in NEGATIVE])]
    return spark.createDataFrame(rows, "row_id BIGINT, x ARRAY<DOUBLE>, y INT")


def test_separable_points_need_two_passes(separable):
    model = p.train_primal(separable, 20, step=1.0).collect()
    assert [r["misclassified"] for r in model] == [8, 0]
    assert model[0]["w"] == [-11.0, 12.0] and model[0]["b"] == 0.0
    scored = p.predict(separable, p.Plane((-11.0, 12.0), 0.0))
    assert scored.where("predicted <> y").count() == 0


def test_dual_equals_primal(separable):
    state, plane = p.train_dual(separable, 20, step=1.0)
    assert plane == p.Plane((-11.0, 12.0), 0.0)
    assert {r["alpha"] for r in state.collect()} == {1.0}
    total, *w = p.weights_from_dual(state, 2)
    assert (total, w) == (0.0, [-11.0, 12.0])


def numpy_passes(x, y, epochs):
    step, w, b, alpha = 1 / len(x), np.zeros(x.shape[1]), 0.0, np.zeros(len(x))
    for _ in range(epochs):
        wrong = y * (x @ w + b) <= 0
        w, b, alpha = w + step * (y * wrong) @ x, b + step * (y * wrong).sum(), alpha + step * wrong
    return w, b, alpha


@pytest.mark.parametrize("dims", [3, 40])
def test_both_forms_match_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    x, y = rng.standard_normal((120, dims)), rng.choice([1, -1], 120)
    rows = [(i, [float(v) for v in a], int(s)) for i, (a, s) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id BIGINT, x ARRAY<DOUBLE>, y INT")
    w, b, alpha = numpy_passes(x, y, 4)
    plane = p.last_plane(p.train_primal(df, 4))
    assert plane.w == pytest.approx(w) and plane.b == pytest.approx(b)
    state, dual = p.train_dual(df, 4)
    assert dual.w == pytest.approx(w) and dual.b == pytest.approx(b)
    got = [r["alpha"] for r in state.orderBy("row_id").collect()]
    assert got == pytest.approx(alpha)


@pytest.mark.parametrize("dims", [2, 30, 1024])
def test_gram_product_equals_all_products(spark, dims):
    rng = np.random.default_rng(9)
    x, c = rng.standard_normal((50, dims)), rng.standard_normal(50)
    df = spark.createDataFrame(
        [(i, [float(v) for v in a], float(s)) for i, (a, s) in enumerate(zip(x, c))], "row_id BIGINT, x ARRAY<DOUBLE>, c DOUBLE"
    )
    got = [r["product"] for r in p.gram_product(df, F.col("c")).orderBy("row_id").collect()]
    assert got == pytest.approx((x @ x.T) @ c)


@pytest.mark.parametrize("dims", [16, 17])
def test_rows_with_missing_numbers_take_no_part(spark, dims):
    rng = np.random.default_rng(dims)
    x, y = rng.standard_normal((30, dims)), rng.choice([1, -1], 30)
    rows = [(i, [float(v) for v in a], int(s)) for i, (a, s) in enumerate(zip(x, y))]
    odd = [(100, None, 1), (101, [None] + [1.0] * (dims - 1), 1), (103, [float("nan")] * dims, 1), (102, [1.0] * dims, None)]
    schema = "row_id BIGINT, x ARRAY<DOUBLE>, y INT"
    clean, mixed = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + odd, schema)
    for a, b in zip(p.train_primal(mixed, 3).collect(), p.train_primal(clean, 3).collect(), strict=True):
        assert (a["misclassified"], a["w"]) == (b["misclassified"], pytest.approx(b["w"]))
    state, plane = p.train_dual(mixed, 3)
    alphas = {r["row_id"]: r["alpha"] for r in state.collect()}
    assert len(alphas) == 34 and [alphas[i] for i in (100, 101, 102, 103)] == [None] * 4
    assert {i: a for i, a in alphas.items() if i < 100} == pytest.approx({r["row_id"]: r["alpha"] for r in p.train_dual(clean, 3)[0].collect()})
    scores = {r["row_id"]: r["score"] for r in p.predict(mixed, plane).collect()}
    assert scores[100] is None and scores[101] is None and scores[102] is not None


def test_ragged_vectors_and_endless_planes_are_errors(spark):
    schema = "row_id BIGINT, x ARRAY<DOUBLE>, y INT"
    with pytest.raises(ValueError, match="between 1 and 2"):
        p.train_primal(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], -1)], schema), 2)
    with pytest.raises(ValueError, match="finite"):
        p.train_primal(spark.createDataFrame([(1, [1e300], 1)], schema), 2, step=1e300)


def test_scaled_values_lie_between_zero_and_one(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1e6, 500)], "a DOUBLE")
    scaled = scaling.minmax_apply(df, scaling.minmax_stats(df, ["a"]), ["a"])
    assert tuple(scaled.agg(F.min("a"), F.max("a")).first()) == (0.0, 1.0)


def test_minmax(spark):
    df = spark.createDataFrame([(0.0, 7, 1.0), (10.0, 7, 3.0)], "a DOUBLE, b INT, c DOUBLE")
    stats = scaling.minmax_stats(df, ["a", "b"])
    new = spark.createDataFrame([(5.0, 7, 1.0), (20.0, 9, 2.0)], "a DOUBLE, b INT, c DOUBLE")
    assert scaling.minmax_apply(new, stats, ["a", "b"]).collect() == [(0.5, None, 1.0), (2.0, None, 2.0)]
    table = scaling.minmax_table(stats, ["a", "b"]).collect()
    assert [tuple(r) for r in table] == [("a", 0.0, 10.0, 10.0), ("b", 7.0, 7.0, 0.0)]
