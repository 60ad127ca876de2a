"""Non-uniform transforms of tables of points against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoflow.operators import nufft, toeplitz
from sinoflow.operators import transforms as T


def points_of(spark, slices, n, seed=0):
    r = np.random.default_rng(seed)
    rows = [(s, k, *map(float, r.uniform(-7, 7, 2)), *map(float, r.normal(size=2))) for s in slices for k in range(n)]
    return rows, spark.createDataFrame(rows, "slice_id int, point_id long, x double, y double, re double, im double")


def waves(p, rows, cols, sign):
    x, y = p[:, 2], p[:, 3]
    return np.exp(sign * 1j * np.outer(y, np.arange(rows) - rows // 2)), np.exp(sign * 1j * np.outer(x, np.arange(cols) - cols // 2))


@pytest.mark.parametrize(("rows", "cols", "eps", "most"), [(9, 14, 1e-12, 1 << 19), (90, 40, 1e-9, 50), (33, 101, 1e-6, 1 << 19), (40, 41, 1e-3, 20)])
def test_both_types_within_the_tolerance(spark, rows, cols, eps, most):
    rows_, df = points_of(spark, (0, 3), 150)
    modes = {(r["slice_id"], r["row_id"]): np.array(r["re"]) + 1j * np.array(r["im"]) for r in nufft.to_modes(df, rows, cols, eps, most).collect()}
    assert set(modes) == {(s, j) for s in (0, 3) for j in range(rows)}
    image = np.random.default_rng(5).normal(size=(rows, cols))
    frame = spark.createDataFrame([(3, j, [float(v) for v in line]) for j, line in enumerate(image)], T.ROWS)
    read = {(r["slice_id"], r["point_id"]): complex(r["re"], r["im"]) for r in nufft.to_points(frame, df, rows, cols, eps, most).collect()}
    assert len(read) == 300
    for s in (0, 3):
        p = np.array([r for r in rows_ if r[0] == s])
        ey, ex = waves(p, rows, cols, 1)
        want = ey.T @ ((p[:, 4] + 1j * p[:, 5])[:, None] * ex)
        got = np.array([modes[s, j] for j in range(rows)])
        assert np.linalg.norm(got - want) < 10 * eps * np.linalg.norm(want)
        ey, ex = waves(p, rows, cols, -1)
        want = ((ey @ image) * ex).sum(1) * (s == 3)
        got = np.array([read[s, k] for k in range(150)])
        assert np.linalg.norm(got - want) <= 10 * eps * np.linalg.norm(want)


def test_odd_points(spark):
    rows = [(0, 1, 0.5, 0.25, 1.0, 0.0), (0, 1, 0.5, 0.25, 1.0, 0.0), (0, 2, None, 0.0, 1.0, 0.0), (0, 3, float("inf"), 0.0, 1.0, 0.0), (0, 4, float("nan"), 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "slice_id int, point_id long, x double, y double, re double, im double")
    out = np.array([r["re"] for r in nufft.to_modes(df, 4, 6).orderBy("row_id").collect()])
    assert np.allclose(out, 2 * np.cos(np.arange(-3, 3) * 0.5 + (np.arange(-2, 2) * 0.25)[:, None]))
    image = spark.createDataFrame([(0, 0, [1.0] * 6)], T.ROWS)
    assert [r["point_id"] for r in nufft.to_points(image, df, 4, 6).collect()] == [1, 1]
    assert nufft.to_modes(df.limit(0), 4, 6).count() == 0 and nufft.to_points(image, df.limit(0), 4, 6).count() == 0


@pytest.mark.parametrize("n", [9, 40])
def test_point_spread_of_a_table_of_angles(spark, n):
    theta = T.even_angles(7)
    angles = spark.createDataFrame([(k, float(t)) for k, t in enumerate(theta)], "proj_id long, theta double")
    got = np.array([r["values"] for r in toeplitz.spread_rows(angles, n).orderBy("row_id").collect()])
    want = toeplitz.point_spread(theta, n)
    assert np.abs(got - want).max() < 1e-10 * np.abs(want).max()


def test_points_of_a_full_tile_stay_where_they_are_read(spark):
    """A point learns its part without a shuffle: with one by tile, all points of a tile were one task's."""
    _, df = points_of(spark, (0,), 400)
    near = df.select("slice_id", "point_id", F.lit(0).alias("tr"), F.lit(0).alias("tc"))
    cut = nufft._cut(near, nufft._parts(near, 50))
    held = [r["count"] for r in cut.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert sum(held) == 400 and max(held) <= 100
    parts = [r["count"] for r in cut.groupBy("part").count().collect()]
    assert len(parts) == 8 and max(parts) <= 100


def test_point_spread_of_repeated_angles(spark, monkeypatch):
    """An angle that occurs often is a point of that weight, so the points are no more than the angles that differ."""
    theta = np.concatenate([np.repeat(T.even_angles(5), 40), [0.3]])
    angles = spark.createDataFrame([*((k, float(t)) for k, t in enumerate(theta)), (900, None), (901, float("nan"))], "proj_id long, theta double")
    seen = []
    to_modes = nufft.to_modes
    monkeypatch.setattr(nufft, "to_modes", lambda points, *how: seen.append(points) or to_modes(points, *how))
    got = np.array([r["values"] for r in toeplitz.spread_rows(angles, 9).orderBy("row_id").collect()])
    want = toeplitz.point_spread(theta, 9)
    assert np.abs(got - want).max() < 1e-10 * np.abs(want).max()
    assert seen[0].where("x is not null and not isnan(x)").count() == 6 * 9
