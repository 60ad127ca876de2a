"""The array operators against their SQL, and the transforms against their identities."""

import duckdb
import numpy as np
import pytest

from sinoflow.operators import arrays as A
from sinoflow.operators import spectra as S
from sinoflow.operators import transforms as T
from sinoflow import image_queries, queries
from sinoflow.operators.gridding import Gridding
from sinoflow.plans import reconstruct as R

QUERIES, ORACLE_SQL = queries.QUERIES | image_queries.QUERIES, queries.ORACLE_SQL | image_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_as_sql(spark, small, db, name):
    got = QUERIES[name](spark, small).toPandas()
    want = db.execute(ORACLE_SQL[name]).df()[list(got.columns)]
    keys = [c for c in got.columns if c.endswith("_id")] or list(got.columns)
    got, want = (x.sort_values(keys).reset_index(drop=True).astype(float) for x in (got, want))
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-4, equal_nan=True)


def test_adjoint():
    r = np.random.default_rng(0)
    x, y, t = r.normal(size=(15, 15)), r.normal(size=(10, 15)), T.even_angles(10)
    assert np.isclose((T.project_slice(x, t) * y).sum(), (x * T.backproject_slice(y, t)).sum())
    assert np.allclose(T.backproject_slice(T.project_slice(x, t), t), T.normal_slice(x, t))


def plain_prior(v, sigma, p=1.2, c=0.001):
    e, out = np.pad(v, 1, mode="edge"), np.zeros_like(v)
    for a in range(3):
        for b in range(3):
            for d in range(3):
                far = abs(a - 1) + abs(b - 1) + abs(d - 1)
                if far:
                    x = v - e[a : a + v.shape[0], b : b + v.shape[1], d : d + v.shape[2]]
                    t = (np.abs(x) / sigma) ** (2 - p)
                    out += A.WEIGHTS[far - 1] * np.sign(x) * np.abs(x) / ((c + t) * sigma**2) * (2 - (2 - p) * t / (c + t))
    return out


def test_prior_and_solver(spark, tmp_path):
    r = np.random.default_rng(1)
    frame = lambda v: spark.createDataFrame([(s, k, [float(x) for x in row]) for s, m in enumerate(v) for k, row in enumerate(m)], T.ROWS)
    back = lambda d: np.array([row["values"] for row in d.orderBy("slice_id", "row_id").collect()])
    v = r.normal(size=(3, 5, 5))
    assert np.allclose(back(A.prior_gradient(frame(v), 2.0)), plain_prior(v, 2.0).reshape(-1, 5))
    t = T.even_angles(8)
    sino = frame([T.project_slice(m, t) for m in v])
    save = lambda d, name: (d.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    start = frame(np.zeros_like(v))
    for method in ("direct", "toeplitz"):
        own = lambda d, name, m=method: save(d, f"{m}-{name}")
        got = R.solve(start, sino, t, own, 2, 100.0, method=method).images
        assert T.error(got, sino, t) < T.error(start, sino, t)
    steep = back(A.add_curvature(frame(v), 2.0)) - v.reshape(-1, 5)
    assert np.allclose(steep, 0.9994 * 2 / (4 * 0.001))


@pytest.mark.parametrize("n", [128, 151])
def test_gridded_as_direct(n):
    r, t = np.random.default_rng(n), T.even_angles(9)
    x, f = r.normal(size=(n, n)), r.normal(size=(9, n)) + 1j * r.normal(size=(9, n))
    for got, want in ((T.to_polar(x, t), T.to_polar(x, t, 0)), (T.from_polar(f, t), T.from_polar(f, t, 0))):
        assert np.abs(got - want).max() < 1e-11 * np.abs(want).max()
    for eps in (1e-3, 1e-6, 1e-9):
        near = Gridding(*T.polar(t, n), n, eps)
        want = T.to_polar(x, t, 0).ravel()
        assert np.abs(near.to_points(x) - want).max() < 10 * eps * np.abs(want).max()


@pytest.mark.parametrize(("columns", "center", "offset"), [(61, 30.5, 0), (61, 30.0, 1), (61, 29.4, 2), (63, 31.5, 0), (64, 31.5, 0), (64, 32.0, 0)])
def test_recentre_at_halves(spark, columns, center, offset):
    """Halves of the centre go up."""
    row = [0.0] * columns
    row[10] = 1.0
    out = A.recentre(spark.createDataFrame([(0, 0, row)], T.ROWS), columns, center).first()["values"]
    pad = max(int(0.42 * columns) // 2, abs(offset))
    assert len(out) == columns + 2 * pad and out.index(1.0) == 10 + pad - offset


def test_spectra_of_rows_of_different_lengths(spark):
    rows = [(0, 0, [1.0, 2.0, 3.0]), (0, 1, [4.0]), (0, 2, []), (0, 3, [5.0, 6.0])]
    z = S.fft1d(S.to_complex(spark.createDataFrame(rows, T.ROWS).coalesce(1))).orderBy("row_id").collect()
    for r, (_, _, v) in zip(z, rows, strict=True):
        assert np.allclose(np.array(r["re"]) + 1j * np.array(r["im"]), np.fft.fft(v) if v else [])


def test_ramp_passes_nothing_from_the_cutoff_on(spark):
    row = [1.0] * 16
    out = A.ramp(spark.createDataFrame([(0, 0, row)], T.ROWS), 0.25).first()["values"]
    assert out == [abs(k - 8) / 16 if abs(k - 8) / 16 < 0.25 else 0.0 for k in range(16)]
