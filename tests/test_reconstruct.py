"""Sources, job configuration, the Toeplitz form and whole reconstructions."""

import numpy as np
import pytest

from sinoflow.operators import arrays as A
from sinoflow.operators import toeplitz
from sinoflow.operators import transforms as T
from sinoflow.plans import reconstruct as R
from sinoflow.sources import container, jobs, volumes


@pytest.fixture
def save(spark, tmp_path):
    return lambda d, name: (d.write.mode("overwrite").parquet(f"{tmp_path}/s/{name}"), spark.read.parquet(f"{tmp_path}/s/{name}"))[1]


def test_numpy_and_parquet_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(5, 3, 4))
    at = f"{tmp_path}/stack"
    volumes.write_stack(volumes.from_numpy(spark, a), at)
    assert np.array_equal(volumes.to_numpy(volumes.read_stack(spark, at)), a)
    assert np.array_equal(volumes.to_numpy(volumes.read_stack(spark, at, 1, 3)), a[1:3])
    assert np.array_equal(volumes.to_numpy(volumes.read_stack(spark, at, projections_first=True)), a.transpose(1, 0, 2))
    assert volumes.to_numpy(volumes.from_numpy(spark, a[0])).shape == (1, 3, 4)
    for begin, end in ((-1, 2), (3, 3)):
        with pytest.raises(ValueError):
            volumes.read_stack(spark, at, begin, end)


def test_slice_range_reaches_the_scan(spark, tmp_path, capsys):
    at = f"{tmp_path}/stack"
    volumes.write_stack(volumes.from_numpy(spark, np.zeros((4, 2, 3))), at)
    volumes.read_stack(spark, at, 1, 3).explain()
    assert "GreaterThanOrEqual(slice_id,1)" in capsys.readouterr().out


def test_angles_and_raw_files(spark, tmp_path):
    t = T.even_angles(7)
    volumes.write_angles(spark, t, f"{tmp_path}/angles")
    assert np.array_equal(volumes.read_angles(spark, f"{tmp_path}/angles"), t)
    a = np.arange(4 * 3 * 5, dtype="<f4").reshape(4, 3, 5)
    (tmp_path / "raw").mkdir()
    a[:1].tofile(tmp_path / "raw/0.bin")
    a[1:].tofile(tmp_path / "raw/1.bin")
    assert np.array_equal(volumes.to_numpy(container.read_raw(spark, f"{tmp_path}/raw", 3, 5)), a)
    (tmp_path / "raw/2.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        container.read_raw(spark, f"{tmp_path}/raw", 3, 5).count()


def test_jobs():
    text = '{"filename": "f", "dataset": "d", "angles": "a", "output": "o", "axis": 3, "slices": [0, 2], "MBIR": {"num_iters": 2, "sigma": 9}}'
    job = jobs.parse_job(text)
    assert (job.slices, job.sigma, job.num_iters, job.tol, job.xtol) == ((0, 2), 9.0, 2, 0.001, 0.001)
    for bad in ('{"filename": "f"}', text.replace("9", "0"), text.replace("[0, 2]", "[2, 2]")):
        with pytest.raises(ValueError):
            jobs.parse_job(bad)


@pytest.mark.parametrize("n", [9, 8, 15])
def test_toeplitz_is_the_normal_operator(n):
    x, t = np.random.default_rng(2).normal(size=(n, n)), T.even_angles(7)
    assert np.allclose(toeplitz.convolve(x, toeplitz.transfer(t, n)), T.normal_slice(x, t))


def test_misfit_and_plane(spark):
    r, t = np.random.default_rng(3), T.even_angles(6)
    x, y = r.normal(size=(2, 9, 9)), r.normal(size=(2, 6, 9))
    images, sino = volumes.from_numpy(spark, x), volumes.from_numpy(spark, y)
    got = toeplitz.misfit(images, T.backproject(sino, t), toeplitz.transfer(t, 9), float((y**2).sum()))
    assert np.isclose(got, T.error(images, sino, t))
    assert np.allclose(volumes.to_numpy(toeplitz.multiply_all(images, x[0])), x * x[0])


def disk(n: int) -> np.ndarray:
    k = np.arange(n) - n // 2
    return (k[:, None] ** 2 + k**2 <= (n // 4) ** 2).astype(float)


@pytest.mark.parametrize("method", ["toeplitz", "direct"])
def test_solver_lowers_the_misfit(spark, save, method):
    t = T.even_angles(12)
    sino = volumes.from_numpy(spark, np.stack([T.project_slice(disk(15), t)] * 2))
    start = volumes.from_numpy(spark, np.zeros((2, 15, 15)))
    out = R.solve(start, sino, t, save, 2, 100.0, method=method)
    assert len(out.errors) == 2 and out.errors[1] < out.errors[0] < np.sqrt(T.error(start, sino, t))


def test_whole_reconstructions(spark, save):
    t = T.even_angles(12)
    sino = volumes.from_numpy(spark, T.project_slice(disk(15), t))
    assert A.dims(R.fbp(sino, t, 8.0)).first()[1:] == (15, 15)
    assert A.dims(R.adjoint(sino, t, 8.0)).first()[1:] == (15, 15)
    assert A.dims(R.mbir(sino, t, 8.0, save, 1).images).first()[1:] == (15, 15)
    flat = R.mbir(volumes.from_numpy(spark, np.zeros((1, 12, 15))), t, 8.0, save, 1)
    assert flat.ended == "empty" and not volumes.to_numpy(flat.images).any()
    with pytest.raises(ValueError):
        R.mbir(sino, t, 8.0, save, smoothness=0)


def test_circular_mask(spark):
    got = volumes.to_numpy(R.circular_mask(volumes.from_numpy(spark, np.ones((1, 9, 9)))))[0]
    k = np.arange(9) - 4
    assert np.array_equal(got, (k[:, None] ** 2 + k**2 <= 4.5**2).astype(float))
