"""Array containers and raw files: round trips, what is read of them, and tasks that are tried again."""

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sinoflow.operators import spectra as S
from sinoflow.sources import container, volumes


def complex_of(df):
    rows = sorted(df.collect(), key=lambda r: (r["slice_id"], r["row_id"]))
    return np.array([np.array(r["re"]) + 1j * np.array(r["im"]) for r in rows])


@pytest.mark.parametrize(("dtype", "compressor", "chunk_bytes"), [("f8", None, 1 << 20), ("f8", "zlib", 64), ("f4", "zstd", 100)])
def test_real_round_trip(spark, tmp_path, dtype, compressor, chunk_bytes):
    a = np.random.default_rng(0).normal(size=(5, 7, 4)).astype(dtype).astype(float)
    container.write_array(volumes.from_numpy(spark, a), str(tmp_path), "recon", dtype, compressor, chunk_bytes)
    back = container.read_array(spark, str(tmp_path), "recon")
    assert back.columns == ["slice_id", "row_id", "values"] and np.array_equal(volumes.to_numpy(back), a)
    assert np.array_equal(volumes.to_numpy(container.read_array(spark, f"file://{tmp_path}", "recon", 1, 3)), a[1:3])
    assert np.array_equal(volumes.to_numpy(container.read_array(spark, str(tmp_path), "recon", projections_first=True)), a.transpose(1, 0, 2))
    swapped = container.read_array(spark, str(tmp_path), "recon", 2, 4, projections_first=True)
    assert np.array_equal(volumes.to_numpy(swapped), a.transpose(1, 0, 2)[2:4])
    with pytest.raises(Exception, match="exists"):
        container.write_array(volumes.from_numpy(spark, a), str(tmp_path), "recon", dtype)
    container.write_array(volumes.from_numpy(spark, a[:2]), str(tmp_path), "recon", dtype, overwrite=True)
    assert np.array_equal(volumes.to_numpy(container.read_array(spark, str(tmp_path), "recon")), a[:2])
    for begin, end in ((-1, 2), (3, 3)):
        with pytest.raises(ValueError):
            container.read_array(spark, str(tmp_path), "recon", begin, end)


def test_complex_and_one_dimension(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(2, 3, 5))
    z = S.fft1d(S.to_complex(volumes.from_numpy(spark, a)))
    for dtype, near in (("c16", 0), ("c8", 1e-5)):
        container.write_array(z, str(tmp_path), f"spectrum-{dtype}", dtype)
        assert np.abs(complex_of(container.read_array(spark, str(tmp_path), f"spectrum-{dtype}")) - np.fft.fft(a).reshape(6, 5)).max() <= near + 1e-12
    theta = np.arange(7) * 0.1
    container.write_angles(spark, theta, str(tmp_path), "angles")
    assert np.array_equal(container.read_vector(spark, str(tmp_path), "angles"), theta)
    line = spark.createDataFrame([(k, float(k), -float(k)) for k in range(100)], "place long, re double, im double").repartition(4)
    container.write_array(line, str(tmp_path), "line", chunk_bytes=160)
    assert len(list((tmp_path / "line").glob("[0-9]*"))) == 10
    assert np.array_equal(container.read_vector(spark, str(tmp_path), "line"), np.arange(100) * (1 - 1j))
    some = container.read_array(spark, str(tmp_path), "line")
    some = container.read_array(spark, str(tmp_path), "line", 25, 31)
    assert sorted(r["place"] for r in some.collect()) == list(range(25, 31)) and some.rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        container.write_array(line, str(tmp_path), "wrong", "f8")


def test_only_asked_chunks_are_read(spark, tmp_path):
    a = np.arange(10 * 6 * 4, dtype=float).reshape(10, 6, 4)
    container.write_array(volumes.from_numpy(spark, a), str(tmp_path), "a", chunk_bytes=64)  # two rows a chunk
    assert len(list((tmp_path / "a").glob("[0-9]*"))) == 30
    for f in (tmp_path / "a").glob("[0-9]*"):
        s, r, _ = map(int, f.name.split("."))
        if not (3 <= s < 6 and r == 1):
            f.write_bytes(b"not to be opened")
    some = container.read_array(spark, str(tmp_path), "a", 3, 6, rows=(2, 4))
    assert some.rdd.getNumPartitions() == 3
    assert np.array_equal(volumes.to_numpy(some), a[3:6, 2:4])
    assert some.where("slice_id = 4 and row_id = 3").first()["values"] == a[4, 3].tolist() and some.count() == 6  # a frame that is read twice
    assert container.read_array(spark, str(tmp_path), "a", 20).count() == 0
    with pytest.raises(Exception, match="reshape|buffer"):
        container.read_array(spark, str(tmp_path), "a").count()


def test_store_of_others(spark, tmp_path):
    """Chunks that cut all axes, chunks that are not there, and types we do not write."""
    a = np.random.default_rng(2).integers(0, 99, (4, 5, 7)).astype("<i2")
    at = tmp_path / "x"
    at.mkdir()
    (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [4, 5, 7], "chunks": [3, 2, 4], "dtype": "<i2", "compressor": None, "fill_value": 5, "order": "C", "filters": None}))
    wide = np.zeros((6, 6, 8), "<i2")
    wide[:4, :5, :7] = a
    for i in range(2):
        for j in range(3):
            for k in range(2):
                if (i, j, k) != (1, 1, 0):
                    (at / f"{i}.{j}.{k}").write_bytes(np.ascontiguousarray(wide[3 * i : 3 * i + 3, 2 * j : 2 * j + 2, 4 * k : 4 * k + 4]).tobytes())
    a[3:, 2:4, :4] = 5
    assert np.array_equal(volumes.to_numpy(container.read_array(spark, str(tmp_path), "x")), a)
    for bad in ({"order": "F"}, {"zarr_format": 3}, {"filters": [{"id": "delta"}]}):
        with pytest.raises(ValueError):
            container.Layout.of(json.dumps({"zarr_format": 2, "shape": [1], "chunks": [1], "dtype": "<f8", "fill_value": 0} | bad).encode())


def test_a_task_tried_again_leaves_no_second_copy(tmp_path):
    layout = container.Layout((2, 2, 3), (1, 2, 3), "<f8")
    writer = container.ContainerWriter(str(tmp_path / "a"), layout, False)
    rows = lambda s: pa.record_batch({"slice_id": pa.array([s, s], pa.int32()), "row_id": pa.array([0, 1], pa.int32()), "values": pa.array([[s + 1.0] * 3] * 2)})

    def lost():
        yield rows(0)
        yield rows(1)
        raise RuntimeError("the executor is lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert not (tmp_path / "a/.zarray").exists()  # nothing can be read yet
    again = writer.write(iter([rows(0), rows(1)]))
    assert (again.names, again.rows) == (["0.0.0", "1.0.0"], 4)
    with pytest.raises(ValueError):
        writer.commit([again, writer.write(iter([rows(1)]))])
    writer.commit([again, None])
    assert sorted(f.name for f in Path(tmp_path / "a").iterdir()) == [".zarray", "0.0.0", "1.0.0"]
    writer.abort([again])
    assert not (tmp_path / "a").exists()


def test_raw_files_by_byte_range(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(23, 3, 5)).astype("<f4")
    a.tofile(tmp_path / "one.raw")
    df = container.read_raw(spark, str(tmp_path / "one.raw"), 3, 5, task_bytes=5 * 3 * 5 * 4)
    assert df.where("slice_id = 3").count() == 3 and df.rdd.getNumPartitions() == 5 and np.array_equal(volumes.to_numpy(df), a)
    some = container.read_raw(spark, str(tmp_path / "one.raw"), 3, 5, begin=7, end=9)
    assert some.rdd.getNumPartitions() == 1 and np.array_equal(volumes.to_numpy(some), a[7:9])
    at = str(tmp_path / "many")
    container.write_raw(df, at, 3, 5)
    assert b"".join(f.read_bytes() for f in sorted(Path(at).iterdir())) == a.tobytes()
    assert np.array_equal(volumes.to_numpy(container.read_raw(spark, at, 3, 5)), a)
    container.write_raw(volumes.from_numpy(spark, a[:2]), at, 3, 5, "<f8", overwrite=True)
    assert np.array_equal(volumes.to_numpy(container.read_raw(spark, at, 3, 5, "<f8")), a[:2])
    for bad in (df.where("slice_id <> 11"), df.where("slice_id <> 11 or row_id <> 2")):
        with pytest.raises(Exception, match="missing|is not"):
            container.write_raw(bad, str(tmp_path / "bad"), 3, 5, overwrite=True)
