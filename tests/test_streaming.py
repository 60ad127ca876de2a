"""Streaming back-projection as the batch form, for files in any order, with late and repeated rows."""

import random

import numpy as np

from sinoflow.operators import spectra as S
from sinoflow.operators import transforms as T
from sinoflow.plans import reconstruct as R
from sinoflow.sources import volumes
from sinoflow.streaming import backproject


def test_as_the_batch_form(spark, tmp_path):
    theta, r = T.even_angles(6), random.Random(1)
    y = np.random.default_rng(0).normal(size=(5, 6, 12))
    want = volumes.to_numpy(R.fbp(volumes.from_numpy(spark, y), theta, 5.0))
    rows = [(s, k, [float(v) for v in y[s, k]]) for s in range(5) for k in range(6)]
    r.shuffle(rows)
    late = rows[:1]  # comes in the second run only
    files = [rows[1:9], rows[9:20], rows[5:12], rows[20:] + [(9, 0, rows[0][2]), (0, 77, rows[0][2]), (None, 1, rows[0][2]), (0, None, None)]]
    at, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for k, f in enumerate(files):
        spark.createDataFrame(f, T.ROWS).coalesce(1).write.mode("append").parquet(at)
    backproject.run(spark, at, out, state, theta, 5.0, 12, files=1)
    got = spark.read.parquet(out)
    missing = late[0][0]
    assert {x["slice_id"] for x in got.select("slice_id").distinct().collect()} == set(range(5)) - {missing}
    wrong = [(s, k, [99.0] * 12) for s, k, _ in rows[3:6] if s != missing]  # slices that have been given out
    spark.createDataFrame(late + wrong, T.ROWS).coalesce(1).write.mode("append").parquet(at)
    backproject.run(spark, at, out, state, theta, 5.0, 12)
    assert np.allclose(volumes.to_numpy(spark.read.parquet(out)), want)


def test_complex_arithmetic(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(2, 2, 3, 4))
    rows = lambda df: np.array([np.array(x["re"], float) + 1j * np.array(x["im"], float) for x in df.orderBy("slice_id", "row_id").collect()]).reshape(2, 3, 4)
    z, w = (S.fft1d(S.to_complex(volumes.from_numpy(spark, v))) for v in (a, b))
    p, q = np.fft.fft(a), np.fft.fft(b)
    for got, want in ((S.add(z, w), p + q), (S.subtract(z, w), p - q), (S.multiply(z, w), p * q), (S.divide(z, w), p / q)):
        assert np.allclose(rows(got), want)
    zero = S.divide(z, S.subtract(w, w)).first()
    assert set(zero["re"]) == set(zero["im"]) == {None}
