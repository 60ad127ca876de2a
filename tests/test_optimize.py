"""The optimizer against plain replays in NumPy, retried and repeated steps included, and on a problem of the user's."""

import numpy as np
import pytest

from sinoflow import image_queries
from sinoflow.operators import arrays as A
from sinoflow.operators import chunked, toeplitz
from sinoflow.operators import transforms as T
from sinoflow.plans import optimize
from sinoflow.plans import reconstruct as R
from sinoflow.sources import volumes
from sinoflow.sources.shared import Shared


def prior(v, sigma):
    e = np.pad(v, ((1, 1), (0, 0), (0, 0)), mode="edge")
    return np.stack([chunked.prior_slice(*e[k : k + 3], sigma) for k in range(len(v))])


def replay(x, gradient, error, iterations, step, shrink=0.9):
    """Backtracking as the formulas say, on whole arrays."""
    s, t, now, errors, steps = x, 1.0, 1.0, [], []
    for _ in range(iterations):
        tried = [step]
        while True:
            beta, now = now * (1 / t - 1), 0.5 * (np.sqrt(t**4 + 4 * t**2) - t**2)
            y = s + (s - x) * beta
            g = gradient(y)
            s = y - g * tried[-1]
            if error(s) <= error(y) + 0.5 * tried[-1] * (g**2).sum():
                break
            tried.append(tried[-1] * shrink)
        t, x = now, s
        errors.append(error(s))
        steps.append(tried)
    return s, errors, steps


def replay_fixed(s, gradient, error, iterations, step):
    x, t, now, before, errors, again = s, 1.0, 1.0, np.inf, [], 0
    for _ in range(iterations):
        y = s + (s - x) * (now * (1 / t - 1))
        x, s = s, y - gradient(y) * step
        t, now = now, 0.5 * (np.sqrt(t**4 + 4 * t**2) - t**2)
        e = error(s)
        if e > before:
            s = x - gradient(x) * step
            e, again = error(s), again + 1
        before = e
        errors.append(e)
    return s, errors, again


def problem(method, n=11, slices=4, angles=9):
    r, theta = np.random.default_rng(4), T.even_angles(angles)
    y, x = r.uniform(size=(slices, angles, n)) / 1000, r.uniform(size=(slices, n, n)) / 1000
    normal = (lambda v: toeplitz.convolve(v, toeplitz.transfer(theta, n))) if method == "toeplitz" else (lambda v: T.normal_slice(v, theta))
    back = np.stack([T.backproject_slice(m, theta) for m in y])
    apply = lambda v: np.stack([normal(m) for m in v])
    sigma = 10.0
    gradient = lambda v: apply(v) - back + prior(v, sigma)
    error = lambda v: float(np.sqrt(max(0.0, (y**2).sum() + (v * (apply(v) - 2 * back)).sum())))
    return x, y, theta, sigma, gradient, error


@pytest.mark.parametrize("method", ["toeplitz", "direct"])
@pytest.mark.parametrize("step", [0.02, 1.0])
def test_fused_steps_as_a_replay(spark, method, step):
    x, y, theta, sigma, gradient, error = problem(method)
    want, errors, steps = replay(x, gradient, error, 2, step)
    assert (len(steps[0]) > 1) == (step == 1)
    save = Shared(spark, "test")
    back = save(T.backproject(volumes.from_numpy(spark, y), theta), "back")
    spread = None
    if method == "toeplitz":
        angles = spark.createDataFrame([(k, float(t)) for k, t in enumerate(theta)], "proj_id long, theta double")
        spread = toeplitz.Stored(save(toeplitz.spread_rows(angles, 11), "spread"))
    fused = R.Fused(back, float((y**2).sum()), R.normal_of(theta, 11, spread), sigma, 1.2, save, parts=3)
    out = optimize.backtracking(fused, volumes.from_numpy(spark, x), 2, step)
    assert np.allclose(out.errors, errors, rtol=1e-7) and np.allclose([s for t in out.steps for s in t], [s for t in steps for s in t])
    assert np.allclose(volumes.to_numpy(out.images), want, atol=1e-8 * np.abs(want).max())


def test_a_step_is_two_jobs_and_leaves_one_table(spark):
    x, y, theta, sigma, *_ = problem("direct")
    save = Shared(spark, "test")
    back = save(T.backproject(volumes.from_numpy(spark, y), theta), "back")
    fused = R.Fused(back, 1.0, R.normal_of(theta, 11), sigma, 1.2, save, parts=2)
    state = fused.begin(volumes.from_numpy(spark, x))
    frames = []
    save_, fused.save = fused.save, lambda df, name: frames.append(name) or save(df, name)
    fused.save.drop = save_.drop
    state, _ = fused.step(state, 0.0, 0.01)
    assert len(frames) == 1 and state[0].count() == 44
    import os

    assert sorted(os.listdir(save.root.removeprefix("file://"))) == ["back", "step1"]


def test_fixed_steps_as_a_replay(spark):
    x, y, theta, sigma, gradient, error = problem("direct", 7, 2, 9)
    step = 1.0
    want, errors, again = replay_fixed(x, gradient, error, 10, step)
    assert again
    save = Shared(spark, "test")
    back = save(T.backproject(volumes.from_numpy(spark, y), theta), "back")
    fused = R.Fused(back, float((y**2).sum()), R.normal_of(theta, 7), sigma, 1.2, save)
    out = optimize.fixed(fused, volumes.from_numpy(spark, x), 10, step)
    assert np.allclose(out.errors, errors, rtol=1e-7) and sum(len(s) > 1 for s in out.steps) == again
    assert np.allclose(volumes.to_numpy(out.images), want, atol=1e-8 * np.abs(want).max())


@pytest.mark.parametrize("step", [0.25, 3.0])
def test_functions_of_the_user(spark, step):
    """min of sum w/2 (x - v)^2 + x^2 / 2: x = w v / (w + 1)."""
    r = np.random.default_rng(1)
    v, w = r.normal(size=(2, 3, 4)), np.array([2.0, 3.0, 2.0, 3.0])
    frame = volumes.from_numpy(spark, v)
    weight = lambda k: 2.0 + (k % 2)
    from pyspark.sql import functions as F

    pull = lambda x: A.zip_arrays(x, frame, lambda a, b: a - b)
    gradient = lambda x: A.add(pull(x).select("slice_id", "row_id", F.transform("values", lambda d, k: d * weight(k)).alias("values")), x)
    error = lambda x: pull(x).agg(F.sum(F.aggregate(F.transform("values", lambda d, k: d * d * weight(k) / 2), F.lit(0.0), lambda s, d: s + d))).first()[0] + x.agg(A.squares(x)).first()[0] / 2
    plain = (lambda x: w * (x - v) + x, lambda x: float((w / 2 * (x - v) ** 2).sum() + (x**2).sum() / 2))
    for how, again in ((optimize.backtracking, replay), (optimize.fixed, replay_fixed)):
        if how is optimize.fixed and step > 1:
            continue
        save = Shared(spark, "test")
        out = how(optimize.Callables(gradient, error, save), A.each(frame, lambda a: a * 0.0), 4, step)
        want, errors, _ = again(v * 0, *plain, 4, step)
        assert np.allclose(out.errors, errors) and np.allclose(volumes.to_numpy(out.images), want)
        if step < 1:
            assert np.allclose(want, w * v / (w + 1), atol=0.05)


@pytest.mark.parametrize("size", [1e3, 1e6, 1e9])
def test_least_squares_of_values_of_any_size(spark, monkeypatch, size):
    v = np.round(np.random.default_rng(2).uniform(size=(2, 3, 4)) * size)
    monkeypatch.setattr(image_queries, "volume", lambda spark, sf_dir: volumes.from_numpy(spark, v))
    w = np.array([3.0, 4.0, 3.0, 4.0])
    assert np.abs(volumes.to_numpy(image_queries.ridge(spark, "")) - v * w / (w + 1)).max() < 1e-4


def test_steps_that_do_not_come_near_are_an_error(spark):
    frame = volumes.from_numpy(spark, np.ones((1, 1, 2)))
    still = optimize.Callables(lambda x: A.each(x, lambda a: a * 0.0 + 1.0), lambda x: 0.0, Shared(spark, "test"))
    with pytest.raises(RuntimeError, match="gradient's norm"):
        optimize.backtracking(still, frame, 1, 0.5, within=0.1, most=2)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_prior_by_chunks(spark, parts):
    v = np.random.default_rng(parts).normal(size=(7, 5, 6))
    got = volumes.to_numpy(chunked.prior_chunks(volumes.from_numpy(spark, v), 2.0, parts=parts))
    assert np.allclose(got, volumes.to_numpy(A.prior_gradient(volumes.from_numpy(spark, v), 2.0)))
    assert chunked.prior_chunks(volumes.from_numpy(spark, v).limit(0), 2.0).count() == 0


def test_arrays_of_unequal_dimensions(spark):
    a = volumes.from_numpy(spark, np.ones((2, 3, 4)))
    for b in (a.where("row_id < 2"), volumes.from_numpy(spark, np.ones((2, 3, 5))), volumes.from_numpy(spark, np.ones((3, 3, 4)))):
        for x, y in ((a, b), (b, a)):
            with pytest.raises(Exception, match="differ in their dimensions"):
                A.add(x, y).collect()
