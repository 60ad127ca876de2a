"""The command line from a job file to its result, on row-blocks and on an array container."""

import json

import numpy as np
import pytest

from sinoflow.__main__ import main
from sinoflow.operators import transforms as T
from sinoflow.plans import reconstruct as R
from sinoflow.sources import container, volumes
from sinoflow.sources.shared import Shared


@pytest.mark.parametrize("contained", [False, True])
def test_job(spark, tmp_path, capsys, contained):
    theta = T.even_angles(8)
    y = np.random.default_rng(0).uniform(size=(4, 8, 11))
    at, sino = str(tmp_path / "in"), volumes.from_numpy(spark, y)
    if contained:
        container.write_array(volumes.from_numpy(spark, y.transpose(1, 0, 2)), at, "sino")
        container.write_angles(spark, theta, at, "theta")
    else:
        volumes.write_stack(sino, f"{at}/sino")
        volumes.write_angles(spark, theta, f"{at}/theta")
    job = {"filename": at, "dataset": "sino", "angles": "theta", "output": str(tmp_path / "out"), "axis": 5, "slices": [1, 3], "MBIR": {"num_iters": 1, "sigma": 50}}
    (tmp_path / "job.json").write_text(json.dumps(job))
    main([str(tmp_path / "job.json")])
    assert "iterations after 1 iterations" in capsys.readouterr().out
    got = volumes.to_numpy(container.read_array(spark, job["output"], "recon") if contained else volumes.read_stack(spark, job["output"]))
    part = volumes.from_numpy(spark, y[1:3])
    want = volumes.to_numpy(R.mbir(part, theta, 5.0, Shared(spark, "test"), 1, 1 / 50).images)
    assert got.shape == (2, 11, 11) and np.allclose(got, want, rtol=1e-5, atol=1e-6 * np.abs(want).max())
