"""Command line: ``python -m sinoflow JOB.json [--method toeplitz|direct]``.

Reads the sinogram and the angles that the job names under its file, reconstructs, and writes to the job's output. A file
that is an array container holds the sinogram as (projection, slice, column) and gets its result as array ``recon`` of
a container; else both are row-blocks in Parquet.
"""

from __future__ import annotations

import argparse

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from .plans.reconstruct import mbir
from .sources import container, volumes
from .sources.jobs import load_job
from .sources.shared import Shared


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="sinoflow", description=__doc__)
    args.add_argument("job")
    args.add_argument("--method", choices=("toeplitz", "direct"), default="toeplitz")
    given = args.parse_args(argv)
    job, spark = load_job(given.job), SparkSession.builder.getOrCreate()
    save, (begin, end) = Shared(spark, "job"), job.slices or (0, -1)
    fs, root = container.filesystem(f"{job.filename}/{job.dataset}/.zarray")
    contained = fs.get_file_info(root).type == pafs.FileType.File
    if contained:
        sino = container.read_array(spark, job.filename, job.dataset, begin, end, projections_first=True)
        theta = container.read_vector(spark, job.filename, job.angles)
    else:
        sino = volumes.read_stack(spark, f"{job.filename}/{job.dataset}", begin, end)
        theta = volumes.read_angles(spark, f"{job.filename}/{job.angles}")
    sino = save(sino.withColumn("slice_id", sino["slice_id"] - begin), "sinogram")
    center = len(sino.first()["values"]) / 2 if job.axis is None else float(job.axis)
    out = mbir(sino, theta, center, save, job.num_iters, 1 / job.sigma, tol=job.tol, xtol=job.xtol, method=given.method)
    if contained:
        container.write_array(out.images, job.output, "recon", "f4", overwrite=True)
    else:
        volumes.write_stack(out.images, job.output, "overwrite")
    print(f"{out.ended} after {len(out.errors)} iterations; errors {out.errors}")
    save.drop("")


if __name__ == "__main__":
    main()
