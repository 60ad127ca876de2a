"""Further queries over the supplied tables: images, spectra, transforms and whole reconstructions, with their SQL.

Most read the small volume of ``queries.volume`` (7 slices of 16 rows and 15 columns), squared to 17 x 17 where an image
is needed or read as a sinogram of 16 angles; SQL sums the transforms directly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import arrays as A
from .operators import chunked, nufft
from .operators import spectra as S
from .operators import toeplitz as Z
from .operators import transforms as T
from .plans import optimize
from .plans import reconstruct as R
from .queries import PAIR, SINO_CELLS, VOLUME, _cell, _of, _pad, _rounded, cells, sinograms, squared, volume
from .sources import container
from .sources.shared import Shared
from .streaming import backproject as streaming

N, ANGLES = 17, 12


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squared(volume(spark, sf_dir), 16, 15)


def places(df: DataFrame) -> DataFrame:
    """One row a place of a complex array."""
    c = df.select("slice_id", "row_id", F.posexplode(F.arrays_zip("re", "im")).alias("col_id", "z"))
    return c.select(*(F.col(k).cast("long").alias(k) for k in ("slice_id", "row_id", "col_id")), *((F.round(F.col("z")[k], 5) + F.lit(0.0)).alias(k) for k in ("re", "im")))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(proj_id, theta): a projection a vector, at a whole number of degrees."""
    of = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return of.select(F.col("vec_id").cast("long").alias("proj_id"), (F.col("vec_id") % 180 * F.lit(math.pi) / 180).alias("theta"))


def points(spark: SparkSession, sf_dir: str, slices: int) -> DataFrame:
    """A point a vector: its place and its value are components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.col("embedding")[k].cast("double")
    return e.select((F.col("label") % slices).cast("long").alias("slice_id"), F.col("vec_id").cast("long").alias("point_id"), (at(0) * 20).alias("x"), (at(1) * 20).alias("y"), at(2).alias("re"), at(3).alias("im"))


def read_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nufft.to_points(volume(spark, sf_dir), points(spark, sf_dir, 7), 16, 15)
    return out.select("slice_id", "point_id", *((F.round(c, 2) + F.lit(0.0)).alias(c) for c in ("re", "im")))


def lipschitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solver's step for the projections of ``angles``."""
    spread = Z.Stored(Shared(spark, "step")(Z.spread_rows(angles(spark, sf_dir), N), "spread"))
    return spark.createDataFrame([(round(R.lipschitz_step(spark, N, R.normal_of(None, N, spread)), 9),)], "step double")


def contained(df: DataFrame, begin: int = 0, end: int = -1) -> DataFrame:
    """``df`` written to an array container and read again, slices [begin, end) alone."""
    at = Shared(df.sparkSession, "container").root
    container.write_array(df, at, "array", compressor="zstd", chunk_bytes=1024)
    return container.read_array(df.sparkSession, at, "array", begin, end)


def raw(df: DataFrame, begin: int) -> DataFrame:
    """``df`` written to raw files and read again from slice ``begin`` on."""
    at = Shared(df.sparkSession, "raw").root
    container.write_raw(df, at, 16, 15, "<f8")
    return container.read_raw(df.sparkSession, at, 16, 15, "<f8", begin, task_bytes=4096)


def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimizer on a problem that is no reconstruction: the least sum of w / 2 (x - v)^2 + x^2 / 2, w being 3 and 4 in turn."""
    save = Shared(spark, "ridge")
    v = save(volume(spark, sf_dir), "v")
    weight = lambda k: F.lit(3.0) + k % 2
    pull = lambda x: A.subtract(x, v)
    slope = lambda x: A.add(_set_values(pull(x), lambda d, k: d * weight(k)), x)
    near = lambda x: _set_values(pull(x), lambda d, k: d * d * weight(k) / 2)

    def error(x: DataFrame) -> float:
        far = near(x)
        return (far.agg(A.total(far)).first()[0] or 0.0) + (x.agg(A.squares(x)).first()[0] or 0.0) / 2

    # curvatures are 4 and 5, so a gradient of 2e-4 leaves every value within 5e-5, whatever its size
    return optimize.backtracking(optimize.Callables(slope, error, save), A.each(v, lambda a: a * 0.0), 9, 1 / 5, within=2e-4).images


def _set_values(df: DataFrame, of) -> DataFrame:
    return df.select("slice_id", "row_id", F.transform("values", of).alias("values"))


def streamed_fbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fbp``, its rows coming in files that hold rows of all slices."""
    save = Shared(spark, "stream")
    save(volume(spark, sf_dir).repartition(4, "row_id"), "rows")
    streaming.run(spark, save.path("rows"), save.path("images"), save.path("state"), T.even_angles(16), 7.0, 15, files=2)
    return spark.read.schema(T.ROWS).parquet(save.path("images"))


def gradient(spark: SparkSession, sf_dir: str, fast: bool) -> DataFrame:
    x, t = image(spark, sf_dir), T.even_angles(ANGLES)
    back = A.roll(x, 1)
    return Z.gradient(x, back, Z.transfer(t, N)) if fast else T.gradient(x, back, t)


def misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared misfit by projection, and by the normal operator with another right side, as one row."""
    x, t = image(spark, sf_dir), T.even_angles(ANGLES)
    sino = x.where(F.col("row_id") < ANGLES)
    both = (T.error(x, sino, t), Z.misfit(x, A.roll(x, 1), Z.transfer(t, N), 100.0))
    return spark.createDataFrame([tuple(round(v, 2) for v in both)], "direct double, toeplitz double")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    mean = A.mean_row(v)
    return A.flat_dark(v, mean.withColumn("values", F.transform("values", lambda x: x + 1.0)), mean.withColumn("values", F.transform("values", lambda x: F.lit(0.5))))


def weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior's weights, and at how many places of the volume such a neighbour is inside."""
    w = spark.createDataFrame(A.weights(), "d_slice long, d_row long, d_col long, weight double")
    inside = [F.col(n) - F.abs(F.col(d)) for n, d in (("slices", "d_slice"), ("rows", "d_row"), ("cols", "d_col"))]
    return w.crossJoin(F.broadcast(sizes(spark, sf_dir))).select(*w.columns, (inside[0] * inside[1] * inside[2]).alias("places"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dims(volume(spark, sf_dir)).select(*(F.col(c).cast("long").alias(c) for c in ("slices", "rows", "cols")))


def reconstruction(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return R.mbir(volume(spark, sf_dir), T.even_angles(16), 7.0, Shared(spark, "solve"), iterations=2, **how).images


def _far(x, sigma: float = 10.0):
    return A.zip_arrays(x, A.roll(x, 1), lambda a, b: A.prior_slope(a - b, sigma))


QUERIES = {
    "dims": sizes,
    "one_slice": _of(lambda d: A.slice_range(d, 3, 4)),
    "element": lambda spark, sf_dir: A.element(volume(spark, sf_dir), 2, 3, 4),
    "sinogram_range": _of(lambda d: A.transpose(A.slice_range(A.transpose(d), 4, 9)), volume),
    "pad_columns_right": _of(lambda d: A.pad_columns(d, 7, A.RIGHT)),
    "pad_columns_left": _of(lambda d: A.pad_columns(d, 7, A.LEFT)),
    "crop_columns_left": _of(lambda d: A.crop_columns(d, 7, A.LEFT)),
    "pad_image_right": _of(lambda d: A.pad_image(d, 5, 16, A.RIGHT), volume),
    "ifftshift": _of(lambda d: A.ifftshift(A.drop_column(d))),
    "roll_image": _of(lambda d: A.roll_image(d, 3, 4, 16), volume),
    "fftshift_image": _of(lambda d: A.fftshift_image(d, N), image),
    "ifftshift_image": _of(lambda d: A.ifftshift_image(d, N), image),
    "fill": _of(lambda d: A.fill(d, 2.5), volume),
    "subtract": _of(lambda d: A.subtract(d, A.roll(d, 1))),
    "scalar_minus": _of(lambda d: A.each(d, lambda v: 2.5 - v)),
    "scalar_over": _of(lambda d: A.each(d, lambda v: F.try_divide(F.lit(2.5), v)), volume),
    "max_normalize": _of(A.max_normalize, volume),
    "ramp_cutoff": _of(lambda d: A.ramp(d, 0.25)),
    "floor": _of(lambda d: A.floor_at(d, 0.1)),
    "minus_log": _of(A.minus_log),
    "flat_dark": _of(lambda d: d, frames),
    "circular_mask": _of(lambda d: R.circular_mask(d, 0.9), image),
    "crop_reconstruction": _of(lambda d: R.crop(d, 11), image),
    "multiply_plane": _of(lambda d: Z.multiply_all(d, [[float(r - k) for k in range(N)] for r in range(N)]), image),
    "prior_weights": weight_table,
    "prior_slope": _of(_far, volume),
    "prior_value": _of(lambda x: A.zip_arrays(x, A.roll(x, 1), lambda a, b: A.prior_value(a - b, 10.0)), volume),
    "prior_curvature": _of(lambda d: A.add_curvature(d, 100.0), volume),
    "angles": lambda spark, sf_dir: angles(spark, sf_dir).select("proj_id", F.round("theta", 9).alias("theta")),
    "polar_grid": lambda spark, sf_dir: T.grid(angles(spark, sf_dir), N).select("proj_id", F.col("col_id").cast("long").alias("col_id"), *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("x", "y"))),
    "points_to_modes": lambda spark, sf_dir: places(nufft.to_modes(points(spark, sf_dir, 10), 9, 7)),
    "modes_to_points": read_points,
    "lipschitz_step": lipschitz,
    "prior_chunks": _of(lambda d: chunked.prior_chunks(d, 10.0, parts=3), volume),
    "container_slices": _of(lambda d: contained(d, 2, 5), volume),
    "container_complex": lambda spark, sf_dir: places(contained(S.fft1d(S.to_complex(volume(spark, sf_dir))))),
    "raw_slices": _of(lambda d: raw(d, 3), volume),
    "least_squares": lambda spark, sf_dir: cells(ridge(spark, sf_dir)).withColumn("value", F.round("value", 3)),
    "fbp_stream": _of(lambda d: d, streamed_fbp),
    "complex_product": lambda spark, sf_dir: places(S.multiply(z := S.fft1d(S.to_complex(volume(spark, sf_dir))), z)),
    "fft1d": lambda spark, sf_dir: places(S.fft1d(S.to_complex(volume(spark, sf_dir)))),
    "ifft1d": lambda spark, sf_dir: places(S.ifft1d(S.to_complex(volume(spark, sf_dir)))),
    "fft2d": lambda spark, sf_dir: places(S.fft2d(S.to_complex(volume(spark, sf_dir)))),
    "ifft2d": lambda spark, sf_dir: places(S.ifft2d(S.to_complex(volume(spark, sf_dir)))),
    "rfft2d": lambda spark, sf_dir: places(S.rfft2d(S.to_complex(volume(spark, sf_dir)))),
    "irfft2d": _of(lambda d: S.real_part(S.irfft2d(S.rfft2d(S.to_complex(d)), 15)), volume),
    "point_spread": lambda spark, sf_dir: cells(Z.spread_rows(angles(spark, sf_dir), N)).select("row_id", "col_id", (F.round("value", 2) + F.lit(0.0)).alias("value")),
    "normal_direct": _of(lambda d: T.per_slice(d, lambda x: T.normal_slice(x, T.even_angles(ANGLES))), image),
    "normal_toeplitz": _of(lambda d: Z.normal(d, Z.transfer(T.even_angles(ANGLES), N)), image),
    "gradient_direct": _of(lambda d: d, lambda spark, sf_dir: gradient(spark, sf_dir, False)),
    "gradient_toeplitz": _of(lambda d: d, lambda spark, sf_dir: gradient(spark, sf_dir, True)),
    "misfit": misfits,
    "fbp": _of(lambda d: R.fbp(d, T.even_angles(16), 7.0), volume),
    "adjoint": _of(lambda d: R.adjoint(d, T.even_angles(16), 7.0), volume),
    "mbir_toeplitz": _of(lambda d: d, reconstruction),
    "mbir_direct": _of(lambda d: d, lambda spark, sf_dir: reconstruction(spark, sf_dir, method="direct", scale="minmax")),
}

IMAGE = VOLUME + """, k AS (SELECT unnest(generate_series(0, 16)) AS k),
    x AS (SELECT s.slice_id, r.k AS row_id, q.k AS col_id, coalesce(c.value, 0.0) AS value
          FROM (SELECT DISTINCT slice_id FROM c) s CROSS JOIN k r CROSS JOIN k q LEFT JOIN c ON c.slice_id = s.slice_id AND c.row_id = r.k AND c.col_id = q.k - 1) """


def _points(angles_: int, n: int, name: str = "pts") -> str:
    """Polar samples: angle p, radius i, waves x and y."""
    r = f"(i - {n // 2}) * 2 * pi() / {n - 1}"
    return f", {name} AS (SELECT p, i, cos(p * pi() / {angles_}) * {r} AS x, sin(p * pi() / {angles_}) * {r} AS y FROM (SELECT unnest(generate_series(0, {angles_ - 1})) AS p), (SELECT unnest(generate_series(0, {n - 1})) AS i)) "


POLAR = IMAGE + _points(ANGLES, N) + """, pol AS (SELECT slice_id, p, i, sum(value * cos(x * (col_id - 8) + y * (row_id - 8))) AS re, -sum(value * sin(x * (col_id - 8) + y * (row_id - 8))) AS im
          FROM x AS img, pts GROUP BY ALL) """
PROJECT = POLAR + """, proj AS (SELECT slice_id, p AS row_id, k AS col_id, sum(re * cos(2 * pi() * (i - 8) * (k - 8) / 17) - im * sin(2 * pi() * (i - 8) * (k - 8) / 17)) / 289 AS value FROM pol, k GROUP BY ALL) """
NORMAL = POLAR + """, nrm AS (SELECT slice_id, r.k AS row_id, q.k AS col_id, sum(re * cos(x * (q.k - 8) + y * (r.k - 8)) - im * sin(x * (q.k - 8) + y * (r.k - 8))) / 4913 AS value
          FROM pol JOIN pts USING (p, i) CROSS JOIN k r CROSS JOIN k q GROUP BY ALL) """
ROLLED = "FROM nrm JOIN x b ON b.slice_id = nrm.slice_id AND b.row_id = nrm.row_id AND b.col_id = (nrm.col_id + 1) % 17"
SLOPE = "CASE WHEN a.value = b.value THEN 0.0 ELSE (a.value - b.value) / ((power(abs(a.value - b.value) / 10, 0.8) + 0.001) * 100) * (2 - 0.8 * power(abs(a.value - b.value) / 10, 0.8) / (power(abs(a.value - b.value) / 10, 0.8) + 0.001)) END"
OFFSETS = "(SELECT ds, dr, dc, CASE abs(ds) + abs(dr) + abs(dc) WHEN 1 THEN 0.0523 WHEN 2 THEN 0.0370 ELSE 0.0302 END AS w FROM (SELECT unnest([-1, 0, 1]) AS ds), (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) WHERE abs(ds) + abs(dr) + abs(dc) > 0)"
RECENTRED = """, w AS (SELECT unnest(generate_series(0, 20)) AS k),
    pad AS (SELECT slice_id, row_id, (col_id + 2) % 21 AS col_id, value FROM c)"""


def _back(source: str, n: int, cells: str, rows: str, filtered: bool, grid: str) -> str:
    """Back-projection of ``cells`` by direct sums: their spectra, then waves. ``rows`` counts each slice's rows."""
    m, ramp = n // 2, f"* abs(i.k - {n // 2}) / {n}.0" if filtered else ""
    wave = f"f.r * (cos({rows} ) * (k.k - {m}) + sin({rows}) * (j.k - {m}))"
    return f"""{source}, {grid},
        f AS (SELECT slice_id, row_id, i.k AS i, (i.k - {m}) * 2 * pi() / {n - 1} AS r, sum(value * cos(2 * pi() * (i.k - {m}) * (col_id - {m}) / {n}) {ramp}) AS re,
              -sum(value * sin(2 * pi() * (i.k - {m}) * (col_id - {m}) / {n}) {ramp}) AS im FROM {cells} CROSS JOIN g i GROUP BY ALL),
        cnt AS (SELECT slice_id, count(DISTINCT row_id) AS n FROM {cells} GROUP BY ALL),
        bp AS (SELECT f.slice_id, j.k AS row_id, k.k AS col_id, sum(re * cos({wave}) - im * sin({wave})) / ({n} * {n}) AS value FROM f JOIN cnt USING (slice_id) CROSS JOIN g j CROSS JOIN g k GROUP BY ALL) """


TABLE_POINTS = f"WITH pts AS (SELECT p, i, cos(t) * (i - {N // 2}) * (2 * pi() / {N - 1}) AS x, sin(t) * (i - {N // 2}) * (2 * pi() / {N - 1}) AS y FROM (SELECT vec_id AS p, vec_id % 180 * pi() / 180 AS t FROM embeddings), (SELECT unnest(generate_series(0, {N - 1})) AS i)) "
PLACES = "WITH e AS (SELECT label, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) AS re, CAST(embedding[4] AS DOUBLE) AS im FROM embeddings) "
THETA = "f.row_id * pi() / cnt.n"
WHOLE = "g AS (SELECT unnest(generate_series(0, {})) AS k)"


def _spectrum(re: str, im: str, cols: int, rows: int | None, tail: str = "") -> str:
    """Direct sums over columns, or over rows and columns; ``re`` and ``im`` are functions of the angle a."""
    angle = f"2 * pi() * o.k * col_id / {15}" + (f" + 2 * pi() * q.k * row_id / {rows}" if rows else "")
    each = f"(SELECT unnest(generate_series(0, {cols - 1})) AS k) o" + (f" CROSS JOIN (SELECT unnest(generate_series(0, {rows - 1})) AS k) q" if rows else "")
    return f"{VOLUME}, z AS (SELECT slice_id, {'q.k' if rows else 'row_id'} AS row_id, o.k AS col_id, sum(value * cos({angle})) AS re, {im}sum(value * sin({angle})) AS im FROM c CROSS JOIN {each} GROUP BY ALL) SELECT slice_id, row_id, col_id, round({re}, 5) + 0.0 AS re, round({tail or 'im'}, 5) + 0.0 AS im FROM z"


SQL_PAIR = lambda value, n, source=VOLUME: _cell(source, value, "a.row_id", "a.col_id", PAIR.format(n=n), "a.slice_id")
LINES = "(SELECT DISTINCT slice_id, row_id, row_id AS of FROM c)"
ORACLE_SQL = {
    "recentre": f"{SINO_CELLS}, d AS (SELECT * FROM c WHERE col_id < 63), l AS (SELECT DISTINCT slice_id, row_id FROM d), k AS (SELECT unnest(generate_series(0, 88)) AS k) "
    "SELECT l.slice_id, l.row_id, (k.k + 87) % 89 AS col_id, round(coalesce(d.value, 0.0), 5) AS value FROM l CROSS JOIN k LEFT JOIN d ON d.slice_id = l.slice_id AND d.row_id = l.row_id AND d.col_id = k.k - 13",
    "chunks": f"{VOLUME} SELECT CAST(t.k AS BIGINT) AS chunk_id, slice_id, slice_id < t.lo OR slice_id > t.hi AS ghost, count(DISTINCT row_id) AS n_rows FROM c JOIN (VALUES (0, 0, 2), (1, 3, 4), (2, 5, 6)) AS t(k, lo, hi) ON slice_id BETWEEN t.lo - 1 AND t.hi + 1 GROUP BY ALL",
    "prior_gradient": f"{VOLUME} SELECT a.slice_id, a.row_id, a.col_id, round(sum(o.w * {SLOPE}), 5) + 0.0 AS value FROM c a CROSS JOIN {OFFSETS} o "
    "JOIN c b ON b.slice_id = least(greatest(a.slice_id + o.ds, 0), 6) AND b.row_id = least(greatest(a.row_id + o.dr, 0), 15) AND b.col_id = least(greatest(a.col_id + o.dc, 0), 14) GROUP BY ALL",
    "backproject": _back(SINO_CELLS, 63, "(SELECT * FROM c WHERE col_id < 63)", THETA, False, WHOLE.format(62)) + "SELECT slice_id, row_id, col_id, round(value, 5) + 0.0 AS value FROM bp",
    "filtered_backproject": _back(SINO_CELLS, 63, "(SELECT * FROM c WHERE col_id < 63)", THETA, True, WHOLE.format(62)) + "SELECT slice_id, row_id, col_id, round(value, 5) + 0.0 AS value FROM bp",
    "project": PROJECT + "SELECT slice_id, row_id, col_id, round(value, 5) + 0.0 AS value FROM proj",
    "dims": f"{VOLUME} SELECT CAST(max(slice_id) + 1 AS BIGINT) AS slices, CAST(max(row_id) + 1 AS BIGINT) AS rows, CAST(max(col_id) + 1 AS BIGINT) AS cols FROM c",
    "one_slice": _cell(SINO_CELLS, tail="FROM c WHERE slice_id = 3"),
    "element": f"{VOLUME} SELECT value FROM c WHERE slice_id = 2 AND row_id = 3 AND col_id = 4",
    "sinogram_range": _cell(VOLUME, tail="FROM c WHERE row_id BETWEEN 4 AND 8"),
    "pad_columns_right": _pad(SINO_CELLS, LINES, 64, 0, 7),
    "pad_columns_left": _pad(SINO_CELLS, LINES, 64, 7, 7),
    "crop_columns_left": _cell(SINO_CELLS, col="col_id - 7", tail="FROM c WHERE col_id >= 7"),
    "pad_image_right": _pad(VOLUME, "(SELECT DISTINCT slice_id, r AS row_id, r AS of FROM c, (SELECT unnest(generate_series(0, 20)) AS r))", 15, 0, 5),
    "ifftshift": _cell(SINO_CELLS, col="(col_id + 32) % 63", tail="FROM c WHERE col_id < 63"),
    "roll_image": _cell(VOLUME, row="(row_id + 13) % 16", col="(col_id + 11) % 15"),
    "fftshift_image": _cell(IMAGE, row="(row_id + 8) % 17", col="(col_id + 8) % 17", tail="FROM x"),
    "ifftshift_image": _cell(IMAGE, row="(row_id + 9) % 17", col="(col_id + 9) % 17", tail="FROM x"),
    "fill": _cell(VOLUME, "CAST(2.5 AS DOUBLE)"),
    "subtract": SQL_PAIR("a.value - b.value", 64, SINO_CELLS),
    "scalar_minus": _cell(SINO_CELLS, "2.5 - value"),
    "scalar_over": _cell(VOLUME, "2.5 / nullif(value, 0)"),
    "max_normalize": _cell(VOLUME, "value / (SELECT max(value) FROM c)"),
    "ramp_cutoff": _cell(SINO_CELLS, "CASE WHEN abs(col_id - 32) / 64.0 < 0.25 THEN value * abs(col_id - 32) / 64.0 ELSE 0.0 END"),
    "floor": _cell(SINO_CELLS, "greatest(value, 0.1)"),
    "minus_log": _cell(SINO_CELLS, "-ln(greatest(value, 0.01))"),
    "flat_dark": _cell(VOLUME, "(value - 0.5) / (avg(value) OVER (PARTITION BY slice_id, col_id) + 0.5)"),
    "circular_mask": _cell(IMAGE, "CASE WHEN power(col_id - 8, 2) + power(row_id - 8, 2) <= power(17 * 0.9 / 2, 2) THEN value ELSE 0.0 END", tail="FROM x"),
    "crop_reconstruction": _cell(IMAGE, row="row_id - 3", col="col_id - 3", tail="FROM x WHERE row_id BETWEEN 3 AND 13 AND col_id BETWEEN 3 AND 13"),
    "multiply_plane": _cell(IMAGE, "value * (row_id - col_id) + 0.0", tail="FROM x"),
    "prior_weights": f"{VOLUME} SELECT CAST(ds AS BIGINT) AS d_slice, CAST(dr AS BIGINT) AS d_row, CAST(dc AS BIGINT) AS d_col, CAST(w AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS places FROM {OFFSETS} o JOIN c ON slice_id + ds BETWEEN 0 AND (SELECT max(slice_id) FROM c) AND row_id + dr BETWEEN 0 AND (SELECT max(row_id) FROM c) AND col_id + dc BETWEEN 0 AND (SELECT max(col_id) FROM c) GROUP BY ALL",
    "prior_slope": SQL_PAIR(f"({SLOPE}) + 0.0", 15),
    "prior_value": SQL_PAIR("power((a.value - b.value) / 10, 2) / (power(abs(a.value - b.value) / 10, 0.8) + 0.001)", 15),
    "prior_curvature": _cell(VOLUME, "value + (6 * 0.0523 + 12 * 0.0370 + 8 * 0.0302) * 2 / (100 * 100 * 0.001)"),
    "angles": "SELECT vec_id AS proj_id, round(vec_id % 180 * pi() / 180, 9) AS theta FROM embeddings",
    "polar_grid": TABLE_POINTS + "SELECT p AS proj_id, i AS col_id, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y FROM pts",
    "points_to_modes": PLACES + """SELECT slice_id, j AS row_id, k AS col_id, round(sum(re * cos(k3 * x + j4 * y) - im * sin(k3 * x + j4 * y)), 5) + 0.0 AS re, round(sum(re * sin(k3 * x + j4 * y) + im * cos(k3 * x + j4 * y)), 5) + 0.0 AS im
        FROM (SELECT label % 10 AS slice_id, * FROM e) CROSS JOIN (SELECT j, j - 4 AS j4 FROM (SELECT unnest(generate_series(0, 8)) AS j)) CROSS JOIN (SELECT k, k - 3 AS k3 FROM (SELECT unnest(generate_series(0, 6)) AS k)) GROUP BY ALL""",
    "modes_to_points": VOLUME + ", " + PLACES.removeprefix("WITH ") + """SELECT c.slice_id, point_id, round(sum(value * cos((col_id - 7) * x + (row_id - 8) * y)), 2) + 0.0 AS re, round(-sum(value * sin((col_id - 7) * x + (row_id - 8) * y)), 2) + 0.0 AS im
        FROM e JOIN c ON c.slice_id = e.label % 7 GROUP BY ALL""",
    "lipschitz_step": TABLE_POINTS + """, k AS (SELECT unnest(generate_series(0, 16)) AS k),
        pol AS (SELECT p, i, sum(cos(x * (q.k - 8) + y * (r.k - 8))) AS re, -sum(sin(x * (q.k - 8) + y * (r.k - 8))) AS im FROM pts CROSS JOIN k q CROSS JOIN k r GROUP BY ALL),
        nrm AS (SELECT r.k AS r, q.k AS q, sum(re * cos(x * (q.k - 8) + y * (r.k - 8)) - im * sin(x * (q.k - 8) + y * (r.k - 8))) / 4913 AS value FROM pol JOIN pts USING (p, i) CROSS JOIN k q CROSS JOIN k r GROUP BY ALL)
        SELECT round(least(1.0, 1 / max(value)), 9) AS step FROM nrm""",
    "container_slices": _cell(VOLUME, tail="FROM c WHERE slice_id >= 2 AND slice_id < 5"),
    "raw_slices": _cell(VOLUME, tail="FROM c WHERE slice_id >= 3"),
    "least_squares": f"{VOLUME} SELECT slice_id, row_id, col_id, round(value * (3 + col_id % 2) / (4 + col_id % 2), 3) AS value FROM c",
    "complex_product": _spectrum("re * re - im * im", "-", 15, None, "2 * re * im"),
    "fft1d": _spectrum("re", "-", 15, None),
    "ifft1d": _spectrum("re", "", 15, None),
    "fft2d": _spectrum("re", "-", 15, 16),
    "ifft2d": _spectrum("re", "", 15, 16),
    "rfft2d": _spectrum("re", "-", 8, 16),
    "irfft2d": _cell(VOLUME, "value * 240"),
    "point_spread": TABLE_POINTS + ", k AS (SELECT unnest(generate_series(0, 32)) AS k) SELECT r.k AS row_id, q.k AS col_id, round(sum(cos(x * (q.k - 16) + y * (r.k - 16))), 2) + 0.0 AS value FROM pts CROSS JOIN k r CROSS JOIN k q GROUP BY ALL",
    "normal_direct": NORMAL + "SELECT slice_id, row_id, col_id, round(value, 5) + 0.0 AS value FROM nrm",
    "normal_toeplitz": NORMAL + "SELECT slice_id, row_id, col_id, round(value, 5) + 0.0 AS value FROM nrm",
    "gradient_direct": NORMAL + f"SELECT nrm.slice_id, nrm.row_id, nrm.col_id, round(nrm.value - b.value, 5) + 0.0 AS value {ROLLED}",
    "gradient_toeplitz": NORMAL + f"SELECT nrm.slice_id, nrm.row_id, nrm.col_id, round(nrm.value - b.value, 5) + 0.0 AS value {ROLLED}",
    "misfit": PROJECT + NORMAL.removeprefix(POLAR) + f"SELECT (SELECT round(sum(power(proj.value - x.value, 2)), 2) FROM proj JOIN x USING (slice_id, row_id, col_id)) AS direct, (SELECT round(100 + sum(a.value * (nrm.value - 2 * b.value)), 2) {ROLLED} JOIN x a ON a.slice_id = nrm.slice_id AND a.row_id = nrm.row_id AND a.col_id = nrm.col_id) AS toeplitz",
    "fbp": _back(VOLUME + RECENTRED, 21, "pad", "f.row_id * pi() / 16", True, WHOLE.format(20)) + "SELECT slice_id, row_id - 3 AS row_id, col_id - 3 AS col_id, round(value, 5) + 0.0 AS value FROM bp WHERE row_id BETWEEN 3 AND 17 AND col_id BETWEEN 3 AND 17",
    "adjoint": _back(VOLUME + RECENTRED, 21, "pad", "f.row_id * pi() / 16", False, WHOLE.format(20)) + "SELECT slice_id, row_id - 3 AS row_id, col_id - 3 AS col_id, round(value, 5) + 0.0 AS value FROM bp WHERE row_id BETWEEN 3 AND 17 AND col_id BETWEEN 3 AND 17",
}
ORACLE_SQL |= {"prior_chunks": ORACLE_SQL["prior_gradient"], "container_complex": ORACLE_SQL["fft1d"], "fbp_stream": ORACLE_SQL["fbp"]}
