"""Non-uniform Fourier transforms of points given as rows of a table, to a tolerance, with rectangular outputs.

``points`` has slice_id, point_id, x, y (radians; x along columns) and, for ``to_modes``, re and im. Both transforms go by
a grid about twice as fine as the modes, cut into tiles, and no task holds more than one tile's points, one band of tiles
or one panel of columns:

- points go to the tiles that their kernel touches (four at most) and each tile is summed where it lies. A tile of more
  than ``MOST`` points is cut by point_id into parts, whose partial grids are added place by place. Points learn of it where
  they are read: the list of such tiles, a row for ``MOST`` points at most, is broadcast;
- the two-dimensional FFT is one over a band of rows, then one over a panel of columns;
- the other way round each tile goes, with the border that kernels reach over, to its points.

A slice without points has no modes, and a point of a slice without an image has value 0. Points with a null or an infinite
place are dropped where they are read. Ids of points should differ: equal ones are points of their own, but share a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gridding import Axis

#: Grid places along a tile's side (the last one of an axis has up to twice as many), and points that one task takes.
TILE, MOST = 64, 1 << 19
#: Points that are spread or read at a time within a task.
STEP = 4096
TILES = "slice_id long, tr int, tc int, re array<double>, im array<double>"
PANELS = "slice_id long, panel int, tr int, re array<double>, im array<double>"
PIECES = "slice_id long, row_id long, panel int, re array<double>, im array<double>"


def tiles_of(fine: int) -> int:
    return max(1, fine // TILE)


def side(fine: int, tile: int) -> tuple[int, int]:
    """[begin, end) of a tile along an axis."""
    return tile * TILE, fine if tile == tiles_of(fine) - 1 else (tile + 1) * TILE


def _first(at: Column, axis: Axis) -> Column:
    """The first grid place that a point's kernel touches, not yet wrapped."""
    u = F.pmod(at / F.lit(2 * np.pi) * F.lit(float(axis.fine)), F.lit(float(axis.fine)))
    return F.ceil(u - axis.wide / 2).cast("int")


def _tile(place: Column, axis: Axis) -> Column:
    return F.least(F.floor(F.pmod(place, F.lit(axis.fine)) / TILE), F.lit(tiles_of(axis.fine) - 1)).cast("int")


def _touched(at: Column, axis: Axis) -> Column:
    first = _first(at, axis)
    return F.array_distinct(F.transform(F.array(F.lit(0), F.lit(axis.wide - 1)), lambda k: _tile(first + k, axis)))


def _placed(points: DataFrame) -> DataFrame:
    there = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in ("x", "y")]
    return points.where(there[0] & there[1]).withColumn("slice_id", F.col("slice_id").cast("long"))


def _parts(points: DataFrame, most: int) -> DataFrame | None:
    """(slice_id, tr, tc, parts) of tiles that hold more than ``most`` points; None where there are none."""
    over = points.groupBy("slice_id", "tr", "tc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return None if over.isEmpty() else over.select("slice_id", "tr", "tc", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _cut(points: DataFrame, over: DataFrame) -> DataFrame:
    """``points`` with the part of their tile, null where it is not cut."""
    met = points.join(F.broadcast(over), ["slice_id", "tr", "tc"], "left")
    return met.withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int")).drop("parts")


def _spread(pdf: pd.DataFrame, rows: Axis, cols: Axis) -> pd.DataFrame:
    """One tile's part of the grid."""
    tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
    (r0, r1), (c0, c1) = side(rows.fine, tr), side(cols.fine, tc)
    high, wide = r1 - r0, c1 - c0
    out = np.zeros((2, high * wide))
    x, y, values = pdf["x"].to_numpy(), pdf["y"].to_numpy(), (pdf["re"].to_numpy(), pdf["im"].to_numpy())
    for k in range(0, len(x), STEP):
        (iy, wy), (ix, wx) = rows.near(y[k : k + STEP]), cols.near(x[k : k + STEP])
        iy, ix = iy - r0, ix - c0
        wy, wx = np.where((iy >= 0) & (iy < high), wy, 0), np.where((ix >= 0) & (ix < wide), wx, 0)
        at = (np.clip(iy, 0, high - 1)[:, :, None] * wide + np.clip(ix, 0, wide - 1)[:, None, :]).ravel()
        weight = wy[:, :, None] * wx[:, None, :]
        for part, v in zip(out, values, strict=True):
            part += np.bincount(at, (weight * v[k : k + STEP, None, None]).ravel(), high * wide)
    return pd.DataFrame({"slice_id": [int(pdf["slice_id"].iloc[0])], "tr": [tr], "tc": [tc], "re": [out[0]], "im": [out[1]]})


def _band(pdf: pd.DataFrame, rows: Axis, cols: Axis) -> pd.DataFrame:
    """A band of tiles, transformed along its rows, cropped to the columns' modes and cut into panels."""
    tr = int(pdf["tr"].iloc[0])
    r0, r1 = side(rows.fine, tr)
    grid = np.zeros((r1 - r0, cols.fine), complex)
    for tc, re, im in zip(pdf["tc"], pdf["re"], pdf["im"], strict=True):
        c0, c1 = side(cols.fine, tc)
        grid[:, c0:c1] = (np.asarray(re) + 1j * np.asarray(im)).reshape(r1 - r0, -1)
    modes = (np.fft.ifft(grid, axis=1) * cols.fine)[:, cols.place] / cols.kernel
    cut = [modes[:, k : k + TILE].ravel() for k in range(0, cols.n, TILE)]
    return pd.DataFrame({"slice_id": int(pdf["slice_id"].iloc[0]), "panel": np.arange(len(cut), dtype=np.int32), "tr": np.int32(tr), "re": [c.real for c in cut], "im": [c.imag for c in cut]})


def _panel(pdf: pd.DataFrame, rows: Axis, cols: Axis) -> pd.DataFrame:
    """A panel of columns, transformed along them and cropped to the rows' modes."""
    panel = int(pdf["panel"].iloc[0])
    grid = np.zeros((rows.fine, min(TILE, cols.n - panel * TILE)), complex)
    for tr, re, im in zip(pdf["tr"], pdf["re"], pdf["im"], strict=True):
        r0, r1 = side(rows.fine, tr)
        grid[r0:r1] = (np.asarray(re) + 1j * np.asarray(im)).reshape(r1 - r0, -1)
    out = (np.fft.ifft(grid, axis=0) * rows.fine)[rows.place] / rows.kernel[:, None]
    return pd.DataFrame({"slice_id": int(pdf["slice_id"].iloc[0]), "row_id": np.arange(rows.n), "panel": np.int32(panel), "re": list(out.real), "im": list(out.imag)})


def _joined(pieces: DataFrame) -> DataFrame:
    """Rows from their pieces."""
    rows = pieces.groupBy("slice_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("panel", "re", "im"))).alias("p"))
    return rows.select("slice_id", "row_id", *(F.flatten(F.col("p")[c]).alias(c) for c in ("re", "im")))


def to_modes(points: DataFrame, rows: int, cols: int, eps: float = 1e-12, most: int = MOST) -> DataFrame:
    """Type 1: (slice_id, row_id, re, im), out[j, k] = sum of value * exp(i ((k - cols//2) x + (j - rows//2) y)) over a slice's points."""
    down, across = Axis(rows, eps), Axis(cols, eps)
    near = _placed(points).select("slice_id", "point_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "re", "im")))
    near = near.withColumn("tr", F.explode(_touched(F.col("y"), down))).withColumn("tc", F.explode(_touched(F.col("x"), across)))
    over = _parts(near, most)
    summed = lambda df, *keys: df.groupBy("slice_id", "tr", "tc", *keys).applyInPandas(lambda x: _spread(x, down, across), TILES)
    if over is None:
        tiles = summed(near)
    else:  # partial grids are added on both sides of a shuffle, a place a row
        cut = _cut(near, over)
        cells = summed(cut.where(F.col("part").isNotNull()), "part").select("slice_id", "tr", "tc", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
        cells = cells.groupBy("slice_id", "tr", "tc", "k").agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))
        whole = cells.groupBy("slice_id", "tr", "tc").agg(F.array_sort(F.collect_list(F.struct("k", "re", "im"))).alias("c"))
        whole = whole.select("slice_id", "tr", "tc", *(F.col("c")[n].alias(n) for n in ("re", "im")))
        tiles = summed(cut.where(F.col("part").isNull()).drop("part")).unionByName(whole)
    panels = tiles.groupBy("slice_id", "tr").applyInPandas(lambda x: _band(x, down, across), PANELS)
    return _joined(panels.groupBy("slice_id", "panel").applyInPandas(lambda x: _panel(x, down, across), PIECES))


def _widen(batches: Iterator[pa.RecordBatch], rows: Axis, cols: Axis) -> Iterator[pa.RecordBatch]:
    """Rows of modes to rows of the finer grid, cut into panels."""
    many = tiles_of(cols.fine)
    cuts = [side(cols.fine, k) for k in range(many)]
    for b in batches:
        for s, r, re, im in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            line = np.zeros(cols.fine, complex)
            line[cols.place] = (np.asarray(re) + 1j * np.asarray(im)) / cols.kernel / rows.kernel[r]
            line = np.fft.fft(line)
            out = [line[lo:hi] for lo, hi in cuts]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            columns = ([s] * many, [r] * many, range(many), [v.real for v in out], [v.imag for v in out])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["slice_id", "row_id", "panel", "re", "im"])


def _tall(pdf: pd.DataFrame, rows: Axis, cols: Axis) -> pd.DataFrame:
    """A panel transformed along its columns; its tiles, and the border of the tiles before, both with the rows that kernels reach over."""
    panel, many = int(pdf["panel"].iloc[0]), tiles_of(cols.fine)
    lo, hi = side(cols.fine, panel)
    grid = np.zeros((rows.fine, hi - lo), complex)
    for r, re, im in zip(pdf["row_id"], pdf["re"], pdf["im"], strict=True):
        grid[rows.place[r]] = np.asarray(re) + 1j * np.asarray(im)
    grid = np.fft.fft(grid, axis=0)
    out = []
    for tr in range(tiles_of(rows.fine)):
        r0, r1 = side(rows.fine, tr)
        block = grid[np.arange(r0, r1 + cols.wide - 1) % rows.fine]
        out.append((tr, panel, 0, block.ravel()))
        if many > 1:
            out.append((tr, (panel - 1) % many, 1, block[:, : cols.wide - 1].ravel()))
    tr, tc, border, blocks = zip(*out, strict=True)
    return pd.DataFrame({"slice_id": int(pdf["slice_id"].iloc[0]), "tr": np.array(tr, np.int32), "tc": np.array(tc, np.int32), "border": np.array(border, np.int32), "re": [b.real for b in blocks], "im": [b.imag for b in blocks]})


def _read(points: pd.DataFrame, blocks: pd.DataFrame, rows: Axis, cols: Axis) -> pd.DataFrame:
    """Values at one tile's points."""
    if not len(points):
        return pd.DataFrame({"slice_id": [], "point_id": [], "re": [], "im": []})
    value = np.zeros(len(points), complex)
    if len(blocks):
        tr, tc = int(points["tr"].iloc[0]), int(points["tc"].iloc[0])
        (r0, r1), (c0, c1) = side(rows.fine, tr), side(cols.fine, tc)
        high = r1 - r0 + cols.wide - 1
        part = {int(b): (np.asarray(re) + 1j * np.asarray(im)).reshape(high, -1) for b, re, im in zip(blocks["border"], blocks["re"], blocks["im"], strict=True)}
        grid = np.concatenate([part[0], part[1] if 1 in part else part[0][:, np.arange(cols.wide - 1) % part[0].shape[1]]], axis=1)
        for k in range(0, len(points), STEP):
            (iy, wy), (ix, wx) = rows.near(points["y"].to_numpy()[k : k + STEP]), cols.near(points["x"].to_numpy()[k : k + STEP])
            iy, ix = (iy[:, :1] - r0) + np.arange(rows.wide), (ix[:, :1] - c0) + np.arange(cols.wide)
            value[k : k + STEP] = np.einsum("ijk,ij,ik->i", grid[iy[:, :, None], ix[:, None, :]], wy, wx)
    return pd.DataFrame({"slice_id": points["slice_id"], "point_id": points["point_id"], "re": value.real, "im": value.imag})


def to_points(images: DataFrame, points: DataFrame, rows: int, cols: int, eps: float = 1e-12, most: int = MOST) -> DataFrame:
    """Type 2: (slice_id, point_id, re, im), sum of image[j, k] * exp(-i ((k - cols//2) x + (j - rows//2) y)) at each point of its slice.

    ``images`` has slice_id, row_id and either values or re and im; rows that a slice lacks are 0.
    """
    down, across = Axis(rows, eps), Axis(cols, eps)
    real = "values" in images.columns
    lines = images.select(F.col("slice_id").cast("long").alias("slice_id"), F.col("row_id").cast("long").alias("row_id"), (F.col("values") if real else F.col("re")).alias("re"), (F.transform("values", lambda v: F.lit(0.0)) if real else F.col("im")).alias("im"))
    panels = lines.mapInArrow(lambda x: _widen(x, down, across), PIECES)
    blocks = panels.groupBy("slice_id", "panel").applyInPandas(lambda x: _tall(x, down, across), "slice_id long, tr int, tc int, border int, re array<double>, im array<double>")
    near = _placed(points).select("slice_id", F.col("point_id").cast("long").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = near.withColumn("tr", _tile(_first(F.col("y"), down), down)).withColumn("tc", _tile(_first(F.col("x"), across), across))
    over = _parts(near, most)
    if over is None:
        near, blocks = (df.withColumn("part", F.lit(0)) for df in (near, blocks))
    else:
        near = _cut(near, over).withColumn("part", F.coalesce("part", F.lit(0)))
        told = blocks.join(F.broadcast(over), ["slice_id", "tr", "tc"], "left")
        blocks = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    keys = ["slice_id", "tr", "tc", "part"]
    return near.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(lambda p, b: _read(p, b, down, across), "slice_id long, point_id long, re double, im double")
