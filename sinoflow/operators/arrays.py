"""Dense-array operators on row-blocks (slice_id, row_id, values array<double>), as native column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("slice_id", "row_id")
SYMMETRIC, RIGHT, LEFT = "symmetric", "right", "left"


def _set(df: DataFrame, values: Column) -> DataFrame:
    return df.select(*KEYS, values.alias("values"))


def zeros(n: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(n))


def dims(df: DataFrame) -> DataFrame:
    return df.agg((F.max("slice_id") + 1).alias("slices"), (F.max("row_id") + 1).alias("rows"), F.max(F.size("values")).alias("cols"))


def slice_range(df: DataFrame, begin: int, end: int) -> DataFrame:
    """Slices [begin, end); the filter reaches the scan."""
    return df.where((F.col("slice_id") >= begin) & (F.col("slice_id") < end))


def transpose(df: DataFrame) -> DataFrame:
    """Axes (1, 0, 2)."""
    return df.select(F.col("row_id").alias("slice_id"), F.col("slice_id").alias("row_id"), "values")


def drop_column(df: DataFrame) -> DataFrame:
    """Without the last column."""
    return _set(df, F.slice("values", 1, F.greatest(F.lit(0), F.size("values") - 1)))


def odd_columns(df: DataFrame) -> DataFrame:
    """The transforms need an odd number of columns."""
    return _set(df, F.slice("values", 1, F.size("values") - (1 - F.size("values") % 2)))


def roll(df: DataFrame, by: int) -> DataFrame:
    """out[k] = in[(k + by) mod n]."""
    n = F.size("values")
    s = F.pmod(F.lit(by), n)
    return _set(df, F.when(n == 0, F.col("values")).otherwise(F.concat(F.slice(F.col("values"), s + 1, n), F.slice(F.col("values"), F.lit(1), s))))


def fftshift(df: DataFrame) -> DataFrame:
    n = F.size("values")
    half = F.ceil(n / 2).cast("int")
    return _set(df, F.concat(F.slice(F.col("values"), half + 1, n), F.slice(F.col("values"), F.lit(1), half)))


def ifftshift(df: DataFrame) -> DataFrame:
    n = F.size("values")
    half = F.floor(n / 2).cast("int")
    return _set(df, F.concat(F.slice(F.col("values"), half + 1, n), F.slice(F.col("values"), F.lit(1), half)))


def roll_image(df: DataFrame, by_rows: int, by_columns: int, rows: int) -> DataFrame:
    """out[r, k] = in[(r + by_rows) mod rows, (k + by_columns) mod n]; ``rows`` is the number of rows of a slice."""
    return roll(df, by_columns).withColumn("row_id", F.pmod(F.col("row_id") - by_rows, F.lit(rows)))


def fftshift_image(df: DataFrame, rows: int) -> DataFrame:
    """Both axes: place 0 goes to the middle."""
    return roll_image(fftshift(df), -(-rows // 2), 0, rows)


def ifftshift_image(df: DataFrame, rows: int) -> DataFrame:
    """Both axes: the middle goes to place 0."""
    return roll_image(ifftshift(df), rows // 2, 0, rows)


def fill(df: DataFrame, value: float) -> DataFrame:
    """``value`` at every place."""
    return _set(df, F.array_repeat(F.lit(float(value)), F.size("values")))


def element(df: DataFrame, slice_id: int, row_id: int, col_id: int) -> DataFrame:
    """One row with one value (null beyond the columns); the filter reaches the scan."""
    return df.where((F.col("slice_id") == slice_id) & (F.col("row_id") == row_id)).select(F.get("values", F.lit(col_id)).alias("value"))


def pad_columns(df: DataFrame, padding: int, kind: str = SYMMETRIC) -> DataFrame:
    before = {SYMMETRIC: padding // 2, RIGHT: 0, LEFT: padding}[kind]
    return _set(df, F.concat(zeros(before), F.col("values"), zeros(padding - before)))


def crop_columns(df: DataFrame, padding: int, kind: str = SYMMETRIC) -> DataFrame:
    before = {SYMMETRIC: padding // 2, RIGHT: 0, LEFT: padding}[kind]
    return _set(df, F.slice("values", before + 1, F.size("values") - padding))


def pad_image(df: DataFrame, padding: int, rows: int, kind: str = SYMMETRIC) -> DataFrame:
    """Zero-pads rows and columns; ``rows`` is the number of rows of a slice."""
    before = {SYMMETRIC: padding // 2, RIGHT: 0, LEFT: padding}[kind]
    wide = pad_columns(df, padding, kind).withColumn("row_id", F.col("row_id") + before)
    new = [*range(before), *range(before + rows, rows + padding)]
    first = df.where("row_id = 0").select("slice_id", F.explode(F.array(*map(F.lit, new)) if new else F.array().cast("array<int>")).alias("row_id"), zeros(F.size("values") + padding).alias("values"))
    return wide.unionByName(first)


def crop_image(df: DataFrame, padding: int, rows: int, kind: str = SYMMETRIC) -> DataFrame:
    before = {SYMMETRIC: padding // 2, RIGHT: 0, LEFT: padding}[kind]
    kept = df.where((F.col("row_id") >= before) & (F.col("row_id") < rows - padding + before))
    return crop_columns(kept.withColumn("row_id", F.col("row_id") - before), padding, kind)


def centre(columns: int, center: float) -> tuple[int, int]:
    """(columns to roll by, columns to pad with on each side) that bring a rotation axis to the middle; halves go up."""
    off = (columns + 1) // 2 - math.floor(center + 0.5)
    return off, max(int(0.42 * columns) // 2, abs(off))


def recentre(df: DataFrame, columns: int, center: float) -> DataFrame:
    """Pads a sinogram and rolls its rotation axis to the middle column."""
    off, pad = centre(columns, center)
    return roll(pad_columns(df, 2 * pad), off)


def zip_arrays(a: DataFrame, b: DataFrame, of: Callable[[Column, Column], Column]) -> DataFrame:
    """Element by element, joined by place. A row without a partner, or of another length, is an error, as unequal dimensions are."""
    other = b.select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("values").alias("_values"))
    met = a.select(*KEYS, "values").join(other, [F.col(k) == F.col(f"_{k}") for k in KEYS], "full_outer")
    alone = [F.col(k).isNull() for k in ("slice_id", "_slice_id")]
    unequal = alone[0] | alone[1] | (F.size("values") != F.size("_values"))
    place = F.concat_ws(", ", F.coalesce("slice_id", "_slice_id"), F.coalesce("row_id", "_row_id"))
    values = F.when(unequal, F.raise_error(F.concat(F.lit("the arrays differ in their dimensions at slice, row "), place))).otherwise(F.zip_with("values", "_values", of))
    return met.select(*KEYS, values.alias("values"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return zip_arrays(a, b, lambda x, y: x + y)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return zip_arrays(a, b, lambda x, y: x - y)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return zip_arrays(a, b, lambda x, y: x * y)


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Null where the divisor is 0."""
    return zip_arrays(a, b, lambda x, y: F.try_divide(x, y))


def each(df: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """Any element-wise expression: scaling, shifting and so on."""
    return _set(df, F.transform("values", of))


def floor_at(df: DataFrame, least: float = 0.01) -> DataFrame:
    return each(df, lambda v: F.greatest(v, F.lit(float(least))))


def minus_log(df: DataFrame, least: float = 0.01) -> DataFrame:
    """Line integrals from transmission, floored at ``least`` first."""
    return each(df, lambda v: -F.ln(F.greatest(v, F.lit(float(least)))))


def mean_row(df: DataFrame) -> DataFrame:
    """(slice_id, values): each slice's rows averaged, as flat and dark frames are."""
    means = to_cells(df).groupBy("slice_id", "col_id").agg(F.avg("value").alias("value"))
    rows = means.groupBy("slice_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("c"))
    return rows.select("slice_id", F.transform("c", lambda c: c["value"]).alias("values"))


def flat_dark(df: DataFrame, flat: DataFrame, dark: DataFrame) -> DataFrame:
    """(v - dark) / (flat - dark); null where they are equal. ``flat`` and ``dark`` have a row a slice, as ``mean_row`` gives."""
    frames = flat.select("slice_id", F.col("values").alias("_flat")).join(dark.select("slice_id", F.col("values").alias("_dark")), "slice_id")
    above = lambda x, d: F.zip_with(x, d, lambda a, b: a - b)
    met = df.join(frames, "slice_id")
    return _set(met, F.zip_with(above("values", "_dark"), above("_flat", "_dark"), lambda a, b: F.try_divide(a, b)))


def max_normalize(df: DataFrame) -> DataFrame:
    """v / max over all elements; null where that is 0. The maximum is one broadcast row."""
    top = df.agg(F.max(F.array_max("values")).alias("greatest"))
    return df.crossJoin(F.broadcast(top)).select(*KEYS, F.transform("values", lambda v: F.try_divide(v, F.col("greatest"))).alias("values"))


def ramp(df: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """A centred spectrum times |k - n/2| / n below ``cutoff``; nothing passes from there on."""
    n = F.size("values")
    return _set(df, F.transform("values", lambda v, k: F.when((f := F.abs(k - F.floor(n / 2)) / n) < cutoff, v * f).otherwise(0.0)))


def _fold(start: float, of) -> Column:
    return F.aggregate("values", F.lit(start), of)


def total(df: DataFrame) -> Column:
    return F.sum(_fold(0.0, lambda s, v: s + v))


def squares(df: DataFrame) -> Column:
    return F.sum(_fold(0.0, lambda s, v: s + v * v))


def statistics(df: DataFrame) -> DataFrame:
    """sum, norm (sum of squares), min and max of all elements, in one pass."""
    return df.agg(total(df).alias("total"), squares(df).alias("norm"), F.min(F.array_min("values")).alias("least"), F.max(F.array_max("values")).alias("greatest"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return multiply(a, b).agg(total(a).alias("dot"))


def squared_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return subtract(a, b).agg(squares(a).alias("xerror"))


def normalize(df: DataFrame) -> DataFrame:
    """(v - min) / (max - min) over all elements; null where they are equal. The extremes are one broadcast row."""
    ends = statistics(df).select("least", "greatest")
    return df.crossJoin(F.broadcast(ends)).select(*KEYS, F.transform("values", lambda v: F.try_divide(v - F.col("least"), F.col("greatest") - F.col("least"))).alias("values"))


def chunks(df: DataFrame, slices: int, parts: int, halo: int = 0) -> DataFrame:
    """Contiguous ranges of slices, the first ``slices mod parts`` one longer; with a halo, border slices go to both sides."""
    size, extra = divmod(slices, parts)
    of = lambda s: F.when(s < extra * (size + 1), F.floor(s / (size + 1))).otherwise(extra + F.floor((s - extra * (size + 1)) / max(1, size)))
    low, high = of(F.greatest(F.col("slice_id") - halo, F.lit(0))), of(F.least(F.col("slice_id") + halo, F.lit(slices - 1)))
    return df.withColumn("chunk_id", F.explode(F.sequence(low.cast("int"), high.cast("int")))).withColumn("ghost", F.col("chunk_id") != of(F.col("slice_id")))


def to_cells(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.posexplode("values").alias("col_id", "value"))


def from_cells(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("c"))
    return rows.select(*KEYS, F.transform("c", lambda c: c["value"]).alias("values"))


#: Prior weights of neighbours that share a face, an edge or a corner.
WEIGHTS = (0.0523, 0.0370, 0.0302)


def prior_slope(d: Column, sigma: float, p: float = 1.2, c: float = 0.001) -> Column:
    """The prior's derivative at a difference ``d`` of neighbours."""
    t = F.pow(F.abs(d) / sigma, F.lit(2 - p))
    return F.when(d == 0, 0.0).otherwise(d / ((t + c) * sigma**2) * (2.0 - (2 - p) * t / (t + c)))


def prior_value(d: Column, sigma: float, p: float = 1.2, c: float = 0.001) -> Column:
    """The prior itself at a difference ``d``."""
    y = F.abs(d) / sigma
    return y * y / (F.pow(y, F.lit(2 - p)) + c)


def prior_curvature(sigma: float, c: float = 0.001) -> float:
    """The prior's second derivative where neighbours are equal."""
    return 2.0 / (sigma**2 * c)


def weights() -> list[tuple[int, int, int, float]]:
    """(slices, rows, columns away, weight) of the 26 neighbours."""
    near = (-1, 0, 1)
    return [(k, j, i, WEIGHTS[far - 1]) for k in near for j in near for i in near if (far := abs(k) + abs(j) + abs(i))]


def add_curvature(df: DataFrame, sigma: float) -> DataFrame:
    """The prior's curvature, summed over the neighbours, on top of a gradient."""
    return each(df, lambda v: v + sum(w for *_, w in weights()) * prior_curvature(sigma))


def prior_gradient(df: DataFrame, sigma: float, p: float = 1.2, c: float = 0.001) -> DataFrame:
    """Gradient of the 27-neighbour edge-preserving prior; edges repeat. Nine rows meet by a window over slices and rows."""
    by_slice, by_row = Window.partitionBy("row_id").orderBy("slice_id"), Window.partitionBy("slice_id").orderBy("row_id")
    near = lambda x, w: (F.coalesce(F.lag(x).over(w), F.col(x)), F.col(x), F.coalesce(F.lead(x).over(w), F.col(x)))
    rows = df.select(*KEYS, "values", *(v.alias(f"s{k}") for k, v in enumerate(near("values", by_slice))))
    rows = rows.select(*KEYS, "values", *(v.alias(f"n{k}{j}") for k in range(3) for j, v in enumerate(near(f"s{k}", by_row))))
    n = F.size("values")

    def at(v: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k in range(3):
            for j in range(3):
                for d in (-1, 0, 1):
                    far = abs(k - 1) + abs(j - 1) + abs(d)
                    if far:
                        place = F.least(F.greatest(i + d, F.lit(0)), n - 1)
                        total = total + WEIGHTS[far - 1] * prior_slope(v - F.get(F.col(f"n{k}{j}"), place), sigma, p, c)
        return total

    return _set(rows, F.transform("values", at))
