"""Queries of the array operators over the supplied tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import arrays as A
from .operators import transforms as T


def sinograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sinogram rows: a slice a label, rows in order of vec_id."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("slice_id"), place.alias("row_id"), F.col("embedding").cast("array<double>").alias("values"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = li.groupBy((F.col("l_linenumber") - 1).alias("slice_id"), (F.col("l_partkey") % 16).cast("int").alias("row_id"), (F.col("l_orderkey") % 15).cast("int").alias("c")).agg(F.sum("l_quantity").alias("q"))
    rows = cells.groupBy("slice_id", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "q"))).alias("m"))
    return rows.select("slice_id", "row_id", F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("values"))


def squared(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Zero-padded to a square of the next odd size, half before and half after; rows that a slice lacks are zeros too."""
    n = max(rows, columns) | 1
    wide = A.pad_columns(df, n - columns).select(F.col("slice_id").alias("s"), (F.col("row_id") + (n - rows) // 2).alias("r"), "values")
    every = df.select("slice_id").distinct().select("slice_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("row_id"))
    return every.join(wide, (F.col("slice_id") == F.col("s")) & (F.col("row_id") == F.col("r")), "left").select("slice_id", "row_id", F.coalesce("values", A.zeros(n)).alias("values"))


def cells(df: DataFrame) -> DataFrame:
    c = A.to_cells(df)
    return c.select(*(F.col(k).cast("long").alias(k) for k in ("slice_id", "row_id", "col_id")), F.round("value", 5).alias("value"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 3).alias(c) for c in df.columns))


def _of(op, source=sinograms):
    return lambda spark, sf_dir: cells(op(source(spark, sf_dir)))


QUERIES = {
    "drop_column": _of(A.drop_column),
    "roll": _of(lambda d: A.roll(d, 5)),
    "fftshift": _of(A.fftshift),
    "pad_columns": _of(lambda d: A.pad_columns(d, 7)),
    "crop_columns": _of(lambda d: A.crop_columns(d, 7)),
    "pad_image": _of(lambda d: A.pad_image(d, 5, 16), volume),
    "crop_image": _of(lambda d: A.crop_image(d, 5, 16), volume),
    "recentre": _of(lambda d: A.recentre(A.drop_column(d), 63, 30.0)),
    "transpose": _of(A.transpose, volume),
    "ramp": _of(A.ramp),
    "normalize": _of(A.normalize),
    "scale_shift": _of(lambda d: A.each(d, lambda v: v * 2.5 + 1.0)),
    "add": _of(lambda d: A.add(d, A.roll(d, 1))),
    "multiply": _of(lambda d: A.multiply(d, A.roll(d, 1))),
    "divide": _of(lambda d: A.divide(d, A.roll(d, 1)), volume),
    "slice_range": _of(lambda d: A.slice_range(d, 2, 5)),
    "statistics": lambda spark, sf_dir: _rounded(A.statistics(volume(spark, sf_dir))),
    "dot": lambda spark, sf_dir: _rounded(A.dot(v := volume(spark, sf_dir), A.roll(v, 1))),
    "squared_difference": lambda spark, sf_dir: _rounded(A.squared_difference(v := volume(spark, sf_dir), A.roll(v, 1))),
    "chunks": lambda spark, sf_dir: A.chunks(volume(spark, sf_dir), 7, 3, 1).groupBy(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("slice_id").cast("long").alias("slice_id"), "ghost").agg(F.count(F.lit(1)).alias("n_rows")),
    "prior_gradient": _of(lambda d: A.prior_gradient(d, 10.0), volume),
    "backproject": _of(lambda d: T.backproject(A.drop_column(d))),
    "filtered_backproject": _of(lambda d: T.backproject(A.drop_column(d), filtered=True)),
    "project": _of(lambda d: T.project(squared(d, 16, 15), T.even_angles(12)), volume),
}

SINO = "WITH s AS (SELECT CAST(label AS BIGINT) AS slice_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
SINO_CELLS = SINO + "c AS (SELECT slice_id, row_id, unnest(generate_series(0, len(v) - 1)) AS col_id, unnest(v) AS value FROM s) "
VOLUME = """
    WITH q AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS slice_id, l_partkey % 16 AS row_id, l_orderkey % 15 AS col_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
    c AS (SELECT r.slice_id, r.row_id, k.col_id, coalesce(q.value, 0.0) AS value
          FROM (SELECT DISTINCT slice_id, row_id FROM q) r CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS col_id) k LEFT JOIN q USING (slice_id, row_id, col_id)) """
PAIR = "FROM c a JOIN c b ON a.slice_id = b.slice_id AND a.row_id = b.row_id AND b.col_id = (a.col_id + 1) % {n}"


def _cell(source: str, value: str = "value", row: str = "row_id", col: str = "col_id", tail: str = "FROM c", slice_id: str = "slice_id") -> str:
    return f"{source} SELECT {slice_id} AS slice_id, {row} AS row_id, {col} AS col_id, round({value}, 5) AS value {tail}"


def _pad(source: str, lines: str, n: int, before: int, total: int) -> str:
    return f"{source} SELECT l.slice_id, l.row_id, k.col_id, round(coalesce(c.value, 0.0), 5) AS value FROM {lines} l CROSS JOIN (SELECT unnest(generate_series(0, {n + total - 1})) AS col_id) k LEFT JOIN c ON c.slice_id = l.slice_id AND c.row_id = l.of AND c.col_id = k.col_id - {before}"


SQL_PAIR = lambda source, value, n: _cell(source, value, "a.row_id", "a.col_id", PAIR.format(n=n), "a.slice_id")
ORACLE_SQL = {
    "drop_column": _cell(SINO_CELLS, tail="FROM c WHERE col_id < 63"),
    "roll": _cell(SINO_CELLS, col="(col_id + 59) % 64"),
    "fftshift": _cell(SINO_CELLS, col="(col_id + 32) % 64"),
    "pad_columns": _pad(SINO_CELLS, "(SELECT DISTINCT slice_id, row_id, row_id AS of FROM c)", 64, 3, 7),
    "crop_columns": _cell(SINO_CELLS, col="col_id - 3", tail="FROM c WHERE col_id BETWEEN 3 AND 59"),
    "pad_image": _pad(VOLUME, "(SELECT DISTINCT slice_id, r AS row_id, r - 2 AS of FROM c, (SELECT unnest(generate_series(0, 20)) AS r))", 15, 2, 5),
    "crop_image": _cell(VOLUME, row="row_id - 2", col="col_id - 2", tail="FROM c WHERE row_id BETWEEN 2 AND 12 AND col_id BETWEEN 2 AND 11"),
    "transpose": _cell(VOLUME, row="slice_id", slice_id="row_id"),
    "ramp": _cell(SINO_CELLS, "value * abs(col_id - 32) / 64.0"),
    "normalize": _cell(SINO_CELLS, "(value - (SELECT min(value) FROM c)) / (SELECT max(value) - min(value) FROM c)"),
    "scale_shift": _cell(SINO_CELLS, "value * 2.5 + 1.0"),
    "add": SQL_PAIR(SINO_CELLS, "a.value + b.value", 64),
    "multiply": SQL_PAIR(SINO_CELLS, "a.value * b.value", 64),
    "divide": SQL_PAIR(VOLUME, "a.value / nullif(b.value, 0)", 15),
    "slice_range": _cell(SINO_CELLS, tail="FROM c WHERE slice_id >= 2 AND slice_id < 5"),
    "statistics": f"{VOLUME} SELECT round(sum(value), 3) AS total, round(sum(value * value), 3) AS norm, min(value) AS least, max(value) AS greatest FROM c",
    "dot": f"{VOLUME} SELECT round(sum(a.value * b.value), 3) AS dot {PAIR.format(n=15)}",
    "squared_difference": f"{VOLUME} SELECT round(sum((a.value - b.value) ** 2), 3) AS xerror {PAIR.format(n=15)}",
}
