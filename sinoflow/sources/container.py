"""Array containers as Spark data sources: chunked stores of named arrays, and raw binary files of slices.

A container is a folder of named arrays in the public layout of Zarr, version 2: an array is a folder with its shape,
chunk shape, type and compressor in ``.zarray`` and one file a chunk, named by the chunk's place ("3.0.1"). Real and
complex arrays (stored as pairs) of one or three dimensions are read and written; uncompressed, zlib and zstd.

Format ``array_container`` (options ``path``, ``dataset``, ``projections_first``) gives row-blocks: ``slice_id, row_id,
values``, or ``re`` and ``im`` for a complex array; one dimension gives ``place, value`` or ``place, re, im``. A
partition is a run of rows of one chunk of slices. The options ``begin`` and ``end`` (of slice_id, or of place),
``row_begin`` and ``row_end`` say what is read: only chunks that hold asked rows are opened. Format ``raw_slices``
(options ``path``, ``rows``, ``cols``, ``dtype``, ``task_bytes``, ``begin``, ``end``) reads files of whole slices, in order of
their names, slices numbered through; a file is read by many tasks, each a byte range that begins and ends at a slice.

Ranges are options, not pushed filters: in Spark 4.1 a loaded frame keeps what was pushed for one query, and the next
query of the same frame then reads too little (seen here: a range of two slices, then all slices, gave two).

Writers write a chunk (or file) under a name of the attempt and then move it to its own name, so a task that is tried
again leaves no second copy. An array can be found only when the driver has committed: ``.zarray`` is written last,
after the messages of all tasks have been checked for chunks that are missing or told twice; an aborted write is removed.

Paths are read by Arrow's file systems on executors (local and shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a chunk of our own holds at most, unless one row is longer, and those of rows in a batch.
CHUNK_BYTES, BATCH_BYTES = 8 << 20, 4 << 20
#: Bytes of a raw file that one task reads, unless a slice is larger.
TASK_BYTES = 64 << 20
SORTS = {"f4": "<f4", "f8": "<f8", "c8": "<c8", "c16": "<c16"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def read_bytes(fs: pafs.FileSystem, path: str, offset: int = 0, size: int | None = None) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if size is None else f.read(size)


def write_moved(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """The file appears whole under its name; one that is there already is replaced."""
    aside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(data)
    fs.move(aside, path)


@dataclass(frozen=True)
class Layout:
    """Shape, chunk shape, type and compressor of one array."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    compressor: str | None = None
    fill: float = 0.0

    @classmethod
    def of(cls, text: bytes) -> Layout:
        raw = json.loads(text)
        if raw.get("zarr_format") != 2 or raw.get("order", "C") != "C" or raw.get("filters"):
            raise ValueError("the array is not a version 2 array in C order without filters")
        fill = raw.get("fill_value") or 0
        fill = float(fill) if not isinstance(fill, list) else fill[0]
        return cls(tuple(raw["shape"]), tuple(raw["chunks"]), raw["dtype"], (raw.get("compressor") or {}).get("id"), fill)

    def text(self) -> bytes:
        how = {None: None, "zlib": {"id": "zlib", "level": 1}, "zstd": {"id": "zstd", "level": 1}}[self.compressor]
        return json.dumps({"zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": self.dtype, "compressor": how, "fill_value": self.fill, "order": "C", "filters": None}).encode()

    @property
    def complex(self) -> bool:
        return np.dtype(self.dtype).kind == "c"

    @property
    def bytes(self) -> int:
        return math.prod(self.chunks) * np.dtype(self.dtype).itemsize

    def decode(self, data: bytes) -> np.ndarray:
        if self.compressor == "zlib":
            data = zlib.decompress(data)
        elif self.compressor == "zstd":
            data = pa.decompress(data, self.bytes, codec="zstd", asbytes=True)
        elif self.compressor:
            raise ValueError(f"compressor {self.compressor} is not known")
        return np.frombuffer(data, self.dtype).reshape(self.chunks)

    def encode(self, chunk: np.ndarray) -> bytes:
        data = np.ascontiguousarray(chunk, self.dtype).tobytes()
        return zlib.compress(data, 1) if self.compressor == "zlib" else pa.compress(data, codec="zstd", asbytes=True) if self.compressor == "zstd" else data

    def grid(self) -> list[range]:
        return [range(-(-n // c)) for n, c in zip(self.shape, self.chunks, strict=True)]


def asked(options: dict, sizes: list[int], names: list[str]) -> list[tuple[int, int]]:
    """[begin, end) of each axis by the options, cut to its size."""
    out = []
    for size, name in zip(sizes, names, strict=True):
        lo, hi = int(options.get(f"{name}begin", 0)), int(options.get(f"{name}end", -1))
        out.append((min(max(0, lo), size), size if hi == -1 else max(0, min(hi, size))))
    return out


def value_names(complex_: bool, one: bool) -> list[str]:
    return ["re", "im"] if complex_ else ["value" if one else "values"]


def list_array(matrix: np.ndarray) -> pa.Array:
    n, wide = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(wide)), pa.array(np.ascontiguousarray(matrix, float).ravel()))


class Block(InputPartition):
    """Rows ``own`` of the chunks at ``place`` along all axes but the last."""

    def __init__(self, place: tuple[int, ...], own: tuple[tuple[int, int], ...]) -> None:
        super().__init__(place)
        self.place, self.own = place, own


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, options: dict) -> None:
        self.path, self.layout = path, layout
        swapped = options.get("projections_first", "false").lower() == "true"
        one = len(layout.shape) == 1
        self.names = ["place"] if one else ["row_id", "slice_id"] if swapped else ["slice_id", "row_id"]
        self.asked = asked(options, layout.shape[: 1 if one else 2], [""] if one else ["row_", ""] if swapped else ["", "row_"])

    def partitions(self) -> list[Block]:
        parts = [[(k, (max(lo, k * c), min(hi, (k + 1) * c))) for k in range(lo // c, -(-hi // c))] if hi > lo else [] for (lo, hi), c in zip(self.asked, self.layout.chunks, strict=False)]
        return [Block(tuple(k for k, _ in p), tuple(own for _, own in p)) for p in itertools.product(*parts)]

    def chunk(self, fs: pafs.FileSystem, root: str, place: tuple[int, ...]) -> np.ndarray:
        try:
            return self.layout.decode(read_bytes(fs, f"{root}/{'.'.join(map(str, place))}"))
        except FileNotFoundError:
            return np.full(self.layout.chunks, self.layout.fill, self.layout.dtype)

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:  # no chunk is asked for
            return
        fs, root = filesystem(self.path)
        inside = tuple(slice(lo - k * c, hi - k * c) for k, (lo, hi), c in zip(block.place, block.own, self.layout.chunks, strict=False))
        if len(self.layout.shape) == 1:
            a = self.chunk(fs, root, block.place)[inside]
            ids = [pa.array(np.arange(*block.own[0], dtype=np.int64))]
            parts = [a.real, a.imag] if self.layout.complex else [a]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.asarray(v, float)) for v in parts)], ["place", *value_names(self.layout.complex, True)])
            return
        width = self.layout.shape[2]
        cut = [self.chunk(fs, root, (*block.place, k))[inside] for k in self.layout.grid()[2]]
        a = np.concatenate(cut, axis=2)[:, :, :width]
        first, second = (np.arange(lo, hi, dtype=np.int32) for lo, hi in block.own)
        ids = {self.names[0]: np.repeat(first, len(second)), self.names[1]: np.tile(second, len(first))}
        flat = a.reshape(-1, width)
        step = max(1, BATCH_BYTES // max(1, 16 * width))
        for k in range(0, len(flat), step):
            own = flat[k : k + step]
            parts = [own.real, own.imag] if self.layout.complex else [own]
            yield pa.RecordBatch.from_arrays([pa.array(ids["slice_id"][k : k + step]), pa.array(ids["row_id"][k : k + step]), *(list_array(v) for v in parts)], ["slice_id", "row_id", *value_names(self.layout.complex, False)])


@dataclass
class Written(WriterCommitMessage):
    """The chunks (or files) that a task has written, and their rows."""

    names: list[str]
    rows: int


class ContainerWriter(DataSourceArrowWriter):
    """Rows come dealt out by chunk and in order within it (``write_array`` does so)."""

    def __init__(self, path: str, layout: Layout, overwrite: bool) -> None:
        self.path, self.layout = path, layout
        fs, root = filesystem(path)
        if fs.get_file_info(f"{root}/.zarray").type != pafs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"{path} exists")
            fs.delete_dir(root)
        fs.create_dir(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        one = len(self.layout.shape) == 1
        steps = np.array(self.layout.chunks[: 1 if one else 2])
        keys = ["place"] if one else ["slice_id", "row_id"]
        names, place, chunk, rows = [], None, None, 0

        def flush() -> None:
            if place is not None:
                names.append(".".join(map(str, place if one else (*place, 0))))
                write_moved(fs, f"{root}/{names[-1]}", self.layout.encode(chunk))

        for b in iterator:
            at = np.stack([np.asarray(b.column(b.schema.get_field_index(k))) for k in keys], axis=1).astype(np.int64)
            columns = [b.column(b.schema.get_field_index(c)) for c in value_names(self.layout.complex, one)]
            values = [np.asarray(c) if one else np.asarray(c.flatten(), float).reshape(len(at), -1) for c in columns]
            data = values[0] + 1j * values[1] if self.layout.complex else values[0]
            rows += len(at)
            owner = at // steps
            cuts = [0, *(np.flatnonzero((owner[1:] != owner[:-1]).any(1)) + 1), len(at)] if len(at) else []
            for lo, hi in itertools.pairwise(cuts):
                if place is None or tuple(owner[lo]) != place:
                    flush()
                    place, chunk = tuple(int(v) for v in owner[lo]), np.full(self.layout.chunks, self.layout.fill, self.layout.dtype)
                inside = at[lo:hi] - owner[lo:hi] * steps
                if one:
                    chunk[inside[:, 0]] = data[lo:hi]
                else:
                    chunk[inside[:, 0], inside[:, 1]] = data[lo:hi]
        flush()
        return Written(names, rows)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m for n in m.names]
        if len(names) != len(set(names)):
            raise ValueError("a chunk was written by two tasks: deal rows out by chunk first, as write_array does")
        fs, root = filesystem(self.path)
        write_moved(fs, f"{root}/.zarray", self.layout.text())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.delete_dir(root)


class ArrayContainer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_container"

    @property
    def at(self) -> str:
        if "path" not in self.options or "dataset" not in self.options:
            raise ValueError("array_container needs path and dataset")
        return f"{self.options['path'].rstrip('/')}/{self.options['dataset'].strip('/')}"

    def layout(self) -> Layout:
        fs, root = filesystem(self.at)
        out = Layout.of(read_bytes(fs, f"{root}/.zarray"))
        if len(out.shape) not in (1, 3):
            raise ValueError("arrays of one or three dimensions are read")
        return out

    def schema(self) -> str:
        layout = self.layout()
        one = len(layout.shape) == 1
        kind = "double" if one else "array<double>"
        return ", ".join([*(["place long"] if one else ["slice_id int", "row_id int"]), *(f"{c} {kind}" for c in value_names(layout.complex, one))])

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.at, self.layout(), self.options)

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        numbers = lambda name: tuple(int(v) for v in self.options[name].split(","))
        layout = Layout(numbers("shape"), numbers("chunks"), SORTS[self.options["dtype"]], self.options.get("compressor") or None)
        return ContainerWriter(self.at, layout, overwrite)


class Piece(InputPartition):
    """Slices [begin, end) of one file; the first of them has the number ``first``."""

    def __init__(self, path: str, begin: int, end: int, first: int) -> None:
        super().__init__(path)
        self.path, self.begin, self.end, self.first = path, begin, end, first


class RawReader(DataSourceReader):
    def __init__(self, path: str, rows: int, cols: int, dtype: str, options: dict) -> None:
        self.path, self.rows, self.cols, self.dtype = path, rows, cols, dtype
        self.task_bytes, (self.asked,) = int(options.get("task_bytes", TASK_BYTES)), asked(options, [1 << 62], [""])

    def partitions(self) -> list[Piece]:
        fs, root = filesystem(self.path)
        size, first, out = self.rows * self.cols * np.dtype(self.dtype).itemsize, 0, []
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
        step = max(1, self.task_bytes // max(1, size))
        for f in sorted(files, key=lambda f: f.path):
            if f.size % size:
                raise ValueError(f"{f.path} is not a whole number of slices")
            n = f.size // size
            lo, hi = max(0, self.asked[0] - first), min(n, self.asked[1] - first)
            out += [Piece(f.path, k, min(hi, k + step), first + k) for k in range(lo, hi, step)]
            first += n
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        fs, _ = filesystem(self.path)
        size = self.rows * self.cols * np.dtype(self.dtype).itemsize
        for k in range(piece.end - piece.begin):
            a = np.frombuffer(read_bytes(fs, piece.path, (piece.begin + k) * size, size), self.dtype).reshape(self.rows, self.cols)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(self.rows, piece.first + k, np.int32)), pa.array(np.arange(self.rows, dtype=np.int32)), list_array(a)], ["slice_id", "row_id", "values"])


class RawWriter(DataSourceArrowWriter):
    """A file a run of consecutive slices, named by the first; rows come in order of slice and row (``write_raw`` does so)."""

    def __init__(self, path: str, rows: int, cols: int, dtype: str, overwrite: bool) -> None:
        self.path, self.rows, self.cols, self.dtype = path, rows, cols, dtype
        fs, root = filesystem(path)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"{path} exists")
            fs.delete_dir(root)
        fs.create_dir(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        name, out, last, rows = None, None, None, 0
        for b in iterator:
            slices, places = (np.asarray(b.column(b.schema.get_field_index(c))).tolist() for c in ("slice_id", "row_id"))
            data = np.asarray(b.column(b.schema.get_field_index("values")).flatten()).astype(self.dtype).reshape(len(slices), -1)
            for s, r, line in zip(slices, places, data, strict=True):
                if len(line) != self.cols or (r != 0 if last is None or last[1] == self.rows - 1 else (s, r) != (last[0], last[1] + 1)):
                    raise ValueError(f"slice {s} is not {self.rows} rows of {self.cols} columns")
                if last is not None and last[1] == self.rows - 1 and s != last[0] + 1:
                    raise ValueError(f"slice {last[0] + 1} is missing")
                if out is None:
                    name, aside = f"slices-{s:012d}.raw", f"{root}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(aside)
                out.write(line.tobytes())
                last, rows = (s, r), rows + 1
        if out is None:
            return Written([], 0)
        out.close()
        if last[1] != self.rows - 1:
            fs.delete_file(aside)
            raise ValueError(f"slice {last[0]} is not {self.rows} rows")
        fs.move(aside, f"{root}/{name}")
        return Written([f"{name}:{rows // self.rows}"], rows)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((int(n[7:19]), int(n.split(":")[1])) for m in messages if m for n in m.names)
        for (a, n), (b, _) in itertools.pairwise(parts):
            if a + n != b:
                raise ValueError(f"slices {a + n} to {b} are missing or come twice")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.delete_dir(root)


class RawSlices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_slices"

    def schema(self) -> str:
        return "slice_id int, row_id int, values array<double>"

    def _args(self) -> tuple[str, int, int, str]:
        return self.options["path"], int(self.options["rows"]), int(self.options["cols"]), self.options.get("dtype", "<f4")

    def reader(self, schema) -> RawReader:
        return RawReader(*self._args(), self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(*self._args(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    spark.dataSource.register(ArrayContainer)
    spark.dataSource.register(RawSlices)


def read_array(spark: SparkSession, path: str, dataset: str, begin: int = 0, end: int = -1, projections_first: bool = False, rows: tuple[int, int] = (0, -1)) -> DataFrame:
    """An array as rows; slices (or places) [begin, end) and, of three dimensions, ``rows`` [begin, end), -1 to the last one, are all that is read.

    With ``projections_first`` the stored axes are (projection, slice, column) and are swapped.
    """
    register(spark)
    for lo, hi in ((begin, end), rows):
        if lo < 0 or (hi != -1 and hi <= lo):
            raise ValueError("ranges must be [begin, end) with 0 <= begin < end")
    options = {"path": path, "dataset": dataset, "projections_first": str(projections_first), "begin": begin, "end": end, "row_begin": rows[0], "row_end": rows[1]}
    return spark.read.format("array_container").options(**options).load()


def write_array(df: DataFrame, path: str, dataset: str, dtype: str | None = None, compressor: str | None = None, chunk_bytes: int = CHUNK_BYTES, overwrite: bool = False, shape: tuple[int, ...] | None = None) -> None:
    """Rows of one or three dimensions, real or complex, as an array of the container at ``path``.

    Its shape is the largest places plus one unless it is given; places without a row are 0. A chunk is one slice's rows, as many
    as ``chunk_bytes`` hold, whole in columns. ``dtype`` is f4, f8, c8 or c16 (f8 or c16 unless given).
    """
    spark = df.sparkSession
    register(spark)
    one, complex_ = "place" in df.columns, "re" in df.columns
    dtype = dtype or ("c16" if complex_ else "f8")
    if (np.dtype(SORTS[dtype]).kind == "c") != complex_:
        raise ValueError("complex rows need a complex type, real ones a real type")
    keys, names = ["place"] if one else ["slice_id", "row_id"], value_names(complex_, one)
    if shape is None:
        ends = [(F.max(k) + 1).alias(k) for k in keys] + ([] if one else [F.max(F.size(names[0])).alias("n"), F.min(F.size(names[0])).alias("least")])
        top = df.agg(*ends).first()
        if not one and top["n"] != top["least"]:
            raise ValueError("the rows differ in their number of columns")
        shape = tuple(int(top[k] or 0) for k in (*keys, *([] if one else ["n"])))
    size = np.dtype(SORTS[dtype]).itemsize
    lines = max(1, chunk_bytes // (size * max(1, 1 if one else shape[2])))
    chunks = (max(1, min(lines, shape[0])),) if one else (1, max(1, min(lines, shape[1])), max(1, shape[2]))
    owner = [F.expr(f"{k} div {c}") for k, c in zip(keys, chunks, strict=False)]
    kinds = [F.col(k).cast("long" if one else "int").alias(k) for k in keys] + [F.col(c).cast("double" if one else "array<double>").alias(c) for c in names]
    dealt = df.select(*kinds).repartitionByRange(*owner).sortWithinPartitions(*keys)
    out = dealt.write.format("array_container").mode("overwrite" if overwrite else "append")
    options = {"path": path, "dataset": dataset, "shape": ",".join(map(str, shape)), "chunks": ",".join(map(str, chunks)), "dtype": dtype, "compressor": compressor or ""}
    out.options(**options).save()


def write_angles(spark: SparkSession, theta, path: str, dataset: str) -> None:
    """One dimension of angles, a few thousand at most."""
    flat = np.asarray(theta, float).ravel()
    write_array(spark.createDataFrame([(k, float(t)) for k, t in enumerate(flat)], "place long, value double"), path, dataset)


def read_vector(spark: SparkSession, path: str, dataset: str) -> np.ndarray:
    """One dimension on the driver, for what is meant to be there, as angles are."""
    rows = read_array(spark, path, dataset).orderBy("place").collect()
    return np.array([complex(*r[1:]) if len(r) == 3 else r[1] for r in rows])


def read_raw(spark: SparkSession, path: str, rows: int, cols: int, dtype: str = "<f4", begin: int = 0, end: int = -1, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Slices [begin, end) of raw files of whole slices, C order; the files in order of their names, slices numbered through."""
    register(spark)
    return spark.read.format("raw_slices").options(path=path, rows=rows, cols=cols, dtype=dtype, begin=begin, end=end, task_bytes=task_bytes).load()


def write_raw(df: DataFrame, path: str, rows: int, cols: int, dtype: str = "<f4", overwrite: bool = False) -> None:
    """Slices 0 and on, whole, as raw files that read in order of their names give the array back."""
    register(df.sparkSession)
    dealt = df.select(F.col("slice_id").cast("int").alias("slice_id"), F.col("row_id").cast("int").alias("row_id"), F.col("values").cast("array<double>").alias("values")).repartitionByRange("slice_id").sortWithinPartitions("slice_id", "row_id")
    dealt.write.format("raw_slices").mode("overwrite" if overwrite else "append").options(path=path, rows=rows, cols=cols, dtype=dtype).save()
