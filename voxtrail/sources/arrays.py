"""Array files of any size as a data source: byte ranges of .npy files by chunk, with filters on the axes pushed down.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("array_files").option("axes", "t,c,z,y,x").load("/movies")

A chunk is a run of whole outer slices of about `chunkBytes` bytes and is one input partition.  Only headers are read to
plan a scan; a task reads the bytes of its own chunk, a slice at a time, so neither a file's size nor a movie's
matters.  Conditions on axes (=, <, <=, >, >=, in) leave out chunks, slices and pixels before they
become rows: those that Spark pushes down, where the session's PUSH is on, and those given to `read_array` in any session.

Defined cases: zeros are rows like any other value; an array without elements gives no rows; axes of different files must agree in number;
Fortran order is read as it lies.  Files are opened by Arrow's file systems (local, hdfs://, s3://, gs://), and
executors need this package.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

CHUNK_BYTES = 64 << 20
PUSH = "spark.sql.python.filterPushdown.enabled"
#: Values that become one batch of rows.
BATCH_VALUES = 1 << 18
HEADER_BYTES = 1 << 16


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """What an array's file says of itself: `axes` from the outermost on, as they lie in the file."""

    path: str
    start: int
    shape: tuple[int, ...]
    axes: tuple[str, ...]
    dtype: str

    @staticmethod
    def read(path: str, axes: list[str]) -> Header:
        files, name = open_at(path)
        with files.open_input_stream(name) as f:
            head = io.BytesIO(f.read(HEADER_BYTES))
        version = np.lib.format.read_magic(head)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if len(shape) != len(axes):
            raise ValueError(f"{path} has {len(shape)} axes, not {axes}")
        if fortran:
            shape, axes = shape[::-1], axes[::-1]
        return Header(path, head.tell(), tuple(shape), tuple(axes), dtype.str)

    @property
    def movie(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".npy")


@dataclass
class Chunk(InputPartition):
    """Outer slices of a file: `depth` axes are fixed by each of `slices`, the others are read whole."""

    header: Header
    depth: int
    slices: list[tuple[int, ...]] = field(default_factory=list)

    @property
    def slice_values(self) -> int:
        return prod(self.header.shape[self.depth :])

    @property
    def n_bytes(self) -> int:
        return len(self.slices) * self.slice_values * np.dtype(self.header.dtype).itemsize


class Bounds:
    """Allowed values of axes: a closed range, and a set if there is one."""

    def __init__(self) -> None:
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}
        self.among: dict[str, set[int]] = {}

    def at_least(self, axis: str, value: int) -> None:
        self.low[axis] = max(value, self.low.get(axis, value))

    def at_most(self, axis: str, value: int) -> None:
        self.high[axis] = min(value, self.high.get(axis, value))

    def one_of(self, axis: str, values: set[int]) -> None:
        self.among[axis] = self.among.get(axis, values) & values

    def take(self, condition: Filter) -> bool:
        """Whether the condition is one of those that can be kept to here."""
        if not isinstance(condition, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            return isinstance(condition, IsNotNull)
        axis = condition.attribute[0]
        if isinstance(condition, EqualTo):
            self.one_of(axis, {condition.value})
        elif isinstance(condition, In):
            self.one_of(axis, set(condition.value))
        elif isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
            self.at_least(axis, condition.value + isinstance(condition, GreaterThan))
        else:
            self.at_most(axis, condition.value - isinstance(condition, LessThan))
        return True

    def allowed(self, axis: str, size: int) -> np.ndarray:
        found = np.arange(max(0, self.low.get(axis, 0)), min(size - 1, self.high.get(axis, size - 1)) + 1)
        return found[np.isin(found, list(self.among[axis]))] if axis in self.among else found


class ArrayReader(DataSourceReader):
    def __init__(self, headers: list[Header], value: str, chunk_bytes: int, bounds: Bounds) -> None:
        self.headers, self.value, self.chunk_bytes, self.bounds = headers, value, chunk_bytes, bounds

    def partitions(self) -> list[Chunk]:
        return [c for h in self.headers for c in self.chunks(h)] or [Chunk(Header("", 0, (), (), "<i4"), 0)]

    def chunks(self, header: Header) -> Iterator[Chunk]:
        """Slices are as thick as fits in `chunk_bytes`, down to a line of the last axis."""
        item, depth = np.dtype(header.dtype).itemsize, 0
        while depth < len(header.shape) - 1 and prod(header.shape[depth:]) * item > self.chunk_bytes:
            depth += 1
        chunk = Chunk(header, depth)
        if not prod(header.shape):
            return
        most = max(1, self.chunk_bytes // (chunk.slice_values * item))
        for at in product(*(self.bounds.allowed(a, n).tolist() for a, n in zip(header.axes[:depth], header.shape))):
            chunk.slices.append(at)
            if len(chunk.slices) == most:
                yield chunk
                chunk = Chunk(header, depth)
        if chunk.slices:
            yield chunk

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        if not chunk.slices:
            return
        h, kind = chunk.header, np.dtype(chunk.header.dtype)
        inner = h.shape[chunk.depth :]
        kept = [self.bounds.allowed(a, n) for a, n in zip(h.axes[chunk.depth :], inner)]
        if not all(map(len, kept)):
            return
        strides = [prod(h.shape[i + 1 :]) for i in range(chunk.depth)]
        # Of the first inner axis only the allowed span is read, in steps of a bounded number of values.
        line = prod(inner[1:])
        step = max(1, BATCH_VALUES // max(1, prod(map(len, kept[1:]))))
        files, name = open_at(h.path)
        with files.open_input_file(name) as f:
            for at in chunk.slices:
                first = sum(i * s for i, s in zip(at, strides))
                for k in range(0, len(kept[0]), step):
                    rows = kept[0][k : k + step]
                    data = f.read_at((rows[-1] - rows[0] + 1) * line * kind.itemsize, h.start + (first + rows[0] * line) * kind.itemsize)
                    part = np.frombuffer(data, kind).reshape(-1, *inner[1:])[np.ix_(rows - rows[0], *kept[1:])]
                    places = np.meshgrid(rows, *kept[1:], indexing="ij")
                    columns = dict(zip(h.axes, [np.full(part.size, i, np.int32) for i in at] + [p.ravel().astype(np.int32) for p in places]))
                    values = pa.array(part.ravel().astype(np.float64 if kind.kind == "f" else np.int64))
                    names = sorted(columns)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(h.movie), part.size), *(pa.array(columns[n]) for n in names), values], ["movie", *names, self.value])


class PushingReader(ArrayReader):
    """A reader that takes conditions from Spark, which has to be allowed to push them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        axes = set(self.headers[0].axes) if self.headers else set()
        for condition in filters:
            if len(condition.attribute) != 1 or condition.attribute[0] not in axes or not self.bounds.take(condition):
                yield condition


class ArrayFiles(DataSource):
    """Options: axes (names from the outermost on, t,z,y,x if not given), value (the values' column), chunkBytes, bounds, push (whether PUSH is on)."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def headers(self) -> list[Header]:
        files, name = open_at(self.options["path"])
        prefix = self.options["path"].removesuffix(name) if "://" in self.options["path"] else ""
        found = [name] if files.get_file_info(name).is_file else sorted(i.path for i in files.get_file_info(fs.FileSelector(name, recursive=True)) if i.path.endswith(".npy"))
        axes = self.options.get("axes", "t,z,y,x").replace(" ", "").split(",")
        return [Header.read(prefix + p, axes) for p in found]

    def schema(self) -> str:
        headers = self.headers()
        kinds = {np.dtype(h.dtype).kind for h in headers}
        if not kinds <= set("biuf"):
            raise ValueError(f"arrays of numbers are read, not of {kinds}")
        axes = sorted(self.options.get("axes", "t,z,y,x").replace(" ", "").split(","))
        return ", ".join(["movie string", *(f"{a} int" for a in axes), f"{self.options.get('value', 'v')} {'double' if 'f' in kinds else 'long'}"])

    def reader(self, schema) -> ArrayReader:
        bounds = Bounds()
        for axis, (low, high) in json.loads(self.options.get("bounds", "{}")).items():
            bounds.at_least(axis, low)
            bounds.at_most(axis, high - 1)
        kind = PushingReader if self.options.get("push", "false").lower() == "true" else ArrayReader
        return kind(self.headers(), self.options.get("value", "v"), int(self.options.get("chunkbytes", self.options.get("chunkBytes", CHUNK_BYTES))), bounds)


def read_array(spark: SparkSession, path: str, axes: str = "t,z,y,x", value: str = "v", chunk_bytes: int = CHUNK_BYTES, **bounds: tuple[int, int]) -> DataFrame:
    """Values of the arrays under `path`; `bounds` are half-open ranges of axes, such as t=(3, 5)."""
    spark.dataSource.register(ArrayFiles)
    reader = spark.read.format(ArrayFiles.name()).option("axes", axes).option("value", value).option("chunkBytes", chunk_bytes)
    return reader.option("push", spark.conf.get(PUSH, "false")).option("bounds", json.dumps(bounds)).load(path)
