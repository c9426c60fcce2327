"""Column files with a binary header as Spark data sources.

``vecfile``   int32 n, int32 dimension, then n x dimension values of ``dtype`` (default u1)
``tagfile``   int64 rows, columns, entries; int64 start[rows + 1]; int32 tag[entries];
              float32 weight[entries]

A path is one file or a folder of shards. Each shard is read in row ranges, several tasks per
file; a reader seeks to its range and yields Arrow batches. Files are opened through
``pyarrow.fs``, so a path may be local or on any store that library reaches.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

ROWS_PER_TASK = 1_000_000
CELLS_PER_BATCH = 4_000_000
MANIFEST = "_manifest.json"
# Element types by numpy code.
SPARK_TYPES = {"u1": "smallint", "u2": "int", "i4": "int", "f4": "float"}
ARROW_TYPES = {"u1": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "f4": pa.float32()}


def _open(path: str):
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[len("file:") :]
    return pafs.LocalFileSystem(), path


def shards(path: str) -> list[str]:
    """The files of a path in row order; a manifest, where there is one, decides."""
    files, base = _open(path)
    info = files.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path}")
    if info.type == pafs.FileType.File:
        return [base]
    listed = {i.base_name: i.path for i in files.get_file_info(pafs.FileSelector(base))}
    if MANIFEST in listed:
        with files.open_input_stream(listed[MANIFEST]) as stream:
            return [posixpath.join(base, name) for name in json.loads(stream.read())]
    return [listed[name] for name in sorted(listed) if not name.startswith(("_", "."))]


@dataclass
class RowRange(InputPartition):
    file: str
    start: int
    stop: int
    first_row: int


class _RangedReader(DataSourceReader):
    def __init__(self, path: str, rows_per_task: int):
        self.path, self.rows_per_task = path, rows_per_task

    def rows_in(self, stream) -> int:
        raise NotImplementedError

    def partitions(self):
        files, _ = _open(self.path)
        ranges, first = [], 0
        for file in shards(self.path):
            with files.open_input_file(file) as stream:
                rows = self.rows_in(stream)
            for start in range(0, rows, self.rows_per_task):
                stop = min(start + self.rows_per_task, rows)
                ranges.append(RowRange(file, start, stop, first + start))
            first += rows
        return ranges or [RowRange("", 0, 0, 0)]

    def read(self, partition):
        if partition.start < partition.stop:
            files, _ = _open(self.path)
            with files.open_input_file(partition.file) as stream:
                yield from self.batches(stream, partition)


def _packed(values: pa.Array, dtype: str) -> bytes:
    """The elements as a file holds them; NULL and numbers out of range are errors."""
    if values.null_count:
        raise ValueError("a file cannot hold NULL")
    if len(values) and np.dtype(dtype).kind in "iu":
        ends, limits = pc.min_max(values).as_py(), np.iinfo(dtype)
        if ends["min"] < limits.min or ends["max"] > limits.max:
            raise ValueError(f"{ends['min']} to {ends['max']} is out of the range of {dtype}")
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False), dtype=f"<{dtype}").tobytes()


def _numbers(stream, offset: int, count: int, dtype: str) -> np.ndarray:
    stream.seek(offset)
    return np.frombuffer(stream.read(count * np.dtype(dtype).itemsize), dtype=f"<{dtype}")


class VectorReader(_RangedReader):
    def __init__(self, path, rows_per_task, dtype, scalar):
        super().__init__(path, rows_per_task)
        self.dtype, self.scalar = dtype, scalar

    def rows_in(self, stream):
        rows, width = _numbers(stream, 0, 2, "i4").tolist()
        if self.scalar and width != 1:
            raise ValueError(f"a scalar file has one value per row, not {width}")
        return rows

    def batches(self, stream, part):
        width = int(_numbers(stream, 4, 1, "i4")[0])
        size = np.dtype(self.dtype).itemsize
        step = max(1, CELLS_PER_BATCH // max(width, 1))
        for start in range(part.start, part.stop, step):
            stop = min(start + step, part.stop)
            flat = _numbers(stream, 8 + start * width * size, (stop - start) * width, self.dtype)
            values = pa.array(flat).cast(ARROW_TYPES[self.dtype])
            first = part.first_row + start - part.start
            ids = pa.array(np.arange(first + 1, first + 1 + stop - start))
            if not self.scalar:
                offsets = pa.array(np.arange(stop - start + 1, dtype=np.int32) * width)
                values = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([ids, values], ["id", "value"])


class VectorWriter(DataSourceArrowWriter):
    """One headed shard per task; the manifest names the shards of the attempts that won.

    Two attempts of a task write two files, and only the committed one is listed, so a lost or
    repeated task leaves no wrong rows.
    """

    def __init__(self, path, dtype, scalar):
        self.path, self.dtype, self.scalar = path, dtype, scalar

    def write(self, iterator):
        files, base = _open(self.path)
        files.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        blocks, rows, width = [], 0, 1 if self.scalar else 0
        body = posixpath.join(base, f"_{name}.body")
        with files.open_output_stream(body) as out:
            for batch in iterator:
                column = batch.column(batch.schema.get_field_index("value"))
                if not self.scalar and batch.num_rows:
                    if column.null_count:
                        raise ValueError("a file cannot hold NULL")
                    lengths = pc.min_max(column.value_lengths()).as_py()
                    if lengths["min"] != lengths["max"] or width not in (0, lengths["min"]):
                        raise ValueError("all vectors of a file have the same dimension")
                    width = lengths["min"]
                    column = column.flatten()
                out.write(_packed(column, self.dtype))
                rows += batch.num_rows
        with files.open_output_stream(posixpath.join(base, name)) as out:
            out.write(np.array([rows, width], dtype="<i4").tobytes())
            with files.open_input_stream(body) as done:
                while block := done.read(1 << 24):
                    out.write(block)
        files.delete_file(body)
        return ShardWritten(number, name, rows)

    def commit(self, messages):
        files, base = _open(self.path)
        files.create_dir(base, recursive=True)
        written = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        with files.open_output_stream(posixpath.join(base, MANIFEST)) as out:
            out.write(json.dumps([m.name for m in written]).encode())

    def abort(self, messages):
        files, base = _open(self.path)
        for message in messages:
            if message:
                files.delete_file(posixpath.join(base, message.name))


@dataclass
class ShardWritten(WriterCommitMessage):
    number: int
    name: str
    rows: int


class VectorFileSource(DataSource):
    """``spark.read.format("vecfile").option("dtype", "u1").load(path)`` -> (id, value)."""

    @classmethod
    def name(cls):
        return "vecfile"

    def _options(self):
        dtype = self.options.get("dtype", "u1")
        if dtype not in SPARK_TYPES:
            raise ValueError(f"unknown dtype {dtype!r}; known: {', '.join(SPARK_TYPES)}")
        return self.options["path"], dtype, self.options.get("scalar", "false") == "true"

    def schema(self):
        _, dtype, scalar = self._options()
        kind = SPARK_TYPES[dtype] if scalar else f"array<{SPARK_TYPES[dtype]}>"
        return f"id bigint, value {kind}"

    def reader(self, schema):
        path, dtype, scalar = self._options()
        rows = int(self.options.get("rowsPerTask", ROWS_PER_TASK))
        return VectorReader(path, rows, dtype, scalar)

    def writer(self, schema, overwrite):
        path, dtype, scalar = self._options()
        return VectorWriter(path, dtype, scalar)


class TagReader(_RangedReader):
    def rows_in(self, stream):
        return int(_numbers(stream, 0, 1, "i8")[0])

    def batches(self, stream, part):
        rows = self.rows_in(stream)
        starts = _numbers(stream, 24 + 8 * part.start, part.stop - part.start + 1, "i8")
        step = 100_000
        for low in range(0, part.stop - part.start, step):
            bounds = starts[low : low + step + 1]
            count = int(bounds[-1] - bounds[0])
            tags = _numbers(stream, 24 + 8 * (rows + 1) + 4 * int(bounds[0]), count, "i4")
            offsets = pa.array((bounds - bounds[0]).astype(np.int32))
            first = part.first_row + low
            ids = pa.array(np.arange(first + 1, first + len(bounds)))
            lists = pa.ListArray.from_arrays(offsets, pa.array(tags))
            yield pa.RecordBatch.from_arrays([ids, lists], ["id", "tags"])


class TagWriter(VectorWriter):
    """Shards in the compressed-row layout; a task keeps its offsets, not its tags, in memory."""

    def __init__(self, path, columns):
        super().__init__(path, "i4", False)
        self.columns = columns

    def write(self, iterator):
        files, base = _open(self.path)
        files.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        body = posixpath.join(base, f"_{name}.body")
        lengths = [np.empty(0, dtype=np.int64)]
        with files.open_output_stream(body) as out:
            for batch in iterator:
                tags = batch.column(batch.schema.get_field_index("tags"))
                sizes = tags.value_lengths().fill_null(0)
                lengths.append(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
                out.write(_packed(tags.flatten(), "i4"))
        sizes = np.concatenate(lengths)
        entries = int(sizes.sum())
        with files.open_output_stream(posixpath.join(base, name)) as out:
            out.write(np.array([len(sizes), self.columns, entries], dtype="<i8").tobytes())
            out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
            with files.open_input_stream(body) as done:
                while block := done.read(1 << 24):
                    out.write(block)
            for start in range(0, entries, CELLS_PER_BATCH):
                ones = np.ones(min(CELLS_PER_BATCH, entries - start), dtype="<f4")
                out.write(ones.tobytes())
        files.delete_file(body)
        return ShardWritten(number, name, len(sizes))


class TagFileSource(DataSource):
    """``spark.read.format("tagfile").load(path)`` -> (id, tags)."""

    @classmethod
    def name(cls):
        return "tagfile"

    def schema(self):
        return "id bigint, tags array<int>"

    def reader(self, schema):
        rows = int(self.options.get("rowsPerTask", ROWS_PER_TASK))
        return TagReader(self.options["path"], rows)

    def writer(self, schema, overwrite):
        return TagWriter(self.options["path"], int(self.options.get("columns", 0)))


# ---------------------------------------------------------------- plain functions


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFileSource)
    spark.dataSource.register(TagFileSource)


def _ordered(df: DataFrame, columns) -> DataFrame:
    """Rows in id order over the tasks: shard by shard, and inside each shard."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(tasks, "id").sortWithinPartitions("id").select(*columns)


def read_vectors(spark, path, dtype: str = "u1", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, value array); row i has the id i + 1."""
    register(spark)
    reader = spark.read.format("vecfile").option("dtype", dtype)
    return reader.option("rowsPerTask", rows_per_task).load(path)


def read_scalars(spark, path, dtype: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, value); a file with more than one value per row is an error."""
    register(spark)
    reader = spark.read.format("vecfile").option("dtype", dtype).option("scalar", "true")
    return reader.option("rowsPerTask", rows_per_task).load(path)


def read_tags(spark, path, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, tags), read by row range."""
    register(spark)
    return spark.read.format("tagfile").option("rowsPerTask", rows_per_task).load(path)


def write_vectors(df: DataFrame, path: str, dtype: str = "u1", column: str = "image_vec") -> None:
    register(df.sparkSession)
    value = F.col(column).cast(f"array<{SPARK_TYPES[dtype]}>").alias("value")
    out = _ordered(df, ["id", value])
    out.write.format("vecfile").option("dtype", dtype).mode("append").save(path)


def write_scalars(df: DataFrame, path: str, dtype: str, column: str) -> None:
    register(df.sparkSession)
    out = _ordered(df, ["id", F.col(column).cast(SPARK_TYPES[dtype]).alias("value")])
    writer = out.write.format("vecfile").option("dtype", dtype).option("scalar", "true")
    writer.mode("append").save(path)


def write_tags(df: DataFrame, path: str, columns: int, column: str = "tags") -> None:
    register(df.sparkSession)
    out = _ordered(df, ["id", F.col(column).cast("array<int>").alias("tags")])
    out.write.format("tagfile").option("columns", columns).mode("append").save(path)


def read_corpus(
    spark: SparkSession,
    vectors: str,
    equality: str,
    ranges: str | None = None,
    tags: str | None = None,
) -> DataFrame:
    """A corpus table from its column files. A missing path is an error before any work starts."""
    from ..functions.cleaning import widen_vector
    from ..operators.corpus import assemble

    for path in filter(None, (vectors, equality, ranges, tags)):
        shards(path)
    return assemble(
        read_vectors(spark, vectors).select("id", widen_vector(F.col("value")).alias("image_vec")),
        read_scalars(spark, equality, "u2").withColumnRenamed("value", "eq_val"),
        None
        if ranges is None
        else read_scalars(spark, ranges, "f4").select(
            "id", F.col("value").cast("double").alias("range_val")
        ),
        None if tags is None else read_tags(spark, tags),
    )
