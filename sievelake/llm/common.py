"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievelake.session import stored

#: Text of so many bytes is handled at a time inside a task; a longer document is handled alone.
SHARD_BYTES = 8 << 20

#: Tables of at most so many bytes are sent whole to every task; each caller has another way beyond it.
SEND_BYTES = 64 << 20

#: Rows that Spark hands to a Python worker at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The columns of ``documents``.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """The configuration ``name`` is ``value`` for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of what runs inside as soon as each query has ended."""
    return setting(spark, FREE_SHUFFLES, "true")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder; its shuffles are deleted once it is written."""
    with freed_shuffles(df.sparkSession):
        return stored(df, label)


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows of a task in order, as tables of about ``limit`` bytes in ``column``.

    What the task no longer uses goes back to the system at its end, since Python workers live on.
    """
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, length in enumerate(lengths):
            size += length
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < len(lengths):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
    del held
    release_memory()


def per_text(
    docs: DataFrame,
    make: Callable[[], Callable[[list], Sequence]],
    schema: str,
    carry: Sequence[str] = ("doc_id",),
    text: str = "text",
    limit: int = SHARD_BYTES,
) -> DataFrame:
    """The columns ``carry`` and the columns that a function finds in whole texts; no shuffle.

    ``make`` is called once in each task. What it returns gets a list of UTF-8 texts (bytes, None for
    null) and gives the new columns, in the order of ``schema``, one entry per text. A carried column
    whose name the schema also has is left out.
    """
    added = T.StructType.fromDDL(schema)
    carry = [c for c in carry if c not in added.fieldNames()]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).cast("binary").alias("_text"))
    out = T.StructType([rows.schema[c] for c in carry] + added.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        function = make()
        for part in shards(batches, "_text", limit):
            new = function(part.column("_text").to_pylist())
            columns = [part.column(c) for c in carry]
            columns += [
                v if isinstance(v, pa.Array) else pa.array(v, arrow.field(f.name).type)
                for f, v in zip(added.fields, new)
            ]
            for batch in pa.Table.from_arrays(columns, names=out.fieldNames()).cast(arrow).to_batches():
                yield batch

    return rows.mapInArrow(run, out)


def whole_rows(docs: DataFrame) -> DataFrame:
    """(_row, text): every column in one struct, so that no name can clash with what is added."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")


def held_out(doc_id: str, classes: int, which: int):
    """True for rows whose crc32(doc_id as text) has the remainder ``which``; null ids have crc32('')."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(classes)) == which


def bounded_sample(df: DataFrame, rows: int, by: str = "doc_id") -> DataFrame:
    """About ``rows`` rows, chosen by a hash of ``by``; all of them when there are no more.

    For fitting a classifier on labelled rows only.
    """
    found = df.count()
    if found <= rows:
        return df
    bound = int(rows / found * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(by), F.lit(17)), F.lit(1 << 30)) < bound)
