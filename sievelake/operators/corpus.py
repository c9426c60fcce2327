"""The corpus table: assembly from column tables, declared schema, batches, summary."""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.distance import has_dimension

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("image_vec", T.ArrayType(T.FloatType(), False)),
        T.StructField("eq_val", T.IntegerType()),
        T.StructField("range_val", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.IntegerType(), False)),
    ]
)

# Declared type names and the Spark types that hold their values. An unsigned
# 16-bit attribute needs an int, hence INT16 is one.
TYPE_NAMES = {
    "INT": T.LongType(),
    "INTEGER": T.LongType(),
    "INT64": T.LongType(),
    "INT32": T.IntegerType(),
    "INT16": T.IntegerType(),
    "SMALLINT": T.IntegerType(),
    "INT8": T.ByteType(),
    "FLOAT": T.FloatType(),
    "DECIMAL": T.DecimalType(38, 18),
    "BOOL": T.BooleanType(),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "KEYWORD": T.StringType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampType(),
    "TEXT[]": T.ArrayType(T.StringType()),
    "TEXT_ARRAY": T.ArrayType(T.StringType()),
    "INTEGER[]": T.ArrayType(T.IntegerType()),
}
VECTOR_NAMES = ("VECTOR", "FLOAT_VECTOR")


def assemble(
    vectors: DataFrame,
    equality: DataFrame,
    ranges: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Column tables, each with ``id``, to one corpus table.

    Rows without tags get an empty array; without a range or tag table every row gets 0.0 or [].
    """
    rows = vectors.join(equality, "id")
    rows = rows.withColumn("range_val", F.lit(0.0)) if ranges is None else rows.join(ranges, "id")
    no_tags = F.array().cast("array<int>")
    if tags is None:
        rows = rows.withColumn("tags", no_tags)
    else:
        rows = rows.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", no_tags))
    return rows.select("id", "image_vec", "eq_val", "range_val", "tags")


def tags_from_pairs(pairs: DataFrame, row: str = "row", tag: str = "tag") -> DataFrame:
    """Sparse (row, tag) pairs to one sorted tag array per row.

    Repeated pairs go first, in a plain hash aggregate that works before its shuffle.
    """
    return pairs.select(row, tag).distinct().groupBy(row).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


def declared_type(column: Mapping) -> T.DataType:
    name = str(column.get("type", "")).upper()
    if name in VECTOR_NAMES:
        if not column.get("dimension"):
            raise ValueError(f"vector column {column['name']} needs a dimension")
        return T.ArrayType(T.FloatType())
    if name == "ARRAY":
        text = str(column.get("element_type", "")).upper() == "VARCHAR"
        return T.ArrayType(T.StringType() if text else T.IntegerType())
    name = re.sub(r"\(.*\)$", "", name)
    if name not in TYPE_NAMES:
        raise ValueError(f"unsupported type {column.get('type')!r} of column {column.get('name')}")
    return TYPE_NAMES[name]


def apply_schema(df: DataFrame, columns: Sequence[Mapping]) -> DataFrame:
    """The declared columns in declared order, cast; a vector of another dimension fails."""
    selected = []
    for column in columns:
        value = F.col(column["name"]).cast(declared_type(column))
        if str(column.get("type", "")).upper() in VECTOR_NAMES:
            value = checked_vector(value, int(column["dimension"]))
        selected.append(value.alias(column["name"]))
    return df.select(*selected)


def checked_vector(vector: Column, dimension: int) -> Column:
    message = F.concat(
        F.lit(f"vector dimension is not {dimension} but "), F.size(vector).cast("string")
    )
    return F.when(vector.isNull() | has_dimension(vector, dimension), vector).otherwise(
        F.raise_error(message).cast(T.ArrayType(T.FloatType()))
    )


def batch_number(id_column: Column, rows_per_batch: int, first_id: int = 1) -> Column:
    """The 0-based batch of a row when contiguous ids are cut into equal batches."""
    return F.floor((id_column - F.lit(first_id)) / F.lit(rows_per_batch)).cast("bigint")


def dataset_info(df: DataFrame, vector: str = "image_vec") -> DataFrame:
    """One row: size, dimension, id range."""
    return df.agg(
        F.count(F.lit(1)).alias("total_size"),
        F.max(F.size(vector)).cast("bigint").alias("vec_dim"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
    )
