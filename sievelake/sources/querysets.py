"""Query sets and ground truth as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.knn import QUERY_SCHEMA


def read_query_set(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """A query set written by ``write_query_set``, optionally that of one dataset."""
    schema = QUERY_SCHEMA if dataset is None else _with_dataset()
    queries = spark.read.schema(schema).json(path)
    if dataset is not None:
        queries = queries.where(F.col("dataset") == dataset)
    return queries.select(*QUERY_SCHEMA.fieldNames())


def write_query_set(queries: DataFrame, path: str, dataset: str | None = None) -> None:
    if dataset is not None:
        queries = queries.withColumn("dataset", F.lit(dataset))
    queries.write.mode("overwrite").json(path)


def _with_dataset():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("dataset", T.StringType()), *QUERY_SCHEMA.fields])


def parse_query_list(spark: SparkSession, entries) -> DataFrame:
    """A list of query dicts, as a configuration file holds them, as a query set."""
    rows = []
    for entry in entries:
        filters = [
            {
                "field": f["field"],
                "operator": f["operator"],
                "value": None if f.get("value") is None else _text(f["value"]),
                "logic": f.get("logic", "and"),
            }
            for f in entry.get("scalar_filters") or []
        ]
        rows.append(
            {
                "name": entry["name"],
                "vector_field": entry["vector_field"],
                "reference_id": int(entry["reference_vector_name"]),
                "scalar_filters": filters,
                "limit": int(entry["limit"]),
            }
        )
    return spark.createDataFrame(rows, QUERY_SCHEMA)


def _text(value) -> str:
    return json.dumps(value) if isinstance(value, (list, dict)) else str(value)


def read_query_yaml(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The queries under a dataset key of a small YAML file."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML query sets needs the yaml package") from error
    with open(path, encoding="utf-8") as stream:
        content = yaml.safe_load(stream)
    if dataset not in content:
        raise ValueError(f"no queries for dataset {dataset!r} in {path}")
    return parse_query_list(spark, content[dataset])


def write_ground_truth(truth: DataFrame, path: str) -> None:
    """(name, result) as JSON lines."""
    truth.write.mode("overwrite").json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, rank, id), rank from 1."""
    lists = spark.read.schema("name string, result array<bigint>").json(path)
    return lists.select("name", F.posexplode("result").alias("pos", "id")).select(
        "name", (F.col("pos") + 1).cast("bigint").alias("rank"), "id"
    )
