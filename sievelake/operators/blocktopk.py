"""Nearest rows of a block of queries, one Arrow batch of the corpus at a time.

Spark decides which rows meet which queries (the ``hits`` column) and merges the partial results;
the function here only turns one task's rows into at most ``limit`` rows per query. A matrix
product bounds every distance from below up to rounding; only rows that can still win are then
measured exactly, as a sum over component differences in double.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.distance import metric as lookup_metric

BLOCK_CELLS = 4_000_000
PARTIAL_SCHEMA = "name string, k int, id bigint, value double"
_ARROW_SCHEMA = pa.schema(
    [("name", pa.string()), ("k", pa.int32()), ("id", pa.int64()), ("value", pa.float64())]
)


def vectors_of(column: pa.Array, dimension: int) -> np.ndarray:
    """An Arrow list column as a (rows, dimension) matrix of doubles."""
    lengths = pc.min_max(column.value_lengths()).as_py()
    if column.null_count or len(column) and (lengths["min"], lengths["max"]) != (dimension, dimension):
        raise ValueError(f"every vector must have {dimension} components")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dimension).astype(np.float64)


def bits_of(words: pa.Array, positions: int) -> np.ndarray:
    """An array<bigint> column as a (positions, rows) matrix of booleans."""
    flat = words.flatten().to_numpy(zero_copy_only=False).astype("<i8")
    rows = len(words)
    octets = flat.view(np.uint8).reshape(rows, len(flat) // max(rows, 1) * 8)
    return np.unpackbits(np.ascontiguousarray(octets.T), axis=0, bitorder="little")[
        :positions
    ].astype(bool)


def measure(name: str, block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The metric between every row of ``block`` and one query; smaller is nearer."""
    if name in ("l2", "l2_squared"):
        gap = block - query
        squared = (gap * gap).sum(axis=1)
        return np.sqrt(squared) if name == "l2" else squared
    if name == "manhattan":
        return np.abs(block - query).sum(axis=1)
    products = (block * query).sum(axis=1)
    if name == "dot":
        return -products
    with np.errstate(invalid="ignore", divide="ignore"):
        norms = np.sqrt((block * block).sum(axis=1)) * np.sqrt((query * query).sum())
        return 1.0 - products / norms


def lower_bounds(name: str, block: np.ndarray, queries: np.ndarray) -> np.ndarray | None:
    """A (rows, queries) matrix that never exceeds the true squared L2 distance.

    It is NaN where components are infinite; such rows have to be measured.
    """
    if name not in ("l2", "l2_squared"):
        return None
    sizes = (block * block).sum(axis=1)[:, None] + (queries * queries).sum(axis=1)[None, :]
    slack = 8.0 * (block.shape[1] + 8) * np.finfo(np.float64).eps
    with np.errstate(invalid="ignore"):
        return sizes * (1.0 - slack) - 2.0 * (block @ queries.T)


class NearestSoFar:
    """The best ``limit`` (value, id) pairs of one query."""

    def __init__(self, limit: int):
        self.limit = limit
        self.ids = np.empty(0, dtype=np.int64)
        self.values = np.empty(0)

    @property
    def worst(self) -> float:
        return self.values[-1] if len(self.values) == self.limit else np.inf

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        keep = values <= self.worst
        ids = np.concatenate([self.ids, ids[keep]])
        values = np.concatenate([self.values, values[keep]])
        order = np.lexsort((ids, values))[: self.limit]
        self.ids, self.values = ids[order], values[order]


def _squared(name: str, value: float) -> float:
    return value * value * (1 + 1e-14) if name == "l2" else value


def _scan_block(name, best, ids, block, queries, vector_of, rows_of_query):
    """Offer one block of rows to every query that hits some of them."""
    bounds = None
    if rows_of_query is None or (
        sum(map(len, rows_of_query.values())) > 0.05 * len(ids) * len(queries)
    ):
        bounds = lower_bounds(name, block, queries)
    for q in range(len(best)) if rows_of_query is None else rows_of_query:
        if best[q].limit <= 0:
            continue
        rows = None if rows_of_query is None else rows_of_query[q]
        if bounds is not None:
            low = bounds[:, vector_of[q]] if rows is None else bounds[rows, vector_of[q]]
            inside = ~(low > _squared(name, best[q].worst))  # NaN stays
            rows = np.flatnonzero(inside) if rows is None else rows[inside]
            low = low[inside]
            if len(rows) > best[q].limit:
                nearest = np.argpartition(low, best[q].limit - 1)[: best[q].limit]
                reach = measure(name, block[rows[nearest]], queries[vector_of[q]]).max()
                rows = rows[~(low > _squared(name, reach))]
        elif rows is None:
            rows = np.arange(len(ids))
        if len(rows):
            values = measure(name, block[rows], queries[vector_of[q]])
            known = ~np.isnan(values)
            best[q].add(ids[rows][known], values[known])


def partial_topk(
    rows: DataFrame,
    names: Sequence[str],
    vectors: np.ndarray,
    limits: Sequence[int],
    metric: str = "l2",
    vector_of: Sequence[int] | None = None,
) -> DataFrame:
    """At most ``limit`` rows per task and query, as (name, k, id, value).

    ``rows`` is (id, vector), or (id, vector, hits), where bit q of the hits says whether the row may
    answer query q. The query block is part of the task, hence bounded by the caller. Several
    queries may share a vector: query q uses row ``vector_of[q]`` of ``vectors``.
    """
    lookup_metric(metric)
    queries = np.ascontiguousarray(vectors, dtype=np.float64)
    names, limits = list(names), [int(k) for k in limits]
    vector_of = list(range(len(names))) if vector_of is None else list(vector_of)
    with_hits = len(rows.columns) > 2
    step = max(1, BLOCK_CELLS // max(queries.shape[1], len(names)))

    def scan(batches):
        best = [NearestSoFar(k) for k in limits]
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                block = vectors_of(batch.column(1), queries.shape[1])
                grouped = None
                if with_hits:
                    hits = bits_of(batch.column(2), len(names))
                    present = np.flatnonzero(hits.any(axis=1))
                    grouped = {q: np.flatnonzero(hits[q]) for q in present.tolist()}
                _scan_block(metric, best, ids, block, queries, vector_of, grouped)
        sizes = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(names, dtype=object), sizes), pa.string()),
                pa.array(np.repeat(np.array(limits, dtype=np.int32), sizes), pa.int32()),
                pa.array(np.concatenate([b.ids for b in best]), pa.int64()),
                pa.array(np.concatenate([b.values for b in best]), pa.float64()),
            ],
            schema=_ARROW_SCHEMA,
        )

    return rows.mapInArrow(scan, PARTIAL_SCHEMA)


def merge_topk(partial: DataFrame, largest: int, metric: str = "l2") -> DataFrame:
    """Partial results to (name, rank, id, dist), ordered by (distance, id).

    A scan of very many tasks leaves many candidates per query, and there are only as many names
    as queries. On a session set up for many shuffle partitions the candidates of a name are first
    reduced in several salted groups.
    """
    spark = partial.sparkSession
    salts = min(256, int(spark.conf.get("spark.sql.shuffle.partitions")) // 32)
    if salts > 1:
        salted = partial.withColumn("_salt", F.pmod(F.hash("id"), F.lit(salts)))
        order = Window.partitionBy("name", "_salt").orderBy("value", "id")
        partial = (
            salted.withColumn("_place", F.row_number().over(order))
            .where(F.col("_place") <= largest)
            .drop("_salt", "_place")
        )
    order = Window.partitionBy("name").orderBy("value", "id")
    value = -F.col("value") if lookup_metric(metric).descending else F.col("value")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") <= largest) & (F.col("rank") <= F.col("k")))
        .select("name", F.col("rank").cast("bigint").alias("rank"), "id", value.alias("dist"))
    )
