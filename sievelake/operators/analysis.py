"""Selectivity of values and filters, and how filters correlate with nearness."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import local_table
from .blocktopk import bits_of, merge_topk, partial_topk
from .hits import HITS, has_position, with_hits
from .knn import Query, over_blocks, vectors_for

BROADCAST_ROWS = 1_000_000
RELEVANCE_OPERATORS = ("==", ">", ">=", "<", "<=")


# ---------------------------------------------------------------- selectivity of values


def filter_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, cnt, selectivity) of numeric scalar fields, all in one pass.

    NULL counts as a value. The denominator is the number of rows.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"))
            for f in fields
        ]
    )
    counts = (
        df.select(F.explode(pairs).alias("pair"))
        .groupBy("pair.field", "pair.value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return _as_rates(counts, counts.groupBy("field").agg(F.sum("cnt").alias("total")))


def tag_rates(df: DataFrame, field: str = "tags", denominator: str = "occurrences") -> DataFrame:
    """The same for an array field; the denominator is all tag occurrences, or all rows."""
    if denominator not in ("occurrences", "rows"):
        raise ValueError("denominator must be 'occurrences' or 'rows'")
    counts = (
        df.select(F.explode(field).alias("tag"))
        .groupBy(F.col("tag").cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.lit(field).alias("field"), "value", "cnt")
    )
    if denominator == "occurrences":
        totals = counts.groupBy("field").agg(F.sum("cnt").alias("total"))
    else:
        totals = df.agg(F.count(F.lit(1)).alias("total")).withColumn("field", F.lit(field))
    return _as_rates(counts, totals)


def _as_rates(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``totals`` has one row per field."""
    return counts.join(F.broadcast(totals), "field").select(
        "field", "value", "cnt", "total", (F.col("cnt") / F.col("total")).alias("selectivity")
    )


# ---------------------------------------------------------------- the query set itself


def filters_of(queries: DataFrame) -> DataFrame:
    """One row per filter: (name, pos, field, operator, value, logic)."""
    return queries.select("name", F.posexplode("scalar_filters").alias("pos", "f")).select(
        "name", "pos", "f.field", "f.operator", "f.value", "f.logic"
    )


def filter_fields(queries: DataFrame) -> DataFrame:
    return filters_of(queries).select("field").distinct()


def relevance_targets(queries: DataFrame) -> DataFrame:
    """Queries with exactly one filter, and that a comparison."""
    only = F.col("scalar_filters")[0]
    return queries.where(
        (F.size("scalar_filters") == 1) & only["operator"].isin(*RELEVANCE_OPERATORS)
    ).select("name", "reference_id", "vector_field", only["field"].alias("field"))


# ---------------------------------------------------------------- selectivity of whole filters


def _bit_counter(queries: int):
    def count(batches):
        rows, matched = 0, np.zeros(queries, dtype=np.int64)
        for batch in batches:
            rows += batch.num_rows
            matched += bits_of(batch.column(0), queries).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(-1, queries, dtype=np.int32)),
                pa.array(np.concatenate([[rows], matched])),
            ],
            ["position", "matched"],
        )

    return count


def match_counts(
    df: DataFrame, queries: DataFrame, mode: str = "fold", like: str = "regex"
) -> DataFrame:
    """(name, matched, total) for every query, in one pass over the rows.

    Every task adds up the bits of its rows; position -1 counts the rows themselves.
    """

    def answer(block: Sequence[Query]) -> DataFrame:
        hits = with_hits(df, [q.filters for q in block], mode, like, keep_all=True)
        found = (
            hits.select(HITS)
            .mapInArrow(_bit_counter(len(block)), "position int, matched bigint")
            .groupBy("position")
            .agg(F.sum("matched").alias("matched"))
        )
        names = _numbered(df, block)
        everything = Window.partitionBy(F.lit(0))  # one row per query of the block
        total = F.max(F.when(F.col("position") == -1, F.col("matched"))).over(everything)
        return (
            names.join(found, "position", "full")
            .select("name", "position", "matched", total.alias("total"))
            .where(F.col("position") >= 0)
            .select(
                "name",
                F.coalesce("matched", F.lit(0)).alias("matched"),
                F.coalesce("total", F.lit(0)).alias("total"),
            )
        )

    return over_blocks(queries, answer, empty_schema="name string, matched bigint, total bigint")


def query_selectivity(df: DataFrame, queries: DataFrame, mode: str = "fold") -> DataFrame:
    """Achieved filter rate: the share of all rows that pass the query's filter."""
    return match_counts(df, queries, mode).withColumn(
        "selectivity", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0))
    )


# ---------------------------------------------------------------- among the nearest rows


def _nearest_rows(df: DataFrame, block: Sequence[Query], top_k: int, vectors, metric: str):
    """(name, the row's scalar columns) of the ``top_k`` nearest rows, filters ignored."""
    field = block[0].vector_field
    topk = merge_topk(
        partial_topk(
            df.where(F.col(field).isNotNull()).select("id", field),
            [q.name for q in block],
            vectors,
            [top_k] * len(block),
            metric,
        ),
        top_k,
        metric,
    ).select("name", "id")
    if len(block) * top_k <= BROADCAST_ROWS:
        topk = F.broadcast(topk)
    return df.drop(field).join(topk, "id")


def _numbered(df: DataFrame, block: Sequence[Query]) -> DataFrame:
    rows = [(i, q.name) for i, q in enumerate(block)]
    return local_table(df.sparkSession, rows, "position int, name string")


def _by_vector_field(block: Sequence[Query]):
    fields = {}
    for query in block:
        fields.setdefault(query.vector_field, []).append(query)
    return fields.items()


def relevance_distribution(
    df: DataFrame,
    queries: DataFrame,
    top_k: int = 500,
    metric: str = "l2",
    references: DataFrame | None = None,
) -> DataFrame:
    """(name, value, cnt, selectivity): values of the filter field among the nearest rows.

    Only queries with a single comparison take part; a query whose reference row is missing is
    left out. Rows without a value are counted neither as a value nor in the total.
    """
    source = df if references is None else references
    targets = queries.join(relevance_targets(queries).select("name"), "name", "left_semi").join(
        source.select(F.col("id").alias("reference_id")), "reference_id", "left_semi"
    )

    def answer(block: Sequence[Query]) -> DataFrame:
        parts = []
        for field, members in _by_vector_field(block):
            near = _nearest_rows(df, members, top_k, vectors_for(source, members, field), metric)
            value = None
            for column in sorted({q.filters[0]["field"] for q in members}):
                names = [q.name for q in members if q.filters[0]["field"] == column]
                test, number = F.col("name").isin(names), F.col(column).cast("double")
                value = F.when(test, number) if value is None else value.when(test, number)
            parts.append(near.select("name", value.alias("value")))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        counts = rows.where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count(F.lit(1)).alias("cnt"))
        totals = counts.groupBy("name").agg(F.sum("cnt").alias("total"))
        return counts.join(F.broadcast(totals), "name").select(
            "name", "value", "cnt", "total", (F.col("cnt") / F.col("total")).alias("selectivity")
        )

    return over_blocks(
        targets,
        answer,
        empty_schema="name string, value double, cnt bigint, total bigint, selectivity double",
    )


def query_filter_correlation(
    df: DataFrame,
    queries: DataFrame,
    top_k: int = 500,
    metric: str = "l2",
    mode: str = "fold",
    references: DataFrame | None = None,
) -> DataFrame:
    """Achieved relevance: the share of the ``top_k`` nearest rows that pass the filter."""
    source = df if references is None else references

    def answer(block: Sequence[Query]) -> DataFrame:
        parts = []
        for field, members in _by_vector_field(block):
            vectors = vectors_for(source, members, field)
            near = _nearest_rows(df, members, top_k, vectors, metric)
            near = with_hits(near, [q.filters for q in members], mode, keep_all=True)
            parts.append(
                near.join(F.broadcast(_numbered(df, members)), "name")
                .groupBy("name")
                .agg(
                    F.avg(
                        has_position(HITS, F.col("position")).cast("double")
                    ).alias("relevance")
                )
            )
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    return over_blocks(queries, answer, empty_schema="name string, relevance double")
