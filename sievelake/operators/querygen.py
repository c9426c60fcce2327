"""Generate filtered queries from sampled corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keyed import keyed_int
from .corpus import batch_number
from .ranking import contiguous_ids, sample_exact

PICK_STREAM = 201
FINAL_STREAM = 202
BROADCAST_ROWS = 1_000_000


def query_sample(
    df: DataFrame, n: int, scale: int, rows_per_batch: int, first_id: int = 1
) -> DataFrame:
    """At most ``n`` rows, spread over the id batches, as (num, and the scalar columns).

    A batch of length m gives ``min(max(1, int(n * m / scale)), m - 1)`` rows; batches are taken in
    order until n rows are reached. The window inside a batch is bounded by ``rows_per_batch`` and
    sees ids only; the columns are joined to the picked ids afterwards.
    """
    rows = df.select("id", batch_number(F.col("id"), rows_per_batch, first_id).alias("_batch"))
    sizes = rows.groupBy("_batch").agg(F.count(F.lit(1)).alias("_size"))
    share = F.floor(F.lit(n) * (F.col("_size") / F.lit(float(scale))))
    quota = F.least(F.greatest(F.lit(1).cast("bigint"), share), F.col("_size") - 1)
    before = Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        sizes.withColumn("_quota", quota)
        .withColumn("_taken", F.coalesce(F.sum("_quota").over(before), F.lit(0)))
        .where(F.col("_taken") < n)
        .select("_batch", "_quota")
    )
    place = Window.partitionBy("_batch").orderBy(keyed_int(F.col("id"), PICK_STREAM), "id")
    picked = (
        rows.join(quotas, "_batch")
        .withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") <= F.col("_quota"))
        .select("id")
    )
    drawn = contiguous_ids(
        sample_exact(picked, n, "id", FINAL_STREAM), "id", out="num", rows_at_most=n
    )
    return df.join(F.broadcast(drawn) if n <= BROADCAST_ROWS else drawn, "id")


def _spec(field: str, operator: str, value: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(operator).alias("operator"),
        value.cast("string").alias("value"),
        F.lit("and").alias("logic"),
    )


def _queries(sample: DataFrame, filters: Column, limit: int) -> DataFrame:
    return sample.select(
        F.concat(F.lit("query"), F.col("num").cast("string")).alias("name"),
        F.lit("image_vec").alias("vector_field"),
        F.col("id").cast("bigint").alias("reference_id"),
        filters.alias("scalar_filters"),
        F.lit(limit).cast("int").alias("limit"),
    )


def equal_queries(sample: DataFrame, field: str = "eq_val", limit: int = 100) -> DataFrame:
    """Each sampled row asks for rows with its own attribute value."""
    return _queries(sample, F.array(_spec(field, "==", F.col(field))), limit)


def range_queries(
    sample: DataFrame, field: str = "range_val", half_width: float = 0.5, limit: int = 100
) -> DataFrame:
    """Each sampled row asks for an open interval around its own value."""
    filters = F.array(
        _spec(field, ">", F.col(field) - half_width), _spec(field, "<", F.col(field) + half_width)
    )
    return _queries(sample, filters, limit)


def contains_queries(sample: DataFrame, field: str = "tags", limit: int = 100) -> DataFrame:
    """Each sampled row that has tags asks for its first one."""
    tagged = sample.where(F.size(field) > 0)
    return _queries(tagged, F.array(_spec(field, "contains", F.col(field)[0])), limit)
