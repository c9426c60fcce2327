"""Global order without a global window: prefix sums, contiguous ids and exact-size samples."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keyed import keyed_int

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 4096


def _with_range(
    df: DataFrame, key: str, rows_per_range: int, rows_at_most: int | None
) -> DataFrame:
    """Add ``_range``: a number that grows with ``key``, with about equally many rows each.

    The split points are read once and become constants, so that every later pass, and every
    recomputed task, puts a row into the same range. Rows with a NULL key come first, in the range
    of the smallest keys, and NaN last, as Spark sorts them.
    """
    rows = df.count() if rows_at_most is None else rows_at_most
    ranges = min(MAX_RANGES, math.ceil(rows / rows_per_range))
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0.0))
    shares = [i / ranges for i in range(1, ranges)]
    finite = F.col(key).cast("double")
    finite = F.when(F.abs(finite) < float("inf"), finite)
    points = df.agg(F.percentile_approx(finite, shares, 20 * ranges).alias("points")).first()["points"]
    splits = [float("-inf"), *sorted(set(points or [])), float("inf")]
    number = F.col(key).cast("double")
    lowest, highest = F.lit(float("-inf")), F.lit(float("inf"))
    keyed = df.withColumn(
        "_key", F.when(number.isNull(), lowest).when(F.isnan(number), highest).otherwise(number)
    )
    return (
        Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(keyed).drop("_key")
    )


def running_total(
    df: DataFrame,
    key: str,
    weight: Column,
    out: str,
    rows_per_range: int = ROWS_PER_RANGE,
    rows_at_most: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows up to this one in the order of ``key``.

    ``key`` is numeric and unique. Rows are cut into key ranges; a window runs inside each range
    and starts from the total of the ranges before it, at most ``MAX_RANGES`` numbers. A caller
    that knows a bound on the rows saves the count.
    """
    ranged = _with_range(df.withColumn("_weight", weight), key, rows_per_range, rows_at_most)
    inside = (
        Window.partitionBy("_range")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if rows_at_most is not None and rows_at_most <= rows_per_range:
        return ranged.withColumn(out, F.sum("_weight").over(inside)).drop("_range", "_weight")
    totals = ranged.groupBy("_range").agg(F.sum("_weight").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn(out, F.sum("_weight").over(inside) + F.col("_start"))
        .drop("_range", "_weight", "_start")
    )


def contiguous_ids(
    df: DataFrame,
    order_key: str,
    out: str = "id",
    start: int = 1,
    rows_per_range: int = ROWS_PER_RANGE,
    rows_at_most: int | None = None,
) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the order of a unique numeric key."""
    one = F.lit(1).cast("bigint")
    numbered = running_total(df, order_key, one, "_number", rows_per_range, rows_at_most)
    return numbered.withColumn(out, (F.col("_number") + F.lit(start - 1)).cast("bigint")).drop(
        "_number"
    )


def sample_exact(df: DataFrame, n: int, key: str = "id", stream: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones however df is partitioned.

    The n rows with the smallest (keyed hash, key) are kept, for any n in the same way: a histogram
    of the hash finds the cutoff pair and the rows are kept by comparing with it, so that nothing
    but hashes and keys moves. Rows with a NULL key are only kept when all rows are.
    """
    draw = keyed_int(F.col(key), stream)
    if n <= 0:
        return df.where(F.lit(False))
    draws = df.select(draw.alias("_draw"), F.col(key).alias("_key")).where(F.col(key).isNotNull())
    coarse = _place_in_histogram(draws, F.shiftright("_draw", 15), n)
    if coarse is None:
        return df
    inside = draws.where(F.shiftright("_draw", 15) == coarse["_bucket"])
    fine = _place_in_histogram(inside, F.col("_draw"), coarse["_rest"])
    ties = inside.where(F.col("_draw") == fine["_bucket"])  # keys of one hash value
    cutoff = (
        ties.withColumn("_rank", F.row_number().over(Window.orderBy("_key")))
        .where(F.col("_rank") == fine["_rest"])
        .select("_draw", "_key")
        .first()
    )
    last_draw, last_key = F.lit(cutoff["_draw"]), F.lit(cutoff["_key"])
    return df.where((draw < last_draw) | ((draw == last_draw) & (F.col(key) <= last_key)))


def _place_in_histogram(draws: DataFrame, bucket: Column, n: int):
    """The bucket of row number n in bucket order, and its number inside that bucket."""
    histogram = draws.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        histogram.withColumn("_upto", F.sum("_rows").over(upto))
        .where(F.col("_upto") >= n)
        .orderBy("_bucket")
        .select("_bucket", (F.lit(n) - (F.col("_upto") - F.col("_rows"))).alias("_rest"))
        .first()
    )


def sample_prefix(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n rows of a table whose ids are 1..N: a filter, which reaches the scan."""
    return df.where(F.col(key) <= n)
