"""Make larger, changed or re-dimensioned versions of a corpus."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from ..functions.keyed import keyed_int, keyed_uniform
from ..functions.vectors import (
    gaussian_matrix,
    noisy,
    project,
    project_quantized,
    projected_ends,
    quantized,
)
from .ranking import contiguous_ids, sample_exact

NOISE_STREAM = 101
SAMPLE_STREAM = 102
ZIPF_STREAM = 103


# ---------------------------------------------------------------- dimension


def random_projection(
    df: DataFrame, matrix: np.ndarray, vector: str = "image_vec"
) -> DataFrame:
    """Vectors times a (dimension, new dimension) matrix; the matrix travels with the task."""
    return df.withColumn(vector, project(F.col(vector), matrix))


def vector_minmax(df: DataFrame, vector: str = "image_vec") -> DataFrame:
    """One row: the smallest and the largest component of all vectors."""
    return df.agg(
        F.min(F.array_min(vector)).cast("double").alias("mn"),
        F.max(F.array_max(vector)).cast("double").alias("mx"),
    )


def vector_quantize(df: DataFrame, vector: str = "image_vec") -> DataFrame:
    """Scale all components together to 0..255 and truncate; constant input becomes 0."""
    ends = vector_minmax(df, vector).first()
    if ends["mn"] is None:
        return df.withColumn(vector, F.col(vector).cast("array<int>"))
    return df.withColumn(vector, quantized(F.col(vector), ends["mn"], ends["mx"]))


def adjust_dimension(
    df: DataFrame, dimension: int, new_dimension: int, seed: int = 42, vector: str = "image_vec"
) -> DataFrame:
    """Random projection to a new dimension, then quantization to 0..255.

    The first pass returns two numbers per row, the second the small integers; the projected
    vectors themselves never leave a batch.
    """
    matrix = gaussian_matrix(dimension, new_dimension, seed)
    ends = (
        df.select(projected_ends(F.col(vector), matrix).alias("ends"))
        .agg(F.min("ends.low").alias("low"), F.max("ends.high").alias("high"))
        .first()
    )
    if ends["low"] is None:
        return df.withColumn(vector, F.col(vector).cast("array<int>"))
    return df.withColumn(
        vector, project_quantized(F.col(vector), matrix, ends["low"], ends["high"])
    )


# ---------------------------------------------------------------- noisy copies


def _noisy_rows(df: DataFrame, sigma: float, rounding: str) -> DataFrame:
    """Noise keyed by the new id, so that a recomputed copy is the same copy."""
    keyed = df.withColumn("_row", keyed_int(F.col("id"), NOISE_STREAM))
    return keyed.withColumn(
        "image_vec", noisy(F.col("image_vec"), F.col("_row"), sigma, rounding)
    ).drop("_row")


def scale_replicate(
    df: DataFrame, factor: int, rows: int, first_id: int = 0, sigma: float = 0.05,
    rounding: str = "truncate",
) -> DataFrame:
    """``factor`` noisy copies of a corpus with ids first_id..first_id+rows-1; no shuffle."""
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    renumbered = copies.withColumn("id", F.col("_copy").cast("bigint") * rows + F.col("id"))
    return _noisy_rows(renumbered.drop("_copy"), sigma, rounding)


def scale_remainder(
    df: DataFrame, rows_wanted: int, start_id: int, sigma: float = 0.05, rounding: str = "truncate"
) -> DataFrame:
    """Exactly ``rows_wanted`` drawn rows as noisy copies with ids from ``start_id``."""
    return _renumbered_sample(df, rows_wanted, start_id, sigma, rounding)


def _renumbered_sample(df, rows_wanted, start_id, sigma, rounding) -> DataFrame:
    drawn = sample_exact(df, rows_wanted, "id", SAMPLE_STREAM)
    numbered = contiguous_ids(
        drawn, "id", out="_new", start=start_id, rows_at_most=rows_wanted
    )
    return _noisy_rows(
        numbered.withColumn("id", F.col("_new")).drop("_new"), sigma, rounding
    )


def adjust_scale(
    df: DataFrame, target: int, sigma: float = 0.05, rounding: str = "truncate"
) -> DataFrame:
    """A corpus of exactly ``target`` rows from one with contiguous ids: copies and a remainder."""
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first")).first()
    rows, first = facts["rows"], facts["first"]
    if rows == 0:
        raise ValueError("cannot scale an empty corpus")
    factor, rest = divmod(target, rows)
    parts = []
    if factor:
        parts.append(scale_replicate(df, factor, rows, first, sigma, rounding))
    if rest:
        parts.append(scale_remainder(df, rest, first + factor * rows, sigma, rounding))
    if not parts:
        return df.where(F.lit(False))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def incremental_generate(
    df: DataFrame, ratio: float, sigma: float = 0.05, rounding: str = "truncate"
) -> DataFrame:
    """``int(rows * ratio)`` drawn rows, in order, as noisy new rows after the largest id."""
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("last")).first()
    wanted = int(facts["rows"] * ratio)
    return _renumbered_sample(df, wanted, (facts["last"] or 0) + 1, sigma, rounding)


# ---------------------------------------------------------------- skewed attribute


def zipf_cumulative(values: int = 500, exponent: float = 1.2) -> np.ndarray:
    weights = np.arange(1, values + 1, dtype=np.float64) ** -exponent
    return np.cumsum(weights / weights.sum())


def zipf_scalar(
    df: DataFrame, out: str, key: str = "id", values: int = 500, exponent: float = 1.2,
    stream: int = ZIPF_STREAM,
) -> DataFrame:
    """Add a value 1..values with weight value**-exponent, by inverting the distribution.

    The binary search over the cumulative weights runs per row; nothing is shuffled.
    """
    splits = [0.0, *zipf_cumulative(values, exponent)[:-1].tolist(), float("inf")]
    drawn = df.withColumn("_draw", keyed_uniform(F.col(key), stream))
    located = Bucketizer(splits=splits, inputCol="_draw", outputCol="_bucket").transform(drawn)
    return located.withColumn(out, F.col("_bucket").cast("int") + 1).drop("_draw", "_bucket")
