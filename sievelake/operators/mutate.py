"""Insert, update, upsert and delete as rewrites of an immutable table.

The change set's keys are what a join may broadcast; Spark decides by their size, nothing is
hinted. The base table keeps its partitioning whenever the change set is small.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keyed import keyed_int
from ..functions.vectors import bumped

BUMP_STREAM = 301


def insert_append(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows)


def latest(changes: DataFrame, sequence: str, key: str = "id") -> DataFrame:
    """One row per key, the one with the highest sequence number.

    ``max_by`` is reduced before the shuffle, so a key with very many changes stays cheap.
    """
    columns = [c for c in changes.columns if c not in (key, sequence)]
    newest = F.max_by(F.struct(*columns), F.col(sequence)).alias("_row")
    return changes.groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}") for c in columns])


def single(changes: DataFrame, key: str = "id") -> DataFrame:
    """The changes as they are; a key that occurs twice is an error when they are read."""
    columns = [c for c in changes.columns if c != key]
    message = F.concat(F.lit(f"two changes with one {key}, but no sequence: "), F.col(key).cast("string"))
    only = F.when(F.count(F.lit(1)) > 1, F.raise_error(message)).otherwise(F.first(F.struct(*columns)))
    return changes.groupBy(key).agg(only.alias("_row")).select(key, *[F.col(f"_row.{c}") for c in columns])


def _one_per_key(changes: DataFrame, columns: Sequence[str], key: str, sequence: str | None) -> DataFrame:
    wanted = [c for c in columns if c != key]
    if sequence:
        ordered = changes.select(key, F.col(sequence).alias("_sequence"), *wanted)
        return latest(ordered, "_sequence", key)
    return single(changes.select(key, *wanted), key) if wanted else changes.select(key).distinct()


def upsert_full(
    base: DataFrame, changes: DataFrame, key: str = "id", sequence: str | None = None
) -> DataFrame:
    """Replace whole rows by key and add new ones.

    With ``sequence`` the last duplicate wins; without it a duplicate key is an error.
    """
    changes = _one_per_key(changes, base.columns, key, sequence)
    kept = base.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes.select(*base.columns))


def upsert_partial(
    base: DataFrame,
    changes: DataFrame,
    columns: Sequence[str],
    key: str = "id",
    sequence: str | None = None,
) -> DataFrame:
    """Overwrite some columns by key; a new key gets NULL in the others.

    A left join and the unmatched changes instead of a full outer join, which could not broadcast.
    Duplicate keys are handled as in ``upsert_full``.
    """
    changes = _one_per_key(changes, columns, key, sequence)
    new = changes.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    merged = base.join(new, key, "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in base.columns
        ]
    )
    added = changes.join(base.select(key), key, "left_anti").select(
        *[
            F.col(c) if c == key or c in columns else F.lit(None).cast(base.schema[c].dataType).alias(c)
            for c in base.columns
        ]
    )
    return merged.unionByName(added)


def overwrite_field(
    base: DataFrame, changes: DataFrame, field: str, key: str = "id", sequence: str | None = None
) -> DataFrame:
    """Set one field where the key has a change; unknown keys are ignored.

    Duplicate keys are handled as in ``upsert_full``.
    """
    changes = _one_per_key(changes, [field], key, sequence)
    new = changes.select(key, F.lit(True).alias("_hit"), F.col(field).alias("_new"))
    return (
        base.join(new, key, "left")
        .withColumn(field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field)))
        .select(*base.columns)
    )


def update_where_in(
    base: DataFrame, ids: DataFrame, column: str, change: Column, key: str = "id"
) -> DataFrame:
    """Apply an expression to one column of the rows whose key is listed."""
    flags = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        base.join(flags, key, "left")
        .withColumn(column, F.when(F.col("_hit"), change).otherwise(F.col(column)))
        .select(*base.columns)
    )


def delete_by_ids(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def delete_by_range(base: DataFrame, first: int, last: int, key: str = "id") -> DataFrame:
    """Delete an inclusive key range: a filter, which reaches the scan."""
    return base.where((F.col(key) < first) | (F.col(key) > last))


# ---------------------------------------------------------------- generated changes


def saturating_delta(column: Column, delta: int, low: int = 0, high: int = 65535) -> Column:
    """Add and clip; the sum is taken wider than the column so that it cannot wrap."""
    moved = F.greatest(F.least(column.cast("bigint") + delta, F.lit(high)), F.lit(low))
    return moved.cast("int")


def bumped_vector(vector: Column, key: Column, stream: int = BUMP_STREAM) -> Column:
    """Change one component, drawn by key: one up, or one down where it is already 255."""
    return bumped(vector, keyed_int(key, stream))


def generate_updates(rows: DataFrame, delta: int = 1) -> DataFrame:
    """The given rows with their attribute moved by delta and one vector component changed."""
    return rows.withColumn("eq_val", saturating_delta(F.col("eq_val"), delta)).withColumn(
        "image_vec", bumped_vector(F.col("image_vec"), F.col("id"))
    )
