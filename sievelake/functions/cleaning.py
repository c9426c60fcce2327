"""Typed projection and cleaning of raw columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict(column: Column, data_type: str) -> Column:
    """A cast that fails on overflow or bad text (ANSI mode, the default in Spark 4)."""
    return column.cast(data_type)


def number_or_zero(column: Column, data_type: str) -> Column:
    """Text to number; what does not parse, and NULL, becomes zero."""
    return F.coalesce(column.try_cast(data_type), F.lit(0).cast(data_type))


def datetime_or_null(column: Column, pattern: str | None = None) -> Column:
    return (
        F.try_to_timestamp(column)
        if pattern is None
        else F.try_to_timestamp(column, F.lit(pattern))
    )


def date_key(column: Column) -> Column:
    """A date as the integer yyyymmdd; NULL becomes 0."""
    return F.coalesce(F.date_format(column, "yyyyMMdd").cast("int"), F.lit(0))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def array_from_text(column: Column) -> Column:
    """``["a","b"]`` to array<string>; what does not parse becomes NULL."""
    return F.from_json(column, "array<string>")


def array_literal(column: Column) -> Column:
    """array to the text ``{"a","b"}``."""
    quoted = F.transform(column, lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def array_of_text(column: Column) -> Column:
    """Elements as text; NULL becomes the empty array."""
    return F.coalesce(column.cast("array<string>"), F.array().cast("array<string>"))


def widen_vector(column: Column) -> Column:
    """Small-integer components as float."""
    return column.cast("array<float>")
