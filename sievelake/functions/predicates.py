"""Scalar filters of a query, compiled to one Catalyst predicate.

A filter is ``{field, operator, value, logic}``. Several filters combine in one of three ways:

* ``fold``        left to right without precedence; the first ``logic`` is ignored (default)
* ``sql``         AND binds tighter than OR, as when the conditions are written in a row in SQL
* ``must_should`` every "and" condition holds and, if there are "or" conditions, one of them does
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_
from typing import Mapping, Sequence

from pyspark.sql import Column, functions as F, types as T

COMPARISONS = {
    "==": lambda column, value: column == value,
    "<": lambda column, value: column < value,
    "<=": lambda column, value: column <= value,
    ">": lambda column, value: column > value,
    ">=": lambda column, value: column >= value,
}
EMPTY_VALUES = (None, "nan", "[]")
MODES = ("fold", "sql", "must_should")
INTEGER_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def typed_literal(value, data_type: T.DataType) -> Column:
    """The filter value as a constant of the field's type.

    Numeric text that an integer type cannot hold (``"3.5"``, also ``"3.0"`` after a rewrite) is
    compared in double, so that ``label < 3.5`` keeps its meaning.
    """
    if isinstance(data_type, T.IntegralType):
        number = float(value)
        if number == int(number):
            exact = int(value) if str(value).lstrip("+-").isdigit() else int(number)
            return F.lit(exact).cast("bigint")
        return F.lit(number)
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.lit(float(value))
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_timestamp(F.lit(str(value)))
    return F.lit(value).cast(data_type)


def typed_key(value, data_type: T.DataType):
    """A filter value as a lookup key of the field's type; None when no row can equal it."""
    if isinstance(data_type, T.IntegralType):
        number = float(value)
        if not math.isfinite(number) or number != int(number):
            return None
        exact = int(value) if str(value).lstrip("+-").isdigit() else int(number)
        limit = 1 << (INTEGER_BITS[data_type.typeName()] - 1)
        return exact if -limit <= exact < limit else None
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float(value)
    return str(value)


def condition(
    schema: T.StructType,
    spec: Mapping,
    like: str = "regex",
    empty_value_means_empty: bool = False,
) -> Column:
    """One filter as a non-NULL boolean column."""
    field, operator, value = spec["field"], spec["operator"], spec.get("value")
    if field not in schema.fieldNames():
        raise ValueError(f"unknown field {field!r}")
    data_type = schema[field].dataType
    column = F.col(field)
    if operator == "is_empty" or (empty_value_means_empty and value in EMPTY_VALUES):
        return is_empty(column, data_type)
    if operator in COMPARISONS:
        if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("timestamp")
        found = COMPARISONS[operator](column, typed_literal(value, data_type))
        if operator in (">", ">=") and isinstance(data_type, (T.FloatType, T.DoubleType)):
            found = found & ~F.isnan(column)  # Spark orders NaN above every number
    elif operator == "like":
        text = column.cast("string")
        found = text.rlike(str(value)) if like == "regex" else text.contains(str(value))
    elif operator == "contains":
        if isinstance(data_type, T.ArrayType):
            element = typed_key(value, data_type.elementType)
            found = F.lit(False)
            if element is not None:
                found = F.array_contains(column, F.lit(element).cast(data_type.elementType))
        elif isinstance(data_type, T.StringType):
            found = column.contains(str(value))
        else:
            found = F.lit(False)
    else:
        raise ValueError(f"unsupported operator {operator!r}")
    return F.coalesce(found, F.lit(False))


def is_empty(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull()


def logic_of(spec: Mapping) -> str:
    return str(spec.get("logic") or "and").lower()


def combine(conditions: Sequence, logics: Sequence[str], mode: str = "fold"):
    """Columns to one Column, or plain booleans to one boolean."""
    if mode not in MODES:
        raise ValueError(f"unknown combine mode {mode!r}; known: {', '.join(MODES)}")
    if not conditions:
        return F.lit(True)
    if mode == "fold":
        result = conditions[0]
        for nxt, logic in zip(conditions[1:], logics[1:]):
            if logic == "and":
                result = result & nxt
            elif logic == "or":
                result = result | nxt
        return result
    if mode == "sql":
        runs = [[conditions[0]]]
        for nxt, logic in zip(conditions[1:], logics[1:]):
            if logic == "or":
                runs.append([nxt])
            else:
                runs[-1].append(nxt)
        return reduce(or_, [reduce(and_, run) for run in runs])
    must = [c for c, logic in zip(conditions, logics) if logic != "or"]
    should = [c for c, logic in zip(conditions, logics) if logic == "or"]
    parts = ([reduce(and_, must)] if must else []) + ([reduce(or_, should)] if should else [])
    return reduce(and_, parts)


def compile_filters(
    schema: T.StructType,
    filters: Sequence[Mapping] | None,
    mode: str = "fold",
    like: str = "regex",
    empty_value_means_empty: bool = False,
) -> Column:
    """The whole filter list as one predicate; an empty list passes every row."""
    filters = list(filters or [])
    conditions = [condition(schema, f, like, empty_value_means_empty) for f in filters]
    return combine(conditions, [logic_of(f) for f in filters], mode)


def equality_values(filters: Sequence[Mapping], mode: str = "fold"):
    """``(field, values)`` when the list means ``field IN (values)``, else None.

    Such queries need no predicate per row: a lookup of the row's value finds them all.
    """
    filters = list(filters or [])
    if not filters or any(f["operator"] != "==" for f in filters):
        return None
    if len({f["field"] for f in filters}) != 1:
        return None
    tail = filters if mode == "must_should" else filters[1:]
    if len(filters) > 1 and any(logic_of(f) != "or" for f in tail):
        return None
    return filters[0]["field"], [f["value"] for f in filters]


def numeric_field(filters: Sequence[Mapping]) -> str | None:
    """The field of a filter list that only compares one field with numbers."""
    filters = list(filters or [])
    if not filters or any(f["operator"] not in COMPARISONS for f in filters):
        return None
    if len({f["field"] for f in filters}) != 1:
        return None
    return filters[0]["field"]


def holds_at(filters: Sequence[Mapping], place: int, places: Mapping[float, int], mode: str) -> bool:
    """Whether a one-field filter list holds at a place on the line.

    The distinct constants of a query block cut the line: constant number i is place 2i + 1, the
    open interval above it is place 2i + 2, the one below all constants is place 0.
    """
    truths = [COMPARISONS[f["operator"]](place, places[float(f["value"])]) for f in filters]
    return combine(truths, [logic_of(f) for f in filters], mode)
