"""What a cell holds, small enough to decide which cells a filter makes worth reading.

A summary counts rows: per value of a field, per element of an array field, and per interval of a
numeric field whose edges all cells share. Summaries of disjoint rows are merged by adding them up.
From them follows the share of a cell's rows that a filter list passes: exact for equality and
containment on one field, interpolated for comparisons, and combined as if independent otherwise. A
share of 0 is certain, so such a cell is never read.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial, reduce
from typing import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import COMPARISONS, combine, equality_values, holds_at, logic_of, numeric_field, typed_key

SUMMARY_SCHEMA = "cell int, field string, kind string, key string, rows bigint"
ALL = ""


def quantile_edges(df: DataFrame, fields: Sequence[str], buckets: int = 64) -> dict[str, list[float]]:
    """Interval edges of about equally many rows each, for the numeric fields."""
    shares = [i / buckets for i in range(buckets + 1)]
    finite = [F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")) for f in fields]
    found = df.agg(*[F.percentile_approx(c, shares, 100 * buckets).alias(f) for f, c in zip(fields, finite)]).first()
    return {f: sorted(set(found[f] or [])) for f in fields}


def _interval(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges that a value is not below, 0 to len(edges)."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def summarize(
    assigned: DataFrame, counted: Sequence[str] = (), edges: Mapping[str, Sequence[float]] | None = None
) -> DataFrame:
    """(cell, field, kind, key, rows) of assigned rows.

    ``counted`` fields are counted by value, or by distinct element; NULL is not counted. ``edges`` are
    those of the numeric fields. One row per cell, with an empty field, counts all its rows. Every row is
    exploded into one short entry per field and element, which the aggregation reduces before its shuffle.
    """

    def entry(field: str, kind: str, key: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), key.cast("string").alias("key"))

    lists = [F.array(entry(ALL, "all", F.lit(ALL)))]
    for field in counted:
        if isinstance(assigned.schema[field].dataType, T.ArrayType):
            elements = F.array_compact(F.array_distinct(F.coalesce(field, F.array())))
            lists.append(F.transform(elements, partial(entry, field, "value")))
        else:
            lists.append(F.array(entry(field, "value", F.col(field))))
    for field, at in (edges or {}).items():
        value = F.col(field).cast("double")
        known = F.when(value.isNotNull() & ~F.isnan(value), _interval(value, at))
        lists.append(F.array(entry(field, "interval", known)))
    spread = assigned.select("cell", F.explode(F.concat(*lists)).alias("e")).where(F.col("e.key").isNotNull())
    return spread.groupBy(F.col("cell").cast("int").alias("cell"), "e.field", "e.kind", "e.key").agg(
        F.count(F.lit(1)).alias("rows")
    )


def merged(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("cell", "field", "kind", "key").agg(F.sum("rows").alias("rows"))


class Share:
    """The share of each cell's rows that a filter passes; ``&`` and ``|`` as if independent."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __and__(self, other: "Share") -> "Share":
        return Share(self.values * other.values)

    def __or__(self, other: "Share") -> "Share":
        return Share(1.0 - (1.0 - self.values) * (1.0 - other.values))


class Expected:
    """Expected matches per cell for the filter lists of one query block.

    Only the entries that the block's constants ask for are read: per cell, one for each constant and
    one for each interval of a field.
    """

    def __init__(
        self,
        summaries: DataFrame,
        schema: T.StructType,
        cells: Sequence[int],
        filter_lists: Sequence[Sequence[Mapping]],
        edges: Mapping[str, Sequence[float]],
        mode: str = "fold",
    ):
        self.schema, self.edges, self.mode = schema, edges, mode
        self.place = {int(cell): i for i, cell in enumerate(cells)}
        self.counted: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.zeros(len(self.place)))
        self.fields = {r["field"] for r in summaries.select("field").where("kind = 'value'").distinct().collect()}
        asked = {(f["field"], self.key(f)) for filters in filter_lists for f in filters or () if self.key(f)}
        fields = {f["field"] for filters in filter_lists for f in filters or ()} & set(edges)
        tests = [F.col("kind") == "all"]
        if fields:
            tests.append((F.col("kind") == "interval") & F.col("field").isin(sorted(fields)))
        by_field = defaultdict(set)
        for field, key in asked:
            by_field[field].add(key)
        for field, keys in by_field.items():
            tests.append((F.col("kind") == "value") & (F.col("field") == field) & F.col("key").isin(sorted(keys)))
        wanted = summaries.where(reduce(lambda a, b: a | b, tests))
        for r in merged(wanted).collect():
            if r["cell"] in self.place:
                self.counted[(f"{r['kind']}:{r['field']}", r["key"])][self.place[r["cell"]]] = r["rows"]
        self.rows = self.counted[("all:", ALL)]

    def element(self, field: str) -> T.DataType:
        kind = self.schema[field].dataType
        return kind.elementType if isinstance(kind, T.ArrayType) else kind

    def key(self, spec: Mapping) -> str | None:
        """The entry that counts the rows of an equality or containment filter."""
        field, operator = spec["field"], spec["operator"]
        if field not in self.schema.fieldNames() or field not in self.fields:
            return None
        array = isinstance(self.schema[field].dataType, T.ArrayType)
        if operator != ("contains" if array else "=="):
            return None
        element = self.element(field)
        if isinstance(element, T.FractionalType):
            return None  # the text of a fraction is not its value
        value = typed_key(spec["value"], element)
        return None if value is None else str(value)

    def _share(self, matches: np.ndarray) -> Share:
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(self.rows > 0, matches / self.rows, 0.0)
        return Share(np.clip(share, 0.0, 1.0))

    def _compared(self, field: str, filters: Sequence[Mapping]) -> Share:
        """Rows evenly spread inside each interval; half of an open interval for each side of a cut."""
        edges = list(self.edges[field])
        constants = sorted({float(f["value"]) for f in filters})
        places = {value: 2 * i + 1 for i, value in enumerate(constants)}
        total = np.zeros(len(self.place))
        ends = [-np.inf, *edges, np.inf]
        for number, (low, high) in enumerate(zip(ends, ends[1:])):
            inside = [c for c in constants if low <= c <= high]
            cuts = [low, *inside, high]
            share = 0.0
            for a, b in zip(cuts, cuts[1:]):
                if holds_at(filters, 2 * sum(c <= a for c in constants), places, self.mode):
                    finite = np.isfinite(low) and np.isfinite(high) and high > low
                    share += (b - a) / (high - low) if finite else 1.0 / (len(cuts) - 1)
            if any(holds_at(filters, places[c], places, self.mode) for c in inside):
                share = max(share, 1e-6)  # a single value may hold
            total += share * self.counted[(f"interval:{field}", str(number))]
        return self._share(total)

    def _one(self, spec: Mapping) -> Share:
        key = self.key(spec)
        if key is not None:
            return self._share(self.counted[(f"value:{spec['field']}", key)].copy())
        if spec["field"] in self.edges and spec["operator"] in COMPARISONS:
            return self._compared(spec["field"], [spec])
        return Share(np.ones(len(self.place)))  # nothing known: cannot rule a cell out

    def matches(self, filters: Sequence[Mapping] | None) -> np.ndarray:
        """The expected matches of one filter list in every cell."""
        filters = list(filters or ())
        if not filters:
            return self.rows.copy()
        equal = equality_values(filters, self.mode)
        if equal and all(self.key(f) is not None for f in filters):
            keys = {self.key(f) for f in filters}
            return sum(self.counted[(f"value:{equal[0]}", key)] for key in keys).copy()
        key = self.key(filters[0])
        if len(filters) == 1 and key is not None:
            return self.counted[(f"value:{filters[0]['field']}", key)].copy()
        field = numeric_field(filters)
        if field in self.edges:
            return self.rows * self._compared(field, filters).values
        shares = [self._one(f) for f in filters]
        return self.rows * combine(shares, [logic_of(f) for f in filters], self.mode).values
