"""Which queries of a block may a row answer?

``with_hits`` gives every row a set of query positions, kept as bits in one short array<bigint>
column. Queries whose filters have the same form (the same fields and operators, other
constants) are handled together, term by term: a term gives the positions whose constant the row
satisfies, AND and OR of terms are bitwise operations. A term is found by

* equality    a broadcast table from constant to positions,
* comparison  a binary search over the sorted constants and a broadcast table of what holds there,
* containment a constant map from element to positions,
* anything else a predicate per distinct filter.

So the plan grows with the number of forms and not with the number of queries, every table is
bounded by the query block. Words are elements of one column per term and are combined by
``zip_with``: separate columns would double the optimizer's constraint sets one by one, and spelled
out word by word the generated code would outgrow what the JVM compiles.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import (
    EMPTY_VALUES,
    combine,
    compile_filters,
    equality_values,
    holds_at,
    logic_of,
    numeric_field,
    typed_key,
)
from ..session import local_table

LOOKUP_TYPES = (T.IntegralType, T.FloatType, T.DoubleType, T.StringType)
SEGMENT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
HITS = "_hits"
WORDS = T.ArrayType(T.LongType(), False)
WORD = 64
DENSE_KEYS = 4096


# ---------------------------------------------------------------- positions as bits


def words_for(queries: int) -> int:
    return max(1, -(-queries // WORD))


def as_words(positions: Sequence[int], words: int) -> list[int]:
    """Positions as signed 64-bit integers."""
    bits = [0] * words
    for position in positions:
        bits[position // WORD] |= 1 << (position % WORD)
    return [b - (1 << WORD) if b >= 1 << (WORD - 1) else b for b in bits]


def words_literal(positions: Sequence[int], words: int) -> str:
    """The words as SQL text; one parsed constant instead of a column per element."""
    lowest = -(1 << 63)  # has no literal of its own
    values = (
        f"{word}L" if word > lowest else f"{lowest + 1}L - 1L"
        for word in as_words(positions, words)
    )
    return f"array({', '.join(values)})"


def _either(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.bitwiseOR(b))


class Positions:
    """A set of query positions as an array of words; ``&`` and ``|`` are set operations."""

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: "Positions") -> "Positions":
        both = F.zip_with(self.column, other.column, lambda a, b: a.bitwiseAND(b))
        return Positions(both)

    def __or__(self, other: "Positions") -> "Positions":
        return Positions(_either(self.column, other.column))

    @staticmethod
    def constant(positions: Sequence[int], words: int) -> "Positions":
        return Positions(F.expr(words_literal(positions, words)))

    @staticmethod
    def of_column(name: str, words: int) -> "Positions":
        """An array column of words; NULL is the empty set."""
        return Positions(F.coalesce(F.col(name), Positions.constant([], words).column))


def any_position(name: str) -> Column:
    """Whether an array of words has any bit set."""
    return (F.array_max(name) != 0) | (F.array_min(name) != 0)


def has_position(name: str, position: Column) -> Column:
    """Whether the bit of a position, itself a column, is set."""
    word = F.get(F.col(name), F.floor(position / WORD).cast("int"))
    return F.getbit(word, position % WORD) == 1


def _type_of(rows: DataFrame, name: str) -> T.DataType:
    if name not in rows.columns:
        raise ValueError(f"unknown field {name!r}")
    return rows.schema[name].dataType


def _arrays(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(name, WORDS) for name in names]


# ---------------------------------------------------------------- the three kinds of table


def with_lookup(
    rows: DataFrame, column: str, outs: Mapping[str, Mapping], queries: int, required: bool = False
) -> DataFrame:
    """Add a column per entry of ``outs``: the positions listed for the row's value, as words.

    ``required`` drops rows whose value nobody asks for, which the scan can already skip.
    """
    words = words_for(queries)
    values = sorted({value for positions in outs.values() for value in positions})
    table = local_table(
        rows.sparkSession,
        [
            (v, *[as_words(listed.get(v, ()), words) for listed in outs.values()])
            for v in values
        ],
        T.StructType(
            [T.StructField("_value", rows.schema[column].dataType)]
            + _arrays(outs)
        ),
    )
    if required:
        rows = rows.where(F.col(column).isin(values))
    how = "inner" if required else "left"
    return rows.join(F.broadcast(table), F.col(column) == F.col("_value"), how).drop("_value")


def with_segments(
    rows: DataFrame,
    column: str,
    outs: Mapping[str, Sequence[tuple[int, Sequence[Mapping]]]],
    queries: int,
    mode: str,
    required: bool = False,
) -> DataFrame:
    """Add a column per entry of ``outs``, a list of (position, filters on the column).

    The m distinct constants cut the line into m points and m + 1 intervals, on each of which
    every filter is constant.
    """
    words = words_for(queries)
    constants = sorted(
        {float(f["value"]) for members in outs.values() for _, filters in members for f in filters}
    )
    places = {value: 2 * i + 1 for i, value in enumerate(constants)}

    def holding(place: int) -> list[list[int]]:
        return [
            as_words([p for p, f in members if holds_at(f, place, places, mode)], words)
            for members in outs.values()
        ]

    on_point = [f"_on{name}" for name in outs]
    table = [(0, None, *holding(0), *([[0] * words] * len(outs)))]
    for i, constant in enumerate(constants):
        table.append((i + 1, constant, *holding(2 * i + 2), *holding(2 * i + 1)))
    segments = local_table(
        rows.sparkSession,
        table,
        T.StructType(
            [T.StructField("_segment", T.IntegerType()), T.StructField("_constant", T.DoubleType())]
            + _arrays([*outs, *on_point])
        ),
    )
    if required and not any(map(any, holding(0))):
        rows = rows.where(F.col(column) >= constants[0])
    if required and not any(map(any, holding(2 * len(constants)))):
        rows = rows.where(F.col(column) <= constants[-1])
    value = F.col(column).cast("double")
    ends = (float("-inf"), float("inf"))
    splits = [ends[0], *[c for c in constants if c not in ends], ends[1]]
    located = Bucketizer(
        splits=splits, inputCol="_place", outputCol="_bucket", handleInvalid="keep"
    ).transform(rows.withColumn("_place", F.when(~F.isnan(value), value)))
    segment = F.col("_bucket").cast("int")
    if ends[0] in constants:  # nothing lies below it
        segment = segment + 1
    if ends[1] in constants:
        segment = segment + (F.col("_place") == ends[1]).cast("int")
    joined = located.join(F.broadcast(segments), segment == F.col("_segment"), "left")
    exact = F.col("_place") == F.col("_constant")
    chosen = {
        name: F.when(exact, F.col(on)).otherwise(F.col(name)) for name, on in zip(outs, on_point)
    }
    return joined.withColumns(chosen).drop("_place", "_bucket", "_segment", "_constant", *on_point)


def contained(
    column: str, data_type: T.ArrayType, positions: Mapping, words: int
) -> Column:
    """The words of the positions listed for any element of an array column."""
    none = Positions.constant([], words).column
    dense = isinstance(data_type.elementType, T.IntegralType) and all(
        0 <= key < DENSE_KEYS for key in positions
    )
    keys = range(max(positions) + 1) if dense else list(positions)
    listed = ", ".join(words_literal(positions.get(key, ()), words) for key in keys)
    table = F.expr(f"array({listed})")
    if dense:  # small keys are places in the table
        return F.aggregate(
            F.col(column),
            none,
            lambda bits, key: _either(
                bits, F.coalesce(F.when(key >= 0, F.get(table, key.cast("int"))), none)
            ),
        )
    key_array = key_literal(data_type, positions)
    by_key = F.map_from_arrays(key_array, table)
    return F.aggregate(
        F.array_intersect(F.col(column), key_array),
        none,
        lambda bits, key: _either(bits, F.coalesce(F.element_at(by_key, key), none)),
    )


def key_literal(data_type: T.ArrayType, positions: Mapping) -> Column:
    return F.array(*[F.lit(key).cast(data_type.elementType) for key in positions])


# ---------------------------------------------------------------- terms


@dataclass
class Terms:
    """Everything that has to be added to the rows, by the kind of table that gives it."""

    rows: DataFrame
    queries: int
    mode: str
    like: str
    lookups: dict = field(default_factory=lambda: defaultdict(dict))
    segments: dict = field(default_factory=lambda: defaultdict(dict))
    columns: dict = field(default_factory=dict)
    overlaps: list = field(default_factory=list)
    count: int = 0

    def kind(self, filters: Sequence[Mapping]) -> str:
        """How the positions of a filter list can be found."""
        if not filters:
            return "all"
        simple = equality_values(filters, self.mode)
        if simple and isinstance(_type_of(self.rows, simple[0]), LOOKUP_TYPES):
            return "equal"
        name = numeric_field(filters)
        if name and isinstance(_type_of(self.rows, name), SEGMENT_TYPES):
            return "compare"
        if len(filters) > 1:
            return "several"
        one = filters[0]
        data_type = _type_of(self.rows, one["field"])
        if one["operator"] == "contains" and isinstance(data_type, T.ArrayType):
            return "contain"
        return "predicate"

    def add(self, kind: str, members: Sequence[tuple[int, Sequence[Mapping]]]) -> Positions:
        """The positions of one kind of filter, on one field, as columns to be computed."""
        words = words_for(self.queries)
        if kind == "all":
            return Positions.constant([p for p, _ in members], words)
        name = f"_term{self.count}"
        self.count += 1
        target = members[0][1][0]["field"]
        data_type = _type_of(self.rows, target)
        if kind == "compare":
            self.segments[target][name] = members
        elif kind in ("equal", "contain"):
            element = data_type.elementType if kind == "contain" else data_type
            positions = defaultdict(list)
            for position, filters in members:
                for f in filters:
                    key = typed_key(f["value"], element)
                    if key is not None:
                        positions[key].append(position)
            if not positions:
                return Positions.constant([], words)
            if kind == "equal":
                self.lookups[target][name] = positions
            else:
                self.columns[name] = contained(target, data_type, positions, words)
                self.overlaps.append(
                    F.arrays_overlap(F.col(target), key_literal(data_type, positions))
                )
        else:
            self.columns[name] = self._predicates(members, words)
        return Positions.of_column(name, words)

    def _predicates(self, members, words: int) -> Column:
        same = defaultdict(list)
        for position, filters in members:
            key = tuple(tuple(sorted(f.items(), key=str)) for f in filters)
            same[key].append((position, filters))
        none = Positions.constant([], words).column
        found = [
            F.when(
                compile_filters(self.rows.schema, group[0][1], self.mode, self.like),
                Positions.constant([p for p, _ in group], words).column,
            )
            for group in same.values()
        ]
        return F.aggregate(F.array_compact(F.array(*found)), none, _either)

    def applied(self, required: bool) -> DataFrame:
        """Computed columns come before the joins, so that a later filter cannot repeat them."""
        rows = self.rows
        for test in self.overlaps if required else ():
            rows = rows.where(test)
        if self.columns:
            rows = rows.withColumns(self.columns)
        for target, outs in self.lookups.items():
            rows = with_lookup(rows, target, outs, self.queries, required)
        for target, outs in self.segments.items():
            rows = with_segments(rows, target, outs, self.queries, self.mode, required)
        return rows


def with_hits(
    rows: DataFrame,
    filter_lists: Sequence[Sequence[Mapping]],
    mode: str = "fold",
    like: str = "regex",
    keep_all: bool = False,
    empty_value_means_empty: bool = False,
) -> DataFrame:
    """Add the column ``HITS``: the positions of the filter lists the row passes, as words.

    Rows that pass none are dropped unless ``keep_all``. With ``empty_value_means_empty`` a filter whose value
    is empty asks for rows whose field is, whatever its operator.
    """
    if empty_value_means_empty:
        filter_lists = [
            [{**f, "operator": "is_empty"} if f.get("value") in EMPTY_VALUES else f for f in filters or ()]
            for filters in filter_lists
        ]
    queries = len(filter_lists)
    terms = Terms(rows, queries, mode, like)
    forms: dict[tuple, list] = defaultdict(list)
    for position, filters in enumerate(filter_lists):
        filters = list(filters or ())
        kind = terms.kind(filters)
        if kind == "several":
            parts = tuple((f["field"], terms.kind([f]), logic_of(f)) for f in filters)
            forms[("several", parts)].append((position, filters))
        else:
            forms[(kind, filters[0]["field"] if filters else None)].append((position, filters))
    found: list[Positions] = []
    for (kind, parts), members in forms.items():
        if kind != "several":
            found.append(terms.add(kind, members))
            continue
        each = [
            terms.add(part_kind, [(position, [filters[i]]) for position, filters in members])
            for i, (_, part_kind, _) in enumerate(parts)
        ]
        found.append(combine(each, [logic for _, _, logic in parts], mode))
    kind = next(iter(forms))[0] if len(forms) == 1 and not keep_all else None
    tables = len(terms.lookups) + len(terms.segments) + len(terms.overlaps)
    required = kind in ("equal", "compare", "contain") and tables == 1
    hits = reduce(or_, found) if found else Positions.constant([], words_for(queries))
    rows = terms.applied(required).withColumn(HITS, hits.column)
    rows = rows.drop(*[f"_term{i}" for i in range(terms.count)])
    if keep_all or (required and kind != "compare"):
        return rows
    return rows.where(any_position(HITS))
