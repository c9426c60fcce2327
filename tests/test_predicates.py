"""Filters: operators, combine modes, NULL and NaN, and query hits against plain predicates."""

import math
import random

import pytest
from pyspark.sql import Row, functions as F, types as T

from sievelake.functions.predicates import MODES, compile_filters, condition
from sievelake.operators.hits import HITS, has_position, with_hits, words_for

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("big", T.LongType()),
        T.StructField("tags", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)


def f(field, operator, value=None, logic="and"):
    return {"field": field, "operator": operator, "value": value, "logic": logic}


def make_rows(n=300, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        price = rng.choice([None, float("nan"), float(rng.randrange(20)), rng.random() * 20])
        tags = rng.choice([None, [], [rng.randrange(6) for _ in range(rng.randrange(1, 5))]])
        words = rng.choice([None, [], [rng.choice("abc") for _ in range(2)]])
        text = rng.choice([None, "", "alpha beta", "beta 12-34", "a.b"])
        rows.append(
            Row(
                id=i, label=rng.choice([None, *range(5)]), price=price, big=2**53 + i, tags=tags,
                words=words, text=text,
            )
        )
    return rows


def truth(row, spec):
    """One condition in plain Python: NULL and NaN satisfy nothing but is_empty."""
    value, wanted, op = row[spec["field"]], spec["value"], spec["operator"]
    if op == "is_empty":
        return value is None or value == []
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return False
    if op == "contains":
        return str(wanted) in [str(x) for x in value] if isinstance(value, list) else str(wanted) in value
    if op == "like":
        import re

        return re.search(str(wanted), str(value)) is not None
    wanted = float(wanted)
    return {
        "==": value == wanted, "<": value < wanted, "<=": value <= wanted,
        ">": value > wanted, ">=": value >= wanted,
    }[op]


def holds(row, filters, mode):
    if not filters:
        return True
    truths = [truth(row, spec) for spec in filters]
    logics = [spec["logic"] for spec in filters]
    if mode == "fold":
        result = truths[0]
        for t, logic in zip(truths[1:], logics[1:]):
            result = (result and t) if logic == "and" else (result or t)
        return result
    if mode == "sql":
        text = str(truths[0]) + "".join(f" {lo} {t}" for t, lo in zip(truths[1:], logics[1:]))
        return eval(text)
    must = [t for t, logic in zip(truths, logics) if logic == "and"]
    should = [t for t, logic in zip(truths, logics) if logic == "or"]
    return all(must) and (any(should) if should else True)


def random_filters(rng):
    def one():
        kind = rng.randrange(7)
        logic = rng.choice(["and", "or"])
        if kind == 0:
            return f("label", "==", str(rng.randrange(6)), logic)
        if kind in (1, 2):
            op = rng.choice(["<", "<=", ">", ">=", "=="])
            return f("price", op, str(rng.choice([rng.randrange(20), 7.5])), logic)
        if kind == 3:
            return f("tags", "contains", str(rng.randrange(7)), logic)
        if kind == 4:
            return f("words", "contains", rng.choice("abd"), logic)
        if kind == 5:
            return f("text", rng.choice(["like", "contains"]), rng.choice(["bet", "alpha"]), logic)
        return f(rng.choice(["tags", "text"]), "is_empty", None, logic)

    return [one() for _ in range(rng.choice([0, 1, 1, 2, 3]))]


@pytest.fixture(scope="module")
def table(spark):
    rows = make_rows()
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("mode", MODES)
def test_hits_agree_with_plain_python(table, mode):
    rows, df = table
    rng = random.Random(MODES.index(mode))
    lists = [random_filters(rng) for _ in range(90)]
    found = with_hits(df, lists, mode, keep_all=True)
    assert words_for(len(lists)) == 2
    bits = {r["id"]: r[HITS] for r in found.select("id", HITS).collect()}
    for row in rows:
        for position, filters in enumerate(lists):
            word = bits[row["id"]][position // 64]
            assert bool(word >> (position % 64) & 1) == holds(row, filters, mode), (row, filters)


@pytest.mark.parametrize("mode", MODES)
def test_compiled_filters_agree_with_plain_python(table, mode):
    rows, df = table
    rng = random.Random(17 + MODES.index(mode))
    lists = [random_filters(rng) for _ in range(12)]
    flags = df.select(
        "id", *[compile_filters(df.schema, x, mode).alias(f"c{i}") for i, x in enumerate(lists)]
    ).collect()
    by_id = {r["id"]: r for r in flags}
    for row in rows:
        for i, filters in enumerate(lists):
            assert by_id[row["id"]][f"c{i}"] == holds(row, filters, mode), (row, filters)


@pytest.mark.parametrize(
    "lists",
    [
        [[f("label", "==", "1")], [f("label", "==", "3")]],
        [[f("price", ">", "3"), f("price", "<", "9")], [f("price", "<=", "2")]],
        [[f("tags", "contains", "2")], [f("tags", "contains", "5")]],
        [[f("words", "contains", "a")]],
        [[f("big", ">", str(2**53 + 11))], [f("big", "==", str(2**53 + 13))]],
        [[f("label", "==", "1.5")]],
        [[]],
    ],
)
def test_one_form_drops_exactly_the_rows_without_hits(table, lists):
    rows, df = table
    kept = {r["id"] for r in with_hits(df, lists).select("id").collect()}
    assert kept == {r["id"] for r in rows if any(holds(r, x, "fold") for x in lists)}


def test_has_position(spark):
    df = spark.createDataFrame([(1, [1 << 62, 2])], "id int, w array<bigint>")
    flags = [has_position("w", F.lit(p)).alias(f"p{p}") for p in (0, 62, 64, 65)]
    assert list(df.select(*flags).first()) == [False, True, False, True]


def test_modes_differ(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "a int, b double")
    filters = [f("a", "==", 2), f("b", ">", 4, "or"), f("b", "<", 7)]
    passed = {
        mode: [r["a"] for r in df.where(compile_filters(df.schema, filters, mode)).collect()]
        for mode in MODES
    }
    assert passed == {"fold": [2, 5, 6], "sql": [2, 5, 6], "must_should": []}


def test_unknown_operator_field_and_mode_raise(table):
    _, df = table
    with pytest.raises(ValueError):
        compile_filters(df.schema, [f("label", "<>", 1)])
    with pytest.raises(ValueError):
        compile_filters(df.schema, [f("nothing", "==", 1)])
    with pytest.raises(ValueError):
        compile_filters(df.schema, [f("label", "==", 1)], mode="other")
    with pytest.raises(ValueError):
        with_hits(df, [[f("nothing", "==", 1)]])


def test_like_modes(spark):
    df = spark.createDataFrame([("a.b",), ("axb",)], "text string")
    pattern = [f("text", "like", "a.b")]
    assert df.where(compile_filters(df.schema, pattern)).count() == 2
    assert df.where(compile_filters(df.schema, pattern, like="substring")).count() == 1


def test_empty_value_means_empty(spark):
    df = spark.createDataFrame([([],), ([1],), (None,)], "tags array<int>")
    empty = compile_filters(df.schema, [f("tags", "==", "[]")], empty_value_means_empty=True)
    assert df.where(empty).count() == 2


def test_contains_takes_only_values_of_the_element_type(spark):
    df = spark.createDataFrame([(1, [23]), (2, [24])], "id bigint, tags array<int>")
    for value, ids in (("23.5", []), ("23.0", [1]), (24, [2]), (2**40, [])):
        spec = {"field": "tags", "operator": "contains", "value": value, "logic": "and"}
        found = df.where(condition(df.schema, spec)).collect()
        assert [r["id"] for r in found] == ids


def test_infinite_bounds_in_a_block(spark):
    from sievelake.operators.hits import HITS, has_position, with_hits

    inf = float("inf")
    values = [None, -inf, -1.0, 0.0, 5.0, inf]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v double")
    tests = [("<", inf), ("<=", inf), (">", -inf), (">=", -inf), (">=", inf), ("<=", -inf), (">", 0.0)]
    filters = [[{"field": "v", "operator": o, "value": b, "logic": "and"}] for o, b in tests]
    rows = with_hits(df, filters, "fold", keep_all=True)
    for place, one in enumerate(filters):
        found = rows.where(has_position(HITS, F.lit(place))).collect()
        assert {r["id"] for r in found} == {r["id"] for r in df.where(condition(df.schema, one[0])).collect()}
