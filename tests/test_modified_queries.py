"""Whole rewrites, empty values in batch filters, strict ground truth and strict casts."""

import pytest
from pyspark.sql import functions as F

from sievelake.functions import cleaning
from sievelake.operators import knn, metrics, rewrite
from sievelake.plans import fixtures as fx
from tests.oracle import ROOT

FOLDER = f"{ROOT}/sf0.001"


def query_set(spark, rows):
    return spark.createDataFrame(
        [(n, "image_vec", i, [tuple(f) for f in filters], 5) for n, i, filters in rows], knn.QUERY_SCHEMA
    )


def filters_by_name(queries):
    return {r["name"]: [tuple(f) for f in r["scalar_filters"]] for r in queries.collect()}


def test_mixed_fields_and_untouched_queries(spark):
    rows = [(i, [float(i)], i % 4, i / 10, [i % 3], "x") for i in range(100)]
    corpus = spark.createDataFrame(rows, "id bigint, image_vec array<double>, kind int, size double, tags array<int>, text string")
    queries = query_set(spark, [
        ("a", 0, [("kind", "==", "3", "and")]),
        ("b", 0, [("size", "<", "9", "and")]),
        ("c", 0, [("tags", "contains", "2", "and")]),
        ("d", 0, [("text", "like", "x", "and")]),
        ("e", 0, []),
        ("f", 0, [("kind", "==", "1", "and")]),
    ])
    overrides = {"a": 0.5, "b": 0.2, "c": 0.3, "d": 0.1, "e": 0.1}
    found = rewrite.modified_queries(corpus, queries, overrides=overrides)
    assert found.columns == queries.columns and found.schema["limit"].dataType == queries.schema["limit"].dataType
    got = filters_by_name(found)
    assert got["a"] == [("kind", "==", "0.0", "or"), ("kind", "==", "1.0", "or")]
    assert got["b"] == [("size", "<=", "1.9", "and")]
    assert got["c"] == [("tags", "contains", "0.0", "or")]
    assert got["d"] == [("text", "like", "x", "and")] and got["e"] == [] and got["f"] == [("kind", "==", "1", "and")]
    answers = knn.knn_batch(corpus, found.where("name in ('a', 'b')"))
    assert answers.count() == 10
    with pytest.raises(ValueError, match="nobody"):
        rewrite.modified_queries(corpus, queries, overrides={"nobody": 0.1})
    with pytest.raises(ValueError, match="filter_rate"):
        rewrite.modified_queries(corpus, queries, by="other")
    only_text = queries.where("name = 'd'")
    assert filters_by_name(rewrite.modified_queries(corpus, only_text, default=0.1)) == {"d": got["d"]}


def test_relevance_changes_single_filters_only(spark):
    corpus = spark.createDataFrame([(i, [float(i)], i % 4) for i in range(40)], "id bigint, image_vec array<double>, kind int")
    queries = query_set(spark, [("a", 0, [("kind", "==", "3", "and")]), ("b", 39, [("kind", "==", "3", "and")]), ("c", 0, [])])
    got = filters_by_name(rewrite.modified_queries(corpus, queries, "relevance", overrides={"a": 0.5}, top_k=8))
    assert [f[2] for f in got["a"]] in (["0", "1"], ["0.0", "1.0"])
    assert got["b"] == [("kind", "==", "3", "and")] and got["c"] == []


def test_empty_values_in_batch_filters(spark):
    rows = fx.corpus(spark, FOLDER)
    queries = query_set(spark, [("none", 1, [("tags", "contains", "[]", "and")]), ("nan", 1, [("range_val", "<", "nan", "and")])])
    found = knn.knn_batch(rows, queries, empty_value_means_empty=True)
    empty = {r["id"] for r in rows.where(F.size("tags") == 0).collect()}
    assert {r["id"] for r in found.collect()} <= empty and found.where("name = 'none'").count() == min(5, len(empty))


def test_strict_ground_truth(spark):
    queries = spark.createDataFrame([(f"q{i:02}",) for i in range(30)], "name string")
    truth = spark.createDataFrame([("q00", 1), ("q00", 2)], "name string, id bigint")
    assert [r["name"] for r in metrics.with_ground_truth(queries, truth).collect()] == ["q00"]
    with pytest.raises(ValueError, match=r"'q01'.*and more"):
        metrics.with_ground_truth(queries, truth, strict=True)
    with pytest.raises(ValueError, match=r"'q29'\]$"):
        metrics.with_ground_truth(queries, truth, strict=True, named=29)
    assert metrics.with_ground_truth(queries.where("name = 'q00'"), truth, strict=True).count() == 1


@pytest.mark.parametrize("width, least, most", [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -(2**31), 2**31 - 1)])
def test_strict_casts_fail_beyond_their_width(spark, width, least, most):
    ends = spark.createDataFrame([(least,), (most,)], "x bigint")
    assert [r[0] for r in ends.select(cleaning.strict(F.col("x"), width)).collect()] == [least, most]
    for value in (least - 1, most + 1):
        with pytest.raises(Exception, match="OVERFLOW"):
            spark.createDataFrame([(value,)], "x bigint").select(cleaning.strict(F.col("x"), width)).collect()
