"""Rates, rewriting and metrics at their edges."""

import pytest
from pyspark.sql import functions as F

from sievelake.operators import analysis, metrics, rewrite
from sievelake.sources.querysets import parse_query_list


def f(field, operator, value, logic="and"):
    return {"field": field, "operator": operator, "value": value, "logic": logic}


def queries(spark, **filters):
    return parse_query_list(
        spark,
        [
            {
                "name": name, "vector_field": "image_vec", "reference_vector_name": 1,
                "scalar_filters": found, "limit": 5,
            }
            for name, found in filters.items()
        ],
    )


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, [float(i), 1.0], i % 10, float(i), [i % 4, i % 4 + 1]) for i in range(200)]
    return spark.createDataFrame(
        rows, "id bigint, image_vec array<float>, eq_val int, range_val double, tags array<int>"
    )


@pytest.fixture(scope="module")
def rates(corpus):
    return analysis.filter_rates(corpus, ["eq_val", "range_val"]).unionByName(
        analysis.tag_rates(corpus)
    )


def rewritten(qs, rates, target, **options):
    targets = rewrite.rewrite_targets(qs, target)
    found = {}
    for r in rewrite.rewrite_by_filter_rate(qs, rates, targets, **options).collect():
        found.setdefault(r["name"], []).append((r["operator"], r["value"]))
    return {name: sorted(pairs) for name, pairs in found.items()}


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (2,)], "v int")
    found = {r["value"]: r["selectivity"] for r in analysis.filter_rates(df, ["v"]).collect()}
    assert found == {None: 0.25, 1.0: 0.5, 2.0: 0.25}


def test_target_zero_and_one(spark, rates):
    qs = queries(spark, q=[f("eq_val", "==", 4)])
    assert rewritten(qs, rates, 0.0) == {"q": [("==", "0.0")]}
    assert len(rewritten(qs, rates, 1.0)["q"]) == 10


def test_range_directions(spark, rates):
    qs = queries(spark, up=[f("range_val", ">", 4)], down=[f("range_val", "<=", 4)])
    assert rewritten(qs, rates, 0.1) == {"up": [(">=", "0.0")], "down": [("<=", "19.0")]}
    top = rewritten(qs, rates, 0.1, descending=True)
    assert top == {"up": [(">=", "180.0")], "down": [("<=", "19.0")]}


def test_every_filter_is_replaced_and_unknown_fields_stay(spark, rates):
    qs = queries(
        spark, two=[f("eq_val", "==", 1), f("eq_val", "==", 2, "or")], other=[f("colour", "==", 1)]
    )
    found = rewritten(qs, rates, 0.2)
    assert len(found["two"]) == 4 and found["other"] == [("==", "1")]


def test_achieved_rate_reaches_the_target(spark, corpus, rates):
    qs = queries(
        spark, a=[f("eq_val", "==", 1)], b=[f("range_val", "<", 3)], c=[f("tags", "contains", 1)]
    )
    for target in (0.03, 0.1, 0.55):
        new = rewrite.with_filters(
            qs, rewrite.rewrite_by_filter_rate(qs, rates, rewrite.rewrite_targets(qs, target))
        )
        found = analysis.query_selectivity(corpus, new).collect()
        assert all(r["selectivity"] >= target for r in found) and len(found) == 3


def test_targets(spark):
    qs = queries(spark, a=[], b=[])
    assert rewrite.rewrite_targets(qs).count() == 0
    only = rewrite.rewrite_targets(qs, overrides={"b": 0.3, "zzz": 0.1}).collect()
    assert [(r["name"], r["target"]) for r in only] == [("b", 0.3)]


def test_relevance_leaves_out_what_it_cannot_score(spark, corpus):
    qs = queries(
        spark, good=[f("eq_val", "==", 1)], two=[f("eq_val", "==", 1)] * 2,
        tags=[f("tags", "contains", 1)],
    )
    lost = qs.withColumn("reference_id", F.lit(-5).cast("bigint")).withColumn("name", F.lit("lost"))
    found = analysis.relevance_distribution(corpus, qs.unionByName(lost), 20).collect()
    assert {r["name"] for r in found} == {"good"} and sum(r["cnt"] for r in found) == 20


def test_correlation(spark, corpus):
    qs = queries(spark, near=[f("range_val", "<", 11)], far=[f("range_val", ">", 150)], all=[])
    found = {r["name"]: r["relevance"] for r in analysis.query_filter_correlation(corpus, qs, 20).collect()}
    assert found == {"near": 0.55, "far": 0.0, "all": 1.0}


def test_selectivity_of_queries_without_matches(spark, corpus):
    qs = queries(spark, none=[f("eq_val", "==", 77)], all=[])
    found = {r["name"]: (r["matched"], r["total"]) for r in analysis.match_counts(corpus, qs).collect()}
    assert found == {"none": (0, 200), "all": (200, 200)}
    nothing = analysis.query_selectivity(corpus.where("id < 0"), qs).collect()
    assert {(r["matched"], r["selectivity"]) for r in nothing} == {(0, 0.0)}


# ---------------------------------------------------------------- metrics


def test_recall(spark):
    truth = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 0)], "name string, id bigint")
    found = spark.createDataFrame([("a", 2), ("a", 9), ("b", 0), ("b", 0)], "name string, id bigint")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    scores = {r["name"]: r["recall"] for r in metrics.recall_at_k(truth, found, names).collect()}
    assert scores == {"a": 0.5, "b": 1.0, "c": 0.0}
    assert [r["name"] for r in metrics.missing_ground_truth(names, truth).collect()] == ["c"]
    assert metrics.with_ground_truth(names, truth).count() == 2


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (0, 10, "a", 0, 1.0, 0.5, True), (0, 10, "a", 1_000_000, 3.0, 1.0, True),
        (1, 10, "a", 0, 2.0, 0.5, False), (2, 20, "b", 5, 0.0, 0.5, True),
    ]
    return spark.createDataFrame(
        rows,
        "sweep_pos int, param int, name string, start_us bigint, exec_time double, recall double, ok boolean",
    )


def test_qps_counts_successes_only(log):
    found = {r["sweep_pos"]: r["qps"] for r in metrics.qps_by_param(log).collect()}
    assert found == {0: 0.5, 1: 0.0, 2: 0.0}


def test_run_stats_keep_repeated_parameters_apart(log):
    rows = {r["sweep_pos"]: r for r in metrics.query_run_stats(log).collect()}
    assert (rows[0]["avg_time"], rows[0]["delta_minus"], rows[0]["delta_plus"]) == (2.0, 1.0, 1.0)
    assert len(rows) == 3
    assert {r["sweep_pos"] for r in metrics.concurrent_query_stats(log, 50).collect()} == {0, 2}


def test_percentiles_interpolate(spark):
    stats = spark.createDataFrame(
        [(0, 10, float(i), i / 10) for i in range(11)],
        "sweep_pos int, param int, avg_time double, avg_recall double",
    )
    row = metrics.overall_percentiles(stats).first()
    assert (row["p25_latency"], row["p1_latency"], row["p95_recall"]) == (2.5, 0.1, 0.95)


def test_histogram_edges(spark):
    values = spark.createDataFrame([(float(i),) for i in range(15)], "avg_recall double")
    rows = metrics.recall_histogram(values).orderBy("bin").collect()
    assert [r["cnt"] for r in rows] == [1] * 13 + [2]
    same = spark.createDataFrame([(0.5,), (0.5,)], "avg_recall double")
    assert sum(r["cnt"] for r in metrics.recall_histogram(same).collect()) == 2
    assert metrics.recall_histogram(same.where("avg_recall > 1")).count() == 0


def test_latency_histogram(spark):
    times = spark.createDataFrame([(0.001,), (0.01,), (10.0,)], "avg_time double")
    rows = metrics.latency_histogram(times).orderBy("bin").collect()
    assert len(rows) == 14 and sum(r["cnt"] for r in rows) == 3
    assert abs(rows[0]["low"] - 0.001) < 1e-12 and abs(rows[-1]["high"] - 10) < 1e-9
    zero = spark.createDataFrame([(0.0,), (0.0,)], "avg_time double")
    assert metrics.latency_histogram(zero).count() == 15


def test_rewrite_counts_null_in_the_total_only(spark):
    from sievelake.operators.rewrite import rewrite_by_filter_rate

    rates = [("v", None, 50, 100, 0.5)] + [("v", float(i), 1, 100, 0.01) for i in range(50)]
    rates = spark.createDataFrame(rates, "field string, value double, cnt bigint, total bigint, selectivity double")
    targets = spark.createDataFrame([("a", 0.1), ("b", 0.1)], "name string, target double")
    kinds = "array<struct<field: string, operator: string, value: string, logic: string>>"
    queries = spark.createDataFrame(
        [("a", "x", 1, [("v", "==", "3", "and")], 5), ("b", "x", 1, [("v", ">", "3", "and")], 5)],
        f"name string, vector_field string, reference_id bigint, scalar_filters {kinds}, `limit` int",
    )
    found = rewrite_by_filter_rate(queries, rates, targets, descending=True).collect()
    assert sorted(float(r["value"]) for r in found if r["name"] == "a") == list(map(float, range(10)))
    assert [(r["operator"], float(r["value"])) for r in found if r["name"] == "b"] == [(">=", 40.0)]
