"""Exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions.distance import METRICS, distance, metric, vector_literal
from sievelake.functions.vectors import distance_to
from sievelake.operators import knn
from sievelake.sources.querysets import parse_query_list

ROWS, DIMENSION = 400, 12


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    found = rng.normal(size=(ROWS, DIMENSION)).astype(np.float32)
    found[100:110] = found[7]  # copies: equal distances, order by id
    return found


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    """A third of the rows carry one label."""
    rows = [
        (i, [float(x) for x in vectors[i]], 0 if i % 3 == 0 else i % 7, float(i), [i % 5, i % 11])
        for i in range(ROWS)
    ]
    schema = "id bigint, image_vec array<float>, eq_val int, range_val double, tags array<int>"
    return spark.createDataFrame(rows, schema).repartition(5)


def label(i):
    return 0 if i % 3 == 0 else i % 7


def exact(vectors, name, reference, rows):
    block, q = vectors.astype(np.float64), vectors[reference].astype(np.float64)
    if name in ("l2", "l2_squared"):
        values = ((block - q) ** 2).sum(1)
        values = np.sqrt(values) if name == "l2" else values
    elif name == "manhattan":
        values = np.abs(block - q).sum(1)
    elif name == "dot":
        values = -(block @ q)
    else:
        values = 1 - block @ q / np.linalg.norm(block, axis=1) / np.linalg.norm(q)
    return sorted((round(values[i], 9), i) for i in rows)


def query(name, reference, filters=(), limit=10):
    return {
        "name": name, "vector_field": "image_vec", "reference_vector_name": reference,
        "scalar_filters": list(filters), "limit": limit,
    }


def eq(value, logic="and"):
    return {"field": "eq_val", "operator": "==", "value": value, "logic": logic}


def answers(df):
    found = {}
    for r in df.orderBy("name", "rank").collect():
        found.setdefault(r["name"], []).append(r["id"])
    return found


@pytest.mark.parametrize("name", sorted(METRICS))
def test_batch_agrees_with_brute_force(spark, corpus, vectors, name):
    queries = [query(f"q{i}", i, [eq(label(i))], 5 + i % 4) for i in range(0, 40, 3)]
    queries += [query(f"all{i}", i, [], 12) for i in (7, 9)]
    found = answers(knn.knn_batch(corpus, parse_query_list(spark, queries), name))
    for q in queries:
        ref = q["reference_vector_name"]
        rows = [i for i in range(ROWS) if not q["scalar_filters"] or label(i) == label(ref)]
        expected = [i for _, i in exact(vectors, name, ref, rows)][: q["limit"]]
        if name in ("cosine", "dot"):
            assert len(found[q["name"]]) == len(expected)
            kth = exact(vectors, name, ref, rows)[q["limit"] - 1][0]
            worst = max(dict((i, v) for v, i in exact(vectors, name, ref, rows))[i] for i in found[q["name"]])
            assert worst <= kth + 1e-9
        else:
            assert found[q["name"]] == expected


@pytest.mark.parametrize("name", sorted(METRICS))
def test_single_query_and_expression_agree(corpus, vectors, name):
    reference = [float(x) for x in vectors[5]]
    literal = distance(F.col("image_vec"), vector_literal(reference), name)
    gap = corpus.select(F.max(F.abs(literal - distance_to(F.col("image_vec"), reference, name))))
    assert gap.first()[0] < 1e-9
    single = knn.knn_single(corpus, reference, 9, [eq(0)], name)
    rows = [i for i in range(ROWS) if label(i) == 0]
    values = [r["dist"] for r in single.orderBy("rank").collect()]
    expected = [v for v, _ in exact(vectors, name, 5, rows)][:9]
    sign = -1 if metric(name).descending else 1
    assert np.allclose([sign * v for v in values], expected, atol=1e-6)


def test_equal_distances_are_ordered_by_id(spark, corpus):
    found = answers(knn.knn_batch(corpus, parse_query_list(spark, [query("q", 105, [], 6)])))
    assert found["q"] == [7, 100, 101, 102, 103, 104]


def test_short_and_empty_answers(spark, corpus):
    few = [{"field": "range_val", "operator": "<", "value": 3, "logic": "and"}]
    none = [{"field": "range_val", "operator": "<", "value": -3, "logic": "and"}]
    other = [query("few", 50, few), query("none", 50, none), query("zero", 50, [], 0)]
    found = answers(knn.knn_batch(corpus, parse_query_list(spark, other)))
    assert sorted(found["few"]) == [0, 1, 2] and set(found) == {"few"}


def test_missing_reference_names_the_queries(spark, corpus):
    queries = parse_query_list(spark, [query("good", 1), query("bad", -1)])
    with pytest.raises(ValueError, match="bad"):
        knn.knn_batch(corpus, queries)
    assert [r["name"] for r in knn.missing_references(queries, corpus).collect()] == ["bad"]


def test_many_blocks_give_the_same_answer(spark, corpus):
    queries = parse_query_list(
        spark, [query(f"q{i}", i, [eq(label(i)), eq(3, "or")]) for i in range(30)]
    )
    whole = answers(knn.knn_batch(corpus, queries))
    assert answers(knn.knn_batch(corpus, queries, block_size=7)) == whole
    assert answers(knn.knn_batch(corpus, queries, block_size=2)) == whole


def test_salted_merge_gives_the_same_answer(spark, corpus):
    queries = parse_query_list(spark, [query(f"q{i}", i, [eq(0)]) for i in range(9)])
    whole = answers(knn.knn_batch(corpus, queries))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "128")
        assert answers(knn.knn_batch(corpus, queries)) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ground_truth_lists(spark, corpus):
    topk = knn.knn_batch(corpus, parse_query_list(spark, [query("q", 3, [], 4)]))
    listed = knn.ground_truth(topk).first()["result"]
    assert listed == [r["id"] for r in topk.orderBy("rank").collect()]


def test_unknown_metric(spark, corpus):
    with pytest.raises(ValueError):
        knn.knn_batch(corpus, parse_query_list(spark, [query("q", 3)]), "hamming")


def test_filter_reaches_the_scan_and_vectors_are_not_shuffled(spark, corpus, tmp_path):
    path = str(tmp_path / "corpus")
    corpus.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = knn.knn_batch(
        stored, parse_query_list(spark, [query("a", 1, [eq(2)]), query("b", 1, [eq(5)])])
    )._jdf.queryExecution().executedPlan().toString()
    assert "In(eq_val, [2,5])" in plan
    exchange = [line for line in plan.splitlines() if "Exchange hash" in line]
    assert len(exchange) == 1 and "name" in exchange[0]
    assert "tags" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_vectors_of_refuses_rows_of_other_lengths():
    import pyarrow as pa

    from sievelake.operators.blocktopk import vectors_of

    for rows in ([[1, 2, 3], [1, 2, 3, 4, 5], [1, 2, 3, 4]], [[1, 2, 3, 4], None]):
        with pytest.raises(ValueError):
            vectors_of(pa.array(rows, pa.list_(pa.int32())), 4)


@pytest.mark.parametrize("hit", [False, True])
def test_infinite_components_stay_on_the_dense_path(hit):
    from sievelake.operators.blocktopk import NearestSoFar, _scan_block

    block = np.array([[0.0, 1.0], [np.inf, 0.0], [3.0, 4.0], [-np.inf, 2.0]])
    best, ids = [NearestSoFar(4)], np.arange(4)
    _scan_block("l2", best, ids, block, np.zeros((1, 2)), [0], {0: ids} if hit else None)
    assert best[0].ids.tolist() == [0, 2, 1, 3]
    assert best[0].values.tolist() == [1.0, 5.0, np.inf, np.inf]
