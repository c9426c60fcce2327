"""The stored cell index: changes touch their own folders, searches read probed ones, bounds are safe."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators import ann, cellindex, knn, summaries
from sievelake.plans import fixtures as fx
from tests.oracle import ROOT

FOLDER = f"{ROOT}/sf0.001"
ROW = "id bigint, image_vec array<double>, kind int, size double, tags array<int>"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/rows/*/*/*.parquet")}


@pytest.fixture(scope="module")
def clustered(spark):
    """900 rows around 30 far apart points; kind 7 only near point 29, size grows with the point."""
    draw = np.random.default_rng(5)
    points = draw.normal(0, 100, (30, 8))
    rows = []
    for i in range(900):
        at = i % 30
        vector = (points[at] + draw.normal(0, 1, 8)).tolist()
        kind = 7 if at == 29 else at % 3
        rows.append((i, vector, kind, at + draw.random(), sorted({at % 5, 10 + i % 4})))
    rows += [(900, rows[0][1], 0, None, None), (901, rows[0][1], None, float("nan"), [])]
    return spark.createDataFrame(rows, ROW).cache()


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    centres = ann.sampled_centroids(clustered.where("id < 900"), 25)
    edges = summaries.quantile_edges(clustered, ["size"], 12)
    path = str(tmp_path_factory.mktemp("index"))
    return cellindex.build(clustered, centres, path, counted=("kind", "tags"), edges=edges)


def queries_of(spark, filters, ids=range(0, 900, 45), limit=10):
    rows = [(f"q{i}", "image_vec", i, [tuple(f) for f in filters], limit) for i in ids]
    return spark.createDataFrame(rows, knn.QUERY_SCHEMA)


FILTERS = [
    [],
    [("kind", "==", "1", "and")],
    [("kind", "==", "7", "and")],
    [("kind", "==", "0", "or"), ("kind", "==", "7", "or")],
    [("tags", "contains", "3", "and")],
    [("size", ">", "12.5", "and"), ("size", "<=", "14.25", "and")],
    [("size", "<", "2", "or"), ("size", ">=", "28", "or")],
    [("kind", "==", "2", "and"), ("size", "<", "9", "and"), ("tags", "contains", "11", "and")],
    [("kind", "is_empty", "", "and")],
    [("kind", "==", "99", "and")],
]


@pytest.mark.parametrize("filters", FILTERS[:1] + FILTERS[2:4] + FILTERS[5:8], ids=str)
def test_exact_and_matching(spark, clustered, index, filters):
    queries = queries_of(spark, filters)
    truth = knn.knn_batch(clustered, queries).cache()
    read = []
    assert same(index.search_exact(queries, references=clustered, measured=read), truth)
    assert len(read) == 20 and all(total == 902 for _, _, total in read)
    if not filters:  # five cells hold the rows of two points
        assert sum(r for _, r, _ in read) < 0.5 * sum(t for _, _, t in read)
    found = index.search_matching(queries, references=clustered).cache()
    assert found.count() == truth.count()
    counts = found.groupBy("name").agg(F.max("rank").alias("most"), F.count("id").alias("n"))
    assert counts.where("most <> n").count() == 0
    everything = knn.knn_batch(clustered, queries_of(spark, filters, limit=902)).select("name", "id", "dist")
    assert found.select("name", "id", "dist").exceptAll(everything).count() == 0


def test_matching_beats_blind_probing(spark, clustered, index):
    """At least 0.95 of the truth from fewer than half of the rows that blind probing reads for it."""
    queries = queries_of(spark, FILTERS[2])
    truth = knn.knn_batch(clustered, queries)
    per_cell = {r["cell"]: r["rows"] for r in index.centres().collect()}
    cells, gaps, _ = index._ordered(knn.vectors_for(clustered, next(iter(knn.query_blocks(queries))), "image_vec"))
    block = next(iter(knn.query_blocks(queries)))
    matches = index.expected(block, cells, "fold").matches(block[0].filters)
    aware = sum(per_cell[c] for c in cells[matches > 0])
    assert same(index.search_matching(queries, slack=1000, references=clustered), truth)
    for probes in range(1, 26):
        found = {r["name"] for r in index.search(queries, probes, references=clustered).collect()}
        if len(found) == 20:
            break
    blind = np.mean([sum(per_cell[c] for c in cells[np.argsort(g)[:probes]]) for g in gaps])
    assert aware < 0.5 * blind


def test_expected_matches(spark, clustered, index):
    cells = [r["cell"] for r in index.centres().collect()]
    rows = index.rows()
    for filters in FILTERS:
        (block,) = knn.query_blocks(queries_of(spark, filters, ids=[0]))
        found = index.expected(block, cells, "fold").matches(block[0].filters)
        where = knn.compile_filters(rows.schema, block[0].filters)
        true = {r["cell"]: r["count"] for r in rows.where(where).groupBy("cell").count().collect()}
        exact = len({f[0] for f in filters}) <= 1 and all(f[1] in ("==", "contains") for f in filters)
        for cell, n in zip(cells, found):
            assert n > 0 or cell not in true
            if exact:
                assert n == true.get(cell, 0)


def test_append_delete_are_like_a_fresh_build(spark, clustered, index, tmp_path):
    centres = index.centroids()
    path = str(tmp_path)
    grown = cellindex.build(clustered.where("id < 300"), centres, path, counted=("kind", "tags"), edges=dict(index.edges))
    first = files(path)
    grown = grown.append(clustered.where("id >= 300"))
    assert first < files(path)
    queries = queries_of(spark, FILTERS[1])
    assert same(grown.search(queries, 3), index.search(queries, 3))
    assert same(grown.summaries(), index.summaries())

    gone = spark.createDataFrame([(i,) for i in (30, 60, 90, 90, 5000)], "id bigint")
    touched = grown.rows().join(gone, "id", "left_semi").select("cell").distinct().count()
    before = files(path)
    smaller = grown.delete(gone)
    new = files(path) - before
    assert before < files(path) and {f.split(os.sep)[2] for f in new} and len({f.split(os.sep)[2] for f in new}) <= touched
    fresh = clustered.join(gone, "id", "left_anti")
    rebuilt = cellindex.build(fresh, centres, str(tmp_path / "fresh"), counted=("kind", "tags"), edges=dict(index.edges))
    assert same(smaller.search(queries, 3, references=clustered), rebuilt.search(queries, 3, references=clustered))
    assert same(smaller.summaries(), rebuilt.summaries())
    assert same(smaller.centres().select("cell", "rows"), rebuilt.centres().select("cell", "rows"))
    assert grown.rows().count() == 902 and smaller.rows().count() == 899  # versions stay readable
    assert smaller.delete(gone.where("id = 5000")).version == smaller.version
    assert cellindex.load(spark, path) == smaller

    everything = smaller.delete(clustered.select("id"))
    assert everything.rows().count() == 0
    assert everything.search_exact(queries, references=clustered).count() == 0
    assert everything.search_matching(queries, references=clustered).count() == 0


def test_split(spark, clustered, tmp_path):
    one = ann.sampled_centroids(clustered.where("id < 900"), 1)
    index = cellindex.build(clustered, one, str(tmp_path), counted=("kind",))
    small = index.split(60)
    sizes = [r["rows"] for r in small.centres().collect()]
    assert max(sizes) <= 60 and sum(sizes) == 902
    assert same(small.rows().drop("cell"), index.rows().drop("cell"))
    gaps = small.stored_rows().groupBy("cell").agg(F.max("_gap").alias("g")).join(small.centres(), "cell")
    assert gaps.where("abs(g - radius) > 1e-9").count() == 0
    queries, read = queries_of(spark, FILTERS[0]), []
    assert same(small.search_exact(queries, references=clustered, measured=read), knn.knn_batch(clustered, queries))
    assert sum(r for _, r, _ in read) < 0.3 * sum(t for _, _, t in read)
    grown = small.append(clustered.where("id < 10").withColumn("id", F.col("id") + 5000))
    assert grown.rows().count() == 912 and max(r["rows"] for r in grown.centres().collect()) <= 70

    twins = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id bigint, image_vec array<double>")
    alike = cellindex.build(twins, ann.sampled_centroids(twins, 1), str(tmp_path / "twins"))
    assert alike.split(5).version == 1


def test_only_probed_folders_are_read(spark, clustered, index):
    few = queries_of(spark, FILTERS[1], ids=[0])
    plan = index.search(few, 2, references=clustered)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and any("cell" in part[:300] for part in plan.split("PartitionFilters")[1:])


def test_ties_across_cells(spark, tmp_path):
    """Rows at one distance in different cells are told apart by id."""
    rows = spark.createDataFrame(
        [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (3, 0), (-3, 0), (0, 3), (0, -3), (6, 0)])],
        "id bigint, image_vec array<double>",
    )
    centres = spark.createDataFrame([(i + 1, [float(x), float(y)]) for i, (x, y) in enumerate([(3, 0), (-3, 0), (0, 3), (0, -3)])], "cell int, centre array<double>")
    index = cellindex.build(rows, centres, str(tmp_path))
    for limit in range(1, 7):
        queries = queries_of(spark, [], ids=[0], limit=limit)
        assert same(index.search_exact(queries), knn.knn_batch(rows, queries))
        assert same(index.search_exact(queries, metric="l2_squared"), knn.knn_batch(rows, queries, "l2_squared"))


def test_errors_and_empty(spark, index, clustered):
    queries = queries_of(spark, [], ids=[0])
    with pytest.raises(ValueError):
        index.search_exact(queries, metric="cosine")
    with pytest.raises(Exception, match="no vector field"):
        index.search_exact(queries.withColumn("vector_field", F.lit("other"))).collect()
    assert index.search_exact(queries.where("1 = 0")).count() == 0
    assert index.search_matching(queries.where("1 = 0")).count() == 0


def test_corpus_queries(spark, tmp_path):
    rows = fx.corpus(spark, FOLDER)
    edges = summaries.quantile_edges(rows, ["range_val"], 8)
    index = cellindex.build(rows, fx.centroids(spark, FOLDER), str(tmp_path), counted=("eq_val", "tags"), edges=edges)
    queries = fx.q_mixed(spark, FOLDER)
    truth = knn.knn_batch(rows, queries, mode="sql")
    assert same(index.search_exact(queries, mode="sql", references=rows), truth)
    assert index.search_matching(queries, mode="sql", references=rows).count() == truth.count()
