"""Approximate search: a subset of the exact one, and equal to it when it looks everywhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions import vectors as vec
from sievelake.operators import ann, knn, metrics
from sievelake.plans import fixtures as fx
from tests.oracle import ROOT

FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return fx.plain_corpus(spark, FOLDER)


@pytest.fixture(scope="module")
def queries(spark):
    return fx.q_equal(spark, FOLDER)


def test_all_cells_give_the_exact_answer(spark, rows, queries):
    centres = ann.sampled_centroids(rows, 9)
    assigned = ann.ivf_assign(rows, centres)
    found = ann.ivf_search(assigned, queries, centres, 9)
    truth = knn.knn_batch(rows, queries)
    assert found.exceptAll(truth).count() == 0 and found.count() == truth.count()


def test_centres_are_compared_once_where_cells_are_filtered(spark, rows, queries):
    centres = ann.sampled_centroids(rows, 9)
    found = ann.ivf_sweep(ann.ivf_assign(rows, centres), queries, centres, [1, 3])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1


def test_recall_grows_with_the_probes_and_repeated_values_stay_apart(spark, rows, queries):
    probes = [1, 1, 2, 4, 12]
    centres = ann.sampled_centroids(rows, 12)
    found = ann.ivf_sweep(ann.ivf_assign(rows, centres), queries, centres, probes)
    wanted = ann.with_sweep(queries.select("name"), probes)
    scores = metrics.recall_at_k(
        knn.knn_batch(rows, queries), found, wanted, ("sweep_pos", "param", "name")
    )
    by_place = {
        r["sweep_pos"]: r["a"]
        for r in scores.groupBy("sweep_pos").agg(F.avg("recall").alias("a")).collect()
    }
    values = [round(by_place[i], 9) for i in range(len(probes))]
    assert values[0] == values[1] and values == sorted(values) and values[-1] == 1.0


def test_cells_written_by_folder_are_pruned(spark, rows, queries, tmp_path):
    centres = ann.sampled_centroids(rows, 9)
    path = str(tmp_path / "cells")
    ann.write_cells(ann.ivf_assign(rows, centres), path)
    stored = spark.read.parquet(path)
    few = queries.where("name in ('query1', 'query2')")
    found = ann.ivf_search(stored, few, centres, 2, references=rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
    direct = ann.ivf_search(ann.ivf_assign(rows, centres), few, centres, 2)
    assert found.exceptAll(direct).count() == 0 and found.count() == direct.count()


def test_nearest_centre_in_several_passes(spark, rows, monkeypatch):
    cells, centres = ann._centre_arrays(ann.sampled_centroids(rows, 20))
    column = F.col("image_vec")
    whole = rows.select("id", vec.nearest_centre(column, cells, centres).alias("cell"))
    monkeypatch.setattr(vec, "CENTRES_PER_PASS", 64 * 6)
    parts = rows.select("id", vec.nearest_centre(column, cells, centres).alias("cell"))
    assert whole.exceptAll(parts).count() == 0


def test_nearest_centre_tie_goes_to_the_lowest_cell():
    centres = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    gaps, index = vec._nearest(np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 2.0]]), centres)
    assert index.tolist() == [0, 0, 1] and np.allclose(gaps, [0, 0.5, 1])


def test_hash_tables_find_a_subset_and_the_row_itself(spark, rows, queries):
    planes = ann.sign_planes(64, 6, 3)
    found = ann.lsh_search(ann.lsh_index(rows, planes), queries, planes)
    exact = knn.knn_batch(rows, queries, "cosine")
    own = queries.join(found, "name").where("reference_id = id")
    assert own.count() == queries.count()
    recall = metrics.recall_at_k(exact, found, queries).agg(F.avg("recall")).first()[0]
    assert recall > 0.5


def test_one_table_without_bits_is_exact(spark, rows, queries):
    planes = ann.sign_planes(64, 1, 0)
    found = ann.lsh_search(ann.lsh_index(rows, planes), queries, planes)
    exact = knn.knn_batch(rows, queries, "cosine")
    assert found.select("name", "id").exceptAll(exact.select("name", "id")).count() == 0


def test_kmeans_centroids(spark, rows):
    centres = ann.kmeans_centroids(rows, 5)
    assert [r["cell"] for r in centres.orderBy("cell").collect()] == [1, 2, 3, 4, 5]
    assert ann.ivf_assign(rows, centres).select("cell").distinct().count() <= 5
