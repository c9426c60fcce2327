"""Synthesis and query generation: laws, edges and sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions.vectors import gaussian_matrix
from sievelake.operators import querygen, synth


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i + 1, [0, 7, 255, i % 256], i % 4, float(i), [i % 3] if i % 5 else []) for i in range(500)]
    return spark.createDataFrame(
        rows, "id bigint, image_vec array<int>, eq_val int, range_val double, tags array<int>"
    )


def test_scale_is_exact_and_ids_are_contiguous(corpus):
    scaled = synth.adjust_scale(corpus, 1730)
    facts = scaled.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id"), F.max("id")
    ).first()
    assert tuple(facts) == (1730, 1730, 1, 1730)
    per_copy = scaled.where("id <= 1500").groupBy("eq_val").count().collect()
    assert {r["count"] for r in per_copy} == {375}
    assert synth.adjust_scale(corpus, 120).count() == 120
    assert synth.adjust_scale(corpus, 0).count() == 0


def test_noise_is_a_coin_flip_under_truncation(corpus):
    rows = synth.scale_replicate(corpus, 4, 500, 1).select("image_vec").collect()
    parts = np.array([r["image_vec"] for r in rows])
    assert set(parts[:, 0]) == {0}
    assert set(parts[:, 1]) == {6, 7} and abs((parts[:, 1] == 6).mean() - 0.5) < 0.05
    assert set(parts[:, 2]) == {254, 255}
    nearest = synth.scale_replicate(corpus, 1, 500, 1, rounding="nearest")
    assert {tuple(r["image_vec"][:3]) for r in nearest.collect()} == {(0, 7, 255)}
    with pytest.raises(ValueError):
        synth.scale_replicate(corpus, 1, 500, rounding="other").collect()


def test_noise_does_not_depend_on_partitions(corpus):
    one = synth.adjust_scale(corpus.coalesce(1), 700)
    many = synth.adjust_scale(corpus.repartition(7), 700)
    assert one.exceptAll(many).count() == 0


def test_increment(corpus):
    rows = synth.incremental_generate(corpus, 0.2)
    facts = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    assert tuple(facts) == (100, 501, 600)


def test_quantize_edges(spark):
    constant = spark.createDataFrame([(1, [3.0, 3.0])], "id bigint, image_vec array<float>")
    assert synth.vector_quantize(constant).first()["image_vec"] == [0, 0]
    line = spark.createDataFrame([(1, [-1.0, 0.0, 1.0])], "id bigint, image_vec array<float>")
    assert synth.vector_quantize(line).first()["image_vec"] == [0, 127, 255]


def test_projection_to_a_new_dimension(corpus):
    adjusted = synth.adjust_dimension(corpus, 4, 9, seed=1)
    values = np.array([r["image_vec"] for r in adjusted.collect()])
    assert values.shape == (500, 9) and values.min() == 0 and values.max() == 255
    matrix = gaussian_matrix(4, 9, 1)
    projected = synth.random_projection(corpus, matrix).where("id = 5").first()["image_vec"]
    assert np.allclose(projected, np.array([0, 7, 255, 4]) @ matrix)


def test_zipf_follows_its_weights(spark):
    drawn = synth.zipf_scalar(spark.range(40_000), "v").groupBy("v").count().collect()
    counts = {r["v"]: r["count"] for r in drawn}
    shares = np.diff(synth.zipf_cumulative(), prepend=0)
    assert min(counts) == 1 and max(counts) <= 500
    for value in (1, 2, 3, 10):
        assert abs(counts[value] / 40_000 - shares[value - 1]) < 0.01


def test_query_sample_quota(spark, corpus):
    sample = querygen.query_sample(corpus, 20, 500, 100)
    rows = sample.collect()
    assert len(rows) == 20 and sorted(r["num"] for r in rows) == list(range(1, 21))
    per_batch = {}
    for r in rows:
        per_batch[(r["id"] - 1) // 100] = per_batch.get((r["id"] - 1) // 100, 0) + 1
    assert per_batch == {b: 4 for b in range(5)}
    assert querygen.query_sample(corpus, 3, 500, 100).count() == 3  # one row a batch, three batches


def test_generated_queries(corpus):
    sample = querygen.query_sample(corpus, 30, 500, 100)
    contains = querygen.contains_queries(sample)
    assert contains.count() == sample.where(F.size("tags") > 0).count()
    ranged = querygen.range_queries(sample).first()["scalar_filters"]
    assert [f["operator"] for f in ranged] == [">", "<"]
    assert float(ranged[1]["value"]) - float(ranged[0]["value"]) == 1.0
    assert querygen.equal_queries(sample).first()["limit"] == 100
