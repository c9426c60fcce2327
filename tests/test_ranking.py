"""Global order, contiguous ids and samples without a global window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions.keyed import keyed_int, keyed_uniform, normals
from sievelake.functions.vectors import keyed_ints
from sievelake.operators import ranking
from sievelake.plans.sqltext import keyed_sql, normal_sql


def test_contiguous_ids_over_many_ranges(spark):
    keys = [i * 7 - 900 for i in range(500)] + [10**12]  # one key far away
    df = spark.createDataFrame([(k,) for k in keys], "key bigint").repartition(6)
    numbered = ranking.contiguous_ids(df, "key", start=5, rows_per_range=40)
    found = [(r["key"], r["id"]) for r in numbered.orderBy("key").collect()]
    assert found == [(k, 5 + i) for i, k in enumerate(sorted(keys))]


def test_running_total_over_ranges(spark):
    df = spark.range(300).select((F.col("id") * 3).alias("v"), (F.col("id") % 4).alias("w"))
    total = ranking.running_total(df.repartition(4), "v", F.col("w"), "upto", rows_per_range=25)
    found = [r["upto"] for r in total.orderBy("v").collect()]
    assert found == np.cumsum([i % 4 for i in range(300)]).tolist()


@pytest.mark.parametrize("n", [0, 1, 40, 300, 999])
def test_sample_by_cutoff_equals_direct_sample(spark, n):
    df = spark.range(300)
    direct = {r["id"] for r in df.orderBy(keyed_int(F.col("id")), "id").limit(n).collect()}
    assert len(direct) == min(n, 300)
    cut = ranking.sample_exact(df.repartition(7), n)
    assert {r["id"] for r in cut.collect()} == direct


@pytest.mark.parametrize("rows_per_range", [1000, 5])
def test_null_and_infinite_keys_have_a_place(spark, rows_per_range):
    keys = [None, float("-inf"), *map(float, range(30)), float("inf")]
    df = spark.createDataFrame([(k,) for k in keys], "key double").repartition(3)
    numbered = ranking.contiguous_ids(df, "key", rows_per_range=rows_per_range)
    assert [r["key"] for r in numbered.orderBy("id").collect()] == keys
    assert [r["id"] for r in numbered.orderBy("id").collect()] == list(range(1, len(keys) + 1))


def test_large_sample_is_exact(spark):
    n = 11_234
    df = spark.range(30_000)
    first = ranking.sample_exact(df, n)
    assert first.count() == n
    assert first.exceptAll(ranking.sample_exact(df.repartition(9), n)).count() == 0


def test_keyed_numbers_agree_everywhere(spark):
    import duckdb

    keys = [0, 1, 2, 5, 1000, 2**31 - 1, 2**31 + 5, 2**40 + 3]
    df = spark.createDataFrame([(k,) for k in keys], "key bigint")
    ours = [r[0] for r in df.select(keyed_int(F.col("key"), 3)).collect()]
    theirs = [_value(duckdb, keyed_sql(str(k), 3)) for k in keys]
    assert ours == theirs
    plain = [r[0] for r in spark.range(50).select(keyed_int(F.col("id"))).collect()]
    assert plain == keyed_ints(np.arange(50)).tolist()
    ours = normals(np.array([77]), np.array([4]))[0]
    assert abs(ours - _value(duckdb, normal_sql("77", "4"))) < 1e-12


def _value(duckdb, text):
    return duckdb.connect().execute(f"SELECT {text}").fetchall()[0][0]


def test_keyed_numbers_look_random(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(keyed_uniform(F.col("id"), 9)).collect()])
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03
    assert np.histogram(u, 20, (0, 1))[0].min() > 850
    rows = keyed_ints(np.arange(4000))
    z = normals(np.repeat(rows, 16), np.tile(np.arange(16), 4000)).reshape(4000, 16)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs((z > 2).mean() - 0.0228) < 0.004
    assert np.abs(np.corrcoef(z.T) - np.eye(16)).max() < 0.07
