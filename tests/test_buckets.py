"""Bucketed tables: changes write the folders they touch and leave the others alone."""

import glob
import os

import pytest

from sievelake.operators import buckets, mutate

ROW = "id bigint, v string, n int"


def files(path, version=None):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/rows/version={version or '*'}/*/*.parquet")}


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, f"v{i}", i % 7) for i in range(500)], ROW).cache()


def test_changes_write_touched_buckets_only(spark, base, tmp_path):
    path = str(tmp_path)
    first = buckets.create(base, path, buckets=32)
    before = files(path)
    changes = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (9000, "added", 3)], ROW)
    second = first.upsert(changes, sequence="n")
    written = {f.split(os.sep)[2] for f in files(path, 2)}
    assert before < files(path) and 1 <= len(written) <= 2
    assert same(second.rows(), mutate.upsert_full(base, changes, sequence="n"))
    assert same(first.rows(), base)

    part = spark.createDataFrame([(4, "only v"), (9001, "fresh")], "id bigint, v string")
    third = second.upsert_partial(part, ["v"])
    assert same(third.rows(), mutate.upsert_partial(second.rows(), part, ["v"]))
    assert len({f.split(os.sep)[2] for f in files(path, 3)}) <= 2

    gone = spark.createDataFrame([(3,), (4,), (4,), (77777,)], "id bigint")
    fourth = third.delete(gone)
    assert same(fourth.rows(), mutate.delete_by_ids(third.rows(), gone))
    assert fourth.delete(gone).version == fourth.version  # nothing left to delete
    assert buckets.load(spark, path) == fourth and fourth.rows().columns == base.columns

    one = {r["bucket"] for r in fourth.rows().where("id < 40").select(fourth._bucket()).collect()}
    empty = fourth.delete(fourth.rows().select("id"))
    assert empty.rows().count() == 0 and one
    again = empty.upsert(base.limit(5))
    assert again.rows().count() == 5


def test_only_touched_buckets_are_read(spark, base, tmp_path):
    table = buckets.create(base, str(tmp_path), buckets=16)
    plan = table._stored([3])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:200]
    none = spark.createDataFrame([], ROW)
    assert table.upsert(none).version == 1 and same(table.rows(), base)


def test_failed_changes_leave_the_table(spark, base, tmp_path):
    table = buckets.create(base, str(tmp_path), buckets=16)
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], ROW)
    with pytest.raises(Exception, match="two changes"):
        table.upsert(twice)
    assert same(buckets.load(spark, str(tmp_path)).rows(), base)
    assert table.upsert(twice, sequence="n").rows().where("id = 1").first()["v"] == "b"
