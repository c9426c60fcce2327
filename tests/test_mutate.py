"""Inserts, updates, upserts, deletes and the stream of upserts."""

import pytest
from pyspark.sql import functions as F

from sievelake.operators import mutate
from sievelake.streaming import ingest

SCHEMA = "id bigint, image_vec array<int>, eq_val int, range_val double, tags array<int>"


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, [i % 256, 255, 0], i, float(i), [i]) for i in range(50)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def changes(spark):
    rows = [(i, [9, 9, 9], 1000 + i, -1.0, []) for i in range(40, 60)]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_delete_undoes_insert(base, changes):
    new = changes.where("id >= 50")
    assert same(mutate.delete_by_ids(mutate.insert_append(base, new), new.select("id")), base)
    assert same(mutate.delete_by_range(mutate.insert_append(base, new), 50, 59), base)


def test_deleting_an_absent_id_changes_nothing(spark, base):
    assert same(mutate.delete_by_ids(base, spark.createDataFrame([(999,)], "id bigint")), base)


def test_upsert_is_idempotent(base, changes):
    once = mutate.upsert_full(base, changes)
    assert once.count() == 60 and same(mutate.upsert_full(once, changes), once)


def test_last_duplicate_wins_for_a_hot_key(spark, base):
    rows = [(7, [i], i, 0.0, [], i) for i in range(500)] + [(8, [1], 1, 0.0, [], 0)]
    batch = spark.createDataFrame(rows, SCHEMA + ", seq int").repartition(4)
    merged = mutate.upsert_full(base, batch, sequence="seq")
    found = {r["id"]: r["eq_val"] for r in merged.where("id in (7, 8)").collect()}
    assert merged.count() == 50 and found == {7: 499, 8: 1}


def test_partial_upsert_keeps_the_rest(base, changes):
    merged = mutate.upsert_partial(base, changes, ["image_vec", "eq_val"])
    rows = {r["id"]: r for r in merged.collect()}
    assert len(rows) == 60
    assert rows[45]["eq_val"] == 1045 and rows[45]["range_val"] == 45.0 and rows[45]["tags"] == [45]
    assert rows[55]["eq_val"] == 1055 and rows[55]["range_val"] is None and rows[55]["tags"] is None


def test_partial_upsert_can_write_null(spark, base):
    batch = spark.createDataFrame([(3, None)], "id bigint, eq_val int")
    merged = mutate.upsert_partial(base, batch, ["eq_val"])
    assert merged.where("id = 3").first()["eq_val"] is None


def test_overwrite_and_update(spark, base, changes):
    over = mutate.overwrite_field(base, changes, "eq_val")
    assert over.count() == 50 and over.where("eq_val >= 1000").count() == 10
    ids = spark.createDataFrame([(1,), (1,), (2,), (99,)], "id bigint")
    moved = mutate.update_where_in(base, ids, "eq_val", F.col("eq_val") + 100)
    assert moved.count() == 50
    assert {r["id"] for r in moved.where("eq_val >= 100").collect()} == {1, 2}


def test_delta_saturates(spark):
    df = spark.createDataFrame([(65535,), (65534,), (0,)], "v int")
    up = [r[0] for r in df.select(mutate.saturating_delta(F.col("v"), 1)).collect()]
    down = [r[0] for r in df.select(mutate.saturating_delta(F.col("v"), -1)).collect()]
    assert up == [65535, 65535, 1] and down == [65534, 65533, 0]


def test_bump_changes_one_component_by_one(base):
    moved = base.select("id", "image_vec", mutate.bumped_vector(F.col("image_vec"), F.col("id")).alias("new"))
    for r in moved.collect():
        steps = [(a, b - a) for a, b in zip(r["image_vec"], r["new"]) if a != b]
        assert len(steps) == 1
        assert steps[0][1] == (-1 if steps[0][0] == 255 else 1)


def test_stream_of_upserts(spark, base, tmp_path):
    incoming, log, state = (str(tmp_path / name) for name in ("in", "log", "state"))

    def deliver(value):
        row = [(7, [value], value, 0.0, []), (100 + value, [1], 1, 1.0, [])]
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        ingest.start_upserts(spark, incoming, base.schema, log, state).awaitTermination()

    deliver(1)
    deliver(2)
    merged = ingest.merged(base, log)
    assert merged.count() == 52 and merged.where("id = 7").first()["eq_val"] == 2
    ingest.start_upserts(spark, incoming, base.schema, log, state).awaitTermination()  # no new files
    assert same(ingest.merged(base, log), merged)
    compacted = ingest.compact(base, log, str(tmp_path / "next"))
    assert same(compacted, merged)


def test_duplicate_keys_need_a_sequence(spark, base):
    rows = [(7, 70, 1), (7, 71, 2), (8, 80, 1), (90, 1, 5), (90, 2, 4)]
    batch = spark.createDataFrame(rows, "id bigint, eq_val int, seq int").repartition(3)
    partial = mutate.upsert_partial(base, batch, ["eq_val"], sequence="seq")
    found = {r["id"]: r["eq_val"] for r in partial.where("id in (7, 8, 90)").collect()}
    assert partial.count() == 51 and found == {7: 71, 8: 80, 90: 1}
    over = mutate.overwrite_field(base, batch, "eq_val", sequence="seq")
    assert over.count() == 50 and over.where("id = 7").first()["eq_val"] == 71
    for wrong in (
        mutate.upsert_partial(base, batch, ["eq_val"]),
        mutate.overwrite_field(base, batch, "eq_val"),
        mutate.upsert_full(base.select("id", "eq_val"), batch.select("id", "eq_val")),
    ):
        with pytest.raises(Exception, match="no sequence"):
            wrong.collect()


def test_compact_keeps_the_row_that_merged_shows(spark, base, tmp_path):
    log = str(tmp_path / "log")
    small = base.select("id", "eq_val")
    rows = spark.createDataFrame([(7, 11, 2), (7, 10, 1)], "id bigint, eq_val int, seq int")
    rows.coalesce(1).write.parquet(f"{log}/batch=0")
    merged = ingest.merged(small, log, sequence="seq")
    assert merged.where("id = 7").first()["eq_val"] == 11
    assert same(ingest.compact(small, log, str(tmp_path / "next"), sequence="seq"), merged)


def test_ordered_changes_are_like_one_batch(spark, tmp_path):
    """Shuffled, repeated and late batches give the rows that the changes give in order."""
    import random

    from pyspark.sql import types as T

    from sievelake.streaming import ingest

    draw = random.Random(3)
    base = spark.createDataFrame([(i, f"b{i}", 10) for i in range(40)], "id bigint, v string, seq bigint")
    changes = [(draw.randrange(60), f"c{n}", n, draw.random() < 0.3) for n in range(200)]
    changes += [(5, "null", None, None), (70, "lone", None, None)]
    state = {i: (i, f"b{i}", 10) for i in range(40)}
    last = {i: 10 for i in range(40)}
    for key, v, seq, gone in changes:
        if seq is None:
            if key not in last:
                state[key], last[key] = (key, v, None), -1
        elif seq > last.get(key, -1):
            last[key] = seq
            if gone:
                state.pop(key, None)
            else:
                state[key] = (key, v, seq)
    schema = "id bigint, v string, seq bigint, gone boolean"
    for turn in range(2):
        mixed = changes + changes[:50]
        draw.shuffle(mixed)
        folder = str(tmp_path / f"t{turn}")
        for start in range(0, len(mixed), 60):
            part = spark.createDataFrame(mixed[start : start + 60], schema).coalesce(1)
            part.write.mode("append").parquet(f"{folder}/in")
            query = ingest.start_upserts(spark, f"{folder}/in", T.StructType.fromDDL(schema), f"{folder}/log", f"{folder}/check")
            query.awaitTermination()  # each start goes on where the last one ended
        found = ingest.ordered(base, f"{folder}/log", "seq", deleted="gone")
        assert sorted(map(tuple, found.collect())) == sorted(state.values())
    without = base.drop("seq")
    found = ingest.ordered(without, f"{folder}/log", "seq", deleted="gone")
    assert found.columns == ["id", "v"] and found.count() >= 1
