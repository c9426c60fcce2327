"""Column files, query sets, ground truth, declared schemas and cleaning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions import cleaning
from sievelake.operators import corpus as tables
from sievelake.sources import binfiles, querysets


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i + 1, [i % 256, 3, 255], i % 70 + 65000, i / 4, list(range(i % 4))) for i in range(97)]
    return spark.createDataFrame(
        data, "id bigint, image_vec array<int>, eq_val int, range_val double, tags array<int>"
    ).repartition(3)


def test_corpus_files_round_trip(spark, rows, tmp_path):
    binfiles.write_vectors(rows, f"{tmp_path}/vec")
    binfiles.write_scalars(rows, f"{tmp_path}/equal", "u2", "eq_val")
    binfiles.write_scalars(rows, f"{tmp_path}/range", "f4", "range_val")
    binfiles.write_tags(rows, f"{tmp_path}/tags", columns=4)
    paths = [f"{tmp_path}/{name}" for name in ("vec", "equal", "range", "tags")]
    back = binfiles.read_corpus(spark, *paths)
    assert back.schema["image_vec"].dataType.elementType.simpleString() == "float"
    expected = rows.withColumn("image_vec", F.col("image_vec").cast("array<float>"))
    assert back.exceptAll(expected).count() == 0 and back.count() == 97


def test_a_file_of_another_writer_is_read_in_ranges(spark, tmp_path):
    vectors = np.arange(60, dtype=np.uint8).reshape(20, 3)
    path = tmp_path / "base.u8bin"
    path.write_bytes(np.array([20, 3], dtype="<i4").tobytes() + vectors.tobytes())
    df = binfiles.read_vectors(spark, str(path), rows_per_task=6)
    assert df.rdd.getNumPartitions() == 4
    found = {r["id"]: r["value"] for r in df.collect()}
    assert found == {i + 1: vectors[i].tolist() for i in range(20)}


def test_scalar_file_with_two_columns_is_an_error(spark, tmp_path):
    path = tmp_path / "wide.bin"
    path.write_bytes(np.array([2, 2], dtype="<i4").tobytes() + bytes(16))
    with pytest.raises(Exception, match="one value per row"):
        binfiles.read_scalars(spark, str(path), "u2").collect()


def test_tag_file_of_another_writer(spark, tmp_path):
    lists = [[1, 4], [], [0], [2, 3, 9]]
    starts = np.cumsum([0] + [len(x) for x in lists])
    flat = np.array([t for x in lists for t in x])
    path = tmp_path / "tags.spmat"
    path.write_bytes(
        np.array([4, 10, 6], dtype="<i8").tobytes() + starts.astype("<i8").tobytes()
        + flat.astype("<i4").tobytes() + np.ones(6, dtype="<f4").tobytes()
    )
    found = {r["id"]: r["tags"] for r in binfiles.read_tags(spark, str(path), 2).collect()}
    assert found == {i + 1: x for i, x in enumerate(lists)}


def test_missing_path_and_unknown_type(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        binfiles.read_corpus(spark, f"{tmp_path}/none", f"{tmp_path}/none")
    with pytest.raises(Exception, match="unknown dtype"):
        binfiles.read_vectors(spark, str(tmp_path), dtype="u9").collect()


def test_query_set_and_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "queries.yaml"
    path.write_text(
        "A:\n  - name: q1\n    vector_field: image_vec\n    reference_vector_name: 2\n"
        "    scalar_filters:\n      - field: eq_val\n        operator: '=='\n        value: 1\n"
        "        logic: or\n    limit: 100\n"
    )
    queries = querysets.read_query_yaml(spark, str(path), "A")
    querysets.write_query_set(queries, f"{tmp_path}/set", "A")
    assert querysets.read_query_set(spark, f"{tmp_path}/set", "A").collect() == queries.collect()
    assert querysets.read_query_set(spark, f"{tmp_path}/set", "B").count() == 0
    with pytest.raises(ValueError):
        querysets.read_query_yaml(spark, str(path), "B")


def test_ground_truth_round_trip(spark, tmp_path):
    truth = spark.createDataFrame([("a", [3, 1, 2])], "name string, result array<bigint>")
    querysets.write_ground_truth(truth, f"{tmp_path}/truth")
    found = querysets.read_ground_truth(spark, f"{tmp_path}/truth").orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in found] == [(1, 3), (2, 1), (3, 2)]


def test_declared_schema(spark, rows):
    columns = [
        {"name": "eq_val", "type": "smallint"}, {"name": "id", "type": "INT64"},
        {"name": "image_vec", "type": "VECTOR", "dimension": 3},
    ]
    typed = tables.apply_schema(rows, columns)
    assert typed.columns == ["eq_val", "id", "image_vec"]
    assert typed.agg(F.max("eq_val")).first()[0] == 65069
    with pytest.raises(ValueError, match="dimension"):
        tables.apply_schema(rows, [{"name": "image_vec", "type": "VECTOR"}])
    with pytest.raises(ValueError, match="unsupported type"):
        tables.apply_schema(rows, [{"name": "id", "type": "POINT"}])
    wrong = [{"name": "image_vec", "type": "FLOAT_VECTOR", "dimension": 4}]
    with pytest.raises(Exception, match="dimension is not 4"):
        tables.apply_schema(rows, wrong).collect()


def test_strict_cast_overflows(spark):
    df = spark.createDataFrame([(300,)], "v int")
    with pytest.raises(Exception, match="OVERFLOW"):
        df.select(cleaning.strict(F.col("v"), "tinyint")).collect()


def test_columns_without_a_file(spark, rows):
    plain = tables.assemble(rows.select("id", "image_vec"), rows.select("id", "eq_val"))
    first = plain.first()
    assert first["range_val"] == 0.0 and first["tags"] == []


def test_batches(spark):
    ids = spark.range(1, 26).select(tables.batch_number(F.col("id"), 10).alias("b"))
    assert {r["b"]: r["count"] for r in ids.groupBy("b").count().collect()} == {0: 10, 1: 10, 2: 5}


@pytest.mark.parametrize("value", ["70000", "-1", "NULL"])
def test_scalars_that_do_not_fit_are_refused(spark, tmp_path, value):
    rows = spark.sql(f"SELECT 1L AS id, CAST({value} AS INT) AS v")
    with pytest.raises(Exception, match="range|NULL"):
        binfiles.write_scalars(rows, str(tmp_path / "v"), "u2", "v")


@pytest.mark.parametrize("vectors", ["array(300, 1)", "array(-1, 1)", "array(1, NULL)", "NULL"])
def test_vectors_that_do_not_fit_are_refused(spark, tmp_path, vectors):
    rows = spark.sql(f"SELECT 1L AS id, CAST({vectors} AS ARRAY<INT>) AS image_vec")
    with pytest.raises(Exception, match="range|NULL"):
        binfiles.write_vectors(rows, str(tmp_path / "v"))
