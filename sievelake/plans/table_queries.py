"""Registered queries: sources, sinks, assembly and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators import corpus as tables, knn
from ..operators.ranking import contiguous_ids
from ..session import scratch_path
from ..sources import binfiles, querysets
from . import fixtures as fx
from .knn_queries import topk_sql
from .synth_queries import as_text

QUERIES, SQL = {}, {}
ROWS_PER_TASK = 100
BATCH_ROWS = 1000


def register(key: str, oracle: str | None = None):
    def keep(build):
        QUERIES[key] = build
        if oracle is not None:
            SQL[key] = oracle
        return build

    return keep


# ---------------------------------------------------------------- files


@register(
    "scan_u8bin",
    fx.sql("SELECT id + 1 AS id, array_to_string(image_vec, ',') AS vec FROM corpus_u8", "corpus_u8"),
)
def scan_u8bin(spark, folder):
    path = scratch_path(spark, "vectors")
    rows = fx.plain_corpus(spark, folder)
    quantized = rows.select("id", fx.quantized(F.col("image_vec")).alias("image_vec"))
    binfiles.write_vectors(quantized, path)
    found = binfiles.read_vectors(spark, path, rows_per_task=ROWS_PER_TASK)
    return found.select("id", as_text("value").alias("vec"))


@register(
    "scan_scalar_bin",
    fx.sql(
        """SELECT id + 1 AS id, eq_val, round(CAST(CAST(range_val AS FLOAT) AS DOUBLE), 4) AS range_val
           FROM corpus""",
        "corpus",
    ),
)
def scan_scalar_bin(spark, folder):
    rows = fx.corpus(spark, folder).select("id", "eq_val", "range_val")
    path = scratch_path(spark, "scalars")
    binfiles.write_scalars(rows, f"{path}/equal", "u2", "eq_val")
    binfiles.write_scalars(rows, f"{path}/range", "f4", "range_val")
    equal = binfiles.read_scalars(spark, f"{path}/equal", "u2", ROWS_PER_TASK)
    ranges = binfiles.read_scalars(spark, f"{path}/range", "f4", ROWS_PER_TASK)
    return equal.withColumnRenamed("value", "eq_val").join(
        ranges.select("id", F.round(F.col("value").cast("double"), 4).alias("range_val")), "id"
    )


@register(
    "scan_csr_tags",
    fx.sql("SELECT id + 1 AS id, array_to_string(tags, ',') AS tags FROM corpus", "corpus"),
)
def scan_csr_tags(spark, folder):
    path = scratch_path(spark, "tags")
    binfiles.write_tags(fx.corpus(spark, folder).select("id", "tags"), path, columns=50)
    found = binfiles.read_tags(spark, path, ROWS_PER_TASK)
    return found.select("id", as_text("tags").alias("tags"))


@register(
    "write_u8bin_roundtrip",
    fx.sql(
        """SELECT id + 1 AS id, array_to_string(image_vec, ',') AS vec, eq_val,
             round(CAST(CAST(range_val AS FLOAT) AS DOUBLE), 4) AS range_val,
             array_to_string(tags, ',') AS tags FROM corpus_u8""",
        "corpus_u8",
    ),
)
def write_u8bin_roundtrip(spark, folder):
    """All four column files of a corpus, written and assembled again."""
    rows = fx.quantized_corpus(spark, folder)
    path = scratch_path(spark, "corpus")
    binfiles.write_vectors(rows, f"{path}/vectors")
    binfiles.write_scalars(rows, f"{path}/equal", "u2", "eq_val")
    binfiles.write_scalars(rows, f"{path}/range", "f4", "range_val")
    binfiles.write_tags(rows, f"{path}/tags", columns=50)
    found = binfiles.read_corpus(
        spark, f"{path}/vectors", f"{path}/equal", f"{path}/range", f"{path}/tags"
    )
    vec = F.array_join(F.transform("image_vec", lambda x: x.cast("int").cast("string")), ",")
    return found.select(
        "id", vec.alias("vec"), "eq_val", F.round("range_val", 4).alias("range_val"),
        as_text("tags").alias("tags"),
    )


def _set_sql(label: str, pos: int, field: str, operator: str, value: str, logic="and",
             limit="10", condition="true") -> str:
    return f"""SELECT '{label}/' || q.name AS name, q.id AS reference_id, {limit} AS "limit",
        CAST({pos} AS BIGINT) AS pos, '{field}' AS field, '{operator}' AS operator,
        round(CAST({value} AS DOUBLE), 6) AS value, '{logic}' AS logic
        FROM drawn q WHERE {condition}"""


def _range_sql(label: str, condition: str) -> list[str]:
    return [
        _set_sql(label, 0, "range_val", ">", "range_val - 20000.0", condition=condition),
        _set_sql(label, 1, "range_val", "<", "range_val + 20000.0", condition=condition),
    ]


@register(
    "query_set_scan",
    fx.sql(
        " UNION ALL ".join(
            [
                _set_sql("equal", 0, "eq_val", "==", "eq_val"),
                *_range_sql("range", "true"),
                _set_sql("contains", 0, "tags", "contains", "tags[1]", condition="len(tags) > 0"),
                _set_sql("limits", 0, "eq_val", "==", "eq_val", limit="5 + 5 * (num % 3)"),
                *[
                    _set_sql("mixed", i, "eq_val", "==", f"(eq_val + {i}) % 10", "or",
                             condition="num % 4 = 0")
                    for i in range(3)
                ],
                *_range_sql("mixed", "num % 4 = 1"),
                _set_sql("mixed", 0, "tags", "contains", "coalesce(tags[1], 0)", "or",
                         condition="num % 4 = 2"),
                _set_sql("mixed", 1, "tags", "contains", "coalesce(tags[-1], 0)", "or",
                         condition="num % 4 = 2"),
                _set_sql("mixed", 0, "eq_val", "==", "eq_val", condition="num % 4 = 3"),
                _set_sql("mixed", 1, "range_val", ">", "range_val", "or", condition="num % 4 = 3"),
                _set_sql("mixed", 2, "range_val", "<", "range_val + 60000.0",
                         condition="num % 4 = 3"),
            ]
        ),
        "drawn",
    ),
)
def query_set_scan(spark, folder):
    """All query sets written as one file set under a dataset key, and read back."""
    path = scratch_path(spark, "queries")
    querysets.write_query_set(fx.q_all_sets(spark, folder), path, "corpus")
    found = querysets.read_query_set(spark, path, "corpus")
    return found.select(
        "name", "reference_id", "limit", F.posexplode("scalar_filters").alias("pos", "f")
    ).select(
        "name", "reference_id", F.col("limit").cast("int").alias("limit"),
        F.col("pos").cast("bigint").alias("pos"), F.col("f.field").alias("field"),
        F.col("f.operator").alias("operator"),
        F.round(F.col("f.value").cast("double"), 6).alias("value"), F.col("f.logic").alias("logic"),
    )


@register(
    "ground_truth_export",
    f"SELECT name, rank, id FROM ({topk_sql('c.eq_val = q.eq_val')})",
)
def ground_truth_export(spark, folder):
    path = scratch_path(spark, "truth")
    found = knn.knn_batch(fx.plain_corpus(spark, folder), fx.q_equal(spark, folder))
    querysets.write_ground_truth(knn.ground_truth(found), path)
    return querysets.read_ground_truth(spark, path)


# ---------------------------------------------------------------- assembly


@register(
    "corpus_assemble",
    fx.sql(
        """SELECT id, CAST(len(image_vec) AS BIGINT) AS dimension, eq_val, range_val,
                  array_to_string(tags, ',') AS tags FROM corpus""",
        "corpus",
    ),
)
def corpus_assemble(spark, folder):
    return fx.corpus(spark, folder).select(
        "id", F.size("image_vec").cast("bigint").alias("dimension"), "eq_val", "range_val",
        as_text("tags").alias("tags"),
    )


@register(
    "batch_plan",
    f"""SELECT batch, CAST(count(*) AS BIGINT) AS cnt, min(id) AS first_id, max(id) AS last_id
        FROM (SELECT o_orderkey + 1 AS id, o_orderkey // {BATCH_ROWS} AS batch FROM orders)
        GROUP BY batch""",
)
def batch_plan(spark, folder):
    rows = fx.table(spark, folder, "orders").select((F.col("o_orderkey") + 1).alias("id"))
    return (
        rows.groupBy(tables.batch_number(F.col("id"), BATCH_ROWS).alias("batch"))
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
        )
    )


@register(
    "dataset_info",
    """SELECT CAST(count(*) AS BIGINT) AS total_size, CAST(max(len(embedding)) AS BIGINT) AS vec_dim,
              min(vec_id) AS min_id, max(vec_id) AS max_id FROM embeddings""",
)
def dataset_info(spark, folder):
    return tables.dataset_info(fx.plain_corpus(spark, folder))


DECLARED = [
    {"name": "id", "type": "INT64"},
    {"name": "eq_val", "type": "INT16"},
    {"name": "range_val", "type": "FLOAT"},
    {"name": "tags", "type": "ARRAY", "element_type": "VARCHAR"},
    {"name": "image_vec", "type": "FLOAT_VECTOR", "dimension": 64},
]


@register(
    "schema_apply",
    fx.sql(
        """SELECT id, eq_val, CAST(CAST(range_val AS FLOAT) AS DOUBLE) AS range_val,
             array_to_string(tags, ',') AS tags, CAST(len(image_vec) AS BIGINT) AS dimension
           FROM corpus""",
        "corpus",
    ),
)
def schema_apply(spark, folder):
    typed = tables.apply_schema(fx.corpus(spark, folder), DECLARED)
    return typed.select(
        "id", "eq_val", F.col("range_val").cast("double").alias("range_val"),
        F.array_join("tags", ",").alias("tags"), F.size("image_vec").cast("bigint").alias("dimension"),
    )


@register(
    "assign_ids",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders",
)
def assign_ids(spark, folder):
    rows = fx.table(spark, folder, "orders").select("o_orderkey")
    return contiguous_ids(rows, "o_orderkey")


@register(
    "tags_from_coo",
    fx.sql(
        """SELECT "row" AS id, array_to_string(list_sort(list(tag)), ',') AS tags
           FROM tag_pairs GROUP BY "row" """,
        "tag_pairs",
    ),
)
def tags_from_coo(spark, folder):
    found = tables.tags_from_pairs(fx.tag_pairs(spark, folder))
    return found.select(F.col("row").alias("id"), as_text("tags").alias("tags"))


# ---------------------------------------------------------------- cleaning


@register(
    "cast_strict",
    """SELECT event_id, CAST(event_id AS INTEGER) AS as_int32, CAST(user_id AS INTEGER) AS as_int16,
              CAST(CAST(value AS FLOAT) AS DOUBLE) AS as_float FROM events""",
)
def cast_strict(spark, folder):
    rows = fx.table(spark, folder, "events")
    return rows.select(
        "event_id",
        cleaning.strict(F.col("event_id"), "int").alias("as_int32"),
        cleaning.strict(F.col("user_id"), "int").alias("as_int16"),
        cleaning.strict(F.col("value"), "float").cast("double").alias("as_float"),
    )


@register(
    "cast_strict_widths",
    """SELECT event_id, CAST(event_id % 128 AS TINYINT) AS i8, CAST(event_id % 32768 AS SMALLINT) AS i16,
              CAST(user_id AS INTEGER) AS i32, CAST(event_id * 4000000000 AS BIGINT) AS i64,
              CAST(CAST(CAST(value AS FLOAT) AS DOUBLE) AS DOUBLE) AS f32, CAST(user_id::VARCHAR AS DOUBLE) AS f64
       FROM events""",
)
def cast_strict_widths(spark, folder):
    """Every declared width; what does not fit fails."""
    event, user = F.col("event_id"), F.col("user_id")
    return fx.table(spark, folder, "events").select(
        "event_id",
        cleaning.strict(event % 128, "tinyint").alias("i8"),
        cleaning.strict(event % 32768, "smallint").alias("i16"),
        cleaning.strict(user, "int").alias("i32"),
        cleaning.strict(event * 4000000000, "bigint").alias("i64"),
        cleaning.strict(F.col("value"), "float").cast("double").alias("f32"),
        cleaning.strict(user.cast("string"), "double").alias("f64"),
    )


@register(
    "cast_coerce_zero",
    fx.sql(
        """SELECT id, coalesce(TRY_CAST(num_text AS BIGINT), 0) AS as_int,
             coalesce(TRY_CAST(num_text AS DOUBLE), 0.0::DOUBLE) AS as_float FROM dirty""",
        "dirty",
    ),
)
def cast_coerce_zero(spark, folder):
    text = F.col("num_text")
    return fx.dirty(spark, folder).select(
        "id",
        cleaning.number_or_zero(text, "bigint").alias("as_int"),
        cleaning.number_or_zero(text, "double").alias("as_float"),
    )


@register(
    "parse_datetime_lenient",
    fx.sql(
        """SELECT id, strftime(try_strptime(date_text, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS parsed
           FROM dirty""",
        "dirty",
    ),
)
def parse_datetime_lenient(spark, folder):
    parsed = cleaning.datetime_or_null(F.col("date_text"))
    return fx.dirty(spark, folder).select(
        "id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@register(
    "date_to_int_key",
    fx.sql(
        """SELECT id, coalesce(CAST(strftime(try_strptime(date_text, '%Y-%m-%d'), '%Y%m%d')
             AS INTEGER), 0) AS date_key FROM dirty""",
        "dirty",
    ),
)
def date_to_int_key(spark, folder):
    parsed = cleaning.datetime_or_null(F.col("date_text"))
    return fx.dirty(spark, folder).select("id", cleaning.date_key(parsed).alias("date_key"))


@register(
    "string_fill_empty",
    fx.sql("SELECT id, coalesce(num_text, '') AS filled, CAST(id AS VARCHAR) AS as_text FROM dirty", "dirty"),
)
def string_fill_empty(spark, folder):
    return fx.dirty(spark, folder).select(
        "id",
        cleaning.text_or_empty(F.col("num_text")).alias("filled"),
        cleaning.text_or_empty(F.col("id")).alias("as_text"),
    )


@register(
    "null_normalise",
    fx.sql("SELECT id, CASE WHEN isnan(real_val) THEN NULL ELSE real_val END AS real_val FROM dirty", "dirty"),
)
def null_normalise(spark, folder):
    return fx.dirty(spark, folder).select(
        "id", cleaning.nan_to_null(F.col("real_val")).alias("real_val")
    )


PARSED = """SELECT id, CASE WHEN json_valid(arr_text)
  THEN from_json(CAST(arr_text AS JSON), '["VARCHAR"]') END AS arr FROM dirty"""


@register(
    "parse_array_text",
    fx.sql(
        "SELECT id, CAST(len(arr) AS BIGINT) AS n, arr[1] AS first, arr[2] AS second FROM parsed",
        "dirty", parsed=PARSED,
    ),
)
def parse_array_text(spark, folder):
    parsed = fx.dirty(spark, folder).select(
        "id", cleaning.array_from_text(F.col("arr_text")).alias("arr")
    )
    return parsed.select(
        "id",
        F.when(F.col("arr").isNotNull(), F.size("arr")).cast("bigint").alias("n"),
        F.try_element_at("arr", F.lit(1)).alias("first"),
        F.try_element_at("arr", F.lit(2)).alias("second"),
    )


@register(
    "array_to_literal",
    fx.sql(
        """SELECT id, '{' || array_to_string(list_transform(tags, lambda t: '"' || t || '"'), ',')
                  || '}' AS literal FROM corpus""",
        "corpus",
    ),
)
def array_to_literal(spark, folder):
    return fx.corpus(spark, folder).select(
        "id", cleaning.array_literal(F.col("tags")).alias("literal")
    )


@register(
    "array_stringify",
    fx.sql(
        """SELECT id, CAST(coalesce(len(arr), 0) AS BIGINT) AS n,
                  coalesce(array_to_string(arr, '|'), '') AS joined FROM parsed""",
        "dirty", parsed=PARSED,
    ),
)
def array_stringify(spark, folder):
    parsed = cleaning.array_of_text(cleaning.array_from_text(F.col("arr_text")))
    return (
        fx.dirty(spark, folder)
        .select("id", parsed.alias("arr"))
        .select("id", F.size("arr").cast("bigint").alias("n"), F.array_join("arr", "|").alias("joined"))
    )


@register(
    "vector_widen",
    fx.sql(
        """SELECT id, CAST(unnest(range(len(image_vec))) AS BIGINT) AS pos,
                  CAST(unnest(image_vec) AS DOUBLE) AS x FROM corpus_u8""",
        "corpus_u8",
    ),
)
def vector_widen(spark, folder):
    rows = fx.plain_corpus(spark, folder)
    widened = rows.select("id", cleaning.widen_vector(fx.quantized(F.col("image_vec"))).alias("v"))
    return widened.select("id", F.posexplode("v").alias("pos", "x")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.col("x").cast("double").alias("x")
    )
