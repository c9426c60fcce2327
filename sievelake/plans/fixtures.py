"""Inputs of the registered queries, derived by Spark from the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ann import sampled_centroids
from ..operators.corpus import assemble, tags_from_pairs
from ..operators.ranking import contiguous_ids, sample_exact
from ..session import stored
from .sqltext import keyed_sql

QUERIES = 100
CENTROIDS = 20
QUERY_STREAM = 7
CENTROID_STREAM = 11
INCREMENT_STREAM = 13
DELETE_STREAM = 17
RANGE_WIDTH = 20000.0
INCREMENT_RATIO = 0.2


SCHEMAS = {
    "orders": "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "documents": "doc_id bigint, text string, lang string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table with the columns the queries use; declared, so that no file is read for it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def tag_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse tags as (row, tag); pairs may repeat."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("tag")
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """id, image_vec, eq_val, range_val, tags."""
    embeddings = table(spark, folder, "embeddings")
    rows = embeddings.select(F.col("vec_id").alias("row"))
    tagged = tag_pairs(spark, folder).join(rows, "row", "left_semi")
    return assemble(
        embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("image_vec")),
        embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("eq_val")),
        table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("range_val")
        ),
        tags_from_pairs(tagged).withColumnRenamed("row", "id"),
    )


def plain_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """id, image_vec, eq_val: what needs no join."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("image_vec"),
        F.col("label").alias("eq_val"),
    )


def quantized_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).withColumn("image_vec", quantized(F.col("image_vec")))


def quantized(vector: Column) -> Column:
    return F.transform(
        vector, lambda x: F.floor((x.cast("double") + F.lit(1.0)) * F.lit(127.5)).cast("int")
    )


# ---------------------------------------------------------------- query sets


def drawn(rows: DataFrame) -> DataFrame:
    """QUERIES corpus rows, numbered by id: the sample every query set is made from."""
    picked = sample_exact(rows.drop("image_vec"), QUERIES, "id", QUERY_STREAM)
    return contiguous_ids(picked, "id", out="num", rows_at_most=QUERIES).withColumn(
        "name", F.concat(F.lit("query"), F.col("num").cast("string"))
    )


def spec(field: str, operator: str, value: Column, logic: str = "and") -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(operator).alias("operator"),
        value.cast("string").alias("value"),
        F.lit(logic).alias("logic"),
    )


def as_query_set(rows: DataFrame, filters: Column, limit: Column | int = 10) -> DataFrame:
    return rows.select(
        "name",
        F.lit("image_vec").alias("vector_field"),
        F.col("id").alias("reference_id"),
        filters.alias("scalar_filters"),
        (F.lit(limit) if isinstance(limit, int) else limit).cast("int").alias("limit"),
    )


def equal_filter() -> Column:
    return F.array(spec("eq_val", "==", F.col("eq_val")))


def range_filter() -> Column:
    return F.array(
        spec("range_val", ">", F.col("range_val") - RANGE_WIDTH),
        spec("range_val", "<", F.col("range_val") + RANGE_WIDTH),
    )


def q_equal(spark, folder, rows: DataFrame | None = None) -> DataFrame:
    rows = plain_corpus(spark, folder) if rows is None else rows
    return as_query_set(drawn(rows), equal_filter())


def q_limits(spark, folder) -> DataFrame:
    return as_query_set(
        drawn(plain_corpus(spark, folder)), equal_filter(), F.lit(5) + 5 * (F.col("num") % 3)
    )


def q_range(spark, folder) -> DataFrame:
    return as_query_set(drawn(corpus(spark, folder)), range_filter())


def q_contains(spark, folder) -> DataFrame:
    rows = drawn(corpus(spark, folder)).where(F.size("tags") > 0)
    return as_query_set(rows, F.array(spec("tags", "contains", F.col("tags")[0])))


def three_terms() -> Column:
    return F.array(
        spec("eq_val", "==", F.col("eq_val")),
        spec("range_val", ">", F.col("range_val"), "or"),
        spec("range_val", "<", F.col("range_val") + 60000.0),
    )


def q_three_terms(spark, folder) -> DataFrame:
    """eq == a, or range > b, and range < b + 60000: different under each combine mode."""
    return as_query_set(drawn(corpus(spark, folder)), three_terms())


def q_one_bound(spark, folder) -> DataFrame:
    """A single upper or lower bound per query."""
    upper = F.array(spec("range_val", "<", F.col("range_val")))
    lower = F.array(spec("range_val", ">=", F.col("range_val")))
    filters = F.when(F.col("num") % 2 == 0, upper).otherwise(lower)
    return as_query_set(drawn(corpus(spark, folder)), filters)


def q_mixed(spark, folder) -> DataFrame:
    kind = F.col("num") % 4
    one_of_three = F.array(
        *[spec("eq_val", "==", (F.col("eq_val") + step) % 10, "or") for step in range(3)]
    )
    first = F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit(0))
    last = F.coalesce(F.try_element_at("tags", F.lit(-1)), F.lit(0))
    either_tag = F.array(spec("tags", "contains", first, "or"), spec("tags", "contains", last, "or"))
    filters = (
        F.when(kind == 0, one_of_three)
        .when(kind == 1, range_filter())
        .when(kind == 2, either_tag)
        .otherwise(three_terms())
    )
    return as_query_set(drawn(corpus(spark, folder)), filters)


def q_all_sets(spark, folder) -> DataFrame:
    """All query sets in one, the set name before the query name."""
    parts = {
        "equal": q_equal, "range": q_range, "contains": q_contains,
        "mixed": q_mixed, "limits": q_limits,
    }
    union = None
    for label, build in parts.items():
        part = build(spark, folder).withColumn("name", F.concat(F.lit(f"{label}/"), "name"))
        union = part if union is None else union.unionByName(part)
    return union


def first_reference(rows: DataFrame, queries: DataFrame) -> list[float]:
    """The reference vector of query1."""
    wanted = queries.where(F.col("name") == "query1").first()["reference_id"]
    return rows.where(F.col("id") == wanted).select("image_vec").first()["image_vec"]


def centroids(spark, folder) -> DataFrame:
    """CENTROIDS drawn corpus rows as cells 1..CENTROIDS, stored as an index is."""
    rows = plain_corpus(spark, folder)
    return stored(sampled_centroids(rows, CENTROIDS, stream=CENTROID_STREAM), "centroids")


# ---------------------------------------------------------------- logs and dirty input


def run_log(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    kinds = {"click": (0, 10), "error": (1, 10), "purchase": (2, 20), "signup": (3, 40), "view": (4, 80)}

    def coded(index: int) -> Column:
        chain = None
        for kind, codes in kinds.items():
            test = F.col("event_type") == kind
            value = F.lit(codes[index])
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain

    return events.select(
        coded(0).alias("sweep_pos"),
        coded(1).alias("param"),
        F.concat(F.lit("query"), (F.col("user_id") % 20 + 1).cast("string")).alias("name"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"),
        (F.col("value") / 1000.0).alias("exec_time"),
        F.least((F.col("event_id") * 37 % 101) / F.lit(100.0), F.lit(1.0)).alias("recall"),
        (F.col("event_id") % 97 != 0).alias("ok"),
    )


def dirty(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    number = F.col("event_id")
    return events.select(
        number.alias("id"),
        F.when(number % 7 == 0, F.lit("n/a"))
        .when(number % 11 == 0, F.lit(None))
        .otherwise(F.col("user_id").cast("string"))
        .alias("num_text"),
        F.when(number % 13 == 0, F.lit("bad"))
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
        .alias("date_text"),
        F.when(number % 5 == 0, F.lit(None))
        .when(number % 5 == 1, F.lit("oops"))
        .otherwise(
            F.concat(
                F.lit('["'), "event_type", F.lit('","'), F.col("user_id").cast("string"),
                F.lit('"]'),
            )
        )
        .alias("arr_text"),
        F.when(number % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("real_val"),
    )


# ---------------------------------------------------------------- SQL twins

CTES = {
    "tag_pairs": (
        (),
        'SELECT DISTINCT l_orderkey AS "row", CAST(l_partkey % 50 AS INTEGER) AS tag FROM lineitem',
    ),
    "corpus": (
        ("tag_pairs",),
        """SELECT e.vec_id AS id, e.embedding AS image_vec, e.label AS eq_val,
                  o.o_totalprice AS range_val, coalesce(t.tags, CAST([] AS INTEGER[])) AS tags
           FROM embeddings e JOIN orders o ON o.o_orderkey = e.vec_id
           LEFT JOIN (SELECT "row", list_sort(list(tag)) AS tags FROM tag_pairs GROUP BY "row") t
             ON t."row" = e.vec_id""",
    ),
    "corpus_u8": (
        ("corpus",),
        """SELECT id, list_transform(image_vec,
                    lambda x: CAST(floor((CAST(x AS DOUBLE) + 1.0) * 127.5) AS INTEGER)) AS image_vec,
                  eq_val, range_val, tags FROM corpus""",
    ),
    "drawn": (
        ("corpus",),
        f"""SELECT *, row_number() OVER (ORDER BY id) AS num,
                   'query' || row_number() OVER (ORDER BY id) AS name
            FROM (SELECT id, eq_val, range_val, tags, CAST(image_vec AS DOUBLE[]) AS ref FROM corpus
                  ORDER BY {keyed_sql('id', QUERY_STREAM)}, id LIMIT {QUERIES})""",
    ),
    "query1": (("drawn",), "SELECT ref AS r FROM drawn WHERE name = 'query1'"),
    "centroids": (
        ("corpus",),
        f"""SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS cell, centre FROM
            (SELECT id, CAST(image_vec AS DOUBLE[]) AS centre FROM corpus
             ORDER BY {keyed_sql('id', CENTROID_STREAM)}, id LIMIT {CENTROIDS})""",
    ),
    "run_log": (
        (),
        """SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                    WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS sweep_pos,
                  CASE event_type WHEN 'click' THEN 10 WHEN 'error' THEN 10 WHEN 'purchase' THEN 20
                    WHEN 'signup' THEN 40 WHEN 'view' THEN 80 END AS param,
                  'query' || (user_id % 20 + 1) AS name, epoch_us(ts) AS start_us,
                  value / 1000.0::DOUBLE AS exec_time,
                  least((event_id * 37 % 101) / 100.0::DOUBLE, 1.0::DOUBLE) AS recall,
                  event_id % 97 <> 0 AS ok FROM events""",
    ),
    "dirty": (
        (),
        """SELECT event_id AS id,
             CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL
                  ELSE CAST(user_id AS VARCHAR) END AS num_text,
             CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS date_text,
             CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'oops'
                  ELSE '["' || event_type || '","' || CAST(user_id AS VARCHAR) || '"]' END AS arr_text,
             CASE WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE ELSE value END AS real_val
           FROM events""",
    ),
}


def sql(body: str, *names: str, **more: str) -> str:
    """``body`` after the common table expressions it names and those they need.

    ``more`` adds expressions of the query itself, in the order given.
    """
    ordered: dict[str, str] = {}

    def need(name: str) -> None:
        if name in ordered:
            return
        before, text = CTES[name]
        for other in before:
            need(other)
        ordered[name] = text

    for name in names:
        need(name)
    ordered.update(more)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS ({text})" for name, text in ordered.items())
    return f"WITH {parts}\n{body}"
