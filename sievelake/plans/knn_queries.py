"""Registered queries: filtered nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import distance_to
from ..operators import knn
from . import fixtures as fx

QUERIES, SQL = {}, {}


def register(key: str, oracle: str | None = None):
    def keep(build):
        QUERIES[key] = build
        if oracle is not None:
            SQL[key] = oracle
        return build

    return keep


def rounded(df):
    return df.withColumn("dist", F.round("dist", 6))


DIST = "list_distance(CAST(c.image_vec AS DOUBLE[]), q.ref)"


def topk_sql(condition: str, limit: str = "10", queries: str = "drawn") -> str:
    return fx.sql(
        f"SELECT name, rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= k",
        "drawn",
        ranked=f"""SELECT q.name, c.id, {DIST} AS dist, {limit} AS k,
                     row_number() OVER (PARTITION BY q.name ORDER BY {DIST}, c.id) AS rank
                   FROM {queries} q JOIN corpus c ON {condition}""",
    )


FOLD = "((c.eq_val = q.eq_val OR c.range_val > q.range_val) AND c.range_val < q.range_val + 60000.0)"
RANGE = "(c.range_val > q.range_val - 20000.0 AND c.range_val < q.range_val + 20000.0)"
MIXED = f"""CASE q.num % 4
  WHEN 0 THEN c.eq_val IN (q.eq_val % 10, (q.eq_val + 1) % 10, (q.eq_val + 2) % 10)
  WHEN 1 THEN {RANGE}
  WHEN 2 THEN list_contains(c.tags, coalesce(q.tags[1], 0))
              OR list_contains(c.tags, coalesce(q.tags[-1], 0))
  ELSE {FOLD} END"""


@register("knn_batch_equal", topk_sql("c.eq_val = q.eq_val"))
def knn_batch_equal(spark, folder):
    rows = fx.plain_corpus(spark, folder)
    return rounded(knn.knn_batch(rows, fx.q_equal(spark, folder)))


@register("knn_batch_range", topk_sql(RANGE))
def knn_batch_range(spark, folder):
    return rounded(knn.knn_batch(fx.corpus(spark, folder), fx.q_range(spark, folder)))


@register("knn_batch_contains", topk_sql("len(q.tags) > 0 AND list_contains(c.tags, q.tags[1])"))
def knn_batch_contains(spark, folder):
    return rounded(knn.knn_batch(fx.corpus(spark, folder), fx.q_contains(spark, folder)))


@register("knn_batch_mixed", topk_sql(MIXED))
def knn_batch_mixed(spark, folder):
    return rounded(knn.knn_batch(fx.corpus(spark, folder), fx.q_mixed(spark, folder)))


@register("knn_variable_k", topk_sql("c.eq_val = q.eq_val", "5 + 5 * (q.num % 3)"))
def knn_variable_k(spark, folder):
    return rounded(knn.knn_batch(fx.plain_corpus(spark, folder), fx.q_limits(spark, folder)))


@register(
    "knn_batch_empty",
    topk_sql("CASE q.num % 3 WHEN 0 THEN len(c.tags) = 0 WHEN 1 THEN c.eq_val = q.eq_val ELSE c.range_val IS NULL END"),
)
def knn_batch_empty(spark, folder):
    """Empty values ask for empty fields: no tags, or no number, beside plain equality."""
    kind = F.col("num") % 3
    none = F.lit(None).cast("string")
    filters = F.when(kind == 0, F.array(fx.spec("tags", "contains", F.lit("[]"))))
    filters = filters.when(kind == 1, fx.equal_filter()).otherwise(F.array(fx.spec("range_val", "==", none)))
    rows = fx.corpus(spark, folder)
    queries = fx.as_query_set(fx.drawn(rows), filters)
    return rounded(knn.knn_batch(rows, queries, empty_value_means_empty=True))


SINGLE = """SELECT rank, id, round(dist, 6) AS dist FROM (
  SELECT c.id, {dist} AS dist, row_number() OVER (ORDER BY {dist}, c.id) AS rank
  FROM corpus c CROSS JOIN drawn q WHERE q.name = 'query1' {condition}) WHERE rank <= 100"""


@register("knn_exact", fx.sql(SINGLE.format(dist=DIST, condition=""), "drawn"))
def knn_exact(spark, folder):
    rows = fx.plain_corpus(spark, folder)
    reference = fx.first_reference(rows, fx.q_equal(spark, folder))
    return rounded(knn.knn_single(rows, reference, 100))


@register(
    "knn_filtered",
    fx.sql(SINGLE.format(dist=DIST, condition="AND c.eq_val = q.eq_val"), "drawn"),
)
def knn_filtered(spark, folder):
    rows = fx.plain_corpus(spark, folder)
    query = next(knn.query_blocks(fx.q_equal(spark, folder).where("name = 'query1'")))[0]
    reference = knn.reference_vectors(rows, [query.reference_id], "image_vec")
    return rounded(knn.knn_single(rows, reference[query.reference_id], 100, query.filters))


@register(
    "reference_lookup",
    fx.sql(
        """SELECT name, reference_id, CAST(pos AS BIGINT) AS pos, round(ref[pos], 6) AS x
           FROM (SELECT name, id AS reference_id, ref, unnest(range(1, len(ref) + 1)) AS pos
                 FROM drawn)""",
        "drawn",
    ),
)
def reference_lookup(spark, folder):
    found = knn.reference_lookup(fx.q_equal(spark, folder), fx.plain_corpus(spark, folder))
    return found.select("name", "reference_id", F.posexplode("reference").alias("pos", "x")).select(
        "name",
        "reference_id",
        (F.col("pos") + 1).cast("bigint").alias("pos"),
        F.round(F.col("x").cast("double"), 6).alias("x"),
    )


@register(
    "missing_references",
    """SELECT 'order' || o_orderkey AS name, o_orderkey AS reference_id
       FROM orders WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings)""",
)
def missing_references(spark, folder):
    """Orders read as queries for the vector of their key; many keys have no vector."""
    queries = fx.table(spark, folder, "orders").select(
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("reference_id"),
    )
    return knn.missing_references(queries, fx.plain_corpus(spark, folder)).select(
        "name", "reference_id"
    )


for _name, _sql in {
    "l2": "list_distance(v, r)",
    "l2_squared": "list_sum(list_transform(list_zip(v, r), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "cosine": "list_cosine_distance(v, r)",
    "dot": "list_inner_product(v, r)",
    "manhattan": "list_sum(list_transform(list_zip(v, r), lambda p: abs(p[1] - p[2])))",
}.items():

    @register(
        f"dist_{_name}",
        fx.sql(
            f"""SELECT id, round({_sql}, 6) AS dist FROM
                (SELECT id, CAST(image_vec AS DOUBLE[]) AS v FROM corpus) CROSS JOIN query1""",
            "query1",
        ),
    )
    def dist(spark, folder, name=_name):
        rows = fx.plain_corpus(spark, folder)
        reference = fx.first_reference(rows, fx.q_equal(spark, folder))
        value = distance_to(F.col("image_vec"), reference, name)
        return rows.select("id", F.round(value, 6).alias("dist"))
