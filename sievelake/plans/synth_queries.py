"""Registered queries: synthesis and query generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sign_matrix
from ..operators import querygen, synth
from ..operators.ranking import sample_exact, sample_prefix
from . import fixtures as fx
from .sqltext import keyed_sql, normal_sql, uniform_sql

QUERIES, SQL = {}, {}
DIMENSION, NEW_DIMENSION = 64, 16
SAMPLE_STREAM, FACTOR = 19, 3
BATCH_ROWS, PICKED = 100, 50


def register(key: str, oracle: str | None = None):
    def keep(build):
        QUERIES[key] = build
        if oracle is not None:
            SQL[key] = oracle
        return build

    return keep


def as_text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def shown(df):
    """A quantized corpus with its arrays as text."""
    return df.select(
        "id", as_text("image_vec").alias("vec"), "eq_val", "range_val", as_text("tags").alias("tags")
    )


SHOWN = """SELECT id, array_to_string(image_vec, ',') AS vec, eq_val, range_val,
  array_to_string(tags, ',') AS tags FROM {rows}"""


def noise_sql(rows: str) -> str:
    """``rows`` (id, image_vec, eq_val, range_val, tags) with noise keyed by id."""
    return f"""SELECT id, list_transform(image_vec, lambda x, i: CAST(floor(least(greatest(
        x + 0.05::DOUBLE * {normal_sql('rk', '(i - 1)')}, 0.0), 255.0))
        AS INTEGER)) AS image_vec, eq_val, range_val, tags
        FROM (SELECT *, {keyed_sql('id', synth.NOISE_STREAM)} AS rk FROM {rows})"""


def sample_sql(rows: str, count: str, stream: int) -> str:
    """The ``count`` rows with the smallest keyed hash, and their place by id."""
    return f"""SELECT * EXCLUDE (draw), row_number() OVER (ORDER BY id) AS place FROM (
        SELECT *, row_number() OVER (ORDER BY {keyed_sql('id', stream)}, id) AS draw FROM {rows})
        WHERE draw <= {count}"""


RENUMBERED = "SELECT {start} + place - 1 AS id, image_vec, eq_val, range_val, tags FROM {rows}"


@register(
    "sample_exact",
    fx.sql(
        "SELECT place AS new_id, id, eq_val FROM picked", "corpus",
        picked=sample_sql("corpus", "(SELECT count(*) // 2 FROM corpus)", SAMPLE_STREAM),
    ),
)
def sample_exact_half(spark, folder):
    """Half of the corpus by keyed hash, renumbered from 1 in the old order."""
    from ..operators.ranking import contiguous_ids

    rows = fx.plain_corpus(spark, folder).select("id", "eq_val")
    half = sample_exact(rows, rows.count() // 2, "id", SAMPLE_STREAM)
    return contiguous_ids(half, "id", out="new_id")


@register(
    "sample_prefix",
    "SELECT vec_id + 1 AS id, label AS eq_val FROM embeddings"
    " WHERE vec_id + 1 <= (SELECT count(*) // 2 FROM embeddings)",
)
def sample_prefix_half(spark, folder):
    """The first half of a corpus with ids 1..n, which is what a prefix sample returns."""
    rows = fx.plain_corpus(spark, folder).select((F.col("id") + 1).alias("id"), "eq_val")
    return sample_prefix(rows, rows.count() // 2)


@register(
    "random_projection",
    fx.sql(
        """SELECT id, j AS pos, round(list_inner_product(CAST(image_vec AS DOUBLE[]), s), 6) AS x
           FROM corpus CROSS JOIN signs""",
        "corpus",
        signs=f"""SELECT j, list_transform(range({DIMENSION}), lambda i:
                    CASE WHEN {keyed_sql(f'(i * {NEW_DIMENSION} + j)')} % 2 = 0
                         THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s
                  FROM range({NEW_DIMENSION}) r(j)""",
    ),
)
def random_projection(spark, folder):
    matrix = sign_matrix(DIMENSION, NEW_DIMENSION)
    projected = synth.random_projection(fx.plain_corpus(spark, folder), matrix)
    return projected.select("id", F.posexplode("image_vec").alias("pos", "x")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x")
    )


MINMAX = """SELECT min(x) AS mn, max(x) AS mx
  FROM (SELECT unnest(CAST(image_vec AS DOUBLE[])) AS x FROM corpus)"""


@register(
    "vector_minmax",
    fx.sql("SELECT round(mn, 6) AS mn, round(mx, 6) AS mx FROM ends", "corpus", ends=MINMAX),
)
def vector_minmax(spark, folder):
    ends = synth.vector_minmax(fx.plain_corpus(spark, folder))
    return ends.select(F.round("mn", 6).alias("mn"), F.round("mx", 6).alias("mx"))


@register(
    "vector_quantize",
    fx.sql(
        """SELECT id, array_to_string(list_transform(CAST(image_vec AS DOUBLE[]),
                    lambda x: CAST(floor((x - mn) / (mx - mn) * 255.0::DOUBLE) AS INTEGER)), ',') AS vec
           FROM corpus CROSS JOIN ends""",
        "corpus", ends=MINMAX,
    ),
)
def vector_quantize(spark, folder):
    quantized = synth.vector_quantize(fx.plain_corpus(spark, folder))
    return quantized.select("id", as_text("image_vec").alias("vec"))


@register(
    "scale_replicate",
    fx.sql(
        SHOWN.format(rows="noised"), "corpus_u8",
        copies=f"""SELECT copy * (SELECT count(*) FROM corpus) + id AS id, image_vec, eq_val,
                     range_val, tags FROM corpus_u8, range({FACTOR}) r(copy)""",
        noised=noise_sql("copies"),
    ),
)
def scale_replicate(spark, folder):
    rows = fx.quantized_corpus(spark, folder)
    target = fx.plain_corpus(spark, folder).count() * FACTOR
    return shown(synth.adjust_scale(rows, target))


@register(
    "scale_remainder",
    fx.sql(
        SHOWN.format(rows="noised"), "corpus_u8",
        picked=sample_sql(
            "corpus_u8", "(SELECT count(*) // 3 FROM corpus_u8)", synth.SAMPLE_STREAM
        ),
        renumbered=RENUMBERED.format(start="(SELECT count(*) FROM corpus_u8)", rows="picked"),
        noised=noise_sql("renumbered"),
    ),
)
def scale_remainder(spark, folder):
    rows = fx.quantized_corpus(spark, folder)
    count = fx.plain_corpus(spark, folder).count()
    return shown(synth.scale_remainder(rows, count // 3, count))


INCREMENT = {
    "inc_picked": sample_sql(
        "corpus_u8",
        f"(SELECT CAST(floor(count(*) * {fx.INCREMENT_RATIO}::DOUBLE) AS BIGINT) FROM corpus_u8)",
        synth.SAMPLE_STREAM,
    ),
    "inc_renumbered": RENUMBERED.format(
        start="(SELECT max(id) + 1 FROM corpus_u8)", rows="inc_picked"
    ),
    "inc": noise_sql("inc_renumbered"),
}


@register(
    "incremental_generate", fx.sql(SHOWN.format(rows="inc"), "corpus_u8", **INCREMENT)
)
def incremental_generate(spark, folder):
    rows = fx.quantized_corpus(spark, folder)
    return shown(synth.incremental_generate(rows, fx.INCREMENT_RATIO))


@register(
    "zipf_scalar",
    fx.sql(
        f"""SELECT o_orderkey AS id, CAST((SELECT 1 + count(*) FROM cdf
                     WHERE cum <= {uniform_sql('o_orderkey', synth.ZIPF_STREAM)} AND k < 500)
                   AS INTEGER) AS eq_val
            FROM orders""",
        cdf="""SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS cum
               FROM (SELECT k, pow(k::DOUBLE, -1.2::DOUBLE) AS w FROM range(1, 501) r(k))""",
    ),
)
def zipf_scalar(spark, folder):
    rows = fx.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return synth.zipf_scalar(rows, "eq_val")


# ---------------------------------------------------------------- query generation

SAMPLED = {
    "batched": f"SELECT *, id // {BATCH_ROWS} AS batch FROM corpus",
    "quotas": f"""SELECT batch, quota FROM (
        SELECT *, coalesce(sum(quota) OVER (ORDER BY batch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
        FROM (SELECT batch, least(greatest(1, CAST(floor({PICKED} * (count(*)
                / (SELECT count(*) FROM corpus))) AS BIGINT)), count(*) - 1) AS quota
              FROM batched GROUP BY batch)) WHERE taken < {PICKED}""",
    "picked": f"""SELECT * FROM (SELECT b.*, q.quota, row_number() OVER (PARTITION BY b.batch
        ORDER BY {keyed_sql('b.id', querygen.PICK_STREAM)}, b.id) AS draw
        FROM batched b JOIN quotas q ON q.batch = b.batch) WHERE draw <= quota""",
    "sample": f"""SELECT *, row_number() OVER (ORDER BY id) AS num FROM (SELECT * FROM picked
        ORDER BY {keyed_sql('id', querygen.FINAL_STREAM)}, id LIMIT {PICKED})""",
}


def sampled(spark, folder, rows=None):
    rows = fx.corpus(spark, folder).drop("image_vec") if rows is None else rows
    scale = fx.plain_corpus(spark, folder).count()
    return querygen.query_sample(rows, PICKED, scale, BATCH_ROWS, first_id=0)


def generated(queries):
    one = F.col("f")
    return queries.select(
        "name", "vector_field", "reference_id", "limit",
        F.posexplode("scalar_filters").alias("pos", "f"),
    ).select(
        "name", "vector_field", "reference_id", "limit",
        F.col("pos").cast("bigint").alias("pos"), one["field"].alias("field"),
        one["operator"].alias("operator"),
        F.round(one["value"].cast("double"), 6).alias("value"), one["logic"].alias("logic"),
    )


def generated_sql(pos: int, field: str, operator: str, value: str, condition: str = "true") -> str:
    return f"""SELECT 'query' || num AS name, 'image_vec' AS vector_field, id AS reference_id,
        100 AS "limit", CAST({pos} AS BIGINT) AS pos, '{field}' AS field, '{operator}' AS operator,
        round(CAST({value} AS DOUBLE), 6) AS value, 'and' AS logic FROM sample WHERE {condition}"""


@register(
    "query_sample", fx.sql("SELECT num, id, eq_val, range_val FROM sample", "corpus", **SAMPLED)
)
def query_sample(spark, folder):
    return sampled(spark, folder).select("num", "id", "eq_val", "range_val")


@register(
    "querygen_equal", fx.sql(generated_sql(0, "eq_val", "==", "eq_val"), "corpus", **SAMPLED)
)
def querygen_equal(spark, folder):
    rows = fx.plain_corpus(spark, folder).drop("image_vec")
    return generated(querygen.equal_queries(sampled(spark, folder, rows)))


@register(
    "querygen_range",
    fx.sql(
        generated_sql(0, "range_val", ">", "range_val - 0.5")
        + " UNION ALL "
        + generated_sql(1, "range_val", "<", "range_val + 0.5"),
        "corpus", **SAMPLED,
    ),
)
def querygen_range(spark, folder):
    return generated(querygen.range_queries(sampled(spark, folder)))


@register(
    "querygen_contains",
    fx.sql(generated_sql(0, "tags", "contains", "tags[1]", "len(tags) > 0"), "corpus", **SAMPLED),
)
def querygen_contains(spark, folder):
    return generated(querygen.contains_queries(sampled(spark, folder)))
