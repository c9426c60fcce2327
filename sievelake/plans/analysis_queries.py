"""Registered queries: predicates, selectivity, correlation and rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import compile_filters
from ..operators import analysis, rewrite
from ..session import stored
from . import fixtures as fx
from .knn_queries import FOLD, MIXED, RANGE

QUERIES, SQL = {}, {}
DEPTH = 50
OVERRIDES = {"query1": 0.03, "query15": 0.005}
DEFAULT_RATE = 0.1


def register(key: str, oracle: str | None = None):
    def keep(build):
        QUERIES[key] = build
        if oracle is not None:
            SQL[key] = oracle
        return build

    return keep


def f(field, operator, value=None, logic="and"):
    return {"field": field, "operator": operator, "value": value, "logic": logic}


def passing(df: DataFrame, filters, *columns, **options) -> DataFrame:
    return df.where(compile_filters(df.schema, filters, **options)).select(*columns)


# ---------------------------------------------------------------- predicates


@register("filter_eq", fx.sql("SELECT id, eq_val FROM corpus WHERE eq_val = 3", "corpus"))
def filter_eq(spark, folder):
    return passing(fx.plain_corpus(spark, folder), [f("eq_val", "==", 3)], "id", "eq_val")


@register(
    "filter_range",
    fx.sql(
        """SELECT id, range_val, op FROM corpus, (VALUES ('<'), ('<='), ('>'), ('>=')) o(op)
           WHERE CASE op WHEN '<' THEN range_val < 150000 WHEN '<=' THEN range_val <= 150000
                         WHEN '>' THEN range_val > 150000 ELSE range_val >= 150000 END""",
        "corpus",
    ),
)
def filter_range(spark, folder):
    rows = fx.corpus(spark, folder)
    parts = [
        passing(rows, [f("range_val", op, 150000)], "id", "range_val").withColumn("op", F.lit(op))
        for op in ("<", "<=", ">", ">=")
    ]
    return reduce(DataFrame.unionByName, parts)


PATTERN = "(the|des) [a-z]+ (que|and|on)|[0-9]{3}-[0-9]{4}"


@register(
    "filter_like_regex",
    f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '{PATTERN}')",
)
def filter_like_regex(spark, folder):
    rows = fx.table(spark, folder, "documents")
    return passing(rows, [f("text", "like", PATTERN)], "doc_id", "lang")


@register(
    "filter_like_substring",
    "SELECT doc_id, lang FROM documents WHERE contains(text, 'tion le') AND contains(lang, 'f')",
)
def filter_like_substring(spark, folder):
    rows = fx.table(spark, folder, "documents")
    filters = [f("text", "like", "tion le"), f("lang", "like", "f")]
    return passing(rows, filters, "doc_id", "lang", like="substring")


@register(
    "filter_contains_tags",
    fx.sql(
        "SELECT id FROM corpus WHERE list_contains(tags, 23) OR list_contains(tags, 29)", "corpus"
    ),
)
def filter_contains_tags(spark, folder):
    filters = [f("tags", "contains", 23), f("tags", "contains", 29, "or")]
    return passing(fx.corpus(spark, folder), filters, "id")


@register(
    "filter_contains_text",
    "SELECT doc_id, n_chars FROM documents WHERE contains(text, ' que ')",
)
def filter_contains_text(spark, folder):
    rows = fx.table(spark, folder, "documents")
    return passing(rows, [f("text", "contains", " que ")], "doc_id", "n_chars")


@register(
    "filter_is_empty",
    fx.sql(
        """SELECT c.id, len(c.tags) = 0 AS no_tags, d.text IS NULL AS no_text
           FROM corpus c LEFT JOIN documents d ON d.doc_id = c.id * 3
           WHERE len(c.tags) = 0 OR d.text IS NULL""",
        "corpus",
    ),
)
def filter_is_empty(spark, folder):
    documents = fx.table(spark, folder, "documents").select(
        F.col("doc_id").alias("key"), "text"
    )
    rows = fx.corpus(spark, folder).join(documents, F.col("key") == F.col("id") * 3, "left")
    filters = [f("tags", "is_empty"), f("text", "==", None, "or")]
    return passing(
        rows,
        filters,
        "id",
        (F.size("tags") == 0).alias("no_tags"),
        F.col("text").isNull().alias("no_text"),
        empty_value_means_empty=True,
    )


@register(
    "filter_datetime_range",
    """SELECT o_orderkey FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-06-15'""",
)
def filter_datetime_range(spark, folder):
    filters = [f("o_orderdate", ">=", "1996-03-01"), f("o_orderdate", "<", "1997-06-15")]
    return passing(fx.table(spark, folder, "orders"), filters, "o_orderkey")


def counts_sql(condition: str, queries: str = "drawn") -> str:
    return fx.sql(
        f"""SELECT q.name, CAST(count(*) FILTER ({condition}) AS BIGINT) AS matched,
                   CAST(count(*) AS BIGINT) AS total
            FROM {queries} q CROSS JOIN corpus c GROUP BY q.name""",
        "drawn",
    )


BY_MODE = {
    "fold": FOLD,
    "sql": "(c.eq_val = q.eq_val OR c.range_val > q.range_val AND c.range_val < q.range_val + 60000.0)",
    "must_should": "(c.eq_val = q.eq_val AND c.range_val < q.range_val + 60000.0 AND c.range_val > q.range_val)",
}

for _key, _mode in {
    "filter_fold_left": "fold",
    "filter_sql_precedence": "sql",
    "filter_must_should": "must_should",
}.items():

    @register(_key, counts_sql(BY_MODE[_mode]))
    def combined(spark, folder, mode=_mode):
        rows = fx.corpus(spark, folder).drop("image_vec")
        return analysis.match_counts(rows, fx.q_three_terms(spark, folder), mode)


@register("filter_none", fx.sql("SELECT id, eq_val, range_val FROM corpus", "corpus"))
def filter_none(spark, folder):
    return passing(fx.corpus(spark, folder), [], "id", "eq_val", "range_val")


@register(
    "predicate_match_counts",
    fx.sql(
        """SELECT name || '/' || pos AS name, CAST(count(*) FILTER (passed) AS BIGINT) AS matched
           FROM (SELECT q.name, 0 AS pos, c.eq_val = q.eq_val AS passed FROM drawn q, corpus c
                 UNION ALL SELECT q.name, 1, c.range_val > q.range_val FROM drawn q, corpus c
                 UNION ALL SELECT q.name, 2, c.range_val < q.range_val + 60000.0
                 FROM drawn q, corpus c)
           GROUP BY ALL""",
        "drawn",
    ),
)
def predicate_match_counts(spark, folder):
    """Matched rows of every single condition of the query set."""
    queries = fx.q_three_terms(spark, folder)
    single = queries.select(
        "name", "vector_field", "reference_id", "limit",
        F.posexplode("scalar_filters").alias("pos", "one"),
    ).select(
        F.concat("name", F.lit("/"), F.col("pos").cast("string")).alias("name"),
        "vector_field", "reference_id", F.array("one").alias("scalar_filters"), "limit",
    )
    rows = fx.corpus(spark, folder).drop("image_vec")
    return analysis.match_counts(rows, single).select("name", "matched")


# ---------------------------------------------------------------- rates


def rates(df: DataFrame) -> DataFrame:
    return df.select("field", "value", "cnt", F.round("selectivity", 6).alias("selectivity"))


@register(
    "filter_rate_scalar",
    fx.sql(
        """SELECT field, value, CAST(count(*) AS BIGINT) AS cnt,
                  round(count(*) / (SELECT count(*) FROM corpus), 6) AS selectivity
           FROM (SELECT 'eq_val' AS field, CAST(eq_val AS DOUBLE) AS value FROM corpus
                 UNION ALL SELECT 'range_val', range_val FROM corpus)
           GROUP BY field, value""",
        "corpus",
    ),
)
def filter_rate_scalar(spark, folder):
    rows = fx.corpus(spark, folder)
    return rates(analysis.filter_rates(rows, ["eq_val", "range_val"]))


TAG_RATES = """SELECT 'tags' AS field, CAST(t AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS cnt,
  round(count(*) / (SELECT {total} FROM corpus), 6) AS selectivity
  FROM (SELECT unnest(tags) AS t FROM corpus) GROUP BY t"""


@register(
    "filter_rate_tags_occurrences", fx.sql(TAG_RATES.format(total="sum(len(tags))"), "corpus")
)
def filter_rate_tags_occurrences(spark, folder):
    return rates(analysis.tag_rates(fx.corpus(spark, folder)))


@register("filter_rate_tags_rows", fx.sql(TAG_RATES.format(total="count(*)"), "corpus"))
def filter_rate_tags_rows(spark, folder):
    return rates(analysis.tag_rates(fx.corpus(spark, folder), denominator="rows"))


@register(
    "query_filter_fields",
    fx.sql(
        """SELECT DISTINCT field FROM (
             SELECT 'eq_val' AS field FROM drawn UNION ALL SELECT 'range_val' FROM drawn
             UNION ALL SELECT 'tags' FROM drawn WHERE len(tags) > 0)""",
        "drawn",
    ),
)
def query_filter_fields(spark, folder):
    return analysis.filter_fields(fx.q_all_sets(spark, folder))


@register(
    "relevance_targets",
    fx.sql(
        """SELECT 'equal/' || name AS name, id AS reference_id, 'image_vec' AS vector_field,
                  'eq_val' AS field FROM drawn
           UNION ALL
           SELECT 'limits/' || name, id, 'image_vec', 'eq_val' FROM drawn""",
        "drawn",
    ),
)
def relevance_targets(spark, folder):
    return analysis.relevance_targets(fx.q_all_sets(spark, folder))


NEAR = f"""SELECT name, id, eq_val, range_val, tags FROM (
  SELECT q.name, c.id, c.eq_val, c.range_val, c.tags, row_number() OVER (PARTITION BY q.name
           ORDER BY list_distance(CAST(c.image_vec AS DOUBLE[]), q.ref), c.id) AS place
  FROM drawn q CROSS JOIN corpus c) WHERE place <= {DEPTH}"""
RELEVANCE = "SELECT name, CAST({value} AS DOUBLE) AS value, count(*) AS cnt FROM near GROUP BY ALL"


@register(
    "relevance_distribution",
    fx.sql(
        f"""SELECT name, value, CAST(cnt AS BIGINT) AS cnt,
                   round(cnt / sum(cnt) OVER (PARTITION BY name), 6) AS selectivity FROM relevance""",
        "drawn", near=NEAR, relevance=RELEVANCE.format(value="eq_val"),
    ),
)
def relevance_distribution(spark, folder):
    rows = fx.plain_corpus(spark, folder)
    found = analysis.relevance_distribution(rows, fx.q_equal(spark, folder), DEPTH)
    return found.select("name", "value", "cnt", F.round("selectivity", 6).alias("selectivity"))


@register(
    "query_selectivity",
    fx.sql(
        f"""SELECT q.name, CAST(count(*) FILTER ({MIXED}) AS BIGINT) AS matched,
                   round(count(*) FILTER ({MIXED}) / count(*), 6) AS selectivity
            FROM drawn q CROSS JOIN corpus c GROUP BY q.name""",
        "drawn",
    ),
)
def query_selectivity(spark, folder):
    rows = fx.corpus(spark, folder).drop("image_vec")
    found = analysis.query_selectivity(rows, fx.q_mixed(spark, folder))
    return found.select("name", "matched", F.round("selectivity", 6).alias("selectivity"))


@register(
    "query_filter_correlation",
    fx.sql(
        f"""SELECT q.name, round(avg(CASE WHEN {MIXED} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS relevance
            FROM drawn q JOIN near c ON c.name = q.name GROUP BY q.name""",
        "drawn", near=NEAR,
    ),
)
def query_filter_correlation(spark, folder):
    found = analysis.query_filter_correlation(
        fx.corpus(spark, folder), fx.q_mixed(spark, folder), DEPTH,
        references=fx.plain_corpus(spark, folder),
    )
    return found.select("name", F.round("relevance", 6).alias("relevance"))


# ---------------------------------------------------------------- rewriting

TARGET = "CASE q.name WHEN 'query1' THEN 0.03 WHEN 'query15' THEN 0.005 ELSE 0.1 END::DOUBLE"
RUNNING = """SELECT value, cnt, sum(cnt) OVER (ORDER BY value) AS upto, sum(cnt) OVER () AS total
  FROM (SELECT {value} AS value, count(*) AS cnt FROM {rows} GROUP BY ALL)"""
CHOSEN = f"(r.upto - r.cnt < {TARGET} * r.total OR r.upto = r.cnt)"


def targets(queries: DataFrame) -> DataFrame:
    return rewrite.rewrite_targets(queries, DEFAULT_RATE, OVERRIDES)


def shown(rewritten: DataFrame) -> DataFrame:
    return rewritten.select(
        "name",
        F.col("pos").cast("bigint").alias("pos"),
        "field",
        "operator",
        F.round(F.col("value").cast("double"), 6).alias("value"),
        "logic",
    )


@register(
    "rewrite_targets",
    fx.sql(f"SELECT q.name, {TARGET} AS target FROM drawn q", "drawn"),
)
def rewrite_targets(spark, folder):
    return targets(fx.q_equal(spark, folder))


@register(
    "rewrite_filter_rate_eq",
    fx.sql(
        f"""SELECT q.name, CAST(0 AS BIGINT) AS pos, 'eq_val' AS field, '==' AS operator,
                   round(r.value, 6) AS value, 'or' AS logic
            FROM drawn q JOIN running r ON {CHOSEN}""",
        "drawn", running=RUNNING.format(value="CAST(eq_val AS DOUBLE)", rows="corpus"),
    ),
)
def rewrite_filter_rate_eq(spark, folder):
    rows = fx.plain_corpus(spark, folder)
    queries = stored(fx.q_equal(spark, folder), "queries")
    found = analysis.filter_rates(rows, ["eq_val"])
    return shown(rewrite.rewrite_by_filter_rate(queries, found, targets(queries)))


@register(
    "rewrite_filter_rate_contains",
    fx.sql(
        f"""SELECT q.name, CAST(0 AS BIGINT) AS pos, 'tags' AS field, 'contains' AS operator,
                   round(r.value, 6) AS value, 'or' AS logic
            FROM drawn q JOIN running r ON {CHOSEN} WHERE len(q.tags) > 0""",
        "drawn",
        running=RUNNING.format(
            value="CAST(t AS DOUBLE)", rows="(SELECT unnest(tags) AS t FROM corpus)"
        ),
    ),
)
def rewrite_filter_rate_contains(spark, folder):
    queries = stored(fx.q_contains(spark, folder), "queries")
    found = analysis.tag_rates(fx.corpus(spark, folder))
    return shown(rewrite.rewrite_by_filter_rate(queries, found, targets(queries)))


@register(
    "rewrite_filter_rate_range",
    fx.sql(
        f"""SELECT name, CAST(pos AS BIGINT) AS pos, 'range_val' AS field,
                   CASE pos WHEN 0 THEN '>=' ELSE '<=' END AS operator,
                   round(CASE pos WHEN 0 THEN low ELSE high END, 6) AS value, 'and' AS logic
            FROM (SELECT q.name, min(r.value) AS low, max(r.value) FILTER ({CHOSEN}) AS high
                  FROM drawn q CROSS JOIN running r GROUP BY q.name), (VALUES (0), (1)) p(pos)""",
        "drawn", running=RUNNING.format(value="range_val", rows="corpus"),
    ),
)
def rewrite_filter_rate_range(spark, folder):
    queries = stored(fx.q_range(spark, folder), "queries")
    found = analysis.filter_rates(fx.corpus(spark, folder), ["range_val"])
    return shown(rewrite.rewrite_by_filter_rate(queries, found, targets(queries)))


WALK = """SELECT *, sum(cnt) OVER (PARTITION BY name ORDER BY value) AS upto,
  sum(cnt) OVER (PARTITION BY name) AS total FROM relevance"""


@register(
    "rewrite_relevance_eq",
    fx.sql(
        f"""SELECT q.name, CAST(0 AS BIGINT) AS pos, 'eq_val' AS field, '==' AS operator,
                   round(r.value, 6) AS value, 'or' AS logic
            FROM drawn q JOIN running r ON r.name = q.name AND {CHOSEN}""",
        "drawn", near=NEAR, relevance=RELEVANCE.format(value="eq_val"), running=WALK,
    ),
)
def rewrite_relevance_eq(spark, folder):
    queries = stored(fx.q_equal(spark, folder), "queries")
    found = analysis.relevance_distribution(fx.plain_corpus(spark, folder), queries, DEPTH)
    return shown(rewrite.rewrite_by_relevance(queries, found, targets(queries)))


@register(
    "rewrite_relevance_range",
    fx.sql(
        f"""SELECT q.name, CAST(0 AS BIGINT) AS pos, 'range_val' AS field,
                   CASE q.num % 2 WHEN 0 THEN '<=' ELSE '>=' END AS operator,
                   round(max(r.value), 6) AS value, 'and' AS logic
            FROM drawn q JOIN running r ON r.name = q.name AND {CHOSEN} GROUP BY q.name, q.num""",
        "drawn", near=NEAR, relevance=RELEVANCE.format(value="range_val"), running=WALK,
    ),
)
def rewrite_relevance_range(spark, folder):
    rows = fx.corpus(spark, folder)
    queries = stored(fx.q_one_bound(spark, folder), "queries")
    found = analysis.relevance_distribution(
        rows, queries, DEPTH, references=fx.plain_corpus(spark, folder)
    )
    return shown(rewrite.rewrite_by_relevance(queries, found, targets(queries)))


# ---------------------------------------------------------------- whole rewrites

LISTED = """SELECT name, count(*) AS n_filters, round(min(value), 6) AS least, round(max(value), 6) AS most,
    string_agg(DISTINCT field || operator || logic, ',' ORDER BY field || operator || logic) AS forms
  FROM entries GROUP BY name"""


def listed(queries: DataFrame) -> DataFrame:
    """A digest of the filters of each query."""
    entries = queries.select("name", F.explode("scalar_filters").alias("f"))
    value = F.col("f.value").cast("double")
    forms = F.array_sort(F.collect_set(F.concat("f.field", "f.operator", "f.logic")))
    return entries.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_filters"), F.round(F.min(value), 6).alias("least"),
        F.round(F.max(value), 6).alias("most"), F.array_join(forms, ",").alias("forms"),
    )


SET_TARGET = "CASE q.name WHEN 'query1' THEN 0.03 WHEN 'query15' THEN 0.5 END::DOUBLE"
SET_CHOSEN = f"(r.upto - r.cnt < {SET_TARGET} * r.total OR r.upto = r.cnt)"


@register(
    "modified_queries_filter_rate",
    fx.sql(
        LISTED, "drawn", running=RUNNING.format(value="CAST(eq_val AS DOUBLE)", rows="corpus"),
        entries=f"""SELECT q.name, 'eq_val' AS field, '==' AS operator, r.value, 'or' AS logic
            FROM drawn q JOIN running r ON {SET_CHOSEN} WHERE {SET_TARGET} IS NOT NULL
            UNION ALL SELECT q.name, 'eq_val', '==', CAST(eq_val AS DOUBLE), 'and' FROM drawn q WHERE {SET_TARGET} IS NULL""",
    ),
)
def modified_queries_filter_rate(spark, folder):
    """Targets for two queries; the others keep their filters."""
    return listed(
        rewrite.modified_queries(
            fx.plain_corpus(spark, folder), fx.q_equal(spark, folder), overrides={"query1": 0.03, "query15": 0.5}
        )
    )


@register(
    "modified_queries_tags",
    fx.sql(
        LISTED, "drawn",
        running=RUNNING.format(value="CAST(t AS DOUBLE)", rows="(SELECT unnest(tags) AS t FROM corpus)"),
        entries=f"""SELECT q.name, 'tags' AS field, 'contains' AS operator, r.value, 'or' AS logic
            FROM drawn q JOIN running r ON {CHOSEN} WHERE len(q.tags) > 0""",
    ),
)
def modified_queries_tags(spark, folder):
    return listed(
        rewrite.modified_queries(
            fx.corpus(spark, folder), fx.q_contains(spark, folder), default=DEFAULT_RATE, overrides=OVERRIDES
        )
    )


@register(
    "modified_queries_relevance",
    fx.sql(
        LISTED, "drawn", near=NEAR, relevance=RELEVANCE.format(value="eq_val"), running=WALK,
        entries=f"""SELECT q.name, 'eq_val' AS field, '==' AS operator, CAST(r.value AS DOUBLE) AS value, 'or' AS logic
            FROM drawn q JOIN running r ON r.name = q.name AND {CHOSEN}""",
    ),
)
def modified_queries_relevance(spark, folder):
    return listed(
        rewrite.modified_queries(
            fx.plain_corpus(spark, folder), fx.q_equal(spark, folder), "relevance", DEFAULT_RATE, OVERRIDES, DEPTH
        )
    )
