"""Registered queries: approximate search and its score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import SPAN
from ..operators import ann, cellindex, knn, metrics, summaries
from ..session import scratch_path
from . import fixtures as fx
from .knn_queries import DIST, MIXED, RANGE, rounded
from .sqltext import keyed_sql

QUERIES, SQL = {}, {}
PROBES = [1, 1, 2, 5, 10, 20]
TABLES, BITS, DIMENSION = 4, 4, 64


def register(key: str, oracle: str | None = None):
    def keep(build):
        QUERIES[key] = build
        if oracle is not None:
            SQL[key] = oracle
        return build

    return keep


ASSIGNED = """SELECT id, cell, image_vec, eq_val FROM (
  SELECT c.id, k.cell, c.image_vec, c.eq_val, row_number() OVER (PARTITION BY c.id
           ORDER BY list_distance(CAST(c.image_vec AS DOUBLE[]), k.centre), k.cell) AS place
  FROM corpus c CROSS JOIN centroids k) WHERE place = 1"""
PROBED = """SELECT q.name, k.cell, row_number() OVER (PARTITION BY q.name
              ORDER BY list_distance(q.ref, k.centre), k.cell) AS cell_rank
  FROM drawn q CROSS JOIN centroids k"""
SWEEP = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {p})" for i, p in enumerate(PROBES)) + (
    ") s(sweep_pos, param)"
)
FOUND = f"""SELECT s.sweep_pos, s.param, q.name, c.id, {DIST} AS dist,
    row_number() OVER (PARTITION BY s.sweep_pos, q.name ORDER BY {DIST}, c.id) AS rank
  FROM sweep s JOIN probed p ON p.cell_rank <= s.param JOIN drawn q ON q.name = p.name
  JOIN assigned c ON c.cell = p.cell AND c.eq_val = q.eq_val"""
TRUTH = f"""SELECT name, id FROM (
  SELECT q.name, c.id, row_number() OVER (PARTITION BY q.name ORDER BY {DIST}, c.id) AS rank
  FROM drawn q JOIN corpus c ON c.eq_val = q.eq_val) WHERE rank <= 10"""
RECALLS = """SELECT s.sweep_pos, s.param, t.name,
    count(f.id) / count(*) AS recall
  FROM sweep s CROSS JOIN truth t LEFT JOIN (SELECT * FROM found WHERE rank <= 10) f
    ON f.sweep_pos = s.sweep_pos AND f.name = t.name AND f.id = t.id
  GROUP BY s.sweep_pos, s.param, t.name"""
IVF = {"assigned": ASSIGNED, "probed": PROBED, "sweep": SWEEP, "found": FOUND}


def sweep_recalls(spark, folder):
    rows, queries = fx.plain_corpus(spark, folder), fx.q_equal(spark, folder)
    centres = fx.centroids(spark, folder)
    found = ann.ivf_sweep(
        ann.ivf_assign(rows, centres), queries, centres, PROBES, references=rows
    )
    wanted = ann.with_sweep(queries.select("name"), PROBES)
    return metrics.recall_at_k(
        knn.knn_batch(rows, queries), found, wanted, ("sweep_pos", "param", "name")
    )


@register("ivf_assign", fx.sql("SELECT id, cell FROM assigned", "centroids", assigned=ASSIGNED))
def ivf_assign(spark, folder):
    centres = fx.centroids(spark, folder)
    return ann.ivf_assign(fx.plain_corpus(spark, folder), centres).select("id", "cell")


@register(
    "ivf_search_filtered",
    fx.sql(
        """SELECT name, rank, id, round(dist, 6) AS dist FROM found
           WHERE rank <= 10 AND sweep_pos = 3""",
        "drawn", "centroids", **IVF,
    ),
)
def ivf_search_filtered(spark, folder):
    rows, centres = fx.plain_corpus(spark, folder), fx.centroids(spark, folder)
    found = ann.ivf_search(
        ann.ivf_assign(rows, centres), fx.q_equal(spark, folder), centres, PROBES[3],
        references=rows,
    )
    return rounded(found)


@register(
    "ivf_sweep_recall",
    fx.sql(
        "SELECT sweep_pos, param, name, round(recall, 6) AS recall FROM recalls",
        "drawn", "centroids", **IVF, truth=TRUTH, recalls=RECALLS,
    ),
)
def ivf_sweep_recall(spark, folder):
    return sweep_recalls(spark, folder).withColumn("recall", F.round("recall", 6))


@register(
    "recall_at_k",
    fx.sql(
        "SELECT name, round(recall, 6) AS recall FROM recalls WHERE sweep_pos = 2",
        "drawn", "centroids", **IVF, truth=TRUTH, recalls=RECALLS,
    ),
)
def recall_at_k(spark, folder):
    rows, queries = fx.plain_corpus(spark, folder), fx.q_equal(spark, folder)
    centres = fx.centroids(spark, folder)
    found = ann.ivf_search(
        ann.ivf_assign(rows, centres), queries, centres, PROBES[2], references=rows
    )
    scored = metrics.recall_at_k(knn.knn_batch(rows, queries), found, queries)
    return scored.withColumn("recall", F.round("recall", 6))


@register(
    "recall_qps_curve",
    fx.sql(
        """SELECT r.sweep_pos, r.param, r.avg_recall, round(l.qps, 6) AS qps
           FROM (SELECT sweep_pos, param, round(avg(recall), 6) AS avg_recall FROM recalls
                 GROUP BY ALL) r
           JOIN (SELECT sweep_pos, count(*) FILTER (ok)
                   / ((max(start_us + exec_time * 1e6) - min(start_us)) / 1e6) AS qps
                 FROM run_log GROUP BY sweep_pos) l ON l.sweep_pos = r.sweep_pos""",
        "drawn", "centroids", "run_log", **IVF, truth=TRUTH, recalls=RECALLS,
    ),
)
def recall_qps_curve(spark, folder):
    curve = metrics.recall_qps_curve(sweep_recalls(spark, folder), fx.run_log(spark, folder))
    return curve.select(
        "sweep_pos",
        "param",
        F.round("avg_recall", 6).alias("avg_recall"),
        F.round("qps", 6).alias("qps"),
    )


PLANES = f"""SELECT t, b, list_transform(range({DIMENSION}), lambda i:
    2.0::DOUBLE * ({keyed_sql(f'(i * {TABLES * BITS} + t * {BITS} + b)')} / {SPAN}::DOUBLE)
    - 1.0::DOUBLE) AS plane FROM range({TABLES}) x(t), range({BITS}) y(b)"""
CODES = """SELECT {id} AS id, t, sum(CASE WHEN list_inner_product({vec}, plane) > 0
    THEN 1 << b ELSE 0 END) AS code FROM {rows} CROSS JOIN planes GROUP BY {id}, t"""
COSINE = "list_cosine_distance(CAST(c.image_vec AS DOUBLE[]), q.ref)"


@register(
    "lsh_search_filtered",
    fx.sql(
        f"""SELECT name, rank, id, round(dist, 6) AS dist FROM (
              SELECT q.name, c.id, {COSINE} AS dist,
                     row_number() OVER (PARTITION BY q.name ORDER BY {COSINE}, c.id) AS rank
              FROM candidates x JOIN drawn q ON q.name = x.name
              JOIN corpus c ON c.id = x.id AND c.eq_val = q.eq_val) WHERE rank <= 10""",
        "drawn",
        planes=PLANES,
        row_codes=CODES.format(id="id", vec="CAST(image_vec AS DOUBLE[])", rows="corpus"),
        query_codes=CODES.format(id="name", vec="ref", rows="drawn"),
        candidates="""SELECT DISTINCT b.id AS name, a.id FROM row_codes a
                      JOIN query_codes b ON a.t = b.t AND a.code = b.code""",
    ),
)
def lsh_search_filtered(spark, folder):
    rows = fx.plain_corpus(spark, folder)
    planes = ann.sign_planes(DIMENSION, TABLES, BITS)
    found = ann.lsh_search(
        ann.lsh_index(rows, planes), fx.q_equal(spark, folder), planes, references=rows
    )
    return rounded(found)


# ---------------------------------------------------------------- stored index

EDGES = 8
SLACK = 2.0


def stored_index(spark, folder, rows, edges=None):
    counted = [c for c in ("eq_val", "tags") if c in rows.columns]
    path = scratch_path(spark, "cell-index")
    return cellindex.build(rows, fx.centroids(spark, folder), path, counted=counted, edges=edges)


#: Cells nearest first without those that hold no match, until the matches before a cell suffice.
MATCHING = f"""SELECT q.name, n.cell, sum(m.n) OVER (PARTITION BY q.name ORDER BY n.cell_rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    row_number() OVER (PARTITION BY q.name ORDER BY n.cell_rank) AS place
  FROM drawn q JOIN probed n ON n.name = q.name JOIN promised m ON m.name = q.name AND m.cell = n.cell WHERE m.n > 0"""
MATCHED = """SELECT name, rank, id, round(dist, 6) AS dist FROM (
    SELECT q.name, c.id, {dist} AS dist, row_number() OVER (PARTITION BY q.name ORDER BY {dist}, c.id) AS rank
    FROM matching p JOIN drawn q ON q.name = p.name JOIN placed c ON c.cell = p.cell AND {test}
    WHERE p.place = 1 OR p.before < {enough}) WHERE rank <= 10"""
PLACED = """SELECT c.*, a.cell FROM corpus c JOIN assigned a ON a.id = c.id"""


def matching_sql(test: str, promised: str) -> str:
    return fx.sql(
        MATCHED.format(dist=DIST, test=test, enough=SLACK * 10),
        "drawn", "centroids", assigned=ASSIGNED, placed=PLACED, probed=PROBED,
        promised=promised, matching=MATCHING,
    )


def promised_rows(test: str) -> str:
    return f"SELECT q.name, c.cell, count(*) AS n FROM drawn q JOIN placed c ON {test} GROUP BY ALL"


@register("ivf_search_matching", matching_sql("c.eq_val = q.eq_val", promised_rows("c.eq_val = q.eq_val")))
def ivf_search_matching(spark, folder):
    """Every query gets as many rows as in the exact search, from cells that hold matches."""
    rows = fx.plain_corpus(spark, folder)
    index = stored_index(spark, folder, rows)
    return rounded(index.search_matching(fx.q_equal(spark, folder), slack=SLACK, references=rows))


HAS_TAG = "len(q.tags) > 0 AND list_contains(c.tags, q.tags[1])"


@register("ivf_search_matching_tags", matching_sql(HAS_TAG, promised_rows(HAS_TAG)))
def ivf_search_matching_tags(spark, folder):
    rows = fx.corpus(spark, folder)
    index = stored_index(spark, folder, rows)
    return rounded(index.search_matching(fx.q_contains(spark, folder), slack=SLACK, references=rows))


SUMMARY = f"""SELECT cell, '' AS field, 'all' AS kind, '' AS key, count(*) AS rows FROM placed GROUP BY cell
  UNION ALL SELECT cell, 'eq_val', 'value', eq_val::VARCHAR, count(*) FROM placed GROUP BY ALL
  UNION ALL SELECT cell, 'tags', 'value', tag::VARCHAR, count(*)
    FROM (SELECT cell, unnest(tags) AS tag FROM placed) GROUP BY ALL
  UNION ALL SELECT cell, 'range_val', 'interval',
      len(list_filter([i * 60000.0::DOUBLE FOR i IN range({EDGES})], lambda e: e <= range_val))::VARCHAR, count(*)
    FROM placed GROUP BY ALL"""


@register("cell_summaries", fx.sql(SUMMARY, "centroids", assigned=ASSIGNED, placed=PLACED))
def cell_summaries(spark, folder):
    """Counts per cell after two appends, merged from what each of them wrote."""
    rows = fx.corpus(spark, folder)
    edges = {"range_val": [i * 60000.0 for i in range(EDGES)]}
    index = stored_index(spark, folder, rows.where("id % 3 = 0"), edges)
    index = index.append(rows.where("id % 3 = 1")).append(rows.where("id % 3 = 2"))
    return index.summaries()


GROWN = f"""SELECT name, rank, id, round(dist, 6) AS dist FROM (
    SELECT q.name, c.id, {DIST} AS dist, row_number() OVER (PARTITION BY q.name ORDER BY {DIST}, c.id) AS rank
    FROM drawn q JOIN probed p ON p.name = q.name AND p.cell_rank <= {PROBES[3]}
    JOIN placed c ON c.cell = p.cell AND c.eq_val = q.eq_val AND c.id % 7 <> 3) WHERE rank <= 10"""


@register(
    "ivf_search_grown",
    fx.sql(GROWN, "drawn", "centroids", assigned=ASSIGNED, placed=PLACED, probed=PROBED),
)
def ivf_search_grown(spark, folder):
    """Search after a build with half of the rows, an append of the others and a delete."""
    rows = fx.plain_corpus(spark, folder)
    index = stored_index(spark, folder, rows.where("id % 2 = 0")).append(rows.where("id % 2 = 1"))
    index = index.delete(rows.select("id").where("id % 7 = 3"))
    return rounded(index.search(fx.q_equal(spark, folder), PROBES[3], references=rows))


def exact_sql(condition: str) -> str:
    return fx.sql(
        f"""SELECT name, rank, id, round(dist, 6) AS dist FROM (
              SELECT q.name, c.id, {DIST} AS dist, row_number() OVER (PARTITION BY q.name ORDER BY {DIST}, c.id) AS rank
              FROM drawn q JOIN corpus c ON {condition}) WHERE rank <= 10""",
        "drawn",
    )


def exact_by_cells(spark, folder, rows, queries):
    edges = summaries.quantile_edges(rows, ["range_val"], EDGES) if "range_val" in rows.columns else None
    index = stored_index(spark, folder, rows, edges)
    return rounded(index.search_exact(queries, references=rows))


@register("knn_cells_equal", exact_sql("c.eq_val = q.eq_val"))
def knn_cells_equal(spark, folder):
    return exact_by_cells(spark, folder, fx.plain_corpus(spark, folder), fx.q_equal(spark, folder))


@register("knn_cells_range", exact_sql(RANGE))
def knn_cells_range(spark, folder):
    return exact_by_cells(spark, folder, fx.corpus(spark, folder), fx.q_range(spark, folder))


@register("knn_cells_mixed", exact_sql(MIXED))
def knn_cells_mixed(spark, folder):
    return exact_by_cells(spark, folder, fx.corpus(spark, folder), fx.q_mixed(spark, folder))
