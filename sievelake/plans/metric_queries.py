"""Registered queries: execution logs, histograms and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..session import scratch_path
from . import fixtures as fx

QUERIES, SQL = {}, {}
DIGITS = 12


def register(key: str, oracle: str | None = None):
    def keep(build):
        QUERIES[key] = build
        if oracle is not None:
            SQL[key] = oracle
        return build

    return keep


STATS = """SELECT sweep_pos, param, name, avg(exec_time) AS avg_time, min(exec_time) AS min_time,
  max(exec_time) AS max_time, avg(recall) AS avg_recall FROM {rows} GROUP BY ALL"""
QPS = """SELECT sweep_pos, param, CAST(count(*) FILTER (ok) AS BIGINT) AS executions,
  (max(start_us + exec_time * 1e6) - min(start_us)) / 1e6 AS seconds FROM run_log GROUP BY ALL"""


def rounded_all(df, *names, digits=DIGITS):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


def stats(spark, folder):
    return metrics.query_run_stats(fx.run_log(spark, folder))


@register(
    "query_run_stats",
    fx.sql(
        f"""SELECT sweep_pos, param, name, round(avg_time, {DIGITS}) AS avg_time, min_time, max_time,
              round(avg_recall, {DIGITS}) AS avg_recall,
              round(avg_time - min_time, {DIGITS}) AS delta_minus,
              round(max_time - avg_time, {DIGITS}) AS delta_plus FROM stats""",
        "run_log", stats=STATS.format(rows="run_log"),
    ),
)
def query_run_stats(spark, folder):
    return rounded_all(
        stats(spark, folder), "avg_time", "avg_recall", "delta_minus", "delta_plus"
    )


def _percentiles(column: str, kind: str) -> str:
    return ", ".join(
        f"round(quantile_cont({column}, {p / 100.0}), 4) AS p{p}_{kind}" for p in metrics.PERCENTS
    )


@register(
    "overall_percentiles",
    fx.sql(
        f"""SELECT sweep_pos, param, round(avg(avg_time), 4) AS avg_latency,
              round(avg(avg_recall), 4) AS avg_recall, {_percentiles('avg_time', 'latency')},
              {_percentiles('avg_recall', 'recall')} FROM stats GROUP BY sweep_pos, param""",
        "run_log", stats=STATS.format(rows="run_log"),
    ),
)
def overall_percentiles(spark, folder):
    return metrics.overall_percentiles(stats(spark, folder))


@register(
    "qps_by_param",
    fx.sql(
        """SELECT sweep_pos, param, executions, round(seconds, 6) AS seconds,
                  round(CASE WHEN seconds > 0 THEN executions / seconds ELSE 0.0 END, 6) AS qps
           FROM qps""",
        "run_log", qps=QPS,
    ),
)
def qps_by_param(spark, folder):
    return rounded_all(
        metrics.qps_by_param(fx.run_log(spark, folder)), "seconds", "qps", digits=6
    )


@register(
    "concurrent_query_stats",
    fx.sql(
        f"""SELECT s.sweep_pos, s.param, s.name, round(s.avg_time, {DIGITS}) AS avg_time, s.min_time,
              s.max_time, round(s.avg_recall, {DIGITS}) AS avg_recall,
              round(q.executions / q.seconds, 6) AS qps, CAST(50 AS BIGINT) AS concurrency
            FROM stats s JOIN qps q ON q.sweep_pos = s.sweep_pos""",
        "run_log", stats=STATS.format(rows="run_log WHERE ok"), qps=QPS,
    ),
)
def concurrent_query_stats(spark, folder):
    found = metrics.concurrent_query_stats(fx.run_log(spark, folder), 50)
    return rounded_all(rounded_all(found, "avg_time", "avg_recall"), "qps", digits=6)


@register(
    "missing_ground_truth",
    fx.sql("SELECT name FROM drawn WHERE len(tags) = 0", "drawn"),
)
def missing_ground_truth(spark, folder):
    """Equality queries that have no truth among the containment queries."""
    truth = fx.q_contains(spark, folder).select("name", F.col("reference_id").alias("id"))
    rows = fx.plain_corpus(spark, folder)
    return metrics.missing_ground_truth(fx.q_equal(spark, folder, rows), truth)


BINNED = """SELECT CAST(e.bin AS INTEGER) AS bin, round({low}, 6) AS low, round({high}, 6) AS high,
    CAST(count(b.x) AS BIGINT) AS cnt
  FROM (SELECT bin, lo + bin * (hi - lo) / 14 AS l,
               CASE WHEN bin = 13 THEN hi ELSE lo + (bin + 1) * (hi - lo) / 14 END AS h
        FROM range(14) r(bin), ends) e
  LEFT JOIN (SELECT x, least(CAST(floor((x - lo) / (hi - lo) * 14) AS BIGINT), 13) AS bin
             FROM vals, ends) b ON b.bin = e.bin GROUP BY ALL"""
ENDS = "SELECT min(x) AS lo, max(x) AS hi FROM vals"


@register(
    "recall_histogram",
    fx.sql(
        BINNED.format(low="e.l", high="e.h"), "run_log", stats=STATS.format(rows="run_log"),
        vals="SELECT avg_recall AS x FROM stats", ends=ENDS,
    ),
)
def recall_histogram(spark, folder):
    return rounded_all(metrics.recall_histogram(stats(spark, folder)), "low", "high", digits=6)


@register(
    "latency_histogram",
    fx.sql(
        BINNED.format(low="pow(10.0::DOUBLE, e.l)", high="pow(10.0::DOUBLE, e.h)"), "run_log",
        stats=STATS.format(rows="run_log"),
        vals="SELECT log10(avg_time) AS x FROM stats WHERE avg_time >= 1e-9", ends=ENDS,
    ),
)
def latency_histogram(spark, folder):
    return rounded_all(metrics.latency_histogram(stats(spark, folder)), "low", "high", digits=6)


def reported(spark, df, label, schema):
    """Write a report as CSV and read it back."""
    path = scratch_path(spark, label)
    metrics.write_report(df, path)
    return spark.read.schema(schema).option("header", True).csv(path)


REPORT = f"""SELECT name, round(avg_recall, {DIGITS}) AS avg_recall,
  round(avg_time, {DIGITS}) AS avg_time FROM stats"""


@register(
    "results_by_recall", fx.sql(REPORT, "run_log", stats=STATS.format(rows="run_log"))
)
def results_by_recall(spark, folder):
    df = metrics.results_by_recall(rounded_all(stats(spark, folder), "avg_recall", "avg_time"))
    return reported(spark, df, "by-recall", "name string, avg_recall double, avg_time double")


@register(
    "results_by_latency", fx.sql(REPORT, "run_log", stats=STATS.format(rows="run_log"))
)
def results_by_latency(spark, folder):
    df = metrics.results_by_latency(rounded_all(stats(spark, folder), "avg_recall", "avg_time"))
    return reported(spark, df, "by-latency", "name string, avg_time double, avg_recall double")
