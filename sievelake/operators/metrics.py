"""Score approximate results and summarise execution logs."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import local_table

PERCENTS = (1, 5, 25, 50, 95, 99)
BINS = 14
LEAST_LATENCY = 1e-9


# ---------------------------------------------------------------- recall


def recall_at_k(
    truth: DataFrame, result: DataFrame, queries: DataFrame, keys: Sequence[str] = ("name",)
) -> DataFrame:
    """Share of a query's distinct true ids that were found; 0 when it has none.

    ``keys`` may name further columns of ``queries`` and ``result``, such as a sweep position.
    """
    keys = list(keys)
    wanted = queries.select(*keys).distinct()
    expected = wanted.join(truth.select("name", "id").distinct(), "name")
    found = result.select(*keys, "id").distinct().withColumn("hit", F.lit(1.0))
    scored = expected.join(found, [*keys, "id"], "left")
    recalls = scored.groupBy(*keys).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    return wanted.join(recalls, keys, "left").select(
        *keys, F.coalesce("recall", F.lit(0.0)).alias("recall")
    )


def missing_ground_truth(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries without ground truth: an error when strict, skipped when lenient."""
    return queries.select("name").join(truth.select("name").distinct(), "name", "left_anti")


def with_ground_truth(queries: DataFrame, truth: DataFrame, strict: bool = False, named: int = 20) -> DataFrame:
    """The queries that have ground truth. When strict, one without is an error that names the first ``named``."""
    if strict:
        missing = [r["name"] for r in missing_ground_truth(queries, truth).orderBy("name").limit(named + 1).collect()]
        if missing:
            more = " and more" if len(missing) > named else ""
            raise ValueError(f"no ground truth for queries: {missing[:named]}{more}")
    return queries.join(truth.select("name").distinct(), "name", "left_semi")


# ---------------------------------------------------------------- execution log


def query_run_stats(log: DataFrame, keys: Sequence[str] = ("sweep_pos", "param", "name")) -> DataFrame:
    """Average, extremes and their distance from the average, per query and sweep position."""
    stats = log.groupBy(*keys).agg(
        F.avg("exec_time").alias("avg_time"),
        F.min("exec_time").alias("min_time"),
        F.max("exec_time").alias("max_time"),
        F.avg("recall").alias("avg_recall"),
    )
    return stats.withColumn("delta_minus", F.col("avg_time") - F.col("min_time")).withColumn(
        "delta_plus", F.col("max_time") - F.col("avg_time")
    )


def overall_percentiles(stats: DataFrame, digits: int = 4) -> DataFrame:
    """Mean and interpolated percentiles of the per-query averages, per sweep position.

    The exact percentile keeps its input, here one row per query.
    """
    shares = F.array(*[F.lit(p / 100.0) for p in PERCENTS])
    summed = stats.groupBy("sweep_pos", "param").agg(
        F.avg("avg_time").alias("avg_latency"),
        F.avg("avg_recall").alias("avg_recall"),
        F.percentile("avg_time", shares).alias("_latency"),
        F.percentile("avg_recall", shares).alias("_recall"),
    )

    def spread(kind: str) -> list[Column]:
        return [
            F.round(F.col(f"_{kind}")[i], digits).alias(f"p{p}_{kind}")
            for i, p in enumerate(PERCENTS)
        ]

    return summed.select(
        "sweep_pos",
        "param",
        F.round("avg_latency", digits).alias("avg_latency"),
        F.round("avg_recall", digits).alias("avg_recall"),
        *spread("latency"),
        *spread("recall"),
    )


def qps_by_param(log: DataFrame) -> DataFrame:
    """Successful executions over the time from the first start to the last end; 0 without time."""
    end = F.col("start_us") + F.col("exec_time") * F.lit(1e6)
    sums = log.groupBy("sweep_pos", "param").agg(
        F.count_if(F.col("ok")).alias("executions"),
        ((F.max(end) - F.min("start_us")) / F.lit(1e6)).alias("seconds"),
    )
    qps = F.when(F.col("seconds") > 0, F.col("executions") / F.col("seconds")).otherwise(0.0)
    return sums.withColumn("qps", qps)


def concurrent_query_stats(log: DataFrame, concurrency: int) -> DataFrame:
    """Per-query statistics of successful executions, with concurrency and QPS on every row."""
    per_query = query_run_stats(log.where(F.col("ok"))).drop("delta_minus", "delta_plus")
    qps = qps_by_param(log).select("sweep_pos", "qps")
    return per_query.join(qps, "sweep_pos").withColumn(
        "concurrency", F.lit(concurrency).cast("bigint")
    )


def recall_qps_curve(recalls: DataFrame, log: DataFrame) -> DataFrame:
    """Average recall and QPS per sweep position, the headline of a benchmark run."""
    average = recalls.groupBy("sweep_pos", "param").agg(F.avg("recall").alias("avg_recall"))
    return average.join(qps_by_param(log).select("sweep_pos", "qps"), "sweep_pos")


def mutation_time(log: DataFrame) -> DataFrame:
    """Total seconds per phase of an operation log."""
    return log.groupBy("phase").agg(
        F.count(F.lit(1)).alias("operations"), F.sum("seconds").alias("seconds")
    )


# ---------------------------------------------------------------- histograms


def histogram(df: DataFrame, value: Column, bins: int = BINS) -> DataFrame:
    """(bin, low, high, cnt): equal bins from the minimum to the maximum, the last one closed.

    Empty bins are kept; when all values are equal they lie in the last bin.
    """
    values = df.select(value.alias("x")).where(F.col("x").isNotNull())
    ends = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None:
        return local_table(df.sparkSession, [], "bin int, low double, high double, cnt bigint")
    width = high - low
    last = F.lit(bins - 1)
    place = F.floor((F.col("x") - low) / F.lit(width) * bins) if width > 0 else last
    counts = (
        values.select(F.least(place, last).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    edges = local_table(
        df.sparkSession,
        [
            (i, low + i * width / bins, high if i == bins - 1 else low + (i + 1) * width / bins)
            for i in range(bins)
        ],
        "bin int, low double, high double",
    )
    return edges.join(counts, "bin", "left").select(
        "bin", "low", "high", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def recall_histogram(stats: DataFrame) -> DataFrame:
    return histogram(stats, F.col("avg_recall"))


def latency_histogram(stats: DataFrame) -> DataFrame:
    """Log-spaced bins from at least 1e-9 s; without any positive latency, 15 equal bins.

    A latency below the lowest edge lies in no bin.
    """
    largest = stats.agg(F.max("avg_time").alias("hi")).first()["hi"]
    if largest is None or largest <= 0:
        return histogram(stats, F.col("avg_time"), BINS + 1)
    seen = stats.where(F.col("avg_time") >= LEAST_LATENCY)
    logs = histogram(seen, F.log10("avg_time"))
    return logs.select(
        "bin",
        F.pow(F.lit(10.0), F.col("low")).alias("low"),
        F.pow(F.lit(10.0), F.col("high")).alias("high"),
        "cnt",
    )


# ---------------------------------------------------------------- sorted reports


def results_by_recall(stats: DataFrame) -> DataFrame:
    """name, recall, time; lowest recall first."""
    return stats.select("name", "avg_recall", "avg_time").orderBy("avg_recall", "name")


def results_by_latency(stats: DataFrame) -> DataFrame:
    """name, time, recall; slowest first."""
    return stats.select("name", "avg_time", "avg_recall").orderBy(F.desc("avg_time"), "name")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
