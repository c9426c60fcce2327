"""Rewrite the filters of a query set so that they reach a target rate.

Values are taken in ascending order until their cumulative count reaches ``target * total``; at
least one value is always taken. Counts are compared, not sums of fractions.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import local_table, stored
from .analysis import filter_fields, filter_rates, filters_of, relevance_distribution, tag_rates
from .ranking import running_total

ANY_OF = ("==", "contains")
ABOVE = (">", ">=")


def rewrite_targets(
    queries: DataFrame, default: float | None = None, overrides: Mapping[str, float] | None = None
) -> DataFrame:
    """(name, target): the override of a query, else the default, else no row."""
    spark = queries.sparkSession
    given = local_table(
        spark,
        [(n, float(t)) for n, t in (overrides or {}).items()],
        "name string, override double",
    )
    fallback = F.lit(None if default is None else float(default)).cast("double")
    return (
        queries.select("name")
        .join(F.broadcast(given), "name", "left")
        .select("name", F.coalesce("override", fallback).alias("target"))
        .where(F.col("target").isNotNull())
    )


def with_running_counts(rates: DataFrame, fields) -> DataFrame:
    """Add ``upto``, the cumulative count of a field's values in ascending order.

    NULL and NaN are no values that a filter could name: they have no row here, while ``total``, the
    denominator of a rate, still counts them. ``known`` is the total without them.
    """
    rates = rates.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    known = rates.groupBy("field").agg(F.sum("cnt").alias("known"))
    rates = rates.join(known, "field")
    union = None
    for field in fields:
        part = running_total(rates.where(F.col("field") == field), "value", F.col("cnt"), "upto")
        union = part if union is None else union.unionByName(part)
    return union


def _is_chosen(target: Column) -> Column:
    before = F.col("upto") - F.col("cnt")
    return (before < target * F.col("total")) | (before == 0)


def rewrite_by_filter_rate(
    queries: DataFrame, rates: DataFrame, targets: DataFrame, descending: bool = False
) -> DataFrame:
    """One row per new filter: (name, pos, field, operator, value, logic).

    ``==`` and ``contains`` become one OR-ed filter per chosen value; ``<`` and ``<=`` become
    ``<=`` the last one. ``>`` and ``>=`` become ``>=`` the first chosen value, which is the
    minimum and passes every row; with ``descending`` they accumulate from the largest value down
    instead. A filter on a field without rates, and a query without a target, stay as they are.

    The rates come from a scan of the corpus and are read several times here, so they are stored.
    No join is hinted: a query set read from a file is broadcast when its size allows it, and a
    distribution of very many values is never moved to a few field names.
    """
    rates = stored(rates, "rates")
    fields = sorted(r["field"] for r in rates.select("field").distinct().collect())
    running = with_running_counts(rates, fields)
    filters = filters_of(queries).join(targets, "name", "left")
    wanted = filters.select("field", "target").where(F.col("target").isNotNull()).distinct()
    chosen = _is_chosen(F.col("target"))
    from_top = (F.col("known") - F.col("upto") < F.col("target") * F.col("total")) | (
        F.col("upto") == F.col("known")
    )
    cutoffs = (
        running.join(wanted, "field")
        .groupBy("field", "target")
        .agg(
            F.min("value").alias("first"),
            F.max(F.when(chosen, F.col("value"))).alias("last"),
            F.min(F.when(from_top, F.col("value"))).alias("top"),
        )
    )
    located = filters.join(cutoffs, ["field", "target"], "left")
    kept = located.where(F.col("last").isNull()).select(
        "name", "pos", "field", "operator", F.col("value").cast("string"), "logic"
    )
    changed = located.where(F.col("last").isNotNull()).drop("value", "logic")
    any_of = changed.where(F.col("operator").isin(*ANY_OF))
    values = running.select("field", F.col("value").alias("found"))
    any_of = (
        any_of.join(values, "field")
        .where(F.col("found") <= F.col("last"))
        .select(
            "name", "pos", "field", "operator",
            F.col("found").cast("string").alias("value"), F.lit("or").alias("logic"),
        )
    )
    above = F.col("operator").isin(*ABOVE)
    low = F.col("top") if descending else F.col("first")
    ranges = changed.where(~F.col("operator").isin(*ANY_OF)).select(
        "name",
        "pos",
        "field",
        F.when(above, F.lit(">=")).otherwise(F.lit("<=")).alias("operator"),
        F.when(above, low).otherwise(F.col("last")).cast("string").alias("value"),
        F.lit("and").alias("logic"),
    )
    return any_of.unionByName(ranges).unionByName(kept)


def rewrite_by_relevance(
    queries: DataFrame, relevances: DataFrame, targets: DataFrame
) -> DataFrame:
    """The same walk over each query's own distribution among its nearest rows.

    Both range directions are cut at the last chosen value. A distribution has at most as many
    rows as nearest rows were taken, so a window per query is bounded.
    """
    order = (
        Window.partitionBy("name")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    chosen = (
        stored(relevances, "relevances")
        .where(F.col("value").isNotNull())
        .withColumn("upto", F.sum("cnt").over(order))
        .join(targets, "name")
        .where(_is_chosen(F.col("target")))
        .select("name", F.col("value").alias("found"))
    )
    lasts = chosen.groupBy("name").agg(F.max("found").alias("last"))
    filters = filters_of(queries)
    untouched = filters.join(lasts, "name", "left_anti").select(
        "name", "pos", "field", "operator", "value", "logic"
    )
    any_of = (
        filters.where(F.col("operator").isin(*ANY_OF))
        .drop("value", "logic")
        .join(chosen, "name")
        .select(
            "name", "pos", "field", "operator",
            F.col("found").cast("string").alias("value"), F.lit("or").alias("logic"),
        )
    )
    above = F.col("operator").isin(*ABOVE)
    ranges = (
        filters.where(~F.col("operator").isin(*ANY_OF))
        .drop("value", "logic")
        .join(lasts, "name")
        .select(
            "name",
            "pos",
            "field",
            F.when(above, F.lit(">=")).otherwise(F.lit("<=")).alias("operator"),
            F.col("last").cast("string").alias("value"),
            F.lit("and").alias("logic"),
        )
    )
    return any_of.unionByName(ranges).unionByName(untouched)


def with_filters(queries: DataFrame, rewritten: DataFrame) -> DataFrame:
    """The query set with its filters replaced by the rewritten ones, in order."""
    entry = F.struct(
        "pos", F.col("value").try_cast("double").alias("order"), "field", "operator", "value", "logic"
    )
    lists = rewritten.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    replaced = F.transform(
        F.coalesce("found", F.array()),
        lambda f: F.struct(f["field"], f["operator"], f["value"], f["logic"]),
    )
    return queries.drop("scalar_filters").join(lists, "name", "left").select(
        "name", "vector_field", "reference_id", replaced.alias("scalar_filters"), "limit"
    )


def modified_queries(
    corpus: DataFrame,
    queries: DataFrame,
    by: str = "filter_rate",
    default: float | None = None,
    overrides: Mapping[str, float] | None = None,
    top_k: int = 500,
    denominator: str = "occurrences",
    metric: str = "l2",
    descending: bool = False,
) -> DataFrame:
    """The query set whose filters reach their targets, ready to be written by ``write_query_set``.

    A query takes the target that ``overrides`` names for it, else ``default``; without either it keeps its
    filters. ``by`` is ``filter_rate``, over the rows of the corpus (array fields with ``denominator``), or
    ``relevance``, over each query's ``top_k`` nearest rows. Filters on fields that have no rates, such as
    text, stay. An override for a query that is not in the set is an error.
    """
    if by not in ("filter_rate", "relevance"):
        raise ValueError("by must be 'filter_rate' or 'relevance'")
    queries = stored(queries, "queries")
    asked = list(overrides or {})
    known = {r["name"] for r in queries.where(F.col("name").isin(asked)).select("name").collect()} if asked else set()
    if set(asked) - known:
        raise ValueError(f"targets for unknown queries: {sorted(set(asked) - known)}")
    targets = rewrite_targets(queries, default, overrides)
    if by == "relevance":
        found = relevance_distribution(corpus, queries.join(targets.select("name"), "name", "left_semi"), top_k, metric)
        return with_filters(queries, rewrite_by_relevance(queries, found, targets))
    fields = sorted(r["field"] for r in filter_fields(queries).collect())  # a name per filter field
    kinds = {f: corpus.schema[f].dataType for f in fields if f in corpus.columns}
    numbers = [f for f, kind in kinds.items() if isinstance(kind, T.NumericType)]
    lists = [f for f, kind in kinds.items() if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)]
    rates = [filter_rates(corpus, numbers)] if numbers else []
    rates += [tag_rates(corpus, f, denominator) for f in lists]
    if not rates:
        return queries
    union = rates[0]
    for part in rates[1:]:
        union = union.unionByName(part)
    return with_filters(queries, rewrite_by_filter_rate(queries, union, targets, descending))
