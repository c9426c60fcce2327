"""All registered queries."""

from __future__ import annotations

from . import (
    analysis_queries,
    ann_queries,
    knn_queries,
    metric_queries,
    mutate_queries,
    synth_queries,
    table_queries,
)

GROUPS = (
    knn_queries,
    ann_queries,
    analysis_queries,
    synth_queries,
    mutate_queries,
    metric_queries,
    table_queries,
)


def queries() -> dict:
    return {key: build for group in GROUPS for key, build in group.QUERIES.items()}


def oracle_sql() -> dict:
    return {key: text for group in GROUPS for key, text in group.SQL.items()}
