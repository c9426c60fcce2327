"""Approximate filtered search: coarse cells, and hash tables of random planes.

Both only decide which rows a query may see; the filter and the exact distance are the same as in
the exact search, so a result is always a subset of the truth ordered the same way.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from functools import reduce
from operator import or_
from typing import Mapping, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.keyed import SPAN
from ..functions.vectors import hash_codes, keyed_ints, nearest_centre, sign_codes
from ..session import local_table
from .blocktopk import merge_topk, partial_topk
from .hits import HITS, Positions, any_position, with_hits, with_lookup, words_for
from .knn import Query, over_blocks, vectors_for
from .ranking import contiguous_ids, sample_exact

CENTRE_STREAM = 401
VIRTUAL_QUERIES = 2048


# ---------------------------------------------------------------- coarse cells


def sampled_centroids(
    df: DataFrame, cells: int, vector: str = "image_vec", stream: int = CENTRE_STREAM
) -> DataFrame:
    """``cells`` drawn rows as (cell, centre), cells numbered from 1 by id."""
    drawn = sample_exact(df.select("id", vector), cells, "id", stream)
    return contiguous_ids(drawn, "id", out="cell", rows_at_most=cells).select(
        F.col("cell").cast("int").alias("cell"), F.col(vector).alias("centre")
    )


def kmeans_centroids(
    df: DataFrame, cells: int, vector: str = "image_vec", rows: int = 1_000_000, seed: int = 42
) -> DataFrame:
    """Centroids trained by distributed k-means on a sample of the vectors."""
    sample = sample_exact(df.select("id", vector), rows, "id", CENTRE_STREAM)
    features = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=20).fit(features)
    return local_table(
        df.sparkSession,
        [(i + 1, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cell int, centre array<double>",
    )


def _centre_arrays(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The centroid table: as many rows as the index has cells, a parameter of the index."""
    rows = centroids.orderBy("cell").collect()
    return np.array([r["cell"] for r in rows]), np.array(
        [r["centre"] for r in rows], dtype=np.float64
    )


def ivf_assign(df: DataFrame, centroids: DataFrame, vector: str = "image_vec") -> DataFrame:
    """Add ``cell``, the nearest centre's. Only the vector column passes through Arrow."""
    cells, centres = _centre_arrays(centroids)
    return df.withColumn("cell", nearest_centre(F.col(vector), cells, centres))


def write_cells(df: DataFrame, path: str) -> None:
    """Store an assigned corpus by cell, so that a probe list prunes folders.

    A cell may hold a large share of the rows: they are spread over several files by a salt.
    """
    salt = F.pmod(F.hash("id"), F.lit(16))
    df.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(path)


def probed_cells(
    centroids: DataFrame, names: Sequence[str], vectors: np.ndarray, most: int
) -> dict[str, list[int]]:
    """Each query's nearest cells, nearest first."""
    cells = centroids.select(F.col("cell").cast("bigint").alias("id"), "centre")
    nearest = merge_topk(partial_topk(cells, names, vectors, [most] * len(names)), most)
    found: dict[str, list] = defaultdict(list)
    for row in nearest.select("name", "rank", "id").collect():
        found[row["name"]].append((row["rank"], row["id"]))
    return {name: [cell for _, cell in sorted(pairs)] for name, pairs in found.items()}


def candidate_topk(
    rows: DataFrame,
    members: Sequence[Query],
    vectors: np.ndarray,
    lookups: Mapping[str, Mapping],
    vector: str,
    metric: str,
    mode: str,
    vector_of: Sequence[int] | None = None,
) -> DataFrame:
    """Exact top-k of each query among the rows one of its lookups leads to and its filter passes."""
    words, outs = words_for(len(members)), []
    for number, (column, positions) in enumerate(lookups.items()):
        outs.append(f"_cand{number}")
        only = len(lookups) == 1
        rows = with_lookup(rows, column, {outs[-1]: positions}, len(members), required=only)
    led_to = reduce(or_, [Positions.of_column(out, words) for out in outs])
    if any(q.filters for q in members):
        rows = with_hits(rows, [q.filters for q in members], mode, keep_all=True)
        led_to = led_to & Positions.of_column(HITS, words)
    rows = rows.withColumn(HITS, led_to.column).where(any_position(HITS))
    rows = rows.select("id", vector, HITS)
    partial = partial_topk(
        rows, [q.name for q in members], vectors, [q.limit for q in members], metric, vector_of
    )
    return merge_topk(partial, max(q.limit for q in members), metric)


def ivf_sweep(
    assigned: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    probes: Sequence[int],
    metric: str = "l2",
    mode: str = "fold",
    references: DataFrame | None = None,
) -> DataFrame:
    """Search with every number of probed cells: (sweep_pos, param, name, rank, id, dist).

    A sweep row is known by its position, since a list may repeat a value. All values are answered
    in the same scan, a repeated one once; the rows of a query are compared with one vector however
    many values there are.
    """
    source = assigned if references is None else references
    counts = sorted(set(probes))

    def answer(block: Sequence[Query]) -> DataFrame:
        parts = []
        by_field: dict[str, list[Query]] = defaultdict(list)
        for query in block:
            by_field[query.vector_field].append(query)
        for field, members in by_field.items():
            vectors = vectors_for(source, members, field)
            near = probed_cells(centroids, [q.name for q in members], vectors, counts[-1])
            virtual, vector_of, positions = [], [], defaultdict(list)
            for count in counts:
                for number, query in enumerate(members):
                    for cell in near[query.name][:count]:
                        positions[cell].append(len(virtual))
                    virtual.append(replace(query, name=f"{count}|{query.name}"))
                    vector_of.append(number)
            parts.append(
                candidate_topk(
                    assigned, virtual, vectors, {"cell": positions}, field, metric, mode, vector_of
                )
            )
        found = reduce(DataFrame.unionByName, parts)
        split = found.select(
            F.substring_index("name", "|", 1).cast("int").alias("param"),
            F.expr("substring(name, instr(name, '|') + 1)").alias("name"),
            "rank",
            "id",
            "dist",
        )
        sweep = F.array(
            *[F.struct(F.lit(i).alias("place"), F.lit(int(p)).alias("p")) for i, p in enumerate(probes)]
        )
        places = F.transform(
            F.filter(sweep, lambda s: s["p"] == F.col("param")), lambda s: s["place"]
        )
        return split.select(
            F.explode(places).alias("sweep_pos"), "param", "name", "rank", "id", "dist"
        )

    return over_blocks(
        queries,
        answer,
        max(1, VIRTUAL_QUERIES // len(counts)),
        "sweep_pos int, param int, name string, rank bigint, id bigint, dist double",
    )


def with_sweep(queries: DataFrame, params: Sequence[int]) -> DataFrame:
    """Every query once per sweep position."""
    positions = F.posexplode(F.array(*[F.lit(int(p)) for p in params]))
    return queries.select("*", positions.alias("sweep_pos", "param"))


def ivf_search(
    assigned: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    nprobe: int,
    metric: str = "l2",
    mode: str = "fold",
    references: DataFrame | None = None,
) -> DataFrame:
    """Filtered search in the ``nprobe`` nearest cells of each query: (name, rank, id, dist)."""
    found = ivf_sweep(assigned, queries, centroids, [nprobe], metric, mode, references)
    return found.select("name", "rank", "id", "dist")


# ---------------------------------------------------------------- hash tables


def sign_planes(dimension: int, tables: int, bits: int) -> np.ndarray:
    """(dimension, tables, bits) plane components in [-1, 1], drawn by position."""
    drawn = keyed_ints(np.arange(dimension * tables * bits)) / SPAN
    return (2.0 * drawn - 1.0).reshape(dimension, tables, bits)


def lsh_index(df: DataFrame, planes: np.ndarray, vector: str = "image_vec") -> DataFrame:
    """Add ``codes``: the row's bucket in every table."""
    return df.withColumn("codes", sign_codes(F.col(vector), planes))


def lsh_search(
    indexed: DataFrame,
    queries: DataFrame,
    planes: np.ndarray,
    metric: str = "cosine",
    mode: str = "fold",
    vector: str = "image_vec",
    references: DataFrame | None = None,
) -> DataFrame:
    """Filtered search among rows that share a bucket with the query in at least one table.

    The buckets of a query block are broadcast, so a bucket that holds a third of all rows moves
    none of them.
    """
    source = indexed if references is None else references
    tables = planes.shape[1]

    def answer(block: Sequence[Query]) -> DataFrame:
        vectors = vectors_for(source, block, vector)
        codes = hash_codes(vectors, planes)
        rows, lookups = indexed, {}
        for table in range(tables):
            column = f"_code{table}"
            rows = rows.withColumn(column, F.col("codes")[table])
            positions: dict[int, list[int]] = defaultdict(list)
            for place, code in enumerate(codes[:, table].tolist()):
                positions[code].append(place)
            lookups[column] = positions
        return candidate_topk(rows, block, vectors, lookups, vector, metric, mode)

    return over_blocks(queries, answer)
