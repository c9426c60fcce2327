"""A stored cell index that grows: build, append, delete, split, and search over its folders.

Below the index path lie ``rows/version=v/cell=c``, what version v wrote of cell c; ``summaries/version=v``, the
counts of these rows; and ``centres/version=v``, the cells of the index as version v leaves it. A version exists
when its centre table does: rows come first and the centre table last, so a failed change leaves the
index as it was, and repeating it overwrites what it left. A cell that is written anew gets ``since = v``; older
folders of the cell are no longer read. An append writes the new rows only, a delete or split only the cells it
touches. One writer at a time.

Searches read the folders of probed cells alone (partition pruning on ``cell``):

* ``search``          the nearest cells of each query, as in ``ann.ivf_search``;
* ``search_matching`` cells nearest first, without those where the filter certainly matches nothing, until the
                      summaries promise enough matches; queries that still come out short go on;
* ``search_exact``    all cells that can hold one of the k nearest, by the triangle inequality.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.vectors import distance_to, nearest_centre_gap, partial_sums
from ..session import local_table, stored
from .ann import _centre_arrays, candidate_topk, ivf_search
from .knn import Query, over_blocks, vectors_for
from .summaries import Expected, merged, summarize

SALTS = 16
GAP = "_gap"
LLOYD_STEPS = 5
SPLIT_AT_ONCE = 16  # the plan of a split grows with the cells it halves
FOUND = "name string, rank bigint, id bigint, dist double"
CENTRES = "cell int, centre array<double>, since bigint, rows bigint, radius double"


@dataclass(frozen=True)
class CellIndex:
    """One version of an index. ``counted`` and ``edges`` are what its summaries count."""

    spark: SparkSession
    path: str
    version: int
    vector: str
    counted: tuple
    edges: tuple

    # ------------------------------------------------------------ reading

    def centres(self) -> DataFrame:
        """(cell, centre, since, rows, radius) of this version; radius is the largest distance to the centre."""
        return self.spark.read.schema(CENTRES).parquet(f"{self.path}/centres/version={self.version}")

    def centroids(self) -> DataFrame:
        return self.centres().select("cell", "centre")

    def _live(self, kind: str) -> DataFrame:
        since = self.centres().select("cell", "since")  # a row per cell, a parameter of the index
        found = self.spark.read.parquet(f"{self.path}/{kind}").where(F.col("version") <= self.version)
        live = found.join(F.broadcast(since), "cell").where(F.col("version") >= F.col("since"))
        return live.drop("version", "since")

    def stored_rows(self) -> DataFrame:
        return self._live("rows")

    def rows(self) -> DataFrame:
        """All rows, with their ``cell``."""
        return self.stored_rows().drop(GAP)

    def summaries(self) -> DataFrame:
        return merged(self._live("summaries"))

    def expected(self, block: Sequence[Query], cells: Sequence[int], mode: str) -> Expected:
        filters = [q.filters for q in block]
        return Expected(self.summaries(), self.rows().schema, cells, filters, dict(self.edges), mode)

    # ------------------------------------------------------------ writing

    def _write(self, assigned: DataFrame, version: int) -> DataFrame:
        """Store assigned rows and their summary; their cells as (cell, rows, radius)."""
        salt = F.pmod(F.hash("id"), F.lit(SALTS))  # a cell may hold a large share of the rows
        out = f"{self.path}/rows/version={version}"
        assigned.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(out)
        written = self.spark.read.schema(assigned.schema).parquet(out)
        counts = summarize(written, self.counted, dict(self.edges))
        counts.write.mode("overwrite").parquet(f"{self.path}/summaries/version={version}")
        return written.groupBy("cell").agg(F.count(F.lit(1)).alias("new_rows"), F.max(GAP).alias("new_radius"))

    def _commit(self, centres: DataFrame, version: int) -> "CellIndex":
        columns = [F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(CENTRES)]
        centres.select(*columns).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres/version={version}")
        return CellIndex(self.spark, self.path, version, self.vector, self.counted, self.edges)

    def append(self, rows: DataFrame) -> "CellIndex":
        """Add rows; only they are assigned and written. Rows without a vector are left out."""
        version = self.version + 1
        added = self._write(with_gap(rows, self.centroids(), self.vector), version)
        centres = self.centres().join(F.broadcast(added), "cell", "left").select(
            "cell", "centre", "since",
            (F.col("rows") + F.coalesce("new_rows", F.lit(0))).alias("rows"),
            F.greatest("radius", F.coalesce("new_radius", F.lit(0.0))).alias("radius"),
        )
        return self._commit(centres, version)

    def delete(self, ids: DataFrame) -> "CellIndex":
        """Remove the rows whose id is in ``ids``; only the cells that hold one are written anew."""
        version = self.version + 1
        gone = ids.select("id").distinct()
        held = self.stored_rows()
        touched = [r["cell"] for r in held.select("id", "cell").join(gone, "id", "left_semi").select("cell").distinct().collect()]
        if not touched:
            return self
        kept = self._write(held.where(F.col("cell").isin(touched)).join(gone, "id", "left_anti"), version)
        old = self.centres()
        rest = old.where(~F.col("cell").isin(touched))
        new = old.where(F.col("cell").isin(touched)).join(F.broadcast(kept), "cell", "left").select(
            "cell", "centre", F.lit(version).alias("since"),
            F.coalesce("new_rows", F.lit(0)).alias("rows"), F.coalesce("new_radius", F.lit(0.0)).alias("radius"),
        )
        return self._commit(rest.unionByName(new), version)

    def split(self, most: int) -> "CellIndex":
        """Halve cells of more than ``most`` rows by local two-means until none is left that can be halved.

        A cell whose rows all have one vector stays as it is. The parts get new numbers; rows of other
        cells stay where they are, even if a new centre is nearer.
        """
        index = self
        while True:
            over = index.centres().where((F.col("rows") > most) & (F.col("radius") > 0))
            large = [r["cell"] for r in over.orderBy(F.col("rows").desc(), "cell").limit(SPLIT_AT_ONCE).collect()]
            halved = index._halve(large) if large else None
            if halved is None:
                return index
            index = halved

    def _halve(self, large: Sequence[int]) -> "CellIndex | None":
        version = self.version + 1
        rows = self.stored_rows().where(F.col("cell").isin(large))
        first = rows.groupBy("cell").agg(F.max_by(self.vector, F.struct(GAP, "id")).alias("v")).collect()
        seeds = {r["cell"]: [r["v"]] for r in first}
        for cell, row in self._farthest(rows, {c: s[0] for c, s in seeds.items()}).items():
            seeds[cell].append(row)
        centres = {c: np.asarray(s, dtype=np.float64) for c, s in seeds.items()}
        for _ in range(LLOYD_STEPS):
            sides = self._sided(rows, centres).select((F.col("cell") * 2 + F.col("_side")).cast("bigint").alias("g"), self.vector)
            parts = partial_sums(sides, "group bigint, n bigint, total array<double>").collect()  # a row per task and half
            moved: dict[int, tuple] = {}
            for p in parts:
                n, total = moved.get(p["group"], (0, 0.0))
                moved[p["group"]] = n + p["n"], total + np.asarray(p["total"])
            for cell in centres:
                for side in (0, 1):
                    if cell * 2 + side in moved:
                        n, total = moved[cell * 2 + side]
                        centres[cell][side] = total / n
        fresh = self.centres().agg(F.max("cell")).first()[0] + 1
        number = {(cell, side): fresh + 2 * i + side for i, cell in enumerate(sorted(centres)) for side in (0, 1)}
        table = local_table(
            self.spark,
            [(cell, side, n, centres[cell][side].tolist()) for (cell, side), n in number.items()],
            "cell int, _side int, _new int, centre array<double>",
        )
        sided = self._sided(rows, centres).drop(GAP).join(F.broadcast(table.drop("centre")), ["cell", "_side"])
        cells = {n: centres[cell][side] for (cell, side), n in number.items()}
        placed = sided.drop("cell", "_side").withColumnRenamed("_new", "cell")
        written = self._write(self._measured(placed, cells), version)
        new = table.select(F.col("_new").alias("cell"), "centre").join(F.broadcast(written), "cell", "left").select(
            "cell", "centre", F.lit(version).alias("since"),
            F.coalesce("new_rows", F.lit(0)).alias("rows"), F.coalesce("new_radius", F.lit(0.0)).alias("radius"),
        )
        return self._commit(self.centres().where(~F.col("cell").isin(list(large))).unionByName(new), version)

    def _by_cell(self, rows: DataFrame, cells: Sequence[int], value) -> DataFrame:
        """Rows with a column made per cell; there are as many expressions as cells in hand."""
        parts = [value(rows.where(F.col("cell") == cell), cell) for cell in cells]
        return reduce(DataFrame.unionByName, parts)

    def _farthest(self, rows: DataFrame, seeds: Mapping[int, Sequence[float]]) -> dict:
        def gap(part: DataFrame, cell: int) -> DataFrame:
            return part.withColumn("_d", distance_to(F.col(self.vector), seeds[cell]))

        far = self._by_cell(rows, sorted(seeds), gap).groupBy("cell").agg(F.max_by(self.vector, F.struct("_d", "id")).alias("v"))
        return {r["cell"]: r["v"] for r in far.collect()}

    def _sided(self, rows: DataFrame, centres: Mapping[int, np.ndarray]) -> DataFrame:
        def side(part: DataFrame, cell: int) -> DataFrame:
            nearest = nearest_centre_gap(F.col(self.vector), np.array([0, 1]), centres[cell])
            return part.withColumn("_side", nearest["cell"])

        return self._by_cell(rows, sorted(centres), side)

    def _measured(self, rows: DataFrame, centres: Mapping[int, np.ndarray]) -> DataFrame:
        def gap(part: DataFrame, cell: int) -> DataFrame:
            return part.withColumn(GAP, distance_to(F.col(self.vector), centres[cell]))

        return self._by_cell(rows, sorted(centres), gap)

    # ------------------------------------------------------------ searching

    def search(self, queries: DataFrame, nprobe: int, metric: str = "l2", mode: str = "fold", references=None) -> DataFrame:
        """Filtered search in the ``nprobe`` nearest cells of each query: (name, rank, id, dist)."""
        rows = self.rows()
        return ivf_search(rows, queries, self.centroids(), nprobe, metric, mode, rows if references is None else references)

    def _answer(self, block, vectors, chosen: Mapping[str, Sequence[int]], metric: str, mode: str) -> DataFrame:
        positions: dict[int, list[int]] = {}
        for number, query in enumerate(block):
            for cell in chosen[query.name]:
                positions.setdefault(int(cell), []).append(number)
        return candidate_topk(self.rows(), block, vectors, {"cell": positions}, self.vector, metric, mode)

    def _ordered(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells, and the distance of every vector to every centre and the cells' radii."""
        table = self.centres().orderBy("cell").collect()  # a row per cell
        cells = np.array([r["cell"] for r in table])
        centres = np.array([r["centre"] for r in table], dtype=np.float64)
        gaps = np.stack([np.sqrt(((centres - v) ** 2).sum(axis=1)) for v in vectors])
        return cells, gaps, np.array([r["radius"] for r in table])

    def search_matching(
        self,
        queries: DataFrame,
        least: int = 1,
        slack: float = 2.0,
        metric: str = "l2",
        mode: str = "fold",
        references: DataFrame | None = None,
    ) -> DataFrame:
        """Filtered search that probes until matches suffice: (name, rank, id, dist).

        Cells without a possible match are passed over. At least ``least`` others are probed, nearest
        centre first, until their expected matches reach ``slack`` times the limit. A query with fewer rows than its
        limit is answered again with twice the matches, until it has enough or no cell is left; so as many
        rows are returned as the exact search returns.
        """
        source = self.rows() if references is None else references

        def answer(block: Sequence[Query]) -> DataFrame:
            vectors = vectors_for(source, block, self.vector)
            cells, gaps, _ = self._ordered(vectors)
            expected = self.expected(block, cells, mode)
            parts, left, wanted = [], list(range(len(block))), slack
            while left:
                members = [block[i] for i in left]
                chosen, more = {}, set()
                for i in left:
                    query, matches = block[i], expected.matches(block[i].filters)
                    order = np.lexsort((cells, gaps[i]))
                    order = order[matches[order] > 0]
                    before = np.cumsum(matches[order]) - matches[order]
                    probe = (before < wanted * query.limit) | (np.arange(len(order)) < least)
                    chosen[query.name] = cells[order[probe]].tolist()
                    if not probe.all():
                        more.add(i)
                found = stored(self._answer(members, vectors[left], chosen, metric, mode), "matching")
                full = {r["name"]: r["count"] for r in found.groupBy("name").count().collect()}
                short = [i for i in left if i in more and full.get(block[i].name, 0) < block[i].limit]
                parts.append(found.where(~F.col("name").isin([block[i].name for i in short])) if short else found)
                left, wanted = short, 2 * wanted
            return reduce(DataFrame.unionByName, parts)

        return over_blocks(_for(self.vector, queries), answer)

    def search_exact(
        self,
        queries: DataFrame,
        slack: float = 2.0,
        mode: str = "fold",
        references: DataFrame | None = None,
        metric: str = "l2",
        measured: list | None = None,
    ) -> DataFrame:
        """The result of ``knn.knn_batch`` without reading cells that are too far: (name, rank, id, dist).

        A row of a cell is no nearer than the distance to the centre less the cell's radius. The nearest cells
        with enough expected matches give a distance that k rows reach; then all cells whose bound is not above
        it are read. ``measured`` receives (name, rows read, rows of the index) of every query.
        """
        if metric not in ("l2", "l2_squared"):
            raise ValueError("cell bounds need l2 or l2_squared")
        source = self.rows() if references is None else references

        def answer(block: Sequence[Query]) -> DataFrame:
            vectors = vectors_for(source, block, self.vector)
            cells, gaps, radii = self._ordered(vectors)
            expected = self.expected(block, cells, mode)
            possible = np.stack([expected.matches(q.filters) for q in block])
            bounds = np.maximum(gaps - radii, 0.0) * (1.0 - 1e-9) - 1e-12
            first, chosen = {}, {}
            for i, query in enumerate(block):
                order = np.lexsort((cells, gaps[i]))
                order = order[possible[i][order] > 0]
                before = np.cumsum(possible[i][order]) - possible[i][order]
                first[i] = order[before < slack * query.limit]
                chosen[query.name] = cells[first[i]]
            start = stored(self._answer(block, vectors, chosen, "l2", mode), "nearest-cells")
            reach = {r["name"]: (r["n"], r["d"]) for r in start.groupBy("name").agg(F.count("id").alias("n"), F.max("dist").alias("d")).collect()}
            rest = {}
            for i, query in enumerate(block):
                n, far = reach.get(query.name, (0, np.inf))
                near = (possible[i] > 0) & (bounds[i] <= (far if n >= query.limit else np.inf))
                near[first[i]] = False
                rest[query.name] = cells[near]
                if measured is not None:
                    read = expected.rows[near].sum() + expected.rows[first[i]].sum()
                    measured.append((query.name, int(read), int(expected.rows.sum())))
            found = start
            if any(len(c) for c in rest.values()):
                found = start.unionByName(self._answer(block, vectors, rest, "l2", mode))
            limits = local_table(self.spark, [(q.name, q.limit) for q in block], "name string, k int")
            order = Window.partitionBy("name").orderBy("dist", "id")
            ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint"))
            ranked = ranked.join(F.broadcast(limits), "name").where(F.col("rank") <= F.col("k"))
            dist = F.col("dist") * F.col("dist") if metric == "l2_squared" else F.col("dist")
            return ranked.select("name", "rank", "id", dist.alias("dist"))

        return over_blocks(_for(self.vector, queries), answer)


def _for(vector: str, queries: DataFrame) -> DataFrame:
    """The queries; one for another vector field than the index's is an error when it is read."""
    message = F.concat(F.lit("the index has no vector field "), F.col("vector_field"))
    return queries.withColumn(
        "vector_field", F.when(F.col("vector_field") == vector, F.col("vector_field")).otherwise(F.raise_error(message))
    )


def with_gap(rows: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """Add ``cell`` and the distance to its centre."""
    cells, centres = _centre_arrays(centroids)
    rows = rows.where(F.col(vector).isNotNull())
    found = rows.withColumn("_nearest", nearest_centre_gap(F.col(vector), cells, centres))
    return found.withColumns({"cell": F.col("_nearest.cell"), GAP: F.sqrt("_nearest.gap")}).drop("_nearest")


def build(
    rows: DataFrame,
    centroids: DataFrame,
    path: str,
    vector: str = "image_vec",
    counted: Sequence[str] = (),
    edges: Mapping[str, Sequence[float]] | None = None,
) -> CellIndex:
    """Write version 1 of an index at ``path``; ``counted`` and ``edges`` as for ``summarize``."""
    spark = rows.sparkSession
    fixed = tuple((field, tuple(at)) for field, at in (edges or {}).items())
    index = CellIndex(spark, path.rstrip("/"), 1, vector, tuple(counted), fixed)
    about = [(vector, list(counted), [f for f, _ in fixed], [list(at) for _, at in fixed])]
    schema = "vector string, counted array<string>, fields array<string>, edges array<array<double>>"
    local_table(spark, about, schema).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/about")
    written = index._write(with_gap(rows, centroids, vector), 1)
    centres = centroids.join(F.broadcast(written), "cell", "left").select(
        "cell", F.col("centre").cast("array<double>").alias("centre"), F.lit(1).alias("since"),
        F.coalesce("new_rows", F.lit(0)).alias("rows"), F.coalesce("new_radius", F.lit(0.0)).alias("radius"),
    )
    return index._commit(centres, 1)


def load(spark: SparkSession, path: str) -> CellIndex:
    """The newest version of the index at ``path``."""
    path = path.rstrip("/")
    version = spark.read.parquet(f"{path}/centres").agg(F.max("version")).first()[0]
    about = spark.read.parquet(f"{path}/about").first()
    edges = tuple((f, tuple(at)) for f, at in zip(about["fields"], about["edges"]))
    return CellIndex(spark, path, int(version), about["vector"], tuple(about["counted"]), edges)
