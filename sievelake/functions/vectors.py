"""Whole-vector functions whose work is a matrix product, as Arrow functions over one column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..operators.blocktopk import measure, vectors_of
from .distance import metric as lookup_metric
from .keyed import MASK, mixed, normals

CENTRES_PER_PASS = 1 << 24  # matrix cells


def keyed_ints(keys: np.ndarray) -> np.ndarray:
    """``keyed_int`` of stream 0 for keys below 2**31, outside Spark."""
    return mixed(np.asarray(keys, dtype=np.int64) & MASK)


def sign_matrix(rows: int, columns: int) -> np.ndarray:
    """A +1/-1 matrix drawn by position; component (i, j) has the key i * columns + j."""
    keys = np.arange(rows * columns).reshape(rows, columns)
    return np.where(keyed_ints(keys) % 2 == 0, 1.0, -1.0)


def gaussian_matrix(rows: int, columns: int, seed: int = 42) -> np.ndarray:
    """A matrix of independent normals, scaled so that lengths are kept on average."""
    return np.random.default_rng(seed).normal(0.0, np.sqrt(1.0 / columns), (rows, columns))


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, columns = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * columns)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), kind))


def project(vector: Column, matrix: np.ndarray) -> Column:
    """vector x matrix as array<double>."""

    @F.arrow_udf("array<double>")
    def product(column: pa.Array) -> pa.Array:
        return _lists(vectors_of(column, matrix.shape[0]) @ matrix, pa.float64())

    return product(vector)


def _to_bytes(values: np.ndarray, low: float, high: float) -> pa.Array:
    if high == low:
        return pa.array(np.zeros(len(values), dtype=np.int32))
    return pa.array(np.floor((values - low) / (high - low) * 255.0).astype(np.int32))


def quantized(vector: Column, low: float, high: float) -> Column:
    """Components scaled from low..high to 0..255 and truncated; 0 when low equals high."""

    @F.arrow_udf("array<int>")
    def scaled(column: pa.Array) -> pa.Array:
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.ListArray.from_arrays(
            pa.array(ends), _to_bytes(values, low, high), mask=column.is_null()
        )

    return scaled(vector)


def projected_ends(vector: Column, matrix: np.ndarray) -> Column:
    """The smallest and largest component of vector x matrix, without the product itself."""

    @F.arrow_udf("struct<low: double, high: double>")
    def ends(column: pa.Array) -> pa.Array:
        product = vectors_of(column, matrix.shape[0]) @ matrix
        return pa.StructArray.from_arrays(
            [pa.array(product.min(axis=1)), pa.array(product.max(axis=1))], ["low", "high"]
        )

    return ends(vector)


def project_quantized(vector: Column, matrix: np.ndarray, low: float, high: float) -> Column:
    """vector x matrix, scaled from low..high to 0..255 and truncated."""

    @F.arrow_udf("array<int>")
    def product(column: pa.Array) -> pa.Array:
        found = vectors_of(column, matrix.shape[0]) @ matrix
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * matrix.shape[1])
        return pa.ListArray.from_arrays(offsets, _to_bytes(found.reshape(-1), low, high))

    return product(vector)


def noisy(
    vector: Column, row_key: Column, sigma: float = 0.05, rounding: str = "truncate"
) -> Column:
    """Add keyed normal noise to 0..255 components, clip, and go back to integers.

    Truncation turns small noise into "subtract one with probability one half"; ``nearest`` keeps
    the value.
    """
    if rounding not in ("truncate", "nearest"):
        raise ValueError("rounding must be 'truncate' or 'nearest'")
    whole = np.floor if rounding == "truncate" else np.rint

    @F.arrow_udf("array<int>")
    def moved(column: pa.Array, keys: pa.Array) -> pa.Array:
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        places = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
        row_keys = np.repeat(keys.to_numpy(zero_copy_only=False), lengths)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        shifted = np.clip(values + sigma * normals(row_keys, places), 0.0, 255.0)
        flat = pa.array(whole(shifted).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=column.is_null())

    return moved(vector, row_key)


def bumped(vector: Column, draw: Column) -> Column:
    """Component ``draw`` modulo the length goes one up, or one down from 255."""

    @F.arrow_udf("array<int>")
    def moved(column: pa.Array, draws: pa.Array) -> pa.Array:
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        some = lengths > 0
        places = ends[:-1][some] + draws.to_numpy(zero_copy_only=False)[some] % lengths[some]
        values[places] += np.where(values[places] < 255, 1, -1).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=column.is_null())

    return moved(vector, draw)


def distance_to(vector: Column, reference, metric: str = "l2") -> Column:
    """The distance of a whole column of vectors to one constant vector.

    The same value as ``distance.distance`` with a vector literal, a batch at a time.
    """
    query = np.asarray(reference, dtype=np.float64)
    sign = -1.0 if lookup_metric(metric).descending else 1.0

    @F.arrow_udf("double")
    def measured(column: pa.Array) -> pa.Array:
        values = sign * measure(metric, vectors_of(column, len(query)), query)
        return pa.array(values, mask=np.isnan(values))

    return measured(vector)


def hash_codes(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One integer per table: bit b is set when the vector lies above plane b of that table.

    ``planes`` is (dimension, tables, bits).
    """
    dimension, tables, bits = planes.shape
    above = vectors @ planes.reshape(dimension, tables * bits) > 0
    return above.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits))


def sign_codes(vector: Column, planes: np.ndarray) -> Column:
    """``hash_codes`` as an array<int> column."""

    @F.arrow_udf("array<int>")
    def codes(column: pa.Array) -> pa.Array:
        found = hash_codes(vectors_of(column, planes.shape[0]), planes)
        return _lists(found.astype(np.int32), pa.int32())

    return codes(vector)


def _nearest(block: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and index of the nearest centre; the lowest index wins a tie.

    The matrix product decides unless two centres are closer than its rounding error; such rows
    are measured exactly.
    """
    sizes = (centres * centres).sum(axis=1)
    largest = (block * block).sum(axis=1).max(initial=0.0) + sizes.max(initial=0.0)
    slack = 16.0 * (block.shape[1] + 8) * np.finfo(np.float64).eps * largest
    rough = block @ (-2.0 * centres.T)
    rough += sizes
    close = rough <= rough.min(axis=1, keepdims=True) + slack
    index = close.argmax(axis=1)
    for row in np.flatnonzero(np.count_nonzero(close, axis=1) > 1):
        options = np.flatnonzero(close[row])
        gaps = centres[options] - block[row]
        index[row] = options[(gaps * gaps).sum(axis=1).argmin()]
    gaps = block - centres[index]
    return (gaps * gaps).sum(axis=1), index


def nearest_centre(vector: Column, cells: np.ndarray, centres: np.ndarray) -> Column:
    """The cell of the nearest centre."""
    return nearest_centre_gap(vector, cells, centres)["cell"]


def nearest_centre_gap(vector: Column, cells: np.ndarray, centres: np.ndarray) -> Column:
    """The squared distance and the cell of the nearest centre, as struct<gap, cell>.

    Centres are part of the task; a table too large for one pass is taken in several, and the
    nearest of their winners is kept. A filter on the cell is not moved below it, where the centres
    would be compared twice, by a Python worker more in every task.
    """
    per_pass = max(1, CENTRES_PER_PASS // centres.shape[1])

    def one_pass(start: int) -> Column:
        part_cells = cells[start : start + per_pass]
        part_centres = centres[start : start + per_pass]

        @F.arrow_udf("struct<gap: double, cell: int>")
        def winner(column: pa.Array) -> pa.Array:
            gaps, index = _nearest(vectors_of(column, part_centres.shape[1]), part_centres)
            return pa.StructArray.from_arrays(
                [pa.array(gaps), pa.array(part_cells[index].astype(np.int32))], ["gap", "cell"]
            )

        return winner.asNondeterministic()(vector)

    winners = [one_pass(start) for start in range(0, len(cells), per_pass)]
    return winners[0] if len(winners) == 1 else F.least(*winners)


def partial_sums(rows, schema: str):
    """(group, vector) rows to one row per task and group: (group, n, total array<double>)."""

    def run(batches):
        totals: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            block = vectors_of(batch.column(1), len(batch.column(1)[0]))
            for group in np.unique(groups).tolist():
                part = block[groups == group]
                n, total = totals.get(group, (0, 0.0))
                totals[group] = n + len(part), total + part.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(totals), pa.int64()),
                pa.array([n for n, _ in totals.values()], pa.int64()),
                pa.array([t.tolist() for _, t in totals.values()], pa.list_(pa.float64())),
            ],
            names=["group", "n", "total"],
        )

    return rows.mapInArrow(run, schema)
