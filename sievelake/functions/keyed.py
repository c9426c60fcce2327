"""Randomness that depends only on a key.

``rand(seed)`` depends on how rows are partitioned, so a recomputed task may draw other numbers.
Here every draw is a pure integer function of (key, stream): the key is folded to 31 bits and
mixed by shifts and multiplications that stay within signed 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# The shift before each multiplication, the factors, the last shift.
SHIFTS = (16, 15)
FACTORS = (2146121005, 1540483477)
LAST_SHIFT = 16
MASK = 2147483647
SPAN = 2147483648
FOLD = 40692
STREAM_STEP = 1013904223


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def keyed_int(key: Column, stream: int = 0) -> Column:
    """A bigint in [0, SPAN) for a bigint key."""
    key = key.cast("bigint")
    low = key.bitwiseAND(_long(MASK))
    high = F.shiftrightunsigned(key, 31).bitwiseAND(_long(MASK))
    offset = (stream * STREAM_STEP) & MASK
    return mix((low + high * _long(FOLD) + _long(offset)).bitwiseAND(_long(MASK)))


def mix(value: Column) -> Column:
    """Mix a value already in [0, SPAN)."""
    for shift, factor in zip(SHIFTS, FACTORS):
        value = value.bitwiseXOR(F.shiftright(value, shift))
        value = (value * _long(factor)).bitwiseAND(_long(MASK))
    return value.bitwiseXOR(F.shiftright(value, LAST_SHIFT))


def keyed_uniform(key: Column, stream: int = 0) -> Column:
    """A double in (0, 1)."""
    return (keyed_int(key, stream) + F.lit(0.5)) / F.lit(float(SPAN))


# ---------------------------------------------------------------- the same for Arrow batches


def mixed(values: np.ndarray) -> np.ndarray:
    """``mix`` for an array of values in [0, SPAN)."""
    values = np.asarray(values, dtype=np.int64)
    for shift, factor in zip(SHIFTS, FACTORS):
        values = values ^ (values >> shift)
        values = (values * factor) & MASK
    return values ^ (values >> LAST_SHIFT)


def normals(row_keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A standard normal per (row key, place in the row), by Box-Muller.

    ``row_keys`` are ``keyed_int`` values; a place takes the two keys 2 * place and 2 * place + 1
    above its row's.
    """
    first = (row_keys + 2 * places) & MASK
    u1 = (mixed(first) + 0.5) / SPAN
    u2 = (mixed((first + 1) & MASK) + 0.5) / SPAN
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
