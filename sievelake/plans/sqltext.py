"""Pieces of the SQL that checks a registered query."""

from __future__ import annotations

from ..functions.keyed import FACTORS, FOLD, LAST_SHIFT, MASK, SHIFTS, SPAN, STREAM_STEP

PI2 = "6.283185307179586"


def mix_sql(expr: str) -> str:
    for shift, factor in zip(SHIFTS, FACTORS):
        expr = f"((xor({expr}, {expr} >> {shift}) * {factor}) & {MASK})"
    return f"xor({expr}, {expr} >> {LAST_SHIFT})"


def keyed_sql(expr: str, stream: int = 0) -> str:
    key = f"CAST({expr} AS BIGINT)"
    offset = (stream * STREAM_STEP) & MASK
    return mix_sql(f"((({key} & {MASK}) + (({key} >> 31) & {MASK}) * {FOLD} + {offset}) & {MASK})")


def uniform_sql(expr: str, stream: int = 0) -> str:
    return f"(({keyed_sql(expr, stream)} + 0.5::DOUBLE) / {SPAN}::DOUBLE)"


def normal_sql(row_key: str, place: str) -> str:
    first = f"(({row_key} + CAST({place} AS BIGINT) * 2) & {MASK})"
    u1 = f"(({mix_sql(first)} + 0.5::DOUBLE) / {SPAN}::DOUBLE)"
    u2 = f"(({mix_sql(f'(({first} + 1) & {MASK})')} + 0.5::DOUBLE) / {SPAN}::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos({PI2}::DOUBLE * {u2}))"
