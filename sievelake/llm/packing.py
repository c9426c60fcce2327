"""Best-fit packing of token pieces into sequences by minimum bin slack.

Pieces are interchangeable when they have the same length, so bins are planned on the histogram of
lengths, which has one entry per possible length whatever the corpus. A plan is a list of patterns: a
combination of lengths found by a bitset subset-sum for the largest length left, and how many bins are
filled that way. Spark then numbers the pieces of each length and looks up their places.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import kept, per_text

CAPACITY = 2048
PIECES = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"

#: So many words keep their ids in a task's memory; the ids of others are found anew each time.
REMEMBERED = 500_000

#: Bits below the length in a key of length and rank.
_RANK_BITS = 44


def added_tokens(path: str) -> dict[str, int]:
    """The strings that the tokenizer file beside a rank file takes as one id wherever they stand."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} of {beside}: only plain ones are supported")
    return {token["content"]: token["id"] for token in added}


class Tokens:
    """Ids of a text by a byte-level BPE rank file, as little-endian unsigned 32-bit numbers.

    The splitting pattern starts a new part at every space before a visible character, so the words
    between spaces can be looked up one by one. Texts with other spaces are encoded whole. The added tokens of
    the JSON file of the same name beside the rank file, where there is one, are cut out of a text first.
    """

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Known(dict):
            def __missing__(self, word):
                found = array("I", encode(" " + word)).tobytes()
                if len(self) < REMEMBERED and len(word) < 64:
                    self[word] = found
                return found

        self.encode, self.known = encode, Known()
        self.odd = re.compile(r" (?=\s|\Z)").search
        self.added = added_tokens(path)
        names = sorted(self.added, key=len, reverse=True)  # of those that start at one place the longest
        self.cut = re.compile(f"({'|'.join(map(re.escape, names))})").split if names else None

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not any(name in text for name in self.added):
            return self.ordinary(text)
        parts = self.cut(text)  # every second one is an added token
        return b"".join(
            array("I", [self.added[part]]).tobytes() if k % 2 else self.ordinary(part) for k, part in enumerate(parts) if part
        )

    def ordinary(self, text: str) -> bytes:
        if self.odd(text):
            return array("I", self.encode(text)).tobytes()
        first, *words = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.known.__getitem__, words))


_TOKENS: dict[tuple[str, str], Tokens] = {}


def tokens(path: str, pattern: str) -> Tokens:
    """One per worker process and file."""
    if (path, pattern) not in _TOKENS:
        _TOKENS[path, pattern] = Tokens(path, pattern)
    return _TOKENS[path, pattern]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` tokens: all are full but the first."""
    head = total % capacity or capacity
    starts = [0, *range(head, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def _cutter(path, pattern, capacity):
    def make():
        ids_of = tokens(path, pattern)

        def pieces(texts):
            out = []
            for text in texts:
                ids = ids_of(text.decode() if text else "") + b"\0\0\0\0"
                out.append(
                    [
                        {"piece": k, "start": a, "length": n, "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + n)])}
                        for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))
                    ]
                )
            return [out]

        return pieces

    return make


def fullest(pivot: int, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The lengths, with their numbers, that fill a bin holding ``pivot`` best.

    Bit s of a bitset says that some of the available lengths sum to s; available numbers are split
    into powers of two. Walking back through the bitsets gives the combination.
    """
    room = capacity - pivot
    bits, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = min(int(counts[length]) - (length == pivot), room // length)
        size = 1
        while left > 0 and not bits >> room:
            take = min(size, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            size *= 2
        if bits >> room:
            break
    goal = bits.bit_length() - 1
    chosen = {pivot: 1}
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            goal -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, number of bins) until every counted length is used up."""
    counts = counts.astype(np.int64).copy()
    out = []
    while len(left := np.flatnonzero(counts)):
        chosen = fullest(int(left[-1]), counts, capacity)
        times = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        out.append((chosen, times))
    return out


class Places:
    """Where the piece of a length and a rank goes: at most one entry per pattern and length."""

    def __init__(self, patterns, capacity: int):
        used, entries, first = np.zeros(capacity + 1, np.int64), [], 0
        for chosen, times in patterns:
            offset = 0
            for length, n in chosen.items():
                entries.append(((length << _RANK_BITS) + used[length], n, first, offset))
                used[length] += n * times
                offset += length * n
            first += times
        self.key, self.number, self.first, self.offset = np.array(sorted(entries), np.int64).reshape(-1, 4).T

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << _RANK_BITS) + rank
        at = np.searchsorted(self.key, key, "right") - 1
        within = key - self.key[at]
        return self.first[at] + within // self.number[at], self.offset[at] + within % self.number[at] * length


def pieces(docs: DataFrame, path: str, pattern: str, carry=("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """The carried columns and piece, start, length, ids_crc32: every text with a closing id 0, cut."""
    found = per_text(docs, _cutter(path, pattern, capacity), PIECES, carry)
    return found.select(*[c for c in found.columns if c != "pieces"], F.inline("pieces"))


def pack(docs: DataFrame, path: str, pattern: str, carry=("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the sequence it is put into and its offset there, gapless from 0.

    Null and empty texts are a piece of one token, id 0. Equal rows are packed each. An empty table gives
    an empty one. Carried columns that are named like a result are left out. Pieces are numbered within
    (task, length), so that a length that very many pieces have is never gathered in one place.
    """
    spark = docs.sparkSession
    found = kept(
        pieces(docs, path, pattern, carry, capacity).withColumn("_part", F.spark_partition_id()), "pieces"
    )
    numbers = kept(found.groupBy("_part", "length").count(), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in numbers.groupBy("length").agg(F.sum("count")).collect():  # at most one row per length
        counts[length] = n
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity), capacity))

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbers.select(
        "_part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    order = Window.partitionBy("_part", "length").orderBy("ids_crc32", "start", "piece")
    ranked = found.withColumn("_rank", F.row_number().over(order)).join(starts, ["_part", "length"])
    columns = [c for c in found.columns if c != "_part"]
    ranked = ranked.select(*columns, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("_rank"))
    out = T.StructType([found.schema[c] for c in columns] + T.StructType.fromDDL("sequence_id long, offset long").fields)

    def put(batches):
        for batch in batches:
            where = places.value(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            arrays = [batch.column(c) for c in columns] + [pa.array(x) for x in where]
            yield pa.RecordBatch.from_arrays(arrays, names=out.fieldNames())

    return ranked.mapInArrow(put, out)
