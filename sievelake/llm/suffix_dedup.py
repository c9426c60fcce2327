"""Removal of bytes that repeat an earlier document, with suffix arrays over shards.

A corpus-wide suffix array would be shuffled whole. Instead every 50-byte string is first given a key
that depends on its bytes alone, the smallest hash of its 18-byte substrings; runs of neighbouring strings
share a key. Strings whose key no other document has can't repeat. The runs of the other keys are brought
together by key, equal runs are merged, and a shard of runs that differ under one key gets a suffix array
by induced sorting; permuted common prefixes of 50 bytes then cut it into groups of equal strings, each
with the smallest document that has it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import kept, release_memory, shards
from .suffix_array import permuted_prefix_at_least, suffix_array

LENGTH = 50
_GRAM = 18
_WINDOW = LENGTH - _GRAM + 1

#: A suffix array is made of about so many bytes; runs under one key stay in one.
SHARD = 2 << 20

#: Stands for a null id, which is larger than any other.
_NO_ID = (1 << 63) - 1

#: Stands for no document, where no string starts.
_NONE = (1 << 63) - 1

#: Keys are computed over about so many bytes at a time, which a processor's cache holds.
PIECE = 128 << 10


def _byte_values() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_BYTES = _byte_values()


_ODD = 0x9E3779B97F4A7C15


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_ODD, k, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def runs(data: np.ndarray, sizes: np.ndarray):
    """(text, key, at, strings, digest) of the runs of 50-byte strings with one key, cut after 33 strings.

    ``data`` are the bytes of some texts of at least 50 bytes, one after another. The digest is one of all
    bytes of a run's strings: of the first string and the last, which together cover them.
    """
    h = _BYTES[data]
    two = h[:-1] * _power(1) + h[1:]
    h = two
    for size in (2, 4, 8):
        h = h[:-size] * _power(size) + h[size:]
    h16 = h
    h18 = h16[:-2] * _power(2) + two[16:]
    low = h = _mixed(h18)
    for size in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-size], low[size:])
    low = np.minimum(low[:-1], h[32:])
    begin = np.cumsum(sizes) - sizes
    stop = begin + sizes - (LENGTH - 1)
    fresh = np.append(True, low[1:] != low[:-1])
    # no string crosses from one text to the next
    fresh[(stop[:-1, None] + np.arange(LENGTH - 1)).ravel()] = False
    fresh[begin] = True
    first = np.flatnonzero(fresh)
    text = np.repeat(np.arange(len(sizes)), np.diff(np.searchsorted(first, np.append(begin, len(data)))))
    n = np.minimum(np.append(first[1:], len(data)), stop[text]) - first
    if n.max() > _WINDOW:
        parts = -(-n // _WINDOW)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(np.repeat(n, parts) - inner * _WINDOW, _WINDOW)
        first, text = np.repeat(first, parts) + inner * _WINDOW, np.repeat(text, parts)

    def string(at):
        return _mixed(_mixed(_mixed(h16[at]) * _power(3) + h16[at + 16]) * _power(5) + h18[at + 32])

    digest = _mixed(string(first) * _power(7) + string(first + n - 1) + n.astype(np.uint64))
    return text, low[first].view(np.int64), first - begin[text], n, digest.view(np.int64)


def _runs(docs: DataFrame, carry: list[str], found: list[str]) -> DataFrame:
    """A row per run of strings: the columns ``carry`` of its document and ``found`` of key, at, n, digest."""
    kinds = {"key": "long", "at": "int", "n": "int", "digest": "long"}
    rows = docs.select(*carry, F.col("text").cast("binary").alias("_text"))
    arrow = {"long": pa.int64(), "int": pa.int32()}

    def find(batches):
        for part in shards(batches, "_text", PIECE):
            texts = part.column("_text").combine_chunks()
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = part.filter(pa.array(sizes >= LENGTH))
            sizes = sizes[sizes >= LENGTH]
            if not len(sizes):
                continue
            data = np.frombuffer(b"".join(part.column("_text").to_pylist()), np.uint8)
            text, *columns = runs(data, sizes)
            columns = dict(zip(("key", "at", "n", "digest"), columns))
            carried = [part.column(c).combine_chunks().to_numpy(zero_copy_only=False)[text] for c in carry]
            new = [pa.array(columns[c].astype(arrow[kinds[c]].to_pandas_dtype(), copy=False)) for c in found]
            yield pa.RecordBatch.from_arrays([*map(pa.array, carried), *new], names=[*carry, *found])

    return rows.mapInArrow(find, ", ".join([f"{c} long" for c in carry] + [f"{c} {kinds[c]}" for c in found]))


def _field(column: pa.ListArray, name: str) -> np.ndarray:
    """A field of all structs in the lists of a column."""
    return column.flatten().field(name).to_numpy(zero_copy_only=False)


def _contexts(found: DataFrame) -> DataFrame:
    """(key, context, at, n, row, doc) from rows with text and the runs wanted of it."""

    def cut(batches):
        for batch in batches:
            wanted = batch.column("wanted")
            counts = wanted.value_lengths().to_numpy(zero_copy_only=False)
            key, at, n = (_field(wanted, c) for c in ("key", "at", "n"))
            ends, context, place = (at + n + (LENGTH - 1)).tolist(), [], 0
            starts = at.tolist()
            for text, count in zip(batch.column("_text"), counts.tolist()):
                text = text.as_py()
                context += [text[a:b] for a, b in zip(starts[place : place + count], ends[place : place + count])]
                place += count
            owners = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts)) for c in ("_row", "_doc")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(context, pa.binary()), pa.array(at), pa.array(n), *owners],
                ["key", "context", "at", "n", "row", "doc"],
            )

    return found.mapInArrow(cut, "key long, context binary, at int, n int, row long, doc long")


def smallest_documents(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each byte of the contexts in ``data``, one after another, the smallest document of the 50-byte
    string that starts there, by a suffix array of them all; none has the value of ``_NONE``."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # a value of their own between the contexts keeps common prefixes from crossing
    text = np.zeros(len(data) + len(sizes), np.uint16)
    place = np.arange(len(data)) + owner
    text[place] = data
    text[place] += 1
    order = suffix_array(text, LENGTH)
    # the place of a byte in ``data``, where a string starts at it
    back = np.full(len(text), -1)
    inside = np.flatnonzero(np.arange(len(data)) + LENGTH <= np.repeat(ends, sizes))
    back[place[inside]] = inside
    order = back[order]
    order = order[order >= 0]
    # equal strings stand together, so what is left has the same neighbours
    alike = permuted_prefix_at_least(data, order, LENGTH)
    fresh = ~alike[order]
    least = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(fresh))
    value = np.full(len(data), _NONE)
    value[order] = least[np.cumsum(fresh) - 1]
    return value


def _resolved(distinct: DataFrame) -> DataFrame:
    """(key, digest, first, hits) from (key, digest, context, doc), sorted by key within the tasks: the smallest
    document of a context, and the ranges of its strings that a still smaller one has."""

    def flush(held):
        part = pa.Table.from_batches(held)
        contexts = part.column("context").to_pylist()
        sizes = np.array([len(c) for c in contexts], np.int64)
        docs = part.column("doc").to_numpy()
        least = smallest_documents(np.frombuffer(b"".join(contexts), np.uint8), sizes, docs)
        hit = (least < np.repeat(docs, sizes)).astype(np.int8)  # the last bytes of a context start no string
        edges = np.flatnonzero(np.diff(hit, prepend=0, append=0)).reshape(-1, 2)
        begin = np.cumsum(sizes) - sizes
        owner = np.searchsorted(begin, edges[:, 0], "right") - 1
        ranges = [pa.array((edges[:, k] - begin[owner]).astype(np.int32)) for k in range(2)]
        offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(sizes)))).astype(np.int32)
        hits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(ranges, names=["a", "b"]))
        columns = [part.column(c).combine_chunks() for c in ("key", "digest", "doc")]
        return pa.RecordBatch.from_arrays([*columns, hits], ["key", "digest", "first", "hits"])

    def solve(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            lengths = pc.binary_length(batch.column("context")).to_numpy()
            before = np.cumsum(lengths, dtype=np.int64) - lengths
            start = 0
            other = np.append(last is not None and key[0] != last, key[1:] != key[:-1])
            for at in np.flatnonzero(other).tolist():
                if size + before[at] - before[start] >= SHARD:
                    held.append(batch.slice(start, at - start))
                    yield flush(held)
                    held, size, start = [], 0, at
            held.append(batch.slice(start))
            size += int(before[-1] + lengths[-1] - before[start])
            last = key[-1]
        if held:
            yield flush(held)
        release_memory()

    return distinct.mapInArrow(solve, "key long, digest long, first long, hits array<struct<a:int,b:int>>")


def _repeats(docs: DataFrame) -> DataFrame:
    """(row, spans): the byte ranges to remove, not merged, for rows (_row, _doc, text) that have some."""
    keys = _runs(docs, ["_doc"], ["key", "digest"]).groupBy("key").agg(
        F.min("_doc").alias("first"), F.max("_doc").alias("last"), F.min("digest").alias("low"), F.max("digest").alias("high")
    )
    keys = keys.where("first < last").select("key", "first", (F.col("low") != F.col("high")).alias("mixed"))
    shared = kept(keys, "shared").hint("shuffle_hash")
    found = _runs(docs, ["_row", "_doc"], ["key", "at", "n"]).join(shared, "key")
    # where all runs of a key are equal, the first document that has it keeps them
    found = found.where("mixed OR first < _doc").select("_row", "key", "at", "n", "mixed")
    found = kept(found.groupBy("_row", "mixed").agg(F.collect_list(F.struct("key", "at", "n")).alias("wanted")), "wanted")
    plain = found.where("NOT mixed").select(F.col("_row").alias("row"), F.inline("wanted"))
    plain = plain.select("row", _span(F.lit(0), F.col("n")))

    wanted = found.where("mixed").select(F.col("_row").alias("_wanted_by"), "wanted")
    texts = docs.join(wanted, F.col("_row") == F.col("_wanted_by")).select(F.col("text").cast("binary").alias("_text"), "wanted", "_row", "_doc")
    cut = kept(_contexts(texts).withColumn("digest", F.xxhash64("context")), "contexts")
    # the digest names a context under its key, so that the contexts themselves are dealt out once
    distinct = cut.groupBy("key", "digest").agg(F.min("doc").alias("doc"), F.min("context").alias("context"))
    solved = kept(_resolved(distinct.repartition("key").sortWithinPartitions("key")), "solved")
    # a later document than the first loses the whole context
    rows = cut.select("key", "digest", "at", "n", "row", "doc").join(solved, ["key", "digest"])
    rows = rows.where((F.col("first") < F.col("doc")) | (F.size("hits") > 0))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    rows = rows.select("row", "at", F.inline(F.when(F.col("first") < F.col("doc"), whole).otherwise(F.col("hits"))))
    found = rows.select("row", _span(F.col("a"), F.col("b"))).unionByName(plain)
    return kept(found.groupBy("row").agg(F.collect_list("span").alias("spans")), "spans")


def _span(a, b):
    """The strings ``a`` to ``b`` (without) of a run, as one byte range."""
    return F.struct((F.col("at") + a).alias("start"), (F.col("at") + b + (LENGTH - 1)).alias("end")).alias("span")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def dedup(docs: DataFrame, carry=("doc_id",), with_text: bool = False) -> DataFrame:
    """The carried columns, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    Null and empty texts have no bytes. A null id is larger than any other; rows of one id, repeated ones
    too, never remove each other's bytes. Texts below 50 bytes are kept. kept_text are bytes, as a removed
    span may begin or end inside a character. Carried columns named like a result are left out.
    """
    carry = [c for c in carry if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")]
    rows = docs.withColumn("_doc", F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).cast("long"))
    rows = rows.withColumn("_row", F.xxhash64("_doc", "text"))  # rows with one number are equal
    spans = _repeats(rows.select("_row", "_doc", "text").where(F.octet_length("text") >= LENGTH))
    both = rows.select(*[F.col(f"`{c}`") for c in carry], "_row", "text").join(spans, F.col("_row") == F.col("row"), "left")
    both = both.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("binary").alias("_text"), "spans")
    fields = {f.name: f for f in both.schema.fields}
    out = T.StructType([fields[c] for c in carry] + T.StructType.fromDDL(RESULT).fields)

    def remove(batches):
        for batch in batches:
            results, place = [], 0
            spans = batch.column("spans")
            counts = pc.fill_null(spans.value_lengths(), 0).to_pylist()
            ranges = list(zip(_field(spans, "start").tolist(), _field(spans, "end").tolist()))
            for text, size in zip(batch.column("_text"), counts):
                text, at, removed, count, pieces = text.as_py() or b"", 0, 0, 0, []
                place += size
                for start, end in sorted(ranges[place - size : place]):
                    if start > at or not count:
                        pieces.append(text[at:start])
                        count += 1
                        removed += end - start
                    else:
                        removed += max(0, end - at)
                    at = max(at, end)
                pieces.append(text[at:])
                left = b"".join(pieces)
                results.append((len(text), removed, count, hashlib.sha256(left).hexdigest(), left if with_text else None))
            columns = [batch.column(c) for c in carry]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns += [pa.array(v, k) for v, k in zip(zip(*results), kinds)] if results else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    found = both.mapInArrow(remove, out)
    return found if with_text else found.drop("kept_text")
