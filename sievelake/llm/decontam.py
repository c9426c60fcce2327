"""Benchmark decontamination by suffix arrays over shards of the training text.

Each task turns its documents into shards of word numbers, sorts the suffixes of a shard, and
binary-searches every suffix of the benchmark in it. The insertion point gives the longest verbatim
match; windows that the match covers are located by two further searches. Nothing is shuffled: a
document's hits come from its own shard. Words that no benchmark item has cannot be part of a match,
so suffixes starting within a shortest window of one are left out of the array.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import per_text, whole_rows

WINDOW = 10

#: The benchmark goes to the tasks in blocks of about so many bytes of text.
BLOCK_BYTES = 16 << 20

ADDED = """n_hit long, n_items long, items_sha256 string, contaminated boolean,
    longest struct<start:int,length:int>"""
FOUND = "n_words long, spans binary, items array<long>, matches array<struct<start:int,length:int>>"

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


class Block:
    """Word numbers of some benchmark items: the test suffixes and the windows."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items, runs, starts, lengths, ends, owners = [], [np.zeros(0, np.int32)], [], [], [], []
        at = 0
        for item, text in items:
            found = words(text)
            if not found:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            span = min(window, len(ids))
            for i in range(len(ids) - span + 1):
                starts.append(at + i)
                lengths.append(span)
                ends.append(at + len(ids))
                owners.append(len(self.items))
            self.items.append(item)
            runs.append(np.array(ids, np.int32))
            at += len(ids)
        self.text = np.concatenate(runs)
        self.start, self.length, self.end, self.owner = (
            np.array(x, np.int64) for x in (starts, lengths, ends, owners)
        )
        self.shortest = int(self.length.min()) if len(self.length) else window

    def encode(self, found: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in found), np.int32, len(found))


def suffix_array(text: np.ndarray, shortest: int) -> np.ndarray:
    """Positions followed by at least ``shortest`` numbers above 0, in the order of their suffixes.

    Prefix doubling: ranks by the first h numbers give ranks by the first 2h. A suffix ends before the
    next 0.
    """
    n = len(text)
    zero = np.append(np.flatnonzero(text == 0), n)
    left = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
    at = np.flatnonzero(left >= shortest)
    if not len(at):
        return at
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = text
    longest, h = int(left.max()), 1
    live = np.flatnonzero(text)
    while h < longest:
        second = np.minimum(live + h, n)
        key = rank[live] * (int(rank.max()) + 1) + np.where(left[live] > h, rank[second], 0)
        values, place = np.unique(key, return_inverse=True)
        rank[live] = place + 1
        h *= 2
        if len(values) == len(live):
            break
    return at[np.argsort(rank[at], kind="stable")]


def _beyond(text, p, test, q, length, after):
    """Per pair: is text[p:] below test[q:q+length] (after: or does it start with it)? And the common length."""
    below = np.full(len(p), after)
    common = length.copy()
    live = np.arange(len(p))
    step = 0
    while len(live):
        live = live[length[live] > step]
        x = p[live] + step
        a = np.where(x < len(text), text[np.minimum(x, len(text) - 1)], 0)
        b = test[q[live] + step]
        other = a != b
        gone = live[other]
        below[gone] = a[other] < b[other]
        common[gone] = step
        live = live[~other]
        step += 1
    return below, common


def _search(text, order, test, q, length, after):
    """Per test string: the first place in ``order`` whose suffix isn't below it (after: is above it)."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order))
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        below, _ = _beyond(text, order[middle], test, q[live], length[live], after)
        low[live] = np.where(below, middle + 1, low[live])
        high[live] = np.where(below, high[live], middle)
    return low


def locate(text: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, window, longest match) of every occurrence of a window in the shard ``text``."""
    empty = np.zeros(0, np.int64)
    order = suffix_array(text, block.shortest) if len(block.start) else empty
    if not len(order):
        return empty, empty, empty
    q, whole = block.start, block.end - block.start
    place = _search(text, order, block.text, q, whole, False)
    longest = np.zeros(len(q), np.int64)
    for near in (place - 1, place):
        inside = (near >= 0) & (near < len(order))
        _, common = _beyond(text, order[np.clip(near, 0, len(order) - 1)], block.text, q, whole, False)
        longest = np.maximum(longest, np.where(inside, common, 0))
    fit = np.flatnonzero(longest >= block.length)
    first = _search(text, order, block.text, q[fit], block.length[fit], False)
    last = _search(text, order, block.text, q[fit], block.length[fit], True)
    times = last - first
    window = np.repeat(fit, times)
    inner = np.arange(len(window)) - np.repeat(np.cumsum(times) - times, times)
    return order[np.repeat(first, times) + inner], window, np.repeat(longest[fit], times)


def _finder(block_of):
    def make():
        block = block_of()

        def find(texts):
            runs, counts = [], []
            gap = np.zeros(1, np.int32)
            for text in texts:
                ids = block.encode(words(text))
                counts.append(len(ids))
                runs += [ids, gap]
            shard = np.concatenate(runs)
            begin = np.cumsum([0] + [c + 1 for c in counts])
            position, window, longest = locate(shard, block)
            covered = np.zeros(len(shard) + 1, np.int64)
            np.add.at(covered, position, 1)
            np.add.at(covered, position + block.length[window], -1)
            hit = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered) > 0).astype(np.int8), [0]))))
            hit = hit.reshape(-1, 2)
            doc = np.searchsorted(begin, position, "right") - 1
            spans, items, matches = ([b""] * len(texts), [[] for _ in texts], [[] for _ in texts])
            span_doc = np.searchsorted(begin, hit[:, 0], "right") - 1
            for d in np.unique(span_doc):
                spans[d] = (hit[span_doc == d] - begin[d]).astype("<i8").tobytes()
            pairs = np.unique(np.stack([doc, block.owner[window]]), axis=1)
            for d, owner in pairs.T.tolist():
                if block.items[owner] is not None:
                    items[d].append(block.items[owner])
            best = np.lexsort((position, -longest, doc))
            for k in best[np.unique(doc[best], return_index=True)[1]].tolist():
                matches[doc[k]].append({"start": int(position[k] - begin[doc[k]]), "length": int(longest[k])})
            return counts, spans, items, matches

        return find

    return make


def _digest(parts):
    """Merged spans and items of one document, as the result's columns."""
    runs = np.concatenate([np.frombuffer(s, "<i8").reshape(-1, 2) for s in parts["spans"]] or [np.zeros((0, 2))])
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    hit, upto = 0, 0
    for start, end in runs.tolist():
        hit += max(0, end - max(start, upto))
        upto = max(upto, end)
    ids = sorted({str(i) for i in parts["items"]})
    return hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The benchmark in blocks that are each small enough to be sent to every task, as broadcasts."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else rows
        yield spark.sparkContext.broadcast(Block([(r.item_id, r.text) for r in part.toLocalIterator()], window))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    carry=("doc_id",),
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document the carried columns and: n_words, n_hit (words inside a benchmark window),
    n_items and items_sha256 (items with such windows), contaminated, longest (the first of its longest
    verbatim matches, in words, null without one).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A null or empty
    text has no words; items without words are ignored; an item with a null id marks words but is not
    listed; repeated items count once and repeated documents each give their row. An empty benchmark
    hits nothing. A benchmark above ``block_bytes`` is searched block by block and a document's hits are
    merged.
    """
    parts = list(blocks(benchmark, window, block_bytes))
    if len(parts) > 1:
        docs, carry = docs.withColumn("_text_key", F.sha2("text", 256)), (*carry, "_text_key")
    found = [per_text(docs, _finder(lambda b=part: b.value), FOUND, carry) for part in parts]
    keys = [c for c in found[0].columns if c not in ("spans", "items", "matches")]
    rows = found[0].select(*keys, F.array("spans").alias("spans"), "items", "matches")
    if len(found) > 1:
        # equal rows are counted in each block and repeated afterwards
        numbered = [f.withColumn("_block", F.lit(k)) for k, f in enumerate(found)]
        both = numbered[0]
        for f in numbered[1:]:
            both = both.unionByName(f)
        merged = both.groupBy(*keys, "_block").agg(
            F.count("*").alias("_times"),
            F.first("spans").alias("spans"),
            F.first("items").alias("items"),
            F.first("matches").alias("matches"),
        )
        rows = merged.groupBy(*keys).agg(
            F.max("_times").alias("_times"),
            F.collect_list("spans").alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
            F.flatten(F.collect_list("matches")).alias("matches"),
        )
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        rows = rows.drop("_times", "_copy")

    keys = [c for c in keys if c != "_text_key"]
    rows = rows.select(*keys, "spans", "items", "matches")
    out = rows.select(*keys).schema
    out = T.StructType(out.fields + T.StructType.fromDDL(ADDED).fields)

    def finish(batches):
        for batch in batches:
            hit, number, digest, longest = [], [], [], []
            for spans, items, matches in zip(
                batch.column("spans").to_pylist(), batch.column("items").to_pylist(), batch.column("matches").to_pylist()
            ):
                h, n, sha = _digest({"spans": spans, "items": items})
                hit.append(h)
                number.append(n)
                digest.append(sha)
                longest.append(max(matches, key=lambda m: (m["length"], -m["start"]), default=None))
            columns = [batch.column(c) for c in keys]
            columns += [
                pa.array(hit, pa.int64()),
                pa.array(number, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
                pa.array(longest, pa.struct([("start", pa.int32()), ("length", pa.int32())])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return rows.mapInArrow(finish, out)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns."""
    rows = decontaminate(whole_rows(docs), benchmark, carry=("_row",))
    return rows.where(~F.col("contaminated")).select("_row.*")
