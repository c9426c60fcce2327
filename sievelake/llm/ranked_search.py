"""Ranked lexical search over an index in strata of documents of equal length normaliser.

A term weighs ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document of n terms has the normaliser
``m = 10 + (90 n N) div L``, and a term that it holds tf times adds ``w * ((10^9 tf) div (1000 tf + 8 m))`` to its
score (N documents with terms, L terms in all). Since documents of a stratum share m, an impact depends
on (term, tf) alone there.

Build: texts are dealt out by ranges of (m, hash of the document), so a stratum with a third of all documents
is spread over many tasks. A task cuts each stratum into units of at most ``UNIT_DOCS`` documents and
``UNIT_BYTES`` of text (or one longer document) and writes a row per term: the documents of the unit that
hold it, grouped by tf. The row without a term lists the unit's ids.

Search: items come in blocks. Their postings are picked out of the index by a broadcast of the block's
terms and brought together by unit; only these are shuffled. The largest tf of a term in a stratum
bounds what the stratum can score; the strata with the highest bounds of each item are visited first and
give every item a score to beat, which then rules out units by their own bounds. Impacts are computed once per
(term, tf) of a unit and shared by all items. Bounds only skip what cannot enter a result.

Results on edge cases:

* null and empty texts, and texts without terms, are not documents (they don't count in N) and are never found;
* items without terms, or whose terms no document holds, have no rows; an item repeated in the table gets
  its rows each time, under its own item_id (null included);
* equal scores are ordered by doc_id, null first; documents that share an id are ranked separately;
* very long texts are read whole; an empty table on either side gives no rows;
* columns beyond doc_id, text and item_id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievelake.session import local_table

from .common import ARROW_ROWS, kept, setting

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z to a-z, and every other ASCII character but digits and letters to a space.
FOLDED = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)

UNIT_DOCS = 1024
UNIT_BYTES = 4 << 20
#: Units, and texts, that a Python worker gets at once.
UNITS_AT_ONCE, TEXTS_AT_ONCE = 4, 1000
#: Text of so many bytes is dealt to one part of the index.
PART_BYTES = 16 << 20

#: A block of items ends after so many items or terms.
BLOCK_ITEMS = 512
BLOCK_TERMS = 100_000

#: Strata of each item that are visited first.
FIRST_STRATA = 4

POSTINGS = "unit bigint, m bigint, term string, tfs array<int>, sizes array<int>, docs array<int>, ids array<bigint>"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


# ---------------------------------------------------------------- index


@dataclass
class Index:
    """``postings`` as above, (unit, m, term, tfs, sizes, docs, ids), N ``documents`` and L ``terms``."""

    postings: DataFrame
    documents: int
    terms: int


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Consecutive pieces of ``values`` that end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def unit_rows(unit: int, m: int, ids: list, texts: list[bytes], arrow: pa.Schema) -> pa.RecordBatch:
    """The postings of the documents of one unit, and its row of ids."""
    split = [terms_of(text) for text in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array([term for terms in split for term in terms], pa.binary()).dictionary_encode()
    of_doc = np.repeat(np.arange(len(split)), lengths)
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(split) + of_doc, return_counts=True)
    term, doc = pairs // len(split), pairs % len(split)
    order = np.lexsort((doc, tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_tf = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tf, prepend=0) != 0))
    term_ends = np.append(new_term[1:], len(term))
    tf_ends = np.searchsorted(new_tf, term_ends)
    rows = len(new_term)
    names = coded.dictionary.cast(pa.string()).take(pa.array(term[new_term]))
    sizes = np.diff(np.append(new_tf, len(term)))
    none = pa.nulls(1, pa.list_(pa.int32()))
    columns = [
        pa.array(np.full(rows + 1, unit)),
        pa.array(np.full(rows + 1, m)),
        pa.concat_arrays([names, pa.nulls(1, pa.string())]),
        pa.concat_arrays([_lists(tf_ends, pa.array(tf[new_tf], pa.int32())), none]),
        pa.concat_arrays([_lists(tf_ends, pa.array(sizes, pa.int32())), none]),
        pa.concat_arrays([_lists(term_ends, pa.array(doc, pa.int32())), none]),
        pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64()))]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=arrow.names).cast(arrow)


def inverted(arrow: pa.Schema):
    """Rows (m, doc_id, text) in the order of m to the postings of their units."""

    def run(batches):
        unit = TaskContext.get().partitionId() << 32
        ids, texts, size, last = [], [], 0, None
        for batch in batches:
            for m, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                if ids and (m != last or len(ids) == UNIT_DOCS or size + len(text) > UNIT_BYTES):
                    yield unit_rows(unit, last, ids, texts, arrow)
                    ids, texts, size, unit = [], [], 0, unit + 1
                last = m
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield unit_rows(unit, last, ids, texts, arrow)

    return run


def counted(batches):
    """(n, bytes) of every text."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        sizes = [len(text or b"") for text in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(terms_of(text)) for text in texts], pa.int64()), pa.array(sizes, pa.int64())],
            names=["n", "size"],
        )


def dealt(strata: list[tuple[int, int]], documents: int, terms: int, per_part: float):
    """Documents to (part, m, doc_id, text): parts are ranges of (m, hash) of about ``per_part`` documents."""
    numbers = np.array([m for m, _ in strata], np.int64)
    sizes = np.array([size for _, size in strata], np.float64)
    before = np.cumsum(sizes) - sizes

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = np.array([len(terms_of(text)) for text in texts], np.int64)
            some = np.flatnonzero(n > 0)
            m = np.array([10 + 90 * int(x) * documents // terms for x in n[some]], np.int64)
            spread = batch.column("spread").to_numpy()[some]
            at = np.searchsorted(numbers, m)
            part = ((before[at] + spread * sizes[at]) // per_part).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part), pa.array(m), batch.column("doc_id").take(pa.array(some)),
                    pa.array([texts[i] for i in some.tolist()], pa.binary()),
                ],
                names=["part", "m", "doc_id", "text"],
            )

    return run


def build(docs: DataFrame) -> Index:
    """The stored index of all documents.

    Texts are read twice, to count terms and to deal them out, and shuffled once. The driver sees one number
    per stratum, of which there are at most 90 times as many as the longest document exceeds the average.
    """
    with setting(docs.sparkSession, ARROW_ROWS, str(TEXTS_AT_ONCE)):
        return _build(docs)


def _build(docs: DataFrame) -> Index:
    text = F.col("text").cast("binary").alias("text")
    lengths = kept(docs.select(text).mapInArrow(counted, "n bigint, size bigint"), "lengths").where("n > 0")
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l"), F.sum("size").alias("b")).first()
    n, length = total["n"], total["l"] or 1
    m = F.expr(f"10 + (90 * n * {n}L) div {length}L").alias("m")
    strata = sorted((r["m"], r["count"]) for r in lengths.groupBy(m).count().collect())
    parts = max(1, math.ceil((total["b"] or 0) / PART_BYTES))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, spread.alias("spread"))
    deal = dealt(strata, n, length, n / parts)
    rows = rows.mapInArrow(deal, "part bigint, m bigint, doc_id bigint, text binary")
    rows = rows.repartition("part").sortWithinPartitions("part", "m").select("m", "doc_id", "text")
    made = rows.mapInArrow(inverted(to_arrow_schema(T.StructType.fromDDL(POSTINGS))), POSTINGS)
    return Index(kept(made, "postings"), n, total["l"] or 0)


# ---------------------------------------------------------------- search


@dataclass
class Item:
    number: int
    item_id: object
    terms: list[str]


def item_blocks(items: DataFrame) -> Iterator[list[Item]]:
    """The items in blocks of bounded size, streamed to the driver."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator()
    block, size = [], 0
    for number, row in enumerate(rows):
        terms = sorted({t.decode() for t in terms_of(row["text"])})
        if not terms:
            continue
        if block and (len(block) == BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append(Item(number, row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def better(kept_so_far: list, scores: np.ndarray, ids: list, least: int, k: int) -> list:
    """The k best (score, id), best first, of those kept and of the documents of a unit."""
    found = np.flatnonzero(scores >= max(least, 1))
    if len(found) > k:
        cut = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= cut]
    rows = kept_so_far + [(int(scores[i]), ids[i]) for i in found]
    return sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))[:k]


def scored(block: list[Item], weights: dict[str, int], k: int, to_beat: dict[int, int], only: dict | None):
    """Units to the k best documents of each item among a task's units: (number, score, doc_id).

    ``to_beat`` holds a score that k documents of an item reach; ``only`` the items wanted of a stratum.
    """
    place = {term: i for i, term in enumerate(weights)}
    w = np.array(list(weights.values()), np.int64)
    of_item = [np.array([place[t] for t in item.terms if t in place], np.int64) for item in block]
    flat = np.concatenate([np.append(terms, len(w)) for terms in of_item])  # a 0 ends each item
    starts = np.cumsum([0] + [len(terms) + 1 for terms in of_item[:-1]])
    beat = np.array([to_beat.get(item.number, 1) for item in block], np.int64)

    def run(batches):
        best: list[list] = [[] for _ in block]
        least = beat.copy()
        for batch in batches:
            for m, ids, postings in zip(batch.column("m").to_pylist(), batch.column("ids"), batch.column("postings")):
                ids, postings = ids.as_py(), postings.values
                most = np.zeros(len(w) + 1, np.int64)
                adds = {}
                columns = [postings.field(c) for c in ("tfs", "sizes", "docs")]
                for j, term in enumerate(postings.field("term").to_pylist()):
                    tf, sizes, docs = (c[j].values.to_numpy(zero_copy_only=False) for c in columns)
                    t, tf = place[term], tf.astype(np.int64)
                    impact = w[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                    adds[t] = docs, np.repeat(impact, sizes)
                    most[t] = impact[-1]
                bounds = np.add.reduceat(most[flat], starts)
                for i in np.flatnonzero((bounds >= least) & (bounds > 0)).tolist():
                    if only is not None and block[i].number not in only.get(m, ()):
                        continue
                    scores = np.zeros(len(ids), np.int64)
                    for t in of_item[i].tolist():
                        if t in adds:
                            docs, add = adds[t]
                            scores[docs] += add
                    best[i] = better(best[i], scores, ids, least[i], k)
                    if len(best[i]) == k:
                        least[i] = max(least[i], best[i][-1][0])
        rows = [(block[i].number, *r) for i, found in enumerate(best) for r in found]
        numbers, scores, ids = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64())],
            names=["number", "score", "doc_id"],
        )

    return run


FOUND = "number bigint, score bigint, doc_id bigint"


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, from at most k rows per task and item."""
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(index: Index, block: list[Item], k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for one block of items; None if no document holds any of its terms."""
    spark = index.postings.sparkSession
    terms = sorted({t for item in block for t in item.terms})
    asked = local_table(spark, [(t,) for t in terms] + [(None,)], "asked string")
    hits = index.postings.join(F.broadcast(asked), F.col("term").eqNullSafe(F.col("asked")))
    posting = F.when(F.col("term").isNotNull(), F.struct("term", "tfs", "sizes", "docs"))
    units = hits.groupBy("unit", "m").agg(
        F.flatten(F.collect_list("ids")).alias("ids"), F.collect_list(posting).alias("postings")
    )
    units = kept(units.where(F.size("postings") > 0), "units")
    held = units.select("m", F.size("ids").alias("docs"), F.explode("postings").alias("p"))
    held = held.select(
        "m", "p.term", F.element_at("p.tfs", -1).alias("tf"), F.size("p.docs").cast("bigint").alias("df")
    )
    in_stratum = kept(held.groupBy("m", "term").agg(F.max("tf").alias("tf"), F.sum("df").alias("df")), "strata")
    frequency = in_stratum.groupBy("term").agg(F.sum("df").alias("df")).collect()  # the block's terms
    if not frequency:
        return None
    weights = {r["term"]: weight(index.documents, r["df"]) for r in frequency}

    wanted = [(item.number, t, weights[t]) for item in block for t in item.terms if t in weights]
    wanted = local_table(spark, wanted, "number bigint, term string, w bigint")
    impact = F.expr("w * ((1000000000 * bigint(tf)) div (1000 * bigint(tf) + 8 * m))")
    bounds = in_stratum.join(F.broadcast(wanted), "term").groupBy("number", "m").agg(F.sum(impact).alias("bound"))
    order = Window.partitionBy("number").orderBy(F.col("bound").desc(), "m")
    first = bounds.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= FIRST_STRATA)
    only: dict[int, set] = {}
    for r in first.select("number", "m").collect():
        only.setdefault(r["m"], set()).add(r["number"])
    columns = units.select("m", "ids", "postings")
    start = columns.where(F.col("m").isin(list(only))).mapInArrow(scored(block, weights, k, {}, only), FOUND)
    to_beat = {r["number"]: r["score"] for r in merged(start, k).where(F.col("rank") == k).collect()}
    found = merged(columns.mapInArrow(scored(block, weights, k, to_beat, None), FOUND), k)
    return found.select("number", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of every item: (item_id, rank, doc_id, score)."""
    spark = items.sparkSession
    with setting(spark, ARROW_ROWS, str(UNITS_AT_ONCE)):
        return _search(index, items, k)


def _search(index: Index, items: DataFrame, k: int) -> DataFrame:
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType
    ids = T.StructType([T.StructField("number", T.LongType()), T.StructField("item_id", kind)])
    out = T.StructType([ids["item_id"], *T.StructType.fromDDL("rank int, doc_id bigint, score bigint")])
    parts = []
    for block in item_blocks(items):
        found = search_block(index, block, k)
        if found is not None:
            named = local_table(spark, [(item.number, item.item_id) for item in block], ids)
            parts.append(kept(found.join(F.broadcast(named), "number").select(*out.fieldNames()), "ranked"))
    result = local_table(spark, [], out)
    for part in parts:
        result = result.unionByName(part)
    return result


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Build the index of ``docs`` and search it for ``items``."""
    return search(build(docs), items, k)
