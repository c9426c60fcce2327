"""Near duplicates: an exact Jaccard join of word-shingle sets by rare-first prefixes.

Sets are ordered rarest shingle first, by counts in a sketch of fixed size (any order gives the same
links, a good one gives short posting lists). Two sets that are similar enough share a shingle of their
prefixes. Equal sets are one node. A posting list is not paired with itself: its members are compared
with one of them, the pivot; members that a link has put into one class need no further comparison, and
what is left over in lists that still hold several classes is paired across classes at the end. So no
class that the links imply is missed, and a list of near copies costs one comparison a member. Pairs are compared by
a signature of the parities of their hashes first, which rules out most of those that don't link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import kept, per_text, shards
from .components import smallest_reachable

SHINGLE, PERCENT = 5, 75

#: Slots of the sketch of shingle counts; its size doesn't depend on the corpus.
SLOT_BITS = 20
_BLOCK = 1 << 14

#: So often the members of a list are compared with a pivot, before what is left is paired across classes.
ROUNDS = 2

#: Bits of a signature, 64 in a word.
SIGNED = 1024

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of a shorter text, of all its words.

    Words are hashed each time: a table of hundreds of thousands of words is slower to look up.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    values = _mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    size = min(SHINGLE, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += values[k : k + len(total)] * _POWERS[k]
    found = np.sort(_mixed(total + np.uint64(size)))
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def _number(found: np.ndarray) -> int:
    """The set's number: a 64-bit hash of its members."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def signature(found: np.ndarray) -> np.ndarray:
    """Per remainder of the hashes by SIGNED, whether an odd number of them has it: SIGNED bits in longs."""
    odd = np.bincount((found & np.uint64(SIGNED - 1)).astype(np.int64), minlength=SIGNED) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame):
    """A broadcast of counts of shingles by the top bits of their hash, each once per document."""
    slots = 1 << SLOT_BITS

    def count(batches):
        total = np.zeros(slots, np.int64)
        for part in shards(batches, "text", 8 << 20):
            for text in part.column("text").to_pylist():
                np.add.at(total, (shingles(text) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        for k in range(0, slots, _BLOCK):
            if total[k : k + _BLOCK].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([total[k : k + _BLOCK].tobytes()], pa.binary())], ["block", "counts"]
                )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"]
            )

    schema = "block int, counts binary"
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)
    parts = parts.repartition("block").mapInArrow(add, schema)  # at most 64 blocks of 128 KB from each task
    total = np.zeros(slots, np.int64)
    for row in kept(parts, "sketch").collect():  # the sketch: 8 MB
        total[row.block : row.block + _BLOCK] = np.frombuffer(row.counts, np.int64)
    return docs.sparkSession.sparkContext.broadcast(np.minimum(total, 1 << 31).astype(np.uint32))


def sets(docs: DataFrame, counts, carry=("doc_id",)) -> DataFrame:
    """The carried columns, n_shingles, set (its number, null when empty) and prefix (rarest first)."""

    def make():
        def find(texts):
            sizes, numbers, prefixes = [], [], []
            for text in texts:
                found = shingles(text)
                n = len(found)
                sizes.append(n)
                numbers.append(_number(found) if n else None)
                often = counts.value[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[: n - -(-PERCENT * n // 100) + 1] if n else []
                prefixes.append(found[first].view(np.int64))
            flat = pa.ListArray.from_arrays(
                np.cumsum([0] + [len(p) for p in prefixes]).astype(np.int32),
                pa.array(np.concatenate(prefixes or [np.zeros(0, np.int64)])),
            )
            return sizes, numbers, flat

        return find

    return per_text(docs, make, "n_shingles long, set long, prefix array<long>", carry)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, of sorted distinct hashes.

    The suffix filter comes first: the sets are cut into 64 ranges of hashes, which can share no more
    than the smaller number of members in each.
    """
    least = -(-PERCENT * (len(x) + len(y)) // (100 + PERCENT))
    if min(len(x), len(y)) < least:
        return False
    ranges = [np.bincount((v >> np.uint64(58)).astype(np.int64), minlength=64) for v in (x, y)]
    if np.minimum(*ranges).sum() < least:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= least


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) for the pairs (a, b) of set numbers; texts holds (set, text)."""
    left = texts.select(F.col("set").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def check(batches):
        known = (None, None)
        for batch in batches:
            linked = []
            b = batch.column("b").to_pylist()
            for at, (x, y) in enumerate(zip(batch.column("text_a"), batch.column("text_b"))):
                if known[0] != b[at]:
                    known = (b[at], shingles(y.as_py()))
                linked.append(similar(shingles(x.as_py()), known[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    return both.mapInArrow(check, "a long, b long, linked boolean")


def _fits(x, y):
    """Length and positional filter of two posts, structs of set, n, at and before, of one list.

    ``before`` counts the shingles ahead in the order that any other prefix has; only those can be common
    to both ahead of this one, and no more than what is left can be behind it.
    """
    length = 100 * F.least(x["n"], y["n"]) >= PERCENT * F.greatest(x["n"], y["n"])
    shared = F.least(x["before"], y["before"]) + F.least(x["n"] - x["at"], y["n"] - y["at"])
    return length & ((100 + PERCENT) * shared >= PERCENT * (x["n"] + y["n"])) & (x["set"] != y["set"])


def _may_link(x, y, n_x, n_y):
    """Whether the signatures leave room for a link: each bit that differs is a shingle that one set lacks.

    Linked sets have a symmetric difference of at most (100 - PERCENT) / (100 + PERCENT) of their sizes' sum.
    """
    apart = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, SIGNED // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (n_x + n_y)


def postings(one: DataFrame) -> DataFrame:
    """(token, post, central) for prefix shingles that two sets have; post: set, n, at, before.

    ``central`` is the share of a set's prefix that other prefixes have too: the text that near copies
    were made from has the largest.
    """
    tokens = one.select("set", F.posexplode("prefix").alias("at", "token"))
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    posts = kept(tokens.join(kept(shared, "shared").hint("shuffle_hash"), "token"), "shared_posts")
    posts = posts.join(one.select("set", "n", F.size("prefix").alias("_size")), "set")
    mine = Window.partitionBy("set")
    post = F.struct("set", "n", "at", (F.row_number().over(mine.orderBy("at")) - 1).alias("before"))
    return kept(posts.select("token", post.alias("post"), (F.count("*").over(mine) / F.col("_size")).alias("central")), "posts")


#: The columns of ``_place``.
PLACE = ["_hash", "_id", "_none"]


def _place(doc_id: str, hashed: str) -> list:
    """A hash and an id that may be null, as columns that are never null, so that joins use them as they are."""
    return [F.col(hashed).alias("_hash"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.col(doc_id).isNull().alias("_none")]


def texts_of(one: DataFrame, posts: DataFrame, docs: DataFrame) -> DataFrame:
    """(set, n, text, signed): one text of every set that has a posting, and the signature of the set.

    The texts are UTF-8 bytes like those the sets were made from.
    """
    wanted = posts.select("post.set").distinct().join(one.select("set", "doc_id", "text_hash"), "set")
    wanted = wanted.select(F.col("set").alias("wanted"), *_place("doc_id", "text_hash"))
    # equal rows meet in one task of the join, where all but one go before anything else moves the texts
    texts = docs.select("text", *_place("doc_id", "text_hash")).join(wanted, PLACE).dropDuplicates([*PLACE, "wanted"])
    texts = texts.select("wanted", "text", F.col("text").cast("binary").alias("_kept"))

    def make():
        def find(values):
            found = [shingles(t) for t in values]
            signed = pa.ListArray.from_arrays(
                np.arange(len(found) + 1, dtype=np.int32) * (SIGNED // 64),
                pa.array(np.concatenate([signature(f) for f in found] or [np.zeros(0, np.int64)])),
            )
            return [[_number(f) if len(f) else None for f in found], [len(f) for f in found], signed]

        return find

    # the hash of a text leaves few rows of an id, however many have it
    texts = per_text(texts, make, "set long, n long, signed array<long>", ("wanted", "_kept"))
    return kept(texts.where("set = wanted").select("set", "n", F.col("_kept").alias("text"), "signed"), "texts")


def links(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, comp): classes of set numbers, for sets that are linked with another one.

    ``found`` is the stored result of ``sets`` with doc_id and text_hash; ``docs`` has these and the texts.
    """
    one = found.where("set IS NOT NULL").groupBy("set").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min(F.struct("n_shingles", "prefix")).alias("of")
    )
    one = kept(one.select("set", "row.doc_id", "row.text_hash", F.col("of.n_shingles").alias("n"), F.col("of.prefix").alias("prefix")), "one")
    posts = postings(one)
    texts = texts_of(one, posts, docs)
    rows = posts.withColumn("comp", F.col("post.set"))
    tested = None
    for turn in range(ROUNDS):
        pivot = F.max(F.struct("central", F.xxhash64("post.set", F.lit(turn)), "post", "comp")).alias("pivot")
        lists = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), pivot)
        lists = kept(lists.where("low <> high").select("token", "pivot"), "lists")
        if lists.isEmpty():
            break
        rows = kept(rows.join(lists.hint("shuffle_hash"), "token"), "open")
        near = _fits(F.col("post"), F.col("pivot.post")) & (F.col("comp") != F.col("pivot.comp"))
        pairs = _once(rows.where(near).select(F.col("post.set").alias("a"), F.col("pivot.post.set").alias("b")))
        tested = _tested(pairs, texts, tested)
        comps = smallest_reachable(tested.where("linked").select("a", "b"))
        # a pivot has been compared with its whole list and leaves it
        rest = rows.where(F.col("post.set") != F.col("pivot.post.set")).drop("pivot", "comp")
        rows = rest.join(comps.withColumnRenamed("node", "_set"), F.col("post.set") == F.col("_set"), "left")
        rows = rows.select("token", "post", "central", F.coalesce("comp", F.col("post.set")).alias("comp"))
    if tested is None:
        return smallest_reachable(one.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0))
    rows = kept(rows.select("token", "post", "comp"), "rest")
    lists = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    rows = kept(rows.join(kept(lists.select("token"), "lists").hint("shuffle_hash"), "token"), "mixed")
    rows = kept(rows.join(texts.select(F.col("set").alias("_set"), "signed"), F.col("post.set") == F.col("_set")).drop("_set"), "signed")
    other = rows.select("token", F.col("post").alias("post_b"), F.col("comp").alias("comp_b"), F.col("signed").alias("signed_b"))
    crossed = rows.join(other, "token").where((F.col("post.set") < F.col("post_b.set")) & (F.col("comp") != F.col("comp_b")))
    crossed = crossed.where(_fits(F.col("post"), F.col("post_b")))
    crossed = crossed.where(_may_link(F.col("signed"), F.col("signed_b"), F.col("post.n"), F.col("post_b.n")))
    pairs = _once(crossed.select(F.col("post.set").alias("a"), F.col("post_b.set").alias("b")))
    tested = _tested(pairs, texts, tested)
    return smallest_reachable(tested.where("linked").select("a", "b"))


def _tested(pairs: DataFrame, texts: DataFrame, tested: DataFrame | None) -> DataFrame:
    """The pairs tested so far and those of ``pairs`` that were not and may link, each verified once."""
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    for at in ("a", "b"):
        signed = texts.select(F.col("set").alias(at), F.col("n").alias(f"n_{at}"), F.col("signed").alias(f"signed_{at}"))
        pairs = pairs.join(signed, at)
    pairs = pairs.where(_may_link(F.col("signed_a"), F.col("signed_b"), F.col("n_a"), F.col("n_b")))
    pairs = _verified(kept(pairs.select("a", "b"), "pairs"), texts)
    return kept(pairs if tested is None else tested.union(pairs), "tested")


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, the smaller number first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(set, comp, least): the class of every set, linked or not, and the smallest id that has the set."""
    comps = links(found, docs)
    sets_of = found.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
    sets_of = sets_of.join(comps.withColumnRenamed("node", "set"), "set", "left")
    return kept(sets_of.select("set", "least", F.coalesce("comp", "set").alias("comp")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) per document.

    Null texts and texts without words have no shingles and are linked with nothing, so that their
    component is their own id. Equal texts are linked, repeated rows each give their row; null ids are
    reached but never smallest, unless a component has no other. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = kept(sets(docs, sketch(docs), ("doc_id", "text_hash")), "sets")
    classes = _classes(found, docs)
    rows = found.select("doc_id", "n_shingles", "set")
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = kept(classes.join(least, "comp").select("set", "component_id"), "named")
    return rows.join(classes, "set", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def clean(docs: DataFrame) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id, with all its columns.

    Classes are those of the texts, whatever ids they have: unlinked texts of one id, or without an id,
    stay each. A null id is smallest only where a class has no other; of rows of the smallest id one
    stays, chosen by a hash of the row. Documents without shingles all stay.
    """
    hashed = [F.col(f"`{c}`") for c in docs.columns if '"map"' not in docs.schema[c].dataType.json()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = docs.select("doc_id", F.xxhash64(*hashed).alias("_hash"), row)
    text_hash = F.xxhash64("_row.text").alias("text_hash")
    texts = marked.select("doc_id", "_hash", F.col("_row.text").alias("text"), text_hash)
    found = kept(sets(texts, sketch(texts), ("doc_id", "_hash", "text_hash")), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash"))
    of_sets = found.where("set IS NOT NULL").groupBy("set").agg(first.alias("first"))
    of_classes = of_sets.join(_classes(found, texts.select("doc_id", "text", "text_hash")).select("set", "comp"), "set")
    stays = of_classes.groupBy("comp").agg(F.min("first").alias("first"))
    stays = kept(stays.select("comp", *_place("first.doc_id", "first._hash")), "stays")
    text = F.translate(F.coalesce("_row.text", F.lit("")), "\t\n\v\f\r", " " * 5)
    empty = F.trim(text) == ""
    # equal rows meet in one task of the join
    full = marked.where(~empty).select(*_place("doc_id", "_hash"), "_row").join(stays, PLACE).dropDuplicates([*PLACE, "comp"])
    return full.select("_row.*").unionByName(marked.where(empty).select("_row.*"))
