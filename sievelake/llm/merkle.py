"""Merkle manifest of a dataset: a postorder append log, proofs from it, and their check.

Every document is a leaf, every source a tree of fan-out 16 over its leaves in the order of doc_id, and
the roots of the sources are the leaves of one more tree. A log holds each tree's nodes in the order
in which they are complete, a node right after its last descendant. With n leaves, node i of a level
covers the leaves up to ``end = min(n, (i + 1) * 16 ** level)``, so its place in the log is the number of
nodes that end no later: ``ceil(end / 16 ** m)`` of each lower level m, i before it on its own level and
``i // 16 ** (m - level)`` of each higher level m. No index is needed to find a sibling.

Builders are aligned: one takes 256 consecutive leaves, two whole levels, and appends one gapless
segment of the log. Its root goes on to a builder two levels up, which only sees a 256th of the rows.
Proofs of documents read the segment of their builder and the path above it, which its 256
documents share; siblings on that path are found by joining their places with the log.

Results on edge cases:

* null in any column is a value of its own (``-``), also as source (first) and doc_id (first);
* rows of equal source and doc_id are ordered by their digests; repeated rows are leaves of their own;
* empty and very long texts are hashed whole; a null doc_id counts as tampered (its crc32 is that of
  no bytes) and its text stays null or is lower-cased like any other;
* an empty table gives no rows; a single leaf is its own root, with no siblings;
* columns beyond the five of ``documents`` take no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import kept

FAN = 16
#: Levels that a builder completes, and the leaves it takes for that.
LEVELS = 2
SPAN = FAN**LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LINK = "struct<before:string,after:string>"
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- shape of a tree


def width(n: int, level: int) -> int:
    """The nodes of a level over n leaves."""
    return -(-n // FAN**level)


def height(n: int) -> int:
    """The level of the root."""
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def place(level: int, i: int, n: int) -> int:
    """The place of node i of a level in the log of a tree of n leaves, from 0."""
    end = min(n, (i + 1) * FAN**level)
    found = i + sum(width(end, m) for m in range(level))
    while i:
        i //= FAN
        found += i
    return found


def run_of(level: int, i: int, n: int) -> range:
    """The nodes of a level that share node i's parent, itself included."""
    first = i - i % FAN
    return range(first, min(first + FAN, width(n, level)))


def joined(digests) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(digest: str, path) -> str:
    """The root that a leaf and its path of (before, after) siblings lead to."""
    for before, after in path:
        digest = joined((before, digest, after))
    return digest


# ---------------------------------------------------------------- leaves in order


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_of(**changed: Column) -> Column:
    """The digest of a document's row, with other values for the columns named."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def in_order(rows: DataFrame, keys: list, label: str) -> DataFrame:
    """``rows`` sorted over all partitions and stored with ``_at``: a number that grows in this order.

    Numbers are consecutive inside a partition, whose number is ``_at >> 33``. Nulls come first.
    """
    by = [F.col(k).asc_nulls_first() for k in keys]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return kept(ranged.withColumn("_at", F.monotonically_increasing_id()), label)


def numbered(ordered: DataFrame) -> DataFrame:
    """Add ``tree`` (the source's number), ``idx`` (the row's in its source) and ``n`` (its source's rows).

    Only a row for each source in each partition passes the windows.
    """
    part = F.shiftright("_at", 33)
    parts = ordered.groupBy(part.alias("_part"), "source").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    same = Window.partitionBy("source")
    before = same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept(
        parts.withColumns(
            {
                "_start": F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"),
                "n": F.sum("_rows").over(same),
            }
        ),
        "parts",
    )
    sources = in_order(parts.groupBy("source").agg(F.max("n").alias("n")), ["source"], "sources")
    groups = sources.groupBy(part.alias("_part")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = groups.select(
        "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_start")
    )
    trees = sources.withColumn("_part", part).join(starts, "_part")
    trees = trees.select("source", (F.col("_at") + F.col("_start")).alias("tree"))
    known = parts.alias("p").join(trees.alias("t"), F.expr("p.source <=> t.source"))
    known = known.select("p._part", "p.source", "p._start", "p.n", "t.tree")
    rows = ordered.withColumn("_part", part).alias("r")
    found = rows.join(known.alias("k"), F.expr("r._part = k._part AND r.source <=> k.source"))
    idx = F.col("r._at") + F.col("k._start")
    return found.select("r.*", "k.tree", "k.n", idx.alias("idx")).drop("_at", "_part")


# ---------------------------------------------------------------- the log

SEGMENT = "tree bigint, n bigint, builder bigint, first bigint, nodes array<string>, ids array<bigint>, now array<string>"
NODE = "tree bigint, n bigint, level int, idx bigint, place bigint, digest string"


def completed(base: int, first: int, digests: list, n: int):
    """What one builder appends: (level, i, digest) of its nodes in completion order.

    ``digests`` are consecutive nodes of level ``base``, the first of them number ``first``.
    """
    top = height(n)
    runs: list[list] = [[] for _ in range(LEVELS + 1)]
    for i, digest in enumerate(digests, first):
        level = base
        yield level, i, digest
        while level < min(top, base + LEVELS):
            run = runs[level - base]
            run.append(digest)
            if len(run) < FAN and i < width(n, level) - 1:
                break
            digest = joined(run)
            run.clear()
            level, i = level + 1, i // FAN
            yield level, i, digest


def groups_of(batches, columns: int):
    """Rows of Arrow batches in order, as (key, rows) for each run of equal first ``columns``."""
    held, key = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:columns] != key:
                if held:
                    yield key, held
                held, key = [], row[:columns]
            held.append(row[columns:])
    if held:
        yield key, held


def mapped(rows: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function that yields lists of rows."""
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        for made in function(batches):
            columns = list(zip(*made)) or [()] * len(arrow)
            arrays = [pa.array(values, f.type) for values, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.mapInArrow(run, out)


def by_builder(rows: DataFrame, *carry: str) -> DataFrame:
    """(tree, n, builder, idx, digest, ...) with the at most SPAN rows of a builder together."""
    builder = F.floor(F.col("idx") / SPAN).cast("bigint").alias("builder")
    rows = rows.select("tree", "n", builder, "idx", "digest", *carry)
    return rows.repartition("tree", "builder").sortWithinPartitions("tree", "builder", "idx")


def append_leaves(batches):
    for (tree, n, builder), rows in groups_of(batches, 3):
        first = rows[0][0]
        nodes = [digest for _, _, digest in completed(0, first, [row[1] for row in rows], n)]
        ids, now = [row[2] for row in rows], [row[3] for row in rows]
        yield [(tree, n, builder, place(0, first, n), nodes, ids, now)]


def append_nodes(base: int):
    def run(batches):
        for (tree, n, _), rows in groups_of(batches, 3):
            made = completed(base, rows[0][0], [row[1] for row in rows], n)
            yield [(tree, n, lv, i, place(lv, i, n), d) for lv, i, d in made if lv > base]

    return run


class Log:
    """The append log of many trees.

    ``segments``: a row per builder of leaves, (tree, n, builder, first, nodes, ids, now): its nodes stand from
    place ``first`` on; ``ids`` and ``now`` are what the leaves carried. ``heads``: (tree, n, level, idx, place, digest)
    of every node from level 2 on, and of lower roots.
    """

    def __init__(self, segments: DataFrame, heads: DataFrame):
        self.segments, self.heads = segments, heads

    def nodes(self) -> DataFrame:
        """(tree, place, digest) of every node."""
        spread = self.segments.select("tree", "first", F.posexplode("nodes").alias("_i", "digest"))
        low = spread.select("tree", (F.col("first") + F.col("_i")).alias("place"), "digest")
        return low.unionByName(self.heads.where(F.col("level") > LEVELS).select("tree", "place", "digest"))

    def roots(self) -> DataFrame:
        """(tree, root): the last node of every tree."""
        return self.heads.groupBy("tree").agg(F.max_by("digest", "place").alias("root"))


def append(leaves: DataFrame, label: str) -> Log:
    """The log of all trees of ``leaves``: (tree, idx, n, digest, doc_id, now)."""
    segments = kept(mapped(by_builder(leaves, "doc_id", "now"), append_leaves, SEGMENT), f"{label}-log")
    level = F.when(F.col("n") > FAN, 2).when(F.col("n") > 1, 1).otherwise(0)
    heads = segments.select(
        "tree", "n", level.cast("int").alias("level"), F.col("builder").alias("idx"),
        (F.col("first") + F.size("nodes") - 1).alias("place"), F.element_at("nodes", -1).alias("digest"),
    )
    stages, base = [kept(heads, f"{label}-heads")], LEVELS
    most = stages[0].agg(F.max("n")).first()[0] or 0
    while most > FAN**base:
        below = stages[-1].where((F.col("level") == base) & (F.col("n") > FAN**base))
        stages.append(kept(mapped(by_builder(below), append_nodes(base), NODE), f"{label}-heads"))
        base += LEVELS
    heads = stages[0]
    for stage in stages[1:]:
        heads = heads.unionByName(stage)
    return Log(segments, heads)


# ---------------------------------------------------------------- proofs

WANTED = "tree bigint, builder bigint, level int, before boolean, place bigint"


def want_siblings(batches):
    """The places of all siblings above a builder; a level without any has one row without a place."""
    for batch in batches:
        rows = []
        for tree, n, builder in zip(*[c.to_pylist() for c in batch.columns]):
            i = builder
            for level in range(LEVELS, height(n)):
                rows.append((tree, builder, level, None, None))
                rows += [(tree, builder, level, j < i, place(level, j, n)) for j in run_of(level, i, n) if j != i]
                i //= FAN
        yield rows


def upper_paths(log: Log) -> DataFrame:
    """(tree, builder, upper): the path from each builder's root to the root of its tree."""
    wanted = mapped(log.segments.select("tree", "n", "builder"), want_siblings, WANTED)
    nodes = log.heads.select("tree", "place", "digest")
    found = wanted.join(nodes, ["tree", "place"], "left")
    digest = F.struct("place", "digest")

    def side(before: bool) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("before") == before, digest)))
        return F.array_join(F.transform(listed, lambda x: x["digest"]), "")

    links = found.groupBy("tree", "builder", "level").agg(side(True).alias("before"), side(False).alias("after"))
    path = F.array_sort(F.collect_list(F.struct("level", "before", "after")))
    return links.groupBy("tree", "builder").agg(
        F.transform(path, lambda x: F.struct(x["before"], x["after"])).cast(f"array<{LINK}>").alias("upper")
    )


def lower_path(nodes: list, first: int, i: int, n: int) -> list:
    """The path of leaf i inside its builder's segment, by the places of its siblings."""
    path = []
    for level in range(min(LEVELS, height(n))):
        run = run_of(level, i, n)
        at = [nodes[place(level, j, n) - first] for j in run]
        path.append(("".join(at[: i - run.start]), "".join(at[i - run.start + 1 :])))
        i //= FAN
    return path


PROOF = f"tree bigint, idx bigint, doc_id bigint, leaf string, path array<{LINK}>"


def extract(batches):
    """A row per leaf with its whole path."""
    for batch in batches:
        for tree, n, builder, first, nodes, ids, _, upper in zip(*[c.to_pylist() for c in batch.columns]):
            rows = []
            for i, doc_id in enumerate(ids, builder * SPAN):
                path = [{"before": b, "after": a} for b, a in lower_path(nodes, first, i, n)]
                rows.append((tree, i, doc_id, nodes[place(0, i, n) - first], path + (upper or [])))
            yield rows


def with_upper(log: Log) -> DataFrame:
    return log.segments.join(upper_paths(log), ["tree", "builder"], "left").select(
        "tree", "n", "builder", "first", "nodes", "ids", "now", "upper"
    )


def proofs(log: Log) -> DataFrame:
    """(tree, idx, doc_id, leaf, path) of every leaf; ``path`` leads to the root of its tree."""
    return mapped(with_upper(log), extract, PROOF)


CHECKED = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def check(batches):
    """Every document's proof, folded from the digest its row has now."""
    for batch in batches:
        for n, builder, first, nodes, ids, now, upper, subroot, root, top in zip(*[c.to_pylist() for c in batch.columns]):
            above = [(x["before"], x["after"]) for x in [*(upper or ()), *(top or ())]]
            rest = "".join(side for link in above for side in link)
            rows = []
            for i, (doc_id, changed) in enumerate(zip(ids, now), builder * SPAN):
                path = lower_path(nodes, first, i, n)
                proof = joined([side for link in path for side in link] + [rest])
                leaf = nodes[place(0, i, n) - first]
                folded = fold(changed or leaf, path + above)
                rows.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
            yield rows


# ---------------------------------------------------------------- the operator


def tampered() -> Column:
    """Rows whose id's crc32 is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def build(docs: DataFrame, now: Column | None = None) -> tuple[Log, Log, DataFrame]:
    """The log of all sources, the log over their roots, and (tree, source, idx, subroot).

    ``now`` is the digest that a later check shall find for a row, null where that is the leaf itself.
    """
    now = F.lit(None).cast("string") if now is None else now
    leaves = kept(docs.select("doc_id", "source", leaf_of().alias("digest"), now.alias("now")), "leaves")
    rows = numbered(in_order(leaves, ["source", "doc_id", "digest"], "ordered"))
    log = append(rows, "sources")
    subroots = kept(log.roots(), "subroots")
    trees = subroots.count()
    tops = subroots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"),
        F.lit(trees).cast("bigint").alias("n"), F.col("root").alias("digest"),
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("now"),
    )
    return log, append(tops, "root"), subroots


def verify(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """Build the manifest, take every document's proof from it and check it against the row of now.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document. ``now`` as for
    ``build``; without it every row is checked as it stands.
    """
    log, over, subroots = build(docs, now)
    root = over.roots().select("root").first()  # one node, none of an empty table
    paths = proofs(over).select(F.col("idx").alias("tree"), F.col("path").alias("top"))
    above = subroots.withColumnRenamed("root", "subroot").join(paths, "tree")
    above = above.withColumn("root", F.lit(root["root"] if root else None).cast("string"))
    rows = with_upper(log).join(above, "tree")
    rows = rows.select("n", "builder", "first", "nodes", "ids", "now", "upper", "subroot", "root", "top")
    return mapped(rows, check, CHECKED)
