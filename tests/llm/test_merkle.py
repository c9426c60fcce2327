"""The Merkle manifest against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sievelake.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    doc_id, text, lang, source, n_chars = row
    return digest(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, i):
    found = []
    for level in levels[:-1]:
        first = i - i % 16
        run = level[first : first + 16]
        found += run[: i - first] + run[i - first + 1 :]
        i //= 16
    return found


def postorder(levels, top=None, i=0):
    top = len(levels) - 1 if top is None else top
    below = range(16 * i, min(16 * i + 16, len(levels[top - 1]))) if top else ()
    return [d for j in below for d in postorder(levels, top - 1, j)] + [levels[top][i]]


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        members = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = (members, tree([leaf(r) for r in members]))
    top = tree([trees[s][1][-1][0] for s in order])
    out = []
    for number, source in enumerate(order):
        members, levels = trees[source]
        for i, row in enumerate(members):
            proof = digest(*siblings(levels, i), *siblings(top, number))
            out.append((row[0], levels[0][i], levels[-1][0], top[-1][0], proof))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4097, 5000])
def test_places_are_those_of_a_postorder_walk(n):
    levels = tree([str(i) for i in range(n)])
    walk = postorder(levels)
    for level, nodes in enumerate(levels):
        for i, node in enumerate(nodes):
            assert walk[merkle.place(level, i, n)] == node


def corpus():
    rows = [(i, f"Text {i}", "en", "big", 6) for i in range(4400)]
    rows += [(i, f"text {i} " * 3, None, f"s{i % 40}", None) for i in range(5000, 5100)]
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (7, "x", "en", "lone ü", 1)]
    rows += [(8, "same", "en", "twice", 4)] * 20 + [(9, "A" * 200_000, "en", "big", 200_000)]
    return rows


def test_verify_equals_trees_built_by_hand(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(7).withColumn("tree", F.lit("clash"))
    altered = merkle.leaf_of(text=F.lower("text"))
    found = merkle.verify(docs, F.when(merkle.tampered(), altered)).collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == expected(rows)
    by_leaf = {leaf(r): r for r in rows}
    for r in found:
        row = by_leaf[r.leaf]
        marked = zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 5 == 0
        changed = marked and row[1] is not None and row[1] != row[1].lower()
        assert r.verified == (not changed)
        assert r.verified == (r.folded_root == r.root)
    assert {r.verified for r in found} == {True, False}


def test_log_and_proofs(spark):
    rows = corpus()
    log, over, subroots = merkle.build(spark.createDataFrame(rows, DOCS))
    levels = tree([leaf(r) for r in sorted((r for r in rows if r[3] == "big"), key=lambda r: (r[0], leaf(r)))])
    number = log.segments.orderBy(F.col("n").desc()).first()["tree"]
    nodes = log.nodes().where(F.col("tree") == number).orderBy("place").collect()
    assert [r.place for r in nodes] == list(range(len(nodes)))
    assert [r.digest for r in nodes] == postorder(levels)
    assert subroots.where(F.col("tree") == number).first()["root"] == levels[-1][0]
    proofs = merkle.proofs(log).where(F.col("tree") == number).collect()
    assert len(proofs) == 4401
    for r in proofs[::97]:
        assert merkle.fold(r.leaf, [tuple(x) for x in r.path]) == levels[-1][0]
    assert over.nodes().count() == 44 + 3 + 1  # leaves, runs, root


def test_empty_and_single(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.verify(none).collect() == []
    row = (3, "only", "en", "s", 4)
    (found,) = merkle.verify(spark.createDataFrame([row], DOCS)).collect()
    assert found.leaf == found.subroot == found.root == found.folded_root == leaf(row)
    assert found.proof_sha256 == digest("") and found.verified
