"""Ranked search against a direct evaluation of the score."""

import math
import re
from collections import Counter

import pytest
from hypothesis import given, strategies as st

from sievelake.llm import ranked_search

DOCS = "doc_id long, text string, m string, term string"
ITEMS = "item_id string, text string, score long"


def terms(text):
    lowered = re.sub("[A-Z]", lambda c: c.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, k=10):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(doc_id, c) for doc_id, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in held:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * big_n) // big_l
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    docs = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    items = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    rows = ranked_search.rank(docs, items, k)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def corpus():
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(900):
        n = 1 + (i * 7919) % 90
        docs.append((i, " ".join(words[(i * 31 + j * j * 17) % (5 + i % 55)] for j in range(n)) + " the The"))
    docs += [(5000 + i, "copy of one text w1 w2 w3") for i in range(1300)]  # a stratum of two units
    docs += [(None, "w1 w2"), (None, "w1 w2"), (7, "w1 w2"), (None, None), (8001, ""), (8002, " ?! ")]
    docs += [(8003, "Über-straße w5 " + "w6," * 30_000)]
    return docs


ITEM_ROWS = [
    ("a", "W1 w2, w3"), ("b", "the"), ("c", "w58 w59 w1 w1"), ("d", None), ("e", "--"), ("f", "nowhere"),
    (None, "copy w40"), ("a", "w1 w2 w3"), ("g", "STRASSE straße über"), ("h", " ".join(f"w{i}" for i in range(60))),
]


def test_equals_direct_evaluation(spark, monkeypatch):
    assert found(spark, corpus(), ITEM_ROWS) == expected(corpus(), ITEM_ROWS)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(ranked_search, "UNIT_BYTES", 2000)
    assert found(spark, corpus(), ITEM_ROWS, 3) == expected(corpus(), ITEM_ROWS, 3)


def test_index_holds_every_term(spark):
    index = ranked_search.build(spark.createDataFrame([(*d, "x", "y") for d in corpus()], DOCS))
    rows = index.postings.collect()
    ids = {r.unit: r.ids for r in rows if r.term is None}
    pairs = Counter()
    for r in rows:
        if r.term is not None:
            assert sum(r.sizes) == len(r.docs) and list(r.tfs) == sorted(set(r.tfs))
            tfs = [tf for tf, size in zip(r.tfs, r.sizes) for _ in range(size)]
            pairs.update((ids[r.unit][d], r.term, tf) for d, tf in zip(r.docs, tfs))
    wanted = Counter()
    for doc_id, text in corpus():
        wanted.update((doc_id, t, tf) for t, tf in Counter(terms(text)).items())
    assert pairs == wanted
    assert max(len(i) for i in ids.values()) <= ranked_search.UNIT_DOCS
    assert len({(r.unit, r.m) for r in rows}) == len(ids)


def test_empty_tables(spark):
    assert found(spark, [], ITEM_ROWS) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [("a", "b")]) == []


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_terms(text):
    assert [t.decode() for t in ranked_search.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("n, df", [(10, 10), (10, 1), (10**10, 3)])
def test_weight(n, df):
    assert ranked_search.weight(n, df) >= 0
