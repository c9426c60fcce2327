import random
import re

import numpy as np
import pytest

from sievelake.llm import jaccard_join as join
from tests.llm.util import docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(texts):
    sets = [(d, shingle_set(t)) for d, t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i), None)) for i, (d, s) in enumerate(sets)), key=str)


def fixture(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    passage = rng.choices(vocab, k=30)
    for g in range(12):
        base = rng.choices(vocab, k=rng.randrange(6, 120))
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
        texts.append(" ".join(base[: len(base) // 2] + passage))
    chain = rng.choices(vocab, k=60)
    for k in range(25):  # a chain: each links the next, far ones don't link
        texts.append(" ".join(chain))
        chain = chain[2:] + rng.choices(vocab, k=2)
    texts += ["É x", "É X", "é x", "a", "A", "a b c d e", "a b c d e f", "a b\tc d\ne", "", " \n", "x\x1cy", "q " * 9, "q " * 30000]
    rng.shuffle(texts)
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(5000, None), (5000, out[3][1]), (5001, out[3][1]), (None, out[4][1]), (None, "alone in the world of words")]


@pytest.mark.parametrize("seed,rounds", [(1, 2), (2, 1)])
def test_against_brute_force(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(join, "ROUNDS", rounds)
    texts = fixture(seed)
    wide = docs(spark, texts).selectExpr("*", "1 as component_id", "2 as set", "3 as token")
    got = rows(join.near_duplicates(wide), "doc_id", "n_shingles", "component_id")
    assert got == brute(texts)


def test_words_are_ascii_words_when_pairs_are_verified(spark):
    """Only A-Z are lower-cased and only ASCII spaces separate words, in both steps alike."""
    rng = random.Random(9)
    texts = []
    for g, mark in enumerate(("\u00a0", "\x1c", "\u2003", "\x85")):
        base = [f"g{g}w{i}" for i in range(30)]
        texts += [" ".join([*base, mark.join(f"{rng.random()}" for _ in range(40))]) for _ in range(3)]
    capital = [f"\u00c9{i}" if i % 6 == 0 else f"c{i}" for i in range(60)]
    texts += [" ".join(capital), " ".join(capital[:-1] + ["end"]), " ".join(capital).replace("\u00c9", "\u00e9", 1)]
    texts = [(i, t) for i, t in enumerate(texts)]
    want = brute(texts)
    assert len({c for _, _, c in want}) == 5
    assert rows(join.near_duplicates(docs(spark, texts)), "doc_id", "n_shingles", "component_id") == want


def test_signatures_leave_room_for_every_link(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for n in (1, 7, 8, 40, 300, 5000):
        for d in range(0, n // 3 + 2, max(1, n // 30)):
            whole = np.unique(rng.integers(0, 1 << 64, n + d, dtype=np.uint64))
            x, y = whole[: len(whole) - d], whole[d // 2 :]
            both = len(np.intersect1d(x, y))
            linked = 100 * both >= join.PERCENT * (len(x) + len(y) - both)
            pairs.append((len(x), len(y), join.signature(x).tolist(), join.signature(y).tolist(), linked))
    df = spark.createDataFrame(pairs, "n long, m long, x array<long>, y array<long>, linked boolean")
    may = [(r.may, r.linked) for r in df.select(join._may_link(df.x, df.y, df.n, df.m).alias("may"), "linked").collect()]
    assert all(m for m, linked in may if linked) and any(linked for _, linked in may) and not all(m for m, _ in may)


def test_far_copies_are_not_all_compared(spark, monkeypatch):
    """Copies of one text that are too far apart to link share rare shingles in pairs, yet few pairs are verified."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(200), 12):
            words[k] = f"x{i}y{k}" if rng.random() < 0.3 else f"z{k}"
        texts.append((i, " ".join(words)))
    seen, verified = [], join._verified
    monkeypatch.setattr(join, "_verified", lambda pairs, of: seen.append(pairs.count()) or verified(pairs, of))
    got = rows(join.near_duplicates(docs(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert got == brute(texts)
    assert sum(seen) < 5 * len(texts)


def test_clean(spark):
    texts = fixture(3)
    wide = docs(spark, texts).selectExpr("*", "1 as component_id", "2 as _row")
    got = rows(join.clean(wide), "doc_id")
    want = {(d,) for d, n, c in brute(texts) if n and d == c}
    empty = [(d,) for d, n, _ in brute(texts) if not n]
    assert sorted(got, key=str) == sorted([*want, *empty], key=str)


def test_empty_table(spark):
    assert join.near_duplicates(docs(spark, [])).collect() == []
    assert join.clean(docs(spark, [])).collect() == []
    assert rows(join.near_duplicates(docs(spark, [None, ""])), "doc_id", "component_id") == [(0, 0), (1, 1)]


def test_clean_keeps_one_row_of_each_class(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    texts = [(None, one), (None, two), (None, two + " more"), (7, three), (7, four), (3, four + " more"), (7, four), (None, "")]
    got = rows(join.clean(docs(spark, texts)), "doc_id", "text")
    either = {(None, two), (None, two + " more")}
    assert len(either & set(got)) == 1
    want = [(None, one), (7, three), (3, four + " more"), (None, "")]
    assert sorted((r for r in got if r not in either), key=str) == sorted(want, key=str) and len(got) == 5


@pytest.mark.parametrize("key", [None, 7])
def test_texts_of_one_id_are_not_multiplied(spark, monkeypatch, key):
    """Rows that share an id, or have none, are brought to their sets by the hash of their text."""
    words = [f"w{i}" for i in range(3000)]
    texts = [(key, " ".join(words[i : i + 30])) for i in range(0, 2000, 2)]
    texts += [(i, text + " end") for i, (_, text) in enumerate(texts)]
    seen, run = [], join.per_text

    def counted(rows, make, schema, carry=("doc_id",), **more):
        if carry[0] == "wanted":
            seen.append(rows.count())
        return run(rows, make, schema, carry, **more)

    monkeypatch.setattr(join, "per_text", counted)
    got = join.near_duplicates(docs(spark, texts)).collect()
    assert len(got) == 2000 and seen and max(seen) <= 2000
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id not in (None, 7)) == [
        (i, 27) for i in range(1000) if i != 7
    ]


def test_texts_move_once(spark, monkeypatch):
    """Texts are shuffled for the joins that find them, and not again for dropping equal rows."""
    plans, store = {}, join.kept

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label):
        plans[label] = plan(df)
        return store(df, label)

    monkeypatch.setattr(join, "kept", seen)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        base = " ".join(f"w{i}" for i in range(60))
        plans["clean"] = plan(join.clean(docs(spark, [base, base + " x", base + " y", "z " * 9])))
    finally:
        spark.conf.set(threshold, before)
    assert "Exchange" in plans["texts"] and "Exchange" not in plans["texts"].split("MapInArrow")[0]
    assert "SortMergeJoin" in plans["clean"] and "Exchange" not in plans["clean"].split("SortMergeJoin")[0]
