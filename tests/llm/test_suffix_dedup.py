import hashlib
import random

import numpy as np

from sievelake.llm import suffix_dedup as dedup
from tests.llm.util import docs, rows

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(texts):
    least, out = {}, []
    big = float("inf")
    for d, t in texts:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, big), big if d is None else d)
    for d, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < (big if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(11)
    make = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passages = [make(n) for n in (49, 50, 51, 60, 120, 300)]
    texts = []
    for i in range(80):
        parts = [make(rng.randrange(0, 150)) for _ in range(3)]
        parts[1:1] = [rng.choice(passages)] * (i % 2)
        parts[2:2] = [rng.choice(passages)[rng.randrange(5) :]] * (i % 3 == 0)
        texts.append((i, "".join(parts)))
    texts += [(100 + k, texts[5][1]) for k in range(6)] + [(5, texts[5][1]), (7, texts[9][1])]
    texts += [(110, "a" * 200), (111, "a" * 70), (112, "b" + "a" * 49), (113, "ab" * 400), (114, "x" + "ab" * 60)]
    texts += [(120, None), (121, ""), (None, texts[3][1]), (None, texts[3][1] + "!"), (130, "\0" * 60 + make(40)), (131, "\0" * 80)]
    texts += [(140, "long " * 12000), (141, "z" + "long " * 30)]
    rng.shuffle(texts)
    return texts


def test_against_brute_force(spark, monkeypatch):
    texts = fixture()
    wide = docs(spark, texts).selectExpr("*", "1 as n_bytes", "2 as _row", "3 as row", "4 as key")
    assert rows(dedup.dedup(wide), *COLUMNS) == brute(texts)


def test_smallest_documents_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SHARD", 300)
    texts = fixture()[:60]
    assert rows(dedup.dedup(docs(spark, texts)), *COLUMNS) == brute(texts)


def test_kept_text_and_empty_table(spark):
    texts = [(1, "q" * 60), (2, "begin " + "q" * 60 + " end")]
    got = {r.doc_id: bytes(r.kept_text) for r in dedup.dedup(docs(spark, texts), with_text=True).collect()}
    assert got == {1: b"q" * 60, 2: b"begin  end"}
    assert dedup.dedup(docs(spark, [])).collect() == []


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    texts = [t.encode() for _, t in fixture() if t and len(t.encode()) >= 50]
    texts += [b"a" * 50, b"a" * 50, bytes(rng.choices(b"ab", k=50)), texts[0] + b"a" * 120]
    sizes = np.array([len(t) for t in texts])
    found = list(zip(*(c.tolist() for c in dedup.runs(np.frombuffer(b"".join(texts), np.uint8), sizes))))
    for number, text in enumerate(texts):
        # the same alone as among others, and without gaps
        alone = list(zip(*(c.tolist() for c in dedup.runs(np.frombuffer(text, np.uint8), np.array([len(text)])))))
        assert [f[1:] for f in found if f[0] == number] == [f[1:] for f in alone]
        place = 0
        for _, _, at, n, _ in alone:
            assert at == place and 0 < n <= 33
            place += n
        assert place == len(text) - 49
    key_of, digest_of = {}, {}
    for number, key, at, n, digest in found:
        for i in range(at, at + n):
            assert key_of.setdefault(texts[number][i : i + 50], key) == key
        context = texts[number][at : at + n + 49]
        assert digest_of.setdefault(context, digest) == digest
    assert len(set(digest_of.values())) == len(digest_of)
