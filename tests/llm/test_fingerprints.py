"""Fingerprints against paragraph sets made in Python."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sievelake.llm import fingerprints as fp

DOCS = "doc_id long, text string, fingerprint string, _range int"


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def pieces(text):
    found = set()
    for line in (text or "").split("\n"):
        parts = [p.strip(" ") for p in re.split(r"[.!?]", line) if p.strip(" ")]
        for i in range(0, len(parts), fp.SENTENCES):
            digest = 42
            for part in parts[i : i + fp.SENTENCES]:
                digest = xxhash.xxh64_intdigest(part.encode(), digest)
            found.add(signed(digest))
    return found


def jaccard(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def order(row):
    doc_id, text = row
    return doc_id is not None, doc_id or 0, signed(xxhash.xxh64_intdigest((text or "").encode(), 42))


def expected(rows):
    rows = sorted(rows, key=order)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        digest = hashlib.sha256(changed.encode()).hexdigest()
        out.append((doc_id, len(text), digest, round(jaccard(text, changed), 9), round(jaccard(text, following), 9)))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], DOCS)


def found(spark, rows):
    result = fp.fingerprints(table(spark, rows).repartition(5)).collect()
    picked = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in result]
    return sorted(picked, key=str), result


def prose(seed, sentences):
    words = [f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(sentences * 6)]
    marks = ["." if i % 6 == 5 else "" for i in range(len(words))]
    return " ".join(w + m + ("\n" if i % 30 == 29 else "") for i, (w, m) in enumerate(zip(words, marks)))


def corpus():
    rows = [(i * 3, prose(i, 1 + i % 40)) for i in range(120)]
    rows += [(1000 + i, prose(5, 30)) for i in range(25)]  # copies
    rows += [(1000, prose(200 + i, 9)) for i in range(60)]  # one id, many texts
    rows += [(None, prose(300 + i, 4)) for i in range(30)] + [(None, None), (None, None), (None, "")]
    rows += [(2000, ""), (2001, None), (2002, "é"), (2003, "𝒳𝒴𝒵 x. " * 9), (2004, prose(7, 5000)), (2005, prose(8, 700))]
    return rows


@pytest.mark.parametrize("range_bytes, max_ranges", [(8 << 20, 4096), (3000, 4096), (1000, 8)])
def test_equals_sets_made_in_python(spark, monkeypatch, range_bytes, max_ranges):
    monkeypatch.setattr(fp, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(fp, "MAX_RANGES", max_ranges)
    picked, result = found(spark, corpus())
    assert picked == expected(corpus())
    of_text = {}
    by_id = {}
    for doc_id, text in corpus():
        by_id.setdefault(doc_id, set()).add(text or "")
    for r in result:
        assert re.fullmatch(r"[0-9A-F]{672}", r.fingerprint) and len(r.edited_fingerprint) == 672
        if len(by_id[r.doc_id]) == 1:
            of_text.setdefault(next(iter(by_id[r.doc_id])), set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in of_text.values())
    assert len({min(p) for p in of_text.values()}) == len({frozenset(pieces(t)) for t in of_text})


@pytest.mark.parametrize("removed, added, common", [(0, 0, 5), (3, 4, 50), (60, 50, 10), (900, 1100, 300)])
def test_peeling_recovers_the_difference(spark, removed, added, common):
    texts = [f"p{i}.\n" for i in range(removed + added + common)]
    left = "".join(texts[: removed + common])
    right = "".join(texts[removed:])
    df = spark.createDataFrame([(left, right)], "l string, r string")
    row = df.select(fp.compared(F.col("l"), F.col("r")).alias("c")).first()["c"]
    assert set(row["removed"]) == pieces(left) - pieces(right) and len(row["removed"]) == removed
    assert set(row["added"]) == pieces(right) - pieces(left) and len(row["added"]) == added
    assert row["likeness"] == pytest.approx(common / (removed + added + common))


def test_attempts_end_in_exact_sets(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROUNDS", 1)
    monkeypatch.setattr(fp, "ATTEMPTS", 1)
    left, right = "".join(f"a{i}.\n" for i in range(400)), "".join(f"b{i}.\n" for i in range(300))
    df = spark.createDataFrame([(left, right)], "l string, r string")
    row = df.select(fp.compared(F.col("l"), F.col("r")).alias("c")).first()["c"]
    assert set(row["removed"]) == pieces(left) and set(row["added"]) == pieces(right)


def test_empty_and_single(spark):
    assert fp.fingerprints(table(spark, [])).collect() == []
    picked, _ = found(spark, [(1, "One. Two. Three. Four.")])
    assert picked == expected([(1, "One. Two. Three. Four.")])
    assert found(spark, [(None, None)])[0] == expected([(None, None)])
