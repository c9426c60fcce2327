import hashlib
import random
import re

import pytest

from sievelake.llm import decontam
from tests.llm.util import docs, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    out = []
    for doc, text in texts:
        ws, hit, ids = words(text), set(), set()
        for item, other in items:
            b = words(other)
            k = min(10, len(b))
            windows = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(ws) - k + 1 if k else 0):
                if tuple(ws[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    ids.add(str(item)) if item is not None else None
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(ids), sha, len(hit) > 0))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(3)
    vocab = ["a", "b", "É", "x1", "the", "日本", "q"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([30, 12, 10, 4, 2, 15, 25])]
    items += [(3, "a-b the"), (12, ""), (13, None), (None, "zz zz zz"), (5, items[5][1])]
    texts = []
    for i in range(60):
        parts = rng.choices(vocab, k=rng.randrange(0, 60))
        if i % 3 == 0:
            parts[5:5] = items[rng.randrange(7)][1].upper().replace("É", "É").split()
        texts.append((i, rng.choice([" ", "\n", "-"]).join(parts)))
    texts += [(70, None), (71, ""), (72, "zz ZZ\x00zz"), (72, "zz ZZ\x00zz"), (None, "a b"), (73, "a " * 30000)]
    texts += [(74, items[0][1] + " " + items[0][1]), (75, "ÀB İ")]
    return texts, items


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 200])
def test_against_brute_force(spark, block_bytes):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs(spark, texts), bench, block_bytes=block_bytes)
    assert rows(got, *COLUMNS) == brute(texts, items)


def test_longest_match(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    text = "x " + " ".join(f"w{i}" for i in range(5, 30)) + " y " + " ".join(f"w{i}" for i in range(12))
    got = decontam.decontaminate(docs(spark, [text]), bench).first()
    assert got.longest == (1, 25) and got.n_hit == 37


def test_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = docs(spark, [])
    assert decontam.decontaminate(none, bench).collect() == []
    assert rows(decontam.decontaminate(docs(spark, ["a b c"]), bench.limit(0)), "n_hit") == [(0,)]
    wide = docs(spark, ["a b c", "a b"]).selectExpr("*", "1 as n_hit", "2 as _row", "3 as `x.y`")
    assert rows(decontam.clean(wide, bench), "doc_id", "n_hit", "_row", "`x.y`") == [(1, 1, 2, 3)]
