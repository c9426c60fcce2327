import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sievelake.llm import packing
from tests.llm.util import docs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def first_fit(lengths):
    """Bins that first fit decreasing needs."""
    left = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, room in enumerate(left) if room >= n), None)
        if k is None:
            left.append(2048 - n)
        else:
            left[k] -= n
    return len(left)


def test_pieces_and_sequences(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "and,", "x1", "É", "日本", "foo\nbar", "it's"], k=rng.randrange(1, 900))) for _ in range(80)]
    texts += [None, "", " ", "a  b", "a \n b ", "tab\t x", " lead", "trail ", "the " * 6000 + "end", "a  b", "\x1c a"]
    texts += ["same text here"] * 30
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wide = docs(spark, texts).selectExpr("*", "1 as offset", "2 as _rank")
    got = packing.pack(wide, RANKS, PATTERN).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert r.start == at
            part = np.array(ids[at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
        assert len(mine) == max(1, -(-len(ids) // 2048)) and all(r.length == 2048 for r in mine[1:])
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert -(-total // 2048) <= len(bins) <= first_fit([r.length for r in got])


def test_added_tokens(spark):
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, end * 3, f"one two{end} three  four {end}\n", f" {end} ", "<|endoftext|", f"<|{end}|>", "the word " * 3000 + end + "x" * 9]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pieces(docs(spark, texts), RANKS, PATTERN).collect()
    found = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in got}
    want = {}
    for i, text in enumerate(texts):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        for a, n in packing.cut(len(ids), 2048):
            want[i, a] = (n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()))
    assert found == want


def test_empty_table(spark):
    assert packing.pack(docs(spark, []), RANKS, PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, np.int64)
    left = counts.copy()
    for chosen, times in packing.plan(counts, 40):
        pivot = int(np.flatnonzero(left)[-1])
        sums = {0}
        for length in np.flatnonzero(left).tolist():
            for _ in range(int(left[length]) - (length == pivot)):
                sums |= {s + length for s in sums if s + length <= 40 - pivot}
        assert sum(k * v for k, v in chosen.items()) == pivot + max(sums)
        for length, n in chosen.items():
            left[length] -= n * times
    assert not left.any()
