import random

import numpy as np
import pytest

from sievelake.llm import langid
from sievelake.llm.common import held_out
from tests.llm.util import DOCS, docs

VOCAB = {
    "en": "the of and water stone light house with from that would there".split(),
    "fr": "le de et eau pierre lumière maison avec depuis que serait là".split(),
    "ru": "вода камень свет дом который был там из".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choices(VOCAB[lang], k=n))


def training(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 40), lang, "s", 1) for i in range(60) for lang in VOCAB]
    return spark.createDataFrame(rows + [(99, "the the", None, "s", 1), (98, None, "en", "s", 1)], DOCS)


def test_whole_and_mixed_texts(spark):
    rng = random.Random(4)
    texts = [text(rng, lang, 30) for lang in VOCAB] + [
        text(rng, "en", 20) + ". " + text(rng, "fr", 30) + " " + text(rng, "ru", 5),
        None, "", "123 !!", "½ ²", "日本語", "THE WATER 5", text(rng, "ru", 30000),
    ]
    model = langid.train(training(spark))
    wide = docs(spark, texts).selectExpr("*", "1 as spans", "2 as _lang")
    got = {r.doc_id: r for r in langid.identify(wide, model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["en", "fr", "ru", "fr"]
    assert [(s.words, s.lang) for s in got[3].spans] == [(20, "en"), (30, "fr"), (5, "ru")]
    assert [got[i].lang_pred for i in (4, 5, 6, 7)] == ["und"] * 4 and got[6].score == 0
    assert got[8].lang_pred in VOCAB and got[9].lang_pred == "en" and got[10].lang_pred == "ru"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 0, 6, 1, 5])
    scores = rng.normal(size=(16, 3)).astype(np.float32) * 2
    got, at = langid.viterbi(scores, lengths, 1.5), 0
    for n in lengths:
        best = max(
            np.ndindex(*[3] * n),
            key=lambda p: sum(scores[at + i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])),
        )
        assert tuple(got[at : at + n]) == best
        at += n


def test_empty_tables(spark):
    none = docs(spark, [])
    model = langid.train(none)
    assert langid.identify(none, model).collect() == []
    assert langid.identify(docs(spark, ["the"]), model).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    from sievelake.llm import queries

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in queries.op5(spark, folder).collect() if r.held_out]
    assert len(rows) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_held_out_rule(spark):
    import zlib

    frame = spark.createDataFrame([(i,) for i in [0, 1, -5, 123456, None]], "doc_id long")
    for r in frame.withColumn("h", held_out("doc_id", 4, 2)).collect():
        assert r.h == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)


@pytest.mark.parametrize("times", [1, 7, 8, 50])
def test_numbers_are_no_letters_at_any_length(times):
    assert langid.words(("½ " * times).encode()) == []
    assert langid.words(("½ " * times + "a").encode())[-1] == "a"
