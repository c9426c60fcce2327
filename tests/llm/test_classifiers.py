import random

from pyspark.ml.functions import array_to_vector

from sievelake.llm import cotraining, queries, toxicity
from sievelake.llm.common import kept
from tests.llm.util import docs

FOLDER = "/root/testdata/sf0.1"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def labels(spark, name):
    rows = spark.read.parquet(f"{FOLDER}/labels.parquet").where(f"{name} IS NOT NULL").collect()
    return {r.doc_id: r[name] for r in rows}


def test_toxicity_held_out(spark):
    truth = labels(spark, "toxic")
    rows = queries.op7(spark, FOLDER).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert auc(held) > 0.98


def test_quality_held_out(spark):
    truth = labels(spark, "quality")
    rows = queries.op9(spark, FOLDER).collect()
    assert len(rows) == 10000
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert auc(held) > 0.9


def test_toxicity_features():
    lexicon = toxicity.Weights({b"idiot$": 5.0})
    f = dict(zip(toxicity.NAMES, toxicity.features(b"You are an IDIOT, 1d10t and i.d.i.o.t! b", lexicon)))
    assert all(f[k] == 1 / 8 for k in ("hits", "near_you", "leet_hits", "broken_hits"))
    assert toxicity.features(None, lexicon) == toxicity.features(b" \n", lexicon) == [0.0] * len(toxicity.NAMES)


def fixture(spark):
    rng = random.Random(9)
    plain = "stone water light house river garden".split()
    texts, marks = [], []
    for i in range(200):
        bad = i % 4 == 0
        words = rng.choices(plain, k=rng.randrange(20, 60))
        if bad:
            words[5:5] = ["you", "IDIOT!!", "###"]
        texts.append(" ".join(words))
        marks.append((i, int(bad)))
    texts += [None, "", "x " * 20000, texts[0], texts[0]]
    marks += [(0, 1), (201, 0), (None, 1), (7, None), (9999, 1)]
    wide = docs(spark, texts).selectExpr("*", "1 as score", "2 as features", "3 as _meta")
    return wide, spark.createDataFrame(marks, "doc_id long, label int")


def test_odd_rows(spark):
    wide, marks = fixture(spark)
    for got in (
        toxicity.score(wide, toxicity.train(wide, marks)),
        cotraining.classify(wide, marks.withColumn("label", 1 - marks.label)),
    ):
        rows = {r.doc_id: r for r in got.collect()}
        assert len(rows) == 205 and all(0 <= r.score <= 1 for r in rows.values())
        assert rows[203].score == rows[204].score == rows[0].score
        flip = rows[0].score > rows[1].score
        assert all((rows[i].score > 0.5) == ((i % 4 == 0) == flip) for i in range(200))


def test_empty_tables(spark):
    wide, marks = fixture(spark)
    none = wide.limit(0)
    assert toxicity.score(none, toxicity.train(wide, marks)).collect() == []
    assert cotraining.classify(none, marks).collect() == []
    assert {r.score for r in toxicity.score(wide, toxicity.train(wide, marks.limit(0))).collect()} == {0.0}
    assert {r.score for r in cotraining.classify(wide, marks.where("label = 1")).collect()} == {1.0}


def test_all_unlabelled_rows_take_part(spark, monkeypatch):
    rows = spark.range(40000).selectExpr("id AS doc_id", "rand(5) AS x", "rand(6) AS y", "rand(7) AS z")
    rows = rows.selectExpr("doc_id", "array(x + y, y) AS text_view", "array(x + z, z) AS page_view", "x")
    rows = rows.select("doc_id", "x", *[array_to_vector(v).alias(v) for v in cotraining.VIEWS])
    rows = kept(rows, "views")
    marks = rows.where("doc_id < 400").selectExpr("doc_id", "cast(x > 0.5 AS int) AS label")
    fitted, fit = [], cotraining._fit

    def counted(found, view):
        fitted.append(found.count())
        return fit(found, view)

    monkeypatch.setattr(cotraining, "_fit", counted)
    cotraining.train(rows.drop("x"), marks, rounds=1)
    learned = fitted[0]
    assert 100 < learned < 300 and fitted[1] == learned
    assert all(abs(n - learned - cotraining.HANDED * 39600) < 20 for n in fitted[2:]) and len(fitted) == 4


def test_ties_at_the_cut_and_growth_over_rounds(spark, monkeypatch):
    """With one metadata row in the whole pool that view still hands over its share, and more each round."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "rand(5) AS x", "rand(6) AS y")
    one = "CASE WHEN doc_id < 400 THEN array(x, 1.0D) ELSE array(0.5D, 1.0D) END"
    rows = rows.selectExpr("doc_id", "array(x + y, y) AS text_view", f"{one} AS page_view", "x")
    rows = rows.select("doc_id", "x", *[array_to_vector(v).alias(v) for v in cotraining.VIEWS])
    rows = kept(rows, "views")
    marks = rows.where("doc_id < 400").selectExpr("doc_id", "cast(x > 0.5 AS int) AS label")
    fitted, fit = [], cotraining._fit

    def counted(found, view):
        fitted.append(found.count())
        return fit(found, view)

    monkeypatch.setattr(cotraining, "_fit", counted)
    cotraining.train(rows.drop("x"), marks, rounds=2)
    learned = fitted[0]
    assert len(fitted) == 6
    for turn in (1, 2):
        for n in fitted[2 * turn : 2 * turn + 2]:
            assert abs(n - learned - turn * cotraining.HANDED * 5600) < 20


def test_lexicon_holds_words_that_no_plain_row_has(spark):
    """Common words, which long toxic rows have a little more often, don't push rare insults out."""
    rng = random.Random(4)
    common, insults = [f"wo{k:03}rd" for k in range(150)], [b"zorgling", b"quibbart", b"mupfel"]
    rows = []
    for i in range(3300):
        toxic = i < 300
        words = [w for w in common if rng.random() < (0.9 if toxic else 0.8)]
        if i < 36:
            words.append(insults[i % 3].decode())
        rows.append((" ".join(words), int(toxic)))
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert all(max(found.get(e, 0) for e in toxicity.entries(w)) > toxicity.STRONG_Z for w in insults)
    assert not any(e.startswith(b"wo") for e in found)
