"""Quality scores by co-training: a classifier of the text and one of the page's metadata.

Both start from the labelled rows. In each round either one labels those of all unlabelled rows that it is
most sure of, and they join the other's training rows. In the end each view is calibrated on
labelled rows that trained neither, and a logistic model combines the calibrated views for all documents.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, kept, per_text
from .quality_rules import base_counts

#: The documented bound of labelled rows.
LABELLED_ROWS = 12000

#: Rounds, and the share of the unlabelled rows that each view hands over in a round.
ROUNDS, HANDED = 3, 0.1

#: The error of a cut's rank, as a share of the unlabelled rows; an exact one would gather them all.
CUT_ERROR = 1e-4
#: Added to log-odds times a random number of the row, so that a cut through equal ones takes a share of them.
TIE = 1e-6

#: Slots that languages, sources and lengths are hashed into.
SLOTS = 32

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def content(text: bytes | None) -> list[float]:
    """Rates of a whole text; zeros without words."""
    n, letters, symbols, dup_lines, repeated = base_counts(text)
    if not n:
        return [0.0] * 13
    size = len(text)
    words = text.split()
    lines = text.count(b"\n") + 1
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    return [
        math.log1p(n),
        letters / n,
        symbols / n,
        dup_lines / lines,
        repeated / n,
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        len(set(words)) / n,
        math.log1p(n / lines),
        (text.count(b".") + text.count(b"?")) / n,
        sum(1 for w in words if len(w) == 1) / n,
        sum(1 for w in words if w.isupper()) / n,
    ]


def metadata(row: DataFrame) -> list:
    """Columns of the metadata view: hashed language and source, and the length class."""
    slots = []
    for name in ("lang", "source"):
        key = F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(SLOTS))
        slots += [(key == k).cast("double") for k in range(SLOTS)]
    length = F.least(F.lit(15), F.floor(F.log2(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) + 1)))
    return slots + [(length == k).cast("double") for k in range(16)]


def views(docs: DataFrame, carry=("doc_id",)) -> DataFrame:
    """The carried columns and the two views as MLlib vectors, ``text_view`` and ``page_view``."""
    rows = docs.select(*carry, "text", F.array(*metadata(docs)).alias("_meta"))
    found = per_text(rows, lambda: lambda texts: [[content(t) for t in texts]], "_content array<double>", (*carry, "_meta"))
    return found.select(*carry, array_to_vector("_content").alias("text_view"), array_to_vector("_meta").alias("page_view"))


VIEWS = ("text_view", "page_view")


def _fit(rows: DataFrame, view: str):
    return LogisticRegression(featuresCol=view, labelCol="label", regParam=0.01, maxIter=25).fit(rows)


def _with_logit(rows: DataFrame, model, view: str) -> DataFrame:
    """``rows`` with the model's log-odds in a column named after the view."""
    drop = ("rawPrediction", "probability", "prediction")
    return model.transform(rows).withColumn(f"{view}_logit", vector_to_array("rawPrediction")[1]).drop(*drop)


class Constant:
    def __init__(self, score):
        self.score = score


def train(found: DataFrame, labels: DataFrame, rounds: int = ROUNDS):
    """The two views' models, their calibrations and the combination.

    Round number t hands over t tenths of the unlabelled rows, the surest by either view; of rows with equal
    log-odds at the cut a random share.

    ``found`` are the views of all documents, stored; ``labels`` (doc_id, label). Half of the labelled
    sample trains, half calibrates. With one class of labels there is only that class's share.
    """
    marked = labels.where("label IS NOT NULL").select("doc_id", F.col("label").cast("double").alias("label"))
    ids = kept(bounded_sample(marked, LABELLED_ROWS), "sample")
    known = kept(found.join(F.broadcast(ids), "doc_id"), "known").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(2)))
    seen = {(r.half, r.label) for r in known.select("half", "label").distinct().collect()}
    if len(seen) < 4:
        return Constant(known.agg(F.avg("label")).first()[0] or 0.0)
    pool = found.join(marked.select("doc_id").distinct(), "doc_id", "left_anti")
    pool = kept(pool.select(*VIEWS, (F.rand(41) * TIE).alias("_tie")), "pool")
    # the same share of either end, as many positives and negatives as the labels have
    share = known.where("half = 0").agg(F.avg("label")).first()[0]
    learned = known.where("half = 0").select(*VIEWS, "label")
    train_rows = {view: learned for view in VIEWS}
    models = {view: _fit(learned, view) for view in VIEWS}
    for turn in range(1, rounds + 1):
        handed = min(1.0, HANDED * turn)
        ends = [handed * (1 - share), 1 - handed * share]
        scored = pool
        for view in VIEWS:
            scored = _with_logit(scored, models[view], view).withColumn(f"{view}_logit", F.col(f"{view}_logit") + F.col("_tie"))
        logits = [f"{view}_logit" for view in VIEWS]
        found_cuts = scored.approxQuantile(logits, ends, CUT_ERROR)  # none of an empty pool
        for logit, other, cuts in zip(logits, VIEWS[::-1], found_cuts):
            if cuts:
                sure = scored.where((F.col(logit) < cuts[0]) | (F.col(logit) > cuts[1]))
                sure = sure.select(*VIEWS, (F.col(logit) > cuts[1]).cast("double").alias("label"))
                train_rows[other] = learned.unionByName(sure)
        models = {view: _fit(train_rows[view], view) for view in VIEWS}
    judged = known.where("half = 1")
    for view in VIEWS:
        judged = _with_logit(judged, models[view], view)
    judged = kept(judged, "judged")
    calibrations = {}
    for view in VIEWS:
        rows = judged.withColumn("_x", array_to_vector(F.array(f"{view}_logit")))
        calibrations[view] = LogisticRegression(featuresCol="_x", labelCol="label").fit(rows)
    both = LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.001)
    return models, calibrations, both.fit(_calibrated(judged, calibrations))


def _calibrated(rows: DataFrame, calibrations) -> DataFrame:
    """The calibrated log-odds of both views side by side in ``_x``."""
    logits = [
        F.col(f"{view}_logit") * float(calibrations[view].coefficients[0]) + float(calibrations[view].intercept)
        for view in VIEWS
    ]
    return rows.withColumn("_x", array_to_vector(F.array(*logits)))


def score(found: DataFrame, model, carry=("doc_id",)) -> DataFrame:
    """The carried columns, text_score, page_score and score (0 to 1), and predicted (1 from 0.5).

    Null and empty texts, null languages, sources and lengths have their own features, so every row has a
    score; equal rows have equal ones.
    """
    if isinstance(model, Constant):
        same = F.lit(float(model.score))
        rows = found.select(*carry, same.alias("text_score"), same.alias("page_score"), same.alias("score"))
    else:
        models, calibrations, both = model
        for view in VIEWS:
            found = _with_logit(found, models[view], view)
        found = both.transform(_calibrated(found, calibrations))
        single = [1 / (1 + F.exp(-vector_to_array("_x")[k])) for k in range(2)]
        rows = found.select(
            *carry,
            single[0].alias("text_score"),
            single[1].alias("page_score"),
            vector_to_array("probability")[1].alias("score"),
        )
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, carry=("doc_id",)) -> DataFrame:
    """Scores of all documents; the views are computed once and stored (a few hundred bytes a row)."""
    found = kept(views(docs, tuple(dict.fromkeys((*carry, "doc_id")))), "views")
    return score(found, train(found, labels), carry)
