"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows too: words and beginnings of words whose document frequency is
clearly higher in toxic ones. Learning uses a bounded sample of labelled rows, a third each for the
lexicon, the trees and the calibration; features and scores are computed on all whole texts.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, kept, per_text

#: The documented bound of the sample: so many labelled rows of each class.
ROWS_PER_CLASS = 6000

#: The lexicon: at most so many entries, found in so many toxic rows at least, this far above chance, and
#: in so many times the share of plain rows, which long rows or those of one language alone don't reach.
LEXICON_WORDS, LEAST_ROWS, LEAST_Z, LEAST_LIFT = 100, 3, 2.5, 3

#: Entries this far above chance are counted on their own too.
STRONG_Z = 4.0

#: Beginnings of so many bytes are entries besides whole words, which end with a mark that words don't have.
STEMS, END = (4, 5, 6, 7), b"$"

#: A task remembers the weights of so many words.
REMEMBERED = 400_000

#: Words on either side of a second-person pronoun, and words of the densest window.
NEAR, DENSE = 6, 40

#: Second-person pronouns of the languages at hand.
SECOND_PERSON = frozenset(
    w.encode()
    for w in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch sie tú usted ustedes vosotros vuestro ti contigo".split()
)

_EDGE = b".,;:!?\"'()[]{}<>*_-#&%$~|/"
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
_BREAKS = b"*._-'`^~+"

NAMES = (
    "hits", "strong", "weighted", "distinct", "densest", "near_you", "you", "capitals", "shouted", "punctuation",
    "exclaims", "mixed", "leet_hits", "broken_hits", "words",
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words without punctuation at their ends."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w] if text else []


def entries(word: bytes) -> list[bytes]:
    """What a word can be found in the lexicon as."""
    return [word + END, *(word[:k] for k in STEMS if len(word) >= k)]


class Weights(dict):
    """Word to the weight of its heaviest lexicon entry, 0 without one."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon

    def __missing__(self, word):
        weight = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)
        if len(self) < REMEMBERED:
            self[word] = weight
        return weight


def features(text: bytes | None, lexicon: Weights) -> list[float]:
    """Densities per word or byte, in the order of NAMES; zeros without words."""
    found = words(text)
    n = len(found)
    if not n:
        return [0.0] * len(NAMES)
    weights = list(map(lexicon.__getitem__, found))
    at = [i for i, w in enumerate(weights) if w]
    you = [i for i, w in enumerate(found) if w in SECOND_PERSON]
    near = sum(1 for i in at if (k := bisect_left(you, i - NEAR)) < len(you) and you[k] <= i + NEAR)
    densest = max((bisect_left(at, i + DENSE) - k for k, i in enumerate(at)), default=0)
    size = len(text)
    letters = len(text) - len(text.translate(None, bytes(range(65, 91)) + bytes(range(97, 123))))
    capitals = size - len(text.translate(None, bytes(range(65, 91))))
    marks = size - len(text.translate(None, bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])))
    exclaims = text.count(b"!") + text.count(b"?")
    raw = text.split()
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    mixed = sum(1 for w in found if not w.isalpha() and w.isascii() and not w.isdigit() and any(65 <= c for c in w))
    lowered = text.lower()
    leet = sum(1 for w in lowered.translate(_LEET).split() if lexicon[w.strip(_EDGE)]) - len(at)
    broken = sum(1 for w in lowered.translate(None, _BREAKS).split() if lexicon[w.strip(_EDGE)]) - len(at)
    return [
        len(at) / n,
        sum(1 for i in at if weights[i] >= STRONG_Z) / n,
        sum(weights) / n,
        float(len({found[i] for i in at})),
        float(densest),
        near / n,
        len(you) / n,
        capitals / max(1, letters),
        shouted / len(raw),
        marks / size,
        exclaims / n,
        mixed / n,
        max(0, leet) / n,
        max(0, broken) / n,
        math.log1p(n),
    ]


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, text, label, weight and third (0: lexicon, 1: trees, 2: calibration) of the sample.

    Each class is weighted to its share of all labelled rows. Rows with a null label are left out.
    """
    labels = labels.where("label IS NOT NULL").select("doc_id", F.col("label").cast("int"))
    parts = []
    for label in (0, 1):
        mine = labels.where(F.col("label") == label)
        chosen = kept(bounded_sample(mine, rows), f"class{label}")
        share = mine.count() / max(1, chosen.count())
        parts.append(chosen.withColumn("weight", F.lit(float(share))))
    ids = parts[0].unionByName(parts[1]).withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)).cast("int"))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by rows
    return kept(sample, "labelled")


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Entry to how far its rows are toxic above chance; a top list of LEXICON_WORDS.

    That is the signed root of the log-likelihood ratio, a z-score that holds for counts of 0 too; that of the
    log-odds is bounded for entries that no plain row has, and puts common words ahead of them. A longer
    beginning of a word that stands below a shorter one says nothing more and takes no place in the list.
    """
    found = per_text(
        sample, lambda: lambda texts: [[sorted({e for w in set(words(t)) for e in entries(w)}) for t in texts]], "words array<binary>", ("label",)
    )
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, plain = totals.get(1, 0), totals.get(0, 0)
    counts = found.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )
    a, b = F.col("a"), F.col("b")

    def part(seen, rows, total):
        """seen * ln(seen / expected), 0 for none, where rows of all rows would be expected."""
        return F.when(seen > 0, seen * F.log(seen * (toxic + plain) / (rows * total))).otherwise(0.0)

    ratio = part(a, a + b, toxic) + part(b, a + b, plain)
    ratio += part(toxic - a, toxic + plain - a - b, toxic) + part(plain - b, toxic + plain - a - b, plain)
    above = counts.where((a >= LEAST_ROWS) & (a * plain >= LEAST_LIFT * b * toxic))
    above = above.select("word", F.sqrt(2 * F.greatest(ratio, F.lit(0.0))).alias("z")).where(F.col("z") >= LEAST_Z)
    above = kept(above, "above")
    shorter = above.select(F.col("word").alias("_start"), F.col("z").alias("_z"))
    size = F.octet_length("word")
    starts = [F.when(size > k, F.substring("word", 1, k)) for k in STEMS]
    below = above.withColumn("_start", F.explode(F.array_compact(F.array(*starts)))).join(shorter, "_start")
    above = above.join(below.where("_z >= z").select("word").distinct(), "word", "left_anti")
    return {bytes(r.word): round(r.z, 6) for r in above.orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()}


def measured(docs: DataFrame, lexicon: dict[bytes, float], carry) -> DataFrame:
    """The carried columns and ``features``, an MLlib vector."""
    def make():
        weights = Weights(lexicon)
        return lambda texts: [[features(t, weights) for t in texts]]

    found = per_text(docs, make, "_dense array<double>", carry)
    return found.withColumn("features", array_to_vector("_dense")).drop("_dense")


class Constant:
    """Stands in for a model where the labelled rows have one class only."""

    def __init__(self, score: float):
        self.score = score


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS):
    """(lexicon, trees, calibration) from labels (doc_id, label)."""
    sample = labelled_rows(docs, labels, rows)
    seen = {(r.third, r.label) for r in sample.select("third", "label").distinct().collect()}
    if len({label for _, label in seen}) < 2 or len(seen) < 6:
        share = sample.agg(F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()[0]
        return {}, Constant(float(share or 0.0)), None
    lexicon = learn_lexicon(sample.where("third = 0"))
    points = kept(measured(sample, lexicon, ("label", "weight", "third")), "points")
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, seed=7)
    trees = trees.fit(points.where("third = 1"))
    raw = trees.transform(points.where("third = 2")).select("label", "weight", _margin())
    return lexicon, trees, IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(raw)


def _margin():
    return vector_to_array(F.col("rawPrediction"))[1].alias("margin")


def score(docs: DataFrame, model, carry=("doc_id",)) -> DataFrame:
    """The carried columns, score (0 to 1) and predicted (1 from 0.5) of every text.

    Null and empty texts have zero features and get their score like any other. Calibration is a step
    function with straight lines between, so equal scores are ties in the order of the trees' margins;
    a share of one millionth of the uncalibrated probability keeps that order. With one class of labels
    the score is that class.
    """
    lexicon, trees, calibration = model
    carry = [c for c in carry if c not in ("score", "predicted", "features")]
    if calibration is None:
        rows = docs.select(*carry).withColumn("score", F.lit(trees.score))
    else:
        rows = trees.transform(measured(docs, lexicon, carry))
        plain = vector_to_array(F.col("probability"))[1]
        rows = calibration.setPredictionCol("_calibrated").transform(rows.withColumn("margin", _margin()).withColumn("_plain", plain))
        mixed = F.col("_calibrated") * (1 - 1e-6) + F.col("_plain") * 1e-6
        rows = rows.select(*carry, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
