"""Language identification word by word, with a penalty for switching.

Words get a log-likelihood under the byte trigrams of every language that writes their script; Viterbi
over the words of a text, paying a penalty at each change of language, labels spans of mixed text.
Trigram counts come from a bounded sample of labelled rows of each language, everything else is done
on whole texts inside the scan; nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import kept, per_text, shards

#: So many labelled rows of each language are learned from; the documented bound of the sample.
ROWS_PER_LANGUAGE = 2000

#: What a change of language costs, in units of log-likelihood.
SWITCH = 12.0

#: A language writes a script that this share of its training letters are in.
SCRIPT_SHARE = 0.02

NO_LANGUAGE = "und"

#: First code points of blocks, and the script whose letters begin there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPTS}))
_SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT_OF_BLOCK = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

_words = re.compile(r"[^\W\d_]+").findall


def words(text: bytes | None) -> list[str]:
    """Lower-cased runs of letters; none when the text has no letter at all."""
    found = _words(text.decode().lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []  # word characters may be numbers, as in ½


def scripts(found: list[str]) -> np.ndarray:
    """The number of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in found), np.int64, len(found))
    return _SCRIPT_OF_BLOCK[np.searchsorted(_SCRIPT_STARTS, first, "right") - 1]


def trigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte trigrams of the words between spaces, and the first trigram of each word."""
    joined = np.frombuffer((" " + " ".join(found) + " ").encode(), np.uint8).astype(np.int32)
    code = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
    keep = joined[1:-1] != 32
    starts = np.flatnonzero((joined[:-2] == 32) & keep)
    place = np.cumsum(keep) - 1
    return code[keep], place[starts]


class Model:
    """Per language log-probabilities of trigrams, and the scripts it writes."""

    def __init__(self, languages, grams, log_probability, unseen, writes):
        self.languages, self.grams, self.log_probability, self.unseen, self.writes = (
            languages, grams, log_probability, unseen, writes,
        )

    def scores(self, found: list[str]) -> np.ndarray:
        """(words, languages): log-likelihoods; languages that don't write the script are far behind."""
        code, starts = trigrams(found)
        place = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        known = self.grams[place] == code
        out = np.empty((len(found), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            logs = np.where(known, self.log_probability[place, k], self.unseen[k])
            out[:, k] = np.add.reduceat(logs, starts)
        able = self.writes[:, scripts(found)].T
        return out - np.where(able | ~able.any(axis=1, keepdims=True), 0, 1e6).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; ``scores`` holds the words of all texts after each other.

    All texts advance together, word by word, the longest first in the arrays.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    length = lengths[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    state = np.zeros((len(order), scores.shape[1]), np.float64)
    best = np.zeros(len(scores), np.int16)
    switch = np.zeros(scores.shape, bool)
    for t in range(steps):
        n = active[t]
        at = begin[:n] + t
        if t:
            top = state[:n].argmax(axis=1)
            reached = state[np.arange(n), top] - penalty
            better = state[:n] < reached[:, None]
            best[at], switch[at] = top, better
            state[:n] = np.where(better, reached[:, None], state[:n])
        state[:n] += scores[at]
    label = np.zeros(len(scores), np.int16)
    now = state.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = np.where(switch[at, now[:n]], best[at], now[:n])
    return label


def train(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE):
    """A broadcast of the model of (text, lang, doc_id) rows, about ``rows`` of each language.

    The rows are chosen by a hash of their id. Classes, trigrams of the sample and scripts are bounded by
    the sample, so the driver holds them.
    """
    spark = labelled.sparkSession
    found = labelled.where("lang IS NOT NULL")
    share = found.groupBy("lang").count().select(
        F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count")).alias("_share")
    )
    chosen = found.join(F.broadcast(kept(share, "languages")), F.col("lang") == F.col("_lang"))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    chosen = chosen.select("lang", F.col("text").cast("binary").alias("text"))

    def count(batches):
        for part in shards(batches, "text", 4 << 20):
            by = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, []).extend(words(text))
            for lang, of in by.items():
                if of:
                    code, n = np.unique(trigrams(of)[0], return_counts=True)
                    kind, m = np.unique(scripts(of), return_counts=True)
                    key = np.concatenate([code, -1 - kind]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key)), pa.array(key), pa.array(np.concatenate([n, m]))],
                        ["lang", "key", "n"],
                    )

    counts = chosen.mapInArrow(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    which = np.array([languages.index(x) for x in names], np.int64)
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    grams = np.unique(key[key >= 0])
    seen = np.zeros((len(grams), len(languages)))
    g = key >= 0
    seen[np.searchsorted(grams, key[g]), which[g]] = n[g]
    letters = np.zeros((len(languages), len(SCRIPT_NAMES)))
    letters[which[~g], -1 - key[~g]] = n[~g]
    total = seen.sum(axis=0) + 0.5 * (len(grams) + 1)
    writes = letters >= SCRIPT_SHARE * letters.sum(axis=1, keepdims=True)
    model = Model(
        languages, grams, np.log((seen + 0.5) / total).astype(np.float32), np.log(0.5 / total).astype(np.float32), writes
    )
    return spark.sparkContext.broadcast(model)


def _labeller(model, penalty):
    def make():
        m = model.value

        def label(texts):
            found = [words(t) if m.languages else [] for t in texts]
            lengths = np.array([len(w) for w in found], np.int64)
            number: dict[str, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for of in found for w in of], np.int64)
            pred, score, spans = [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if not len(ids):
                return pred, score, spans
            distinct = list(number)
            label_of = viterbi(m.scores(distinct)[ids], lengths, penalty)
            size = np.fromiter(map(len, distinct), np.int64, len(distinct))[ids]
            doc = np.repeat(np.arange(len(texts)), lengths)
            kinds = len(m.languages)
            weight = np.bincount(doc * kinds + label_of, size, len(texts) * kinds).reshape(-1, kinds)
            top = weight.argmax(axis=1)
            cuts = np.flatnonzero(np.diff(doc * kinds + label_of)) + 1
            first = np.concatenate([[0], cuts])
            begin = np.cumsum(lengths) - lengths
            many = np.diff(np.append(first, len(ids)))
            for d in np.flatnonzero(lengths).tolist():
                pred[d] = m.languages[top[d]]
                score[d] = float(weight[d, top[d]] / weight[d].sum())
            for at, n in zip(first.tolist(), many.tolist()):
                d = doc[at]
                spans[d].append({"first": at - int(begin[d]), "words": n, "lang": m.languages[label_of[at]]})
            return pred, score, spans

        return label

    return make


RESULT = "lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>"


def identify(docs: DataFrame, model, carry=("doc_id",), penalty: float = SWITCH) -> DataFrame:
    """The carried columns, lang_pred, score and spans (word runs of one language) of every text.

    lang_pred is the language of most letters, score their share. A null text, an empty one and one
    without a letter are ``und`` with score 0 and no spans, as is any text under a model that has learned
    no language. Ties go to the language that sorts first. Words of a script that no learned language
    writes are compared under all.
    """
    return per_text(docs, _labeller(model, penalty), RESULT, carry)
