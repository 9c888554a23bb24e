"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matches, exception phrases, length normalisation.

Terms are word stems (prefixes of words) or whole words. Their weights are log odds learned from labelled
training rows on top of a short fixed list; hits inside an exception phrase count nothing. The score is a logistic
function of the summed weight and of that sum normalised by the text's length.

Defined cases: a null or empty text scores as a text without hits; texts that repeat score alike; without labels the
fixed list and default coefficients serve; a null doc_id falls in the fold of the empty text; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, id_fold, small_batches, text_of, written

# Insults that are terms whatever the labels say, phrases in which a term is harmless.
BASE_TERMS = ("idiot", "moron", "stupid", "pathetic", "worthless", "scum", "loser", "disgusting", "imbecile")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser award", "stupid simple", "idiot proof")
# Look-alike letters of other scripts, and digits or signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ɡ": "g", "ı": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"

MIXED = re.compile(r"[^\s\d@$!|]*[1!|][^\s]*")


@lru_cache(1)
def _tables() -> tuple[dict, dict]:
    """Character maps: with 1 ! | read as i, and as l."""
    base: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for code in range(0x20, 0x3000):
        c = chr(code)
        if unicodedata.category(c)[0] in "PSZ" and c not in SUBSTITUTES:
            base.setdefault(code, " ")
    base |= {code: " " for code in range(0x09, 0x0E)}
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        c = chr(code - 0xFEE0).lower()
        base[code] = SUBSTITUTES.get(c, c if c.isalnum() else " ")
    for code in range(0x1D400, 0x1D800):  # mathematical letters
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        if len(c) == 1 and c != chr(code):
            base[code] = SUBSTITUTES.get(c, c)
    base |= {ord(k): v for k, v in LOOKALIKES.items()}
    base |= {ord(k): v for k, v in SUBSTITUTES.items()}
    return base, base | {ord(c): "l" for c in "1!|"}


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin letters, digits and signs to the letters that they stand for, all else to spaces.

    Words that hold one of 1 ! | appear a second time at the end, with l in its place.
    """
    low = text.lower()
    first, second = _tables()
    out = low.translate(first)
    if "1" in low or "!" in low or "|" in low:
        again = [w for w in MIXED.findall(low) if any(c.isalpha() for c in w)]
        if again:
            out += " . " + " ".join(again).translate(second)
    return f" {out} "


@dataclass
class Lexicon:
    """weights: by term; a term begins with a space (start of a word) and may end with one (end of a word)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-2.0, 1.5, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for p in self.exceptions:
                t = f" {p} "
                a.add_word(t, (len(t), None))
            a.make_automaton()
            self._automaton = a if len(a) else False
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def features(self, text: str | None) -> tuple[float, float]:
        """log(1 + summed weight), and the sum by the square root of the number of words. Each word counts its best term."""
        if not text or not (automaton := self.automaton()):
            return 0.0, 0.0
        folded = fold(text)
        hits: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                safe.append((start, end))
            elif w > hits.get(start, 0.0):
                hits[start] = w
        if safe:  # marked once, whatever their number
            inside = bytearray(len(folded))
            for a, b in safe:
                inside[a:b] = b"\1" * (b - a)
            hits = {start: w for start, w in hits.items() if not inside[start]}
        total = math.fsum(hits.values())
        return math.log1p(total), total / math.sqrt(1 + folded.count(" "))

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _forms(w: str, least: int = 4, most: int = 12) -> list[str]:
    """The terms that a word holds: its stems, and itself as a whole."""
    return [f" {w} ", *(" " + w[:k] for k in range(least, min(len(w), most) + 1))]


def _stems(text: str) -> set[str]:
    return {s for w in set(fold(text).split()) for s in _forms(w)}


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, last (a word that it follows), n (texts with the term, on one of its rows) of a task's texts."""
    texts: Counter[str] = Counter()
    after: dict[str, set[str]] = {}
    for batch in batches:
        for t in batch.column(0).to_pylist():
            words = fold(t).split()
            texts.update({s for w in set(words) for s in _forms(w)})
            for last, w in zip(["", *words], words, strict=False):
                for s in _forms(w):
                    after.setdefault(s, set()).add(last)
    terms = sorted(after)
    for i in range(0, len(terms), 2000):
        some = [(s, last, 0 if j else texts[s]) for s in terms[i : i + 2000] for j, last in enumerate(sorted(after[s]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["term", "last", "n"])


def fit(rows: DataFrame, min_log_odds: float = 3.0) -> Lexicon:
    """Weights from text, toxic (distinct, no empty text): a stem's smoothed log odds, if it is in at least 1 % (and 3) of the toxic texts.

    It must also follow as many different words, or it marks copies of one text. A longer stem is dropped where a
    shorter one of the same words is as good. A fixed term stays unless a larger share of clean texts holds it. Texts
    stay in their tasks: terms that reach the support, at most some hundred times those of a text, and two features of
    each row come to the driver.
    """
    rows = written(rows, "toxicity-rows")
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    base = {f" {t}": 3.0 for t in BASE_TERMS}
    if not size.get(1) or not size.get(0):
        return Lexicon(base)
    support = max(3, math.ceil(0.01 * size[1]))
    toxic, clean = (rows.where(F.col("toxic") == k).select("text") for k in (1, 0))
    found = toxic.mapInArrow(_toxic_terms, "term string, last string, n long").groupBy("term", "last").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("before"))
    enough = (F.col("n") >= support) & (F.col("before") >= F.greatest(F.lit(float(support)), 0.3 * F.col("n")))
    found = {r.term: r for r in found.where(enough | F.col("term").isin(list(base))).collect()}
    wanted = {t: r.n for t, r in found.items() if r.n >= support and r.before >= max(support, 0.3 * r.n)}
    asked = wanted.keys() | base.keys()

    def clean_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(s for batch in batches for t in batch.column(0).to_pylist() for s in _stems(t) & asked)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    n_clean = Counter({r.term: r.n for r in clean.mapInArrow(clean_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()})
    odds = {s: math.log((n + 0.5) / (size[1] + 1)) - math.log((n_clean[s] + 0.5) / (size[0] + 1)) for s, n in wanted.items()}
    kept: dict[str, float] = {}
    for s in sorted(odds, key=lambda s: (len(s), s)):
        if odds[s] >= min_log_odds and not any(s[:k] in kept and kept[s[:k]] >= odds[s] - 1 for k in range(4, len(s))):
            kept[s] = odds[s]
    for t, w in base.items():
        n = found[t].n if t in found else 0
        if not any(t[:k] in kept for k in range(2, len(t) + 1)) and n * size[0] >= n_clean[t] * size[1]:
            kept[t] = w
    lexicon = Lexicon(kept)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column(1)], names=["x", "y", "toxic"])

    points = np.array(sorted(map(tuple, rows.select("text", "toxic").mapInArrow(features, "x double, y double, toxic int").collect())))
    lexicon.coefficients = tuple(_logistic(np.column_stack([np.ones(len(points)), points[:, :2]]), points[:, 2]))
    dropped(rows)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.02, rounds: int = 60) -> list[float]:
    """Newton's method with a ridge; slopes stay at 0 or more, so more hits never lower a score."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [l2] * (x.shape[1] - 1)) * max(1.0, len(y) / 100)
    free = np.ones(x.shape[1], bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w -= np.clip(step, -2, 2)
        if (w[1:] < 0).any():
            free[1:] &= w[1:] >= 0
            w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = 4000, folds: int = 5) -> Lexicon:
    """Fit on at most `bound` labelled documents outside fold 0 of `folds`, up to a quarter of them toxic, the rest clean.

    They are those with the smallest hash of the id, whatever their number; their ids come to the driver. The intercept
    is set right for the share of toxic ones among all labelled rows. A document with both labels is toxic.
    """
    of = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_fold("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id", F.lit("toxicity")))
    )
    total = {r.toxic: r["count"] for r in of.groupBy("toxic").count().collect()}
    ids = [r for k, n in ((0, bound - bound // 4), (1, bound // 4)) for r in of.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(n).select("doc_id", "toxic").collect()]
    if not ids:
        return Lexicon({f" {t}": 3.0 for t in BASE_TERMS})
    chosen = docs.sparkSession.createDataFrame(ids, of.select("doc_id", "toxic").schema)
    rows = docs.select("doc_id", text_of().alias("text")).where("text <> ''").join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct()
    lexicon = fit(rows)
    drawn = Counter(r.toxic for r in ids)
    if drawn[0] and drawn[1]:
        a, b, c = lexicon.coefficients
        lexicon.coefficients = (a + math.log(total[1] / drawn[1]) - math.log(total[0] / drawn[0]), b, c)
    return lexicon


def score(lexicon: Lexicon, column: str = "text") -> Column:
    """The score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([lexicon.score(t) for t in batch], dtype="float64")

    return scores(F.col(column))


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    small_batches(docs.sparkSession)
    lexicon = fit_on(docs, labels, bound)
    return docs.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), score(lexicon).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
