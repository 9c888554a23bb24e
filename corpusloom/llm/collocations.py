"""Phrase collocation mining, level by level (Apriori).

A pass over the texts counts the phrases of k words; a phrase is counted only where both of the phrases of k - 1 words
in it are frequent. Which ones are, the passes know from a broadcast bitmap of a fixed largest size: a bit set by
another phrase lets a phrase be counted in vain, never the reverse, and the counts that Spark sums decide. Each level's
frequent phrases are a written table; cuts are scored from these by joins, in decimals.

Defined cases: a null text has no words, a null lang is `und`; rows that repeat count each; an empty table has no
phrases; extra columns are ignored. A word is whatever stands between the separators, so any text has words of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import blocks, dropped, small_batches, written
from corpusloom.llm.shingles import PLACES, mixed

LONGEST, FREQUENT, TOP, NO_LANG = 4, 30, 2000, "und"
#: Bits of the broadcast bitmap for each frequent phrase, and its largest size as a power of two (32 MB).
BITS_EACH, LARGEST_BITMAP = 24, 28
#: Distinct words, and phrases, that a task holds before it hands on its counts.
WORDS_HELD, PHRASES_HELD = 600_000, 3_000_000
#: How many partial lists of the best phrases are combined at once.
FAN = 16
# Separators of pieces become a byte that no text holds; A-Z are lower-cased; a tab is a space.
BREAK = b"\xff"
TABLE = bytes(0xFF if chr(c) in ".,;:!?\n\v\f\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SHAPE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType())])


def _hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def _joined(h: list[np.ndarray], lang: int | np.ndarray) -> np.ndarray:
    """One number for the phrase of the words whose numbers stand at the same place of each array."""
    s = np.zeros(len(h[0]), np.uint64) + np.asarray(lang, np.uint64)
    for x, place in zip(h, PLACES, strict=False):
        s += x * place
    return mixed(s, len(h))


def _lang_number(lang: str) -> int:
    return int(_hashes([lang.encode()])[0])


class Bitmap:
    """Which phrases may be frequent."""

    def __init__(self, bits: int, cells: np.ndarray) -> None:
        self.shift, self.cells = np.uint64(64 - bits), cells

    def may(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class _Counts:
    """The phrases of k words in the texts of one language, as a task meets them."""

    def __init__(self, lang: str, k: int, bitmap: Bitmap | None) -> None:
        self.lang, self.k, self.bitmap, self.number = lang, k, bitmap, _lang_number(lang)
        self.start()

    def start(self) -> None:
        self.id_of: dict[bytes, int] = {BREAK: 0}
        self.words, self.hash = [BREAK], np.zeros(1, np.uint64)
        self.total, self.seen, self.held, self.n_held = 0, np.zeros(1, np.int64), [], 0

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        """text: pieces and words parted by BREAK and spaces."""
        before = np.empty(0, np.int64)
        for block in blocks(text):
            words = block.replace(BREAK, b" \xff ").split()
            id_of = self.id_of
            ids = list(map(id_of.get, words))
            if None in ids:
                for w in dict.fromkeys(words):
                    if w not in id_of:
                        id_of[w] = len(self.words)
                        self.words.append(w)
                ids = list(map(id_of.get, words))
            if self.k > 1 and len(self.hash) < len(self.words):
                self.hash = np.concatenate([self.hash, _hashes(self.words[len(self.hash) :])])
            ids = np.concatenate([before, np.array(ids, np.int64)])
            self.total += int((ids[len(before) :] != 0).sum())
            self._count(ids)
            before = ids[max(0, len(ids) - self.k + 1) :] if self.k > 1 else before
            if len(self.words) > WORDS_HELD or self.n_held > PHRASES_HELD:
                yield from self.out()
                self.start()
                before = np.empty(0, np.int64) if self.k == 1 else self._renumbered(before, id_of)

    def _renumbered(self, ids: np.ndarray, old: dict[bytes, int]) -> np.ndarray:
        """The last words of a block, after the words began anew."""
        wanted = set(ids.tolist())
        name = {i: w for w, i in old.items() if i in wanted}
        for w in name.values():
            if w not in self.id_of:
                self.id_of[w] = len(self.words)
                self.words.append(w)
        return np.array([self.id_of[name[i]] for i in ids.tolist()], np.int64)

    def _count(self, ids: np.ndarray) -> None:
        k = self.k
        if k == 1:
            n = np.bincount(ids, minlength=len(self.words))
            n[: len(self.seen)] += self.seen
            self.seen = n
            return
        m = len(ids) - k + 1
        if m < 1:
            return
        h, words = self.hash[ids], ids != 0
        part = _joined([h[i : len(h) - k + 2 + i] for i in range(k - 1)], self.number)
        ok = self.bitmap.may(part)
        for i in range(k - 1):
            ok &= words[i : len(h) - k + 2 + i]
        at = np.nonzero(ok[:-1] & ok[1:])[0]
        if len(at):
            self.held.append(ids[at[:, None] + np.arange(k)].astype(np.int32))
            self.n_held += len(at)

    def out(self) -> Iterator[pa.RecordBatch]:
        """The counts so far; a null phrase has the number of words."""
        if self.k == 1:
            at = np.nonzero(self.seen)[0]
            at = at[at != 0]
            columns, counts = [at], self.seen[at]
            yield self._batch(pa.nulls(1, pa.string()), np.array([self.total]))
        else:
            rows = np.concatenate(self.held) if self.held else np.empty((0, self.k), np.int32)
            code = rows[:, 0].astype(np.int64)
            for i in range(1, self.k):  # exact: equal codes have equal words
                if i > 1:
                    code = np.unique(code, return_inverse=True)[1]
                code = (code << 32) | rows[:, i]
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            columns = list(rows[first].T)
        words = pa.array(self.words, pa.binary())
        for a in range(0, len(counts), 1 << 16):
            parts = [words.take(pa.array(c[a : a + (1 << 16)])) for c in columns]
            yield self._batch(pc.binary_join_element_wise(*parts, b" ").cast(pa.string()) if len(parts) > 1 else parts[0].cast(pa.string()), counts[a : a + (1 << 16)])

    def _batch(self, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(self.lang, len(counts)), phrases, pa.array(counts, pa.int64())], names=SHAPE.fieldNames())


def _pass(docs: DataFrame, k: int, bitmap: tuple[int, np.ndarray] | None) -> DataFrame:
    """lang, phrase, f: partial counts of the phrases of k words."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, _Counts] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text.encode())
            for lang, texts in by_lang.items():
                if lang not in found:
                    found[lang] = _Counts(lang, k, Bitmap(*known.value) if known.value else None)
                yield from found[lang].add(BREAK.join(t.translate(TABLE) for t in texts))
            if sum(len(c.words) for c in found.values()) > WORDS_HELD or sum(c.n_held for c in found.values()) > PHRASES_HELD:
                for c in found.values():
                    yield from c.out()
                found.clear()
        for c in found.values():
            yield from c.out()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)), F.col("text").cast("string")).mapInArrow(rows, SHAPE)


def _bitmap(level: DataFrame, k: int, frequent: int) -> tuple[int, np.ndarray]:
    """Bits of the level's phrases; Spark combines them, at most 2^22 numbers come to the driver."""
    bits = min(LARGEST_BITMAP, max(10, (frequent * BITS_EACH).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column(1).to_pylist()
            if not phrases:
                continue
            words = [p.encode().split(b" ") for p in phrases]
            langs = {x: _lang_number(x) for x in set(batch.column(0).to_pylist())}
            h = _joined([_hashes([w[i] for w in words]) for i in range(k)], np.array([langs[x] for x in batch.column(0).to_pylist()], np.uint64))
            at = h >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["cell", "bit"])

    rows = level.select("lang", "phrase").mapInArrow(cells, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["cell"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return bits, out


def levels(docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n (its words), and for each number of words a written table lang, phrase, f of the frequent phrases."""
    small_batches(docs.sparkSession)
    out: list[DataFrame] = []
    total, bitmap = None, None
    for k in range(1, longest + 1):
        summed = _pass(docs, k, bitmap).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found = written(summed.where((F.col("f") >= frequent) | F.col("phrase").isNull()), f"phrases{k}")
        if k == 1:
            total = found.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
        out.append(found.where("phrase IS NOT NULL"))
        out[-1].written_to = found.written_to
        if k < longest:
            bitmap = _bitmap(out[-1], k, out[-1].count())
    return total, out


def _words(of: str = "phrase") -> Column:
    return F.split(of, " ")


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate, by the cut with the lowest score, the first among equals."""
    known = tables[0]
    for t in tables[1:]:
        known = known.unionByName(t)
    candidates = tables[1].select("lang", "phrase", F.col("f").alias("a"))
    for t in tables[2:]:
        candidates = candidates.unionByName(t.select("lang", "phrase", F.col("f").alias("a")))
    cut = F.explode(F.sequence(F.lit(1), F.size(_words()) - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", cut)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice(_words(), F.lit(1), F.col("k")), " ").alias("part")), F.struct(F.lit(1).alias("side"), F.array_join(F.slice(_words(), F.col("k") + 1, F.size(_words()) - F.col("k")), " ").alias("part"))))
    parts = cuts.select("*", sides.alias("s")).select("lang", "phrase", "a", "k", "s.*")
    met = parts.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def covered(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, over: the largest count of a longer candidate that holds the phrase's words in a row."""
    inner = None
    for words, t in enumerate(tables[2:], start=3):
        spans = [F.array_join(F.slice(_words(), i + 1, n), " ") for n in range(2, words) for i in range(words - n + 1)]
        rows = t.select("lang", F.explode(F.array(*spans)).alias("phrase"), F.col("f").alias("over"))
        inner = rows if inner is None else inner.unionByName(rows)
    return inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """lang and the first `top` rows of each, in order, in an array: partial lists of bounded groups, combined in a tree."""
    kept = rows.select("lang", F.xxhash64("phrase").alias("deal"), F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("b"), "phrase", "l", "r").alias("x"))
    lists = -(-kept.count() // (2 * top)) or 1
    group = lambda n: F.pmod(F.col("deal"), F.lit(n))
    first = lambda x: F.slice(F.sort_array(x), 1, top).alias("x")
    out = kept.withColumn("deal", group(lists)).groupBy("lang", "deal").agg(first(F.collect_list("x")))
    while lists > 1:
        lists = -(-lists // FAN)
        out = out.withColumn("deal", group(lists)).groupBy("lang", "deal").agg(first(F.flatten(F.collect_list("x"))))
    return out.drop("deal")


def collocations(docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language that no longer one stands for."""
    total, tables = levels(docs, longest, frequent)
    rows = scored(tables).join(covered(tables), ["lang", "phrase"], "left")
    rows = written(rows.where(F.col("over").isNull() | (_exact("over") * 100 < _exact("a") * 80)).drop("over"), "candidates")
    dropped(*tables[1:])
    out = _best(rows, top).join(total, "lang").select("lang", "n", F.posexplode("x").alias("rank", "x"))
    return out.select("lang", (F.col("rank") + 1).cast("long").alias("rank"), "x.phrase", (-F.col("x.b")).alias("a"), "x.l", "x.r", "n", (-F.col("x.s")).alias("score"))
