"""Grouping of spelling variants by a symmetric-delete join.

Every word emits itself and its deletions by one code point; words meet at equal keys. Two words differ by one replaced
code point if and only if the same key comes of deleting the same place in both, and by one inserted code point if and
only if the key of one is the other itself. So those that meet at a key and a place are near each other one and all:
their number and the best two of them say for each what all pairs would, and no pairs are made. Keys are pairs of 64-bit
sums over places and code points, made in time linear in the word; a word's form, the only neighbour that is named, is
checked letter by letter.

Defined cases: a null text has no words; a null id counts as the empty text in the hash that alters runs; rows that
repeat count each; an empty table has no words; extra columns are ignored. Words may be as long as they like.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, dropped, parts_for, small_batches, written
from corpusloom.llm.shingles import mixed

SHORTEST, LEAST, TIMES, ALTERED = 6, 5, 5, 199
#: Distinct words that a task holds before it hands on its counts; letters of words whose keys are made at once.
WORDS_HELD, LETTERS = 600_000, 1 << 20
# In Latin-1, letters A-Z become small, a-z and U+00C0 to U+00FF stay, all else parts words.
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 0x20 for c in range(256))


def _altered(words: list[bytes], start: int) -> list[bytes]:
    """Runs of a document after the seeded deletion; start: the checksum of its id and a colon."""
    sums = np.fromiter(map(zlib.crc32, [w if w.isascii() else w.decode("latin-1").encode() for w in words], repeat(start)), np.int64, len(words))
    for i in np.nonzero(sums % ALTERED == 0)[0].tolist():
        at = int(sums[i]) % len(words[i])
        words[i] = words[i][:at] + words[i][at + 1 :]
    return words


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: partial counts of the words of all texts."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{i}:".encode())
                for block in blocks((text or "").encode("latin-1", "replace").translate(RUNS)):
                    runs = Counter(block.split())
                    words = [w for w in runs if len(w) >= SHORTEST]
                    for w, was in zip(_altered(words.copy(), start), words, strict=True):
                        if len(w) >= SHORTEST:
                            found[w] += runs[was]
            if len(found) > WORDS_HELD:
                yield out()
                found.clear()
        yield out()

    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string")).mapInArrow(rows, "word string, n long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, word -> k1, k2, place, once, id, n: the word itself at place -1, and each deletion; once: of deletions with one result only the first has it."""
    for batch in batches:
        words = [w.encode("utf-32-le") for w in batch.column(2).to_pylist()]
        start = 0
        while start < len(words):
            end, size = start + 1, len(words[start])
            while end < len(words) and size + len(words[end]) <= 4 * LETTERS:
                size, end = size + len(words[end]), end + 1
            c = np.frombuffer(b"".join(words[start:end]), np.uint32).astype(np.uint64)
            length = np.array([len(w) // 4 for w in words[start:end]], np.int64)
            first = np.cumsum(length) - length
            owner = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(c)) - first[owner]
            keys = []
            for salt in (11, 12):
                here = mixed(c | (place.astype(np.uint64) << np.uint64(21)), salt)
                back = mixed(c | ((place - 1).astype(np.uint64) << np.uint64(21)), salt)
                a, b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (here, back))
                low, high = first[owner], first[owner] + length[owner]
                at = np.arange(len(c))
                keys.append((a[first + length] - a[first], a[at] - a[low] + b[high] - b[at + 1]))
            once = np.ones(len(c), bool)
            once[1:] = (c[1:] != c[:-1]) | (place[1:] == 0)
            ids, n = (batch.column(i).to_numpy()[start:end] for i in (0, 1))
            none = np.full(len(length), -1, np.int64)
            columns = [np.concatenate([k[0], k[1]]).view(np.int64) for k in keys]
            columns += [np.concatenate([none, place]), np.concatenate([np.ones(len(length), bool), once]), np.concatenate([ids, ids[owner]]), np.concatenate([n, n[owner]])]
            for i in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in columns], names=["k1", "k2", "place", "once", "id", "n"])
            start = end


def _near(words: DataFrame) -> DataFrame:
    """id, n_near, best (struct of -n and id) of each word that has a near one. words: id in the order of the words, n, word."""
    keys = words.select("id", "n", "word").mapInArrow(_keys, "k1 long, k2 long, place long, once boolean, id long, n long")
    keys = keys.withColumn("x", F.struct((-F.col("n")).alias("s"), F.col("id").alias("i")))
    key, here = Window.partitionBy("k1", "k2"), Window.partitionBy("k1", "k2", "place")
    ranked = here.orderBy("x")
    longer = (F.col("place") >= 0) & F.col("once")
    keys = keys.select(
        "*",
        F.row_number().over(ranked).alias("rank"),
        F.first("x").over(here.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
        F.lead("x").over(ranked).alias("second"),
        F.count("*").over(here).alias("members"),
        F.max(F.when(F.col("place") < 0, F.col("x"))).over(key).alias("itself"),
        F.min(F.when(longer, F.col("x"))).over(key).alias("best_longer"),
        F.count(F.when(longer, True)).over(key).alias("n_longer"),
    )
    replaced = F.when(F.col("place") >= 0, F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first")))
    shorter = F.when(longer, F.col("itself"))
    inserted = F.when(F.col("place") < 0, F.col("best_longer"))
    many = F.when(F.col("place") < 0, F.col("n_longer")).otherwise(F.col("members") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    rows = keys.select("id", many.alias("many"), F.array_min(F.array_compact(F.array(replaced, shorter, inserted))).alias("best")).where("many > 0")
    return rows.groupBy("id").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """id, root of forms (id, form): each round the root of the root so far; n grows fivefold a step, so few rounds do."""
    found = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(found.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        changed = moved.where("moved").limit(1).count()
        dropped(found)
        found, path = moved.select("id", "root"), moved.written_to
        found.written_to = path
        if not changed:
            return found


def spelling_variants(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each distinct word of at least SHORTEST code points and `least` occurrences."""
    spark = docs.sparkSession
    counted = word_counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # Numbers in the order of the words: ties between words are ties between numbers.
    words = written(counted.repartitionByRange(parts_for(spark, 8), "word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = written(words.join(_near(words), "id", "left").select("id", "n", "word", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.s")).alias("best_n"), F.col("best.i").alias("best")), "near")
    given = F.col("best_n") >= times * F.col("n")
    name = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    forms = near.where(given).select("id", "word", F.col("best").alias("form"), F.col("best_n").alias("form_n")).join(name, "form")
    checked = F.when(F.levenshtein("word", "form_word", 1) == 1, F.col("form_word")).otherwise(F.raise_error(F.lit("two keys are equal by chance")))
    forms = written(forms.select("id", "form", "form_n", checked.alias("form_word")), "forms")
    roots = _roots(forms).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = near.join(forms, "id", "left").join(roots, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
