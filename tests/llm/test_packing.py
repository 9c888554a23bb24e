import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import packing
from corpusloom.llm.common import table

ODD = ["", None, "a\x0bb\x0cc\x1cd\x1ee\x85f\xa0g h", "it's don't 'str abc's. x.", "Ünïcode ÀÉ ß ªº µ İI ſK", "é a ́b", "日本語 テスト 😀😀", "<|endoftext|> x<|startoftext|>y", "1234 5a6b", "a,b,c.. ,x, .", "× ÷ a×b", "x" * 5000, "Σσς ΑΣ", "À× ab.: c;: :", "a\r\nb", "one two " * 3000]


def whole(text):
    tokenizer = whole.tokenizer = getattr(whole, "tokenizer", None) or Tokenizer.from_file(packing.MODEL)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_librarys(spark):
    coder = packing.Coder(open(packing.MODEL).read())
    texts = ODD + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    assert [[*coder.encode(t).tolist(), 0] for t in texts] == [whole(t) for t in texts]


def fewest(sizes, length):
    """The least number of sequences, by trying."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for r in set(room):
            if r >= sizes[i]:
                j = room.index(r)
                room[j] -= sizes[i]
                go(i + 1, room)
                room[j] += sizes[i]
        go(i + 1, [*room, length - sizes[i]])

    go(0, [])
    return best


def filled(patterns, length):
    found = Counter()
    for pattern, many in patterns:
        assert sum(pattern) <= length and many > 0
        for s in pattern:
            found[s] += many
    return found


def test_few_sequences():
    rnd = random.Random(5)
    over = 0
    for trial in range(60):
        length = rnd.choice([20, 50, 100])
        sizes = [rnd.randint(1 + length // rnd.choice([4, 5, 50]), length * 2 // 3) for _ in range(rnd.randint(1, 11))]
        found = packing.completed(Counter(sizes), length)
        assert filled(found, length) == Counter(sizes)
        many, best = sum(m for _, m in found), fewest(sizes, length)
        assert packing.least_sequences(Counter(sizes), length) <= best <= many
        over += many - best
    assert over == 0
    assert packing.completed({}, 10) == [] and packing.completed({10: 3}, 10) == [((10,), 3)]
    with pytest.raises(ValueError, match="longer"):
        packing.completed({11: 1}, 10)


def test_search_betters_best_fit():
    counts = Counter([6, 5, 5, 4, 4, 4, 2])  # best fit opens a fourth sequence of 10
    counts = Counter([7, 6, 5, 5, 4, 3]) + Counter([8, 2])
    assert sum(m for _, m in packing.completed(counts, 10)) == fewest(counts.elements(), 10)
    worse = 0
    rnd = random.Random(7)
    for _ in range(80):
        counts = Counter(rnd.choices([17, 23, 26, 31, 34, 43, 51], k=9))
        fit, found = (sum(m for _, m in f(counts, 100)) for f in (packing.best_fit, packing.completed))
        assert found <= fit
        worse += found < fit
    assert worse


def test_dominance():
    def by_force(a, b):
        if not b:
            return True
        return any(x >= b[0] and by_force((*a[:i], x - b[0], *a[i + 1 :]), b[1:]) for i, x in enumerate(a))

    sets = [c for k in (1, 2, 3) for c in combinations((9, 7, 6, 4, 3, 2), k)]
    assert all(packing.dominates(a, b) == by_force(a, b) for a in sets for b in sets)


def test_many_equal_lengths_stay_near_the_bound():
    rnd = random.Random(3)
    counts = Counter({s: rnd.randint(1, 10**9) for s in rnd.sample(range(1, 2049), 700)})
    found = packing.completed(counts)
    assert filled(found, 2048) == counts
    assert sum(m for _, m in found) <= 1.01 * packing.least_sequences(counts, 2048)


def checked(rows, texts, length=2048):
    """texts: of (doc_id, text) rows; each row of the table has its pieces once, sequences are gapless and short enough."""
    want = Counter()
    for i, t in texts:
        ids = whole(t)
        for k, start in enumerate(range(0, len(ids), length)):
            part = np.array(ids[start : start + length], "<u4")
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by_sequence.values():
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert at <= length
    return len(by_sequence)


def test_query_and_sequences(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.packed(docs, ids=True).cache()
    many = checked(rows.collect(), texts)
    sizes = Counter(r.length for r in rows.collect())
    assert many <= packing.least_sequences(sizes, 2048) + 1
    whole_ = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(rows).collect()}
    assert len(whole_) == many
    for r in rows.collect():
        assert (whole_[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(bytes(r.ids), "<u4")).all()


def test_odd_tables(spark):
    texts = [*enumerate(ODD), (None, "x y"), (None, None), *[(3, "one two three")] * 40]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("own")).withColumn("row", F.lit(1))
    found = packing.packed(docs)
    assert found.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    checked(found.collect(), texts)
    assert packing.packed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{3: 10_000, 7: 5_000}, {1: 1}, {2: 100_000, 3: 5, 2048: 7}, {s: 1003 for s in range(1, 12)}])
def test_lengths_so_short_that_a_sequence_takes_more_than_there_are_steps(counts):
    patterns, used = packing.completed(counts), Counter()
    for pattern, many in patterns:
        assert sum(pattern) <= packing.LENGTH
        used.update({s: c * many for s, c in Counter(pattern).items()})
    assert used == Counter(counts)
    assert sum(m for _, m in patterns) <= packing.least_sequences(counts, packing.LENGTH) + 1


@pytest.mark.parametrize("block", [1, 64, 1 << 22])
def test_texts_are_encoded_together_and_each_word_once(monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    coder = packing.Coder(open(packing.MODEL).read())
    texts = [*ODD, "One one, ONE. one$$$ !? ?!a", "", "é" * 500 + "  x\t", None]
    ids, ends = coder.encode_all(pa.array(texts, pa.string()))
    assert [ids[i:j].tolist() for i, j in zip([0, *ends[:-1]], ends, strict=True)] == [whole(t) for t in texts]
    assert {"one", "two", "$$$"} < coder.words.keys() and not {"One", "ONE", "one,"} & coder.words.keys()
    ids, ends = coder.encode_all(pa.array([], pa.string()))
    assert len(ids) == len(ends) == 0
