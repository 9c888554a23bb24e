import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import collocations
from corpusloom.llm.common import table

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, longest=4, frequent=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(AZ)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    rows = []
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= frequent}
    over = Counter()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                over[lang, p[i : i + k]] = max(over[lang, p[i : i + k]], a)
    for (lang, p), a in candidates.items():
        cut = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        if 100 * over[lang, p] < 80 * a:
            rows.append((lang, -cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
    rows.sort()
    out, rank = [], Counter()
    for lang, s, a, p, left, right in rows:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return out


def found(df, **options):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    out = collocations.collocations(df, **options)
    assert out.columns == names and dict(out.dtypes)["rank"] == dict(out.dtypes)["n"] == dict(out.dtypes)["score"] == "bigint"
    return sorted(tuple(r) for r in out.collect())


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.lang, r.text) for r in docs.collect()]
    assert found(docs) == sorted(brute(texts))
    assert found(docs, frequent=5, top=40) == sorted(brute(texts, frequent=5, top=40))


def test_odd_texts_and_tables(spark):
    rnd = random.Random(2)
    words = ["a", "B", "b", "É", "é", "c\x1cd", "x y", " ", "😀", "e-f", "<|>"]
    texts = [(rnd.choice(["en", None, "und", "de"]), "".join(rnd.choice(words) + rnd.choice([" ", "\t", "  ", ". ", ",", "\n", "\x0b", "?!"]) for _ in range(300))) for _ in range(30)]
    texts += [("en", None), (None, ""), ("fr", None), ("de", ". . ,"), ("en", "one two three four " * 2000)] + [("en", "same words again and again")] * 40
    docs = spark.createDataFrame(texts, "lang string, text string").withColumn("phrase", F.lit("own")).withColumn("f", F.lit(1)).repartition(5)
    assert found(docs) == sorted(brute(texts))
    assert found(docs.limit(0)) == []
    assert found(docs, longest=3, frequent=2, top=50) == sorted(brute(texts, 3, 2, 50))


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").coalesce(2)
    part = sorted(map(tuple, collocations._pass(docs, 1, None).groupBy("lang", "phrase").agg(F.sum("f")).collect()), key=str)
    # one text in blocks, words forgotten in between
    text = " ".join(f"w{i % 7} x{i % 11}" + "." * (i % 13 == 0) for i in range(4000))
    counts = collocations._Counts("en", 3, collocations.Bitmap(10, __import__("numpy").full(16, 2**64 - 1, "uint64")))
    monkeypatch.setattr(collocations, "blocks", lambda t: (t[i : t.find(b" ", i + 99) if t.find(b" ", i + 99) > 0 else len(t)] for i in cuts(t)))
    monkeypatch.setattr(collocations, "PHRASES_HELD", 50)

    def cuts(t):
        i = 0
        while i < len(t):
            yield i
            i = t.find(b" ", i + 99) if t.find(b" ", i + 99) > 0 else len(t)

    got = Counter()
    for batch in [*counts.add(text.encode().translate(collocations.TABLE)), *counts.out()]:
        for p, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got[p] += n
    want = Counter()
    for piece in text.split("."):
        ws = piece.split()
        want.update(" ".join(ws[i : i + 3]) for i in range(len(ws) - 2))
    assert got == want
    assert part


def test_partial_lists_of_the_best(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), (F.col("id") * 7919 % 101).alias("score"), (F.col("id") % 5 + 30).alias("a"), F.col("id").cast("string").alias("phrase"), F.lit(1).alias("l"), F.lit(2).alias("r"))
    got = {r.lang: [(-x.s, -x.b, x.phrase) for x in r.x] for r in collocations._best(rows, 50).collect()}
    for lang in ("de", "en"):
        want = sorted(((-r.score, -r.a, r.phrase) for r in rows.where(F.col("lang") == lang).collect()))[:50]
        assert got[lang] == [(-s, -a, p) for s, a, p in want]
