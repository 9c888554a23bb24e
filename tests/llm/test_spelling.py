import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import spelling
from corpusloom.llm.common import table

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts, least=5, times=5):
    n = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    others = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def found(docs, **options):
    out = spelling.spelling_variants(docs, **options)
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    return sorted(tuple(r) for r in out.collect())


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = found(docs)
    assert got == brute(texts) and len(got) > 500


def test_odd_texts(spark):
    rnd = random.Random(4)
    base = ["aaaaaaa", "receive", "straße", "élèvesx", "aabbccdd", "mississippi"]
    texts = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                j = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:j] + rnd.choice("abés÷ÉZ") + w[j:], w[:j] + w[j + 1 :], w[:j] + rnd.choice("abc") + w[j + 1 :]])
            words.append(w)
        texts.append((rnd.choice([i, None, 7]), rnd.choice([" ", "-", "\n", "日", "Ā"]).join(words)))
    texts += [(1, None), (None, ""), (2, "short word"), *[(9, "same again repeated")] * 30]
    texts += [(i, w) for w, many in (("qchained", 6), ("chained", 40), ("chainex", 300)) for i in range(many)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("own")).withColumn("id", F.lit(1)).repartition(4)
    want = brute(texts)
    assert found(docs) == want and ("qchained", "chained", "chainex") in {r[:3] for r in want} and max(r[4] for r in want) > 5
    assert found(docs, least=2, times=2) == brute(texts, 2, 2)
    assert found(docs.limit(0)) == []


def test_long_words(spark):
    long = "ab" * 20_000
    texts = [(i, w) for w, many in ((long, 30), (long[:-1], 5), (long[:999] + "z" + long[1000:], 5), ("y" * 30_000, 5)) for i in range(many)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r[0]: r for r in found(docs, least=3)}
    assert rows[long[:-1]][1] == rows[long[:999] + "z" + long[1000:]][1] == long
    assert rows[long][4] >= 2 and rows["y" * 30_000][4] <= 1


def test_keys_are_those_of_the_deleted_words():
    words = ["banana", "baana", "aaaaaa", "straße", "x" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([9] * 5), pa.array(words)], names=["id", "n", "word"])
    rows = [r for b in spelling._keys(iter([batch])) for r in b.to_pylist()]
    shorter = sorted({w[:i] + w[i + 1 :] for w in words for i in range(len(w))} | set(words))
    own = {}
    for i in range(0, len(shorter), 2):
        part = pa.RecordBatch.from_arrays([pa.array(range(len(shorter[i : i + 2]))), pa.array([1] * len(shorter[i : i + 2])), pa.array(shorter[i : i + 2])], names=["id", "n", "word"])
        own |= {shorter[i + r["id"]]: (r["k1"], r["k2"]) for b in spelling._keys(iter([part])) for r in b.to_pylist() if r["place"] == -1}
    assert len(set(own.values())) == len(shorter)
    for r in rows:
        w = words[r["id"]]
        key = w if r["place"] < 0 else w[: r["place"]] + w[r["place"] + 1 :]
        assert (r["k1"], r["k2"]) == own[key]
        assert r["once"] == (r["place"] <= 0 or w[r["place"]] != w[r["place"] - 1])
