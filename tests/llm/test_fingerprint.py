import hashlib
import math

from corpusloom.llm import fingerprint
from corpusloom.llm.common import table


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "one two"), (10**6 + 3, "one two"), (10**6 + 4, "😀" * 7 + " é"), (10**6 + 5, " \n "), (10**6 + 6, "long " * 20_000)]


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE", 50)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(text)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.selectExpr("*", "'x' as fp", "1 as spot")).collect()}
    assert sorted(got) == ids
    errors = []
    for i, d in enumerate(ids):
        own, after, r = text[d], text[ids[(i + 1) % len(ids)]], got[d]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [r.near_edited - likeness(own, edited), r.near_next - likeness(own, after)]
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.05
    assert abs(sum(errors) / len(errors)) < 0.02
    assert got[10**6 + 2].fingerprint == got[10**6 + 3].fingerprint and got[10**6 + 2].near_next == 1.0
    assert got[10**6].fingerprint == "" and len(got[0].fingerprint) == 256


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    assert fingerprint.fingerprints(one).first().near_next == 1.0
    assert fingerprint.fingerprints(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y"), (1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert fingerprint.fingerprints(odd).count() == 4
