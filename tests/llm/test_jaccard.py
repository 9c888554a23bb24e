import random

import pytest

from corpusloom.llm import components as component_search
from corpusloom.llm import jaccard
from corpusloom.llm.common import table, written
from corpusloom.llm.components import components


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def agree(docs):
    want = brute(docs.select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == want


def test_agrees_with_brute_force(spark):
    agree(table(spark, "/root/testdata/sf0.001", "documents"))


def test_chains_large_groups_and_odd_texts(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):  # near copies, each with its own edits; many pairs of them miss the threshold
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    chain = [word() for _ in range(100)]
    for i in range(12):  # each like the next, the ends unlike
        rows.append((100 + i, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
    shared = " ".join(word() for _ in range(40))
    rows += [(200 + i, shared + " " + " ".join(word() for _ in range(rng.choice([5, 12, 30, 60])))) for i in range(60)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One two"), (404, "one TWO"), (405, "É one"), (406, "é one"), (407, "x" * 100_000), (408, "a a a a a a a a"), (409, "a a a a a")]
    agree(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g", "2 as rep"))


def test_one_of_each(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (4, "z", 3), (4, "z", 3), (9, None, 4), (8, "", 5), (None, "a b c d e f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "8", "9", "None"]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 40])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(99, 99), (None, 1), (70, 71), (70, 71)], "a long, b long")
    got = {r.id: r.component for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(n + 1)} | {70: 70, 71: 70}


def test_one_id_on_two_texts_is_a_class_each(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "P q r s t u v w"), (3, "x y")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 1, 3)]


def test_string_ids_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 50)
    monkeypatch.setattr(jaccard, "OWNERS", 3)
    rng = random.Random(8)
    rows = []
    for i in range(40):
        t = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 90))]
        rows += [(f"d{3 * i}", " ".join(t)), (f"d{3 * i + 1}", " ".join(t[1:])), (f"d{3 * i + 2}", " ".join(t[:-1] + ["end"]))]
    agree(spark.createDataFrame(rows, "doc_id string, text string"))


def test_classes_set_aside_link_with_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    packed = jaccard.packed_sets(docs, 16)
    left = {r.n for r in jaccard.not_apart(packed).collect()}
    total = packed.where("chunk is null and n > 0").select("c1").distinct().count()
    assert 0 < len(left) < total


@pytest.mark.parametrize(("edges", "rounds"), [([(0, i) for i in range(1, 30)] + [(50, 51)], 0), ([(7, i) for i in range(30)], 1), ([], 0)])
def test_stars_are_seen_without_a_round_more(spark, monkeypatch, edges, rounds):
    names = []
    monkeypatch.setattr(component_search, "written", lambda df, name: names.append(name) or written(df, name))
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: min(e) if min(e) == 50 else 0 for e in edges for i in e}
    assert len(names) == 1 + rounds


def test_lists_that_are_done_are_not_paired_once_more(spark, monkeypatch):
    names = []
    monkeypatch.setattr(jaccard, "written", lambda df, name: names.append(name) or written(df, name))
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(40)] + [(90 + i, f"{i} b c d e f g {i}") for i in range(5)]
    agree(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 0 < names.count("jaccard-links") < names.count("jaccard-round")
