import math

import numpy as np

from corpusloom.llm import forest


def vectors(n=3000, dim=32):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim))
    for i in range(0, 600, 2):
        x[i + 1] = x[i] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3, 0.5])
    x[700:900] = x[700] + rng.standard_normal((200, dim)) * 0.15
    x[1000:1040] = x[1000]
    return x.astype(np.float32)


def brute(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        p, q = root(i), root(j)
        parent[max(p, q)] = min(p, q)
    return near.sum(1), [root(i) for i in range(len(x))]


def test_recall_and_no_false_links(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 150)  # leaves in several blocks
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, m int")
    got = {r.vec_id: r for r in forest.near_duplicates(df).collect()}
    links, label = brute(x)
    assert sum(r.n_links for r in got.values()) >= 0.98 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(x)))
    assert sum(got[i].component_id == label[i] for i in range(len(x))) >= 0.98 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in forest.near_duplicates(df).collect())
    assert got == [(0, 0, 0, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (9, 0, 9, True)]
    assert forest.near_duplicates(df.limit(0)).count() == 0
    assert forest.near_duplicates(df.where("vec_id < 4")).count() == 3


def test_leaves_are_split_on_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 100)
    monkeypatch.setattr(forest, "SAMPLE", 60)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in forest.near_duplicates(df).collect()}
    links, label = brute(x)
    assert links.sum() >= sum(r.n_links for r in got.values()) >= 0.98 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(x)))
    assert sum(got[i].component_id == label[i] for i in range(len(x))) >= 0.98 * len(x)


def test_doubles_tiny_huge_and_string_ids(spark):
    rows = [("a", [1e60, 1e60]), ("b", [1e-60, 1e-60]), ("c", [1.0, 1.0]), ("d", [5e-324, 5e-324]), ("e", [1.0, -1.0]), ("f", [1e308, 1e308]), ("g", [1.0, 1.0 + 1e-12])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {k: (5, "a") for k in "abcdfg"} | {"e": (0, "e")}


def test_tiny_vectors_do_not_spoil_the_planes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 8))
    x[:10] *= 1e-30
    tree = forest.fitted(x.astype(np.float32), len(x), trees=1)[0]
    assert tree.leaves > 8
