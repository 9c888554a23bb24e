from corpusloom.llm import mixing
from corpusloom.llm.common import table


def filled(sizes):
    """Targets by repeated resharing."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return goal | share
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        open_ -= over
    return goal


def test_targets_takes_and_reruns(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = mixing.copies(docs).collect()
    source = {}
    for r in found:
        source.setdefault(r.source, []).append(r)
    assert len(found) == docs.count()
    want = filled({s: sum(r.size for r in rs) for s, rs in source.items()})
    for s, rs in source.items():
        assert abs(rs[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.copies * r.size for r in rs) - rs[0].target) <= 0.01 * rs[0].target + 60
        assert all(0 <= r.copies <= 2 for r in rs)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.size, r.source_size, r.target, r.copies * r.size, r.copies) for r in found)


def test_chances_are_kept_on_average(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    total = {}
    for seed in range(12):
        for r in mixing.copies(docs, seed=seed).collect():
            total.setdefault(r.source, []).append(r.copies - r.target / r.source_size)
    assert all(abs(sum(v) / len(v)) < 0.15 for v in total.values())


def test_edge_cases(spark):
    rows = [(1, None, "a", 0), (2, "", None, 0), (3, "one two", None, 0), (3, "one two", None, 0), (None, "x y z", "b", 0), (5, "w " * 30_000, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and all(0 <= r.taken <= 2 * r.size for r in got)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id = 3").count() == sum(r.copies for r in got if r.doc_id == 3)
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
