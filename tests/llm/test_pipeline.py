import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import pieces, toxicity
from corpusloom.llm.common import table
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "pii", "mixing", "sentencepiece"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert out.columns == table(spark, SF, "documents").columns
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    clean = {r.doc_id for r in table(spark, SF, "documents").collect() if labels.get(r.doc_id) == 0}
    left = {r.doc_id for r in kept["toxicity"].collect()}
    assert len(clean - left) <= 0.03 * len(clean)
    assert kept["jaccard"].count() < kept["toxicity"].count()
    assert "[EMAIL]" in " ".join(r.text for r in kept["pii"].collect())
    # the last stage decodes to the texts of the one before
    text = {r.doc_id: r.text for r in kept["mixing"].collect()}
    assert all(r.text == text[r.doc_id] for r in pieces.decoded(kept["sentencepiece"]).collect())
    run = corpus_pipeline.run(spark, SF)
    digest = lambda df: sorted((r.doc_id, hashlib.md5(str(r.pieces).encode()).hexdigest()) for r in df.collect())
    assert digest(run) == digest(kept["sentencepiece"])


def test_filters_agree_with_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SF)
    lexicon = toxicity.fit_on(docs, table(spark, SF, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, t in texts.items() if lexicon.score(t) < 0.5}
    left = {r.doc_id for r in stages["jaccard"](spark, docs, SF).collect()}
    assert left == {d for d, (_, c) in brute(texts.items()).items() if c == d}


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, g long, row string, _mix_id int"
ODD = [
    (1, "mail a.b@c.example now and then", "en", "s", 31, 1, "x", 1),
    (1, "mail a.b@c.example now and then", "en", "s", 31, 1, "x", 1),
    (2, "mail a.b@c.example now and then", None, None, None, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "s", 0, 2, "y", 2),
    (None, "no id, some words", "en", None, 17, 3, "z", 3),
    (None, None, None, None, None, None, None, None),
    (5, "long word " * 30_000, "en", "t", 300_000, 4, "w", 4),
    (6, "you idiot, you stupid worthless scum", "en", "t", 36, 5, "v", 5),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(6, 0, 1), (1, 1, 0), (None, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name == "toxicity" and rows:
            assert out.count() == len(rows) - 1 and not out.where("doc_id = 6").count()
        if name == "jaccard" and rows:
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "5", "6", "None", "None"]
        if name == "pii" and rows:
            assert out.where("doc_id = 1").first().text == "mail [EMAIL] now and then" and out.where("doc_id = 3").first().text is None
        if name == "mixing" and rows:
            assert out.groupBy(F.coalesce("doc_id", F.lit(-1)), "text").count().agg(F.max("count")).first()[0] <= 4
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_pieces", "pieces"]
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == bool(rows)
