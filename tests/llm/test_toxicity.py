import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as T
from corpusloom.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def test_fold_undoes_look_alikes_digits_and_hidden_characters():
    assert T.fold("1d10t").split()[0] == "idiot"
    assert "loser" in T.fold("1oser").split()
    assert "idiot" in T.fold("іdіоt").split()  # Cyrillic letters
    assert "scum" in T.fold("s​c­um").split()
    assert "moron" in T.fold("ｍｏｒｏｎ").split()


def test_exception_phrases_count_nothing():
    lexicon = T.Lexicon({" trash": 4.0, " clown": 4.0})
    assert lexicon.features("put it in the trash can now")[0] == 0
    assert lexicon.features("you are trash")[0] > 0
    assert lexicon.features("a Clown  fish")[0] > 0  # two spaces: not the phrase
    assert lexicon.features("a clown fish")[0] == 0


def test_length_normalises():
    lexicon = T.Lexicon({" bad": 2.0})
    assert lexicon.features("bad word")[1] > lexicon.features("bad word " + "fine " * 500)[1]


def corpus(spark, n=400):
    rng = random.Random(5)
    words = ["ala", "bela", "cora", "dune", "esta", "fola", "gira", "hano", "ilex", "jora"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(words) for _ in range(30)]
        if toxic := i % 5 == 0:
            text[rng.randrange(30)] = "zorble" + rng.choice(["n", "d", "st"])
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_learns_a_stem_and_holds_out(spark):
    docs, labels = corpus(spark)
    found = T.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert held and all(r.predicted == r.toxic for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, T.toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (3, "you idiot", "x"), (3, "you idiot", "x"), (4, "a" * 200_000, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], LABELS)
    got = T.toxicity(docs, none).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score < 0.5 < by[3].score
    assert T.toxicity(docs.limit(0), none).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    found = T.toxicity(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out and toxic is not null")
    right = found.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    caught = found.where("toxic = 1").agg(F.avg("predicted")).first()[0]
    assert right > 0.97
    assert caught > 0.85


@pytest.mark.parametrize("text", ["", None, "   ", "\x00😀".encode("utf-8", "surrogatepass").decode("utf-8", "replace")])
def test_features_of_odd_texts(text):
    assert T.Lexicon({" bad": 1.0}).features(text) == (0.0, 0.0)


def test_intercept_is_right_when_toxic_labels_exceed_the_bound(spark, monkeypatch):
    docs, labels = corpus(spark)
    fits, fit = [], T.fit

    def seen(rows):
        lexicon = fit(rows)
        fits.append((*(rows.where(F.col("toxic") == k).count() for k in (1, 0)), lexicon.coefficients[0]))
        return lexicon

    monkeypatch.setattr(T, "fit", seen)
    got = T.fit_on(docs, labels, 40)
    n, m, intercept = fits[0]
    assert (n, m) == (10, 30)
    train = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    toxic, clean = (train.where(F.col("toxic") == k).count() for k in (1, 0))
    assert toxic > 10 and abs(got.coefficients[0] - intercept - math.log(toxic / n) + math.log(clean / m)) < 1e-9


def test_features_agree_with_a_plain_search():
    rng = random.Random(9)
    lexicon = T.Lexicon({" bad": 2.0, " badly ": 5.0, " worse": 1.5, " trash": 4.0})
    words = ["bad", "badly", "badge", "worse", "trash", "can", "b4d", "fine", "Trash", "sand", "unbad"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
        folded, total = T.fold(text), 0.0
        safe = [range(i, i + len(p) + 1) for p in T.EXCEPTIONS for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        for i in range(len(folded)):
            best = max((w for t, w in lexicon.weights.items() if folded.startswith(t, i)), default=0.0)
            total += best if not any(i in r for r in safe) else 0.0
        want = (math.log1p(total), total / math.sqrt(1 + folded.count(" "))) if text else (0.0, 0.0)
        assert lexicon.features(text) == pytest.approx(want)


def test_a_fixed_term_goes_where_clean_texts_hold_it_more(spark):
    rows = [(f"you are stupid {i}", 1) for i in range(20)] + [(f"the scum of iron {i}", 0) for i in range(20)] + [(f"plain {i}", 0) for i in range(20)]
    weights = T.fit(spark.createDataFrame(rows, "text string, toxic int")).weights
    assert " scum" not in weights and " moron" in weights and any(t.startswith(" stup") for t in weights)


def test_many_exception_phrases_take_linear_time():
    import time

    lexicon = T.Lexicon({" idiot": 2.0, " trash": 1.0}, exceptions=("trash can",))
    alone = lexicon.features("trash can idiot")
    took = []
    for n in (2_000, 40_000):
        began = time.process_time()
        x, _ = lexicon.features("trash can idiot " * n)
        took.append(time.process_time() - began)
        assert abs(math.expm1(x) - n * math.expm1(alone[0])) < 1e-6 * n
    assert took[1] < 100 * max(took[0], 0.005)
