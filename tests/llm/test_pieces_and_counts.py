import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from corpusloom.llm import counts, pieces
from corpusloom.llm.common import table

ODD = ["", None, "  lead  and   many    spaces  ", "x" * 3000, "日本語 テスト 😀😀 ñandú\n\ttab", "." * 300 + " end", "the " * 20, " ", "a▁b", "<s> <0x41> </s>", "\x00\x7f"]


def texts(spark):
    return [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()] + ODD


def test_rate_0_is_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coder = pieces.Coder(pieces.read_model())
    some = [t for t in texts(spark) if not t or "▁" not in t]
    got = coder.encode(some, [1] * len(some), 0.0)
    assert [x.tolist() for x in got] == [sp.encode(t) if t else [] for t in some]


def test_dropout_is_lossless_repeatable_and_varied(spark):
    coder = pieces.Coder(pieces.read_model())
    some = texts(spark)
    a, b, c = (coder.encode(some, [pieces.key_of(i, seed) for i in range(len(some))], 0.1) for seed in (1, 1, 2))
    assert [coder.decode(x) for x in a] == [t or "" for t in some]
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert sum(len(x) != len(y) or (x != y).any() for x, y in zip(a, c, strict=True)) > len(some) * 0.8
    # a plain agenda makes the same merges
    for t, key, want in zip(some[::9], [pieces.key_of(i, 1) for i in range(len(some))][::9], a[::9], strict=True):
        units = coder._units(t)
        own = pieces.mixed(np.arange(len(units), dtype=np.uint64) + np.uint64(key), 9).tolist()
        assert [i for u, k in zip(units, own, strict=True) for i in plain(coder, u, k, 0.1)] == want.tolist()


def plain(coder, unit, key, rate):
    """One word: again and again the best of all candidates that are not dropped, the leftmost of equal ones."""
    parts = [(i, i + 1, int(coder.table[ord(c)])) for i, c in enumerate(unit)]
    while True:
        best = None
        for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)):
            piece = coder.merge.get(x[2] * coder.width + y[2]) if x[2] >= 0 and y[2] >= 0 else None
            if piece is not None and (best is None or coder.rank[piece] < best[0]):
                place = np.array([(x[0] << 42) ^ (y[1] << 20) ^ piece], np.uint64)
                if not rate or int(pieces.mixed(np.uint64(key) ^ pieces.mixed(place, 7), 8)[0]) >> 11 >= int(rate * 2**53):
                    best = (coder.rank[piece], i, piece)
        if best is None:
            return [j for a, _, s in parts for j in ([s] if 0 <= s < len(coder.raw) else coder._bytes(unit[a]))]
        i = best[1]
        parts[i : i + 2] = [(parts[i][0], parts[i + 1][1], best[2])]


def test_long_words_are_merged_as_short_ones(spark, monkeypatch):
    coder = pieces.Coder(pieces.read_model())
    words = ["".join(r.text.split())[:700] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(12).collect()] + ["x" * 900, "ab" * 300, "日本語😀" * 50, "." * 200, "a\ud7ffb" * 40]
    for rate in (0.0, 0.1, 0.5):
        keys = pieces.mixed(np.arange(len(words), dtype=np.uint64), 3)
        for rounds in (400, 3):  # the heap takes over early
            monkeypatch.setattr(pieces, "ROUNDS", rounds)
            pool, first, count = coder.long(words, keys, rate)
            for w, k, a, n in zip(words[:: 1 if rounds == 400 else 3], keys[:: 1 if rounds == 400 else 3].tolist(), first[:: 1 if rounds == 400 else 3], count[:: 1 if rounds == 400 else 3], strict=True):
                assert pool[a : a + n].tolist() == plain(coder, w, k, rate)


def test_one_long_word_leaves_the_others_as_they_are():
    coder = pieces.Coder(pieces.read_model())
    text = "some words and some more words"
    (alone,), (beside,) = coder.encode([text], [3], 0.3), coder.encode([text + " " + "y" * 500], [3], 0.3)
    assert beside[: len(alone)].tolist() == alone.tolist()


def test_line_ends_part_words_as_spaces_do():
    coder = pieces.Coder(pieces.read_model())
    text = "\n".join(["several", "words", "without", "spaces"] * 2000)
    assert max(map(len, coder._units(text))) < 20
    (ids,) = coder.encode([text], [1], 0.1)
    assert coder.decode(ids) == text


def test_each_occurrence_and_each_copy_is_segmented_in_its_own_way(spark):
    coder = pieces.Coder(pieces.read_model())
    (ids,) = coder.encode(["internationalization " * 200], [5], 0.3)
    lengths = {len(x) for x in coder.encode(["internationalization"] * 50, list(range(50)), 0.3)}
    assert len(lengths) > 1 and len(ids) % 200  # equal segmentations would make a multiple
    docs = spark.createDataFrame([(7, "some words that are segmented " * 5)] * 6 + [(8, "some others")], "doc_id long, text string")
    sets = [{(r.doc_id, tuple(r.pieces)) for r in pieces.encoded(docs.repartition(n), rate=0.3).collect()} for n in (1, 7)]
    assert sets[0] == sets[1] and len(sets[0]) == 2  # no layout of the rows changes the pieces
    copies = docs.where("doc_id = 7").withColumn("copy", F.monotonically_increasing_id())
    assert len({tuple(r.pieces) for r in pieces.encoded(copies, rate=0.3, copy="copy").collect()}) == 6
    assert {r.text for r in pieces.decoded(pieces.encoded(copies, rate=0.3, copy="copy")).collect()} == {docs.first().text}


def test_operators(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)] + [(None, "one two", "n"), (3, "x" * 3000, "n")], "doc_id long, text string, pieces string")
    assert all(r.lossless for r in pieces.round_trips(docs).collect())
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_counts_are_the_librarys(spark):
    model = pieces.read_model()
    vocabulary = [p for p in model["pieces"] if p]
    least = min(s for _, s in vocabulary)
    names = {i: f"<0x{b:02X}>" for b, i in enumerate(model["bytes"])}
    full = [p or (names.get(i, f"<special{i}>"), least) for i, p in enumerate(model["pieces"])]
    library = Tokenizer(models.Unigram(full, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=pieces.SPACE, prepend_scheme="always", split=True)
    some = [t for t in texts(spark) if t and "<" not in t]
    counter = counts.Counter(vocabulary)
    assert [counter.text(t) for t in some] == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_ties_go_to_the_earlier_start():
    counter = counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0)])
    assert counter.word("ab") == 1  # one piece of -2 before two of -1
    assert counter.word("abc") == 1
    assert counter.word("xab") == 2  # x is unknown: one byte
    assert counter.word("é") == 2


def test_count_operator(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "one two", 0), (3, "one two", 0), (None, "x" * 50_000, 0)], "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_chars, r.n_tokens > 0) for r in counts.token_counts(docs).collect())
    assert got == [("1", 0, False), ("2", 0, False), ("3", 7, True), ("3", 7, True), ("None", 50_000, True)]
    assert counts.token_counts(docs.limit(0)).count() == 0
