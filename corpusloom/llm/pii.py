"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are the matches of four fixed patterns. The words around a seed make lexical patterns; the same patterns around
tokens of identifier shape make a graph of patterns and instances. Confidence flows over it for a few rounds: a
pattern is as good as the share of its instances that are believed, an instance as its patterns together. Tokens that
good patterns find, and no seed covers, are added spans. Only what was found moves between tasks, never texts.

Spans are code points, the end exclusive. Defined cases: a null or empty text has no spans; rows that repeat a text
get the same spans; ties in a pattern's score are all kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, fresh, text_of, written

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. They differ from its text in form only: starts inside a run that cannot match are skipped
# and repeats give nothing back, so time stays linear and deep recursion is out.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words with a digit or an at sign: what a pattern may discover.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Code points on either side that a context is taken from; hits that are placed at once; what stands for struck characters.
REACH, RUN, STRUCK = 48, 512, "\x01"
FOUND = "array<struct<kind:string,start:bigint,end:bigint,value:string,left:string,right:string>>"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when((n >= 14) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        rest = F.regexp_replace(part, "^0+", "")
        return (F.length(rest) <= 3) & (F.coalesce(rest.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, "[.]"), small)


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _pieces(text: Column, pattern: str) -> Column:
    """What lies before, between and behind the hits."""
    return F.split(text, pattern, -1)


def _located(hits: Column, between: Column, kind: str) -> Column:
    """The hits with their places and surroundings, both told by what lies between hits, so time is linear in the text."""
    n = F.size(hits)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(hits, i))
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    def some(state: Column, first: Column) -> Column:
        # An array is copied for each item that is appended, so few are appended at once.
        own = F.struct(state["at"].alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(first, F.least(first + RUN, n) - 1), own, step, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], s["out"]).alias("out")))

    places = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(RUN)), F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), some, lambda s: s["out"])

    def around(h: Column, i: Column) -> Column:
        at = lambda array, j: F.coalesce(F.when(j >= 0, F.get(array, j)), F.lit(""))
        before = F.concat(at(between, i - 2), at(hits, i - 2), at(between, i - 1), at(hits, i - 1), at(between, i))
        after = F.concat(at(between, i + 1), at(hits, i + 1), at(between, i + 2), at(hits, i + 2), at(between, i + 3))
        # Words that the ends of a context cut are left out.
        left = F.when(F.length(before) > REACH, F.regexp_replace(F.substring(before, -REACH, REACH), f"^{WORD}", "")).otherwise(before)
        right = F.when(F.length(after) > REACH, F.regexp_replace(F.substring(after, 1, REACH), f"{WORD}$", "")).otherwise(after)
        return F.struct(F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), F.get(hits, i).alias("value"), left.alias("left"), right.alias("right"))

    return F.when(n > 0, F.transform(places, around)).otherwise(F.array()).cast(FOUND)


def _hits(text: Column, pattern: str, trigger: Column) -> Column:
    return F.when(trigger, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def seeds(docs: DataFrame, candidates: bool = True) -> DataFrame:
    """doc_id, row (hash of the text) and base: the matches of the four patterns, failing ones dropped; candidates: words that a pattern may discover."""
    text = F.col("_text")
    df = docs.select(F.col("doc_id"), text_of().alias("_text"))
    digit = text.rlike("[0-9]")
    triggers = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.rlike(r"\+[0-9]")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    tests = {
        "email": lambda value: F.lit(True),
        "ip": _octets,
        "card": _luhn,
        "phone": lambda value: _digits(value).between(10, 15),
    }
    if candidates:
        triggers["word"], patterns["word"] = digit | text.contains("@"), CANDIDATE
    df = df.withColumns({f"_h_{k}": _hits(text, patterns[k], triggers[k]) for k in patterns})
    df = df.withColumns({f"_p_{k}": F.when(F.size(f"_h_{k}") > 0, _pieces(text, patterns[k])) for k in patterns})
    df = df.withColumns({f"_s_{k}": _located(F.col(f"_h_{k}"), F.col(f"_p_{k}"), k) for k in patterns})
    df = df.withColumns({f"_s_{k}": F.filter(f"_s_{k}", (lambda test: lambda x: test(x["value"]))(test)) for k, test in tests.items()})
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.transform(F.array_sort(F.transform(F.concat(*[F.col(f"_s_{k}") for k in KINDS]), lambda x: F.struct(x["start"].alias("s"), place[x["kind"]].alias("p"), x.alias("x")))), lambda x: x["x"])
    out = [F.col("doc_id"), F.xxhash64("_text").alias("row"), base.cast(FOUND).alias("base")]
    if candidates:
        # No seed covers a candidate: where seeds' digits and at signs are struck out, the same words in the same order show which do.
        struck = {}
        for k in KINDS:
            hits, between = F.col(f"_h_{k}"), F.col(f"_p_{k}")
            own = lambda x: F.translate(x, STRUCK, "\x02")
            piece = lambda i: F.concat(own(F.get(between, i)), F.when(tests[k](F.get(hits, i)), F.regexp_replace(F.get(hits, i), "[0-9@]", STRUCK)).otherwise(own(F.get(hits, i))))
            whole = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(hits) - 1), piece), ""), own(F.element_at(between, -1)))
            struck[f"_c_{k}"] = F.when((F.size(f"_s_{k}") > 0) & (F.size("_h_word") > 0), F.transform(F.regexp_extract_all(whole, F.lit(CANDIDATE.replace("0-9@", f"0-9@{STRUCK}")), F.lit(0)), lambda w: w.contains(STRUCK)))
        df = df.withColumns(struck)
        # Named twice, an array is made once and not anew for each word.
        covers = lambda c, i: F.coalesce(F.when(F.size(c) > i, F.get(c, i)), F.lit(False))
        word = F.filter("_s_word", lambda w, i: ~F.greatest(*[covers(f"_c_{k}", i) for k in KINDS]))
        out.append(word.cast(FOUND).alias("word"))
    return df.select(*out)


def _words(text: Column) -> Column:
    """Lower-cased words; digits read as 0, marks around a word dropped but for : = #."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[^\p{L}\p{N}:=#]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _contexts(left: Column, right: Column) -> Column:
    """Lexical patterns: the two words before, the word before and the one after."""
    before, after = _words(left), _words(right)
    two = F.when(F.size(before) >= 2, F.concat(F.lit("L:"), F.array_join(F.slice(before, -2, 2), " ")))
    both = F.when((F.size(before) >= 1) & (F.size(after) >= 1), F.concat(F.lit("B:"), F.element_at(before, -1), F.lit(" _ "), F.element_at(after, 1)))
    return F.array_compact(F.array(two, both))


def _shapes(value: Column) -> Column:
    """The kinds that a candidate's form allows."""
    n, other = _digits(value), F.length(F.regexp_replace(value, r"[0-9().\x20+-]", ""))
    return F.array_compact(
        F.array(
            F.when(value.contains("@") & value.rlike(r"[A-Za-z0-9]@|@[A-Za-z0-9]"), F.lit("email")),
            F.when(value.rlike(r"^[0-9]{1,3}(\.[0-9*x]{1,3}){2,3}$"), F.lit("ip")),
            F.when(n.between(12, 19) & (other == 0), F.lit("card")),
            F.when(n.between(7, 15) & (other == 0) & ~value.contains("."), F.lit("phone")),
        )
    )


#: Rounds of scoring; seeds (distinct values) that a pattern needs; what a pattern needs to discover, and a token to be added.
ROUNDS, SUPPORT, GOOD, ENOUGH = 3, 3, 0.7, 0.6


def discovered(found: DataFrame) -> DataFrame:
    """doc_id, row, kind, start, end of the tokens that good patterns find; found: what seeds() gives, already written."""
    seed = found.select(F.explode("base").alias("x")).select(F.explode(_contexts(F.col("x.left"), F.col("x.right"))).alias("pattern"), F.col("x.kind").alias("kind"), F.xxhash64("x.value").alias("value"))
    # Distinct pairs, so a page that repeats counts once; then one row per pattern: nothing grows with a popular pattern.
    seeded = seed.distinct().groupBy("pattern", "kind").agg(F.count("*").alias("n_seed")).where(F.col("n_seed") >= SUPPORT)
    word = found.select("doc_id", "row", F.explode("word").alias("x"))
    # A word without marks around it; without an at sign its longest run of identifier shape, however long the word is.
    trimmed = F.regexp_replace("x.value", r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9@]+$", "")
    runs = F.transform(F.regexp_extract_all("x.value", F.lit(r"[+(]{0,2}[0-9][0-9().*x+-]*[0-9*x]|[+(]{0,2}[0-9]"), F.lit(0)), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))
    word = word.withColumn("v", F.when(F.col("x.value").contains("@"), trimmed).otherwise(F.coalesce(F.array_max(runs)["v"], F.lit("")))).withColumn("shift", F.instr("x.value", F.col("v")) - 1).where("length(v) >= 5")
    word = word.select("doc_id", "row", (F.col("x.start") + F.col("shift")).alias("start"), (F.col("x.start") + F.col("shift") + F.length("v")).alias("end"), F.xxhash64("v").alias("value"), F.explode(_shapes(F.col("v"))).alias("kind"), _contexts(F.col("x.left"), F.col("x.right")).alias("patterns"))
    places = word.select("doc_id", "row", "start", "end", "value", "kind", F.explode("patterns").alias("pattern")).join(seeded, ["pattern", "kind"])
    places = written(places, "pii-places")
    edges = places.select("pattern", "kind", "value", "n_seed").distinct()
    belief = None
    for i in range(ROUNDS):
        linked = edges.withColumn("conf", F.lit(0.0)) if belief is None else edges.join(belief, ["kind", "value"])
        pattern = linked.groupBy("pattern", "kind").agg(((F.max("n_seed") + F.sum("conf")) / (F.max("n_seed") + F.count("*") + 1)).alias("score"))
        belief = edges.join(pattern, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("conf"))
        if i < ROUNDS - 1:
            belief = written(belief, f"pii-belief-{i}")
    good = pattern.where(F.col("score") >= GOOD)
    return places.join(good, ["pattern", "kind"]).join(belief.where(F.col("conf") >= ENOUGH), ["kind", "value"]).select("doc_id", "row", "kind", "start", "end").distinct()


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end. No span stands twice: added ones are distinct and cover no base one."""
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place[x["kind"]].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs."""
    found = written(seeds(docs), "pii-found")
    added = discovered(found).groupBy("doc_id", "row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    both = found.select("doc_id", "row", "base").alias("f").join(added.alias("a"), F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.row") == F.col("a.row")), "left")
    plain = "array<struct<kind:string,start:bigint,end:bigint>>"
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    more = F.coalesce(F.col("added").cast(plain), F.array().cast(plain))
    counts = [F.size(F.array_compact(F.transform("base", lambda x: F.when(x["kind"] == k, 1)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return both.select(F.col("f.doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(_ordered(F.concat(base, more))).alias("spans"), F.size(more).cast("long").alias("n_added"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, each span replaced by its kind in brackets; of spans that overlap the first counts. n_chars follows where there is such a column."""
    found = written(seeds(docs), "pii-found")
    added = discovered(found).groupBy("doc_id", "row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    plain = "array<struct<kind:string,start:bigint,end:bigint>>"
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    touched = found.select("doc_id", "row", base.cast(plain).alias("b")).where("size(b) > 0").groupBy("doc_id", "row").agg(F.first("b").alias("b"))
    spans = touched.alias("t").join(added.alias("a"), F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.row") == F.col("a.row")), "full")
    none = F.array().cast(plain)
    id_, row, spans_ = fresh(docs, "_pii_id", "_pii_row", "_pii_spans")
    spans = spans.select(F.coalesce("t.doc_id", "a.doc_id").alias(id_), F.coalesce("t.row", "a.row").alias(row), _ordered(F.concat(F.coalesce(F.col("b"), none), F.coalesce(F.col("added").cast(plain), none))).alias(spans_))
    text = text_of()

    def step(s: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], piece, F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")))

    clean = F.aggregate(spans_, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    out = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(row)), "left").withColumn("text", F.when(F.col(spans_).isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans_).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
