"""Mixing sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, its source's target by its source's size. The whole part is taken as
it is; the fractional parts are rounded against each other so that a source's words keep their sum: two documents swap
words (chances times sizes) in a direction drawn by a keyed hash until one chance is 0 or 1. Documents are paired
within buckets of bounded size, each bucket leaves at most one undecided document, and those are bucketed again, level
by level, until one is left for each source. That one goes to the nearer side, and at most one document of its bucket
changes sides with it where that brings the source's words nearer to the target. Only ids and sizes move, never texts.

Defined cases: a null text has size 0; a document without words has the chance of its source, drawn alone (it moves no
words); a null source is a source of its own, the last one; rows that repeat are told apart by a running number and
rounded one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, fresh, text_of, written

#: Weights by a source's place in code-point order, repeating; the share of all words to take; copies at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of a bucket, about; the bucket's rows are folded in one expression.
BUCKET = 96


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the number of words."""
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target for each source: the share of all words by weight, none above `most` times its size.

    What sources over their limit leave is reshared by weight until none is above: the level at which the limits and
    level times weight sum to the share. One row per source reaches the sorts here, after summing.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    full = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # With the sources before this one at their limits: the level that gives the rest their share.
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(full), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    by = by.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(whole)
    return by.withColumn("least", first).select("source", "source_size", F.least("limit", F.coalesce(F.col("least.level") * F.col("weight"), F.col("limit"))).alias("target"))


def _draw(seed: int, *of: Column) -> Column:
    """A number from 0 up to 1 for each key."""
    return F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _pair(state: Column, x: Column, seed: Column) -> Column:
    """Let the undecided document and the next one swap words until one is decided."""
    a = state["left"]
    fill = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])  # words from a to x at most
    drain = F.least(x["p"] * x["size"], (1 - a["p"]) * a["size"])  # words from x to a at most
    u = F.shiftrightunsigned(F.xxhash64(a["doc_id"], a["nth"], x["doc_id"], x["nth"], seed), 11) / F.lit(float(1 << 53))
    forth = u * (fill + drain) < drain
    # Who ends: forth, a at 0 or x at 1; back, x at 0 or a at 1.
    a_ends = F.when(forth, a["p"] * a["size"] <= (1 - x["p"]) * x["size"]).otherwise((1 - a["p"]) * a["size"] <= x["p"] * x["size"])
    pa = F.when(forth, a["p"] - fill / a["size"]).otherwise(a["p"] + drain / a["size"])
    px = F.when(forth, x["p"] + fill / x["size"]).otherwise(x["p"] - drain / x["size"])

    def item(of: Column, p: Column) -> Column:
        return F.struct(of["doc_id"].alias("doc_id"), of["nth"].alias("nth"), of["size"].alias("size"), p.alias("p"))

    ended = F.when(a_ends, item(a, F.when(forth, 0.0).otherwise(1.0))).otherwise(item(x, F.when(forth, 1.0).otherwise(0.0)))
    kept = F.when(a_ends, item(x, F.least(F.greatest(px, F.lit(0.0)), F.lit(1.0)))).otherwise(item(a, F.least(F.greatest(pa, F.lit(0.0)), F.lit(1.0))))
    return F.when(a.isNull(), F.struct(x.alias("left"), state["done"].alias("done"))).otherwise(F.struct(kept.alias("left"), F.array_append(state["done"], ended).alias("done")))


def _settled(folded: DataFrame, kind: str) -> DataFrame:
    """Decide what the last bucket of a source leaves: the choice, and at most one other change, that errs by fewest words."""

    def options(x: float) -> list[Column]:
        error = (F.lit(x) - F.col("left.p")) * F.col("left.size")
        alone = F.array(F.struct(F.abs(error).alias("e"), F.lit(x).alias("x"), F.lit(-1).alias("j")))
        return [alone, F.transform("done", lambda d, j: F.struct(F.abs(error + (1 - 2 * d["p"]) * d["size"]).alias("e"), F.lit(x).alias("x"), j.alias("j")))]

    best = F.array_min(F.concat(*options(0.0), *options(1.0)))
    chosen = folded.withColumn("best", F.when(F.col("left").isNotNull(), best))
    turned = F.transform("done", lambda d, j: F.struct(d["doc_id"], d["nth"], d["size"], F.when(j == F.col("best.j"), 1 - d["p"]).otherwise(d["p"]).alias("p")))
    last = F.struct(F.col("left.doc_id"), F.col("left.nth"), F.col("left.size"), F.col("best.x").alias("p"))
    done = F.when(F.col("left").isNull(), F.col("done")).otherwise(F.array_append(turned.cast(f"array<{kind}>"), last.cast(kind)))
    return chosen.select("source", F.lit(None).cast(kind).alias("left"), done.alias("done"))


def rounded(units: DataFrame, seed: int) -> DataFrame:
    """source, doc_id, nth, size, up (0 or 1) for units source, doc_id, nth, size > 0, 0 < p < 1.

    One level folds buckets of about BUCKET units; what they leave goes to the next. The number of levels follows from
    the count of the largest source: the logarithm to the base BUCKET.
    """
    kind = f"struct<doc_id:{units.schema['doc_id'].dataType.simpleString()},nth:int,size:bigint,p:double>"
    decided = []
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while most > 1:
        buckets = max(1, -(-most // BUCKET))
        bucket = F.pmod(F.xxhash64("doc_id", "nth", F.lit(seed + level)), F.lit(buckets))
        one = F.struct("doc_id", "nth", "size", "p").cast(kind)
        folded = (
            units.withColumn("bucket", bucket)
            .groupBy("source", "bucket")
            .agg(F.collect_list(one).alias("all"))
            .select(
                "source",
                F.aggregate(
                    # the longest first, so that what is left over is short as far as possible
                    F.array_sort("all", lambda a, b: F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1)).when(a["doc_id"] != b["doc_id"], F.when(a["doc_id"] < b["doc_id"], -1).otherwise(1)).otherwise(F.when(a["nth"] < b["nth"], -1).when(a["nth"] > b["nth"], 1).otherwise(0))),
                    F.struct(F.lit(None).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done")),
                    lambda state, x: _pair(state, x, F.lit(seed)),
                ).alias("r"),
            )
        )
        folded = folded.select("source", "r.left", "r.done")
        if buckets == 1:
            folded = _settled(folded, kind)
        folded = written(folded, f"mixing-{level}")
        decided.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        units = folded.where("left is not null").select("source", "left.*")
        # A unit may come out whole; it is decided then.
        decided.append(units.where("p <= 0 or p >= 1"))
        units = units.where("p > 0 and p < 1")
        fewer = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        most, level = fewer, level + 1
    if most:  # every source had one at most from the start
        decided.append(units)
    out = None
    for part in decided:
        part = part.select("source", "doc_id", "nth", "size", (F.col("p") >= 0.5).cast("int").alias("up"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else units.select("source", "doc_id", "nth", "size", F.lit(0).alias("up"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 20240607) -> DataFrame:
    """doc_id, source, size, nth, source_size, target, copies: one row per document; nth tells rows that repeat apart."""
    # Rows of the same id, source and size are counted first, then numbered: no sort of a hot id, no text is moved.
    units = sizes(docs).groupBy("doc_id", "source", "size").count().select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))
    units = written(units, "mixing-units")
    goal = written(targets(units, weights, share, most), "mixing-targets")
    units = units.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    keyed = goal.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "source_size", "target")
    units = units.join(keyed, "key").withColumn("share", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(1.0)))
    units = units.withColumn("whole", F.floor("share")).withColumn("p", F.col("share") - F.col("whole"))
    open_ = units.where("size > 0 and p > 0").select("key", "doc_id", "nth", "size", "p")
    up = rounded(open_.withColumnRenamed("key", "source"), seed).select(F.col("source").alias("key"), "doc_id", "nth", "size", "up")
    rest = units.where("not (size > 0 and p > 0)").withColumn("up", (_draw(seed, F.col("doc_id"), F.col("nth")) < F.col("p")).cast("int"))
    # null ids join too
    both = units.where("size > 0 and p > 0").alias("u").join(up.alias("r"), (F.col("u.key") == F.col("r.key")) & F.col("u.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("u.nth") == F.col("r.nth")) & (F.col("u.size") == F.col("r.size")))
    names = ["doc_id", "source", "size", "nth", "source_size", "target", "whole"]
    both = both.select(*[F.col(f"u.{c}").alias(c) for c in names], F.col("r.up").alias("up"))
    return both.unionByName(rest.select(*names, "up")).select("doc_id", "source", "size", "nth", "source_size", "target", F.least(F.col("whole") + F.col("up"), F.lit(most)).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 20240607) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    found = copies(docs, seed=seed)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 20240607) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Whole rows move once, to meet their numbers of copies."""

    own = fresh(docs, "_mix_id", "_mix_null", "_mix_key", "_mix_size", "_mix_copies", "_mix_nth", "_mix_times", "_mix_copy")
    on, (all_, nth, times, copy) = own[:4], own[4:]

    def keys(df: DataFrame, size: Column) -> DataFrame:
        kind = df.schema["doc_id"].dataType
        of = (F.coalesce(F.col("doc_id"), F.lit(0).cast(kind)), F.col("doc_id").isNull(), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")), size)
        return df.withColumns(dict(zip(on, of, strict=True)))

    found = keys(copies(docs, seed=seed), F.col("size")).groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("nth", F.col("copies").cast("int").alias("copies")))).alias(all_))
    rows = keys(docs, F.regexp_count(text_of(), F.lit(WORD)).cast("long")).join(found, on)
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64(text_of())))).withColumn(times, F.element_at(all_, F.col(nth))["copies"])
    return rows.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
