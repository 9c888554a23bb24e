"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits, bias correction.

Each five-word shingle is hashed once; its top byte names one of 256 bins, a bin keeps its least hash. An empty bin
borrows from the first filled one in a random order of its own, so texts that are alike borrow alike. Four low-order
bits of each bin are packed; as unlike bins agree by chance once in 16, likeness is corrected for that. All of it is
row-wise DataFrame expressions; whole texts move once, to stand beside the next document.

Defined cases: null counts as empty; a text without words has the empty fingerprint, alike (1.0) to another such and to
nothing else (0.0); fewer than five words are one shingle; documents stand in the order of doc_id, null first, then of
their texts, and the first follows the last; an only document follows itself; extra columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, text_of

#: Bins, bits kept of each; bins that an empty one tries in its own order before it ranks all filled ones.
BINS, BITS, TRIES = 256, 4, 24
WORDS64 = BINS * BITS // 64
#: Documents of a range of ids, about; ranges at most (their bounds and first ids pass through the driver). Beyond 134
#: million documents ranges grow; one of 100 TB in all is a sort of 1.5 GB, which spills where it must.
RANGE, RANGES = 2048, 65_536


def _orders(seed: int = 97) -> list[tuple[int, int]]:
    """Factor and offset of TRIES hashes modulo the prime 257; hash r of bin i is the r-th bin that i tries."""
    draw = random.Random(seed)
    return [(draw.randrange(1, 257), draw.randrange(257)) for _ in range(TRIES)]


def _fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: the fingerprint of column `text` as an array of WORDS64 longs, empty for a text without words."""
    w, s, b = f"{out}_w", f"{out}_s", f"{out}_b"
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    n = F.size(w)
    # Five words' hash from a pair's, two pairs' and the fifth word's: each a pass over shifted arrays.
    for name, one, two, step, width in ((f"{out}_2", w, w, 1, 2), (f"{out}_4", f"{out}_2", f"{out}_2", 2, 4), (f"{out}_5", f"{out}_4", w, 4, 5)):
        both = F.zip_with(F.slice(one, F.lit(1), n - width + 1), F.slice(two, F.lit(step + 1), n - width + 1), lambda x, y: F.xxhash64(x, y))
        df = df.withColumn(name, F.when(n >= 5, both))
    fives = F.col(f"{out}_5")
    shingles = F.when(n >= 5, fives).when(n > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    # Sorted, each bin is one run that its least hash begins.
    bin_of = lambda h: (F.shiftright(h, 56) + 128).cast("int")
    df = df.withColumn(s, F.sort_array(shingles))
    df = df.withColumn(s, F.filter(s, lambda h, i: (i == 0) | (F.shiftrightunsigned(h.bitwiseXOR(F.get(F.col(s), i - 1)), 56) != 0)))
    low = lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint"))
    none = F.lit(None).cast("bigint")
    run = lambda h, i: F.concat(F.array(h), F.array_repeat(none, F.coalesce(bin_of(F.get(F.col(s), i + 1)), F.lit(BINS)) - bin_of(h) - 1))
    lead = F.array(F.array_repeat(none, F.coalesce(bin_of(F.get(F.col(s), F.lit(0))), F.lit(BINS))))
    df = df.withColumn(b, F.flatten(F.concat(lead, F.transform(s, run))))
    order = _orders()

    def filled(x: Column, i: Column) -> Column:
        ranked = F.array_min(F.transform(s, lambda h: F.struct(F.xxhash64(i, bin_of(h)).alias("h"), h.alias("v"))))["v"]
        lent = F.coalesce(*[F.get(F.col(b), (i * f + o) % 257 % BINS) for f, o in order], ranked)
        # What is borrowed is hashed with the bin's number, or a text of few shingles would repeat a few bits.
        return F.when(x.isNotNull(), low(x)).otherwise(low(F.xxhash64(lent, i)))

    df = df.withColumn(b, F.transform(b, filled))
    per = 64 // BITS
    pack = F.transform(F.sequence(F.lit(0), F.lit(WORDS64 - 1)), lambda k: F.aggregate(F.slice(F.col(b), k * per + 1, per), F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v)))
    # Named twice, the bins are made once and not anew for each long that takes a slice of them.
    return df.withColumn(out, F.when((F.size(w) > 0) & (F.size(b) > 0), pack).otherwise(F.array().cast("array<bigint>"))).drop(w, s, b, f"{out}_2", f"{out}_4", f"{out}_5")


def _hex(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """The estimated Jaccard similarity of two fingerprints: the share of equal bins, less what agrees by chance."""

    def unlike(acc: Column, d: Column) -> Column:
        any_bit = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return acc + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), unlike)
    chance = 2.0**-BITS
    share = (F.lit(float(BINS)) - differing) / BINS
    both = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def _range_of(docs: DataFrame) -> Column:
    """The number of the range of ids that a row is in, from bounds that share the rows out evenly."""
    count = docs.count()
    parts = min(RANGES, math.ceil(count / RANGE)) if count else 1
    bounds: list = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", F.lit(shares), F.lit(20 * parts))).first()[0] or []))
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    given = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda acc, k: acc + F.when(F.get(given, acc + k - 1) <= F.col("doc_id"), k).otherwise(0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text ends in the beginning of the next document instead of its own second half.
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    spot = _range_of(docs)
    key = F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id").alias("id"))
    firsts = sorted((r.spot, r.first.given, r.first.id) for r in docs.groupBy(spot.alias("spot")).agg(F.min(key).alias("first")).collect())
    # After the last of a range comes the first of the next one; after the last range the first.
    after = [(firsts[i - 1][0], *f[1:]) for i, f in enumerate(firsts)]
    shape = f"spot int, given boolean, id {docs.schema['doc_id'].dataType.simpleString()}"
    heads = F.broadcast(docs.sparkSession.createDataFrame(after, shape))
    nexts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("spot").agg(F.min("text").alias("head"))
    nexts = _fingerprint(nexts, "head", "head_fp").withColumnRenamed("spot", "head_spot")

    rows = _fingerprint(docs, "text", "fp").withColumn("spot", spot)
    order = Window.partitionBy("spot").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("last", F.lead(F.lit(1)).over(order).isNull()).withColumn("next", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
    rows = rows.join(nexts, (F.col("spot") == F.col("head_spot")) & F.col("last"), "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", "head"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "fp", F.coalesce("next_fp", "head_fp").alias("next_fp"), edited.alias("edited"))
    rows = _fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        _hex("fp").alias("fingerprint"),
        _hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
