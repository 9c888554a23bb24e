"""Unique names: rows that would have one name get numbers behind it, as if they were named in turn."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import _kept, numbered

#: Rows that are named in turn at a time; a task takes no more of them at once.
BLOCK = 1 << 18

TURNS = "_stem string, _digits string, _at long, _place long, _index long, _passed long"


def _taken(last: dict[str, int], digits: str) -> bool:
    """Whether the name of a stem and these digits is some row's: of every name all numbers up to its last one are taken, by its own rows or by others."""
    for k in range(len(digits) + 1):
        number = digits[k:]
        if digits[:k] in last and number != "1" and not number.startswith("0") and last[digits[:k]] >= int(number or 1):
            return True
    return False


def _turns(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one stem in turn. Those at place -1 hold the last number of each name; they come back brought up to date."""
    before, asked = rows[rows["_at"] < 0], rows[rows["_at"] >= 0].sort_values("_at")
    last = dict(zip(before["_digits"], map(int, before["_index"]), strict=True))
    given, passed = [], []
    for digits in asked["_digits"]:
        n = start = last.get(digits, 0) + 1
        while _taken(last, digits if n == 1 else f"{digits}{n}"):
            n += 1
        last[digits] = n
        given.append(n)
        passed.append(n - start)
    asked = asked.assign(_index=given, _passed=passed)
    state = pd.DataFrame({"_stem": rows["_stem"].iloc[0], "_digits": list(last), "_at": -1, "_place": -1, "_index": list(last.values()), "_passed": 0})
    return pd.concat([asked, state])[["_stem", "_digits", "_at", "_place", "_index", "_passed"]]


def _in_turn(tried: DataFrame) -> DataFrame:
    """_place, _index, _passed of rows (_stem, _digits, _place, _order), block by block in their order: what a block leaves to the next is one number for each name."""
    rows = numbered(tried, "_order", "_place", name="_at").select("_stem", "_digits", "_at", "_place", F.lit(0).cast("long").alias("_index"), F.lit(0).cast("long").alias("_passed"))
    done, state = [rows.limit(0)], None
    for k in range(-(-rows.count() // BLOCK)):
        block = rows.where(F.expr(f"_at div {BLOCK}") == k)
        out = _kept((block.unionByName(state) if state is not None else block).groupBy("_stem").applyInPandas(_turns, TURNS))
        state = out.where("_at < 0")
        done.append(out.where("_at >= 0"))
    return reduce(DataFrame.unionByName, done).select("_place", "_index", "_passed")


def unique_names(rows: DataFrame, name: str, order: str, limit: int | None = None) -> DataFrame:
    """Add unique: the name where no earlier row (by `order`, without repeats) has taken it, else the name with the least of 2, 3 .. behind it that is free.

    A name that repeats can take others that begin with it and go on in digits: only these are settled in turn, a block
    of rows at a time, each stem (a name without digits at its end) in a task of its own. All other names need no turn.
    With a limit it raises where a row passes over more taken numbers. Null names stay null; columns that begin with an
    underscore are not allowed.
    """
    placed = numbered(rows.withColumn("_base", F.col(name)), "_base", order, name="_place")
    first = placed.groupBy("_base").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    bases = first.where("_base is not null").withColumn("_stem", F.regexp_replace("_base", r"[0-9]+\z", ""))
    shorter = F.transform(F.sequence(F.length("_stem"), F.length("_base") - 1), lambda n: F.substr("_base", F.lit(1), n))
    pairs = bases.where("length(_base) > length(_stem)").select("_base", F.explode(shorter).alias("_short"))
    pairs = pairs.join(first.where("_rows > 1").select(F.col("_base").alias("_short")), "_short")
    clashing = pairs.select("_base").union(pairs.select("_short")).distinct().withColumn("_clashes", F.lit(True))
    first = first.join(clashing, "_base", "left").select(F.col("_base").alias("_key"), "_first", "_clashes")
    placed = placed.join(first, F.col("_base").eqNullSafe(F.col("_key"))).withColumn("_index", F.col("_place") - F.col("_first") + 1)
    placed = _kept(placed.drop("_key", "_first"))
    stem = F.regexp_replace("_base", r"[0-9]+\z", "")
    tried = placed.where("_clashes").select(stem.alias("_stem"), F.substr("_base", F.length(stem) + 1).alias("_digits"), "_place", F.col(order).alias("_order"))
    turns = _in_turn(tried)
    if limit is not None and turns.where(F.col("_passed") > limit).take(1):
        raise RuntimeError(f"a row passes over more than {limit} names that are taken")
    settled = placed.where("_clashes").drop("_index").join(turns.drop("_passed"), "_place")
    label = F.when(F.col("_index") == 1, F.col("_base")).otherwise(F.concat("_base", F.col("_index").cast("string")))
    out = placed.where("_clashes is null").unionByName(settled).withColumn("unique", label)
    return out.select(*rows.columns, "unique")
