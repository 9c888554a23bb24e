"""Local-asset closure: what captured files name, which of it is there, and the gate over what is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import script as S
from corpusloom.functions import url as U
from corpusloom.operators.links import ATTRIBUTE

#: Where a name was found, the later the more it says; names from scripts and hints alone are for diagnosis.
STATIC, STYLE, SINK, HINT = "static", "css-url", "javascript-runtime-sink", "hint"
RANK = {STATIC: 0, STYLE: 1, SINK: 2, HINT: 3}
# What is not local; names below the folders of assets, with or without quotes.
NOT_LOCAL = "(?i)^(?:data:|blob:|https?:|//|#)"
ROOTED = rf"""(?i)(/(?:assets|vendor|legacy|_external)/[^\s"'`)]+\.(?:{"|".join(S.EXTENSIONS)})(?:[?#][^\s"'`)]*)?)"""


def _names(text: Column, path: Column, attributes: bool) -> Column:
    """array of struct(raw, source)."""
    of = lambda p, source: F.transform(p, lambda v: F.struct(v.alias("raw"), F.lit(source).alias("source")))
    all_of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    markup = [of(all_of(S.ASSETS["quoted"]), STATIC), of(all_of(ROOTED), STATIC), of(all_of(S.ASSETS["style"]), STYLE)]
    if attributes:
        markup.append(of(all_of(ATTRIBUTE), STATIC))
    sinks = of(F.transform(S.sinks(text), lambda m: m["raw"]), SINK)
    return F.when(path.rlike(r"(?i)\.[cm]?js$"), sinks).otherwise(F.concat(*markup))


def references(files: DataFrame, extensions: tuple[str, ...] | None = S.EXTENSIONS, attributes: bool = False, root: Column | None = None, hints: DataFrame | None = None) -> DataFrame:
    """from, raw, source, resolved of every local file that files (path, text) or hints (path) name, each once for a file and a name.

    Rooted names, and bare ones outside of styles, lie below `root`, the folder of the file's site ("" for the whole
    tree); others beside the file. extensions: those that count, None for any. Pages of foreign hosts kept below
    _external, names with a template's placeholder, remote names and empty ones are passed over; a name that cannot be
    decoded stands for itself.
    """
    top = F.lit("") if root is None else root
    scanned = files.where(~F.col("path").rlike(r"(?i)^_external/.*\.html?$"))
    named = scanned.select(F.col("path").alias("from"), top.alias("top"), F.explode(_names(F.col("text"), F.col("path"), attributes)).alias("n")).select("from", "top", "n.*")
    if hints is not None:
        named = named.unionByName(hints.select(F.lit("index.html").alias("from"), F.lit("").alias("top"), F.col("path").alias("raw"), F.lit(HINT).alias("source")))
    plain = U.without_query(F.col("raw"))
    named = named.where(~F.col("raw").rlike(NOT_LOCAL)).withColumn("name", F.coalesce(U.decoded(plain), plain)).where("name <> '' and not contains(name, '${')")
    if extensions is not None:
        named = named.where(F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1)).isin(*extensions))
    beside = F.col("name").rlike(r"^\.\.?/") | F.col("from").rlike(r"(?i)\.css$")
    below = F.concat(F.col("top"), F.lit("/"), F.regexp_replace("name", "^/+", ""))
    place = F.when(F.startswith("name", F.lit("/")) | ~beside, below).otherwise(F.concat(F.regexp_replace("from", "[^/]*$", ""), F.col("name")))
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(r)) for s, r in RANK.items()])
    best = F.max_by(F.struct("raw", "source", U.tidy(place).alias("resolved")), F.struct(rank, "raw")).alias("b")
    return named.groupBy("from", "name").agg(best).select("from", "b.*")


def missing(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References without a file, and whether they block: what only a script or a hint names does not."""
    lost = refs.join(files.select(F.col("path").alias("resolved")), "resolved", "left_anti")
    return lost.select("from", "raw", "source", "resolved", (~F.col("source").isin(SINK, HINT)).alias("blocking"))


def gate(refs: DataFrame, files: DataFrame, by: str | None = None, strict: bool = False) -> DataFrame:
    """references, blocking, diagnostic, passed: one row, or one for each value of column `by` of refs; strict: what is for diagnosis blocks, too."""
    there = files.select(F.col("path").alias("resolved"), F.lit(True).alias("there")).distinct()
    rows = refs.join(there, "resolved", "left").withColumn("blocking", F.col("there").isNull() & ~F.col("source").isin(SINK, HINT)).withColumn("diagnostic", F.col("there").isNull() & F.col("source").isin(SINK, HINT))
    bad = F.col("blocking") | F.col("diagnostic") if strict else F.col("blocking")
    out = [F.count("*").alias("references"), F.count_if("blocking").alias("blocking"), F.count_if("diagnostic").alias("diagnostic"), F.coalesce(F.bool_and(~bad), F.lit(True)).alias("passed")]
    return rows.groupBy(by).agg(*out) if by else rows.agg(*out)
