"""URLs in styles, rewritten to captured copies: matches become placed rows, rows meet the copies, texts are put together again in the order of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import url as U
from corpusloom.operators.lookups import local_copies

# A URL in a style, and what stays as it is.
STYLE_URL = r"""url\(\s*(["']?)([^"')]+)\1\s*\)"""
STAYS = "(?i)^(data:|blob:|#)"
NOTHING = "url('')"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('url("'), c, F.lit('")'))


def style_urls(styles: DataFrame) -> DataFrame:
    """id, page, source, start, end, raw, target of every URL in styles (id, page, source, text) that may change.

    page: the file that the style belongs to; source: the URL that the style came from, null where it is local.
    target: the URL that the name stands for where it leads out of the tree, else null.
    """
    found = styles.select("id", "page", "source", F.explode(X.placed(F.col("text"), STYLE_URL)).alias("m"))
    rows = found.select("id", "page", "source", F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.value")).alias("end"), F.regexp_extract("m.value", STYLE_URL, 2).alias("raw"))
    raw = F.col("raw")
    return rows.where(~raw.rlike(STAYS)).withColumn("target", F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).when(U.is_remote(raw), raw).when(F.col("source").isNotNull(), U.joined(F.col("source"), raw)))


def decided(urls: DataFrame, copies: DataFrame, site: str, ignored: DataFrame | None = None) -> DataFrame:
    """urls with outcome (local, copied, tracker, external, ignored) and value, what stands in the URL's place.

    copies: key (a URL, whole or up to its path), kept_as, one for each key; ignored: path of pages that are none. Each
    distinct URL meets the copies once, however often styles name it.
    """
    out = urls.select("target").where("target IS NOT NULL").distinct().withColumnRenamed("target", "url")
    kept = local_copies(out, copies, F.regexp_replace("url", r"[?#].*$", "")).select(F.col("url").alias("target"), "kept_as")
    rows = urls.join(kept, "target", "left").withColumn("file", F.coalesce(U.resolved(F.col("raw"), F.col("page"), F.lit(site)), F.col("raw")))
    if ignored is None:
        rows = rows.withColumn("gone", F.lit(False))
    else:
        rows = rows.join(ignored.select(F.col("path").alias("file"), F.lit(True).alias("gone")).distinct(), "file", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    away = F.col("target").isNotNull()
    outcome = F.when(away & F.col("kept_as").isNotNull(), "copied").when(away & U.is_tracker(F.col("target")), "tracker").when(away, "external").when(F.col("gone"), "ignored").otherwise("local")
    value = F.when(F.col("outcome") == "copied", _quoted(U.runtime_url(F.col("kept_as"), site))).when(F.col("outcome") == "local", _quoted(U.runtime_url(F.col("file"), site))).otherwise(F.lit(NOTHING))
    return rows.withColumn("outcome", outcome).withColumn("value", value).select("id", "start", "end", "raw", "target", "outcome", "value")


def rewritten(styles: DataFrame, urls: DataFrame) -> DataFrame:
    """id, text: the styles with the values of decided() in their places; texts move once, to their edits. Ids are distinct; a null text stays null."""
    edits = urls.groupBy("id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")).alias("edits"))
    both = styles.select("id", "text").join(edits, "id", "left")
    return both.select("id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(X.edited(F.col("text"), F.col("edits"))).alias("text"))
