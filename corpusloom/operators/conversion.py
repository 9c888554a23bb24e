"""Conversion of a captured site, as far as it is data: which files are pages, the page of each route, names, and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import classify as C
from corpusloom.functions import tree
from corpusloom.functions import url as U
from corpusloom.operators.naming import unique_names

# Folders of a capture that hold no pages of the site.
APART = ("hts-cache/", "__embeds/")
INDEX = r"(?i)(^|/)index\.html?$"
PAGE, OTHER, DOCUMENT, ERROR = "page", "alternative", "no-page", "error-page"


def _page_facts(files: DataFrame, site: Column) -> DataFrame:
    """id, path, route, real, error, title, heading, lang: each file is read once, and its text goes no further."""
    nodes, text = F.col("page.nodes"), F.col("page.text")
    first = lambda tag: F.get(tree.named(nodes, tag), F.lit(0))
    rel = lambda n: F.array_contains(F.split(F.coalesce(tree.attribute(n, "rel"), F.lit("")), r"\s+"), "canonical")
    canonical = tree.attribute(F.try_element_at(F.filter(tree.named(nodes, "link"), rel), F.lit(-1)), "href")
    rows = files.select("id", "path", site.alias("site"), (C.content_class(F.col("html"), extension=U.extension(F.col("path"))) == "html").alias("real"), tree.parsed(F.col("html")).alias("page"))
    rows = rows.select(
        "id", "path", "real", U.route_of_file(F.col("path")).alias("route"), F.nullif(canonical, F.lit("")).alias("canonical"), "site",
        F.trim(F.coalesce(tree.text_of(text, first("title")), F.lit(""))).alias("title"), F.trim(F.coalesce(tree.text_of(text, first("h1")), F.lit(""))).alias("h1"),
        tree.attribute(first("html"), "lang").alias("lang"), tree.attribute(first("body"), "class").alias("body_class"), tree.text_of(text, first("body")).alias("body"),
    )
    remote = U.is_remote(F.col("canonical"))
    own = F.when(remote, U.path(F.col("canonical"))).otherwise(F.concat(F.lit("/"), F.regexp_replace(U.without_query(F.col("canonical")), "^/+", "")))
    same = ~remote | (U.host(F.col("canonical")) == F.col("site"))
    error = C.error_page(F.col("route"), own, same, F.col("title"), F.col("body_class"), F.col("body"))
    return rows.select("id", "path", "route", F.coalesce("real", F.lit(False)).alias("real"), F.coalesce(error, F.lit(False)).alias("error"), "title", F.coalesce(F.nullif("h1", F.lit("")), "title").alias("heading"), "lang")


def converted(files: DataFrame, site: Column | None = None) -> DataFrame:
    """id, path, outcome, route, selected, name, title, heading, lang of each captured page file (id, path, html).

    outcome: page (the one of its route), alternative (another of the route; selected is the path of the one), no-page
    (other content in a page's name) or error-page. Of a route's candidates an index file counts, then the first path,
    then the least id. Pages are named by their routes, in the order of their paths, and no two alike; heading is the
    first h1, else the title. site: the host that canonical links must name. Files below folders that hold no pages, and
    those without a path, are passed over; a null text is no page.
    """
    given = files.where(F.col("path").rlike(r"(?i)\.html?$"))
    for folder in APART:
        given = given.where(~F.startswith("path", F.lit(folder)))
    facts = _page_facts(given, F.lit("") if site is None else site)
    sort = F.struct((~F.col("path").rlike(INDEX)).alias("other"), "path", "id")
    good = F.col("real") & ~F.col("error")
    best = facts.where(good).groupBy("route").agg(F.min(sort).alias("best")).select("route", F.col("best.path").alias("selected"), F.col("best.id").alias("chosen"))
    named = unique_names(best.withColumn("base", U.component_name(F.col("route"))), "base", "selected").select("route", "selected", "chosen", F.col("unique").alias("name"))
    rows = facts.join(named, "route", "left")
    outcome = F.when(~F.col("real"), DOCUMENT).when(F.col("error"), ERROR).when(F.col("id") == F.col("chosen"), PAGE).otherwise(OTHER)
    only = lambda c, *which: F.when(F.col("outcome").isin(*which), F.col(c)).alias(c)
    return rows.withColumn("outcome", outcome).select("id", "path", "outcome", "route", only("selected", PAGE, OTHER), only("name", PAGE), only("title", PAGE, ERROR), only("heading", PAGE), only("lang", PAGE))


def manifest(rows: DataFrame) -> DataFrame:
    """pages, alternatives, ignored, errors, duplicated_routes, passed of converted rows: one row; a site without a page does not pass."""
    count = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).cast("long")
    per = rows.groupBy("route", "outcome").agg(F.count("*").alias("n"))
    out = per.agg(count(PAGE).alias("pages"), count(OTHER).alias("alternatives"), count(DOCUMENT).alias("ignored"), count(ERROR).alias("errors"), F.count_if(F.col("outcome") == OTHER).alias("duplicated_routes"))
    return out.withColumn("passed", F.col("pages") > 0)
