"""Pages as trees: their heads, the text of subtrees, what lies inside what, links within the site. A page is parsed once and its text moves nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import tree
from corpusloom.functions import url as U

#: References that lead to no other page.
APART = r"(?i)^(?:mailto:|tel:|javascript:|data:|blob:|#)"
REMOTE = r"^(?i:https?:)?//"


def _parsed(pages: DataFrame, *more: str) -> DataFrame:
    return pages.select("page_id", *more, tree.parsed(F.col("html")).alias("page"))


def elements(pages: DataFrame) -> DataFrame:
    """page_id, place, until, depth, tag, attributes, start, length: a row for each element."""
    return _parsed(pages).select("page_id", F.explode("page.nodes").alias("n")).select("page_id", "n.*")


def subtree_texts(pages: DataFrame, *tags: str) -> DataFrame:
    """page_id, tag, nth (from 1, of its tag in the page), text of each element of these tags, what is inside it included."""
    of = [F.transform(tree.named(F.col("page.nodes"), t), lambda n, i: F.struct(n["tag"].alias("tag"), (i + 1).cast("int").alias("nth"), tree.text_of(F.col("page.text"), n).alias("text"))) for t in tags]
    return _parsed(pages).select("page_id", F.explode(F.concat(*of)).alias("e")).select("page_id", "e.*")


def heads(pages: DataFrame) -> DataFrame:
    """page_id, title, heading (the first h1, wherever it stands), lang, dir, viewport (the last one named); null where a page has none."""
    nodes, text = F.col("page.nodes"), F.col("page.text")
    first = lambda tag: F.get(tree.named(nodes, tag), F.lit(0))
    views = F.filter(tree.named(nodes, "meta"), lambda n: F.lower(tree.attribute(n, "name")) == "viewport")
    return _parsed(pages).select(
        "page_id",
        tree.text_of(text, first("title")).alias("title"),
        tree.text_of(text, first("h1")).alias("heading"),
        tree.attribute(first("html"), "lang").alias("lang"),
        tree.attribute(first("html"), "dir").alias("dir"),
        tree.attribute(F.try_element_at(views, F.lit(-1)), "content").alias("viewport"),
    )


def inside(nodes: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """page_id, outer, outer_tag, place, tag: each pair of an element and one inside it, by a join on the page and the interval.

    outer and inner are conditions on the rows of elements().
    """
    a = nodes.where(outer).select("page_id", F.col("place").alias("outer"), "until", F.col("tag").alias("outer_tag"))
    b = nodes.where(inner).select(F.col("page_id").alias("page"), "place", "tag")
    return a.join(b, F.expr("page_id = page AND place > outer AND place <= until")).select("page_id", "outer", "outer_tag", "place", "tag")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, place, href of the anchors that lead on within a site: no download, no target, neither remote nor of another scheme."""

    def leads(n: Column) -> Column:
        href = F.coalesce(tree.attribute(n, "href"), F.lit(""))
        return (href != "") & ~href.rlike(APART) & ~href.rlike(REMOTE) & tree.attribute(n, "download").isNull() & (F.coalesce(tree.attribute(n, "target"), F.lit("")) == "")

    found = F.filter(tree.named(F.col("page.nodes"), "a"), leads)
    return _parsed(pages, "url").select("page_id", "url", F.explode(found).alias("n")).select("page_id", "url", "n.place", tree.attribute(F.col("n"), "href").alias("href"))


def query_map(href: Column) -> Column:
    """The query of a reference as a map; of keys that repeat the last counts, a plus is a space."""
    raw = F.regexp_extract(F.split(href, "#")[0], r"\?(.*)$", 1)
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("key"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def routed_links(pages: DataFrame, routes: DataFrame) -> DataFrame:
    """page_id, place, route, search (map), hash of the anchors whose file, resolved beside their page, has a route. routes: file, route."""
    page = F.regexp_replace(U.path(F.col("url")), "^/", "")
    named = page_links(pages).withColumn("file", U.resolved(F.col("href"), page, F.lit("")))
    return named.join(routes.select("file", "route"), "file").select("page_id", "place", "route", query_map(F.col("href")).alias("search"), F.regexp_extract("href", "#(.*)$", 1).alias("hash"))
