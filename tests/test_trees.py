"""Pages as trees, links of trees, order and provenance of texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import tree
from corpusloom.operators import elements, inventory, ordering, provenance


def parents(html):
    """tag: path of the tags above, from the intervals alone."""
    nodes = tree._tree(html)["nodes"]
    return ["/".join(m["tag"] for m in nodes if m["place"] <= n["place"] <= m["until"]) for n in nodes]


def texts(html, tag):
    t = tree._tree(html)
    return [t["text"][n["start"] : n["start"] + n["length"]] for n in t["nodes"] if n["tag"] == tag]


def test_tags_left_open():
    assert parents("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["ul", "ul/li", "ul/li", "ul/li/ul", "ul/li/ul/li", "ul/li"]
    assert parents("<p>a<b>b<p>c") == ["p", "p/b", "p"]
    assert parents("<p><table><tr><td><p>x<td>y<tr><td>z</table>") == ["p", "table", "table/tr", "table/tr/td", "table/tr/td/p", "table/tr/td", "table/tr", "table/tr/td"]
    assert parents("<div><br/><img><span/>x</div></p><i>") == ["div", "div/br", "div/img", "div/span", "i"]
    assert parents("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>") == ["dl", "dl/dt", "dl/dd", "dl/dt", "select", "select/option", "select/option"]
    assert parents("<head><title>t</title><body>x") == ["head", "head/title", "body"]
    assert parents("") == parents(None) == []


def test_subtrees_have_their_texts():
    page = "<nav>a<a href=x>b &amp; c</a></nav><div>1<h1>T<b>o</b>p</h1><script>if (a<b) '</p>'</script>2"
    assert texts(page, "nav") == ["ab & c"] and texts(page, "a") == ["b & c"] and texts(page, "h1") == ["Top"]
    assert texts(page, "script") == ["if (a<b) '</p>'"] and texts(page, "div") == ["1Topif (a<b) '</p>'2"]
    deep = "<div>" * 3000 + "x"
    assert texts(deep, "div") == ["x"] * 3000


PAGES = [
    (1, "https://s.example/docs/guide.html?v=1", "<html lang=en dir=rtl><head><meta name=Viewport content='a'><meta name=viewport content='width=1'><title>A &lt; B</title></head><body><div><h1>First <i>one</i></h1></div><h1>Second</h1>"
        "<a href='../about.html?tab=team&amp;x=a+b&tab=all#bio'>1</a><a href='/docs/guide.html' download>2</a><a href=/about.html target=_blank>3</a><a href='mailto:x@y'>4</a><a href=//cdn.example/about.html>5</a><a href=#top>6</a><a>7</a><a href='gone.html'>8</a><a href='/about.html' target=''>9</a>"),
    (2, "https://s.example/about.html", "<p>No head</p>"),
    (3, "https://s.example/", None),
]


def test_heads_and_links(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    heads = {r.page_id: tuple(r)[1:] for r in elements.heads(pages).collect()}
    assert heads == {1: ("A < B", "First one", "en", "rtl", "width=1"), 2: (None,) * 5, 3: (None,) * 5}
    routes = spark.createDataFrame([("about.html", "/about"), ("docs/guide.html", "/docs/guide")], "file string, route string")
    found = sorted(elements.routed_links(pages, routes).drop("place").collect(), key=lambda r: r.hash)
    assert [(r.page_id, r.route, r.search, r.hash) for r in found] == [(1, "/about", {}, ""), (1, "/about", {"tab": "all", "x": "a b"}, "bio")]
    assert elements.routed_links(pages.limit(0), routes).count() == 0


def test_inside_is_by_interval(spark):
    pages = spark.createDataFrame([(1, "<div><p>a<b>b</b></div><b>c</b>"), (2, "<div><div><b>x</b></div></div>")], "page_id int, html string")
    nodes = elements.elements(pages)
    got = sorted(tuple(r) for r in elements.inside(nodes, F.col("tag") == "div", F.col("tag") == "b").collect())
    assert got == [(1, 0, "div", 2, "b"), (2, 0, "div", 2, "b"), (2, 1, "div", 2, "b")]


def test_query_map(spark):
    hrefs = ["/a", "/a?", "/a?x=1&y=%C3%A9&x=2#z?w=1", "/a?=b&c&d=e=f", "/a?p=%zz+1"]
    got = [r.q for r in spark.createDataFrame([(h,) for h in hrefs], "h string").select(elements.query_map(F.col("h")).alias("q")).collect()]
    assert got == [{}, {}, {"x": "2", "y": "é"}, {"": "b", "c": "", "d": "e=f"}, {"p": "%zz+1"}]


@pytest.mark.parametrize("n", [0, 1, 7, 40])
def test_fingerprint_of_paths(spark, n):
    files = [(f"p/{i * 7919 % 100}.txt", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)] + [("same", "b"), ("same", "a"), (None, None)] * (n > 1)
    df = spark.createDataFrame(files, "path string, sha256 string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(f"{p}\n{d}") for p, d in sorted((p or "", d or "") for p, d in files)]
    while len(level) > 4:
        level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
    want = [(sha("".join(level)),)]
    for parts in (1, 3):
        assert [tuple(r) for r in ordering.path_fingerprint(df.repartition(parts), fanout=4).collect()] == want


def test_numbers_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("v"))
    got = [r.at for r in ordering.numbered(df, "v", "k").orderBy(F.col("v").asc_nulls_first(), "k").select("at").collect()]
    assert sorted(got) == list(range(5000)) and got[0] < 500
    rows = ordering.numbered(df, "v", "k").orderBy("at").collect()
    key = [(r.v is not None, r.v or 0, r.k) for r in rows]
    assert key == sorted(key)


def test_numbers_outside_the_tree_are_refused(spark):
    for bad in (-1, 16, None):
        with pytest.raises(Exception, match="outside"):
            inventory.ordered_fingerprint(spark.createDataFrame([(bad,)], "i int"), "i", F.lit("x"), fanout=4, levels=2).collect()


def test_white_space(spark):
    odd = ["  a \n b\t\tc  ", " a 　b", "a b", "", " ", "\n", "a   b﻿", "é  è", "x᠎y", "a\x0bb\x0cc", None, "tail \n"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in odd], "t string").select(X.collapsed(F.col("t")).alias("c")).collect()]
    space = "[\\s\x0b\xa0  -     　﻿]+"
    assert got == [None if t is None else re.sub(space, " ", t, flags=re.A).strip(" ") for t in odd]


def test_both_ways_find_the_same_phrases(spark, monkeypatch):
    phrases = spark.createDataFrame([(1, "One  two"), (2, "one two three four five"), (3, "nowhere to be seen at all"), (4, " "), (5, None), (6, "ONE TWO"), (7, "wo thre")], "item_id int, text string")
    texts_ = spark.createDataFrame([(1, "zone\ntwo"), (2, "One two  three four five six"), (3, None), (4, ""), (2, "one two")], "doc_id int, text string")
    want = [(1, 1), (1, 2), (2, 2), (6, 1), (6, 2), (7, 2)]
    assert sorted(map(tuple, provenance.supported_pairs(phrases, texts_).collect())) == want
    monkeypatch.setattr(provenance, "LETTERS", 3)
    assert sorted(map(tuple, provenance.supported_pairs(phrases, texts_).collect())) == want


def test_provenance_gate(spark):
    files = spark.createDataFrame([("a.txt", "Read the guide\n/not/shown\nRead  the guide"), ("b.txt", "Never written\n")], "path string, text string")
    evidence = spark.createDataFrame([("x", "we READ the\nguide"), ("y", None)], "path string, text string")
    assert sorted(map(tuple, provenance.checked_phrases(files, evidence).collect())) == [("a.txt", "Read the guide", True), ("b.txt", "Never written", False)]
    gate = provenance.provenance_gate(files, evidence).first()
    assert (gate.passed, gate.checked, gate.unsupported, gate.evidence_files) == (False, 2, 1, 2) and len(gate.evidence_sha256) == 64
    empty = provenance.provenance_gate(files.limit(0), evidence.limit(0)).first()
    assert (empty.passed, empty.checked, empty.evidence_files) == (True, 0, 0)
