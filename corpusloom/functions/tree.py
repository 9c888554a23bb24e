"""Markup as a tree of elements, by the rules that browsers follow for tags left open; Arrow-batched.

A page becomes its whole text and its elements. Each element has its interval twice: first and last place in the order
of the elements (all that lies between is inside it), and start and length of its text within the page's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.html import Markup, slices, small_batches

# Fixed values of the markup language: elements without content; what a paragraph ends at; what ends at another of its like, and what shields it.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENDS_PARAGRAPH = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "body": (("head",), ()),
}
SHIELDS_PARAGRAPH = ("button", "caption", "html", "marquee", "object", "table", "td", "template", "th")

NODE = "struct<place:int,until:int,depth:int,tag:string,attributes:map<string,string>,start:int,length:int>"


class _Tree(Markup):
    def __init__(self) -> None:
        super().__init__()
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.text: list[str] = []
        self.size = 0

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            node["until"], node["length"] = len(self.nodes) - 1, self.size - node["start"]

    def _end_open(self, tags: tuple[str, ...], shields: tuple[str, ...]) -> None:
        """Close the outermost of the open elements of these tags that no shield stands above."""
        found = None
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth]["tag"]
            if tag in shields:
                break
            if tag in tags:
                found = depth
        if found is not None:
            self._close_to(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end_open(("p",), SHIELDS_PARAGRAPH)
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        node = {"place": len(self.nodes), "until": len(self.nodes), "depth": len(self.open), "tag": tag, "attributes": self.attributes(attrs), "start": self.size, "length": 0}
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in markup

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self._close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        data = self.data(data)
        self.text.append(data)
        self.size += len(data)

    def close(self) -> None:
        super().close()
        self._close_to(0)


def _tree(html: str | None) -> dict:
    t = _Tree()
    t.read(html)
    return {"text": "".join(t.text), "nodes": t.nodes}


def parsed(html: Column) -> Column:
    """struct(text, nodes): the text of a page (entities decoded, that of scripts and styles included) and its elements in order."""

    @F.pandas_udf(f"struct<text:string,nodes:array<{NODE}>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in slices(batches):
            yield pd.DataFrame([_tree(p) for p in some], columns=["text", "nodes"])

    small_batches()
    return parse(html)


def text_of(text: Column, node: Column) -> Column:
    """The text of an element with all that is inside it."""
    return F.substring(text, node["start"] + 1, node["length"])


def named(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def attribute(node: Column, name: str) -> Column:
    """null where the element lacks it."""
    return F.try_element_at(node["attributes"], F.lit(name))
