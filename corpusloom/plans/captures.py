"""Queries over `pages` as trees and over whole closures and gates, with SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.operators import architecture, closure, discovery, elements, naming, ordering, provenance, repairs, reports, rewriting, upkeep
from corpusloom.sources.tables import table, texts
from corpusloom.sources.trees import new_folder, read_tree, write_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# What several queries share: text of markup (of the entities that pages hold), host and path of a URL.
PLAIN = "replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
HOST = "regexp_extract(url, '^(?i:https?:)?//([^/?#]+)', 1)"
PATH = "coalesce(nullif(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^(?i:https?:)?//[^/?#]+(/.*)$', 1), ''), '/')"
ANCHORS = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages"


@query(f"""SELECT page_id, {PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
nullif(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '<html[^>]* dir="([^"]*)"', 1), '') AS dir, nullif(regexp_extract(html, '<meta name="viewport" content="([^"]*)"', 1), '') AS viewport FROM pages""")
def page_heads(spark, sf_dir):
    """Title, first heading, language, direction and viewport of each page, from its tree."""
    return elements.heads(of_pages(spark, sf_dir))


SUBTREES = ("nav", "article", "footer", "li", "a")


@query(" UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, CAST(unnest(range(1, len(m) + 1)) AS INT) AS nth, {PLAIN.format('unnest(m)')} AS text FROM (SELECT page_id, regexp_extract_all(html, '(?s)<{t}(?: [^>]*)?>(.*?)</{t}>', 1) AS m FROM pages)" for t in SUBTREES))
def subtree_texts(spark, sf_dir):
    """The text of each navigation, article, footer, list item and anchor, with all that is inside it."""
    return elements.subtree_texts(of_pages(spark, sf_dir), *SUBTREES)


@query("SELECT page_id, CAST(len(regexp_extract_all(n, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(n, '<li>')) AS BIGINT) AS items FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS n FROM pages) WHERE contains(n, '<a ')")
def navigation_contents(spark, sf_dir):
    """How many anchors and list items lie inside the navigation of each page, at whatever depth."""
    nodes = elements.elements(of_pages(spark, sf_dir))
    pairs = elements.inside(nodes, F.col("tag") == "nav", F.col("tag").isin("a", "li"))
    return pairs.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "li").alias("items"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-z]')) AS BIGINT) AS elements FROM pages")
def element_counts(spark, sf_dir):
    """How many elements each page has."""
    return elements.elements(of_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("elements"))


@query(f"""WITH s AS (SELECT DISTINCT split_part(ltrim({PATH}, '/'), '/', 1) AS file FROM pages), l AS (SELECT page_id, href, split_part(split_part(href, '#', 1), '?', 1) AS p FROM ({ANCHORS}) WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))
SELECT page_id, '/' || file AS route, '' AS hash, 0 AS searched, count(*) AS n FROM l JOIN s ON ltrim(p, '/') = file WHERE file <> '' GROUP BY page_id, file""")
def section_links(spark, sf_dir):
    """Anchors that lead to a section of captured pages (first part of a path): neither downloads nor for another window, parts split."""
    pages = of_pages(spark, sf_dir)
    section = F.regexp_extract(U.path(F.col("url")), "^/([^/]*)", 1)
    routes = pages.select(section.alias("file")).where("file <> ''").distinct().withColumn("route", F.concat(F.lit("/"), "file"))
    found = elements.routed_links(pages, routes).withColumn("searched", F.size("search"))
    return found.groupBy("page_id", "route", "hash", "searched").agg(F.count("*").alias("n"))


# --- provenance of text, whole

WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
SHOWN = r"""length(t) >= 4 AND regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '^(?i:https?:|data:|blob:|/|\./|\.\./|#|\[|\{|@)') AND NOT regexp_matches(t, '^[a-z0-9_.:@/-]+$')
AND NOT regexp_matches(t, '^[a-z][a-z0-9_-]*( [a-z][a-z0-9_-]*)+$') AND NOT regexp_matches(t, '^(?i:application|text|image|audio|video)/') AND NOT regexp_matches(t, '[<>{}=;]') AND (contains(t, ' ') OR regexp_matches(t, '^[A-Z]'))"""
CHECKED = f"""WITH l AS (SELECT item_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '{WS}', ' ', 'g')) AS t FROM benchmark), p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS path, t AS phrase FROM l WHERE {SHOWN}),
e AS (SELECT CAST(doc_id AS VARCHAR) AS path, lower(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS body FROM documents),
c AS (SELECT path, phrase, EXISTS (SELECT 1 FROM e WHERE contains(e.body, lower(p.phrase))) AS supported FROM p)"""


def claims(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), "text")


def evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


@query(f"{CHECKED} SELECT path, phrase, supported FROM c")
def checked_phrases(spark, sf_dir):
    """Each line of the benchmark that reads like text for people, and whether a document contains it."""
    return provenance.checked_phrases(claims(spark, sf_dir), evidence(spark, sf_dir))


ROWS_DIGEST = "sha256(coalesce(string_agg(d, '' ORDER BY ix), ''))"


def in_order(rows: str, levels: int) -> str:
    """The digest of the files of `rows` (path, d) in the order of their paths, through a tree of 4096 children."""
    out = f"SELECT row_number() OVER (ORDER BY path, d) - 1 AS ix, sha256(path || chr(10) || d) AS d FROM ({rows})"
    for _ in range(levels - 1):
        out = f"SELECT ix // 4096 AS ix, sha256(string_agg(d, '' ORDER BY ix)) AS d FROM ({out}) GROUP BY 1"
    return f"SELECT {ROWS_DIGEST} AS fingerprint FROM ({out})"


def of_any_size(rows: str) -> str:
    """Up to 4096 files one level, beyond that two (up to 16 million)."""
    return f"SELECT CASE WHEN (SELECT count(*) FROM ({rows})) <= 4096 THEN ({in_order(rows, 1)}) ELSE ({in_order(rows, 2)}) END AS fingerprint"


@query(f"""{CHECKED} SELECT coalesce(bool_and(supported), true) AS passed, count(*) AS checked, count(*) FILTER (NOT supported) AS unsupported, (SELECT count(*) FROM documents) AS evidence_files,
({of_any_size("SELECT path, sha256(body) AS d FROM e")}) AS evidence_sha256 FROM c""")
def content_provenance_gate(spark, sf_dir):
    """Content provenance as one gate: lines for people, whether all of them are in the documents, and what the documents were."""
    return provenance.provenance_gate(claims(spark, sf_dir), evidence(spark, sf_dir))


@query(of_any_size("SELECT url AS path, sha256(html) AS d FROM pages"))
def site_fingerprint(spark, sf_dir):
    """One digest of all pages in the order of their URLs."""
    pages = of_pages(spark, sf_dir)
    return ordering.path_fingerprint(pages.select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256")))


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS place FROM events")
def event_order(spark, sf_dir):
    """The place of each event in the order of kinds, times and ids, numbered without one task for all."""
    return ordering.numbered(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id", name="place").select("event_id", "place")


# --- closure of names over files


FILES = f"""WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path, html FROM pages), f AS (SELECT *, host || path || CASE WHEN ends_with(path, '/') THEN 'index.html' ELSE '' END AS file FROM p),
r AS (SELECT DISTINCT f.file AS "from", f.host, split_part(split_part(h, '#', 1), '?', 1) AS name FROM f, (SELECT page_id AS id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) l WHERE l.id = f.page_id AND NOT regexp_matches(h, '^(#|//|[a-z]+:)') AND h <> ''),
n AS (SELECT *, host || '/' || ltrim(name, '/') AS resolved FROM r)"""


def captured_files(spark, sf_dir):
    """Pages as the files of a capture: a folder for each host."""
    path = U.path(F.col("url"))
    name = F.concat(U.host(F.col("url")), path, F.when(F.endswith(path, F.lit("/")), "index.html").otherwise(""))
    return of_pages(spark, sf_dir).select("page_id", name.alias("path"), F.col("html").alias("text"))


def named_files(spark, sf_dir):
    return closure.references(captured_files(spark, sf_dir), extensions=None, attributes=True, root=F.substring_index("path", "/", 1))


@query(f"""{FILES} SELECT "from", name AS raw, 'static' AS source, resolved, true AS blocking FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.file = n.resolved)""")
def unclosed_references(spark, sf_dir):
    """What pages, as files of their hosts' folders, name that was not captured."""
    return closure.missing(named_files(spark, sf_dir), captured_files(spark, sf_dir))


@query(f"""{FILES} SELECT host, count(*) AS "references", count(*) FILTER (NOT there) AS blocking, 0 AS diagnostic, bool_and(there) AS passed FROM (SELECT host, EXISTS (SELECT 1 FROM f WHERE f.file = n.resolved) AS there FROM n) GROUP BY host""")
def closure_gate(spark, sf_dir):
    """The closure gate of each host."""
    refs = named_files(spark, sf_dir).withColumn("host", F.substring_index("from", "/", 1))
    return closure.gate(refs, captured_files(spark, sf_dir), by="host")


FILED = FILES.replace("FROM p),", "FROM p QUALIFY row_number() OVER (PARTITION BY file ORDER BY page_id) = 1),")


@query(f"""{FILED} SELECT count(*) AS "references", count(*) FILTER (NOT there) AS blocking, 0 AS diagnostic, coalesce(bool_and(there), true) AS passed FROM (SELECT EXISTS (SELECT 1 FROM f WHERE f.file = n.resolved) AS there FROM n)""")
def tree_closure_gate(spark, sf_dir):
    """Pages written out as a tree of files (of those with one path the first), scanned folder by folder, and the closure gate over what the tree holds."""
    root = new_folder(spark, "capture")
    first = captured_files(spark, sf_dir).groupBy("path").agg(F.min_by("text", "page_id").alias("content"))
    write_tree(first.withColumn("path", F.concat("path", F.lit(".page"))), root)  # a page's path may be the folder of another page
    files = texts(read_tree(spark, root)).withColumn("path", F.regexp_replace("path", r"\.page$", ""))
    return closure.gate(closure.references(files, extensions=None, attributes=True, root=F.substring_index("path", "/", 1)), files)


# --- styles


@query(f"""WITH c AS (SELECT url AS key, min(page_id) AS k FROM pages WHERE page_id % 2 = 0 GROUP BY url), o AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS m FROM pages),
a AS (SELECT page_id, origin, unnest(m) AS h, unnest(range(len(m))) AS i FROM o),
v AS (SELECT page_id, string_agg('a{{background:' || CASE WHEN page_id % 3 <> 0 THEN 'url("/' || url_encode(ltrim(h, '/')) || '")' WHEN k IS NULL THEN 'url('''')' ELSE 'url("/_external/kept/' || k || '.html")' END || '}}', '' ORDER BY i) AS t FROM a LEFT JOIN c ON c.key = origin || h GROUP BY page_id)
SELECT o.page_id AS id, coalesce(t, '') || 'b{{background:' || CASE WHEN coalesce(x.k, y.k) IS NULL THEN 'url('''')' ELSE 'url("/_external/kept/' || coalesce(x.k, y.k) || '.html")' END || '}}c{{background:url(data:x)}}' AS text
FROM o LEFT JOIN v USING (page_id) LEFT JOIN c x ON x.key = o.url LEFT JOIN c y ON y.key = regexp_replace(o.url, '[?#].*$', '')""")
def rewritten_styles(spark, sf_dir):
    """Styles that load what a page links to and the page itself, with every URL led to its copy, emptied, or left (every third page's style comes from elsewhere; pages with even ids are kept)."""
    pages = of_pages(spark, sf_dir)
    one = lambda u: F.concat(F.lit("a{background:url("), u, F.lit(")}"))
    anchors = F.transform(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)), one)
    text = F.concat(F.array_join(anchors, ""), F.lit("b{background:url('"), F.col("url"), F.lit("')}c{background:url(data:x)}"))
    styles = pages.select(F.col("page_id").alias("id"), F.lit("site/index.html").alias("page"), F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("source"), text.alias("text"))
    copies = pages.where("page_id % 2 = 0").groupBy(F.col("url").alias("key")).agg(F.concat(F.lit("kept/"), F.min("page_id").cast("string"), F.lit(".html")).alias("kept_as"))
    return rewriting.rewritten(styles, rewriting.decided(rewriting.style_urls(styles), copies, "site"))


# --- discovery


@query(f"""WITH RECURSIVE p AS (SELECT split_part(ltrim({PATH}, '/'), '/', 1) AS key, html FROM pages), s AS (SELECT DISTINCT key FROM p),
e AS (SELECT DISTINCT key AS source, ltrim(split_part(split_part(h, '#', 1), '?', 1), '/') AS target FROM (SELECT key, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">', 1)) AS h FROM p)),
r(key, round) AS (SELECT 'fr', 0 UNION SELECT e.target, r.round + 1 FROM r JOIN s ON s.key = r.key JOIN e ON e.source = r.key WHERE r.round < 5),
f AS (SELECT key, min(round) AS round FROM r GROUP BY key)
SELECT CAST(f.round AS INT) AS round, CASE WHEN s.key IS NULL THEN 'missing' ELSE 'fetched' END AS outcome, count(*) AS n FROM f LEFT JOIN s ON s.key = f.key
WHERE f.round <= (SELECT max(f.round) + 1 FROM f JOIN s ON s.key = f.key) GROUP BY ALL""")
def discovery_rounds(spark, sf_dir):
    """What each round of discovery from one section of captured pages on asks for: sections that are there, and others (sections stand for files, anchors for what they load)."""
    pages = of_pages(spark, sf_dir)
    files = pages.select(F.regexp_extract(U.path(F.col("url")), "^/([^/]*)", 1).alias("key"), "html")
    name = lambda h: F.regexp_replace(U.without_query(h), "^/+", "")
    names = lambda rows: rows.select(F.explode(F.transform(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), F.lit(1)), name)).alias("key"))
    found = discovery.discover(files, spark.createDataFrame([("fr",)], "key string"), names, new_folder(spark, "rounds"))
    return reports.per_round(found, "outcome")


# --- the architecture of rebuilt projects

#: Five pages are a project; what its files say follows from the ids of its pages, so that every rule is kept and broken.
PROJECTS = """WITH p AS (SELECT page_id AS i, page_id // 5 AS project FROM pages), f AS (SELECT project,
bool_or(i % 5 = 0) AND project % 3 <> 0 AS package, bool_or(i % 2 = 0) AS router, count(*) FILTER (i % 3 = 0) AS injected, count(*) FILTER (i % 17 = 0) AS bundle, count(*) FILTER (i % 11 = 0) AS marker,
count(*) FILTER (i % 23 = 0) AS legacy, count(*) FILTER (i % 46 = 0) AS shells, count(*) FILTER (i % 7 = 0) AS imperative, bool_or(i % 13 = 0) AS element, bool_or(i % 4 = 0) AS imported,
count(*) FILTER (i % 3 = 1) AS engine, count(*) FILTER (i % 3 = 1 AND (i % 2 = 1 OR i % 5 = 0)) AS incomplete, count(*) FILTER (i % 3 = 1 AND i % 2 = 1) AS placeholders,
bool_or(i % 3 = 1 AND i % 4 < 2) AS surface, bool_or(i % 3 = 1 AND i % 8 < 4) AS rendered, bool_or(i % 3 = 1 AND i % 16 < 8) AS terminated,
bool_or(i % 5 = 1) AND project % 4 = 0 AS canvas, bool_or(i % 5 = 1) AND project % 4 = 0 OR bool_or(i % 19 = 0) AS workers, bool_or(i % 19 = 0) AS captured FROM p GROUP BY project),
n AS (SELECT *, canvas OR workers OR element AS needed, NOT canvas OR rendered AS renders FROM f),
r AS (SELECT project, unnest([{'c': 'tanstack-router-missing', 'n': CAST(NOT (package AND router) AS BIGINT)}, {'c': 'dynamic-script-injection', 'n': injected}, {'c': 'business-bootstrap-bundle', 'n': bundle}, {'c': 'legacy-adapter-marker', 'n': marker},
{'c': 'captured-legacy-script-not-reconstructed', 'n': legacy}, {'c': 'bootstrap-owned-shell', 'n': shells}, {'c': 'visible-dom-owned-outside-react', 'n': imperative + shells},
{'c': 'runtime-engine-present-but-unisolated', 'n': CAST((canvas OR workers) AND engine = 0 AS BIGINT)}, {'c': 'engine-contract-missing', 'n': CAST(needed AND NOT canvas AND NOT workers AND engine = 0 AS BIGINT)},
{'c': 'engine-contract-incomplete', 'n': incomplete}, {'c': 'engine-contract-placeholder', 'n': placeholders}, {'c': 'engine-contract-unmounted', 'n': CAST(needed AND engine > 0 AND NOT imported AS BIGINT)},
{'c': 'runtime-canvas-surface-missing', 'n': CAST(canvas AND NOT (element AND surface) AS BIGINT)}, {'c': 'runtime-worker-cleanup-missing', 'n': CAST(workers AND NOT terminated AS BIGINT)},
{'c': 'engine-runtime-placeholder', 'n': CAST(needed AND engine > 0 AND NOT renders AS BIGINT)}, {'c': 'captured-bootstrap-replacement-unproven', 'n': CAST(captured AND NOT renders AS BIGINT)}]) AS x FROM n)"""


def projects(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Files of projects, with the markup of a page in each source file, and the legacy scripts that they were captured with."""
    pages = of_pages(spark, sf_dir).select(F.col("page_id").alias("i"), F.floor(F.col("page_id") / 5).alias("project"), "html")
    i, name = F.col("i"), F.col("i").cast("string")
    some = lambda test, text: F.when(test, F.lit(text)).otherwise("")
    source = F.concat("html", some(i % 2 == 0, " <RouterProvider/>; createFileRoute('/')"), some(i % 3 == 0, " createElement('script')"), some(i % 7 == 0, " document.body.innerHTML = x"), some(i % 11 == 0, " legacyScripts"), some(i % 13 == 0, " <canvas id=c>"), some(i % 4 == 0, " import e from '../engines/e'; e.start(); e.destroy()"))
    engine = F.concat(F.lit("start() { this.on = 1 }\nsnapshot() { }\ndestroy: () => { stop() }\n"), F.when(i % 2 == 1, "dispatch(e: Event): void { return; /* later */ }\n").otherwise("async dispatch(e) { this.e = e }\n"), some(i % 5 != 0, "resize(w, h) { this.w = w }\n"), some(i % 4 < 2, "c.getContext('2d')\n"), some(i % 8 < 4, "c.drawImage(a)\n"), some(i % 16 < 8, "w.terminate()\n"))
    kinds = [
        (i >= 0, F.concat(F.lit("src/pages/p"), name, F.lit(".tsx")), source),
        (i % 3 == 1, F.concat(F.lit("src/engines/e"), name, F.lit("/index.ts")), engine),
        ((i % 5 == 0) & (F.col("project") % 3 != 0), F.lit("package.json"), F.lit('{"dependencies": {"@tanstack/react-router": "1"}}')),
        (i % 17 == 0, F.concat(F.lit("public/"), name, F.lit("/main.js.bak")), F.lit("")),
        ((i % 5 == 1) & (F.col("project") % 4 == 0), F.lit("reports/behavior-contracts.json"), F.lit('{"summary": {"canvas": 1, "workers": 2}}')),
        (i % 19 == 0, F.concat(F.lit("mirror/"), name, F.lit("/app.js")), F.lit("new Worker('w.js')")),
    ]
    each = F.array_compact(F.array(*[F.when(test, F.struct(path.alias("path"), text.alias("text"))) for test, path, text in kinds]))
    files = pages.select("project", F.explode(each).alias("f")).select("project", "f.*")
    return files, pages.where("i % 23 = 0").select("project", F.when(i % 46 == 0, 0).otherwise(F.size(F.regexp_extract_all("html", F.lit("<[a-z]"), F.lit(0)))).alias("visible"))


@query(f"{PROJECTS} SELECT project, x.c AS code, x.n AS n FROM r WHERE x.n > 0")
def architecture_findings(spark, sf_dir):
    """Which rules of a rebuilt project's architecture each project breaks, and how often."""
    return architecture.findings(*projects(spark, sf_dir))


@query(f"{PROJECTS} SELECT project, count(*) FILTER (x.n > 0) AS findings, count(*) FILTER (x.n > 0) = 0 AS passed FROM r GROUP BY project")
def architecture_gate(spark, sf_dir):
    """The architecture gate of each project."""
    return architecture.gate(*projects(spark, sf_dir))


# --- names in turn


@query("""WITH RECURSIVE d AS (SELECT doc_id, chr(CAST(97 + (doc_id // 20) % 13 AS INT)) || source AS base FROM documents), g AS (SELECT doc_id, base, regexp_replace(base, '[0-9]+$', '') AS stem FROM d WHERE base IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS i FROM g),
r(stem, i, doc_id, u, used) AS (SELECT DISTINCT stem, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM o
UNION ALL SELECT x.stem, x.i, x.doc_id, x.u, list_append(x.used, x.u) FROM (SELECT o.stem, o.i, o.doc_id, r.used, list_filter(list_prepend(o.base, list_transform(range(2, len(r.used) + 3), lambda j: o.base || j)), lambda c: NOT list_contains(r.used, c))[1] AS u FROM r JOIN o ON o.stem = r.stem AND o.i = r.i + 1) AS x)
SELECT doc_id, u AS "unique" FROM r WHERE i > 0 UNION ALL SELECT doc_id, NULL FROM d WHERE base IS NULL""")
def names_in_turn(spark, sf_dir):
    """Names that no other row has, given in order of documents (a letter and the source for component names, some of which end in numbers that others would get)."""
    letter = F.char((97 + F.floor(F.col("doc_id") / 20) % 13).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(letter, "source").alias("name"))
    return naming.unique_names(docs, "name", "doc_id").select("doc_id", "unique")


# --- histories of repairs

REPAIRS = r"""WITH e AS (SELECT event_id, user_id, ts, event_type AS strategy, value > 20 AS passed, CASE WHEN event_id % 10 <> 0 THEN event_type END AS signature,
CASE event_id % 6 WHEN 0 THEN 'route' WHEN 1 THEN 'content' WHEN 2 THEN 'layout' WHEN 3 THEN 'asset' WHEN 4 THEN 'network' ELSE 'behavior' END AS classification,
CASE WHEN value > 20 AND event_id % 7 = 0 THEN 'untested' WHEN event_id % 13 = 0 THEN 'no-action' WHEN event_id % 5 < 2 THEN 'report-only' END AS own FROM events),
f AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM e),
g AS (SELECT *, min(i) FILTER (own IS NULL AND NOT passed) OVER (PARTITION BY user_id, classification, strategy) AS failed FROM f), j AS (SELECT *, CASE WHEN i > failed THEN 'repeated' ELSE own END AS refused FROM g)"""


def proposed_repairs(spark, sf_dir):
    """Events as repairs: users for histories, types for strategies; what else a proposal has follows from the event's number."""
    n = F.col("event_id")
    pick = lambda by, *of: F.element_at(F.array(*of), (n % by + 1).cast("int"))
    codes = [F.lit(c) for c in ("route-missing", "visible-text", "geometry", "asset-lost", "fetch-failed", "other")]
    files = [F.array(*map(F.lit, f)) if f else F.array().cast("array<string>") for f in (["reports/a.json"], ["proof\\x.json", "a/run.json"], ["reports/a.json", "src/a.ts"], [], ["src/a.ts"])]
    return table(spark, sf_dir, "events").select(
        n, "user_id", "ts", pick(6, *codes).alias("code"), F.col("event_type").alias("strategy"), F.when(n % 10 != 0, F.col("event_type")).alias("signature"), F.when(F.col("value") > 20, "passed").otherwise("failed").alias("result"),
        F.when(n % 7 != 0, "a test").alias("test"), F.when(n % 13 == 0, " ").otherwise("edit").alias("action"), pick(5, *files).alias("files"),
    )


@query(f"{REPAIRS} SELECT event_id, classification, refused FROM j")
def judged_repairs(spark, sf_dir):
    """Which proposed repairs are refused, and why."""
    return repairs.judged(proposed_repairs(spark, sf_dir), "user_id", ["ts", "event_id"], ("run.json",)).select("event_id", "classification", "refused")


@query(f"""{REPAIRS} SELECT event_id, row_number() OVER (PARTITION BY user_id, signature ORDER BY i) AS attempt, lag(signature) OVER (PARTITION BY user_id ORDER BY i) AS previous_signature, passed AS converged FROM j WHERE refused IS NULL""")
def recorded_repairs(spark, sf_dir):
    """The history of the repairs that are kept."""
    return repairs.recorded(proposed_repairs(spark, sf_dir), "user_id", ["ts", "event_id"], ("run.json",)).select("event_id", "attempt", "previous_signature", "converged")


# --- convergence, batch by batch


@query("""WITH a AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run, lag(event_type, 2) OVER w AS l2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY ts, event_id) AS consecutive FROM a) SELECT event_id, consecutive, consecutive >= 2 OR coalesce(event_type = l2, false) AS non_convergent FROM b""")
def convergence_by_batches(spark, sf_dir):
    """What failure_convergence tells, from three batches of events in order of time, the second of which comes twice."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    third = F.least(F.floor((at - F.lit(low or 0)) * 3 / F.lit(max((high or 0) - (low or 0), 1))), F.lit(2))
    root, out = new_folder(spark, "convergence"), []
    for i in (0, 1, 1, 2):
        batch = events.where(third == i) if i else events.where((third == 0) | F.col("ts").isNull())
        out.append(upkeep.carry_on(batch, root, f"batch-{i}", "user_id", "event_type", ["ts", "event_id"]))
    del out[1]  # it and the one after are the same rows
    return out[0].unionByName(out[1]).unionByName(out[2]).select("event_id", "consecutive", "non_convergent")
