"""Queries of operators that the tables hold no input for, over rows of their own (and over the tables where they help), with their SQL.

Rows stand in one list that both Spark and the SQL take. Where SQL cannot say what an operator does, it states the rows
that must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import classify as C
from corpusloom.functions import html as H
from corpusloom.functions import script as S
from corpusloom.functions import text as X
from corpusloom.functions import url as U
from corpusloom.operators import comparison, inventory, links, lookups, reports, sequences
from corpusloom.sources.tables import table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, str):
        return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    return str(v).upper() if isinstance(v, bool) else str(v)


def values(names: str, rows: list[tuple]) -> str:
    """FROM-clause of rows."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({names})"


def with_rows(names: str, rows: list[tuple], sql: str) -> str:
    """FROM-clause of rows and what a query over the tables gives."""
    return f"(SELECT {names} FROM {values(names, rows)} UNION ALL {sql})"


def by_id(column: str, *cases: str) -> str:
    """One text or another, by the remainder of an id, in words that both engines read."""
    return f"CASE {column} % {len(cases)} " + " ".join(f"WHEN {i} THEN {literal(c)}" for i, c in enumerate(cases)) + " END"


def rows_of_pages(spark, sf_dir, **columns):
    """Columns made of page_id, url, html, place (the path without its first slash)."""
    place = F.regexp_replace(U.path(F.col("url")), "^/", "")
    return table(spark, sf_dir, "pages").withColumn("place", place).select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def pattern(p: str) -> str:
    return literal(p)


def any_of(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {pattern(p)})" for p in patterns) + ")"


# --- routes, paths and URLs

URL_PATH = "coalesce(nullif(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^(?i:https?:)?//[^/?#]+(/.*)$', 1), ''), '/')"
OF_PAGES = f"(SELECT *, regexp_replace({URL_PATH}, '^/', '') AS place FROM pages)"
ROUTE = "CASE WHEN {0} = 'index.html' THEN '/' WHEN ends_with({0}, '/index.html') THEN '/' || regexp_replace({0}, '/index\\.html$', '') ELSE '/' || regexp_replace({0}, '(?i)\\.html?$', '') END"
FILES = [("index.html",), ("a/index.html",), ("a.html",), ("a/index.htm",), ("b/c.HTML",), ("d",)]


@query(f"SELECT path, {ROUTE.format('path')} AS route FROM {with_rows('path', FILES, f"SELECT place || {by_id('page_id', '.html', '/index.html', '')} FROM {OF_PAGES}")}")
def routes_of_files(spark, sf_dir):
    """The route of each captured file (paths of pages, as files)."""
    files = spark.createDataFrame(FILES, "path string").unionByName(rows_of_pages(spark, sf_dir, path=f"place || {by_id('page_id', '.html', '/index.html', '')}"))
    return files.select("path", U.route_of_file(F.col("path")).alias("route"))


URLS = [("https://fixture.example/about.html?tab=team#bio",), ("https://fixture.example/?#",), ("https://fixture.example",), ("//cdn.example/x/index.html#top",)]


@query(f"""WITH u AS (SELECT url, regexp_replace({URL_PATH}, '^/', '') AS p, regexp_extract(split_part(url, '#', 1), '(\\?.*)$', 1) AS s, regexp_extract(url, '(#.*)$', 1) AS f FROM (SELECT url FROM pages UNION ALL SELECT url FROM {values('url', URLS)}))
SELECT url, {ROUTE.format('p')} AS route, CASE WHEN s = '?' THEN '' ELSE s END AS search, CASE WHEN f = '#' THEN '' ELSE f END AS hash FROM u""")
def parts_of_links(spark, sf_dir):
    """Route, search and fragment of page URLs and a few more."""
    urls = table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame(URLS, "url string"))
    return urls.select("url", U.href_parts(F.col("url")).alias("p")).select("url", "p.*")


HREFS = [("../a/./b.css?v=1", "x/y.html", "site", "a/b.css"), ("/img/a%20b+c.png#z", "x/y.html", "site", "site/img/a b+c.png"), ("c.js", "index.html", "", "c.js"), ("../../up.js", "x/y.html", "s", "../up.js")]


BESIDE = f"SELECT '../' || page_id || '.css' AS href, CASE WHEN contains(place, '/') THEN regexp_replace(regexp_replace(place, '[^/]*$', ''), '[^/]+/$', '') ELSE '../' END || page_id || '.css' AS kept FROM {OF_PAGES}"


@query(f"SELECT href, kept FROM {values('href, page, prefix, kept', HREFS)} UNION ALL {BESIDE}")
def resolved_links(spark, sf_dir):
    """The files that hrefs of pages name."""
    own = spark.createDataFrame([h[:3] for h in HREFS], "href string, page string, prefix string")
    return own.unionByName(rows_of_pages(spark, sf_dir, href="'../' || page_id || '.css'", page="place", prefix="''")).select("href", U.resolved(F.col("href"), F.col("page"), F.col("prefix")).alias("kept"))


STEMS = [("/", "index", "index", "HomePage"), ("/about/team", "about.team", "about.team", "AboutTeamPage"), ("/products/widget/details", "products.widget.details", "products_.widget.details", "ProductsWidgetDetailsPage"), ("/123-tools", "123-tools", "123-tools", "Page123ToolsPage")]
KNOWN_ROUTES = ["/", "/products", "/products/widget/details", "/about/team"]


SAFE = "regexp_replace(rtrim(place, '/'), '[^A-Za-z0-9_$/-]', '-', 'g')"
NAMED_PAGES = f"SELECT '/' || rtrim(place, '/') AS route, replace({SAFE}, '/', '.') AS stem, replace({SAFE}, '/', '.') AS project_stem, array_to_string(list_transform(regexp_extract_all(place, '[A-Za-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '') || 'Page' AS name FROM {OF_PAGES} WHERE rtrim(place, '/') <> ''"


@query(f"SELECT route, stem, project_stem, name FROM {values('route, stem, project_stem, name', STEMS)} UNION ALL {NAMED_PAGES}")
def route_names(spark, sf_dir):
    """Stems and component names of routes."""
    pages = rows_of_pages(spark, sf_dir, route="concat('/', rtrim('/', place))").where("route <> '/'")
    routes = spark.createDataFrame([s[:1] for s in STEMS], "route string").unionByName(pages)
    known = F.array(*[F.lit(r) for r in KNOWN_ROUTES])
    return routes.select("route", U.route_stem(F.col("route")).alias("stem"), U.project_stem(F.col("route"), known).alias("project_stem"), U.component_name(F.col("route")).alias("name"))


KEPT = [("site/img/a b+c.png", "/source/site/img/a%20b%2Bc.png", "/img/a%20b%2Bc.png"), ("site", "/source/site", "/"), ("_fonts/é.woff", "/source/_fonts/%C3%A9.woff", "/_external/_fonts/%C3%A9.woff"), ("./site/x/../y.js", "/source/./site/x/../y.js", "/y.js")]


ENCODED = "array_to_string(list_transform(list_filter(string_split({0}, '/'), lambda x: x <> ''), lambda x: url_encode(x)), '/')"
EACH = "array_to_string(list_transform(string_split({0}, '/'), lambda x: url_encode(x)), '/')"
SERVED = f"SELECT {by_id('page_id', 'site/', '')} || place AS path, '/source/' || {EACH.format(by_id('page_id', 'site/', '') + ' || place')} AS source_url, CASE WHEN page_id % 2 = 0 THEN '/' ELSE '/_external/' END || {ENCODED.format('place')} AS runtime_url FROM {OF_PAGES} WHERE place <> ''"


@query(f"SELECT path, source_url, runtime_url FROM {values('path, source_url, runtime_url', KEPT)} UNION ALL {SERVED}")
def public_urls(spark, sf_dir):
    """URLs that captured files are served by."""
    own = spark.createDataFrame([k[:1] for k in KEPT], "path string")
    return own.unionByName(rows_of_pages(spark, sf_dir, path=f"CASE WHEN place <> '' THEN {by_id('page_id', 'site/', '')} || place END").where("path IS NOT NULL")).select("path", U.public_url(F.col("path")).alias("source_url"), U.runtime_url(F.col("path"), "site").alias("runtime_url"))


SLUGS = [("https://Shop.Example.com:8080/x", "shop.example.com"), ("https://a_b.example/", "a-b.example"), ("/nowhere", "site")]


SLUG = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '[^a-z0-9.-]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT url, slug, '20240130-235959' AS stamp FROM {values('url, slug', SLUGS)} UNION ALL SELECT url, {SLUG}, '20240130-235959' FROM pages")
def run_names(spark, sf_dir):
    """Slugs of hosts and the stamp of a run."""
    at = F.lit("2024-01-30T23:59:59").cast("timestamp_ntz")
    urls = spark.createDataFrame([s[:1] for s in SLUGS], "url string").unionByName(table(spark, sf_dir, "pages").select("url"))
    return urls.select("url", U.host_slug(F.col("url")).alias("slug"), U.run_stamp(at).alias("stamp"))


PUBLIC = [("~/assets/a%20b.js?x=1#y",), ("//assets/c+d.js",), ("~~e%zz.js",), (None,)]


@query(f"""SELECT raw, CASE WHEN regexp_matches(p, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f])') THEN p ELSE url_decode(p) END AS path FROM
(SELECT raw, regexp_replace(regexp_replace(split_part(split_part(coalesce(raw, ''), '#', 1), '?', 1), '^~+', ''), '^/+', '') AS p FROM {with_rows('raw', PUBLIC, f"SELECT '~~//' || place || '?x=1' FROM {OF_PAGES}")})""")
def public_paths(spark, sf_dir):
    """References as paths of public files."""
    return spark.createDataFrame(PUBLIC, "raw string").unionByName(rows_of_pages(spark, sf_dir, raw="'~~//' || place || '?x=1'")).select("raw", U.public_path(F.col("raw")).alias("path"))


OFFLINE = [("https://api.example/v1/users/*",), ("https://api.example/v1/users/",), ("//CDN.example/a.js?x=*",), ("https://api.example",)]


@query(f"""SELECT url, '/__offline__/' || lower(regexp_extract(c, '^(?i:https?:)?//([^/?#]+)', 1)) || regexp_replace(c, '^(?i:https?:)?//[^/?#]*', '') AS offline, regexp_replace(c, '^(?i:https?:)?//[^/?#]*', '') AS local
FROM (SELECT url, split_part(url, '*', 1) AS c FROM {with_rows('url', OFFLINE, f"SELECT url || {by_id('page_id', '*', '')} FROM pages")})""")
def offline_paths(spark, sf_dir):
    """Where calls to other hosts go in a copy without network."""
    return spark.createDataFrame(OFFLINE, "url string").unionByName(rows_of_pages(spark, sf_dir, url=f"url || {by_id('page_id', '*', '')}")).select("url", U.offline_path(F.col("url")).alias("offline"), U.local_path(F.col("url")).alias("local"))


VISITS = [("http://localhost:4173", "/about"), ("http://localhost:4173/base/", "team"), ("http://localhost:4173/base", "/")]


@query(f"SELECT base, route, regexp_replace(base, '/$', '') || '/' || regexp_replace(route, '^/', '') AS url FROM {with_rows('base, route', VISITS, f"SELECT regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || {by_id('page_id', '/', '')}, '/' || place FROM {OF_PAGES}")}")
def route_urls(spark, sf_dir):
    """The URL of each route below a base."""
    visits = rows_of_pages(spark, sf_dir, base=f"regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || {by_id('page_id', '/', '')}", route="'/' || place")
    return spark.createDataFrame(VISITS, "base string, route string").unionByName(visits).select("base", "route", U.route_url(F.col("base"), F.col("route")).alias("url"))


SITE = "https://fixture.example/"
RAW = [
    ("./nested.png", "_external/cdn.example/css/theme.css", "https://cdn.example/css/theme.css", "https://cdn.example/css/nested.png"),
    ("../img/a.png?v=2", "css/site.css", None, "https://fixture.example/img/a.png?v=2"),
    ("assets/app.js", "js/boot.js", None, "https://fixture.example/assets/app.js"),
    ("/assets/b.json#x", "js/boot.js", None, "https://fixture.example/assets/b.json#x"),
    ("//cdn.example/c.woff2", "index.html", None, "https://cdn.example/c.woff2"),
    ("../host.example/x.js", "index.html", None, None),
    ("/host.example/x.js", "index.html", None, None),
    ("data:image/png,x", "index.html", None, None),
    ("#top", "index.html", None, None),
    ("page.php", "index.html", None, None),
    ("https://www.google-analytics.com/a.js", "index.html", None, None),
    ("/a/%2e%2e/x.js", "index.html", None, None),
    ("", "index.html", None, None),
]


@query(f"SELECT raw, url FROM {values('raw, found_in, captured, url', RAW)} UNION ALL SELECT p || page_id || e, u || page_id || '.png' FROM pages, (VALUES ('/a/', '.png', 'https://fixture.example/a/'), ('../b/', '.png', 'https://fixture.example/b/'), ('#', '', NULL), ('https://x.example/', '.png', 'https://x.example/')) AS v(p, e, u)")
def fetch_candidates(spark, sf_dir):
    """The URLs that references ask for; null where one is refused."""
    rows = spark.createDataFrame([r[:3] for r in RAW], "raw string, found_in string, captured string")
    for before, after in (("/a/", ".png"), ("../b/", ".png"), ("#", ""), ("https://x.example/", ".png")):
        rows = rows.unionByName(rows_of_pages(spark, sf_dir, raw=f"concat('{before}', page_id, '{after}')", found_in="'css/site.css'", captured="CAST(NULL AS STRING)"))
    return rows.select("raw", U.candidate(F.col("raw"), F.col("found_in"), SITE, S.EXTENSIONS, F.col("captured")).alias("url"))


PLACES = [("/work/site", "/work/site"), ("/work/site", "/work/site/a/b"), ("/work/site", "/work/site2"), ("/work/site", "/work")]


@query(f"SELECT root, path, path = root OR starts_with(path, root || '/') AS inside FROM {with_rows('root, path', PLACES, f"SELECT '/' || {by_id('page_id', 'en', 'fr', 'f')}, '/' || place FROM {OF_PAGES}")}")
def contained_paths(spark, sf_dir):
    """Whether paths lie within a root."""
    more = rows_of_pages(spark, sf_dir, root=f"'/' || {by_id('page_id', 'en', 'fr', 'f')}", path="'/' || place")
    return spark.createDataFrame(PLACES, "root string, path string").unionByName(more).select("root", "path", U.within(F.col("root"), F.col("path")).alias("inside"))


NAMED = [("http://www.w3.org/2000/svg",), ("https://react.dev/errors/31",), ("http://127.0.0.1:4173/x",), ("https://api.example/v1",)]


@query(f"SELECT url, {' OR '.join(f'starts_with(url, {literal(p)})' for p in U.INERT)} OR regexp_matches(url, '^(?i:https?:)?//(localhost|127(\\.\\d{{1,3}}){{3}})(:|/|$)') AS inert FROM (SELECT url FROM pages UNION ALL SELECT url FROM {values('url', NAMED)})")
def inert_urls(spark, sf_dir):
    """Which URLs load nothing."""
    urls = table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame(NAMED, "url string"))
    return urls.select("url", U.is_inert(F.col("url")).alias("inert"))


# --- classes

ENDINGS = by_id("page_id", "/LICENSE", "/brand/x.svg", "/vendor/y.js", "/data.JSON", "", "/license.d/z")
PATHS = [("LICENSE",), ("lib/copying.txt",), ("vendors/x.license.js",), ("assets/logo/a.svg",), ("vendor/three.js",), ("js/App.MJS",), ("a/b",), ("noticeboard.html",)]
LICENSE = "(regexp_matches(path, '(?i)(^|/)(license|copying|notice)(\\.[^/]*)?$') OR regexp_matches(path, '(?i)\\.license(\\.|$)'))"
STATUS = "CASE WHEN regexp_matches(path, '(?i)(^|/)(brand|brands|logo|logos|trademark)(/|$)') THEN 'restricted' WHEN regexp_matches(path, '(?i)(^|/)(vendor|vendors|third-party)(/|$)') THEN 'covered' ELSE 'unverified' END"


@query(f"SELECT path, {LICENSE} AS license, {STATUS} AS status, coalesce(lower(nullif(regexp_extract(path, '[^/.](\\.[^/.]*)$', 1), '')) IN ('.css', '.js', '.mjs', '.json', '.svg'), false) AS text_asset FROM {with_rows('path', PATHS, f"SELECT place || {ENDINGS} FROM {OF_PAGES}")}")
def path_classes(spark, sf_dir):
    """License files, what an authorization says of a path, text assets."""
    p = F.col("path")
    return spark.createDataFrame(PATHS, "path string").unionByName(rows_of_pages(spark, sf_dir, path=f"place || {ENDINGS}")).select("path", C.license_file(p).alias("license"), C.authorization(p, F.lit(True)).alias("status"), C.text_asset(p).alias("text_asset"))


NAMES_OF_SCRIPTS, KINDS_OF_SCRIPTS = by_id("page_id", "/main-abc.js", "/draco.js.bak", "/x.mjs", "/app.123.js.old", ".js"), by_id("page_id", "module", "", "text/javascript; v", "application/json")
SCRIPTS = [("/assets/main-CJJ9sJBo.js", "module"), ("/assets/js/app.1782836328290.js", ""), ("/assets/js/app.1782836328290.js.reconstructed", "text/javascript; x"), ("/vendor/draco_decoder.js", ""), ("/x/other.mjs", "module"), ("/x/other.js", "application/json")]
BARE = "regexp_replace(lower(src), '(\\.m?js)(\\.(reconstructed|disabled|backup|bak|old|orig|txt))+$', '\\1')"


@query(f"""SELECT src, CASE WHEN regexp_matches(p, 'draco|basis|stats|vendor/') THEN 'vendor-runtime' WHEN regexp_matches(p, '/(main|app|index)([-.][a-z0-9_-]+)*\\.m?js$') THEN 'business-bootstrap'
WHEN type = 'module' AND regexp_matches(p, '\\.m?js$') THEN 'unknown-module' ELSE 'unknown-script' END AS class, lower(trim(split_part(type, ';', 1))) IN ('', 'module', 'text/javascript', 'application/javascript', 'text/ecmascript', 'application/ecmascript') AS runs
FROM (SELECT src, type, {BARE} AS p FROM {with_rows('src, type', SCRIPTS, f"SELECT '/' || place || {NAMES_OF_SCRIPTS}, {KINDS_OF_SCRIPTS} FROM {OF_PAGES}")})""")
def script_classes(spark, sf_dir):
    """Classes of scripts that pages load, and which types run."""
    rows = spark.createDataFrame(SCRIPTS, "src string, type string").unionByName(rows_of_pages(spark, sf_dir, src=f"'/' || place || {NAMES_OF_SCRIPTS}", type=KINDS_OF_SCRIPTS))
    return rows.select("src", C.script_class(F.col("src"), F.col("type")).alias("class"), C.executable_type(F.col("type")).alias("runs"))


CONTENTS = [("fallback.js", "<!-- saved -->\n<!doctype html><title>x</title>", True), ("payload.js", '{"enabled":true,"items":[1,2,3]}', False), ("broken.html", "error", False), ("page.html", "\n<html lang='en'>", True)]


@query(f"SELECT path, page FROM {values('path, body, page', CONTENTS)} UNION ALL SELECT 'p/' || page_id, regexp_matches(html, '(?is)^\\s*(<!doctype\\s+html\\b|<html(\\s|>))') FROM pages")
def real_pages(spark, sf_dir):
    """Which files are pages; the rest goes aside."""
    own = spark.createDataFrame([c[:2] for c in CONTENTS], "path string, body string")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("body"))
    return own.unionByName(pages).select("path", (C.content_class(F.col("body"), extension=U.extension(F.col("path"))) == "html").alias("page"))


ERROR_PAGES = [
    ("/gone", None, True, "Page unavailable", "", "404 Not Found", True),
    ("/src/css/fonts/Geist", "/error", True, "x", "error-page", "", True),
    ("/about", "/about/", True, "Error handling", "", "404", False),
    ("/about", "/other", False, "Error", "", "", False),
    ("/zh", None, True, "页面不存在", None, None, True),
    ("/fine", None, True, "Terrors", "page-4040", "all is well", False),
]


@query(f"SELECT route, title, error FROM {values('route, canonical, same_site, title, body_class, body, error', ERROR_PAGES)} UNION ALL SELECT '/' || place, {by_id('page_id', '页面不存在', 'All is well')}, page_id % 2 = 0 FROM {OF_PAGES} WHERE place <> ''")
def error_pages(spark, sf_dir):
    """Captured pages that tell of an error."""
    rows = spark.createDataFrame([e[:6] for e in ERROR_PAGES], "route string, canonical string, same_site boolean, title string, body_class string, body string")
    title = by_id("page_id", "页面不存在", "All is well")
    pages = rows_of_pages(spark, sf_dir, route="'/' || place", canonical="CAST(NULL AS STRING)", same_site="true", title=title, body_class="''", body="''").where("route <> '/'")
    return rows.unionByName(pages).select("route", "title", C.error_page(*(F.col(c) for c in ("route", "canonical", "same_site", "title", "body_class", "body"))).alias("error"))


EVENTS = [("a", ["wheel", "click", "pointerdown", "pointerup", "pointermove", "submit"], True, "click,forms,pointer-drag,press-and-hold,scroll"), ("b", ["keydown", "touchmove"], False, "keyboard,scroll,touch"), ("c", [], True, "")]


@query(f"SELECT file, families FROM {values('file, events, timed, families', EVENTS)} UNION ALL SELECT CAST(event_id AS VARCHAR), CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'error' THEN 'keyboard' ELSE 'forms' END FROM events")
def families_of_files(spark, sf_dir):
    """Interaction families of what files listen to."""
    heard = F.expr("array(CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'wheel' WHEN 'error' THEN 'keydown' ELSE 'submit' END)")
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file"), heard.alias("events"), F.lit(False).alias("timed"))
    rows = spark.createDataFrame([e[:3] for e in EVENTS], "file string, events array<string>, timed boolean").unionByName(events)
    no = F.lit(False)
    return rows.select("file", F.array_join(C.interaction_families(F.col("events"), F.col("timed"), no, no, no), ",").alias("families"))


EVIDENT = [("a", ["click", "forms", "scroll", "pointer-drag"], False, False, True, True, "click,scroll,pointer-drag"), ("b", ["media", "keyboard", "navigation"], True, False, False, False, "navigation")]


@query(f"SELECT file, families FROM {values('file, all_of, forms, media, canvas, interactive, families', EVIDENT)} UNION ALL SELECT CAST(event_id AS VARCHAR), CASE WHEN value > 50 THEN 'forms' ELSE 'click' END FROM events")
def evident_families(spark, sf_dir):
    """Interaction families that the interface can show."""
    rows = spark.createDataFrame([e[:6] for e in EVIDENT], "file string, all_of array<string>, forms boolean, media boolean, canvas boolean, interactive boolean")
    dear, no = F.col("value") > 50, F.lit(False)
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file"), F.array(F.lit("click"), F.lit("forms"), F.lit("media")).alias("all_of"), dear.alias("forms"), no.alias("media"), no.alias("canvas"), (~dear).alias("interactive"))
    rows = rows.unionByName(events)
    return rows.select("file", F.array_join(C.evident(F.col("all_of"), F.col("forms"), F.col("media"), F.col("canvas"), F.col("interactive")), ",").alias("families"))


EDITS = [("reports/conversion-manifest.json",), ("reports/repair.json",), ("src/app.jsx",)]


@query(f"SELECT path FROM {with_rows('path', EDITS, "SELECT 'reports/' || event_type || '.json' FROM events")} WHERE path NOT IN ('reports/repair.json', 'reports/click.json')")
def forbidden_report_edits(spark, sf_dir):
    """Edited reports that none may edit."""
    edits = table(spark, sf_dir, "events").select(F.concat(F.lit("reports/"), "event_type", F.lit(".json")).alias("path"))
    return inventory.forbidden_edits(spark.createDataFrame(EDITS, "path string").unionByName(edits), ("reports/repair.json", "reports/click.json"))


@query("SELECT id, redacted FROM (VALUES (0, '__REDACTED_JWT__ x'), (1, 'a __REDACTED_OPENAI_KEY__'), (2, 'AAAA//8EAAQ')) AS v(id, redacted) UNION ALL SELECT 10 + doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'ey' || 'J[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}', '__REDACTED_JWT__', 'g'), 'sk' || '-[A-Za-z0-9_-]{20,}', '__REDACTED_OPENAI_KEY__', 'g'), 'sk' || '_(live|test)_[A-Za-z0-9]{16,}', '__REDACTED_STRIPE_SECRET__', 'g'), 'AI' || 'za[A-Za-z0-9_-]{20,}', '__REDACTED_GOOGLE_API_KEY__', 'g') FROM documents")
def redactions(spark, sf_dir):
    """Texts without their credentials (made of parts, so that no scanner takes them for real ones)."""
    rows = [(0, "eyJ" + "hbGciOiJIUzI1" + "." + "eyJzdWIiOiIx" + "." + "c2lnbmF0dXJl" + " x"), (1, "a sk" + "-" + "a" * 24), (2, "AAAA//8EAAQ")]
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 10).alias("id"), F.col("text").alias("body"))
    return spark.createDataFrame(rows, "id long, body string").unionByName(docs).select("id", X.redacted(F.col("body")).alias("redacted"))


# --- references, sinks and behavior

SOURCES = [
    (-1, "a.js", "fetch('/assets/runtime/config.json'); new Worker(\"./w.js\"); import('x/y.js'); img.src = '/assets/hero.webp?v=1'"),
    (-2, "b.css", "p{background:url(../img/p.png)} @font-face{src:url('/assets/f.woff2')}"),
    (-3, "c.js", "table = {\"./backend/backend.js\": 1}; new Audio('/assets/s.mp3'); loader.load(`/assets/models/missing.glb`)"),
]
BODIES = f"(SELECT page_id AS id, '/p/' || page_id AS path, html AS body FROM pages UNION ALL SELECT id, path, body FROM {values('id, path, body', SOURCES)})"


def of_patterns(patterns: dict[str, str], column: str = "raw") -> str:
    return " UNION ALL ".join(f"SELECT id, {literal(k)} AS kind, unnest(regexp_extract_all(body, {pattern(p)}, {int(S._grouped(p))})) AS {column} FROM {BODIES}" for k, p in patterns.items())


def bodies(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("body"))
    return pages.unionByName(spark.createDataFrame(SOURCES, "id long, path string, body string"))


@query(of_patterns(S.ASSETS))
def asset_references(spark, sf_dir):
    """Assets that pages, scripts and styles name."""
    return bodies(spark, sf_dir).select("id", F.explode(S.asset_names(F.col("body"))).alias("m")).select("id", "m.*")


@query(of_patterns(S.SINKS))
def runtime_sinks(spark, sf_dir):
    """What calls, constructors, assignments and imports load."""
    return bodies(spark, sf_dir).select("id", F.explode(S.sinks(F.col("body"))).alias("m")).select("id", "m.*")


CAPTURED = [("/assets/runtime/config.json",), ("/assets/hero.webp",), ("/assets/f.woff2",), ("/assets/s.mp3",), ("/img/p.png",)]
REFERENCED = f"""SELECT DISTINCT kind, CASE WHEN starts_with(raw, '../') THEN substr(raw, 3) ELSE split_part(split_part(raw, '#', 1), '?', 1) END AS path FROM
(SELECT id, 'runtime-sink' AS kind, raw FROM ({of_patterns(S.SINKS)}) UNION ALL SELECT id, 'static', raw FROM ({of_patterns({'style': S.ASSETS['style']})})) WHERE id < 0 AND (starts_with(raw, '/') OR starts_with(raw, '../'))
UNION ALL SELECT k, d || page_id || e FROM pages, (VALUES ('runtime-sink', '/p/', '.json'), ('static', '/img/', '.png')) AS v(k, d, e)"""
CAPTURED_TOO = "SELECT '/img/' || page_id || '.png' FROM pages WHERE page_id % 2 = 0"


@query(f"SELECT kind, path, kind <> 'runtime-sink' AS blocking FROM ({REFERENCED}) ANTI JOIN {with_rows('path', CAPTURED, CAPTURED_TOO)} USING (path)")
def missing_assets(spark, sf_dir):
    """Named assets without a captured file; what only a script may load does not block."""
    return _missing(spark, sf_dir)


def _missing(spark, sf_dir):
    own = spark.createDataFrame(SOURCES, "id long, path string, body string")
    own = own.unionByName(rows_of_pages(spark, sf_dir, id="page_id", path="place", body="concat('fetch(\\'/p/', page_id, '.json\\'); p{background:url(/img/', page_id, '.png)}')"))
    sinks = own.select(F.lit("runtime-sink").alias("kind"), F.explode(S.sinks(F.col("body"))).alias("m"))
    styles = own.select(F.lit("static").alias("kind"), F.explode(S.matches(F.col("body"), {"style": S.ASSETS["style"]})).alias("m"))
    named = sinks.unionByName(styles).select("kind", F.col("m.raw").alias("raw")).where("startswith(raw, '/') or startswith(raw, '../')")
    named = named.select("kind", F.when(F.startswith("raw", F.lit("../")), F.substring(F.col("raw"), F.lit(3), F.length("raw"))).otherwise(U.without_query(F.col("raw"))).alias("path")).distinct()
    captured = rows_of_pages(spark, sf_dir, path="CASE WHEN page_id % 2 = 0 THEN concat('/img/', page_id, '.png') END").where("path IS NOT NULL")
    return links.unresolved(named, spark.createDataFrame(CAPTURED, "path string").unionByName(captured))


@query(f"SELECT count(*) FILTER (blocking) AS blocking, count(*) FILTER (NOT blocking) AS diagnostic, coalesce(bool_and(NOT blocking), true) AS passed FROM (SELECT kind <> 'runtime-sink' AS blocking FROM ({REFERENCED}) ANTI JOIN {with_rows('path', CAPTURED, CAPTURED_TOO)} USING (path))")
def asset_gate(spark, sf_dir):
    """The gate over missing assets."""
    return links.asset_gate(_missing(spark, sf_dir))


REACHES = [(-9, "d.js", "fetch('https://api.example/v1'); new WebSocket(\"wss://live.example/s\"); a.src = 'https://www.google-analytics.com/x.js'; p{background:url(https://i.example/x.png)}"), (-10, "e.js", "b = '//cdn.example:8080/y?z=1' + \"//[::1]/k\"; // a note\n c = `//10.0.0.7`")]


@query(f"SELECT id, unnest(regexp_extract_all(body, {pattern(S.REMOTE)}, 0)) AS url FROM (SELECT id, body FROM {BODIES} UNION ALL SELECT id, body FROM {values('id, path, body', REACHES)})")
def remote_urls(spark, sf_dir):
    """Remote URLs in pages, scripts and styles, with or without a scheme."""
    rows = bodies(spark, sf_dir).unionByName(spark.createDataFrame(REACHES, "id long, path string, body string"))
    return rows.select("id", F.explode(S.remote_urls(F.col("body"))).alias("url"))


@query(f"SELECT id, kind, raw FROM ({' UNION ALL '.join(f'SELECT id, {literal(k)} AS kind, unnest(regexp_extract_all(body, {pattern(p)}, 1)) AS raw FROM {values('id, path, body', REACHES)}' for k, p in S.LIKELY.items())}) WHERE NOT contains(raw, 'google-analytics.com') UNION ALL SELECT 10 + page_id, k, url FROM pages, (VALUES ('fetch'), ('attribute')) AS k(k) WHERE regexp_matches(url, '^https?://')")
def likely_external_loads(spark, sf_dir):
    """Places where scripts likely load from elsewhere, trackers left out."""
    of_pages = rows_of_pages(spark, sf_dir, id="10 + page_id", path="place", body="concat('fetch(\\'', url, '\\'); x.src = \\'', url, '\\'')")
    rows = spark.createDataFrame(REACHES, "id long, path string, body string").unionByName(of_pages)
    return rows.select("id", F.explode(S.likely_externals(F.col("body"))).alias("m")).select("id", "m.*")


DOES = [
    (-1, "el.addEventListener('Wheel', f); requestAnimationFrame(step); setTimeout(f, 1); new ResizeObserver(f); localStorage.setItem('a', 1); history.pushState({}, '', '/x'); form.submit(); video.play(); c.getContext('webgl2'); new Worker('w.js'); document.querySelector('#a')"),
    (-2, "setInterval(f, 9); document.getElementById('b'); el.addEventListener(\"keydown\", g)"),
]
DOINGS = f"(SELECT page_id AS id, html AS body FROM pages UNION ALL SELECT id, body FROM {values('id, body', DOES)})"
DONE = " UNION ALL ".join(f"SELECT id, {literal(k)} AS kind, unnest(regexp_extract_all(body, {pattern(p)}, 1)) AS raw FROM {DOINGS}" for k, p in S.BEHAVIOR.items())
UNDONE = ", ".join(map(literal, S.UNDONE))
CATEGORIES = [*S.BEHAVIOR, "cleanupRequirements"]


def doings(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("body")).unionByName(spark.createDataFrame(DOES, "id long, body string"))
    return rows.select("id", S.behavior(F.col("body")).alias("entries"))


@query(f"WITH d AS ({DONE}) SELECT id, kind, raw FROM d UNION ALL SELECT id, 'cleanupRequirements', raw FROM d WHERE kind IN ({UNDONE})")
def behavior_inventory(spark, sf_dir):
    """What scripts do, by category, and what must be undone."""
    return doings(spark, sf_dir).select("id", F.explode("entries").alias("e")).select("id", "e.*")


@query(f"WITH d AS ({DONE}), e AS (SELECT kind FROM d UNION ALL SELECT 'cleanupRequirements' FROM d WHERE kind IN ({UNDONE})) SELECT c.category, count(e.kind) AS n FROM {values('category', [(c,) for c in CATEGORIES]).replace('v(', 'c(')} LEFT JOIN e ON e.kind = c.category GROUP BY c.category")
def behavior_totals(spark, sf_dir):
    """Sums of each category over all files."""
    return reports.totals(doings(spark, sf_dir), CATEGORIES)


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def sources_by_language(spark, sf_dir):
    """The sorted union of sources for each language (sources for interaction families)."""
    rows = table(spark, sf_dir, "documents").select("lang", F.array("source").alias("sources"))
    return reports.union_of(rows, ["lang"], "sources").select("lang", F.array_join("sources", ",").alias("sources"))


STYLES = [(1, "a{color:red}\n{!theme!}\n;\nb{margin: auto: ;}", "a{color:red}\n\nb{/* dropped malformed margin declaration */}"), (2, "a{}", "a{}")]


@query(f"SELECT id, css FROM {values('id, raw, css', STYLES)} UNION ALL SELECT 10 + page_id, 'a' || page_id || '{{}}' || chr(10) || chr(10) || 'p{{}}' FROM pages")
def cleaned_styles(spark, sf_dir):
    """Captured style without template lines, malformed declarations and lone semicolons."""
    own = spark.createDataFrame([s[:2] for s in STYLES], "id long, raw string")
    return own.unionByName(rows_of_pages(spark, sf_dir, id="10 + page_id", raw="concat('a', page_id, '{}\\n', 'x {!', page_id, '!} y\\n  ; \\np{}')")).select("id", S.clean_css(F.col("raw")).alias("css"))


SETS = [(1, "a.png 1x,  b.png 2x", "a.png,b.png"), (2, "c.png", "c.png"), (3, " , d.png 300w", "d.png")]


@query(f"SELECT id, urls FROM {values('id, srcset, urls', SETS)} UNION ALL SELECT 10 + page_id, url || ',' || url || '2' FROM pages")
def srcset_candidates(spark, sf_dir):
    """The URLs of srcset attributes."""
    own = spark.createDataFrame([s[:2] for s in SETS], "id long, srcset string")
    return own.unionByName(rows_of_pages(spark, sf_dir, id="10 + page_id", srcset="url || ' 1x,  ' || url || '2 300w'")).select("id", F.array_join(S.srcset_urls(F.col("srcset")), ",").alias("urls"))


MARKUP = [(1, "<link rel='stylesheet icon' href='a.css?x=1&amp;y=2'><link rel=next href=no><script src=b.js></script><img data-src=c.png srcset='d.png 1x, e.png 2x'><p style='background:url(f.png)'>T&amp;x</p>")]
NAMES = [(1, "link", "href", "a.css?x=1&y=2"), (1, "script", "src", "b.js"), (1, "img", "data-src", "c.png"), (1, "img", "srcset", "d.png"), (1, "img", "srcset", "e.png"), (1, "p", "style", "f.png")]


@query(f"SELECT id, tag, attribute, raw FROM {values('id, tag, attribute, raw', NAMES)} UNION ALL SELECT 10 + page_id, t, a, split_part(url, '?', 1) || e FROM pages, (VALUES ('img', 'src', ''), ('div', 'style', '2'), ('img', 'srcset', '3')) AS v(t, a, e)")
def markup_assets(spark, sf_dir):
    """Assets that markup names."""
    u = "split(url, '[?]')[0]"
    of_pages = rows_of_pages(spark, sf_dir, id="10 + page_id", html=f"concat('<a href=x><img src=\"', {u}, '\"><div style=\"b:url(', {u}, '2)\"><img srcset=\"', {u}, '3 2x\">')")
    return spark.createDataFrame(MARKUP, "id long, html string").unionByName(of_pages).select("id", F.explode(H.asset_references(F.col("html"))).alias("a")).select("id", "a.*")


SHOWN = "replace(replace(replace(replace(replace(regexp_replace(replace(html, '\"</p>\"', chr(1)), '<[^>]*>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(1), '\"</p>\"')"


@query(f"SELECT 1 AS id, 'T&x' AS body UNION ALL SELECT 2, 'ab' UNION ALL SELECT 10 + page_id, {SHOWN} FROM pages")
def markup_text(spark, sf_dir):
    """The text of markup, entities decoded."""
    own = spark.createDataFrame([*MARKUP, (2, "a<br>b")], "id long, html string")
    return own.unionByName(rows_of_pages(spark, sf_dir, id="10 + page_id", html="html")).select("id", H.text_content(F.col("html")).alias("body"))


# --- lookups, sums and choices of reports

LOADERS = [("assets/boot.js", ["assets/app.7.js", "assets/lib.js", "assets/gone.js"])]
FACTS = [("assets/app.7.js", True, False, False), ("assets/lib.js", False, False, False)]


@query(f"""SELECT l.path, l.target, f.path IS NOT NULL AS "exists", CASE WHEN f.path IS NULL THEN 'missing' WHEN f.a OR f.b OR f.c THEN 'application-bootstrap' ELSE 'runtime-script' END AS class
FROM (SELECT path, unnest(targets) AS target FROM {with_rows('path, targets', LOADERS, "SELECT 'p/' || page_id, ['assets/lib.js', 'assets/' || page_id % 9 || '.js'] FROM pages")}) l LEFT JOIN {with_rows('path, a, b, c', FACTS, "SELECT 'assets/' || page_id || '.js', page_id = 1, false, page_id = 2 FROM pages")} f ON f.path = l.target""")
def loader_targets(spark, sf_dir):
    """The scripts that loaders load, looked up; missing where none is captured."""
    scripts = spark.createDataFrame(FACTS, "path string, touches_dom boolean, creates_worker boolean, has_canvas boolean")
    scripts = scripts.unionByName(rows_of_pages(spark, sf_dir, path="concat('assets/', page_id, '.js')", touches_dom="page_id = 1", creates_worker="false", has_canvas="page_id = 2"))
    loaders = rows_of_pages(spark, sf_dir, path="concat('p/', page_id)", targets="array('assets/lib.js', concat('assets/', page_id % 9, '.js'))")
    return lookups.targets_of(spark.createDataFrame(LOADERS, "path string, targets array<string>").unionByName(loaders), scripts)


@query("""WITH a AS (SELECT conv_id || '/' || turn AS id, text AS state FROM conversations WHERE conv_id % 5 <> 0), b AS (SELECT conv_id || '/' || turn AS id, CASE WHEN turn % 3 = 0 THEN upper(text) ELSE text END AS state FROM conversations WHERE conv_id % 5 <> 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing-local' WHEN a.id IS NULL THEN 'missing-source' WHEN a.state IS NOT DISTINCT FROM b.state THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b ON a.id = b.id""")
def checkpoint_results(spark, sf_dir):
    """Checkpoints of two runs compared (turns of conversations for checkpoints)."""
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    local = c.where("conv_id % 5 <> 1").select("id", F.when(F.col("turn") % 3 == 0, F.upper("text")).otherwise(F.col("text")).alias("state"))
    return lookups.checkpoint_results(c.where("conv_id % 5 <> 0").select("id", F.col("text").alias("state")), local)


@query("SELECT e.lang AS environment, s.event_type AS scenario, (SELECT count(*) FROM documents d JOIN events v ON v.event_id = d.doc_id WHERE d.lang = e.lang AND v.event_type = s.event_type) AS n FROM (SELECT DISTINCT lang FROM documents) e, (SELECT DISTINCT event_type FROM events) s")
def run_grid(spark, sf_dir):
    """How many results each environment and scenario has (languages and event types for them)."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    ran = d.join(e, d.doc_id == e.event_id).select(F.col("lang").alias("environment"), F.col("event_type").alias("scenario"))
    return lookups.grid(d.select(F.col("lang").alias("environment")), e.select(F.col("event_type").alias("scenario")), ran)


KEPT_PAGES = "SELECT split_part(split_part(url, '#', 1), '?', 1), 'p' || min(page_id) FROM pages WHERE page_id % 3 > 0 GROUP BY 1"
COPIES = [("https://a.example/x.js?v=1", "x.q1.js"), ("https://a.example/x.js", "x.js")]
ASKED = [("https://a.example/x.js?v=1",), ("https://a.example/x.js?v=2",), ("https://a.example/y.js",)]


@query(f"SELECT u.url, coalesce(a.kept, b.kept) AS kept_as FROM {with_rows('url', ASKED, 'SELECT url FROM pages')} u LEFT JOIN {with_rows('url, kept', COPIES, KEPT_PAGES)} a ON a.url = u.url LEFT JOIN {with_rows('url, kept', COPIES, KEPT_PAGES)} b ON b.url = split_part(split_part(u.url, '#', 1), '?', 1)")
def local_copies(spark, sf_dir):
    """Copies of remote files, by the whole URL, else by the one without its query."""
    pages = table(spark, sf_dir, "pages")
    kept = pages.where("page_id % 3 > 0").groupBy(U.without_query(F.col("url")).alias("key")).agg(F.concat(F.lit("p"), F.min("page_id").cast("string")).alias("kept_as"))
    copies = spark.createDataFrame(COPIES, "key string, kept_as string").unionByName(kept)
    return lookups.local_copies(spark.createDataFrame(ASKED, "url string").unionByName(pages.select("url")), copies, U.without_query(F.col("url")))


@query(f"""WITH p AS (SELECT min(page_id) AS page, regexp_extract({URL_PATH}, '^/([^/]*)', 1) AS route FROM pages GROUP BY route)
SELECT s.src, p.page, coalesce(p.page % 2 = 0, false) AS reached FROM (VALUES ('a.js', 'en'), ('b.js', 'de'), ('c.js', 'none')) AS s(src, route) LEFT JOIN p ON p.route = s.route""")
def legacy_script_pages(spark, sf_dir):
    """The page of each legacy script's route and whether it is reached (first path parts for routes, even ids for reached ones)."""
    pages = table(spark, sf_dir, "pages").groupBy(F.regexp_extract(U.path(F.col("url")), "^/([^/]*)", 1).alias("route")).agg(F.min("page_id").alias("page"))
    scripts = spark.createDataFrame([("a.js", "en"), ("b.js", "de"), ("c.js", "none")], "src string, route string")
    return lookups.pages_of_scripts(scripts, pages, pages.where("page % 2 = 0").select(F.col("page").alias("node")))


@query("SELECT e.event_type, k.rank, count(*) AS n FROM events e JOIN (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('error', 4), ('signup', 5), ('refund', 6)) AS k(event_type, rank) USING (event_type) GROUP BY ALL")
def known_kinds(spark, sf_dir):
    """Events by kind; a kind that the profile does not know is an error."""
    known = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 3), ("error", 4), ("signup", 5), ("refund", 6)], "event_type string, rank int")
    return lookups.joined_known(table(spark, sf_dir, "events"), known, "event_type").groupBy("event_type", "rank").agg(F.count("*").alias("n"))


@query("SELECT greatest((SELECT max(coalesce(nullif(c, 0), nullif(a, 0), 1)) FROM (VALUES ('click', 3, 9), ('click', 0, 5), ('view', 99, 0)) AS v(s, c, a) WHERE s = 'click'), (SELECT count(*) FROM events WHERE event_type = 'click' AND value > 99)) AS failures")
def parity_failures(spark, sf_dir):
    """The most failures that gates or the history of a stage tell of (clicks for the stage, values over 99 for failures)."""
    gates = spark.createDataFrame([("click", 3, 9), ("click", 0, 5), ("view", 99, 0)], "stage string, consecutive int, attempts int")
    history = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") > 99, "failed").otherwise("passed").alias("event"))
    return reports.most_failures(gates, history, "click")


@query("SELECT user_id AS round, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL")
def round_counts(spark, sf_dir):
    """Outcomes of each round (users for rounds)."""
    return reports.per_round(table(spark, sf_dir, "events").withColumnRenamed("user_id", "round"), "event_type")


PAGE_INDEX = by_id("page_id", "a.example/", "b.example/", "a.example_") + " || place || '/index.html'"
INDEXES = [("a.example_2/index.html",), ("a.example/deep/index.html",), ("other/index.html",), ("a.example/b/index.html",)]


@query(f"SELECT path FROM {with_rows('path', INDEXES, f'SELECT {PAGE_INDEX} FROM {OF_PAGES}')} ORDER BY CASE WHEN path = 'a.example/index.html' THEN 0 WHEN starts_with(path, 'a.example/') THEN 1 WHEN starts_with(path, 'a.example_') THEN 2 ELSE 3 END, len(string_split(path, '/')), length(path), path LIMIT 1")
def best_index(spark, sf_dir):
    """The index file that a capture begins with."""
    return reports.best_index(spark.createDataFrame(INDEXES, "path string").unionByName(rows_of_pages(spark, sf_dir, path=PAGE_INDEX)), "a.example")


@query("SELECT doc_id, source || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END AS \"unique\" FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def unique_names(spark, sf_dir):
    """Names with a number where they repeat (sources for component names)."""
    return reports.unique_names(table(spark, sf_dir, "documents"), "source", "doc_id").select("doc_id", "unique")


FINDINGS = [(1, "BUILD", ["code", "stdout", "at"], ["x", "noise", "1"]), (2, "BUILD", ["at", "code"], ["2", "x"]), (3, "PROOF", ["code"], ["x"]), (4, "BUILD", ["code"], ["y"])]


@query(f"""SELECT id, sha256(stage || chr(10) || (SELECT string_agg(k || '=' || v, chr(10) ORDER BY k) FROM (SELECT unnest(ks) AS k, unnest(vs) AS v) WHERE k NOT IN ('stdout', 'stderr', 'recordedAt', 'at', 'durationMs'))) AS signature FROM {values('id, stage, ks, vs', FINDINGS)} UNION ALL SELECT 10 + event_id, sha256('RUN' || chr(10) || 'code=' || event_type) FROM events""")
def failure_signatures(spark, sf_dir):
    """Signatures of failures, the same for runs that differ in times and output only."""
    events = table(spark, sf_dir, "events").select((F.col("event_id") + 10).alias("id"), F.lit("RUN").alias("stage"), F.array(F.lit("durationMs"), F.lit("code"), F.lit("at")).alias("ks"), F.array(F.col("value").cast("string"), "event_type", F.col("ts").cast("string")).alias("vs"))
    rows = spark.createDataFrame(FINDINGS, "id long, stage string, ks array<string>, vs array<string>").unionByName(events)
    return rows.select("id", reports.failure_signature(F.col("stage"), F.map_from_arrays("ks", "vs")).alias("signature"))


@query("SELECT 1 AS id, 'delay=5,retries=2,width=800' AS options UNION ALL SELECT 2, 'delay=1,retries=3,width=800' UNION ALL SELECT 10 + event_id, 'at=' || user_id || ',delay=' || event_type || ',retries=3,width=800' FROM events")
def merged_options(spark, sf_dir):
    """Options of scenarios over their defaults."""
    rows = spark.createDataFrame([(1, {"delay": "5", "retries": "2"}), (2, {})], "id long, given map<string,string>")
    rows = rows.unionByName(table(spark, sf_dir, "events").select((F.col("event_id") + 10).alias("id"), F.create_map(F.lit("delay"), "event_type", F.lit("at"), F.col("user_id").cast("string")).alias("given")))
    defaults = F.create_map(*[F.lit(x) for x in ("delay", "1", "retries", "3", "width", "800")])
    entries = F.array_sort(F.map_entries(reports.merged(defaults, F.col("given"))))
    return rows.select("id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("options"))


@query("SELECT conv_id, turn FROM conversations c WHERE turn >= (SELECT min(turn) FROM conversations g WHERE g.conv_id = c.conv_id AND role = 'assistant')")
def invalidated_stages(spark, sf_dir):
    """Stages from a changed one on (turns for stages, the first assistant's for the changed one)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("stage"))
    return sequences.invalidated_from(c, "conv_id", "assistant").select("conv_id", F.col("ord").alias("turn"))


ACTIONS = [(1, 1, "checkpoint", False), (1, 2, "wheel", True), (1, 3, "wait", False), (1, 4, "checkpoint", False), (1, 5, "hold", False), (2, 1, "wheel", False), (2, 2, "checkpoint", False)]


ACTED = "SELECT 10 + user_id AS scenario, CAST(event_id AS INT) AS place, CASE event_type WHEN 'view' THEN 'checkpoint' WHEN 'click' THEN 'wheel' ELSE 'wait' END AS kind FROM events"
NEXT_TO = "{0}(nullif(kind, 'wait') IGNORE NULLS) OVER (PARTITION BY scenario ORDER BY place ROWS BETWEEN {1}) = 'checkpoint'"
BETWEEN = f"coalesce({NEXT_TO.format('last_value', 'UNBOUNDED PRECEDING AND 1 PRECEDING')} AND {NEXT_TO.format('first_value', '1 FOLLOWING AND UNBOUNDED FOLLOWING')}, false)"


@query(f"SELECT scenario, place, kind, bracketed FROM {values('scenario, place, kind, bracketed', ACTIONS)} UNION ALL SELECT scenario, place, kind, {BETWEEN} FROM ({ACTED})")
def bracketed_actions(spark, sf_dir):
    """Which actions stand between two checkpoints."""
    kind = F.when(F.col("event_type") == "view", "checkpoint").when(F.col("event_type") == "click", "wheel").otherwise("wait")
    events = table(spark, sf_dir, "events").select((F.col("user_id") + 10).alias("scenario"), F.col("event_id").cast("int").alias("place"), kind.alias("kind"))
    own = spark.createDataFrame([a[:3] for a in ACTIONS], "scenario long, place int, kind string")
    return sequences.bracketed(own.unionByName(events), "scenario", "place").select("scenario", "place", "kind", "bracketed")


SEEDS = [("", 2166136261), ("a", (2166136261 ^ 97) * 16777619 % 2**32), ("ab", (((2166136261 ^ 97) * 16777619 % 2**32) ^ 98) * 16777619 % 2**32)]


STEP = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(key, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296)"


@query(f"SELECT key, CAST(seed AS BIGINT) AS seed FROM {values('key, seed', SEEDS)} UNION ALL SELECT key, CAST({STEP} AS BIGINT) FROM (SELECT source || '/' || doc_id AS key FROM documents)")
def proof_seeds(spark, sf_dir):
    """32-bit seeds of keys."""
    keys = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"))
    return spark.createDataFrame([s[:1] for s in SEEDS], "key string").unionByName(keys).select("key", comparison.seed_of(2166136261, F.col("key")).alias("seed"))


@query("SELECT page_id, regexp_extract(html, '<body class=\"([^\"]*)\"', 1) AS body_class, coalesce(nullif(regexp_extract(html, '<html[^>]* dir=\"([^\"]*)\"', 1), ''), 'ltr') AS dir, regexp_extract(html, '<meta name=\"viewport\" content=\"([^\"]*)\"', 1) AS viewport FROM pages")
def page_settings(spark, sf_dir):
    """Direction, viewport and body class of each page, as marked up."""
    take = lambda p: F.regexp_extract("html", p, 1)
    direction = take('<html[^>]* dir="([^"]*)"')
    return table(spark, sf_dir, "pages").select("page_id", take('<body class="([^"]*)"').alias("body_class"), F.when(direction == "", F.lit("ltr")).otherwise(direction).alias("dir"), take('<meta name="viewport" content="([^"]*)"').alias("viewport"))


# --- more of scripts, links and reports

TALKS = [
    (1, "fetch('https://api.example/v1'); window.open(\"https://shop.example/\"); x.src = '//cdn.example/a.js'; ns = 'http://www.w3.org/2000/svg'; base = 'https://unused.example/b'"),
    (2, "location.href = 'https://other.example/'; new WebSocket('wss://live.example/s'); d = \"http://localhost:4173/dev\""),
    (3, "var t = 1;"),
]


def talks(spark, sf_dir):
    """Scripts of their own, and one for each page that loads its URL, follows another and names a third."""
    body = "concat('fetch(\\'', url, '\\'); window.open(\\'', url, '~\\'); a = \\'', url, '!\\'')"
    return spark.createDataFrame(TALKS, "id long, body string").unionByName(rows_of_pages(spark, sf_dir, id="10 + page_id", body=body))


def found_in(patterns: dict[str, str]) -> str:
    return " || ".join(f"regexp_extract_all(body, {pattern(p)}, 1)" for p in patterns.values())


@query(f"""WITH t AS (SELECT id, body, unnest(list_distinct(regexp_extract_all(body, {pattern(S.LITERAL)}, 1))) AS url FROM {values('id, body', TALKS)})
SELECT id, url, CASE WHEN {' OR '.join(f'starts_with(url, {literal(p)})' for p in U.INERT)} OR regexp_matches(url, '//localhost') THEN 'inert' WHEN list_contains({found_in(S.AUTOMATIC)}, url) THEN 'automatic' WHEN list_contains({found_in(S.NAVIGATION)}, url) THEN 'navigation' ELSE 'unknown' END AS class FROM t UNION ALL SELECT 10 + page_id, url || e, c FROM pages, (VALUES ('', 'automatic'), ('~', 'navigation'), ('!', 'unknown')) AS v(e, c)""")
def network_findings(spark, sf_dir):
    """Remote URLs that scripts quote: loaded at once, followed, inert, or unknown."""
    return talks(spark, sf_dir).select("id", F.explode(S.network_findings(F.col("body"))).alias("f")).select("id", "f.*")


@query(f"""WITH t AS (SELECT id, body, unnest(list_distinct(regexp_extract_all(body, {pattern(S.LITERAL)}, 1))) AS url FROM {values('id, body', TALKS)}), c AS (SELECT list_contains({found_in(S.AUTOMATIC)}, url) AS a FROM t UNION ALL SELECT true FROM pages)
SELECT count(*) FILTER (a) AS automatic, count(*) FILTER (a) = 0 AS passed FROM c""")
def no_external_gate(spark, sf_dir):
    """The gate over what loads from elsewhere at once."""
    found = talks(spark, sf_dir).select(F.explode(S.network_findings(F.col("body"))).alias("f")).where("f.class = 'automatic'")
    return found.agg(F.count("*").alias("automatic")).select("automatic", (F.col("automatic") == 0).alias("passed"))


CODE = [(1, "a = 'x // y'; // note\n/* fetch('z') */ b = `t`;"), (2, 'render() { /* later */ return "a \\" b"; }')]


@query(f"SELECT id, regexp_replace(code, {pattern(S.UNREAD)}, ' ', 'g') AS masked FROM {values('id, code', CODE)} UNION ALL SELECT 10 + page_id, 'a' || page_id || ' =  ; b =   + 1;  ' FROM pages")
def masked_code(spark, sf_dir):
    """Scripts without comments and quoted text."""
    pages = rows_of_pages(spark, sf_dir, id="10 + page_id", code="concat('a', page_id, ' = \\'', url, '\\'; b = \"x // y\" + 1; // ', page_id)")
    return spark.createDataFrame(CODE, "id long, code string").unionByName(pages).select("id", S.masked(F.col("code")).alias("masked"))


ENGINES = [(1, "class E { start() { this.run(1); } stop() { /* none */ } }", "this.run(1);"), (2, "e.start() { x }", None), (3, "start(a, b)\n{\n  go();\n  on(); }", "go(); on();")]


ENGINE_OF_PAGE = "concat('class E { restart() { no(); } start(a) { if (a) { go(', page_id, '); /* } */ } s = \\'}\\'; u = \\'', url, '\\'; } stop() { } }')"
BODY_OF_PAGE = "'if (a) { go(' || page_id || '); } s = ' || chr(39) || '}' || chr(39) || '; u = ' || chr(39) || url || chr(39) || ';'"


@query(f"SELECT id, body FROM {values('id, code, body', ENGINES)} UNION ALL SELECT 10 + page_id, {BODY_OF_PAGE} FROM pages")
def method_bodies(spark, sf_dir):
    """Bodies of the method that starts an engine."""
    own = spark.createDataFrame([e[:2] for e in ENGINES], "id long, code string")
    return own.unionByName(rows_of_pages(spark, sf_dir, id="10 + page_id", code=ENGINE_OF_PAGE)).select("id", S.method_body(F.col("code"), "start").alias("body"))


QUOTED = [(1, "caf\\u00e9\\tx", "café\tx"), (2, 'say \\"hi\\"', 'say "hi"'), (3, 'plain "x"', 'plain "x"'), (4, "bad \\u00", None)]


@query(f"SELECT id, body FROM {values('id, raw, body', QUOTED)} UNION ALL SELECT 10 + doc_id, text FROM documents")
def decoded_literals(spark, sf_dir):
    """What quoted literals stand for."""
    quoted = F.to_json(F.struct("text"))  # {"text":"..."}
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 10).alias("id"), F.substring(quoted, F.lit(10), F.length(quoted) - 11).alias("raw"))
    return spark.createDataFrame([q[:2] for q in QUOTED], "id long, raw string").unionByName(docs).select("id", S.decoded_literal(F.col("raw")).alias("body"))


PAGE_PATH = "coalesce(nullif(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^(?i:https?:)?//[^/?#]+(/.*)$', 1), ''), '/')"
PAGE_HOST = "regexp_extract(url, '^(?i:https?:)?//([^/?#]+)', 1)"


@query(f"""WITH p AS (SELECT page_id, {PAGE_HOST} AS host, {PAGE_PATH} AS path, html FROM pages), r AS (SELECT page_id, host, unnest(regexp_extract_all(html, '(?:src|href|poster|data)=["'']([^"'']*)["'']', 1)) AS raw FROM p),
n AS (SELECT page_id, host, raw, split_part(split_part(raw, '#', 1), '?', 1) AS path FROM r WHERE starts_with(raw, '/') AND NOT starts_with(raw, '//'))
SELECT page_id, path AS route, regexp_extract(split_part(raw, '#', 1), '(\\?.*)$', 1) AS search, regexp_extract(raw, '(#.*)$', 1) AS hash FROM n WHERE EXISTS (SELECT 1 FROM p WHERE p.host = n.host AND p.path = n.path)""")
def internal_links(spark, sf_dir):
    """Links that lead to a captured page, in parts."""
    return links.internal_links(table(spark, sf_dir, "pages"))


@query(f"SELECT route, array_to_string(list_sort(list(page_id)), ',') AS pages FROM (SELECT page_id, regexp_extract({PAGE_PATH}, '^/([^/]*)', 1) AS route FROM pages) GROUP BY route")
def pages_by_route(spark, sf_dir):
    """All pages of each first part of a path."""
    return links.pages_by_route(table(spark, sf_dir, "pages")).select("route", F.array_join("pages", ",").alias("pages"))


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY lang")
def distinct_counts(spark, sf_dir):
    """Distinct sources and sizes for each language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct("n_chars").alias("sizes"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') = '7' AS same FROM events")
def parsed_reports(spark, sf_dir):
    """Event properties read as JSON, and whether they equal a given record (properties for reports)."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    given = F.from_json(F.lit('{ "k" : 7 }'), "k int")
    return rows.select("event_id", "p.k", (F.to_json("p") == F.to_json(given)).alias("same"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents")
def decoded_texts(spark, sf_dir):
    """Files read as UTF-8 (documents, as the bytes that they have in a file)."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.col("text"), "UTF-8").alias("content"))
    return texts(files)


WHITE = "[\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


@query(f"""WITH a AS (SELECT page_id AS ix, sha256(lower(trim(regexp_replace(html, '{WHITE}', ' ', 'g')))) AS d FROM pages), b AS (SELECT CAST(floor(ix / 4096) AS BIGINT) AS ix, sha256(string_agg(d, '' ORDER BY ix)) AS d FROM a GROUP BY 1),
c AS (SELECT CAST(floor(ix / 4096) AS BIGINT) AS ix, sha256(string_agg(d, '' ORDER BY ix)) AS d FROM b GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY ix)) AS evidence FROM c""")
def evidence_digest(spark, sf_dir):
    """One digest of all pages' normalized text in order, through a tree of digests."""
    pages = table(spark, sf_dir, "pages")
    return inventory.ordered_fingerprint(pages, "page_id", F.sha2(X.normalized(F.col("html")), 256)).withColumnRenamed("fingerprint", "evidence")


REWRITES = [(1, "load('a.js', 'b.js')", [(6, 10, "x"), (14, 18, "yy")], "load('x', 'yy')"), (2, "é😀z", [(1, 2, "*"), (0, 2, "!")], "!z"), (3, "same", [], "same")]


@query(f"SELECT id, body FROM {values('id, body', [(r[0], r[3]) for r in REWRITES])} UNION ALL SELECT 10 + doc_id, '<' || substr(text, 1, 3) || '*' || substr(text, 6) FROM documents WHERE length(text) > 9")
def applied_edits(spark, sf_dir):
    """Texts with edits made at their places."""
    rows = spark.createDataFrame([r[:3] for r in REWRITES], "id int, raw string, edits array<struct<start:int,end:int,value:string>>")
    edit = lambda a, b, v: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(v).alias("value"))
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 9).select((F.col("doc_id") + 10).alias("id"), F.col("text").alias("raw"), F.array(edit(3, 5, "*"), edit(0, 0, "<"), edit(4, 7, "no")).alias("edits"))
    rows = rows.withColumn("id", F.col("id").cast("long")).unionByName(docs)
    return rows.select("id", X.edited(F.col("raw"), F.col("edits")).alias("body"))


NESTED = [(1, '{"a": ["x", {"b": "y", "c": [["z"], 3, null]}], "d": true}'), (2, '"top"'), (3, "no json"), (4, "[]")]


@query("SELECT id, body FROM (VALUES (1, 'x'), (1, 'y'), (1, 'z'), (2, 'top')) AS v(id, body) UNION ALL SELECT 10 + doc_id, unnest([lang, source, lang]) FROM documents")
def deep_strings(spark, sf_dir):
    """Every string of nested records."""
    inner = F.struct(F.array(F.struct("source", F.col("n_chars").alias("n")), F.struct(F.col("lang").alias("source"), F.lit(1).alias("n"))).alias("x"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 10).alias("id"), F.to_json(F.struct("lang", inner.alias("deep"))).alias("raw"))
    return reports.deep_strings(spark.createDataFrame(NESTED, "id long, raw string").unionByName(docs), "id", "raw").withColumnRenamed("text", "body")


@query(f"SELECT count(DISTINCT {PAGE_PATH}) AS routes, count(*) AS pages, CAST(coalesce(sum(len(regexp_extract_all(html, '<script[^>]*>'))), 0) AS BIGINT) AS scripts, count(*) FILTER (regexp_extract(html, '<title>([^<]*)</title>', 1) = '') AS untitled FROM pages")
def site_summary(spark, sf_dir):
    """Routes, pages, scripts and untitled pages of all that was captured."""
    scripts = F.regexp_extract_all("html", F.lit("<script[^>]*>"), F.lit(0))
    return reports.site_summary(table(spark, sf_dir, "pages"), U.path(F.col("url")), scripts, F.regexp_extract("html", "<title>([^<]*)</title>", 1))


@query("SELECT id, missing FROM (VALUES (1, 'stop,resize'), (2, 'start,stop,resize'), (3, 'stop,resize')) AS v(id, missing) UNION ALL SELECT 10 + page_id, 'stop,resize' FROM pages")
def engine_gate(spark, sf_dir):
    """Methods that engines lack or leave empty."""
    own = spark.createDataFrame([e[:2] for e in ENGINES], "id long, code string")
    rows = own.unionByName(rows_of_pages(spark, sf_dir, id="10 + page_id", code=ENGINE_OF_PAGE))
    return reports.lacking(rows, {n: S.method_body(F.col("code"), n) for n in ("start", "stop", "resize")})


TAGS = ("main", "canvas", "button", "input", "form", "section", "a")


@query(f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<({'|'.join(TAGS)})[ >]', 1)) AS tag FROM pages) GROUP BY ALL")
def interface_elements(spark, sf_dir):
    """Elements that make each page's interface."""
    tags = F.regexp_extract_all("html", F.lit(f"<({'|'.join(TAGS)})[ >]"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
