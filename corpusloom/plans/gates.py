"""Queries over whole gates: baselines, traces of runs, delivered files, oracles, conversion, delivery. Rows of given tables stand for files and runs; what they are like follows from their numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import classify as C
from corpusloom.functions import url as U
from corpusloom.operators import conversion, delivery, gates, provenance, reports
from corpusloom.plans.captures import HOST, PATH, PLAIN, of_any_size
from corpusloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "source", F.coalesce("text", F.lit("")).alias("text"))


def inventory(rows: DataFrame, path: str, changed: str, where: str = "true", by: tuple[str, ...] = ()) -> DataFrame:
    """by, path, sha256 of the documents of a condition; the text has a line more where `changed` holds."""
    return rows.where(where).select(*by, F.expr(path).alias("path"), F.sha2(F.concat("text", F.when(F.expr(changed), "\n").otherwise("")), 256).alias("sha256"))


# --- strings at any depth


@query("""SELECT page_id, unnest(list_concat([sha256(url), sha256(html), sha256('q"' || chr(92) || html)], list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: sha256(h)))) AS digest FROM pages""")
def page_strings(spark, sf_dir):
    """The digest of every string in a nested record of each page: its address, markup with quotes and line ends, and links."""
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.struct(F.lit(1).alias("n"), F.array(F.struct(h.alias("href"))).alias("url")))
    record = F.to_json(F.struct("url", F.struct("html", links.alias("links"), F.array(F.array(F.concat(F.lit('q"\\'), "html"))).alias('k"')).alias("deep")))
    found = reports.deep_strings(table(spark, sf_dir, "pages").select("page_id", record.alias("raw")), "page_id", "raw")
    return found.select("page_id", F.sha2("text", 256).alias("digest"))


# --- baselines and traces

STYLE_PATH = "CASE WHEN i % 3 = 0 THEN 'src/s' || i || '.CSS' WHEN i % 3 = 1 THEN 'src/s' || i || '.css' ELSE 'src/s' || i || '.ts' END"
STYLES = "SELECT i, source, path, i % 5 <> 0 AS was, i % 7 <> 0 AS now, i % 11 = 0 AS changed FROM d WHERE i % 3 < 2 AND (i % 5 <> 0 OR i % 7 <> 0)"
STYLES = f"WITH d AS (SELECT *, {STYLE_PATH} AS path FROM (SELECT doc_id AS i, source FROM documents)), s AS ({STYLES})"


def styles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    now = inventory(docs, STYLE_PATH, "i % 11 = 0", "i % 7 <> 0", ("source",))
    return now, inventory(docs, STYLE_PATH, "false", "i % 5 <> 0", ("source",))


@query(f"{STYLES} SELECT source, path, CASE WHEN NOT was THEN 'untracked' WHEN NOT now THEN 'missing' ELSE 'modified' END AS finding FROM s WHERE NOT (was AND now AND NOT changed)")
def style_findings(spark, sf_dir):
    """Styles of each source (a project) that differ from their baseline."""
    return gates.baseline_findings(*styles(spark, sf_dir), by=["source"])


@query(f"""{STYLES}, g AS (SELECT source, count(*) FILTER (now) AS checked, count(*) FILTER (was AND now AND changed) AS modified, count(*) FILTER (NOT was) AS untracked, count(*) FILTER (NOT now) AS missing, NOT bool_or(was) AS baseline_missing FROM s GROUP BY source)
SELECT *, NOT baseline_missing AND modified + untracked + missing = 0 AS passed FROM g""")
def style_gate(spark, sf_dir):
    """The gate of each source's styles; some sources have no baseline."""
    return gates.baseline_gate(*styles(spark, sf_dir), by=["source"])


RUN_PATH = "CASE i % 6 WHEN 0 THEN 'react/src/a' || i || '.ts' WHEN 1 THEN 'react/reports/r' || i || '.json' WHEN 2 THEN 'react/src/node_modules/m' || i WHEN 3 THEN 'react/srcs/' || i WHEN 4 THEN 'react/public/dist/' || i ELSE 'react/package.json/' || i END"
TRACE = f"""WITH f AS (SELECT doc_id AS i, source, regexp_replace({RUN_PATH.replace(" i ", " doc_id ").replace("|| i", "|| doc_id")}, '/r[0-9]*9[.]json$', '/proof-profile.json') AS path, lang FROM documents),
h AS (SELECT source, path, max(CASE WHEN i % 5 <> 0 THEN lpad(CAST(i AS VARCHAR), 12, '0') END) AS was, max(CASE WHEN i % 7 <> 0 THEN lpad(CAST(i AS VARCHAR), 12, '0') || CASE WHEN i % 3 = 0 THEN 'x' ELSE '' END END) AS start, max(CASE WHEN i % 11 <> 0 THEN lpad(CAST(i AS VARCHAR), 12, '0') || CASE WHEN i % 2 = 0 THEN 'x' ELSE '' END END) AS fin FROM f WHERE i % 6 IN (0, 1, 5) GROUP BY ALL),
c AS (SELECT source, path, 'outside' AS made_by, was AS a, start AS b FROM h WHERE EXISTS (SELECT 1 FROM f WHERE f.source IS NOT DISTINCT FROM h.source AND i % 5 <> 0) UNION ALL SELECT source, path, 'pipeline', start, fin FROM h),
s AS (SELECT source, path, made_by, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'modified' END AS status FROM c WHERE a IS DISTINCT FROM b)
SELECT *, status = 'modified' AND starts_with(path, 'react/reports/') AND NOT ends_with(path, '/proof-profile.json') AS forbidden FROM s"""


@query(TRACE)
def run_changes(spark, sf_dir):
    """What changed between and within the runs of each source, and reports that should not have; documents with one path are one file."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "source")
    path = f"regexp_replace({RUN_PATH}, '/r[0-9]*9[.]json$', '/proof-profile.json')"
    of = lambda where, more: docs.where(where).select("source", F.expr(path).alias("path"), F.expr(f"lpad(CAST(i AS STRING), 12, '0') || CASE WHEN {more} THEN 'x' ELSE '' END").alias("sha256"))
    return gates.run_changes(of("i % 5 <> 0", "false"), of("i % 7 <> 0", "i % 3 = 0"), of("i % 11 <> 0", "i % 2 = 0"), by=["source"])


# --- delivered files and the oracle

PUBLIC = "CASE i % 5 WHEN 0 THEN '_external/x' || i || '.png' WHEN 1 THEN 'legacy/' || i || '.js' WHEN 2 THEN 'a/' || i || '.MJS' ELSE 'a/' || i || '.png' END"
CHECKED = """SELECT CASE WHEN i % 13 = 0 THEN NULL WHEN NOT (i % 3 <> 0 OR i % 5 = 0 AND i % 2 = 0) THEN 'uncaptured' WHEN i % 5 <> 2 AND (i % 3 <> 0 AND i % 7 = 0 OR i % 3 = 0 AND i % 11 = 0) THEN 'mismatched' END AS finding, {0} AS path FROM (SELECT doc_id AS i FROM documents) WHERE i % 5 <> 1""".format(PUBLIC)


def delivered(spark, sf_dir) -> tuple[DataFrame, ...]:
    docs = documents(spark, sf_dir)
    site, mirror = inventory(docs, PUBLIC, "i % 7 = 0", "i % 3 <> 0"), inventory(docs, "substr(" + PUBLIC + ", 11)", "i % 11 = 0", "i % 5 = 0 AND i % 2 = 0")
    return inventory(docs, PUBLIC, "false"), site, mirror, docs.where("i % 13 = 0").select(F.expr(PUBLIC).alias("path"))


@query(f"SELECT path, finding FROM ({CHECKED})")
def public_findings(spark, sf_dir):
    """Delivered files (documents) that were not captured, or have other bytes than what was."""
    return gates.public_findings(*delivered(spark, sf_dir))


@query(f"SELECT count(*) AS checked, count(*) FILTER (finding = 'uncaptured') AS uncaptured, count(*) FILTER (finding = 'mismatched') AS mismatched, count(finding) = 0 AS passed FROM ({CHECKED})")
def public_gate(spark, sf_dir):
    """The gate of delivered files."""
    return gates.public_gate(*delivered(spark, sf_dir))


ORACLE = "SELECT 'p/' || page_id AS path, sha256(CASE WHEN page_id % 9 = 4 THEN html || '<!-- later -->' ELSE html END) AS d FROM pages"


@query(f"SELECT count(*) AS files, count(*) FILTER (k IS NULL) AS unknown, count(*) > 0 AND count(*) FILTER (k IS NULL) = 0 AS passed, ({of_any_size(ORACLE)}) AS integrity FROM ({ORACLE}) o LEFT JOIN (SELECT DISTINCT sha256(html) AS k FROM pages) c ON c.k = o.d")
def oracle_gate(spark, sf_dir):
    """Pages as a source oracle: bytes that were never captured, and the digest of what the oracle holds."""
    pages = table(spark, sf_dir, "pages")
    later = F.when(F.col("page_id") % 9 == 4, F.concat("html", F.lit("<!-- later -->"))).otherwise(F.col("html"))
    files = pages.select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.sha2(later, 256).alias("sha256"))
    return gates.oracle_gate(files, pages.select(F.sha2("html", 256).alias("sha256")))


# --- authorization

SHOWN = "CASE WHEN i % 20 < 5 AND i // 20 % 7 = 3 THEN 'x/Logo/' || i WHEN i % 20 < 12 AND i // 20 % 3 = 1 THEN 'js/' || i WHEN i % 2 = 0 THEN 'vendor/' || i ELSE 'a/Third-Party/' || i END"
HELD = "CASE WHEN i // 20 % 9 = 2 AND i % 3 <> 0 AND i % 20 NOT IN (2, 13, 19) THEN 'lib' || i || '/COPYING.txt' ELSE 'copying/' || i END"
ITEMS = f"""WITH d AS (SELECT doc_id AS i, source, coalesce(text, '') AS text FROM documents), l AS (SELECT source, count(*) FILTER (h LIKE 'lib%') AS licenses FROM (SELECT source, {HELD} AS h FROM d) GROUP BY source),
t AS (SELECT d.source, {SHOWN} AS path, sha256(text) AS sha256, licenses FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source),
s AS (SELECT *, CASE WHEN path LIKE 'x/%' THEN 'restricted' WHEN licenses > 0 AND path NOT LIKE 'js/%' THEN 'covered' ELSE 'unverified' END AS status FROM t)"""


def published(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs, spark_sql = documents(spark, sf_dir), lambda e: e.replace("//", "div")
    return inventory(docs, spark_sql(SHOWN), "false", by=("source",)), docs.select("source", F.expr(spark_sql(HELD)).alias("path"))


@query(f"{ITEMS} SELECT source, path, sha256, status FROM s")
def authorization_items(spark, sf_dir):
    """What is known of the right to publish each file (documents; sources for sites)."""
    return provenance.authorization_items(*published(spark, sf_dir), "source")


@query(f"""{ITEMS}, g AS (SELECT source, count(*) AS items, count(*) FILTER (status = 'restricted') AS restricted, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'covered') AS covered, max(licenses) AS licenses FROM s GROUP BY source)
SELECT *, CASE WHEN restricted > 0 THEN 'restricted' WHEN unverified > 0 THEN 'unverified' ELSE 'covered' END AS decision FROM g""")
def authorization_manifest(spark, sf_dir):
    """The authorization manifest of each source."""
    return provenance.authorization_manifest(*published(spark, sf_dir), "source")


# --- conversion

SUFFIX = "CASE WHEN page_id % 5 = 0 THEN '/index.html' WHEN page_id % 5 = 4 THEN '.txt' ELSE '.html' END"
CONVERTED = f"""WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path, html FROM pages),
f AS (SELECT page_id AS id, split_part(ltrim(path, '/'), '/', 1) || {SUFFIX} AS path, CASE WHEN page_id % 7 = 0 THEN '{{"a": 1}}' WHEN page_id % 11 = 0 THEN replace(html, '<title>', '<title>404 ') ELSE html END AS html, page_id % 22 = 0 AND page_id % 7 <> 0 AS elsewhere FROM p WHERE page_id % 5 <> 4),
t AS (SELECT *, trim({PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title, trim({PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS h1,
substr(trim(regexp_replace({PLAIN.format("regexp_extract(html, '(?s)<body>(.*)</body>', 1)")}, '\\s+', ' ', 'g')), 1, 2000) AS body FROM f),
r AS (SELECT *, CASE WHEN path = 'index.html' THEN '/' ELSE '/' || regexp_replace(regexp_replace(path, '/index\\.html$', ''), '\\.html$', '') END AS route, html NOT LIKE '{{%' AS ok, NOT elsewhere AND regexp_matches(title || '  ' || body, '{C.ERRORS}') AS error FROM t),
b AS (SELECT route, min(struct_pack(o := NOT regexp_matches(path, '(^|/)index\\.html$'), path := path, id := id)) AS best FROM r WHERE ok AND NOT error GROUP BY route),
n AS (SELECT route, best.path AS selected, best.id AS chosen, CASE WHEN route = '/' THEN 'HomePage' ELSE regexp_replace(array_to_string(list_transform(regexp_extract_all(route, '[A-Za-z0-9]+'), lambda w: upper(w[1]) || w[2:]), ''), '^([^A-Za-z_$]|$)', 'Page\\1') || 'Page' END AS base FROM b),
u AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY selected) AS nth FROM n),
c AS (SELECT id, path, CASE WHEN NOT ok THEN 'no-page' WHEN error THEN 'error-page' WHEN id = chosen THEN 'page' ELSE 'alternative' END AS outcome, r.route, selected, base || CASE WHEN nth > 1 THEN CAST(nth AS VARCHAR) ELSE '' END AS name, title, coalesce(nullif(h1, ''), title) AS heading, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM r LEFT JOIN u ON u.route = r.route)"""


def site_files(spark, sf_dir) -> DataFrame:
    """Pages as files: a section's page or its index; some hold no page, some tell of an error, of which some have their canonical page elsewhere."""
    html = F.expr("""CASE WHEN page_id % 7 = 0 THEN '{"a": 1}' WHEN page_id % 11 = 0 THEN replace(html, '<title>', '<title>404 ') ELSE html END""")
    html = F.when((F.col("page_id") % 22 == 0) & (F.col("page_id") % 7 != 0), F.replace(html, F.lit("</title>"), F.lit("</title><link rel='x canonical' href='https://elsewhere.example/x'>"))).otherwise(html)
    section = F.split_part(F.ltrim(U.path(F.col("url")), F.lit("/")), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(section, F.expr(SUFFIX)).alias("path"), html.alias("html"))


@query(f"""{CONVERTED} SELECT id, path, outcome, route, CASE WHEN outcome IN ('page', 'alternative') THEN selected END AS selected, CASE WHEN outcome = 'page' THEN name END AS name, CASE WHEN outcome IN ('page', 'error-page') THEN title END AS title,
CASE WHEN outcome = 'page' THEN heading END AS heading, CASE WHEN outcome = 'page' THEN lang END AS lang FROM c""")
def converted_pages(spark, sf_dir):
    """What conversion makes of each captured page: the page of its route with its name and heading, another one of the route, no page, or one that tells of an error."""
    return conversion.converted(site_files(spark, sf_dir), F.lit("own.example"))


@query(f"""{CONVERTED} SELECT count(*) FILTER (outcome = 'page') AS pages, count(*) FILTER (outcome = 'alternative') AS alternatives, count(*) FILTER (outcome = 'no-page') AS ignored, count(*) FILTER (outcome = 'error-page') AS errors,
count(DISTINCT CASE WHEN outcome = 'alternative' THEN route END) AS duplicated_routes, count(*) FILTER (outcome = 'page') > 0 AS passed FROM c""")
def conversion_manifest(spark, sf_dir):
    """The counts of a whole conversion."""
    return conversion.manifest(conversion.converted(site_files(spark, sf_dir), F.lit("own.example")))


# --- delivery

RUNS = """WITH e AS (SELECT event_id AS i, user_id AS project, event_type, value FROM events), p AS (SELECT project, count(*) AS ran, CASE WHEN project % 5 = 0 THEN 1 ELSE 2 END AS envs FROM e GROUP BY project),
w AS (SELECT *, ran // CASE WHEN project % 10 = 3 THEN 3 ELSE envs END AS named, project % 7 <> 0 AS summary, project % 13 <> 0 AS contract, CASE WHEN project % 9 <> 3 THEN 'f' || project % 9 END AS fixed, CASE WHEN project % 8 = 5 THEN 'x' WHEN project % 9 <> 3 THEN 'f' || project % 9 END AS mark FROM p),
q AS (SELECT project, unnest([CASE WHEN NOT summary THEN 'summary-missing-or-invalid' END, CASE WHEN NOT contract THEN 'contract-missing-or-invalid' END, CASE WHEN NOT summary OR project % 4 = 1 THEN 'summary-not-passed' END,
CASE WHEN NOT contract OR fixed IS NULL OR project % 17 = 0 THEN 'thresholds-unlocked' END, CASE WHEN CASE WHEN summary THEN mark END IS DISTINCT FROM CASE WHEN contract THEN fixed END THEN 'threshold-fingerprint-mismatch' END,
CASE WHEN contract AND project % 2 = 0 AND envs = 1 THEN 'dynamic-environment-coverage-incomplete' END, CASE WHEN NOT contract OR named = 0 OR named * envs <> ran THEN 'scenario-coverage-incomplete' END]) AS code FROM w),
s AS (SELECT project, unnest([CASE WHEN i % 997 = 0 OR event_type = 'error' AND i % 31 = 0 THEN 'scenario-failed:s' || i END, CASE WHEN i % 809 = 0 OR i % 811 = 0 THEN 'image-evidence-incomplete:s' || i END,
CASE WHEN i % 499 = 0 THEN 'screenshot-missing:s' || i || ':source' END, CASE WHEN (i + 1) % 499 = 0 OR NOT EXISTS (SELECT 1 FROM events v WHERE v.event_id = i + 1) THEN 'screenshot-missing:s' || i || ':local' END, CASE WHEN i % 601 = 0 THEN 'capture-evidence-incomplete:s' || i || ':source' END]) AS code FROM e),
c AS (SELECT project, code FROM (SELECT * FROM q UNION ALL SELECT * FROM s) WHERE code IS NOT NULL),
r AS (SELECT project, unnest(CASE WHEN project % 19 = 0 THEN ['report-missing'] ELSE [CASE WHEN project % 6 = 5 THEN 'report-not-passed' END, CASE WHEN project % 11 = 0 OR project % 23 = 0 THEN 'commands-incomplete' END, CASE WHEN project % 14 = 1 OR project % 25 = 0 THEN 'route-probes-incomplete' END,
CASE WHEN project % 29 = 0 THEN 'preview-url-invalid' END, CASE WHEN project % 29 = 1 THEN 'preview-not-loopback' END] END) AS code FROM p),
x AS (SELECT project, code FROM r WHERE code IS NOT NULL)"""


def runs(spark, sf_dir) -> dict[str, DataFrame]:
    """Users as projects, their events as scenarios."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("project"), "event_type", "value")
    ran = events.groupBy("project").agg(F.count("*").alias("ran")).withColumn("envs", F.expr("CASE WHEN project % 5 = 0 THEN array('desktop') ELSE array('mobile', 'desktop') END"))
    mark = "CASE WHEN project % 9 <> 3 THEN 'f' || project % 9 END"
    captures = F.expr("map('source', named_struct('screenshot', 'shot-' || i, 'evidence', i % 601 <> 0), 'local', named_struct('screenshot', 'shot-' || (i + 1), 'evidence', true))")
    return {
        "projects": ran.select("project"),
        "contracts": ran.where("project % 13 <> 0").selectExpr("project", "project % 17 <> 0 AS locked", f"{mark} AS fingerprint", "project % 2 = 0 AS dynamic", "envs AS environments", "ran div CASE WHEN project % 10 = 3 THEN 3 ELSE size(envs) END AS scenarios"),
        "summaries": ran.where("project % 7 <> 0").selectExpr("project", "project % 4 <> 1 AS passed", f"CASE WHEN project % 8 = 5 THEN 'x' ELSE {mark} END AS fingerprint"),
        "scenarios": events.selectExpr("project", "'s' || i AS id", "i % 997 <> 0 AS passed", "CASE WHEN event_type = 'error' AND i % 31 = 0 THEN 2 END AS findings", "i % 809 <> 0 AS dimensions_match", "CASE WHEN i % 811 <> 0 THEN value END AS mismatch", "i").withColumn("captures", captures).drop("i"),
        "screenshots": events.where("i % 499 <> 0").selectExpr("'shot-' || i AS path"),
        "reports": ran.where("project % 19 <> 0").selectExpr(
            "project", "project % 6 <> 5 AS passed", "CASE WHEN project % 11 = 0 THEN array(0) WHEN project % 23 = 0 THEN array(0, 1) ELSE array(0, 0) END AS commands",
            "CASE WHEN project % 14 = 1 THEN CAST(array() AS ARRAY<STRUCT<status: INT, content_type: STRING>>) WHEN project % 25 = 0 THEN array(named_struct('status', 404, 'content_type', 'text/html')) ELSE array(named_struct('status', 200, 'content_type', 'text/html; charset=utf-8')) END AS routes",
            "CASE WHEN project % 29 = 0 THEN 'nowhere' WHEN project % 29 = 1 THEN 'http://far.example:1/' ELSE 'http://localhost:4173/' END AS preview",
        ),
        "gates": events.where("event_type = 'error' AND value > 20").selectExpr("project", "'PARITY_PROOF' AS stage", "CAST(i % 3 AS INT) AS consecutive", "1 AS attempts"),
        "history": events.where("event_type = 'purchase'").selectExpr("project", "CASE WHEN i % 2 = 0 THEN 'PARITY_PROOF' ELSE 'BUILD' END AS stage", "CASE WHEN value > 20 THEN 'failed' ELSE 'passed' END AS event"),
        "evidence": ran.where("project % 3 <> 0").select("project"),
        "opened": ran.where("project % 31 <> 2").select("project"),
    }


@query(f"{RUNS} SELECT project, code FROM c")
def proof_findings(spark, sf_dir):
    """What is wrong with the proofs of projects."""
    r = runs(spark, sf_dir)
    return delivery.proof_findings(r["projects"], r["contracts"], r["summaries"], r["scenarios"], r["screenshots"])


@query(f"{RUNS} SELECT project, code FROM x")
def reproducibility_findings(spark, sf_dir):
    """What is wrong with the reports on whether projects can be built again."""
    r = runs(spark, sf_dir)
    return delivery.reproducibility_findings(r["projects"], r["reports"])


@query(f"""{RUNS}, m AS (SELECT project, greatest(coalesce(max(CASE WHEN event_type = 'error' AND value > 20 THEN greatest(i % 3, 1) END), 0), count(*) FILTER (event_type = 'purchase' AND i % 2 = 0 AND value > 20)) AS failures FROM e GROUP BY project),
g AS (SELECT project, m.failures < 2 OR project % 3 <> 0 AS shown, NOT EXISTS (SELECT 1 FROM c WHERE c.project = p.project) AS proof, NOT EXISTS (SELECT 1 FROM x WHERE x.project = p.project) AS again, project % 31 <> 2 AS opened FROM p JOIN m USING (project))
SELECT project, proof AND shown AS proof_passed, again AS reproducible, shown AS repairs_shown, opened AS browser_opened, proof AND shown AND again AND opened AS delivered FROM g""")
def delivery_gates(spark, sf_dir):
    """Whether each project can be delivered."""
    r = runs(spark, sf_dir)
    proof = delivery.proof_findings(r["projects"], r["contracts"], r["summaries"], r["scenarios"], r["screenshots"])
    failures = delivery.repeated_failures(r["gates"], r["history"])
    return delivery.delivery_gate(r["projects"], proof, delivery.reproducibility_findings(r["projects"], r["reports"]), failures, r["evidence"], r["opened"])
