"""All queries over the captured-corpus tables, and the SQL that each must agree with.

Queries whose table has no captured files take the nearest table for the same operator; their docstrings say so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import classify as C
from corpusloom.functions import html as H
from corpusloom.functions import text as X
from corpusloom.functions import url as U
from corpusloom.operators import comparison, inventory, links, provenance, sequences
from corpusloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# The pieces of SQL that several queries share.
ATTR = r"""'(?:src|href|poster|data)=["'']([^"'']*)["'']'"""
HOST = "regexp_extract({0}, '^(?i:https?:)?//([^/?#]+)', 1)"
PATH = "coalesce(nullif(regexp_extract(split_part(split_part({0}, '#', 1), '?', 1), '^(?i:https?:)?//[^/?#]+(/.*)$', 1), ''), '/')"
WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NORM = "trim(regexp_replace({0}, '" + WS.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"
PAGES = f"SELECT page_id, {HOST.format('url')} AS host, {PATH.format('url')} AS path, url, html FROM pages"
REFS = f"SELECT page_id, host, unnest(regexp_extract_all(html, {ATTR}, 1)) AS raw FROM ({PAGES})"


def of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(f"SELECT page_id, host, raw FROM ({REFS})")
def link_refs(spark, sf_dir):
    """Every reference in an attribute of a page."""
    return links.references(of_pages(spark, sf_dir))


@query(f"""WITH p AS ({PAGES}), r AS (SELECT DISTINCT host, split_part(split_part(raw, '#', 1), '?', 1) AS path FROM ({REFS}) WHERE starts_with(raw, '/') AND NOT starts_with(raw, '//'))
SELECT r.host, r.path FROM r ANTI JOIN p ON r.host = p.host AND r.path = p.path""")
def missing_links(spark, sf_dir):
    """Local-asset closure: rooted links that lead to no captured page."""
    return links.missing_links(of_pages(spark, sf_dir))


@query(f"""SELECT route, min(struct_pack(o := NOT regexp_matches(path, '(?i)(^|/)index\\.html?$'), page_id := page_id)).page_id AS page_id, count(*) AS candidates
FROM (SELECT page_id, path, host || regexp_replace(path, '(.)/+$', '\\1') AS route FROM ({PAGES})) GROUP BY route""")
def page_route_top1(spark, sf_dir):
    """One page a route, index files first, and how many there were."""
    return links.page_of_route(of_pages(spark, sf_dir))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages""")
def page_titles(spark, sf_dir):
    """Title, language and first heading of each page, as marked up."""
    take = lambda p, n: F.regexp_extract("html", p, 1).alias(n)
    return of_pages(spark, sf_dir).select("page_id", take("<title>([^<]*)</title>", "title"), take('<html lang="([^"]*)"', "lang"), take("<h1>([^<]*)</h1>", "heading"))


@query(f"""SELECT page_id, '_external/' || regexp_replace(host, '[^A-Za-z0-9._-]', '_', 'g') || '/' || coalesce(nullif(array_to_string(list_filter(string_split(url_decode(path), '/'), lambda s: s <> ''), '/'), ''), 'index')
 || '.__q_' || substr(sha256(regexp_extract(split_part(url, '#', 1), '(\\?.+)$', 1)), 1, 12) AS kept_as FROM ({PAGES}) WHERE contains(split_part(url, '#', 1), '?')""")
def external_asset_path(spark, sf_dir):
    """Where pages with a query string would be kept as foreign files."""
    return of_pages(spark, sf_dir).where("contains(split(url, '#')[0], '?')").select("page_id", U.external_path(F.col("url")).alias("kept_as"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def doc_inventory(spark, sf_dir):
    """Path, size and hash of each document."""
    return inventory.inventory(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    """Contents that occur more than once, the first document and the number."""
    return inventory.first_by_content(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, '(?is)^\\s*(<!doctype\\s+html\\b|<html(\\s|>))') THEN 'html' WHEN regexp_matches(t, '^\\s*[\\x5B\\x7B]') AND json_valid(t) THEN 'json'
WHEN trim(t) = '' THEN 'empty' ELSE 'text' END AS class FROM (SELECT text AS t FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT props FROM events)) GROUP BY class""")
def content_class_counts(spark, sf_dir):
    """How many contents of documents, pages and event properties are of each class."""
    texts = [table(spark, sf_dir, t).select(F.col(c).alias("t")) for t, c in (("documents", "text"), ("pages", "html"), ("events", "props"))]
    return texts[0].unionAll(texts[1]).unionAll(texts[2]).select(C.content_class(F.col("t")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


SUPPORTED = f"""SELECT DISTINCT b.item_id, d.doc_id FROM (SELECT item_id, lower({NORM.format('text')}) AS p FROM benchmark) b
JOIN (SELECT doc_id, lower({NORM.format('text')}) AS t FROM documents) d ON contains(d.t, b.p) WHERE b.p <> ''"""


@query(SUPPORTED)
def supported_pairs(spark, sf_dir):
    """Benchmark items and the documents that contain them."""
    return provenance.supported_pairs(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(f"SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM ({SUPPORTED}))")
def unsupported_phrases(spark, sf_dir):
    """Content provenance: items that no document contains."""
    return provenance.unsupported(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


LICENSE = "(Released under the|Licensed under|License|Copyright|All rights reserved)"
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(f"SELECT doc_id, line FROM ({LINES}) WHERE regexp_matches(line, '{LICENSE}')")
def license_lines(spark, sf_dir):
    """License lines of documents (for license files, which the tables lack)."""
    return lines(spark, sf_dir).where(F.col("line").rlike(LICENSE))


FACING = f"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {NORM.format('line')} AS t FROM ({LINES})) WHERE length(t) >= 4 AND regexp_matches(t, '[A-Za-z]')
AND NOT regexp_matches(t, '^(?i:https?:|data:|blob:|/|\\./|\\.\\./|#|\\x5B|\\x7B|@)') AND NOT (regexp_matches(t, '^(?i:[a-z0-9_.:@/-]+)$') AND t = lower(t)) AND NOT regexp_matches(t, '^[a-z][a-z0-9_-]*( [a-z][a-z0-9_-]*)+$')
AND NOT regexp_matches(t, '^(?i:application|text|image|audio|video)/') AND NOT regexp_matches(t, '[<>{{}}=;]') AND (contains(t, ' ') OR regexp_matches(t, '^[A-Z]')) GROUP BY doc_id"""


@query(FACING)
def user_facing_lines(spark, sf_dir):
    """How many lines of each document read like text for people."""
    shown = F.size(F.filter(F.split("text", "\n"), X.user_facing))
    return table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.sum(shown).cast("long").alias("n")).where("n > 0")


CONVERGE = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run,
lag(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l2 FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY ts, event_id) AS consecutive FROM a)
SELECT event_id, user_id, event_type, consecutive, consecutive >= 2 OR coalesce(event_type = l2, false) AS non_convergent FROM b"""


@query(CONVERGE)
def failure_convergence(spark, sf_dir):
    """Runs of equal events of a user and recurrence (users for stages, event types for failure signatures)."""
    out = sequences.convergence(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])
    return out.select("event_id", "user_id", "event_type", "consecutive", "non_convergent")


@query("""SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 4) + 0.0 AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, pos""")
def temporal_mean(spark, sf_dir):
    """The mean vector of each label (vectors for frames)."""
    return comparison.vector_mean(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query("SELECT vec_id, round(len(list_filter(embedding, lambda v: v <> embedding[1])) / len(embedding), 6) AS share FROM embeddings")
def first_element_variation(spark, sf_dir):
    """The share of elements that differ from the first (vectors for canvas boxes)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(comparison.variation("embedding"), 6).alias("share"))


@query("""WITH m AS (SELECT label, pos, round(avg(v), 4) + 0.0 AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, pos),
f AS (SELECT label AS id, list(mean ORDER BY pos) AS frame FROM m GROUP BY label),
d AS (SELECT a.id AS left_id, b.id AS right_id, round(list_sum(list_transform(range(1, len(a.frame) + 1), lambda i: abs(a.frame[i] - b.frame[i]))) / len(a.frame), 6) AS distance FROM f a, f b WHERE a.id < b.id)
SELECT left_id, right_id, distance FROM d ORDER BY distance, left_id, right_id LIMIT 1""")
def closest_pair(spark, sf_dir):
    """The two mean frames that are nearest (labels for capture sequences; as many frames as labels)."""
    mean = comparison.vector_mean(table(spark, sf_dir, "embeddings"), "label", "embedding")
    frames = mean.groupBy(F.col("label").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("f")).select("id", F.transform("f", lambda x: x["mean"]).alias("frame"))
    return comparison.nearest_frames(frames, frames, ascending=True)


@query("""WITH b AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: v::DOUBLE) AS r FROM embeddings), j AS (SELECT a.vec_id, a.r, l.r AS o FROM b a LEFT JOIN b l ON l.vec_id = a.vec_id + 1)
SELECT vec_id AS key, property, delta FROM (SELECT vec_id, unnest(['x', 'y', 'width', 'height']) AS property, unnest([round(abs(r[1] - o[1]), 6), round(abs(r[2] - o[2]), 6), round(abs(r[3] - o[3]), 6), round(abs(r[4] - o[4]), 6)]) AS delta FROM j) WHERE delta IS NULL OR delta > 0.1""")
def geometry_tolerance(spark, sf_dir):
    """Boxes off by more than a tolerance (a vector's first four numbers for a box, the next vector for the copy)."""
    box = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "width", "height"))])
    out = comparison.geometry_failures(box, box.withColumn("key", F.col("key") - 1), 0.1)
    return out.withColumn("delta", F.round("delta", 6)).where("delta is null or delta > 0.1")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def occurrence_keys(spark, sf_dir):
    """The number of each event among those of its user and type (for elements with one tag and role)."""
    return links.occurrences(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "occurrence")


# Before: all documents and benchmark items that a label or document names. After: what a delivery would keep of them,
# secrets blanked, documents without a label gone, pages new.
TOKEN = 'token = "[0-9a-f]{40}"'
BEFORE = "SELECT 'd/' || doc_id AS path, sha256(text) AS sha256 FROM documents"
AFTER = f"SELECT 'd/' || doc_id AS path, sha256(regexp_replace(text, '{TOKEN}', 'token', 'g')) AS sha256 FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT 'p/' || page_id, sha256(html) FROM pages"


def snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    before = d.select(path, F.sha2("text", 256).alias("sha256"))
    kept = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(path, F.sha2(F.regexp_replace("text", TOKEN, "token"), 256).alias("sha256"))
    new = of_pages(spark, sf_dir).select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))
    return before, kept.unionByName(new)


@query(f"SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS status FROM ({BEFORE}) b FULL JOIN ({AFTER}) a ON a.path = b.path WHERE a.sha256 IS DISTINCT FROM b.sha256")
def snapshot_diff(spark, sf_dir):
    """Added, removed and modified files between two snapshots (documents, and what a delivery keeps of them)."""
    return inventory.snapshot_diff(*snapshots(spark, sf_dir))


@query(f"SELECT a.path, a.sha256, b.sha256 AS captured_sha256 FROM ({AFTER}) a JOIN ({BEFORE}) b USING (path) WHERE a.sha256 <> b.sha256")
def mismatched_assets(spark, sf_dir):
    """Delivered files whose captured namesake has other bytes."""
    before, after = snapshots(spark, sf_dir)
    return inventory.mismatched(after, before)


@query(f"SELECT path, sha256 FROM ({AFTER}) ANTI JOIN ({BEFORE}) USING (path) WHERE path NOT IN (SELECT 'p/' || page_id FROM pages WHERE contains(url, '?'))")
def uncaptured_assets(spark, sf_dir):
    """Delivered files without a captured namesake, but for declared ones (pages whose URL has a query)."""
    before, after = snapshots(spark, sf_dir)
    declared = of_pages(spark, sf_dir).where("contains(url, '?')").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"))
    return inventory.uncaptured(after, before, declared)


@query("SELECT doc_id, source FROM documents WHERE source <> 'src0' AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def hash_oracle_check(spark, sf_dir):
    """Documents of other sources whose bytes occur in the first source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return inventory.known_content(d.where("source <> 'src0'"), d.where("source = 'src0'")).select("doc_id", "source")


@query("""SELECT user_id, array_to_string(list_filter([CASE WHEN bool_or(event_type = 'click') THEN 'click' END, CASE WHEN bool_or(event_type = 'error' AND value > 50) THEN 'costly-error' END,
CASE WHEN bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') THEN 'view-to-purchase' END], lambda x: x IS NOT NULL), ',') AS families FROM events GROUP BY user_id""")
def interaction_families(spark, sf_dir):
    """Families of what a user does, from events that go together (users for files)."""
    any_of = lambda c: F.bool_or(c)
    kind = F.col("event_type")
    flags = F.array_compact(F.array(F.when(any_of(kind == "click"), F.lit("click")), F.when(any_of((kind == "error") & (F.col("value") > 50)), F.lit("costly-error")), F.when(any_of(kind == "view") & any_of(kind == "purchase"), F.lit("view-to-purchase"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(flags, ",").alias("families"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, struct_pack(t := turn, r := role)) AS role FROM conversations GROUP BY conv_id")
def deepest_newest(spark, sf_dir):
    """The role at the deepest turn of each conversation (turns for depth of a report)."""
    return sequences.latest(table(spark, sf_dir, "conversations").withColumn("r", F.col("role")), "conv_id", ["turn", "r"], "role").select("conv_id", "turn", "role")


AUTH = f"CASE WHEN contains(text, 'token = ') THEN 'restricted' WHEN regexp_matches(text, '{LICENSE}') THEN 'covered' ELSE 'unverified' END"


@query(f"SELECT source, CASE WHEN bool_or(s = 'restricted') THEN 'restricted' WHEN bool_or(s = 'unverified') THEN 'unverified' ELSE 'covered' END AS decision FROM (SELECT source, {AUTH} AS s FROM documents) GROUP BY source")
def authorization_decision(spark, sf_dir):
    """One decision a source by precedence (secrets for restricted paths, license lines for license files)."""
    t = F.col("text")
    status = F.when(t.contains("token = "), F.lit("restricted")).when(t.rlike(LICENSE), F.lit("covered")).otherwise(F.lit("unverified"))
    return provenance.precedence(table(spark, sf_dir, "documents").select("source", status.alias("status")), "source")


@query("SELECT CASE WHEN value > 80 THEN 'content-type-mismatch' WHEN event_type = 'error' THEN 'parse-error' ELSE 'remote-url' END AS cause, count(*) AS n FROM events GROUP BY cause")
def cause_counts(spark, sf_dir):
    """Events by cause, the first that applies (events for conversion failures)."""
    cause = F.when(F.col("value") > 80, "content-type-mismatch").when(F.col("event_type") == "error", "parse-error").otherwise("remote-url")
    return table(spark, sf_dir, "events").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("SELECT user_id, bool_and(event_type <> 'error') AS all_pass, bool_or(event_type = 'purchase') AS any_done, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def gate_summary(spark, sf_dir):
    """Gates of a user: all checks passed, any done, failures (users for runs)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(kind != "error").alias("all_pass"), F.bool_or(kind == "purchase").alias("any_done"), F.count_if(kind == "error").alias("failures"))


RULES = [(0, None, "/en/", 200), (1, "/fr/825", None, 204), (2, None, "/fr", 201), (3, None, "/de/4", 202)]


@query(f"""WITH r(ord, m, p, status) AS (VALUES (0, NULL, '/en/', 200), (1, '/fr/825', NULL, 204), (2, NULL, '/fr', 201), (3, NULL, '/de/4', 202))
SELECT page_id AS id, path, coalesce(arg_min(r.status, r.ord), 503) AS status FROM ({PAGES}) q LEFT JOIN r ON q.path = r.m OR starts_with(q.path, r.p) GROUP BY page_id, path""")
def offline_rule_match(spark, sf_dir):
    """The status that the first matching rule gives each page's path."""
    rules = spark.createDataFrame([(o, m, p, None, s, None) for o, m, p, s in RULES], schemas.RULE)
    return comparison.first_rule(of_pages(spark, sf_dir).select(F.col("page_id").alias("id"), U.path(F.col("url")).alias("path"), F.lit("GET").alias("method")), rules)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), n(event_type) AS (VALUES ('click'), ('view'), ('refund')) SELECT user_id, event_type FROM u, n
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = n.event_type AND e.value > 40)""")
def coverage_gap(spark, sf_dir):
    """Required families that a user's costly events lack (users for proof profiles)."""
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 40, F.col("event_type")).alias("event_type"))
    return comparison.uncovered(["click", "view", "refund"], rows, "user_id", "event_type")


@query("""WITH a AS (SELECT doc_id AS ix, sha256(text) AS d FROM documents), b AS (SELECT CAST(floor(ix / 4096) AS BIGINT) AS ix, sha256(string_agg(d, '' ORDER BY ix)) AS d FROM a GROUP BY 1),
c AS (SELECT CAST(floor(ix / 4096) AS BIGINT) AS ix, sha256(string_agg(d, '' ORDER BY ix)) AS d FROM b GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY ix)) AS fingerprint FROM c""")
def corpus_fingerprint(spark, sf_dir):
    """One digest of all documents in order, through a tree of digests."""
    return inventory.ordered_fingerprint(table(spark, sf_dir, "documents"), "doc_id", F.sha2("text", 256))


@query("""SELECT event_id, user_id, event_type, CAST(floor((epoch_us(ts) - epoch_us(last)) / 1000) AS BIGINT) AS duration_ms FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
WHERE event_type IN ('purchase', 'error') AND last IS NOT NULL""")
def stage_durations(spark, sf_dir):
    """Milliseconds from the event before to each terminal one (users for runs)."""
    out = sequences.durations(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], F.col("event_type").isin("purchase", "error"))
    return out.select("event_id", "user_id", "event_type", "duration_ms")


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS BIGINT) AS attempt, coalesce(bool_or(value <= 50) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS repeated FROM events")
def repair_attempts(spark, sf_dir):
    """Attempts so far, and whether the same was tried and failed (user and type for finding and strategy, value over 50 for passed)."""
    e = table(spark, sf_dir, "events").withColumns({"signature": F.concat_ws("/", "user_id", "event_type"), "finding": F.col("user_id"), "strategy": F.col("event_type"), "passed": F.col("value") > 50})
    return sequences.repair_guardrails(e, ["ts", "event_id"]).select("event_id", "attempt", "repeated")


@query("SELECT conv_id, turn FROM conversations c WHERE turn < coalesce((SELECT min(turn) FROM conversations g WHERE g.conv_id = c.conv_id AND length(g.text) > 400), 1000000000)")
def valid_prefixes(spark, sf_dir):
    """Turns before a conversation's first long one (turns for stages, long for not done)."""
    stages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), (F.length("text") <= 400).alias("done"))
    return sequences.valid_prefix(stages, "conv_id").select("conv_id", F.col("ord").alias("turn"))


EXTRA_URLS = ["http://localhost:3000/x", "//127.0.0.1:4173/preview", "https://www.google-analytics.com/collect", "/assets/app.js", "data:text/plain,x"]


@query("""SELECT CASE WHEN r AND (h = 'localhost' OR ends_with(h, '.localhost') OR h = '::1' OR regexp_matches(h, '^127(\\.\\d{1,3}){3}$')) THEN 'loopback'
WHEN contains(u, 'google-analytics.com') OR contains(u, 'googletagmanager.com') OR contains(u, 'doubleclick.net') OR contains(u, 'hotjar.com') OR contains(u, 'segment.io') OR contains(u, 'segment.com') OR contains(u, 'clarity.ms') OR contains(u, 'fullstory.com') THEN 'tracker'
WHEN r THEN 'remote' ELSE 'local' END AS class, count(*) AS n FROM (SELECT u, regexp_matches(u, '^(?i:https?:)?//') AS r, lower(regexp_replace(regexp_extract(u, '^(?i:https?:)?//(?:[^/?#@]*@)?(\\x5B[^\\x5D]*\\x5D|[^/?#:]+)', 1), '^\\x5B|\\x5D$|\\.$', '', 'g')) AS h
FROM (SELECT url AS u FROM pages UNION ALL VALUES ('http://localhost:3000/x'), ('//127.0.0.1:4173/preview'), ('https://www.google-analytics.com/collect'), ('/assets/app.js'), ('data:text/plain,x'))) GROUP BY class""")
def url_classes(spark, sf_dir):
    """Remote, tracker, loopback and local URLs of pages and some of each class besides."""
    urls = of_pages(spark, sf_dir).select("url").unionByName(spark.createDataFrame([(u,) for u in EXTRA_URLS], "url string"))
    return urls.groupBy(U.url_class(F.col("url")).alias("class")).agg(F.count("*").alias("n"))


# Split so that no scanner takes them for real ones.
SECRETS = ["eyJ" + "hbGciOiJIUzI1" + "." + "eyJzdWIiOiIx" + "." + "c2lnbmF0dXJl", "first line\n  sk" + "-" + "a" * 24, "AAAA//8EAAQ", "sk" + "_live_" + "b" * 20 + " and AIza" + "c" * 24]
SECRET_ROWS = ", ".join("(" + str(i) + ", '" + s.replace("\n", "' || chr(10) || '") + "')" for i, s in enumerate(SECRETS))
KINDS_SQL = ", ".join(f"('{k}', '{p}')" for k, p in X.CREDENTIALS.items())


@query(f"""WITH s(id, body) AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - i, b FROM (VALUES {SECRET_ROWS}) AS v(i, b)), k(kind, p) AS (VALUES {KINDS_SQL}),
m AS (SELECT id, body, kind, unnest(regexp_extract_all(body, p)) AS v FROM s, k), o AS (SELECT id, kind, v, substr(body, 1, instr(body, v) - 1) AS b FROM m)
SELECT id, kind, CAST(len(string_split(b, chr(10))) AS INT) AS line, CAST(length(string_split(b, chr(10))[-1]) + 1 AS INT) AS "column", substr(sha256(v), 1, 12) AS fingerprint FROM o""")
def credential_findings(spark, sf_dir):
    """Credentials in documents and in a few planted lines, with their places."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    rows = rows.unionByName(spark.createDataFrame([(-1 - i, s) for i, s in enumerate(SECRETS)], "id long, body string"))
    return rows.select("id", F.explode(X.credentials(F.col("body"))).alias("f")).select("id", "f.*")


@query("""SELECT page_id, CAST(octet_length(encode(s)) AS BIGINT) AS bytes, regexp_matches(s, 'createElement\\(\\s*["'']script["'']') AS creates_script, regexp_matches(s, 'appendChild|innerHTML|insertAdjacentHTML') AS touches_dom,
regexp_matches(s, 'new\\s+(SharedWorker|Worker)\\s*\\(') AS creates_worker, regexp_matches(s, 'WebGLRenderer') AS has_canvas, array_to_string(list_distinct(regexp_extract_all(s, '(?m)(?:^|[;{}]\\s*)([A-Za-z_$][\\w$]*(?:[.][A-Za-z_$][\\w$]*)*)\\s*\\(', 1)), ',') AS calls
FROM (SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS s FROM pages)""")
def script_facts(spark, sf_dir):
    """Facts of each page's inline script."""
    s = of_pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1).alias("s"))
    return s.select("page_id", *C.script_facts(F.col("s")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT host AS source, split_part(raw, '/', 2) AS target FROM (""" + REFS + """) UNION SELECT DISTINCT split_part(path, '/', 2), host FROM (""" + PAGES + """)),
r(node, distance) AS (SELECT 'en', 0 UNION SELECT e.target, r.distance + 1 FROM r JOIN e ON e.source = r.node WHERE r.distance < 2) SELECT node, CAST(min(distance) AS INT) AS distance FROM r GROUP BY node""")
def import_reachability(spark, sf_dir):
    """What two steps reach from the section `en`: its hosts, and the names that their pages link (for imports of modules)."""
    pages = of_pages(spark, sf_dir)
    names = links.references(pages).select(F.col("host").alias("source"), F.get(F.split("raw", "/"), F.lit(1)).alias("target"))
    hosts = pages.select(F.get(F.split(U.path(F.col("url")), "/"), F.lit(1)).alias("source"), U.host(F.col("url")).alias("target"))
    start = spark.createDataFrame([("en",)], "node string")
    return links.reachable(names.unionByName(hosts).distinct(), start, 2)


CODES = ["visible-text-mismatch", "automatic-external-request", "content-type-mismatch", "state-progression-missing", "route-not-found", "geometry-delta", "font-missing", "canvas-cleanup"]
CASES = " ".join(f"WHEN regexp_matches(code, '{p}') THEN '{n}'" for n, p in C.FINDINGS)


@query(f"SELECT code, CASE {CASES} ELSE 'behavior' END AS class FROM (SELECT unnest({CODES!r}) AS code UNION ALL SELECT DISTINCT event_type FROM events)")
def finding_class(spark, sf_dir):
    """The class of finding codes, the first pattern that matches."""
    codes = spark.createDataFrame([(c,) for c in CODES], "code string").unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("code")).distinct())
    return codes.select("code", C.finding_class(F.col("code")).alias("class"))


@query("""SELECT page_id, CAST(idx - 1 AS BIGINT) AS place, CASE WHEN contains(tag, 'src=') THEN 'external' ELSE 'inline' END AS kind FROM (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS idx FROM (SELECT page_id, regexp_extract_all(html, '<script[^>]*>') AS t FROM pages))""")
def page_scripts(spark, sf_dir):
    """The scripts of each page in order, inline, external or data."""
    parsed = of_pages(spark, sf_dir).select("page_id", F.posexplode(H.scripts(F.col("html"))).alias("place", "s"))
    return parsed.select("page_id", F.col("place").cast("bigint").alias("place"), "s.kind")


# Pages load nothing from elsewhere; a few lines that do stand beside them.
LOADS = ["<script src='https://cdn.example/a.js'></script>", "p{background:url(//img.example/x.png)}", "<form action='https://f.example/post'>", "<img src='/local.png'><video poster='http://v.example/p.jpg'>", "@import \"https://c.example/b.css\";"]
LOADS_SQL = ", ".join("(" + str(-1 - i) + ", '" + t.replace("'", "''") + "')" for i, t in enumerate(LOADS))
EXTERNAL_SQL = ", ".join(f"('{k}', '" + p.replace("'", "''") + "')" for k, p in H.EXTERNAL if "(?=" not in p)


@query(f"""WITH s(id, body) AS (SELECT page_id, html FROM pages UNION ALL VALUES {LOADS_SQL}), k(kind, p) AS (VALUES {EXTERNAL_SQL})
SELECT id, kind, unnest(regexp_extract_all(body, p, 1)) AS url FROM s, k""")
def external_resources(spark, sf_dir):
    """What pages load from elsewhere, by kind."""
    rows = of_pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("html").alias("body")).unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(LOADS)], "id long, body string"))
    return rows.select("id", F.explode(H.external_resources(F.col("body"))).alias("x")).select("id", "x.*")
