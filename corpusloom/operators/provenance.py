"""Whether text comes from captured evidence: phrases that documents contain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.classify import authorization, license_file
from corpusloom.functions.text import collapsed, normalized, user_facing
from corpusloom.operators.ordering import path_fingerprint

#: Phrases, and characters of phrases, that may be broadcast; beyond that keys meet in a shuffle.
SENDABLE, LETTERS = 100_000, 4_000_000


def _grams(column: str) -> Column:
    words = F.col(column)
    three = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, F.array_distinct(three)).otherwise(F.array().cast("array<string>"))


def _scanned(phrases: DataFrame, documents: DataFrame) -> DataFrame:
    """phrase, doc_id: what one automaton of all phrases (a column of distinct ones) finds in each text, which is read once where it lies."""
    sent = phrases.sparkSession.sparkContext.broadcast([r.phrase for r in phrases.select("phrase").collect()])
    shape = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("doc_id", documents.schema["doc_id"].dataType)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in sent.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            found, at = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                hits = {p for _, p in automaton.iter(body)} if body and len(automaton) else set()
                found += hits
                at += [i] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], names=shape.fieldNames())

    return documents.select("doc_id", normalized(F.col("text")).alias("body")).mapInArrow(rows, shape)


def supported_pairs(phrases: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id where a document's normalized text contains the item's, each once.

    Phrases of at most LETTERS characters in all, which are counted first, go to the tasks as one automaton, and nothing
    but its hits moves. More of them meet the documents by keys. Null and empty phrases are in no document, rows
    without a text contain nothing.
    """
    p = phrases.select("item_id", normalized(F.col("text")).alias("phrase")).where("phrase <> ''")
    each = p.select("phrase").distinct()
    if (each.agg(F.sum(F.length("phrase"))).first()[0] or 0) > LETTERS:
        return _by_keys(phrases, documents)
    return _scanned(each, documents).join(p, "phrase").select("item_id", "doc_id").distinct()


def _by_keys(phrases: DataFrame, documents: DataFrame) -> DataFrame:
    """As supported_pairs, for any number of phrases.

    Containment is not an equality, so pairs are found by inner words of the phrase, whole words of any text that
    contains it: three of them, or one where the phrase has but three or four words. Only texts of documents that such a
    key names move, to be verified. Phrases of one or two words have no inner word; they meet every document, in its
    own task, and may be SENDABLE at most.
    """
    p = phrases.select("item_id", normalized(F.col("text")).alias("phrase")).where("phrase <> ''").withColumn("w", F.split("phrase", " "))
    d = documents.select("doc_id", normalized(F.col("text")).alias("body"))
    three = F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3)))
    keyed = p.where("size(w) >= 3").select("item_id", "phrase", F.when(F.size("w") >= 5, three).otherwise(F.get("w", F.lit(1))).alias("gram"))
    sizes = p.agg(F.count_if(F.size("w") >= 3).alias("keyed"), F.count_if(F.size("w").between(3, 4)).alias("single"), F.count_if(F.size("w") < 3).alias("short")).first()
    grams = F.array_union(_grams("words"), F.array_distinct("words")) if sizes.single else _grams("words")
    keys = keyed.select("item_id", "gram")
    named = d.select("doc_id", F.split("body", " ").alias("words")).select("doc_id", F.explode(grams).alias("gram"))
    maybe = named.join(F.broadcast(keys) if sizes.keyed <= SENDABLE else keys, "gram").select("item_id", "doc_id").distinct()
    texts = d.join(maybe.select("doc_id").distinct(), "doc_id", "left_semi")
    found = maybe.join(keyed.select("item_id", "phrase"), "item_id").join(texts, "doc_id").where("contains(body, phrase)").select("item_id", "doc_id")
    if not sizes.short:
        return found.distinct()
    if sizes.short > SENDABLE:
        raise ValueError(f"{sizes.short} phrases of one or two words, {SENDABLE} at most")
    loose = d.join(F.broadcast(p.where("size(w) < 3").select("item_id", "phrase")), F.expr("contains(body, phrase)")).select("item_id", "doc_id")
    return found.unionByName(loose).distinct()


def unsupported(phrases: DataFrame, documents: DataFrame) -> DataFrame:
    """Items whose normalized text occurs in no document."""
    return phrases.join(supported_pairs(phrases, documents).select("item_id").distinct(), "item_id", "left_anti").select("item_id")


def source_phrases(files: DataFrame) -> DataFrame:
    """path, phrase: the lines of files (path, text) that read like text for people, white space collapsed, each once."""
    lines = files.select("path", F.explode(F.split("text", "\n")).alias("line")).where(user_facing(F.col("line")))
    return lines.select("path", collapsed(F.col("line")).alias("phrase")).distinct()


def checked_phrases(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """path, phrase, supported: whether any text of the evidence (path, text) contains the phrase, white space and case aside."""
    phrases = source_phrases(files)
    found = supported_pairs(phrases.select(F.col("phrase").alias("item_id"), F.col("phrase").alias("text")), evidence.select(F.col("path").alias("doc_id"), "text"))
    known = found.select(F.col("item_id").alias("phrase"), F.lit(True).alias("known")).distinct()
    return phrases.join(known, "phrase", "left").select("path", "phrase", F.col("known").isNotNull().alias("supported"))


def provenance_gate(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: passed, checked, unsupported, evidence_files, evidence_sha256 (of the normalized texts in the order of their paths)."""
    counts = checked_phrases(files, evidence).agg(F.coalesce(F.bool_and("supported"), F.lit(True)).alias("passed"), F.count("*").alias("checked"), F.count_if(~F.col("supported")).alias("unsupported"))
    digests = evidence.select("path", F.sha2(normalized(F.col("text")), 256).alias("sha256"))
    print_ = path_fingerprint(digests).withColumnRenamed("fingerprint", "evidence_sha256")
    return counts.join(evidence.agg(F.count("*").alias("evidence_files")), how="cross").join(print_, how="cross")  # one row each


def precedence(statuses: DataFrame, by: str) -> DataFrame:
    """One decision a group: restricted if any row is, else unverified if any is, else covered."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    return statuses.groupBy(by).agg(F.when(any_of("restricted"), F.lit("restricted")).when(any_of("unverified"), F.lit("unverified")).otherwise(F.lit("covered")).alias("decision"))


def authorization_items(public: DataFrame, site: DataFrame, by: str) -> DataFrame:
    """by, path, sha256, status of each file that is to be published (by, path, sha256): restricted, covered, or unverified.

    Vendors' files are covered where the captured files of the group (by, path) hold a license; null is a group, too.
    """
    licensed = site.where(license_file(F.col("path"))).select(F.col(by).alias("_by"), F.lit(True).alias("_licensed")).distinct()
    rows = public.join(licensed, F.col(by).eqNullSafe(F.col("_by")), "left")
    return rows.select(by, "path", "sha256", authorization(F.col("path"), F.col("_licensed").isNotNull()).alias("status"))


def authorization_manifest(public: DataFrame, site: DataFrame, by: str) -> DataFrame:
    """by, items, restricted, unverified, covered, licenses, decision of each group that has a file in either table; a group with nothing to publish is covered. It lists evidence and grants nothing."""
    nothing = F.lit(0).cast("long")
    items = authorization_items(public, site, by).select(by, "status", nothing.alias("license"))
    found = site.select(by, F.lit(None).cast("string").alias("status"), license_file(F.col("path")).cast("long").alias("license"))
    of = lambda s: F.count_if(F.col("status") == s)
    out = items.unionByName(found).groupBy(by).agg(F.count("status").alias("items"), *[of(s).alias(s) for s in ("restricted", "unverified", "covered")], F.coalesce(F.sum("license"), nothing).alias("licenses"))
    return out.withColumn("decision", F.when(F.col("restricted") > 0, "restricted").when(F.col("unverified") > 0, "unverified").otherwise("covered"))
