"""The thirteen queries over the training-data tables, each through its operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.collocations import collocations
from corpusloom.llm.common import table
from corpusloom.llm.counts import token_counts
from corpusloom.llm.fingerprint import fingerprints
from corpusloom.llm.forest import near_duplicates
from corpusloom.llm.jaccard import jaccard_components
from corpusloom.llm.mixer import language_scores
from corpusloom.llm.mixing import mix
from corpusloom.llm.packing import packed
from corpusloom.llm.passages import shared_passages
from corpusloom.llm.pieces import round_trips
from corpusloom.llm.pii import personal_data
from corpusloom.llm.spelling import spelling_variants
from corpusloom.llm.toxicity import toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts and digest of the base spans, all spans. A null text has none; each row of `documents` gives one row."""
    return personal_data(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips of every text through the 32k vocabulary with merge dropout 0.1: number and digest of its pieces, lossless or not. A null text is empty."""
    return round_trips(table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that two documents share, each link both ways, with its class. Rows without doc_id, null and short texts give none."""
    return shared_passages(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses. A null text is empty; equal ids stand in the order of their texts."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles are alike by 0.8. Texts without words and rows without doc_id are alone."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, 150 % of all by weights 3, 1, 2 of the sources. A null source is the last one, a null text has size 0."""
    return mix(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by best unigram segmentation, counted only. A null text has none."""
    return token_counts(table(spark, sf_dir, "documents"))


def op8_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every text: by unigram counts, and by mixed context predictions, learned from nine tenths of the documents. An empty text is its end alone."""
    return language_scores(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of 0.95 or more. Unusable vectors link with nothing; equal ones link with each other."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a lexicon learned outside fold 0 of five. A null text is empty; labels that are neither 0 nor 1 are left out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every tokenized text in sequences of 2048 tokens. A null text is its end alone; rows that repeat are packed each on their own."""
    return packed(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of each language. A null text has no words, a null lang is `und`."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their forms, roots and numbers of near words. A null text has no words, a null id is the empty text."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_passages": op3_passages,
    "op4_fingerprints": op4_fingerprints,
    "op5_jaccard": op5_jaccard,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_language_scores": op8_language_scores,
    "op9_embeddings": op9_embeddings,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_collocations": op12_collocations,
    "op13_spelling": op13_spelling,
}

#: The smallest node that a node reaches over linked(a, b), from nodes(id).
REACHED = """both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

SQL: dict[str, str] = {
    "op5_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
nodes AS (SELECT doc_id AS id FROM s), {REACHED}
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, l.component_id FROM s JOIN least l ON l.id = s.doc_id""",
    "op9_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95), nodes AS (SELECT vec_id AS id FROM v), {REACHED}
SELECT v.vec_id, (SELECT count(*) FROM both_ways e WHERE e.a = v.vec_id) AS n_links, l.component_id, v.vec_id = l.component_id AS kept FROM v JOIN least l ON l.id = v.vec_id""",
    "op12_collocations": """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, string_split(c.phrase, ' ') AS ws FROM f c, range(1, 4) t(j) WHERE j < c.k),
s AS (SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT DISTINCT c.lang, array_to_string(string_split(c.phrase, ' ')[i:i + m - 1], ' ') AS phrase, c.f FROM f c, range(2, 4) t(m), range(1, 4) u(i) WHERE m < c.k AND i + m - 1 <= c.k),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 80 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
}
