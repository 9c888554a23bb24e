"""A corpus pipeline of training-data operations over `documents`.

Each stage works on all rows that the one before kept and returns the columns of documents, whatever others there are;
an empty table gives an empty table. What each does with nulls, repeats and ties its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import jaccard, mixing, pieces, pii
from corpusloom.llm.common import small_batches, table, written
from corpusloom.llm.toxicity import fit_on, score


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the lexicon is fitted on labelled rows of these documents.

    A null or empty text scores as one without hits and stays; rows that repeat share their fate; a null id has no label.
    """
    small_batches(spark)
    lexicon = fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(lexicon) < 0.5).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of rows that share an id one.

    Texts without words, null ones and rows without an id are like nothing and all stay.
    """
    return jaccard.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows.

    Of spans that overlap the first counts; a null text stays null; rows that repeat are changed alike.
    """
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 2 times.

    A null source is a source of its own, the last one; a null text has size 0 and its source's chance; rows that repeat
    are told apart and drawn one by one.
    """
    return mixing.mixed(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and pieces: the ids that train a model.

    A null or empty text has none; copies that follow each other are segmented each in its own way.
    """
    return pieces.encoded(docs)


STAGES = [("toxicity", toxicity_stage), ("jaccard", jaccard_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("sentencepiece", pieces_stage)]

#: The stages learn, draw and merge; SQL cannot say that. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole of `documents`; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
