"""The corpus pipeline: filters, duplicates, decontamination and mixing, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
docs, whatever these are. The last returns a row for each document that the mix takes, with its number of copies.

Cases, in all stages: docs needs doc_id, text and source; other columns, of any type and name, are carried (not by the last
stage); null texts are empty texts; long texts are read whole; an empty table gives an empty table. What a stage does with
null ids, ties and repeated rows is told below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from weftgraph.stage import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among docs, does not reject.

    Each row is judged by its text alone, so repeated rows stay or go together; a score of exactly one half goes; rows with
    null ids are judged but train nothing; without labels of both kinds all documents stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id.

    One with a null id stays only where none of its group has an id; of rows that tie in text and id one stays, that whose
    other columns are smallest. All empty texts are equal.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the document with the smallest doc_id.

    One with a null id stays only where none of its group has an id; of rows that tie in id and text one stays; a text without
    words is near to no other; one of fewer than five words is near to those of the same words.
    """
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold half or more of a benchmark item's words in passages of five words or more.

    Each row is judged by its text alone, so repeated rows stay or go together, and null ids count for nothing; an item of fewer
    than five words is held where all of them follow each other; with an empty benchmark all documents stay.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document that the mix takes: doc_id, source, size, source_size, target, copies, taken.

    A null source is a source, the last; a null id is an id like others; repeated rows count each; a document without words is
    taken a whole number of times.
    """
    return mixing.mix_sources(docs).filter("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: SQL can't express the trained model, tilings and random rounding of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
