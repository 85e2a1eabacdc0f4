"""A training-data pipeline over ``documents``: each stage is written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import decontaminate, language_id, mixing, near_dedup, token_files
from frameloom.llm._shared import materialize, release, table
from frameloom.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter of a language; the rest get the predicted language as ``lang``.

    Null, empty and letterless texts go; null ids, repeated rows and all other columns stay; no rows give no rows.
    """
    model = language_id.fit_language_model(docs)
    return language_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8.

    (The query op8_near_dedup takes four words, as its contract says.) The smallest id of a group stays, a null id only
    where all are null; of repeated rows one stays; texts without words stay.
    """
    return near_dedup.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which tiles with a benchmark item cover half of the item's words.

    Null and empty texts stay; copies are judged alike; an empty benchmark drops nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources meet their target weights; a document stands once for each draw, three times at most.

    A null source is one of its own; repeated rows are drawn one by one; sources without words get nothing.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and reads them back: (doc_id, start, n_tokens, ids_crc32) per document.

    A null or empty text is the end id alone; null ids come first; documents that stand several times are written so.
    """
    return token_files.token_files(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Byte-pair encoding and MinHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = materialize(stage(spark, docs, sf_dir), name), docs
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
