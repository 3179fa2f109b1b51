"""From raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet in the shared
folder and read again as the next stage's documents, so a lost executor never reaches back further than
one stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontaminate, langid, mixing, nearcopies, tokens
from attesta.llm.common import materialise, table
from attesta.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the model recognises.

    Texts that are null or without a letter go, and so do those far from every learned language; without any
    labelled row nothing is recognised and all go. Repeated rows are judged alike.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    kept = langid.predict(docs, model, carry=COLUMNS, text_col="text").where("not rejected")
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Exactly one row of each group stays: of repeated rows one, rows without an id after those with one. Null
    texts count as empty, and all texts without words are one group.
    """
    return nearcopies.keep_one(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that share no ten-word span with the benchmark.

    Null and empty texts share none and stay, repeated rows share one fate, and an empty benchmark drops nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets.

    A row comes in whole copies, twice at most. Texts without words, null or empty, give no words and go; a null
    source is a source; rows without an id are rows like others, and repeated rows are decided together.
    """
    return mixing.repeat_taken(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token shards and return each document's place in them.

    One row for each row: null and empty texts hold the end id alone, null ids come first, and rows that share
    an id follow each other by their texts' hashes.
    """
    return tokens.token_index(docs, tokenizer_path())


STAGES = [
    ("language id", known_language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", token_ids),
]
#: Language models, shingle sets and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
