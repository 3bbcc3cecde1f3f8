"""From raw documents to packed training sequences, in stages that are written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import languages, quality
from textloom.llm.common import discard, pick, stored, table, tokenizer_path
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.minhash import near_duplicates
from textloom.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.5 go."""
    docs = _documents(docs)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that holds 0.4 of them, go."""
    docs = _documents(docs)
    return languages.accepted(docs, languages.fit(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    out = dedup_lines(_documents(docs), carry=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    docs = _documents(docs)
    found = near_duplicates(docs)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "gone")
    discard(*found._reads)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers decide, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
