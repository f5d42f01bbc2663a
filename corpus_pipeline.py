"""The corpus pipeline (part of the ``llm`` subpackage): documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
back as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, jaccard, language, mixing, suffix
from foliospark.llm.common import materialize, table
from foliospark.llm.entries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, letters unlike any learned language, or no language with three tenths of
    the letters (a text half in one and half in another stays).  A null lang takes the prediction.  Rows are judged one by one."""
    return language.keep_identified(docs.select(COLUMNS), language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest id, of each group linked by five-word shingles of a similarity of 0.8 and more.

    Rows of one id with unlike texts are different documents, a null id is the greatest, and one of rows that
    repeat id and text stays.  Texts without words stay."""
    return jaccard.keep_one(docs.select(COLUMNS), words=5, percent=80)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 200 and more that occur elsewhere, at whole characters, but for the first place of each.

    Places are in order of id (null last) and position, so no text is lost everywhere.  A document of which nothing but
    white space is left goes; one that was so before stays."""
    cut = suffix.remove_repeats(docs, keep_text=True, keep=["lang", "source"], keep_first=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the Pfair schedule: files, and rows within, follow the slots.

    Drops no row: repeated rows, null ids and null sources each have their place."""
    slots = mixing.interleave(docs, carry=[c for c in COLUMNS if c not in ("doc_id", "source")])
    return slots.repartitionByRange("slot").sortWithinPartitions("slot", "doc_id").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left of each document, digests of the ids and their decoding, and its place in the mix.

    ``part`` and ``place`` are the number of the file and of the row in it that the stage before wrote: in order of both the
    documents follow the schedule.  Null where ``docs`` does not come from files."""
    if docs.inputFiles():
        part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1)
        placed = docs.select("doc_id", "text", part.try_cast("int").alias("part"), F.col("_metadata.row_index").alias("place"))
    else:
        placed = docs.select("doc_id", "text", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("place"))
    return bpe.encode(placed, vocabulary("word_bpe_49k.json"), keep_ids=True, carry=["part", "place"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("mix", mix),
    ("encode", encode),
]

#: Language identification and the schedule cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
