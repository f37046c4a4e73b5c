"""A training-corpus pipeline over the table ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written
as Parquet and reread as the next stage's ``docs``.  All but the last return the
columns of ``documents`` and any others that ``docs`` has, whatever their names; an
empty table passes as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import langid, pii
from ledgerlake.llm.common import from_row, in_row, out_of_row, read, stored
from ledgerlake.llm.line_dedup import dedup_lines
from ledgerlake.llm.near_dup import near_duplicates
from ledgerlake.llm.packing import pack_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and ``rest``, a struct of all other columns, whose names meet no other."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("rest"))


def restored(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``documents`` with a new text and its length."""
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or far from every language learned, go;
    others stay as they are, repeated rows and null ids too."""
    model = langid.fit(langid.learnable(docs))
    kept = langid.predict(carried(docs), model).filter("NOT rejected")
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"rest.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents share; a null text becomes an empty one."""
    return restored(dedup_lines(carried(docs)), docs.columns, F.col("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.  Texts without words are
    no copies; rows that share an id stay or go together; rows with a null id stay as
    ``near_duplicates`` keeps their group."""
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    rows = in_row(docs)
    same = from_row("doc_id").eqNullSafe(kept["doc_id"])
    return rows.join(kept, same, "left_semi").select(*out_of_row(docs.columns, {}))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind; null texts stay null."""
    return restored(pii.redact(carried(docs)), docs.columns, F.col("redacted"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each document stands.  A null text is empty; every row is
    packed, also a repeated one; an empty table gives an empty result."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("packing", packing),
]

# Language ID, near-dedup on signatures, trees and packing are beyond SQL;
# tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
