"""Line dedup: drop lines that many documents share.

Method: explode the normalised lines, hash them, count the distinct documents
of each hash, drop the lines over the threshold and reassemble each text by
line position.

Only hashes, ids and positions of long lines are shuffled for the counts.
Distinct (line, document) pairs are formed first, so a line found in a third
of all documents reaches its count as one partial row per task, and its lines
are salted when they meet the count.  The text is
shuffled once, to meet its dropped positions; documents that lose nothing
keep their lines without any regrouping.

Defined results:
- null or empty text: one empty line;
- a null ``doc_id``: all rows without an id count as one document, which
  precedes every other;
- repeated rows and several texts of one ``doc_id``: each row is returned;
  lines are counted once per ``doc_id``;
- an empty table gives an empty result; other columns pass through unchanged
  (input columns named like an output column are replaced by it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, from_row, hash128, in_row, lower_ascii, out_of_row, salted_join

MIN_CHARS = 20
MIN_DOCS = 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, with A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def _long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line long enough to count: document, text hash, position, line hash."""
    t1, t2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    lines = docs.select(F.col(id_col).alias("_d"), t1.alias("_t1"), t2.alias("_t2"),
                        F.posexplode(split_lines(F.col(text_col))).alias("_pos", "_line"))
    key = line_key(F.col("_line"))
    h1, h2 = hash128(F.col("_k"))
    return (lines.select("_d", "_t1", "_t2", "_pos", key.alias("_k"))
            .filter(F.length("_k") >= min_chars)
            .select("_d", "_t1", "_t2", "_pos", h1.alias("_h1"), h2.alias("_h2")))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hash of every line held by ``min_docs`` documents, and the document that keeps it."""
    pairs = (_long_lines(docs, id_col, text_col, min_chars)
             .select("_h1", "_h2", "_d").distinct())
    return (pairs.groupBy("_h1", "_h2")
            .agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_keeper"))
            .filter(F.col("_n") >= min_docs).select("_h1", "_h2", "_keeper"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    ``docs`` is read three times, so pass a table or a stored frame."""
    shared = shared_lines(docs, id_col, text_col, min_chars, min_docs)
    lines = _long_lines(docs, id_col, text_col, min_chars)
    dropped = (salted_join(lines, shared, ["_h1", "_h2"], ["_t1", "_t2", "_pos", "_d"])
               .filter(~F.col("_d").eqNullSafe(F.col("_keeper")))
               .groupBy("_d", "_t1", "_t2")
               .agg(F.collect_set("_pos").alias("_drop")))
    text = F.coalesce(from_row(text_col), F.lit(""))
    t1, t2 = hash128(text)
    base = in_row(docs).withColumns({"_u1": t1, "_u2": t2})
    joined = base.join(dropped, from_row(id_col).eqNullSafe(F.col("_d"))
                       & (F.col("_u1") == F.col("_t1")) & (F.col("_u2") == F.col("_t2")), "left")
    positions = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    rebuilt = F.when(F.col("_drop").isNull(), text).otherwise(
        F.array_join(F.transform(positions, lambda p: F.get(F.col("_lines"), p)), "\n"))
    return joined.withColumn("_lines", split_lines(from_row(text_col))).select(*out_of_row(docs.columns, {
        "kept_text": rebuilt, "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long")}))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS pos) u),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line,
         s.k IS NOT NULL AND l.doc_id <> s.keeper AS dropped
  FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
