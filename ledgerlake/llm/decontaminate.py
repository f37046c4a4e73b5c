"""Benchmark decontamination: words of documents that stand in passages of a benchmark.

Method: winnowing.  Of every ``WINDOW`` successive hashes of ``GRAM`` words the least is
kept, with its place, as a fingerprint.  A span of ``SPAN`` words holds just so many
hashes, so it keeps the same fingerprint wherever it stands, and every shared span of
``SPAN`` words or more shares one.  Documents' fingerprints are joined with those of the
items; a hit is extended to the spans that hold its place, and these are
compared with the items' as text.  An item of fewer words is a span itself; for
each such length found among the items, all hashes of so many words are fingerprints.

Everything is DataFrame functions.  Words are hashed row by row; one row per place then
computes the grams around it and their least inside generated code, and only
fingerprints that an item has too go further.  The items' distinct fingerprints are
broadcast where they are at most ``SENT`` rows of two numbers; more are met by a join
whose frequent keys are salted.  A document's hits are combined before they meet
texts, and only texts with a hit are read again, so a passage that stands in a third of all
documents costs a row a document.  A span carries the set of items that hold it, so one
shared by all items does not multiply rows.

Defined results: null and empty texts have no words; an item without words is left
out; a text of fewer words than a span cannot hold it; items that share an id are
one item of several texts, a null item id is no item; every document row is
returned, also a repeated one, and null ids may stand; empty tables give zero
counts or an empty result; other columns are left out; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash128, lower_ascii, read, salted_join, stored

SPAN = 10                   # words of a passage
GRAM = 5                    # words hashed together
WINDOW = SPAN - GRAM + 1    # hashes of which the least is kept
SENT = 1 << 20              # rows (of 16 bytes) that a broadcast may have
SENT_SPANS = 1 << 16        # spans (text and items) that a broadcast may have
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE = (1 << 31) - 1       # bits for a place, below those of a hash
KEY = ["_d", "_t1", "_t2"]


def words(text: Column) -> Column:
    """A text's words, A-Z lower-cased; null: none."""
    text = F.coalesce(text, F.lit(""))
    # Of ASCII texts both ways give the same, and ``lower`` is the faster.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(low, NOT_WORD), "")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def packed(digest: Column, at: Column) -> Column:
    """33 bits of a hash above the 31 of a place."""
    return digest.bitwiseAND(~PLACE).bitwiseOR(at.cast("long"))


def grams(h: Column, at: Column, first: int) -> dict[str, Column]:
    """The numbers of the grams that a span at a place holds, from the ``first`` on (-1: also the one before)."""
    return {f"_g{k}": packed(F.xxhash64(*[F.get(h, at + (k + j)) for j in range(GRAM)]), at + k)
            for k in range(first, WINDOW)}


def short_print(h: Column, at: Column, n: int) -> Column:
    """The hash of a run of ``n`` words."""
    return packed(F.xxhash64(F.lit(n), *[F.get(h, at + k) for k in range(n)]), at)


def print_of(number: Column) -> Column:
    return number.bitwiseAND(~PLACE)


def item_spans(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """The items' distinct spans: ``words`` (joined by spaces), ``length`` in words, ``print`` (the hash
    part of its fingerprint) and ``items`` (ids, sorted)."""
    # The words pass through a generator, so that they are computed once.
    rows = (items.filter(F.col(item_col).isNotNull())
            .select(F.col(item_col).alias("item"), F.explode(F.array(words(F.col(text_col)))).alias("_w"))
            .filter(F.size("_w") > 0))
    spans = rows.select("item", F.explode(F.transform(
        F.slice(F.col("_w"), 1, F.greatest(F.size("_w") - (SPAN - 1), F.lit(1))),
        lambda _, i: F.slice("_w", i + 1, SPAN))).alias("s"))
    spans = (spans.select("item", F.concat_ws(" ", "s").alias("words"), F.size("s").alias("length"),
                          word_hashes(F.col("s")).alias("h"))
             .groupBy("words", "length").agg(F.first("h").alias("h"), F.sort_array(F.collect_set("item")).alias("items")))
    h, first = F.col("h"), F.lit(0)
    number = F.coalesce(F.when(F.col("length") == SPAN, F.least(*grams(h, first, 0).values())),
                        *[F.when(F.col("length") == n, short_print(h, first, n)) for n in range(1, SPAN)])
    return spans.select("words", "length", print_of(number).alias("print"), "items")


def fingerprints(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``length`` of the spans it is for, ``print`` and ``place`` of every fingerprint (other rows have a null print),
    and per row of ``docs`` one with place -1, whose print is its number of words.

    The steps are separate projections, so that generated code computes each number once."""
    h, at, n = F.col("_h"), F.col("_at"), F.col("_n")
    hashed = docs.select(*KEY, word_hashes(words(F.col("_x"))).alias("_h"))
    last = F.greatest(F.size(h) - SPAN, F.lit(-1)) if SPAN in lengths else F.lit(-1)
    rows = hashed.select(*KEY, "_h", F.explode(F.sequence(F.lit(-1), last)).alias("_at"))
    rows = rows.select(*KEY, F.size(h).cast("long").alias("_n"), at, *[c.alias(k) for k, c in grams(h, at, -1).items()])
    rows = rows.select(*KEY, n, at, F.least(*[F.col(f"_g{k}") for k in range(WINDOW)]).alias("_now"),
                       F.least(*[F.col(f"_g{k}") for k in range(-1, WINDOW - 1)]).alias("_before"))
    # Of neighbours with the same fingerprint the first has it.
    new = (at == 0) | (F.col("_now") != F.col("_before"))
    found = rows.select(*KEY, F.lit(SPAN).alias("length"),
                        F.when(at < 0, n).when(new, print_of(F.col("_now"))).alias("print"),
                        F.when(at < 0, at).otherwise(F.col("_now").bitwiseAND(PLACE).cast("int")).alias("place"))
    short = [k for k in lengths if k < SPAN]
    if short:
        least = F.size(h) - min(short)
        numbers = F.array(*[F.struct(F.lit(k).alias("length"), F.when(at <= F.size(h) - k, short_print(h, at, k)).alias("p"))
                            for k in short])
        found = found.unionAll(
            hashed.select(*KEY, "_h", F.explode(F.when(least >= 0, F.sequence(F.lit(0), F.greatest(least, F.lit(0))))).alias("_at"))
            .select(*KEY, "_at", F.explode(numbers).alias("s"))
            .select(*KEY, "s.length", print_of(F.col("s.p")).alias("print"), "_at"))
    return found


def hits(docs: DataFrame, spans: DataFrame, lengths: list[int]) -> DataFrame:
    """Per distinct document (``_d`` and text hash): ``copies`` (its rows), ``n_words``, and ``hits``, an array
    of (length of the span, place of a fingerprint that an item has too)."""
    found = fingerprints(docs, lengths)
    wanted = stored(spans.select("length", "print").distinct(), "prints")
    if wanted.count() <= SENT:
        # The rows of place -1 meet a print by chance at most; they pass anyway.
        met = (found.join(F.broadcast(wanted.withColumn("hit", F.lit(True))), ["length", "print"], "left")
               .filter(F.col("hit") | (F.col("place") < 0)).drop("hit"))
    else:
        found = stored(found, "found")
        met = (salted_join(found.filter("place >= 0 AND print IS NOT NULL"), wanted, ["length", "print"], [*KEY, "place"])
               .unionByName(found.filter("place < 0")))
    one = F.col("place") < 0
    return met.groupBy(*KEY).agg(
        F.count_if(one).alias("copies"), F.max(F.when(one, F.col("print"))).alias("n_words"),
        F.collect_set(F.when(~one, F.col("place").cast("long") * 16 + F.col("length"))).alias("hits"))


def _starts(n: Column, hit: Column) -> Column:
    """Where the spans that hold a hit may start: 16 times the place, and the length."""
    place, length = F.shiftright(hit, 4), hit.bitwiseAND(15)
    low = F.when(length == SPAN, F.greatest(place - (WINDOW - 1), F.lit(0))).otherwise(place)
    high = F.least(place, n - length)
    return F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda s: s * 16 + length))


def covered(found: Column) -> Column:
    """The words inside the spans of a sorted array of (start, length)."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(found, none, lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n")),
        lambda a: a["n"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: ``doc_id``, ``n_words``, ``spans`` (sorted array of start and length in words) and
    ``items`` (sorted array of the ids of items with a span in it)."""
    spans = stored(item_spans(items, item_col, item_text_col), "spans")
    kind = spans.schema["items"].dataType
    lengths = sorted(r["length"] for r in spans.select("length").distinct().collect())  # SPAN rows at most
    t1, t2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_d"), t1.alias("_t1"), t2.alias("_t2"), F.col(text_col).alias("_x"))
    marked = stored(hits(rows, spans, lengths).withColumn("row", F.monotonically_increasing_id()), "hits")
    # Only texts with a hit are read again, one of each document.
    m = marked.filter(F.size("hits") > 0).select("row", "hits", *[F.col(c).alias(f"m{c}") for c in KEY])
    again = (rows.join(m, F.col("_d").eqNullSafe(F.col("m_d")) & (F.col("_t1") == F.col("m_t1"))
                       & (F.col("_t2") == F.col("m_t2")))
             .select("row", "hits", F.explode(F.array(words(F.col("_x")))).alias("_w")))
    around = F.array_distinct(F.flatten(F.array_compact(F.transform("hits", lambda x: _starts(F.size("_w"), x)))))
    near = again.select("row", "_w", F.explode(around).alias("s"))
    start, length = F.shiftright("s", 4).cast("int"), F.col("s").bitwiseAND(15).cast("int")
    near = near.select("row", start.alias("start"), length.alias("length"),
                       F.concat_ws(" ", F.slice("_w", start + 1, length)).alias("words"))
    if spans.count() <= SENT_SPANS:
        real = near.join(F.broadcast(spans.select("words", "length", "items")), ["words", "length"])
    else:
        real = salted_join(near, spans.select("words", "length", "items"), ["words", "length"], ["row", "start"])
    real = real.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
                                   F.collect_set("items").alias("items"))
    every = F.sort_array(F.array_distinct(F.flatten("items")))
    return (marked.join(real, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("_d").alias("doc_id"), "n_words",
                    F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
                    F.coalesce(every, F.array().cast(kind)).alias("items")))


def op13_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return (found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"),
                         F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP13_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
spans AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(list_slice(w, place, place + 9), ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS place FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT length FROM spans),
runs AS (
  SELECT row, length, place, array_to_string(list_slice(w, place, place + length - 1), ' ') AS words
  FROM (SELECT row, w, length, unnest(range(1, len(w) - length + 2)) AS place FROM docs, lengths WHERE len(w) >= length)),
found AS (SELECT row, r.length, place, item_id FROM runs r JOIN spans s ON r.words = s.words AND r.length = s.length),
counts AS (
  SELECT row, count(DISTINCT place + k) AS n_hit
  FROM (SELECT DISTINCT row, place, length FROM found) f, range(10) t(k) WHERE k < length GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counts USING (row) LEFT JOIN named USING (row)
"""
