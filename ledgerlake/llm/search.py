"""Ranked lexical search: every document scored against every item, by dense blocks.

Method: dense blocked matrix multiplication.  The items form a matrix of item by
term (a term's weight, times its occurrences in the item), the documents one of
term by document (a term's impact in the document).  Both are cut into tiles; each pair of tiles is multiplied as float64 by BLAS, and the tiles' products are added as
64-bit integers.  All numbers are integers, and a term tile is narrow enough that every
partial sum stays below 2^53, so the products are exact.  A document block
keeps, per item, its best scores against the running bound; ties with
the bound stay until ids have settled them.

Documents are split into terms once per item tile.  What is kept of a document, its
length and the items' terms that it holds, goes to a table; the counts over all
documents (their number, their terms, the documents of each term) come from that
table.  Whole items are taken together up to ``TILE_ENTRIES`` different (item, term)
entries and ``TILE_ITEMS`` items (one item with more entries is taken alone); only so
much of them is sent to the tasks at a time, and the documents are read once for it.

The score of an item and a document is the sum over the item's terms, repeats
included, of ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))``, where
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 75 + (25 * n * N) div L``: N
documents with a term, L terms in all, df documents of the term, n terms of the
document, tf of them this one.

Defined results: null or empty text has no terms; a document without a term is
no result; an item without terms has no results; scores of 0 are left out; a
null id comes before others of its score; repeated documents and items are each
taken as they come (rows that share an item id each have their own ranks, rows
with equal scores and ids any order); empty tables give an empty result; texts
are read whole; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, read, stored

TOP = 20
TILE_ENTRIES = 1 << 19   # (item, term) entries sent to the tasks at once,
TILE_ITEMS = 4096        # of at most so many items
ITEM_ROWS = 256          # items,
TERM_COLUMNS = 1024      # terms
DOC_COLUMNS = 512        # and documents of the tiles multiplied
EXACT = 1 << 53          # integers below it are exact in float64
IMPACT = 1_000_000       # no impact is higher

# Bytes of terms as themselves (A-Z lower-cased), of everything else as spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                    for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """A text's terms, in order, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split() if text else []


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row per item row and term: ``item`` (a row number), ``item_id``, ``term``, ``times``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                found = Counter(terms(text))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(found), pa.int64()), pa.array([k] * len(found), b.schema.field(1).type),
                         pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                        names=["item", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col))
    kind = rows.schema["item_id"].dataType.simpleString()
    return stored(map_arrow(rows, run, f"item long, item_id {kind}, term binary, times long"), "items")


def tiles(entries: DataFrame, size: int) -> list[tuple[int, int]]:
    """Ranges of item numbers (low inclusive, high exclusive) of at most ``size`` entries and ``TILE_ITEMS`` items."""
    sizes = entries.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy("item")
    cuts, filled, held, low, high = [], 0, 0, None, None
    for r in sizes.toLocalIterator():  # two numbers an item, a partition at a time
        if low is None:
            low = r["item"]
        elif filled + r["n"] > size or held == TILE_ITEMS:
            cuts.append((low, r["item"]))
            low, filled, held = r["item"], 0, 0
        filled, held, high = filled + r["n"], held + 1, r["item"] + 1
    return cuts if low is None else [*cuts, (low, high)]


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """Per document: ``doc_id``, ``n`` (its terms), and the places in ``vocabulary`` of those it
    holds (``at``) with their counts (``tf``)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one item tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(sent.value)}
        for b in batches:
            n, at, tf, ends = [], [], [], [0]
            for text in b.column(1):
                found = terms(text.as_py())
                n.append(len(found))
                held = Counter(map(place.get, found))
                held.pop(None, None)
                at.extend(held.keys())
                tf.extend(held.values())
                ends.append(len(at))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tf, pa.int64()))],
                names=["doc_id", "n", "at", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return stored(map_arrow(rows, run, "doc_id long, n long, at array<int>, tf array<long>"), "postings")


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of integer matrices, entries of ``b`` at most ``IMPACT``: by BLAS where
    no sum can reach 2^53, else in narrower tiles, in integers where a single term is too much."""
    if not a.shape[1]:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    if int(a.sum(1).max()) * IMPACT < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if a.shape[1] == 1:
        return a.astype(np.int64) * b.astype(np.int64)
    half = a.shape[1] // 2
    return multiply(a[:, :half], b[:half]) + multiply(a[:, half:], b[half:])


class Best:
    """The best scores of each item so far; ties with the last one wait for ``settle``."""

    def __init__(self, items: int, top: int):
        self.top, self.bound = top, np.ones(items, np.int64)  # scores of 0 are no results
        self.item, self.score, self.doc, self.null = ([np.empty(0, np.int64)] for _ in range(4))
        self.waiting = 0

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Scores of all items against a block of documents."""
        rows, columns = np.nonzero(scores >= self.bound[:, None])
        for held, new in ((self.item, rows), (self.score, scores[rows, columns]), (self.doc, doc[columns]),
                          (self.null, null[columns])):
            held.append(new)
        self.waiting += len(rows)
        if self.waiting > max(1 << 18, 4 * self.top * len(self.bound)):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, doc, null = (np.concatenate(x) for x in (self.item, self.score, self.doc, self.null))
        order = np.lexsort((doc, 1 - null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.top
        last = rank == self.top - 1
        self.bound[item[last]] = score[last]
        kept = [x[keep] for x in (item, score, doc, null)]
        self.item, self.score, self.doc, self.null = ([x] for x in kept)
        self.waiting = 0
        return kept


def impacts(block: pa.RecordBatch, norm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, column (document of the block) and impact, ordered by term."""
    at = block.column("at")
    column = np.repeat(np.arange(block.num_rows), np.diff(at.offsets.to_numpy()))
    term, times = at.flatten().to_numpy(), block.column("tf").flatten().to_numpy()
    m = norm(block.column("n").to_numpy())[column]
    order = np.argsort(term, kind="stable")
    return term[order], column[order], ((1_000_000_000 * times) // (1000 * times + 12 * m))[order]


def score_block(tile: tuple[np.ndarray, ...], block: tuple[np.ndarray, ...], items: int, documents: int) -> np.ndarray:
    """Scores of all items of a tile (item, term, weight; ordered by term) against a block
    (term, column, impact; ordered by term).  Terms that the block lacks are left out."""
    (item, term, w), (has, column, impact) = tile, block
    held = np.unique(has)
    scores = np.zeros((items, documents), np.int64)
    for low in range(0, len(held), TERM_COLUMNS):
        here = held[low:low + TERM_COLUMNS]
        a, b = np.searchsorted(term, here[0]), np.searchsorted(term, here[-1], "right")
        place = np.minimum(np.searchsorted(here, term[a:b]), len(here) - 1)
        known = here[place] == term[a:b]
        rows, place, x = item[a:b][known], place[known], w[a:b][known]
        c, d = np.searchsorted(has, here[0]), np.searchsorted(has, here[-1], "right")
        right = np.zeros((len(here), documents), np.int64)
        right[np.searchsorted(here, has[c:d]), column[c:d]] = impact[c:d]
        for first in range(0, items, ITEM_ROWS):
            mine = (rows >= first) & (rows < first + ITEM_ROWS)
            left = np.zeros((min(ITEM_ROWS, items - first), len(here)), np.int64)
            left[rows[mine] - first, place[mine]] = x[mine]
            scores[first:first + ITEM_ROWS] += multiply(left, right)
    return scores


def best_of_tile(rows: DataFrame, numbers: np.ndarray, tile: tuple[np.ndarray, ...], documents: int, length: int,
                 top: int) -> DataFrame:
    """Each task's best documents per item of a tile: (item, score, doc_id)."""
    sent = rows.sparkSession.sparkContext.broadcast((numbers, tile))  # of one item tile

    def norm(n: np.ndarray) -> np.ndarray:
        if 25 * length * documents < 1 << 63:  # 25 * n * N fits 64 bits, as n <= L
            return 75 + (25 * n * documents) // length
        return np.array([75 + (25 * int(x) * documents) // length for x in n], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tile = sent.value
        best = Best(len(numbers), top)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_COLUMNS):
                block = batch.slice(at, DOC_COLUMNS)
                doc = block.column("doc_id")
                scores = score_block(tile, impacts(block, norm), len(numbers), block.num_rows)
                best.add(scores, doc.fill_null(0).to_numpy(), np.asarray(doc.is_null()).astype(np.int64))
        item, score, doc, null = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item]), pa.array(score), pa.array(doc, mask=null.astype(bool))],
                                         names=["item", "score", "doc_id"])

    return map_arrow(rows, run, "item long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, tile_entries: int = TILE_ENTRIES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's best documents."""
    spark = docs.sparkSession
    entries = item_terms(items, item_col, item_text_col)
    found = None
    for low, high in tiles(entries, tile_entries):
        tile = entries.filter((F.col("item") >= low) & (F.col("item") < high))
        got = tile.select("item", "term", "times").toPandas()  # at most tile_entries rows
        vocabulary = sorted(set(got["term"]))
        place = {t: k for k, t in enumerate(vocabulary)}
        rows = postings(docs, id_col, text_col, vocabulary)
        size = rows.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not size[0]:
            continue
        held = rows.select(F.explode("at").alias("at")).groupBy("at").count().toPandas()  # one row a term of the tile
        df = np.zeros(len(vocabulary), np.int64)
        df[held["at"].to_numpy()] = held["count"].to_numpy()
        weigh = [math.floor(1000 * math.log((2 * size[0] + 2) / (2 * int(n) + 1))) for n in df]
        at = np.array([place[t] for t in got["term"]])
        w = got["times"].to_numpy() * np.array(weigh, np.int64)[at]
        numbers, item = np.unique(got["item"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        best = best_of_tile(rows, numbers, (item[order], at[order], w[order]), size[0], size[1], top)
        found = best if found is None else found.unionAll(best)
    kind = entries.schema["item_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    best_first = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # Tasks' best meet in parts first, so an item's last step sees few rows of each.
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    few = (part.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best_first)))
           .filter(F.col("r") <= top))
    ranked = (few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best_first)))
              .filter(F.col("rank") <= top))
    return (ranked.join(entries.select("item", "item_id").distinct(), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

OP12_SQL = f"""
WITH held AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_SQL_TERMS} FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_SQL_TERMS} FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(s.docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, size s WHERE term IN (SELECT term FROM wanted) GROUP BY term),
scores AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (doc_id), size
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY rank <= 20
"""
