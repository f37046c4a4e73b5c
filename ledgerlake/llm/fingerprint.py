"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs: at line ends, after every sentence inside a
line, and, ``STRETCH`` characters into a stretch without such an end, after
words (characters, where words are long) that a hash picks, so equal passages
are cut alike wherever they stand.  Each distinct paragraph's digest is added to one
cell of each of three tables; a cell holds a count and the XOR of its digests, of
which ``CHECK_BITS`` bits check the others.  Subtracting two sketches cancels what the
texts share; peeling then takes out cells that hold one digest, again and
again, until all differing digests are recovered.  The recovered
counts give the likeness: shared paragraphs over all paragraphs of both.

A fingerprint is a small sketch of ``CELLS`` cells, written out.  Two texts are compared by
sketches sized by their numbers of paragraphs; a pair that could not be peeled
is tried again with tables twice as large and other cells.  Sketches are rows of
cells, built by a hash aggregate of counts and XORs; empty cells are no rows, so
large tables cost nothing.  A round of peeling is two more aggregates: one lets
the cells that hold the same digest name it once, one takes it out of its
cells.

Everything is DataFrame functions.  The next document (descending id) is
found inside id ranges bounded by quantiles, of about ``RANGE_ROWS`` rows each, fewer if
these have over ``RANGE_CHARS`` characters; the first row of each range is also sent to the
range before, so one window with one shuffle of the texts is enough.  That is the
only shuffle of all rows: cells are grouped by range first, so sketches are built and
peeled where the texts arrive, a row's other columns standing among its cells
as one more group.  Written out are small sketches and likenesses, and digests only
of rows that are tried again.

Defined results: null text is empty; an empty text has no paragraphs, and two
empty texts are alike (1.0); a null id comes after all others; rows that share an
id follow each other by text hash; a single row is its own next; every row,
also a repeated one, is returned; other columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, stored

TABLES, TABLE = 3, 16
CELLS = TABLES * TABLE   # of a fingerprint
SPACE = 2                # cells of each table of a comparison, per paragraph of both texts
ROUNDS = 4               # of peeling, before a retry
CHECK_BITS = 16
TABLE_BITS = 40          # a cell's number is below these bits, its table's above
RANGE_ROWS = 1024
RANGE_CHARS = 1 << 22
LOWEST = -(1 << 63)
# Line ends, and spaces after a sentence, also one closed by a quote or bracket.
CUT = "[\\n ](?<=\\n|[.!?…؟۔।] |[.!?…؟۔।][\"'”’)\\]] )"
ENDS = "。！？"          # sentence ends that no space follows
STRETCH = 96             # characters without a cut before words may end a paragraph
WORD = 32                # characters; longer runs without a space count by the character
PICKED = 8               # one of so many words ends a paragraph
LEVELS = 24              # more retries are never needed


def _stretch(part: Column) -> Column:
    """The paragraphs of a stretch without a sentence or line end: what follows its
    first ``STRETCH`` characters is also cut after words picked by their hash."""
    def ended(w: Column) -> Column:
        return F.when(F.pmod(F.xxhash64(w), F.lit(PICKED)) == 0, F.concat(w, F.lit("\n"))).otherwise(w)

    words = F.transform(F.split(F.substring(part, F.lit(STRETCH + 1), F.length(part)), " ", -1), lambda w: F.when(
        F.length(w) > WORD, F.array_join(F.transform(F.split(w, ""), ended), "")).otherwise(ended(w)))
    return F.split(F.concat(F.substring(part, 1, STRETCH), F.array_join(words, " ")), "\n ?", -1)


def paragraphs(text: Column) -> Column:
    """A text's paragraphs, in order."""
    for end in ENDS:
        text = F.replace(text, F.lit(end), F.lit(f"{end}\n"))
    parts = F.flatten(F.transform(F.split(text, CUT, -1), lambda p: F.when(
        F.length(p) > STRETCH, _stretch(p)).otherwise(F.array(p))))
    return F.filter(parts, lambda p: F.length(p) > 0)


def _check(d: Column) -> Column:
    return F.xxhash64(F.shiftright(d, CHECK_BITS)).bitwiseAND((1 << CHECK_BITS) - 1)


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs, their last bits a check of the others."""
    high = lambda h: F.shiftleft(F.shiftright(h, CHECK_BITS), CHECK_BITS)
    plain = F.array_distinct(F.transform(paragraphs(text), lambda p: high(F.xxhash64(p))))
    return F.transform(plain, lambda d: d.bitwiseOR(_check(d)))


def cell(d: Column, table: Column, bits: Column, salt: int) -> Column:
    """A digest's cell in one of the tables of 2 to the power ``bits`` cells, numbered through."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    inside = F.xxhash64(F.lit(salt), table, d).bitwiseAND(size - 1)
    return table.cast("long") * (1 << TABLE_BITS) + inside


def peeled(pairs: DataFrame, level: int, part: tuple[str, ...] = (), held: tuple[str, ...] = ()) -> DataFrame:
    """``row``, ``of``, ``plus`` and ``minus`` (digests only in the first, only in the second set, as far as
    recovered) and ``left``, the cells that still hold some, of pairs (row, of, a, b: digests).

    Pairs without a difference have no row.  All is grouped by ``part`` and row first, so pairs that are dealt by
    these are built and peeled where they are.  What ``held`` names is carried along: each pair with such
    a column that is not null has a row more with that column, in which nothing is counted."""
    none = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in held]
    sides = [F.struct(F.lit(k).alias("n"), F.col(ds).alias("ds"), *none) for k, ds in ((1, "a"), (-1, "b"))]
    if held:
        sides.append(F.struct(F.lit(0).alias("n"), F.array(F.lit(0).cast("long")).alias("ds"), *held))
    need = F.greatest(SPACE * (F.size("a") + F.size("b")), F.lit(TABLE))
    bits = F.ceil(F.log2(need)).cast("int") + level
    tables = F.explode(F.when(F.col("n") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(TABLES)))))
    rows = pairs.select(*part, "row", "of", bits.alias("bits"), F.explode(F.array(*sides)).alias("s"))
    rows = rows.select(*part, "row", "of", "bits", "s.n", *[f"s.{c}" for c in held], F.explode("s.ds").alias("x"))
    rows = rows.select("*", tables.alias("t"))
    at = F.when(F.col("n") == 0, F.lit(-3)).otherwise(cell(F.col("x"), F.col("t"), F.col("bits"), level))
    pair = [*part, "row", "of", "bits", *held]
    keys = [*pair, "at"]
    full = " OR ".join(["n <> 0", "x <> 0", *[f"{c} IS NOT NULL" for c in held]])

    def cells(r: DataFrame) -> DataFrame:
        """The cells that hold something; those below 0 count what was recovered, or hold other columns."""
        out = r.groupBy(*keys).agg(F.sum("n").cast("int").alias("n"), F.bit_xor("x").alias("x"))
        return out.filter(full)

    now = cells(rows.select(*pair, "n", "x", at.alias("at")))
    for _ in range(ROUNDS):
        x, n = F.col("x"), F.col("n")
        mine = cell(x, F.shiftright("at", TABLE_BITS).cast("int"), F.col("bits"), level) == F.col("at")
        single = (F.col("at") >= 0) & (F.abs(n) == 1) & (_check(x) == x.bitwiseAND((1 << CHECK_BITS) - 1)) & mine
        # A cell passes itself on, and names its digest if it holds one; cells that hold the same name it once.
        kinds = F.when(single, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        named = now.select(*keys, "n", "x", F.explode(kinds).alias("kind"))
        named = (named.select(*pair, "kind", F.when(F.col("kind") == 0, F.col("at")).otherwise(x).alias("at"), "n", "x")
                 .groupBy(*pair, "kind", "at").agg(F.max("n").alias("n"), F.max("x").alias("x")))
        # A named digest leaves its three cells and is counted (table 3).
        named = named.select(*pair, "kind", "at", "n", "x", F.explode(F.when(
            F.col("kind") == 0, F.array(F.lit(-1))).otherwise(F.array(*map(F.lit, range(TABLES + 1))))).alias("t"))
        out = F.col("t").between(0, TABLES - 1)
        count = F.col("t") == TABLES
        now = cells(named.select(
            *pair, F.when(out, cell(x, F.col("t"), F.col("bits"), level)).when(count, F.when(n > 0, F.lit(-1)).otherwise(F.lit(-2)))
            .otherwise(F.col("at")).cast("long").alias("at"),
            F.when(out, -n).when(count, F.lit(1)).otherwise(n).alias("n"), F.when(count, F.lit(0)).otherwise(x).cast("long").alias("x")))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("at") == k, F.col("n"))), F.lit(0))
    return now.groupBy(*part, "row", "of", *held).agg(of(-1).alias("plus"), of(-2).alias("minus"), F.count_if(F.col("at") >= 0).alias("left"))


def likeness(a: Column, b: Column, plus: Column, minus: Column) -> Column:
    """Shared over all paragraphs, from set sizes and recovered differences."""
    every = a + minus
    return F.when(every == 0, F.lit(1.0)).otherwise((a - plus) / every).cast("double")


def compare(pairs: DataFrame, first: int = 0) -> DataFrame:
    """``row``, ``of`` and ``near`` of pairs (row, of, a, b: digests), of which ``row`` and ``of`` are the key."""
    done = []
    for level in range(first, LEVELS):
        sizes = pairs.select("row", "of", F.size("a").alias("a"), F.size("b").alias("b"))
        found = sizes.join(peeled(pairs, level), ["row", "of"], "left")
        plus, minus, left = (F.coalesce(c, F.lit(0)) for c in ("plus", "minus", "left"))
        near = F.when(left == 0, likeness(F.col("a"), F.col("b"), plus, minus))
        tried = stored(found.select("row", "of", near.alias("near")), f"level{level}")
        done.append(tried.filter("near IS NOT NULL"))
        again = tried.filter("near IS NULL").select("row", "of")
        if again.isEmpty():
            return reduce(DataFrame.unionAll, done)
        pairs = stored(pairs.join(again, ["row", "of"], "left_semi"), "again").repartition("row")
    raise RuntimeError("sketches cannot be peeled: digests collide")


def _longs(xs: list[int]) -> Column:
    """A constant array, also a long one, by one expression."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")


def _range(k: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``k``: looked up among every so many of them, then among those between."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= k))
    block = upto(_longs(bounds[step::step])) if len(bounds) > step else F.lit(0)
    return block * step + upto(F.slice(_longs(bounds), block * step + 1, F.lit(step)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text``, its digests ``a``, and ``next_text`` and ``c``, those of the next row by
    descending id; dealt by ``_part``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"_k": F.coalesce("doc_id", F.lit(LOWEST)), "_h": F.xxhash64("text")})
    keys = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_k"))
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length(text_col).cast("long"))).first()
    if not n:
        rows = rows.withColumn("a", digests(F.col("text")))
        return rows.select(F.lit(0).alias("_part"), "doc_id", "text", "a", F.col("text").alias("next_text"), F.col("a").alias("c"))
    ranges = min(n, max(-(-n // RANGE_ROWS), -(-(chars or 0) // RANGE_CHARS)))
    bounds = sorted(set(keys.agg(F.percentile_approx("_k", [k / ranges for k in range(1, ranges)] or [0.5], 25 * ranges))
                        .first()[0])) if ranges > 1 else []
    part = _range(F.col("_k"), bounds).alias("_part")
    heads = sorted((r["_part"], r["first"]) for r in
                   keys.groupBy(part).agg(F.max("_k").alias("first")).collect())  # a row a range
    first, above = dict(heads), {p: heads[(k + 1) % len(heads)][0] for k, (p, _) in enumerate(heads)}
    of = lambda d: F.get(_longs([d.get(p, 0) for p in range(len(bounds) + 1)]), F.col("_at"))
    also = F.when(F.col("_k") == of(first), of(above).cast("int"))
    places = F.array_compact(F.array(F.struct(F.col("_at").alias("_part"), F.lit(0).alias("_copy")),
                                     F.when(also.isNotNull(), F.struct(also.alias("_part"), F.lit(1).alias("_copy")))))
    w = Window.partitionBy("_part").orderBy("_copy", F.desc("_k"), "_h")
    # The texts are shuffled without their digests, which are made where the rows arrive.
    return (rows.withColumn("_at", part).withColumn("_p", F.explode(places)).select("doc_id", "text", "_k", "_h", "_p.*")
            .repartition(max(8, len(heads)), "_part")
            .withColumn("a", digests(F.col("text"))).withColumns({"next_text": F.lead("text").over(w), "c": F.lead("a").over(w)}).filter("_copy = 0")
            .select("_part", "doc_id", "text", "a", "next_text", "c"))


def edited(text: Column, following: Column) -> Column:
    """The last half of a text replaced by the first as many characters of another."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compared(rows: DataFrame) -> DataFrame:
    """Rows (_part, row, a, b, c: digests, and others) with ``near0`` and ``near1``, the likenesses of a and b, of a
    and c; null where they could not be peeled.  Without a shuffle, if rows are dealt by ``_part``."""
    held = F.struct(*[c for c in rows.columns if c not in ("_part", "row")])
    none = F.lit(None).cast(rows.select(held.alias("held")).schema["held"].dataType)
    a, b, c = map(F.col, "abc")
    both = F.array(F.struct(F.lit(0).alias("of"), a, b, held.alias("held")), F.struct(F.lit(1).alias("of"), a, c.alias("b"), none.alias("held")))
    pairs = rows.select("_part", "row", F.explode(both).alias("p")).select("_part", "row", "p.*")
    of = lambda k, name: F.coalesce(F.sum(F.when(F.col("of") == k, F.col(name))), F.lit(0)).alias(f"{name}{k}")
    found = (peeled(pairs, 0, ("_part",), ("held",)).groupBy("_part", "row")
             .agg(F.first("held", True).alias("held"), *[of(k, name) for k in (0, 1) for name in ("plus", "minus", "left")]))
    near = [F.when(F.col(f"left{k}") == 0, likeness(F.size("held.a"), F.size(f"held.{ds}"), F.col(f"plus{k}"), F.col(f"minus{k}")))
            .alias(f"near{k}") for k, ds in ((0, "b"), (1, "c"))]
    return found.select("_part", "row", "held.*", *near)


def sketched(rows: DataFrame) -> DataFrame:
    """Rows (_part, row, a, b: digests, and others) with ``cells0`` and ``cells1``: the cells of small sketches of
    a and b that hold something, in order.  Without a shuffle, if rows are dealt by ``_part``."""
    held = F.struct(*[c for c in rows.columns if c not in ("_part", "row")])
    none = F.lit(None).cast(rows.select(held.alias("held")).schema["held"].dataType)
    nothing = F.array(F.lit(0).cast("long"))
    sides = F.array(*[F.struct(F.lit(k).alias("of"), ds.alias("ds"), h.alias("held"))
                      for k, (ds, h) in enumerate(((F.col("a"), none), (F.col("b"), none), (nothing, held)))])
    one = rows.select("_part", "row", F.explode(sides).alias("s")).select("_part", "row", "s.of", "s.held", F.explode("s.ds").alias("x"))
    one = one.select("*", F.explode(F.when(F.col("of") == 2, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(TABLES))))).alias("t"))
    inside = F.xxhash64(F.lit(0), "t", "x").bitwiseAND(TABLE - 1)
    cells = (one.groupBy("_part", "row", "of", "held", (F.col("t") * TABLE + inside).cast("int").alias("at"))
             .agg(F.count(F.lit(1)).cast("int").alias("n"), F.bit_xor("x").alias("x")))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("of") == k, F.struct("at", "n", "x")))).alias(f"cells{k}")
    return (cells.groupBy("_part", "row").agg(F.first("held", True).alias("held"), of(0), of(1))
            .select("_part", "row", "held.*", "cells0", "cells1"))


def written(cells: Column) -> Column:
    """A fingerprint: cells, each as ``number:count:digests`` (XOR, hexadecimal), comma-joined."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["at"], c["n"], F.hex(c["x"]))), ",")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, and the likenesses."""
    rows = with_next(docs, id_col, text_col).withColumn("e", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("_part", F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("e", 256).alias("edited_sha256"), "a", digests(F.col("e")).alias("b"), "c")
    rows = sketched(compared(rows))
    out = ["doc_id", "n_chars", "edited_sha256", "cells0", "cells1", "near0", "near1"]
    # Digests of rows that are tried again alone are written.
    failed = F.col("near0").isNull() | F.col("near1").isNull()
    rows = stored(rows.select("row", *out, *[F.when(failed, F.col(c)).alias(c) for c in "abc"]), "sketches")
    again = rows.filter("a IS NOT NULL")
    if not again.isEmpty():
        a, b, c = map(F.col, "abc")
        both = F.array(F.struct(F.lit(0).alias("of"), a, b), F.struct(F.lit(1).alias("of"), a, c.alias("b")))
        near = (compare(again.select("row", F.explode(both).alias("p")).select("row", "p.*").repartition("row"), 1).groupBy("row")
                .agg(*[F.max(F.when(F.col("of") == k, F.col("near"))).alias(f"near{k}") for k in (0, 1)]))
        rows = rows.filter("a IS NULL").select(out).unionAll(again.drop("near0", "near1").join(near, "row").select(out))
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("cells0")).alias("fingerprint"),
                       written(F.col("cells1")).alias("edited_fingerprint"), F.col("near0").alias("near_edited"), F.col("near1").alias("near_next"))


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
