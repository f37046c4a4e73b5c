"""Dense numbers for rows in order, and pseudo-random permutations of them.

Rows are range-partitioned and sorted once, and stored with their place in
their partition.  Counts per partition then give each partition's first
number by a prefix sum in two levels (partitions inside blocks, then
blocks), so no window sees more than ``BLOCK`` rows of a block, or one row
a block, and none sees the table.

Names looked up by their number are packed, many a row, so that a table of
them is small enough to broadcast where a row a name would not be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import BROADCAST_MAX_BYTES

BLOCK = 1024
PACK_BITS = 5    # names a row: 2^5
BLOCK_BITS = 11  # rows a block of packed names, which is what tiles are made of: 2^11
ROW_BYTES = 64   # of a packed row, but for its names
MOST_TILES = 4
PRIME = 2147483647  # 2^31 - 1
MULTIPLIERS = (65521, 48271)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def numbered(df: DataFrame, group: list[str], order: list[str], work: str,
             rank: str = "rank", size: str = "n") -> DataFrame:
    """``df`` with each row's ``rank`` (from 0, in ``order`` with nulls first) and its
    group's ``size``.  ``work`` is a folder that keeps the sorted rows; rows equal in
    all of ``order`` stand in any order, which stays once stored."""
    at = F.monotonically_increasing_id()
    keys = [*group, "_part"]
    rows = (df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
            .withColumns({"_part": F.shiftright(at, 33), "_place": at.bitwiseAND((1 << 33) - 1)}))
    rows.write.mode("overwrite").parquet(work)
    rows = df.sparkSession.read.schema(rows.schema).parquet(work)
    counts = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("_place").alias("first"))
              .withColumn("_block", F.floor(F.col("_part") / BLOCK)))
    inside = Window.partitionBy(*group, "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*group, "_block").agg(F.sum("c").alias("c"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*[F.col(k).alias(f"_{k}") for k in [*group, "_block"]],
                           F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"),
                           F.sum("c").over(Window.partitionBy(*group, F.lit(0))).alias(size))
    firsts = counts.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    firsts = (firsts.join(starts, _same(firsts, starts, [*group, "_block"]))
              .select(*[F.col(k).alias(f"_{k}") for k in keys],
                      (F.col("start") + F.col("inside") - F.col("first")).alias("_shift"), size))
    return (rows.join(firsts, _same(rows, firsts, keys))
            .select(*df.columns, (F.col("_place") + F.col("_shift")).alias(rank), size))


def slot_keys(*parts: Column) -> list[Column]:
    """Four 32-bit numbers from the digest of a slot's name."""
    name = F.md5(F.concat_ws("|", *parts))
    return [F.conv(F.substring(name, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)]


def halves(n: Column) -> tuple[Column, Column]:
    """Two moduli whose product is n or a little more: about its square root each."""
    a = F.ceil(F.sqrt(n)).cast("long")
    return a, F.ceil(n / a).cast("long")


def _mixed(v, key, factor):
    return (v + key) * (factor % MULTIPLIERS[0] + 1) % PRIME * MULTIPLIERS[1] % PRIME


def _feistel(x, a, b, keys, div, mod):
    """Four Feistel rounds over pairs of a number below ``a`` and one below ``b``: each adds to one
    half a keyed mix of the other, so the pairs are permuted."""
    left, right = div(x, b), mod(x, b)
    k, m = keys, [*keys[1:], keys[0]]
    left = mod(left + _mixed(right, k[0], m[0]), a)
    right = mod(right + _mixed(left, k[1], m[1]), b)
    left = mod(left + _mixed(right, k[2], m[2]), a)
    right = mod(right + _mixed(left, k[3], m[3]), b)
    return left * b + right


def permuted(x: Column, n: Column, a: Column, b: Column, keys: list[Column]) -> Column:
    """The place of a number ``x`` (0 to n - 1) in a permutation of 0 to n - 1 that four ``keys`` pick;
    ``a`` and ``b`` are the ``halves`` of n.

    Feistel rounds permute the a * b pairs.  A number that leaves the range is permuted
    again until it is back (cycle walking): at most a * b - n < a times, and few
    numbers do.  n stays below 2^62 / 2^31."""
    def once(v: Column) -> Column:
        return _feistel(v, a, b, keys, lambda p, q: F.floor(p / q).cast("long"), lambda p, q: p % q)

    first = once(x)
    walked = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n, F.lit(1))), first,
                         lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(first < n, first).otherwise(walked)


class _Sql(str):
    """SQL text with the operators that ``_mixed`` uses."""

    def __add__(self, other):
        return _Sql(f"({str(self)} + {str(other)})")

    def __mul__(self, other):
        return _Sql(f"({str(self)} * {str(other)})")

    def __mod__(self, other):
        return _Sql(f"({str(self)} % {str(other)})")


def permuted_sql(x: str, n: str, a: str, b: str, keys: list[str]) -> str:
    """The same in DuckDB SQL."""
    def once(v: str) -> str:
        return str(_feistel(_Sql(v), _Sql(a), _Sql(b), [_Sql(k) for k in keys],
                            lambda p, q: _Sql(f"({str(p)} // {str(q)})"), lambda p, q: p % q))
    return (f"list_reduce(list_prepend({once(x)}, CAST(range(greatest({a} * {b} - {n}, 1)) AS BIGINT[])), "
            f"lambda v, i: CASE WHEN v < {n} THEN v ELSE {once('v')} END)")


def packed(names: DataFrame, place: Column, name: Column) -> DataFrame:
    """Names by their ``place`` (0 to their number - 1, each once), 2^PACK_BITS a row: the ``prefix``
    that all of a row share, and of each the rest, ended by a dot and filled up with blanks to the
    row's ``width`` in bytes."""
    rows = (names.select(place.alias("_place"), name.alias("_name"))
            .groupBy(F.shiftright("_place", PACK_BITS).alias("pack"))
            .agg(F.sort_array(F.collect_list(F.struct("_place", "_name"))).alias("_names"),
                 F.min("_name").alias("_low"), F.max("_name").alias("_high")))
    shorter = F.least(F.length("_low"), F.length("_high"))
    shared = F.size(F.filter(F.sequence(F.lit(0), shorter), lambda n: (
        F.substring("_low", F.lit(1), n) == F.substring("_high", F.lit(1), n)))) - 1
    rows = rows.withColumn("prefix", F.substring("_low", F.lit(1), shared))
    rows = rows.withColumn("_rests", F.transform("_names", lambda x: F.concat(
        F.substr(x["_name"], F.length("prefix") + 1), F.lit("."))))
    rows = rows.withColumn("width", F.array_max(F.transform("_rests", F.octet_length)))
    filled = F.transform("_rests", lambda x: F.concat(x, F.repeat(F.lit(" "), F.col("width") - F.octet_length(x))))
    return rows.select("pack", F.shiftright("pack", BLOCK_BITS).alias("block"), "prefix", "width",
                       F.array_join(filled, "").cast("binary").alias("names"))


def unpacked(place: Column) -> Column:
    """The name at a place, of the packed row joined to it."""
    at = place.bitwiseAND((1 << PACK_BITS) - 1).cast("int") * F.col("width") + 1
    rest = F.rtrim(F.substring("names", at, F.col("width")).cast("string"))
    return F.concat("prefix", F.substring(rest, F.lit(1), F.length(rest) - 1))


def block_of(place: int) -> int:
    return place >> (PACK_BITS + BLOCK_BITS)


def tiles(rows: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> list[tuple[int, int]]:
    """Runs of blocks (first, last) of packed rows that each fit a broadcast by their bytes, measured
    now; no runs if there would be more than MOST_TILES or one block is too large alone."""
    sizes = (rows.groupBy("block").agg(F.sum(F.octet_length("names") + F.octet_length("prefix") + ROW_BYTES).alias("size"))
             .orderBy("block").collect())  # a row a block
    runs, room = [], 0
    for block, size in sizes:
        if size > room:
            runs.append((block, block))
            room = max_bytes
        runs[-1] = (runs[-1][0], block)
        room -= size
    return runs if len(runs) <= MOST_TILES and all(r.size <= max_bytes for r in sizes) else []
