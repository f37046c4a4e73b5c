"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
# The code points of [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    from ..session import checkpoint_root  # needed on the driver only
    return f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage at
    files that outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def hash128(c: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes, used together as one key."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x9E3779B9), c)


def in_row(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``_row``, so that none of its names meets another."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def from_row(name: str) -> Column:
    return F.col(f"_row.`{name}`")


def out_of_row(columns: list[str], new: dict[str, Column]) -> list[Column]:
    """The packed columns but those that new ones replace, and the new ones."""
    taken = {c.lower() for c in new}
    return [*[from_row(c).alias(c) for c in columns if c.lower() not in taken], *[v.alias(c) for c, v in new.items()]]


SALTS = 8


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``one`` row a key, where a key may hold a
    large part of ``many``: its rows are dealt to ``SALTS`` tasks by ``spread``.
    Both sides are dealt for the join alone, so AQE can split a task further."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).alias("_salt")
    dealt = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1))).alias("_salt"))
    return many.select("*", salt).join(dealt, [*keys, "_salt"]).drop("_salt")


def schema_with(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per context, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlake_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(sc._temp_dir, "ledgerlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._ledgerlake_shipped = True


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def group_arrow(df: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    """``applyInArrow`` per group with this package on the workers."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(fn, schema)


def cogroup_arrow(left: DataFrame, right: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    """``applyInArrow`` per pair of groups with this package on the workers."""
    ship(left.sparkSession)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)
