"""Append stores that know which folder may hold a key.

Every append writes a folder of its own.  Beside the folders stands one small table, a few rows of bits for
each: a bitmap of the hashes of its keys.  A reader that asks for keys looks there first, and opens only
the folders whose bitmap has one of them.  A bitmap may name a folder without the key, never the reverse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a folder's bitmap.
BITS = 1 << 22
INDEX = "_keys"


def _spot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def append_keyed(rows: DataFrame, root: str, keys: list[str]) -> str:
    """Add rows as a folder ``part=<id>`` with its bitmap; returns the id.

    The bitmap is written first: an append that breaks off leaves a bitmap of no folder, which is ignored.
    """
    part = f"p{uuid.uuid4().hex}"  # a name that is never read as a number
    bits = rows.select(_spot(keys).alias("s")).distinct().groupBy((F.col("s") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("bits"))
    bits.write.parquet(f"{root}/{INDEX}/{part}")
    rows.write.parquet(f"{root}/part={part}")
    return part


def touched_parts(spark: SparkSession, root: str, asked: DataFrame, keys: list[str]) -> list[str]:
    """Ids of the folders that may hold one of the asked keys; as many as there were appends at most."""
    index = spark.read.parquet(f"{root}/{INDEX}/*").withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), f"/{INDEX}/(p[0-9a-f]+)/", 1))
    spots = asked.select(_spot(keys).alias("s")).distinct().select((F.col("s") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(s % 64 AS int))").alias("bit"))
    met = index.join(spots, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return sorted(r["part"] for r in met.select("part").distinct().collect())


def read_keyed(spark: SparkSession, root: str, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows of the folders that may hold one of the asked keys; other folders are not opened."""
    parts = touched_parts(spark, root, asked, keys)
    return spark.read.parquet(*[f"{root}/part={p}" for p in parts]) if parts else spark.read.parquet(root).drop("part").limit(0)
