"""ST4, AG18, JN10: sets of ids as bitmaps, to compare stores that mostly agree.

A store's ids become one bitmap for each 32 768 consecutive numbers, built within each task before they're shuffled, so what
moves is an eighth of a byte for each possible id in place of the ids. Counts of unions, intersections and differences follow
from the bitmaps; ids themselves are read again in those ranges alone where two stores differ.

Null ids are in no set; ids that repeat count once. Ids are whole numbers; ranges that have no id have no bitmap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small

MOST_RANGES = 1_000_000


def bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """range, bits: the ids of rows."""
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"))
    return own.groupBy(F.bitmap_bucket_number("_id").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))


def union(*sets: DataFrame) -> DataFrame:
    """ST4: the bitmaps of all ids that some set has."""
    both = sets[0]
    for other in sets[1:]:
        both = both.unionByName(other)
    return both.groupBy("range").agg(F.bitmap_or_agg("bits").alias("bits"))


def size(found: DataFrame) -> DataFrame:
    """One row: how many ids there are."""
    return found.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """range, n_left, n_right, n_both of two sets, for each range that one of them has."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    count = lambda side: F.coalesce(F.sum(F.when(F.col("_side") == side, F.bitmap_count("bits"))), F.lit(0)).cast("long")
    counts = both.groupBy("range").agg(count(0).alias("n_left"), count(1).alias("n_right"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("_n"))
    return counts.select("range", "n_left", "n_right", (F.col("n_left") + F.col("n_right") - F.col("_n")).alias("n_both"))


def missing(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """JN10: the distinct ids of left (key) that right (other) lacks. Only ids of ranges that differ are shuffled."""
    differ = compared(bitmaps(left, key), bitmaps(right, other)).where("n_left > n_both").select("range")
    differ = F.broadcast(differ) if small(differ, MOST_RANGES) else differ
    of = lambda rows, name: rows.select(F.col(name).cast("long").alias(key)).withColumn("range", F.bitmap_bucket_number(key)).join(differ, "range", "left_semi").select(key).distinct()
    return of(left, key).join(of(right, other), key, "left_anti")


def coverage(rows: DataFrame, stores: dict[str, DataFrame], key: str) -> DataFrame:
    """AG18 by sets: one row with the number of ids, and for each store how many it has of them and how many it has besides."""
    own = bitmaps(rows, key)
    out = size(own).withColumnRenamed("n", "n_ids")
    for name, store in stores.items():
        sums = compared(own, bitmaps(store, key)).agg(F.coalesce(F.sum("n_both"), F.lit(0)).alias(f"{name}_has"), F.coalesce(F.sum(F.col("n_right") - F.col("n_both")), F.lit(0)).alias(f"{name}_besides"))
        out = out.crossJoin(F.broadcast(sums))  # one row each
    return out
