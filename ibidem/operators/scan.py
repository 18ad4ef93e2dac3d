"""Prefix scans over ordered rows of a key, whose rows may be any share of all.

A window by key puts all rows of a key into one task. Here rows are cut into ranges of (key, order) instead, so that a large
key lies in many ranges; values run on within a range by a window, and what a range hands on to the next is one row of its
last key. Only keys that go over a border have such rows, at most one a range, and these alone are scanned one after another.

The order must tell rows apart where the result depends on it, as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

MOST_ROWS = 1_000_000


def hot(rows: DataFrame, on: list[str], most: int | None = None) -> bool:
    """Whether some key has more rows than one task should take. Both ways give the same rows; this one costs a count."""
    return not rows.groupBy(*on).count().where(F.col("count") > (MOST_ROWS if most is None else most)).isEmpty()


class Ranges:
    """Rows in ranges of (key, order), written once so that every step sees the same ones."""

    def __init__(self, rows: DataFrame, on: list[str], order: list, ranges: int | None = None):
        self.on, self.columns = on, rows.columns
        order = [c if isinstance(c, Column) else F.col(c) for c in order]
        placed = rows.withColumns({f"_o{i}": c for i, c in enumerate(order)})
        self.order = [f"_o{i}" for i in range(len(order))]
        keys = [*on, *self.order]
        dealt = placed.repartitionByRange(ranges, *keys) if ranges else placed.repartitionByRange(*keys)
        self.rows = written(dealt.withColumn("_range", F.spark_partition_id()))
        self.own = Window.partitionBy("_range", *on).orderBy(*self.order)

    def handed_on(self, value: Column) -> DataFrame:
        """_range, key, carry: the aggregate `value` of a key's rows in each range, for the keys that lie in several."""
        held = self.rows.groupBy("_range", *self.on).agg(value.alias("_v"))
        w = Window.partitionBy(*self.on)
        return held.withColumn("_many", F.count("*").over(w)).where("_many > 1").drop("_many")

    def with_carry(self, carry: DataFrame) -> DataFrame:
        """Rows with `_c` of their range and key, null where there's none. A range has it for its first and its last key at most."""
        keys = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(self.on)]
        named = carry.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.on)], "_c")
        condition = F.col("_range") == F.col("_r")
        for k in keys:
            condition = condition & k
        return self.rows.join(F.broadcast(named), condition, "left")

    def running(self, within, across, joined) -> DataFrame:
        """Rows with `_out`: `within` is the column over the range's window; `across` the aggregate that a range hands on, summed up
        over the ranges before by `joined` (of a column and a window)."""
        before = Window.partitionBy(*self.on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carry = self.handed_on(across).withColumn("_c", joined(F.col("_v"), before))
        return self.with_carry(carry).withColumn("_out", within(F.col("_c")))

    def shown(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[c for c in self.columns if c != name], F.col("_out").alias(name))


def filled(rows: DataFrame, on: list[str], order: list, value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """W3: adds the last value that isn't null up to each row of a key."""
    cut = Ranges(rows.withColumn("_value", value), on, order, ranges)
    upto = cut.own.rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*cut.order)))  # of rows with a value
    out = cut.running(lambda c: F.coalesce(F.last("_value", True).over(upto), c), last, lambda v, w: F.last(v, True).over(w))
    return cut.shown(out, name).drop("_value")


def numbered(rows: DataFrame, on: list[str], order: list, name: str, ranges: int | None = None) -> DataFrame:
    """W5: adds a number from 0 in the order of a key."""
    cut = Ranges(rows, on, order, ranges)
    out = cut.running(lambda c: (F.row_number().over(cut.own) - 1 + F.coalesce(c, F.lit(0))).cast("long"), F.count(F.lit(1)), lambda v, w: F.sum(v).over(w))
    return cut.shown(out, name)


def beside(rows: DataFrame, on: list[str], order: list, value: Column, back: int, name: str, ranges: int | None = None) -> DataFrame:
    """W2, JN18: adds the value of the row before (back=1) or after (back=-1) in the order of a key."""
    cut = Ranges(rows.withColumn("_value", F.struct(value.alias("v"))), on, order, ranges)
    edge = (F.max_by if back > 0 else F.min_by)("_value", F.struct(*cut.order))  # the range's row next to the border
    border = Window.partitionBy(*on).orderBy("_range")
    step = F.lag if back > 0 else F.lead
    carry = cut.handed_on(edge).withColumn("_c", step("_v").over(border))
    out = cut.with_carry(carry).withColumn("_out", F.coalesce(step("_value").over(cut.own), F.col("_c"))["v"])
    return cut.shown(out, name).drop("_value")
