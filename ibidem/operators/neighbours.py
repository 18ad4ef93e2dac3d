"""Operators over ordered rows of a group: context, neighbours, forward fill, numbering, samples, budgets, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import beside, filled, hot, numbered


def context(rows: DataFrame, group: str, order: list, text: str = "text", before: int = 1, after: int = 2) -> DataFrame:
    """W1: adds `context`, the row's text with those of its neighbours, in order, by line feeds; empty ones are left out."""
    frame = Window.partitionBy(group).orderBy(*order).rowsBetween(-before, after)
    return rows.withColumn("context", F.array_join(F.filter(F.collect_list(F.col(text)).over(frame), lambda t: t != ""), "\n"))


def wanted_context(rows: DataFrame, wanted: DataFrame, group: str, number: str, text: str = "text", before: int = 1, after: int = 2) -> DataFrame:
    """W1 for few rows: group, number and `context`, `previous`, `next` of the wanted rows (group, number) of densely numbered
    ones. Only these and their neighbours are shuffled, and the rows are read past once; wanted keys are joined as Spark plans."""
    around = F.explode(F.sequence(F.col(number) - before, F.col(number) + after))
    keys = wanted.select(group, number).distinct()
    near = rows.select(group, number, F.col(text).alias("_t"), *[c for c in ("page", "column") if c in rows.columns])
    near = near.join(keys.select(group, around.alias(number)).distinct(), [group, number], "left_semi")
    w = Window.partitionBy(group).orderBy(number)
    at = lambda d: F.max("_t").over(w.rangeBetween(d, d))
    joined = F.array_join(F.filter(F.collect_list("_t").over(w.rangeBetween(-before, after)), lambda t: t != ""), "\n")
    return near.withColumns({"context": joined, "previous": at(-1), "next": at(1)}).drop("_t").join(keys, [group, number], "left_semi")


def nearest(rows: DataFrame, group: str, order: list, value: str = "text") -> DataFrame:
    """W2, JN18: adds `previous` and `next`, the values of the nearest rows in order, whatever the gap."""
    if hot(rows, [group]):
        return beside(beside(rows, [group], order, F.col(value), 1, "previous"), [group], order, F.col(value), -1, "next")
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def exact_neighbours(rows: DataFrame, group: str, number: str, value: str = "text") -> DataFrame:
    """JN19: adds `previous` and `next` of the numbers just before and after; a gap gives null. Without a self-join."""
    w = Window.partitionBy(group).orderBy(number)
    at = lambda f, d: F.when(f(number).over(w) == F.col(number) + d, f(value).over(w))
    return rows.withColumns({"previous": at(F.lag, -1), "next": at(F.lead, 1)})


def forward_fill(rows: DataFrame, group: str, order: list, value: Column, name: str) -> DataFrame:
    """W3: adds a value that stays until the next one that isn't null. Where a key has many rows, by ranges of these."""
    if hot(rows, [group]):
        return filled(rows, [group], order, value, name)
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def header_author(page: Column, patterns: dict[str, str], lines: int = 8) -> Column:
    """W4: the author of the first pattern that occurs in the first lines that aren't empty."""
    head = F.array_join(F.slice(F.filter(F.split(page, "\n"), lambda x: F.trim(x) != ""), 1, lines), "\n")
    return F.coalesce(*[F.when(head.rlike(p), author) for author, p in patterns.items()])


def numbered_on(rows: DataFrame, known: DataFrame, group: str, order: list, number: str = "seq") -> DataFrame:
    """W5: numbers new rows of a group on from the greatest number known, from 0 if none is."""
    top = known.groupBy(group).agg(F.max(number).alias("_top"))
    if hot(rows, [group]):
        own = numbered(rows, [group], order, "_own")
    else:
        own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    return own.join(top, group, "left").withColumn(number, (F.coalesce("_top", F.lit(-1)) + 1 + F.col("_own")).cast("long")).drop("_top", "_own")


def position_sample(rows: DataFrame, group: str, order: list) -> DataFrame:
    """SRC18, W6: the first, middle and last row of each group."""
    w = Window.partitionBy(group)
    placed = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    return placed.where((F.col("_r") == 0) | (F.col("_r") == F.floor(F.col("_n") / 2)) | (F.col("_r") == F.col("_n") - 1)).drop("_r", "_n")


def head_text(rows: DataFrame, group: str, order: str, text: str = "text", k: int = 5, limit: int = 1000) -> DataFrame:
    """SRC19: the texts of the first k rows of a group in one, of at most so many signs."""
    w = Window.partitionBy(group).orderBy(order)
    first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    joined = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", text))).alias("_p"))
    return joined.select(group, F.substring(F.array_join(F.transform("_p", lambda p: p[text]), " "), 1, limit).alias("sample"))


def within_budget(files: DataFrame, size: str, used: str, key: str, budget: int, buckets: int = 64) -> DataFrame:
    """W7: adds `running`, the bytes of this and all more recently used files, and `kept`, whether they're within a budget.

    The order is over all files, so it's cut into ranges of time: sums within a range run in parallel, and the sums of the
    ranges before, a row each, are added.
    """
    edges = files.approxQuantile(used, [i / buckets for i in range(1, buckets)], 0.001) if buckets > 1 else []
    cuts = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    placed = files.withColumn("_b", F.size(F.filter(cuts, lambda c: c < F.col(used).cast("double"))))
    sums = placed.groupBy("_b").agg(F.sum(size).alias("_s"))
    later = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_later"))
    w = Window.partitionBy("_b").orderBy(F.col(used).desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(later), "_b").withColumn("running", F.col("_later") + F.sum(size).over(w))
    return out.withColumn("kept", F.col("running") <= budget).drop("_b", "_later")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], at: str, values: list[str]) -> DataFrame:
    """JN11, JN12: adds values of the right side's last row at or before each left row, within the keys. Right rows at the
    same place go first, and where several share a place their greatest values count."""
    empty = [F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values]
    rest = [c for c in left.columns if c not in (*on, at)]
    marks = right.groupBy(*on, at).agg(F.max(F.struct(*values)).alias("_m")).select(*on, at, F.lit(None).alias("_row"), F.lit(0).alias("_side"), *[F.col(f"_m.{v}").alias(f"_{v}") for v in values], F.lit(True).alias("_is"))
    rows = left.select(*on, at, F.struct(*rest).alias("_row") if rest else F.struct(F.lit(1).alias("_x")).alias("_row"), F.lit(1).alias("_side"), *empty, F.lit(None).cast("boolean").alias("_is"))
    both = rows.unionByName(marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    mark = F.when(F.col("_is"), F.struct(*[f"_{v}" for v in values]))
    if hot(both, on):
        held = filled(both, on, [at, "_side"], mark, "_last")
    else:
        held = both.withColumn("_last", F.last(mark, ignorenulls=True).over(Window.partitionBy(*on).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)))
    return held.where("_side = 1").select(*on, at, *[F.col("_row")[c].alias(c) for c in rest], *[F.col("_last")[f"_{v}"].alias(v) for v in values])
