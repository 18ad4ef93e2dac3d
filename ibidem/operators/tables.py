"""Changes to tables as DataFrame rewrites: upserts, deletes with their dependants, backfills, reconciliation, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import numbered


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SNK2, TK13, ST6, ST7: the row of each key that comes first in an order; upserts append and then keep these."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK7: rows of both by key; a new value that isn't null goes before the old one."""
    rest = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*rest).alias("_o")).join(new.select(*keys, F.struct(*[c for c in rest if c in new.columns]).alias("_n")), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col("_n")[c], F.col("_o")[c]).alias(c) if c in new.columns else F.col("_o")[c].alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """SNK6: (the table with new keys added, the rejected new rows). Null keys never agree, as in a unique index."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True), new.join(old.select(*keys).distinct(), keys, "left_semi")


def delete_cascade(parents: DataFrame, key: str, doomed: Column, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """SNK5, SNK14: parents and children without the rows that go; children are name: (table, column of the parent's key)."""
    gone = parents.where(doomed).select(F.col(key).alias("_k")).distinct()
    left = {name: table.join(gone, table[column] == gone["_k"], "left_anti") for name, (table, column) in children.items()}
    return parents.where(~F.coalesce(doomed, F.lit(False))), left


def backfill(rows: DataFrame, column: str, *sources: Column) -> DataFrame:
    """SNK16: fills a column only where it's null or empty, by the first source that isn't."""
    return rows.withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), *sources))


def corrected(rows: DataFrame, fixes: DataFrame, key: str, column: str) -> DataFrame:
    """SNK17: a table of corrections (key, column) put over the old values."""
    table = fixes.select(key, F.col(column).alias("_fix"))
    return rows.join(table, key, "left").withColumn(column, F.coalesce("_fix", column)).drop("_fix")


def path_outcomes(files: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """SNK15: adds `found`, the listed path of the same base name, and outcome: ok, fixed or missing."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    there = listing.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    known = listing.groupBy(name("path").alias("_name")).agg(F.min("path").alias("found"))
    met = files.join(there, F.col(path) == F.col("_path"), "left").join(known, name(path) == F.col("_name"), "left")
    outcome = F.when(F.col("_there"), "ok").when(F.col("found").isNotNull(), "fixed").otherwise("missing")
    return met.withColumn("outcome", outcome).drop("_name", "_path", "_there")


def reconciled(rows: DataFrame, text_index: DataFrame, vector_index: DataFrame, key: str, semantic: bool = True) -> DataFrame:
    """AG18: per key the rows, text entries and vectors, missing files where known, and a status."""
    count = lambda t, n: t.groupBy(key).agg(F.count("*").alias(n))
    full = count(rows, "n_rows").join(count(text_index, "n_text"), key, "full").join(count(vector_index, "n_vectors"), key, "full")
    full = full.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_text", "n_vectors")])
    n, t, v = F.col("n_rows"), F.col("n_text"), F.col("n_vectors")
    status = F.when(n == 0, "no_chunks").when(t < n, "text_incomplete")
    if semantic:
        status = status.when(v < n, "vectors_incomplete")
    return full.withColumn("status", status.when((t > n) | ((v > n) if semantic else F.lit(False)), "surplus").otherwise("done"))


def rollup_counts(rows: DataFrame, levels: list[str], size: str) -> DataFrame:
    """AG7: count and sum of a size by each level alone and in all, from one aggregation with grouping sets."""
    sets = rows.select(*levels, size).groupingSets([[F.col(x)] for x in levels] + [[]], *[F.col(x) for x in levels])
    return sets.agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.grouping_id().cast("int").alias("level"))


def histogram(rows: DataFrame, label: Column, default: str, by: list[str] | None = None) -> DataFrame:
    """AG6, AG25: counts of labels, null and empty under a default, with their percentage of all (of each `by`)."""
    named = F.coalesce(F.nullif(label, F.lit("")), F.lit(default)).alias("label")
    counts = rows.groupBy(*(by or []), named).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(whole), 4))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """TK10: a page of rows in an order that ends in a unique key, with the total."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """FLT16: the next rows after a key."""
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def multi_label(rows: DataFrame, text: Column, tabs: dict[str, str], rest: str = "others") -> DataFrame:
    """FLT11: a row for each tab whose pattern occurs in a text; those of none go to the rest. Tabs overlap."""
    hits = F.filter(F.array(*[F.when(text.rlike(p), name) for name, p in tabs.items()]), lambda x: x.isNotNull())
    return rows.withColumn("tab", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(rest)))))


def accuracy(rows: DataFrame, expected: Column, status: Column, positive: list[str], uncertain: list[str], context: Column | None = None, seconds: Column | None = None) -> DataFrame:
    """AG20: top-1 and top-3 (with uncertain outcomes) among the genuine, false positives and uncertain ones among the others; the
    share of positive outcomes whose neighbours confirm them, if a context is given, and the mean time, if one is."""
    right, near = status.isin(*positive), status.isin(*positive, *uncertain)
    share = lambda c, of: F.round(F.count_if(c & of) / F.nullif(F.count_if(of), F.lit(0)), 6)
    more = [] if context is None else [share(context, right).alias("context_rate")]
    more += [] if seconds is None else [F.round(F.avg(seconds), 6).alias("mean_seconds")]
    return rows.agg(F.count("*").alias("n"), share(right, expected).alias("top1"), share(near, expected).alias("top3"), share(right, ~expected).alias("false_positive"), share(status.isin(*uncertain), ~expected).alias("uncertain"), *more)


def languages_rollup(files: DataFrame, key: str, language: str = "language") -> DataFrame:
    """AG19: the one language of a book's files, 'multi' for several, null for none."""
    codes = files.groupBy(key).agg(F.sort_array(F.collect_set(language)).alias("languages"))
    return codes.withColumn("language", F.when(F.size("languages") > 1, "multi").otherwise(F.get("languages", F.lit(0))))


def prefix_without(text: Column, prefix: str, infix: str) -> Column:
    """FLT6: begins with one string and doesn't hold another, whatever its case."""
    return text.startswith(prefix) & ~F.lower(text).contains(infix.lower())


def not_suffixed(path: Column, suffixes: list[str]) -> Column:
    """FLT8: ends with none of some suffixes."""
    return ~F.exists(F.array(*[F.lit(x) for x in suffixes]), lambda s: F.endswith(path, s))


def blocked(text: Column, terms: list[str]) -> Column:
    """FLT10: holds any of some terms, whatever their case."""
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(text), t))


def selected(files: DataFrame, path: str, size: str, include: str | None = None, exclude: str | None = None, most: int | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """FLT9: files by patterns and size, from the one after a path on, in order of paths; limit only where one is given."""
    if include:
        files = files.where(F.col(path).rlike(include))
    if exclude:
        files = files.where(~F.col(path).rlike(exclude))
    if most is not None:
        files = files.where(F.col(size) <= most)
    if after is not None:
        files = files.where(F.col(path) > after)
    return files.orderBy(path).limit(limit) if limit is not None else files


def unfinished(rows: DataFrame, status: str, done: str = "done", only: str | None = None, name: str | None = None, search: str | None = None) -> DataFrame:
    """FLT15: rows whose status isn't done, or is the one asked for, and whose name holds a search. A null status is never so."""
    rows = rows.where(F.col(status) == only) if only else rows.where(F.col(status) != done)
    return rows.where(F.lower(name).contains(search.lower())) if name and search else rows


def remote(path: Column, schemes=("s3://", "r2://", "gdrive://")) -> Column:
    """FLT17: a path of a remote store."""
    return F.exists(F.array(*[F.lit(x) for x in schemes]), lambda s: F.startswith(path, s))


def missing_ids(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """JN10: the keys of rows that an index doesn't hold."""
    return rows.select(key).distinct().join(index.select(key), key, "left_anti")


def tagged(chunks: DataFrame, pages: DataFrame, on: list[str], column: str) -> DataFrame:
    """JN16: gives chunks the value of their page where it has one, and tells by `changed` where that is another than theirs."""
    own = pages.groupBy(*on).agg(F.max(column).alias("_new"))
    met = chunks.join(own, on, "left").withColumn("changed", F.col("_new").isNotNull() & ~F.col(column).eqNullSafe(F.col("_new")))
    return met.withColumn(column, F.coalesce("_new", column)).drop("_new")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """JN24: the rows whose composite key is among some keys."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def translation_audit(chunks: DataFrame, translations: DataFrame, indexed: DataFrame, key: str, language: str) -> DataFrame:
    """AG17: per book its chunks, translations into a language, entries of the index, and what lacks."""
    count = lambda t, n: t.groupBy(key).agg(F.count("*").alias(n))
    full = count(chunks, "n_chunks").join(count(translations.where(F.col("language") == language), "n_translated"), key, "left").join(count(indexed, "n_indexed"), key, "left")
    full = full.select(key, "n_chunks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_translated", "n_indexed")])
    return full.withColumn("lacking", F.greatest(F.col("n_chunks") - F.col("n_translated"), F.lit(0)))


def best_by(rows: DataFrame, key: list[str], value: str, score: str) -> DataFrame:
    """AG22, AG23: per key the value of the highest score; the least value on a tie."""
    return rows.groupBy(*key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(value)).alias("v"))).alias("_b")).select(*key, (-F.col("_b.v")).alias(value), F.col("_b.s").alias(score))


def numbered_groups(rows: DataFrame, key: Column, order: str, name: str = "title") -> DataFrame:
    """AG24, AG27: groups by a key, numbered in the order of their first row, with their counts; members stay rows, joined by the
    key, so that no group is gathered in one task."""
    groups = rows.groupBy(key.alias(name)).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return numbered(groups, [], ["first", name], "place").withColumn("place", (F.col("place") + 1).cast("int"))


def active(rows: DataFrame, revoked: str) -> DataFrame:
    """AG28: how many keys are there, and how many of them aren't revoked."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(revoked).isNull()).alias("active"))


def in_volumes(files: DataFrame, volume: str, key: str) -> DataFrame:
    """TK6: files by volume, those without one last, then by key."""
    return files.orderBy(F.asc_nulls_last(volume), key)


def preview(rows: DataFrame, order: list, most: int = 80) -> DataFrame:
    """TK11: the first rows of an order."""
    return rows.orderBy(*order).limit(most)


def ids_in_any(key: str, *tables: DataFrame) -> DataFrame:
    """ST4: the distinct keys of several tables."""
    out = tables[0].select(key)
    for other in tables[1:]:
        out = out.unionByName(other.select(key))
    return out.distinct()


def choices(rows: DataFrame, columns: list[str]) -> DataFrame:
    """ST5: the distinct values of each column, for menus: column, value. One pass; nulls and empty strings are no choice."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").distinct()
