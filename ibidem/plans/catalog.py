"""Catalog analytics: authors, publishers, centuries, councils, searches of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ibidem.functions.metadata import century, publisher_label_ok
from ibidem.functions.text import fold, slug
from ibidem.operators.lexicon_match import matches

#: Rows of pairs of a book and an author that a task groups, so its memory doesn't grow with their number.
PAIRS = 1_000_000


def author_catalog(authors: DataFrame, books: DataFrame, chunk_authors: DataFrame) -> DataFrame:
    """AG8: per known author (author), books of their own (book_id, author), books with chunks of theirs (book_id, author, n)
    that aren't their own, and all their chunks; authors without any stay, with zeros, last."""
    own = books.groupBy("author").agg(F.count("*").alias("direct"))
    pair = ["book_id", "author"]
    parts = max(1, -(-chunk_authors.count() // PAIRS))
    within = chunk_authors.select(*pair, "n").repartition(parts, *pair).groupBy(*pair).agg(F.sum("n").alias("n"))
    shared = books.select(*pair).distinct().repartition(parts, *pair).withColumn("_own", F.lit(True))
    told = within.join(shared, pair, "left").groupBy("author").agg(F.sum("n").alias("chunks"), F.count(F.when(F.col("_own").isNull(), 1)).alias("collected"))
    out = authors.select("author").distinct().join(own, "author", "left").join(told, "author", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("direct", "collected", "chunks")]
    return out.select("author", *zero).orderBy((F.col("chunks") == 0), F.col("chunks").desc(), "author")


def publisher_tabs(books: DataFrame, label: Column, order: str, pinned: list[str] = ()) -> DataFrame:
    """AG12: tabs by the slug of a label, the first label shown, pinned ones first, then by count."""
    tabs = books.where(publisher_label_ok(label)).groupBy(slug(label).alias("key")).agg(F.min_by(label, order).alias("label"), F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(p) for p in pinned]).cast("array<string>"), F.col("key"))
    return tabs.withColumn("pinned", place > 0).orderBy(F.when(place > 0, place).otherwise(10_000), F.col("n").desc(), "key")


def by_century(rows: DataFrame, year: Column) -> DataFrame:
    """AG14: counts by century, unknown last."""
    return rows.groupBy(century(year).alias("century")).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("century"))


def councils(rows: DataFrame, group: str, year: Column) -> DataFrame:
    """AG9: the first year that isn't 0 of each council, its documents, ordered with unknown years last."""
    return rows.groupBy(group).agg(F.min(F.nullif(year, F.lit(0))).alias("year"), F.count("*").alias("n")).orderBy(F.coalesce("year", F.lit(9999)), group)


def popes(rows: DataFrame, group: str, kind: str, year: Column, last: str) -> DataFrame:
    """AG10: per pope the last year, the documents and their counts by kind; a special label comes last."""
    kinds = rows.groupBy(group, kind).agg(F.count("*").alias("n"), F.max(year).alias("y"))
    whole = kinds.groupBy(group).agg(F.max("y").alias("year"), F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))
    return whole.orderBy(F.col(group) == last, F.col("year").desc_nulls_last(), group)


def author_works(rows: DataFrame, author: str, work: str) -> DataFrame:
    """AG11: books by author and work with subtotals, from one rollup."""
    return rows.rollup(author, work).agg(F.count("*").alias("books"), F.grouping_id().cast("int").alias("level"))


def publisher_works(rows: DataFrame, publisher: str, work: str, chunks: str) -> DataFrame:
    """AG13: per publisher and work the books and chunks, with the publisher's own sums."""
    works = rows.groupBy(publisher, work).agg(F.count("*").alias("books"), F.sum(chunks).alias("chunks"))
    w = Window.partitionBy(publisher)
    return works.withColumns({"all_books": F.sum("books").over(w), "all_chunks": F.sum("chunks").over(w)})


def labels_in_order(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """AG15: the distinct labels of a group in the order of their first appearance."""
    first = rows.groupBy(group, label).agg(F.min(order).alias("o"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", label))), lambda x: x[label]).alias("labels"))


def coverage(rows: DataFrame, domain: list[str], value: str) -> DataFrame:
    """AG16: counts over a fixed, ordered domain; absent values count 0."""
    known = rows.sparkSession.createDataFrame(list(enumerate(domain)), "position int, value string")
    counts = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return F.broadcast(known).join(counts, "value", "left").select("position", "value", F.coalesce("n", F.lit(0)).alias("n"))


def library(books: DataFrame, search: str, columns: list[str], primary: bool | None = None) -> DataFrame:
    """FLT2, FLT3: books of which the given columns, joined and folded, contain the folded search."""
    text = fold(F.concat_ws(" ", *columns))
    found = books.where(text.contains(fold(F.lit(search))))
    return found if primary is None else found.where(F.col("is_primary") == primary)


def collated(rows: DataFrame, column: str, locale: str = "pt_CI_AI") -> DataFrame:
    """TK8: rows in a locale's order."""
    return rows.orderBy(F.collate(F.col(column), locale), F.col(column))


def sections(books: DataFrame, order: list[str], column: str, unknown: int = 99) -> DataFrame:
    """TK12: rows in the order of an enumeration, unknown values last."""
    place = F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0))
    return books.withColumn("place", F.coalesce(place, F.lit(unknown)).cast("int"))


def alias_books(saints: DataFrame, books: DataFrame, text: str = "text") -> DataFrame:
    """JN13: saint, book_id of every book whose folded text contains one of a saint's aliases (saint, alias). All aliases are sought
    in one pass over a text."""
    aliases = saints.select("saint", fold(F.col("alias")).alias("_a")).where(F.length("_a") > 0).distinct()
    forms = [(r["_a"], False, r["_a"]) for r in aliases.select("_a").distinct().collect()]  # a lexicon, not a corpus
    found = matches(books.select("book_id", fold(F.col(text)).alias("_t")), "_t", forms, "_a")
    return found.join(F.broadcast(aliases), "_a").select("saint", "book_id").distinct()


def editions(files: DataFrame, key: str) -> DataFrame:
    """JN25: per book its files by volume (unknown ones, as 9999, last), distinct editions, and flags of risk."""
    place = F.struct(F.col("volume").isNull().alias("unknown"), F.coalesce("volume", F.lit(9999)).alias("volume"), "file")
    out = files.groupBy(key).agg(F.array_sort(F.collect_list(place)).alias("files"), F.sort_array(F.collect_set("edition")).alias("editions"))
    flags = F.filter(F.array(F.when(F.size("editions") > 1, "several editions"), F.when(F.size("editions") == 0, "no edition"), F.when(F.exists("files", lambda f: f["unknown"]), "volume unknown")), lambda x: x.isNotNull())
    return out.withColumn("risks", flags).withColumn("files", F.transform("files", lambda f: f.dropFields("unknown")))


def expected_rows(spark, expected: list[tuple], schema: str, actual: DataFrame, key: str, missing: str = "not_imported") -> DataFrame:
    """JN22, JN23: every expected row with what there is of it, or a status for what's missing."""
    known = F.broadcast(spark.createDataFrame(expected, schema))
    return known.join(actual, key, "left").withColumn("status", F.coalesce("status", F.lit(missing)))


def saint_work(section: Column, kind: Column, author: Column, kinds=("concilio", "catecismo", "direito_canonico")) -> Column:
    """FLT14: a work by a saint that is neither patristic nor an official document."""
    named = author.rlike(r"(?i)^\s*(são|santo|santa|beato|beata|saint|st\.)\s")
    return F.coalesce((section != "patristica") & ~F.coalesce(kind, F.lit("")).isin(*kinds) & named, F.lit(False))


def search_groups(rows: DataFrame, group: str, columns: list[str], search: str) -> DataFrame:
    """FLT18: groups with the number of their rows that hold a search in some columns, folded; groups without any are left out."""
    return library(rows, search, columns).groupBy(group).agg(F.count("*").alias("n"))


def search_documents(chunks: DataFrame, books: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """PRJ1, PRJ3: what a text index holds for each chunk (doc_id, chunk, text, and author if it has one of its own): with the
    book's title (canonical, else raw) and author (the chunk's, else the book's), and the translation into Portuguese."""
    own = F.col("_own") if "author" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.withColumnRenamed("author", "_own").join(books.select("doc_id", "title", "canonical_title", "author"), "doc_id", "left")
    if translations is not None:
        first = translations.where("language = 'pt'").groupBy("doc_id", "chunk").agg(F.min("text").alias("translation"))
        rows = rows.join(first, ["doc_id", "chunk"], "left")
    else:
        rows = rows.withColumn("translation", F.lit(None).cast("string"))
    name = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk").cast("string"))
    return rows.select(name.alias("id"), "doc_id", "chunk", F.coalesce("canonical_title", "title").alias("title"), F.coalesce(own, F.col("author")).alias("author"), "text", "translation")
