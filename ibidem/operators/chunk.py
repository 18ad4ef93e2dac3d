"""Chunking of pages into overlapping windows of words, with page and column markers as of each chunk's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, STEP = 500, 400
#: Fixed value: the format of a column marker, [503] or col. 503.
MARKER = r"(?i)\[(\d{3,4})\]|col\.\s*(\d{3,4})"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def windows(tokens: Column, size: int = SIZE, step: int = STEP) -> Column:
    """W8: windows of words, one beginning at every step; an array of struct(chunk, text)."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct((s / step).cast("int").alias("chunk"), F.array_join(F.slice(tokens, s + 1, size), " ").alias("text")))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, step: int = STEP) -> DataFrame:
    """key, chunk, text of every window of every document; other columns aren't kept."""
    cut = docs.select(key, words(F.col(text)).alias("_w"))
    return cut.select(key, F.explode(windows(F.col("_w"), size, step)).alias("_c")).select(key, "_c.chunk", "_c.text")


def word_steps(text: Column) -> Column:
    """struct(gap, word) of the lengths of each word of a text and of the gap before it, in signs."""
    gaps = F.split(text, r"(?U)\S+")
    tokens = words(text)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(tokens)).alias("gap"), tokens.alias("word"))
    return F.transform(pairs, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["word"]).alias("word")))


def word_start(steps: Column, number: Column) -> Column:
    """Where a word begins, in signs from 0: what lies before it, added up. Meant for one word in some hundred."""
    before = F.aggregate(F.slice(steps, F.lit(1), number), F.lit(0), lambda a, x: a + x["gap"] + x["word"])
    return before + F.get(steps, number)["gap"]


def markers(text: Column) -> Column:
    """SC63: struct(at, column) of every column marker, in order."""
    parts = F.split(text, MARKER)
    found = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,column:int>>").alias("out"))
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("gap"), found.alias("mark"))
    return F.aggregate(pairs, start, lambda a, x: F.struct((a["at"] + F.length(x["gap"]) + F.length(x["mark"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("at"), F.regexp_extract(x["mark"], r"(\d{3,4})", 1).cast("int").alias("column")))).alias("out")))["out"]


def as_of(marks: Column, at: Column, field: str, default: int) -> Column:
    """JN11, JN12: a field of the last mark at or before a place, else the default."""
    before = F.filter(marks, lambda m: m["at"] <= at)
    return F.coalesce(F.get(before, F.size(before) - 1)[field], F.lit(default))


def paged_chunks(books: DataFrame, key: str = "book_id", pages: str = "pages", size: int = SIZE, step: int = STEP) -> DataFrame:
    """Chunks of books given as an array of struct(page_number, text): key, chunk, text, page, begin, end, column."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,page:int>>").alias("out"))
    offsets = F.aggregate(pages, start, lambda a, p: F.struct((a["at"] + F.length(p["text"]) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p["page_number"].cast("int").alias("page")))).alias("out")))["out"]
    whole = F.concat(F.array_join(F.transform(pages, lambda p: p["text"]), "\n"), F.lit("\n"))
    wide = books.select(key, whole.alias("_t"), offsets.alias("_p")).select(key, "_p", words(F.col("_t")).alias("_w"), word_steps(F.col("_t")).alias("_s"), markers(F.col("_t")).alias("_m"))
    cut = wide.select("*", F.explode(windows(F.col("_w"), size, step)).alias("_c"))
    first = F.col("_c.chunk") * step
    last = F.least(first + size, F.size("_w")) - 1
    begin = word_start(F.col("_s"), first)
    return cut.select(key, "_c.chunk", "_c.text", as_of(F.col("_p"), begin, "page", 1).alias("page"), begin.alias("begin"), (word_start(F.col("_s"), last) + F.length(F.get("_w", last))).alias("end"), as_of(F.col("_m"), begin, "column", 0).alias("column"))


def character_windows(text: Column, length: Column) -> Column:
    """W9: windows of a length, stepping a quarter of it. A text is cut into steps once, in one pass, and a window is put together of
    the few that it spans, so the work is in proportion to the text."""
    step = F.greatest(F.lit(1), F.floor(length / 4).cast("int"))
    pieces = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - length, F.lit(0)), step)
    window = lambda p, s: F.substring(F.array_join(F.slice(p, (s / step).cast("int") + 1, F.ceil(length / step).cast("int")), ""), F.lit(1), length)
    return F.get(F.transform(F.array(pieces), lambda p: F.transform(starts, lambda s: window(p, s))), F.lit(0))  # pieces are made once
