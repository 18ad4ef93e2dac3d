"""Tables, manifests, inventories and folders; writers of logs and nested reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC1: a Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table so small that its scan has fewer tasks than there are cores, dealt out; a larger one as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC12: a JSON-lines file; lines that aren't JSON, and blank ones, are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def inventory(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """SRC11: a JSON array of Path, Name, Size, reduced to files of a kind."""
    rows = spark.read.schema("Path string, Name string, Size long").option("multiLine", True).json(path)
    return rows.where(F.lower("Path").endswith(suffix)).select(F.col("Path").alias("path"), F.col("Name").alias("name"), F.col("Size").alias("size"))


def folder(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """SRC13, SRC23: path, length and time of the files of a folder; their contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return rows.select("path", "length", "modificationTime")


def with_fallback(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """SRC14: rows, or those of a fallback where there are none."""
    return fallback if rows.isEmpty() else rows


def is_digital(pages: Column, first: int = 8, least: int = 50) -> Column:
    """SRC3: one of the first pages has more signs than that."""
    return F.exists(F.slice(pages, 1, first), lambda p: F.length(F.trim(p)) > least)


def form_pages(text: Column, count: Column | None = None) -> Column:
    """SRC4: pages between form feeds, filled up with empty ones to a count."""
    pages = F.split(text, "\f")
    if count is None:
        return pages
    return F.concat(pages, F.array_repeat(F.lit(""), F.greatest(count - F.size(pages), F.lit(0))))


def best_attempt(attempts: DataFrame, key: list[str], order: str = "attempt", text: str = "text", enough: int = 80) -> DataFrame:
    """SRC6: of several readings of a page the first of at least so many signs, else the longest."""
    size = F.length(F.trim(text))
    rank = F.struct((size >= enough).alias("e"), F.when(size >= enough, -F.col(order)).otherwise(size).alias("v"), (-F.col(order)).alias("o"), F.col(text).alias("text"))
    return attempts.groupBy(*key).agg(F.max(rank).alias("_b")).select(*key, F.col("_b.text").alias(text))


def unread(wanted: DataFrame, cache: DataFrame, key: str = "sha1") -> DataFrame:
    """SRC5: what a content-addressed cache doesn't hold yet."""
    return wanted.join(cache.select(key), key, "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """SNK8: rows appended as JSON lines."""
    rows.write.mode("append").json(path)


def report(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """SNK9: one JSON document with counts and sums by each of some columns."""
    parts = []
    for column in by:
        sums = rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        parts.append(sums.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "name", "n", "bytes"))).alias(column)))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.select(F.to_json(F.struct(*[F.transform(c, lambda x: x.dropFields("order")).alias(c) for c in by])).alias("report"))


def replace_checked(rows: DataFrame, path: str) -> int:
    """SNK12: writes beside the old files, compares counts, and reads what is new under its own name; the count."""
    rows.write.mode("errorifexists").parquet(path)
    n = rows.sparkSession.read.parquet(path).count()
    if n != rows.count():
        raise ValueError(f"{path} holds {n} rows, not as many as were written")
    return n
