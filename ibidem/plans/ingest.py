"""Ingest of books in one call: pages to chunks, the text index's documents, and vectors under composite ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibidem.operators.chunk import paged_chunks
from ibidem.operators.neighbours import numbered_on
from ibidem.operators.versions import Versions

from .catalog import search_documents


def book_chunks(books: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Chunks of books (doc_id, pages: array of struct(page_number, text)) with page, column and place, numbered on from the
    chunks that are known of a book."""
    made = paged_chunks(books, "doc_id", "pages")
    if known is None:
        return made
    return numbered_on(made.withColumnRenamed("chunk", "_part"), known.select("doc_id", "chunk"), "doc_id", ["_part"], "chunk").drop("_part")


def vector_rows(chunks: DataFrame, vectors: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """SNK3, SNK4: rows of the vector store (id, doc_id, chunk, language, vector): each chunk's own under its id, and those of
    translations (doc_id, chunk, language, vector) under '<id>_translation_<language>'."""
    name = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk").cast("string"))
    own = chunks.join(vectors, ["doc_id", "chunk"]).select(name.alias("id"), "doc_id", "chunk", F.lit(None).cast("string").alias("language"), "vector")
    if translations is None:
        return own
    other = translations.join(chunks.select("doc_id", "chunk"), ["doc_id", "chunk"], "left_semi")
    return own.unionByName(other.select(F.concat_ws("_", name, F.lit("translation"), "language").alias("id"), "doc_id", "chunk", "language", "vector"))


def ingest(books: DataFrame, target: str, batch: str, translations: DataFrame | None = None, vectors: DataFrame | None = None, translation_vectors: DataFrame | None = None) -> dict[str, int]:
    """SNK1, SNK3, SNK4, PRJ1: writes books (doc_id, title, canonical_title, author, pages) to the tables `books`, `chunks`,
    `index` and `vectors` under a folder, each as the partition of this batch, which is written whole or replaced whole: a
    batch that failed or is repeated leaves no rows twice. Returns how many rows each table got.
    """
    spark = books.sparkSession

    def write(df: DataFrame, name: str) -> DataFrame:
        path = f"{target.rstrip('/')}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    chunks = write(book_chunks(books.select("doc_id", "pages")), "chunks")
    made = {"chunks": chunks, "index": write(search_documents(chunks, books, translations), "index")}
    if vectors is not None:
        made["vectors"] = write(vector_rows(chunks, vectors, translation_vectors), "vectors")
    made["books"] = write(books.drop("pages"), "books")  # last: a book is listed once its chunks are there
    return {name: df.count() for name, df in made.items()}


TABLES = ("books", "chunks", "index", "vectors")


def ingest_whole(versions: Versions, books: DataFrame, batch: str, translations: DataFrame | None = None, vectors: DataFrame | None = None, translation_vectors: DataFrame | None = None) -> dict[str, int]:
    """SNK1 in one transaction: the tables of ingest() for a batch of books, each written apart and counted against what was to be
    written, and then shown together by one new version. A writer that fails leaves the version before; a batch that is
    repeated takes the place of what it held. Returns how many rows each table got."""
    number, rows = versions.current()
    made, counts = [], {}

    def write(df: DataFrame, name: str) -> DataFrame:
        path, counts[name] = versions.write(df, name)
        made.append((name, 0, path, number + 1, batch))
        return versions.read([path], df.schema)

    chunks = write(book_chunks(books.select("doc_id", "pages")), "chunks")
    write(search_documents(chunks, books, translations), "index")
    if vectors is not None:
        write(vector_rows(chunks, vectors, translation_vectors), "vectors")
    write(books.drop("pages"), "books")
    versions.publish(number, [tuple(r) for r in rows if r.facts != batch or r.kind not in TABLES] + made)
    return counts


def library(versions: Versions, name: str) -> DataFrame | None:
    """All rows of a table in the current version."""
    paths = [r.path for r in versions.current()[1] if r.kind == name]
    return reduce(DataFrame.unionByName, [versions.read([p]) for p in paths]) if paths else None


def rebuild(versions: Versions, name: str, rows: DataFrame, wanted: int | None = None) -> int:
    """SNK12: a table made anew beside the old one, and swapped in once its count is as wanted (that of the old one, if no
    number is given); else an error, and the old one stays. The count."""
    number, held = versions.current()
    old = library(versions, name)
    wanted = wanted if wanted is not None or old is None else old.count()
    path, n = versions.write(rows, name)
    if wanted is not None and n != wanted:
        raise ValueError(f"{name} has {n} rows made anew, not {wanted}")
    versions.publish(number, [tuple(r) for r in held if r.kind != name] + [(name, 0, path, number + 1, "rebuilt")])
    return n
