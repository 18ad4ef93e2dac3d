"""Retrieval: postings and BM25, vector similarity, exact containment, fusion of ranked lists, top k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ibidem.functions.evidence import tokens

from .best import dense_top, sparse_top
from .lexicon_match import matches
from .shared import ship, small, written

K1, B = 1.2, 0.75
#: Rows of a side that is broadcast: terms of queries, hashes of quotations, queries of a block.
MOST_TERMS, MOST_HASHES, BLOCK = 1_000_000, 2_000, 500
#: Signs of all quotations that one automaton holds; its size is some hundred bytes a sign at most.
QUOTED = 1_000_000


def top_k(rows: DataFrame, group: list[str] | str, order: list, k: int, rank: str = "rank") -> DataFrame:
    """TK1-TK3: the first k rows of each group, with their rank. Spark limits groups before the shuffle."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def postings(docs: DataFrame, key: list[str], text: Column, least: int = 1) -> DataFrame:
    """RT1: key, term, tf of every term of every document."""
    return docs.select(*key, F.explode(tokens(text, least)).alias("term")).groupBy(*key, "term").agg(F.count("*").cast("int").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, key: list[str], query: Column, text: Column, least: int = 1) -> DataFrame:
    """RT1: query_key, key, score of every document that shares a term with a query; any term counts.

    One pass cuts the documents into terms. What leaves it are the documents' lengths and the postings of terms that a query
    has, combined by document and written once, since statistics, frequencies and scores all come from them. The queries'
    terms are broadcast while they're at most MOST_TERMS, and else joined by shuffle.
    """
    wanted = queries.select(query_key, F.explode(tokens(query, least)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    terms = wanted.select("term").distinct().withColumn("is_wanted", F.lit(True))
    cut = docs.select(*key, tokens(text, least).alias("_t")).select(*key, F.size("_t").alias("dl"), F.concat(F.array(F.lit("")), "_t").alias("_t"))
    spread = cut.select(*key, "dl", F.explode("_t").alias("term"))  # "" stands for the document
    beside = F.broadcast if small(wanted, MOST_TERMS) else lambda frame: frame
    met = spread.join(beside(terms), "term", "left").where("is_wanted or term = ''")
    held = written(met.groupBy(*key, "term").agg(F.max("dl").alias("dl"), F.count("*").alias("tf")))
    stats = held.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    found = held.where("term <> ''")
    frequency = found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    weights = frequency.select("term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return found.join(beside(wanted.join(weights, "term")), "term").groupBy(query_key, *key).agg(F.sum(part).alias("score"))


def bm25_top(queries: DataFrame, docs: DataFrame, query_key: str, key: list[str], query: Column, text: Column, k: int, least: int = 1) -> DataFrame:
    """TK1: query_key, key, score (rounded to 6 places), rank of the k best documents of each query; ties go by key.

    While the queries' terms are at most MOST_TERMS, a document's terms are counted where it is read, and its scores are formed in
    the task too, of which only the best leave; so neither postings nor scores are shuffled. Keys are taken to be unique."""
    wanted = written(queries.select(query_key, F.explode(tokens(query, least)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf")))
    if not small(wanted, MOST_TERMS):
        scored = bm25(queries, docs, query_key, key, query, text, least).withColumn("score", F.round("score", 6))
        return top_k(scored, query_key, [F.col("score").desc(), *key], k)
    terms = wanted.select("term").distinct().orderBy("term").toArrow()["term"]  # MOST_TERMS rows at most
    held = written(counted(docs.select(*key, tokens(text, least).alias("_t")), key, terms))
    facts = held.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    df = held.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df"))
    numbers = queries.sparkSession.createDataFrame(terms_table(terms))
    weights = df.select("at", F.log(1 + (F.lit(facts["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = wanted.join(numbers, "term").join(weights, "at").select(query_key, "at", (F.col("qtf") * F.col("idf")).alias("weight"))
    return sparse_top(weighed(held, facts["mean"] or 0.0), written(asked), query_key, key, k)


def terms_table(terms):
    """(term, at): numbers of terms, an Arrow table."""
    import pyarrow as pa

    return pa.table({"term": terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms, "at": pa.array(range(len(terms)), pa.int32())})


def weighed(held: DataFrame, mean: float) -> DataFrame:
    """Documents (key, dl, at, tf) with BM25's part of each term, `value`, but for its weight."""
    part = lambda tf: tf * F.lit(K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return held.withColumn("value", F.transform("tf", lambda tf: part(tf.cast("double")))).drop("tf", "dl")


def counted(cut: DataFrame, key: list[str], terms) -> DataFrame:
    """key, dl, at, tf: of each document (key, _t: its terms) their number, and the numbers and counts of those among `terms`."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    ship(cut.sparkSession)
    known = cut.sparkSession.sparkContext.broadcast(terms.combine_chunks())
    schema = StructType([*[cut.schema[c] for c in key], StructField("dl", IntegerType()), StructField("at", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))])

    def work(parts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in parts:
            column = part.column(len(key))
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(column.flatten(), value_set=known.value), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(part)), size)[at >= 0]
            pairs, tf = np.unique(row * (len(known.value) + 1) + at[at >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(part) + 1) * (len(known.value) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % (len(known.value) + 1), tf)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], pa.array(size.astype(np.int32)), *lists], [*key, "dl", "at", "tf"])

    return cut.where("_t is not null").select(*key, "_t").mapInArrow(work, schema)


def excerpts(hits: DataFrame, docs: DataFrame, key: list[str], text: str = "text", signs: int = 350) -> DataFrame:
    """RT4: adds `excerpt`, the first signs of each hit's text. Hits are few, so documents are cut before they're joined."""
    return hits.join(docs.select(*key, F.substring(text, 1, signs).alias("excerpt")), key)


def two_field_top(claims: DataFrame, chunks: DataFrame, translations: DataFrame, query_key: str, key: list[str], query: str, k: int, attributed: str = "attributed_to", bonus: float = 0.5) -> DataFrame:
    """RT2, RT3: query_key, key, score, rank of the k best chunks (key, text, and author if there is one) by the better of two
    fields, the text and its translations (key, text), each boosted by the query's language; an identical author adds a bonus."""
    from ibidem.functions.language import query_language

    one = bm25(claims, chunks, query_key, key, F.col(query), F.col("text")).withColumnRenamed("score", "_text")
    joined = translations.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))  # a few languages
    other = bm25(claims, joined, query_key, key, F.col(query), F.col("text")).withColumnRenamed("score", "_translation")
    both = one.join(other, [query_key, *key], "full").join(claims.select(query_key, field_boosts(query_language(F.col(query))).alias("_boosts"), F.col(attributed).alias("_named")), query_key)
    if "author" in chunks.columns:
        both = both.join(chunks.select(*key, "author"), key, "left").withColumn("_same", F.coalesce(F.col("author") == F.col("_named"), F.lit(False)))
    else:
        both = both.withColumn("_same", F.lit(False))
    scored = both.select(query_key, *key, F.round(best_field(F.col("_boosts"), F.col("_text"), F.col("_translation"), F.col("_same"), bonus), 6).alias("score"))
    return top_k(scored, query_key, [F.col("score").desc(), *key], k)


def field_boosts(language: Column) -> Column:
    """RT2: struct(text, translation): boosts by the query's languages, modern ones before classical."""
    codes = F.split(F.coalesce(language, F.lit("unknown")), r"\+")
    modern = F.arrays_overlap(codes, F.array(*[F.lit(x) for x in ("pt", "es", "fr", "it", "en", "de")]))
    classical = F.arrays_overlap(codes, F.array(*[F.lit(x) for x in ("la", "grc", "el", "he")]))
    pair = lambda a, b: F.struct(F.lit(a).alias("text"), F.lit(b).alias("translation"))
    return F.when(modern, pair(1.0, 2.0)).when(classical, pair(2.0, 1.0)).otherwise(pair(1.2, 1.2))


def best_field(boosts: Column, text_score: Column, translation_score: Column, same_author: Column, bonus: float = 0.0) -> Column:
    """RT2, RT3: the better of two boosted fields, plus a bonus where the author's keyword is identical."""
    best = F.greatest(boosts["text"] * F.coalesce(text_score, F.lit(0.0)), boosts["translation"] * F.coalesce(translation_score, F.lit(0.0)))
    return best + F.when(same_author, bonus).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """RT7: 1 less the distance, at least 0; squared Euclidean by default, or the cosine."""
    if metric == "cosine":
        return F.greatest(F.lit(0.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - gap)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, query_key: str, key: list[str] | str, vector: str, k: int, metric: str = "l2sq", block: int | None = None) -> DataFrame:
    """TK2: query_key, key, score, rank of the k most similar vectors of each query, exact. Of several vectors of one key (in
    several collections) the most similar counts.

    A stated set of queries meets all vectors in blocks of at most about `block` queries (so many that their numbers fit a bound
    unless it is given), each broadcast: a vector is compared with every query, so the work is their product, as products of
    matrices; vectors aren't shuffled, and what leaves a block is limited to k a query and task.
    """
    keys = [key] if isinstance(key, str) else key
    return dense_top(queries, vectors, query_key, keys, vector, k, metric, block)


def containing(quotes: DataFrame, docs: DataFrame, quote_key: str, key: list[str], quote: str, text: str, grams: int = 4) -> DataFrame:
    """SC24 at scale: quote_key and key of every document whose text contains a quotation, both in a form made beforehand.

    A quotation's first whole words, after its first (which may be cut), must follow one another in the text; the hashes of
    such runs are sought in the text's, and only where they meet are the strings compared, in the same pass. Quotations of at most
    QUOTED signs in all are sought whole instead, by one automaton in a pass over each text's signs. While there are at
    most MOST_HASHES hashes, a text keeps those it has before anything is exploded; more are joined. Quotations too short for
    a run are a stated set that meets the texts in blocks, each one row that is broadcast.
    """
    if quotes.agg(F.coalesce(F.sum(F.length(quote)), F.lit(0))).first()[0] <= QUOTED:
        own = quotes.where(F.length(quote) > 0).select(quote_key, F.col(quote).alias("_q"))
        forms = [(r["_q"], False, r["_q"]) for r in own.select("_q").distinct().collect()]  # at most QUOTED signs
        return matches(docs.select(*key, F.col(text).alias("_t")), "_t", forms, "_q").join(F.broadcast(own), "_q").select(quote_key, *key)
    run = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
    cut = lambda c: F.filter(F.split(F.col(c), r"[ \n]+"), lambda w: w != "")
    own = quotes.select(quote_key, F.col(quote).alias("_q"), cut(quote).alias("_w")).withColumn("_long", F.size("_w") >= grams + 2)
    keyed = own.where("_long").select(quote_key, "_q", F.xxhash64(F.array_join(F.slice("_w", 2, grams), " ")).alias("_h"))
    wanted = keyed.select("_h").distinct()
    held = docs.select(*key, F.col(text).alias("_t"), cut(text).alias("_w"))
    hashes = F.array_distinct(F.when(F.size("_w") >= grams, run(F.col("_w"), grams)).otherwise(F.array().cast("array<bigint>")))
    if small(wanted, MOST_HASHES):
        row = F.broadcast(wanted.agg(F.collect_list("_h").alias("_hs")))
        spread = held.join(row).select(*key, "_t", F.explode(F.array_intersect(hashes, F.col("_hs"))).alias("_h"))
    else:
        spread = held.select(*key, "_t", F.explode(hashes).alias("_h"))
    long = spread.join(keyed, "_h").where(F.col("_t").contains(F.col("_q"))).select(quote_key, *key)
    short = own.where(~F.col("_long") & (F.length("_q") > 0)).select(quote_key, "_q")
    n_blocks = -(-short.count() // BLOCK)
    parts = [long]
    for number in range(n_blocks):
        block = short.where(F.pmod(F.xxhash64(quote_key), F.lit(n_blocks)) == number).agg(F.collect_list(F.struct(quote_key, "_q")).alias("_qs"))
        met = docs.select(*key, F.col(text).alias("_t")).join(F.broadcast(block))
        parts.append(met.select(*key, F.explode(F.filter("_qs", lambda q: F.col("_t").contains(q["_q"]))).alias("_e")).select(f"_e.{quote_key}", *key))
    return reduce(DataFrame.unionByName, parts)


def fused(text_hits: DataFrame, semantic_hits: DataFrame, keys: list[str], clip: bool = True) -> DataFrame:
    """JN17, RT10: two ranked lists joined in full: text_score, semantic_score, combined (0.65 and 0.35; 0.9 without text)."""
    both = text_hits.select(*keys, F.col("score").alias("_t")).join(semantic_hits.select(*keys, F.col("score").alias("_s")), keys, "full")
    text, semantic = F.coalesce("_t", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))
    bound = (lambda c: F.least(c, F.lit(1.0))) if clip else (lambda c: c)
    return both.select(*keys, text.alias("text_score"), semantic.alias("semantic_score"), F.when(text == 0, 0.9 * bound(semantic)).otherwise(0.65 * bound(text) + 0.35 * bound(semantic)).alias("combined"))


def only_unmatched(queries: DataFrame, text_hits: DataFrame, key: str) -> DataFrame:
    """RT9: the queries that text retrieval found nothing for, which alone go on to vectors."""
    return queries.join(text_hits.select(key).distinct(), key, "left_anti")
