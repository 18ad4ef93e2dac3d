"""Verification of quotations: retrieval, context, evidence, the best candidate, and its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ibidem.functions import evidence as E
from ibidem.functions.language import MODERN, query_language
from ibidem.functions.text import clean_ocr, fold
from ibidem.operators.hashed_vectors import hashed_top
from ibidem.operators.neighbours import wanted_context
from ibidem.operators.retrieval import bm25_top, fused, nearest_vectors, only_unmatched, two_field_top
from ibidem.operators.shared import written

KEY = ["doc_id", "chunk"]


def candidates(claims: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """claim_id, doc_id, chunk, score, rank: the k best chunks of each claim."""
    return bm25_top(claims, chunks, "claim_id", KEY, F.col("quote"), F.col("text"), k)


def retrieved(claims: DataFrame, chunks: DataFrame, k: int = 5, translations: DataFrame | None = None, claim_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None, legacy_vectors: DataFrame | None = None, always: bool = False, hashed: bool = False) -> DataFrame:
    """RT2, RT6, RT8-RT10: claim_id, doc_id, chunk, text_score, semantic_score, rank of each claim's candidates.

    Text goes first: the chunks' own, and their translations if there are any. Vectors are sought for the claims (claim_id,
    vector) that text found nothing for, or for every claim if `always`; among those of the chunks (doc_id, chunk, vector), and
    of a legacy collection only if one is given. Without vectors, `hashed` ones of the texts themselves can take their place. Both
    lists are then joined and ranked by their combined score.
    """
    if translations is not None:
        hits = two_field_top(claims, chunks, translations, "claim_id", KEY, "quote", k)
    else:
        hits = candidates(claims, chunks, k)
    hits = written(hits)
    if hashed:
        asked = claims if always else only_unmatched(claims, hits, "claim_id")
        near = hashed_top(asked, chunks, "claim_id", KEY, F.col("quote"), F.col("text"), k)
        return _ranked(hits, near, k)
    if claim_vectors is None or chunk_vectors is None:
        return hits.select("claim_id", *KEY, F.col("score").alias("text_score"), F.lit(0.0).alias("semantic_score"), "rank")
    asked = claim_vectors if always else only_unmatched(claim_vectors, hits, "claim_id")
    held = chunk_vectors if legacy_vectors is None else chunk_vectors.unionByName(legacy_vectors)
    return _ranked(hits, nearest_vectors(asked, held, "claim_id", KEY, "vector", k), k)


def _ranked(hits: DataFrame, near: DataFrame, k: int) -> DataFrame:
    both = fused(hits, near, ["claim_id", *KEY])
    w = Window.partitionBy("claim_id").orderBy(F.col("combined").desc(), *KEY)
    return both.select("claim_id", *KEY, "text_score", "semantic_score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= 2 * k)


def verify(claims: DataFrame, chunks: DataFrame, books: DataFrame, translations: DataFrame | None = None, k: int = 5, similarity: bool = True, **vectors) -> DataFrame:
    """The verdict on each claim (claim_id, quote, attributed_to) against chunks (doc_id, chunk, text, and page and column if
    known) of books (doc_id, author); translations are (doc_id, chunk, language, text), vectors those of retrieved().

    Candidates are ranked first; then only their texts, with the chunk before and two after (a quotation may run on), are
    taken from the chunks. The candidate with the highest selection score, the better rank first, gives the evidence. Costly
    string similarity is computed for that one only. Conflicts are candidates of other authors that hold the quotation too.
    """
    hits = retrieved(claims, chunks, k, translations, **vectors)
    tasks = claims.sparkSession.sparkContext.defaultParallelism
    near = wanted_context(chunks, hits, "doc_id", "chunk").join(books.select("doc_id", "author"), "doc_id", "left")
    # Few rows with much work each: adaptive execution would put them in one task.
    rows = hits.join(near, KEY).join(claims, "claim_id").repartition(tasks, "claim_id")
    rows = rows.withColumns({"exact": E.exact_match(F.col("quote"), F.col("context")), "author_match": E.same_author(F.col("attributed_to"), F.col("author"))})
    named = F.coalesce(F.col("attributed_to"), F.lit("")) != ""
    combined = E.penalized(E.combine(F.col("text_score"), F.col("semantic_score"), F.col("author_match")), named, F.col("author_match"), F.col("exact"))
    rows = rows.withColumn("combined", combined).withColumn("selected", E.selection(F.col("combined"), F.col("exact"), F.col("author_match")))
    places = [c for c in ("page", "column") if c in chunks.columns]
    fields = ["doc_id", "chunk", "author", "exact", "author_match", "combined", "semantic_score", "context", "previous", "next", *places]
    conflicts = F.count_if(F.col("exact") & ~F.col("author_match")).alias("conflicts")
    best = rows.groupBy("claim_id").agg(F.max(F.struct("selected", (-F.col("rank")).alias("order"), *fields)).alias("b"), conflicts).select("claim_id", "b.*", "conflicts")
    found = claims.join(best, "claim_id", "left")
    if translations is not None:
        own = translations.where("language = 'pt'").join(best.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.min("text").alias("translation"))
        found = found.join(own, KEY, "left")
    else:
        found = found.withColumn("translation", F.lit(None).cast("string"))
    modern = query_language(F.col("quote")).isin(*MODERN)
    found = found.withColumns({
        "fidelity": F.when(modern & F.col("translation").isNotNull(), E.fidelity(F.col("quote"), F.col("translation"))),
        "anchor": E.anchor(F.col("quote"), F.coalesce("context", F.lit("")), F.col("translation")),
        "intrusion": E.intrusion(F.col("quote")),
        "exact": F.coalesce("exact", F.lit(False)),
        "author_match": F.coalesce("author_match", F.lit(False)),
        "combined": F.coalesce("combined", F.lit(0.0)),
        "semantic_score": F.coalesce("semantic_score", F.lit(0.0)),
        "conflicts": F.when(F.coalesce("author_match", F.lit(False)), F.coalesce("conflicts", F.lit(0))).otherwise(0),
    })
    if similarity:
        found = found.repartition(tasks, "claim_id")
        measured = E.similarity_udf()(fold(clean_ocr(F.col("quote"))), fold(F.col("context")))
        found = found.withColumn("similarity", F.coalesce(measured, F.lit(0.0)))
    else:
        found = found.withColumn("similarity", F.when(F.col("exact"), 1.0).otherwise(0.0))
    code = E.verdict_code(F.col("combined"), F.col("exact"), F.col("author_match"), F.col("fidelity"), F.col("anchor"), F.col("intrusion"), F.col("similarity"))
    found = found.withColumn("code", F.when(F.col("doc_id").isNull(), "NAO_ENCONTRADA").otherwise(code))
    shown = F.col("code") != "NAO_ENCONTRADA"
    reference = F.when(shown, F.struct("doc_id", "chunk", "author", *places, E.excerpt(F.col("quote"), F.col("context")).alias("excerpt"), "translation", "previous", "next", E.context_risk(F.col("previous"), F.col("next")).alias("risk")))
    public = E.public_verdict(F.col("code"), F.col("intrusion"), F.col("conflicts"))
    return found.select(
        "claim_id", "code", E.label(F.col("code")).alias("label"), E.confidence(F.col("code")).alias("confidence"), public["verdict"].alias("public"), public["level"].alias("level"),
        "exact", "author_match", F.round("combined", 6).alias("combined"), F.round("semantic_score", 6).alias("semantic"), F.round("anchor", 6).alias("anchor"), F.round("intrusion", 6).alias("intrusion"), F.round("similarity", 6).alias("similarity"),
        E.explanation(F.col("code")).alias("explanation"), reference.alias("reference"),
    )


def verify_tasks(tasks: DataFrame, chunks: DataFrame, books: DataFrame, **options) -> DataFrame:
    """The natural-language entry: quotation and author are read out of a request (claim_id, task), then verified."""
    claims = tasks.select("claim_id", E.quoted(F.col("task")).alias("quote"), E.attributed(F.col("task")).alias("attributed_to"))
    return verify(claims, chunks, books, **options)
