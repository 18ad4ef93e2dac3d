"""Verification of a fixture of claims, with text, translations, vectors, pages; ingest; missing rows and gaps."""

import pytest
from pyspark.sql import functions as F

from ibidem.functions import evidence as E
from ibidem.functions.text import fold
from ibidem.operators import neighbours as N
from ibidem.operators import retrieval as R
from ibidem.operators import tables as D
from ibidem.operators.versions import Versions
from ibidem.plans.ingest import ingest, ingest_whole, rebuild
from ibidem.plans.ingest import library as shown
from ibidem.plans.verify import retrieved, verify

PASSAGE = "Quem planta figueiras ao lado do caminho colhe sombra para os viajantes e figos para os vizinhos"
OTHER = "The harbour keeps its lamps burning while ships return slowly through heavy winter fog"


def filler(n, seed):
    return " ".join(f"palavra{seed}x{i % 37}" for i in range(n))


@pytest.fixture(scope="module")
def library(spark):
    one = filler(480, 1).split()
    whole = " ".join([*one[:390], PASSAGE, *one[390:]])  # the passage lies across the border of two chunks
    texts = [(1, 0, whole[: len(whole) // 2]), (1, 1, whole[len(whole) // 2 :]), (2, 0, f"{filler(50, 2)} {OTHER} {filler(50, 3)}"), (3, 0, filler(80, 4))]
    chunks = spark.createDataFrame([(*t, 10 + t[1], 500) for t in texts], "doc_id long, chunk int, text string, page int, column int")
    books = spark.createDataFrame([(1, "Santo Anselmo de Lisboa"), (2, "Mary Harbour"), (3, "Nobody")], "doc_id long, author string")
    return chunks, books


CLAIMS = [
    (1, PASSAGE, "Anselmo de Lisboa", "CONFIRMADA_EXATA"),  # across two chunks, honorific only on one side
    (2, PASSAGE.upper().replace("CAMINHO", "CAMÍNHO"), "Santo Anselmo de Lisboa", "CONFIRMADA_EXATA"),  # case and accents
    (3, PASSAGE.replace("Quem", "12Quem"), "Santo Anselmo de Lisboa", "CONFIRMADA_EXATA"),  # digits of a scan
    (4, PASSAGE, "Mary Harbour", "ATRIBUICAO_DUVIDOSA"),
    (5, OTHER, "Mary Harbour", "CONFIRMADA_EXATA"),
    (6, OTHER.replace("lamps", "desconstrução"), "Mary Harbour", "NAO_ENCONTRADA"),  # a modern word
    (7, "Nothing of this was ever written anywhere", "Mary Harbour", "NAO_ENCONTRADA"),
    (8, OTHER.replace("slowly", "gently"), "Mary Harbour", "PARAFRASE_PLAUSIVEL"),
    (9, "heavy winter fog", "", "ATRIBUICAO_DUVIDOSA"),
    (10, "", "Mary Harbour", "NAO_ENCONTRADA"),
]


def test_claims(spark, library):
    claims = spark.createDataFrame([c[:3] for c in CLAIMS], "claim_id long, quote string, attributed_to string")
    found = {r.claim_id: r for r in verify(claims, *library).collect()}
    assert {k: r.code for k, r in found.items()} == {c[0]: c[3] for c in CLAIMS}
    own = found[1].reference
    assert own.page in (10, 11) and own.column == 500 and "figueiras" in own.excerpt and (own.previous is None) != (own.next is None)
    assert found[7].reference is None and found[5].similarity == 1.0


def test_conflicts_lower_the_public_verdict(spark, library):
    chunks, books = library
    twice = chunks.unionByName(spark.createDataFrame([(3, 1, OTHER, 1, 1)], chunks.schema))
    claims = spark.createDataFrame([(1, OTHER, "Mary Harbour")], "claim_id long, quote string, attributed_to string")
    calm, doubted = verify(claims, chunks, books).first(), verify(claims, twice, books).first()
    assert calm.code == doubted.code == "CONFIRMADA_EXATA" and (calm.public, doubted.public) == ("confirmado", "provável")


def test_translations_and_vectors(spark, library):
    chunks, books = library
    translations = spark.createDataFrame([(2, 0, "pt", "O porto mantém as lâmpadas acesas enquanto os navios voltam"), (2, 0, "fr", "Le port garde ses lampes")], "doc_id long, chunk int, language string, text string")
    claims = spark.createDataFrame([(1, "o porto mantém acesas as lâmpadas", "Mary Harbour"), (2, "zzz qqq", "Nobody")], "claim_id long, quote string, attributed_to string")
    hits = retrieved(claims, chunks, 3, translations).collect()
    assert {(r.claim_id, r.doc_id) for r in hits if r["rank"] == 1} == {(1, 2)}
    # Vectors: only for the claim that text found nothing for; a legacy collection counts only if it is given.
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "claim_id long, vector array<double>")
    held = spark.createDataFrame([(1, 0, [1.0, 0.0]), (3, 0, [0.6, 0.8]), (3, 0, [0.1, 0.9])], "doc_id long, chunk int, vector array<double>")
    legacy = spark.createDataFrame([(1, 1, [0.0, 1.0])], held.schema)
    found = [tuple(r) for r in retrieved(claims, chunks, 2, translations, asked, held).where("semantic_score > 0").select("claim_id", "doc_id", "chunk", "semantic_score").collect()]
    assert found[0] == (2, 3, 0, 0.98) and all(r[0] == 2 for r in found)  # the more similar of the chunk's two vectors
    older = retrieved(claims, chunks, 1, translations, asked, held, legacy).where("claim_id = 2 and rank = 1").first()
    assert (older.doc_id, older.chunk, older.semantic_score) == (1, 1, 1.0)
    every = retrieved(claims, chunks, 2, translations, asked, held, always=True).where("claim_id = 1 and semantic_score > 0").count()
    assert every > 0
    verdicts = {r.claim_id: r.code for r in verify(claims, chunks, books, translations, claim_vectors=asked, chunk_vectors=held).collect()}
    assert verdicts[1] == "TRADUCAO_FIEL" and verdicts[2] == "NAO_ENCONTRADA"


def test_short_and_many_quotations(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta{i} gamma delta epsilon zeta eta theta {i % 3}") for i in range(30)], "doc_id long, text string")
    quotes = [(0, "eta2 gamma"), (1, "ta1"), (2, "beta7 gamma delta epsilon zeta eta"), (3, "a"), (4, "nowhere"), (5, ""), (6, "delta epsilon zeta eta theta 1")]
    expected = {(q, i) for q, t in quotes for i in range(30) if t and t in f"alpha beta{i} gamma delta epsilon zeta eta theta {i % 3}"}
    frame = spark.createDataFrame(quotes, "item_id long, q string")
    run = lambda: [(r.item_id, r.doc_id) for r in R.containing(frame, docs, "item_id", ["doc_id"], "q", "text").collect()]
    first = run()
    monkeypatch.setattr(R, "MOST_HASHES", 0)  # joined in place of being kept in the text
    monkeypatch.setattr(R, "BLOCK", 2)
    assert sorted(first) == sorted(run()) == sorted(expected)


def test_bm25_by_shuffle_and_broadcast(spark, tables, monkeypatch):
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    run = lambda: sorted((r.item_id, r.doc_id, round(r.score, 6)) for r in R.bm25(items, docs, "item_id", ["doc_id"], F.col("text"), F.col("text")).collect())
    one = run()
    monkeypatch.setattr(R, "MOST_TERMS", 0)
    assert one == run() and one


def test_no_text_is_shuffled(spark, library):
    """Only wanted chunks and their neighbours go through an exchange with their texts."""
    chunks, _ = library
    wanted = spark.createDataFrame([(1, 0)], "doc_id long, chunk int")
    near = N.wanted_context(chunks, wanted, "doc_id", "chunk")
    assert [(r.doc_id, r.chunk, r.previous is None, r.next is None) for r in near.collect()] == [(1, 0, True, False)]


def test_gaps_and_missing(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "d"), (2, 5, "x")], "g long, n long, text string")
    assert {(r.n, r.previous, r.next) for r in N.exact_neighbours(rows, "g", "n").collect()} == {(0, None, "b"), (1, "a", None), (3, None, None), (5, None, None)}
    assert {(r.n, r.previous, r.next) for r in N.nearest(rows, "g", ["n"]).collect()} == {(0, None, "b"), (1, "a", "d"), (3, "b", None), (5, None, None)}
    assert [r.g for r in D.missing_ids(rows, rows.where("g = 1"), "g").collect()] == [2]
    customers = spark.createDataFrame([(1,), (2,), (3,)], "c long")
    orders = spark.createDataFrame([(1,), (1,), (None,)], "o long")
    assert sorted(r.c for r in customers.join(orders, F.col("c") == F.col("o"), "left_anti").collect()) == [2, 3]
    assert D.unfinished(spark.createDataFrame([("a", None), ("b", "done"), ("c", "open")], "k string, s string"), "s").count() == 1


def test_ingest(spark, tmp_path):
    pages = "array<struct<page_number:int,text:string>>"
    books = spark.createDataFrame([(1, "raw", "Canon", "A", [(1, filler(300, 1)), (2, filler(300, 2))]), (2, "only raw", None, None, [(1, "")])], f"doc_id long, title string, canonical_title string, author string, pages {pages}")
    translations = spark.createDataFrame([(1, 0, "pt", "texto")], "doc_id long, chunk int, language string, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0])], "doc_id long, chunk int, vector array<double>")
    other = spark.createDataFrame([(1, 0, "pt", [2.0]), (9, 0, "pt", [2.0])], "doc_id long, chunk int, language string, vector array<double>")
    for _ in range(2):  # a repeated batch replaces itself
        assert ingest(books, str(tmp_path), "b1", translations, vectors, other) == {"chunks": 2, "index": 2, "vectors": 2, "books": 2}
    index = {r.id: r for r in spark.read.parquet(f"{tmp_path}/index").collect()}
    assert index["1_0"].title == "Canon" and index["1_0"].translation == "texto" and index["1_1"].translation is None
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/vectors").collect()) == ["1_0", "1_0_translation_pt"]
    assert {(r.chunk, r.page) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {(0, 1), (1, 2)}


def test_ingest_whole(spark, tmp_path):
    """A batch shows whole or not at all: a writer that fails half-way, after some tables, leaves the version before."""
    pages = "array<struct<page_number:int,text:string>>"
    books = spark.createDataFrame([(1, "raw", "Canon", "A", [(1, filler(300, 1)), (2, filler(300, 2))]), (2, "only raw", None, None, [(1, "")])], f"doc_id long, title string, canonical_title string, author string, pages {pages}")
    held = Versions.create(spark, str(tmp_path / "library"))
    assert shown(held, "books") is None
    vectors = spark.createDataFrame([(1, 0, [1.0])], "doc_id long, chunk int, vector array<double>")
    for _ in range(2):  # a repeated batch replaces itself
        assert ingest_whole(held, books, "b1", None, vectors) == {"chunks": 2, "index": 2, "vectors": 1, "books": 2}
    assert ingest_whole(held, books.where("doc_id = 1").withColumn("doc_id", F.lit(7).cast("long")), "b2")["chunks"] == 2
    before, state = held.current()[0], {n: sorted(map(str, shown(held, n).collect())) for n in ("books", "chunks", "index", "vectors")}
    assert len(state["chunks"]) == 4 and len(state["books"]) == 3
    broken = vectors.withColumn("vector", F.when(F.col("chunk") == 0, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("vector")))
    with pytest.raises(Exception, match="lost"):  # chunks and index have been written by then
        ingest_whole(held, books, "b1", None, broken)
    assert held.current()[0] == before and {n: sorted(map(str, shown(held, n).collect())) for n in state} == state
    with pytest.raises(ValueError, match="made anew"):
        rebuild(held, "index", shown(held, "index").limit(1))
    assert held.current()[0] == before
    assert rebuild(held, "index", shown(held, "index").withColumn("title", F.upper("title"))) == 4
    assert {r.title for r in shown(held, "index").collect()} == {"CANON"} and shown(held, "books").count() == 3


def test_similarity_is_that_of_the_best_candidate(spark, tables):
    """The flagship's similarity against difflib over the same windows."""
    from difflib import SequenceMatcher

    pairs = spark.createDataFrame([("abc def", "xx abc def yy"), ("abcdefgh", "zzabcxefghzz"), ("long words here", "short")], "q string, t string")
    for r in pairs.select("*", E.similarity_udf()(fold(F.col("q")), fold(F.col("t"))).alias("s")).collect():
        windows = [r.t[i : i + len(r.q)] for i in range(0, max(1, len(r.t) - len(r.q) + 1), max(1, len(r.q) // 4))]
        best, ratios = 0.0, [SequenceMatcher(None, r.q, w).ratio() for w in windows]
        for x in ratios:
            best = max(best, x)
            if best >= 0.9:
                break
        assert r.s == (1.0 if r.q in r.t else best)


def test_known_authors(spark):
    from ibidem.functions import lexicon, metadata

    texts = spark.createDataFrame([(1, "As Confissões de Santo Agostinho"), (2, "Contra as heresias"), (3, "De Trinitate, por Hilário de Poitiers; e Santo Agostinho"), (4, "nobody")], "id long, text string")
    known = lexicon.known_authors(spark)
    assert known.select("author").distinct().count() == len(lexicon.AUTHORS) and known.where("weight = 2").count() >= len(lexicon.AUTHORS)
    found = {r.id: (r.author, r.score) for r in metadata.best_author(metadata.lexicon_scores(texts, known)).collect()}
    assert found == {1: ("Augustine", 3), 2: (None, 1), 3: ("Augustine", 3)}


def test_hashed_vectors_find_what_text_does_not(spark):
    """A quotation whose every word is misspelt shares no word with its passage, but most of its signs."""
    chunks_ = spark.createDataFrame([(1, 0, "blessed are the peacemakers for they shall inherit"), (2, 0, "consider the lilies of the field how they grow"), (3, 0, None)], "doc_id long, chunk int, text string")
    claims = spark.createDataFrame([(1, "blesseds peacemakerss inheritt", "a"), (2, "consider lilies", "b"), (3, "", "c"), (4, None, "d")], "claim_id long, quote string, attributed_to string")
    hits = {(r.claim_id, r.doc_id): (r.text_score, r.semantic_score) for r in retrieved(claims, chunks_, hashed=True).collect()}
    assert set(hits) == {(1, 1), (2, 2)} and hits[1, 1][0] == 0 and hits[1, 1][1] > 0.3 and hits[2, 2][1] == 0
    books = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, author string")
    assert {r.claim_id: r.semantic > 0 for r in verify(claims, chunks_, books, hashed=True).collect()} == {1: True, 2: False, 3: False, 4: False}
