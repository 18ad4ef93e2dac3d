"""The named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ibidem.functions import dates as T2
from ibidem.functions import evidence as E
from ibidem.functions import language as L
from ibidem.functions import metadata as M
from ibidem.functions import text as T
from ibidem.operators import id_sets as I
from ibidem.operators import neighbours as N
from ibidem.operators import retrieval as R
from ibidem.operators import tables as D
from ibidem.operators.chunk import chunks
from ibidem.operators.hashed_vectors import hashed_top
from ibidem.operators.shared import fresh_folder
from ibidem.operators.text_index import TextIndex
from ibidem.operators.vector_index import VectorIndex
from ibidem.operators.versions import Versions
from ibidem.sources import html as H
from ibidem.sources.files import spread, table

from . import catalog as C
from .ingest import ingest_whole, library
from .registry import ORACLES, query
from .verify import candidates, verify

FOLD = "lower(trim(regexp_replace(strip_accents({0}), '\\s+', ' ', 'g')))"
CHUNKS = """
w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, (s / 400)::INT AS chunk, array_to_string(list_slice(w, s + 1, s + 500), ' ') AS text
      FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 400)) AS s FROM w WHERE len(w) > 0))"""
BM25 = CHUNKS + r""",
d AS (SELECT doc_id, chunk, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{1,}')) AS dl FROM c),
p AS (SELECT doc_id, chunk, term, count(*) AS tf FROM (SELECT doc_id, chunk, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{1,}')) AS term FROM c) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{1,}')) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(dl) AS mean FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id, doc_id, chunk, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id, chunk), n GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk) AS rank FROM s)"""


def _claims(spark, sf_dir):
    """Benchmark items as quotations, attributed to a source by their number."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("quote"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("attributed_to"))


@query("chunk_words", f"WITH {CHUNKS} SELECT doc_id, chunk, text FROM c")
def _(spark, sf_dir):
    return chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("normalize_text", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("exact_quote_hits", "SELECT item_id, doc_id FROM (SELECT item_id, lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g'))) AS q FROM benchmark) b JOIN (SELECT doc_id, lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g'))) AS t FROM documents) d ON contains(t, q)")
def _(spark, sf_dir):
    folded = lambda name: spread(table(spark, sf_dir, name)).withColumn("f", T.fold(F.col("text")))
    return R.containing(folded("benchmark").withColumnRenamed("f", "q"), folded("documents").select("doc_id", "f"), "item_id", ["doc_id"], "q", "f")


@query("bm25_top5", f"WITH {BM25} SELECT item_id, doc_id, chunk, score, rank FROM t WHERE rank <= 5")
def _(spark, sf_dir):
    held = chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return R.bm25_top(table(spark, sf_dir, "benchmark"), held, "item_id", ["doc_id", "chunk"], F.col("text"), F.col("text"), 5)


@query("bm25_all", f"WITH {BM25} SELECT item_id, doc_id, chunk, round(score, 2) AS score FROM s WHERE item_id % 20 = 0")
def _(spark, sf_dir):
    """All scores of every twentieth item."""
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    found = R.bm25(items, chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "item_id", ["doc_id", "chunk"], F.col("text"), F.col("text"))
    return found.withColumn("score", F.round("score", 2))


@query("postings_terms", r"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{1,}')) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def _(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _vectors(metric):
    def run(spark, sf_dir):
        v = table(spark, sf_dir, "embeddings")
        return R.nearest_vectors(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, "query_id", "vec_id", "embedding", 5, metric)

    return run


for metric, sim in (("l2sq", "1 - list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"), ("cosine", "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])")):
    query(f"vector_top5_{metric}", f"SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(greatest(0.0, {sim}), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0.0, {sim}), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5")(_vectors(metric))


def _indexed(spark, sf_dir, share: float):
    """The index of all vectors with about the root of their number of lists, searched in a share of these."""
    v = table(spark, sf_dir, "embeddings")
    lists = max(2, int(v.count() ** 0.5))
    index = VectorIndex.build(v, fresh_folder(spark), "vec_id", "embedding", lists, "cosine")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.top(asked, "query_id", "embedding", 5, max(1, int(share * lists))).withColumnRenamed("key", "vec_id")


@query("vector_index_top5")
def _(spark, sf_dir):
    """RT7, TK2: from half of the lists; recall is measured in tests."""
    return _indexed(spark, sf_dir, 0.5)


@query("vector_index_all_lists", "SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(greatest(0.0, list_cosine_similarity(q.embedding::FLOAT[]::DOUBLE[], v.embedding::FLOAT[]::DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0.0, list_cosine_similarity(q.embedding::FLOAT[]::DOUBLE[], v.embedding::FLOAT[]::DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def _(spark, sf_dir):
    """RT7: from all lists, which is exact."""
    return _indexed(spark, sf_dir, 1.0)


@query("bm25_index_top5", f"WITH {BM25.replace("FROM documents)", "FROM documents WHERE lang <> 'es')", 1)} SELECT item_id, doc_id, chunk, score, rank FROM t WHERE rank <= 5")
def _(spark, sf_dir):
    """RT1, SNK2, SNK5: from an index into which French documents went with other texts at first, German ones in a second batch, and
    from which Spanish ones were deleted."""
    docs, key = table(spark, sf_dir, "documents"), ["doc_id", "chunk"]
    held = spread(docs.select(F.struct("doc_id", "lang").alias("doc"), "text"))
    held = chunks(held, "doc").select("doc.*", "chunk", "text")
    index = TextIndex.create(spark, fresh_folder(spark), buckets=16)
    index.upsert(held.where("lang <> 'de'"), key, F.when(F.col("lang") == "fr", F.reverse("text")).otherwise(F.col("text")))
    index.upsert(held.where("lang IN ('fr', 'de')"), key, F.col("text"))
    index.delete(held.where("lang = 'es'"), key)
    index.merge(key, 1)
    items = table(spark, sf_dir, "benchmark")
    return index.top(items, "item_id", key, F.col("text"), 5)


HASHED = r"""w AS (SELECT kind, id, list_transform(regexp_extract_all(FOLDED, '[\p{L}\p{N}]+'), lambda x: '_' || x || '__') AS ws FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark)),
g AS (SELECT kind, id, f, count(*) AS tf FROM (SELECT kind, id, unnest(flatten(list_transform(ws, lambda x: list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4))))) AS f FROM w) GROUP BY ALL),
h AS (SELECT kind, id, tf, CAST(concat('0x', substr(md5(f), 1, 8)) AS BIGINT) AS h FROM g),
e AS (SELECT kind, id, h % 65536 AS place, sum(CASE WHEN (h // 65536) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS v FROM h GROUP BY ALL HAVING abs(v) > 1e-9),
n AS (SELECT count(*) AS n FROM documents), i AS (SELECT place, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM e, n WHERE kind = 'd' GROUP BY place),
x AS (SELECT kind, id, place, v * coalesce(idf, ln(1.0::DOUBLE + n) + 1) AS w FROM e LEFT JOIN i USING (place), n),
u AS (SELECT kind, id, place, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS w FROM x),
s AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.w * d.w), 6) AS score FROM u q JOIN u d USING (place) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL HAVING score > 0)""".replace("FOLDED", FOLD.format("text"))


@query("hashed_vectors_top5", f"WITH {HASHED} SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def _(spark, sf_dir):
    """RT6: the documents nearest to each item by hashed vectors of their texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return hashed_top(table(spark, sf_dir, "benchmark"), docs, "item_id", ["doc_id"], F.col("text"), F.col("text"), 5)


@query("text_excerpts", f"WITH {BM25} SELECT item_id, doc_id, chunk, left(c.text, 350) AS excerpt FROM t JOIN c USING (doc_id, chunk) WHERE rank <= 3")
def _(spark, sf_dir):
    """RT4: hits as a search shows them, with the first 350 signs of each; only texts of hits are taken."""
    held, key = chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), ["doc_id", "chunk"]
    hits = R.bm25_top(table(spark, sf_dir, "benchmark"), held, "item_id", key, F.col("text"), F.col("text"), 3)
    return R.excerpts(hits, held, key).select("item_id", *key, "excerpt")


@query("ingested_index", f"WITH {CHUNKS} SELECT concat(doc_id, '_', chunk) AS id, coalesce(CASE WHEN n_chars % 2 = 0 THEN upper(lang) END, source) AS title, source AS author, c.text FROM c JOIN documents USING (doc_id)")
def _(spark, sf_dir):
    """SNK1, PRJ1: the text index's documents after two batches, one of them repeated, each shown whole by a version."""
    docs = table(spark, sf_dir, "documents")
    pages = F.array(F.struct(F.lit(1).alias("page_number"), "text")).alias("pages")
    books = docs.select("doc_id", F.col("source").alias("title"), F.when(F.col("n_chars") % 2 == 0, F.upper("lang")).alias("canonical_title"), F.col("source").alias("author"), "lang", pages)
    held = Versions.create(spark, fresh_folder(spark))
    for batch, wanted in (("others", F.col("lang") != "en"), ("english", F.col("lang") == "en"), ("others", F.col("lang") != "en")):
        ingest_whole(held, books.where(wanted).drop("lang"), batch)
    return library(held, "index").select("id", "title", "author", "text")


@query("ids_missing", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf_dir):
    """JN10 by bitmaps: documents without a vector."""
    return I.missing(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "embeddings"), "vec_id")


@query("store_coverage", """SELECT count(DISTINCT doc_id) AS n_ids, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS labels_has, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_besides,
  (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS vectors_has, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_besides FROM documents""")
def _(spark, sf_dir):
    """AG18 by bitmaps: what two stores have of the documents."""
    stores = {"labels": table(spark, sf_dir, "labels"), "vectors": table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")}
    return I.coverage(table(spark, sf_dir, "documents"), stores, "doc_id")


DISTANCE = "list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
NEAR = f"""n1 AS (SELECT item_id, v.vec_id AS doc_id, round(greatest(0.0, 1 - {DISTANCE}), 6) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v),
n2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM n1)"""
EXACT = f"x1 AS (SELECT DISTINCT item_id FROM (SELECT item_id, {FOLD.format('text')} AS q FROM benchmark) JOIN (SELECT {FOLD.format('text')} AS t FROM documents) ON contains(t, q))"


def _item_vectors(spark, sf_dir):
    """A benchmark item has the vector of its number, and so has a document."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.join(table(spark, sf_dir, "benchmark").select("item_id"), F.col("vec_id") == F.col("item_id")).select("item_id", "embedding"), vectors.select(F.col("vec_id").alias("doc_id"), "embedding")


@query("hybrid_fusion", f"""WITH {BM25}, {NEAR},
x AS (SELECT item_id, doc_id, max(score) / 128 AS score FROM t WHERE rank <= 10 GROUP BY ALL),
y AS (SELECT item_id, doc_id, score FROM n2 WHERE rank <= 10)
SELECT item_id, doc_id, round(coalesce(x.score, 0), 6) AS text_score, round(coalesce(y.score, 0), 6) AS semantic_score,
  round(CASE WHEN coalesce(x.score, 0) = 0 THEN 0.9 * least(coalesce(y.score, 0), 1) ELSE 0.65 * least(x.score, 1) + 0.35 * least(coalesce(y.score, 0), 1) END, 4) AS combined
FROM x FULL JOIN y USING (item_id, doc_id)""")
def _(spark, sf_dir):
    """JN17, RT10: the ten best documents by text and the ten nearest by vectors, joined."""
    items, docs = table(spark, sf_dir, "benchmark"), spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = candidates(items.select(F.col("item_id").alias("claim_id"), F.col("text").alias("quote")), chunks(docs), 10)
    text = hits.groupBy(F.col("claim_id").alias("item_id"), "doc_id").agg((F.max("score") / 128).alias("score"))
    near = R.nearest_vectors(*_item_vectors(spark, sf_dir), "item_id", "doc_id", "embedding", 10)
    return R.fused(text, near, ["item_id", "doc_id"]).select("item_id", "doc_id", *[F.round(c, n).alias(c) for c, n in (("text_score", 6), ("semantic_score", 6), ("combined", 4))])


@query("semantic_fallback", f"WITH {EXACT}, {NEAR} SELECT item_id, doc_id, score, rank FROM n2 WHERE rank <= 5 AND item_id NOT IN (SELECT item_id FROM x1)")
def _(spark, sf_dir):
    """RT9: the nearest vectors of items that no document's text contains."""
    folded = lambda name: spread(table(spark, sf_dir, name)).withColumn("f", T.fold(F.col("text")))
    hits = R.containing(folded("benchmark").withColumnRenamed("f", "q"), folded("documents").select("doc_id", "f"), "item_id", ["doc_id"], "q", "f")
    asked, held = _item_vectors(spark, sf_dir)
    return R.nearest_vectors(R.only_unmatched(asked, hits, "item_id"), held, "item_id", "doc_id", "embedding", 5)


@query("verify_claims")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = verify(_claims(spark, sf_dir), chunks(spread(docs.select("doc_id", "text"))), docs.select("doc_id", F.col("source").alias("author")))
    return found.select("*", F.col("reference.doc_id").alias("doc_id"), F.col("reference.chunk").alias("chunk"), F.col("reference.excerpt").alias("excerpt")).drop("reference")


STOP = "[" + ", ".join(f"'{w}'" for w in E.STOP_WORDS) + "]"


LEXICAL = f"""WITH {BM25},
x AS (SELECT doc_id, chunk, array_to_string(list_filter([lag(text) OVER v, text, lead(text) OVER v, lead(text, 2) OVER v], lambda z: z IS NOT NULL AND z <> ''), chr(10)) AS ctx FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY chunk)),
r AS (SELECT t.item_id, t.doc_id, t.chunk, t.rank, least(t.score, 1.0) AS ts, b.text AS quote, x.ctx,
        contains(lower(ctx), lower(trim(b.text))) OR contains({FOLD.format('ctx')}, {FOLD.format('b.text')}) AS exact,
        'src' || (t.item_id % 20) = source OR length(source) >= 6 AND contains('src' || (t.item_id % 20), source) OR length('src' || (t.item_id % 20)) >= 6 AND contains(source, 'src' || (t.item_id % 20)) AS am
      FROM t JOIN benchmark b USING (item_id) JOIN x USING (doc_id, chunk) JOIN documents USING (doc_id) WHERE rank <= 5),
s2 AS (SELECT *, (0.65 * ts + CASE WHEN am THEN 0.2 ELSE 0 END) * CASE WHEN am THEN 1 WHEN exact THEN 0.6 ELSE 0.4 END AS combined FROM r),
b2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY combined + CASE WHEN exact THEN 2 ELSE 0 END + CASE WHEN am THEN 0.2 ELSE 0 END DESC, rank) AS k FROM s2),
e AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(quote), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda z: NOT list_contains({STOP}, z)) AS qt,
        list_distinct(regexp_extract_all(lower(ctx), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS ct FROM b2 WHERE k = 1)
SELECT item_id AS claim_id, CASE WHEN exact AND am THEN 'CONFIRMADA_EXATA' WHEN exact THEN 'ATRIBUICAO_DUVIDOSA' ELSE 'NAO_ENCONTRADA' END AS code,
  exact, am AS author_match, round(combined, 6) AS combined, round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, ct)) / len(qt) END, 6) AS anchor
FROM e"""


@query("verify_lexical", LEXICAL)
def _(spark, sf_dir):
    """Verification without string similarity, so paraphrases can't be told; all else alike."""
    docs = table(spark, sf_dir, "documents")
    found = verify(_claims(spark, sf_dir), chunks(spread(docs.select("doc_id", "text"))), docs.select("doc_id", F.col("source").alias("author")), similarity=False)
    return found.select("claim_id", "code", "exact", "author_match", "combined", "anchor")


@query("verify_reference", LEXICAL.split("\nSELECT item_id AS claim_id")[0] + """,
held AS (SELECT item_id, count(*) FILTER (exact AND NOT am) AS conflicts FROM s2 GROUP BY 1),
near AS (SELECT doc_id, chunk, lag(text) OVER v AS previous, lead(text) OVER v AS next FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY chunk)),
told AS (SELECT e.*, previous, next, am AND conflicts > 0 AS doubt, CASE WHEN exact AND am THEN 'CONFIRMADA_EXATA' WHEN exact THEN 'ATRIBUICAO_DUVIDOSA' ELSE 'NAO_ENCONTRADA' END AS code FROM e JOIN held USING (item_id) JOIN near USING (doc_id, chunk))
SELECT item_id AS claim_id, CASE code WHEN 'CONFIRMADA_EXATA' THEN 'Confirmada (exata)' WHEN 'ATRIBUICAO_DUVIDOSA' THEN 'Atribuição duvidosa' ELSE 'Não encontrada' END AS label, CASE code WHEN 'CONFIRMADA_EXATA' THEN 'Alta' WHEN 'ATRIBUICAO_DUVIDOSA' THEN 'Baixa' ELSE 'Nenhuma' END AS confidence,
  CASE code WHEN 'CONFIRMADA_EXATA' THEN CASE WHEN doubt THEN 'provável' ELSE 'confirmado' END WHEN 'ATRIBUICAO_DUVIDOSA' THEN 'inconclusivo' ELSE 'não sustentado' END AS public,
  CASE code WHEN 'CONFIRMADA_EXATA' THEN CASE WHEN doubt THEN 'baixo' ELSE 'alto' END WHEN 'ATRIBUICAO_DUVIDOSA' THEN 'baixo' ELSE 'crítico' END AS level,
  CASE WHEN exact THEN doc_id END AS doc_id, CASE WHEN exact THEN chunk END AS chunk, CASE WHEN exact THEN previous END AS previous, CASE WHEN exact THEN next END AS next,
  CASE WHEN NOT exact THEN NULL WHEN previous IS NULL AND next IS NULL THEN 'unknown' WHEN regexp_matches(lower(concat_ws(' ', previous, next)), 'não|nunca|falso|not|never|heresy') THEN 'high' ELSE 'low' END AS risk FROM told""")
def _(spark, sf_dir):
    """PRJ2, SC30, SC37: what the verdict of verify_lexical shows, with the reference's place and neighbours."""
    docs = table(spark, sf_dir, "documents")
    found = verify(_claims(spark, sf_dir), chunks(spread(docs.select("doc_id", "text"))), docs.select("doc_id", F.col("source").alias("author")), similarity=False)
    own = F.col("reference")
    return found.select("claim_id", "label", "confidence", "public", "level", *[own[c].alias(c) for c in ("doc_id", "chunk", "previous", "next", "risk")])


@query("lexical_anchor_top", f"""WITH {BM25},
e AS (SELECT t.item_id, t.doc_id, t.chunk, rank, list_filter(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda z: NOT list_contains({STOP}, z)) AS qt,
  list_distinct(regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS ct FROM t JOIN benchmark b USING (item_id) JOIN c USING (doc_id, chunk) WHERE rank <= 3)
SELECT item_id, doc_id, chunk, rank, round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, ct)) / len(qt) END, 6) AS anchor FROM e""")
def _(spark, sf_dir):
    items, held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("quote")), chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = candidates(items, held, 3).join(items, "claim_id").join(held, ["doc_id", "chunk"])
    return found.select(F.col("claim_id").alias("item_id"), "doc_id", "chunk", "rank", F.round(E.anchor(F.col("quote"), F.col("text")), 6).alias("anchor"))


@query("fidelity_bands", r"""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 3)) AS q, list_distinct(list_filter(string_split_regex(lower(nxt), '\s+'), lambda w: length(w) > 3)) AS r FROM p WHERE nxt IS NOT NULL),
s AS (SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, r)) / len(q) END AS share FROM t)
SELECT conv_id, turn, CASE WHEN share >= 0.4 THEN 'fiel' WHEN share >= 0.2 THEN 'imprecisa' ELSE 'nao_encontrada' END AS band FROM s""")
def _(spark, sf_dir):
    near = N.nearest(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).where("next is not null")
    return near.select("conv_id", "turn", E.fidelity(F.col("text"), F.col("next")).alias("band"))


GRID_SQL = """WITH g AS (SELECT l_orderkey, l_linenumber, (l_partkey % 101) / 100.0 AS combined, l_returnflag = 'R' AND l_linenumber = 1 AS exact, l_linestatus = 'F' AS author,
  CASE WHEN l_quantity > 40 THEN 'fiel' WHEN l_quantity > 30 THEN 'imprecisa' WHEN l_quantity > 20 THEN 'nao_encontrada' END AS fidelity,
  l_discount * 10 AS anchor, CASE WHEN l_tax > 0.07 THEN l_tax * 5 WHEN l_tax > 0.06 THEN 0.1 ELSE 0 END AS intrusion, (l_suppkey % 100) / 100.0 AS similarity FROM lineitem),
v AS (SELECT *, CASE WHEN intrusion > 0 AND NOT exact THEN 'NAO_ENCONTRADA' WHEN exact AND author THEN 'CONFIRMADA_EXATA' WHEN exact THEN 'ATRIBUICAO_DUVIDOSA'
  WHEN fidelity = 'fiel' AND combined >= 0.55 AND anchor >= 0.18 THEN CASE WHEN author THEN 'TRADUCAO_FIEL' ELSE 'ATRIBUICAO_DUVIDOSA' END
  WHEN fidelity = 'imprecisa' AND combined >= 0.55 AND anchor >= 0.18 THEN 'TRADUCAO_IMPRECISA'
  WHEN author AND combined >= 0.78 AND anchor >= 0.75 AND similarity >= 0.5 THEN 'PARAFRASE_PLAUSIVEL' ELSE 'NAO_ENCONTRADA' END AS code FROM g)"""


def _grid(spark, sf_dir):
    """What verdicts are drawn from, read from the columns of lines, so that every rule is met."""
    quantity, tax = F.col("l_quantity"), F.col("l_tax")
    grid = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_partkey") % 101) / 100.0).alias("combined"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("exact"), (F.col("l_linestatus") == "F").alias("author"),
        F.when(quantity > 40, "fiel").when(quantity > 30, "imprecisa").when(quantity > 20, "nao_encontrada").alias("fidelity"),
        (F.col("l_discount") * 10).alias("anchor"), F.when(tax > 0.07, tax * 5).when(tax > 0.06, 0.1).otherwise(0.0).alias("intrusion"), ((F.col("l_suppkey") % 100) / 100.0).alias("similarity"),
    )
    return grid.withColumn("code", E.verdict_code(*[F.col(c) for c in ("combined", "exact", "author", "fidelity", "anchor", "intrusion", "similarity")]))


@query("verdict_grid", GRID_SQL + " SELECT l_orderkey, l_linenumber, code FROM v")
def _(spark, sf_dir):
    """SC36: all six codes."""
    return _grid(spark, sf_dir).select("l_orderkey", "l_linenumber", "code")


@query("public_verdicts", GRID_SQL + """ SELECT code, intrusion > 0.3 AS doubtful, count(*) AS n,
  CASE WHEN NOT intrusion > 0.3 THEN CASE WHEN code IN ('CONFIRMADA_EXATA', 'TRADUCAO_FIEL') THEN 'confirmado' WHEN code = 'NAO_ENCONTRADA' THEN 'não sustentado' ELSE 'inconclusivo' END
       ELSE CASE WHEN code IN ('CONFIRMADA_EXATA', 'TRADUCAO_FIEL') THEN 'provável' ELSE 'não sustentado' END END AS verdict,
  CASE WHEN NOT intrusion > 0.3 THEN CASE code WHEN 'CONFIRMADA_EXATA' THEN 'alto' WHEN 'TRADUCAO_FIEL' THEN 'médio-alto' WHEN 'NAO_ENCONTRADA' THEN 'crítico' ELSE 'baixo' END
       ELSE CASE WHEN code IN ('CONFIRMADA_EXATA', 'TRADUCAO_FIEL') THEN 'baixo' ELSE 'crítico' END END AS level
FROM v GROUP BY ALL""")
def _(spark, sf_dir):
    public = E.public_verdict(F.col("code"), F.col("intrusion"), F.lit(0))
    return _grid(spark, sf_dir).groupBy("code", (F.col("intrusion") > 0.3).alias("doubtful"), public["verdict"].alias("verdict"), public["level"].alias("level")).agg(F.count("*").alias("n"))


@query("context_window", """SELECT conv_id, turn, array_to_string(list_filter([lag(text) OVER w, text, lead(text) OVER w, lead(text, 2) OVER w], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(spark, sf_dir):
    return N.context(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "context")


@query("neighbours_nearest", f"SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.col("turn"))
    return N.nearest(rows, "conv_id", ["turn"], "t").select("conv_id", "turn", "previous", "next")


@query("neighbours_exact", f"SELECT a.conv_id, a.turn, b.text AS previous, c.text AS next FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return N.exact_neighbours(rows, "conv_id", "turn").select("conv_id", "turn", "previous", "next")


@query("context_risk", r"""WITH p AS (SELECT conv_id, turn, lag(text) OVER w AS b, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN a IS NULL AND b IS NULL THEN 'unknown' WHEN regexp_matches(lower(concat_ws(' ', b, a)), 'não|nunca|falso|not|never|heresy') THEN 'high' ELSE 'low' END AS risk FROM p""")
def _(spark, sf_dir):
    near = N.nearest(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])
    return near.select("conv_id", "turn", E.context_risk(F.col("previous"), F.col("next")).alias("risk"))


@query("sticky_section", "SELECT event_id, user_id, last_value(CASE WHEN value > 100 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def _(spark, sf_dir):
    rows = N.forward_fill(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.when(F.col("value") > 100, F.col("event_type")), "section")
    return rows.select("event_id", "user_id", "section")


@query("asof_marker", "WITH m AS (SELECT user_id, ts, max(event_id) AS marker FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, m.marker FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    marks = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("marker"))
    return N.as_of_join(rows.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), marks, ["user_id"], "ts", ["marker"]).select("event_id", "marker")


@query("position_sample", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r = 0 OR r = n // 2 OR r = n - 1")
def _(spark, sf_dir):
    return N.position_sample(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn")


@query("head_sample", "SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 1000) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id")
def _(spark, sf_dir):
    return N.head_text(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("dense_sequence", "SELECT o_custkey, o_orderkey, coalesce(top, -1) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') LEFT JOIN (SELECT o_custkey, count(*) - 1 AS top FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) USING (o_custkey)")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    known = orders.where("o_orderstatus <> 'O'").groupBy("o_custkey").agg((F.count("*") - 1).alias("seq"))
    return N.numbered_on(orders.where("o_orderstatus = 'O'").drop("o_orderstatus"), known, "o_custkey", ["o_orderkey"])


@query("lru_budget", "SELECT doc_id, running::BIGINT AS running, running <= 500000 AS kept FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM documents)")
def _(spark, sf_dir):
    return N.within_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("doc_id").alias("used")), "n_chars", "used", "doc_id", 500_000).select("doc_id", "running", "kept")


@query("author_catalog", """WITH authors AS (SELECT s_suppkey AS author FROM supplier), books AS (SELECT p_partkey AS book_id, p_partkey % (SELECT count(*) FROM supplier) + 1 AS author FROM part),
w AS (SELECT l_partkey AS book_id, l_suppkey AS author, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT a.author, (SELECT count(*) FROM books b WHERE b.author = a.author) AS direct, (SELECT count(*) FROM w WHERE w.author = a.author AND NOT EXISTS (SELECT 1 FROM books b WHERE b.book_id = w.book_id AND b.author = w.author)) AS collected,
  coalesce((SELECT sum(n) FROM w WHERE w.author = a.author), 0)::BIGINT AS chunks FROM authors a""")
def _(spark, sf_dir):
    authors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author"))
    n = authors.count()
    books = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), (F.col("p_partkey") % n + 1).alias("author"))
    written = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("author"), F.lit(1).alias("n"))
    return C.author_catalog(authors, books, written)


@query("books_without_chunks", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def _(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@query("exists_or_status", "SELECT o_orderkey FROM orders o WHERE o_orderstatus IN ('P') OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def _(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf_dir, "lineitem")
    hit = lines.where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey").distinct().withColumn("hit", F.lit(True))
    return orders.join(hit, orders.o_orderkey == hit.l_orderkey, "left").where("o_orderstatus = 'P' or hit").select("o_orderkey")


@query("chunked_authors", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def _(spark, sf_dir):
    """JN2: authors that have a chunk, as a semi-join."""
    supplier, lines = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").where("l_quantity >= 50")
    return supplier.join(lines, supplier.s_suppkey == lines.l_suppkey, "left_semi").select("s_suppkey", "s_name")


@query("book_counts", "SELECT p_partkey, count(l_orderkey) AS n_chunks, coalesce(sum(l_quantity), 0) AS size FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def _(spark, sf_dir):
    """JN9, AG1: counts of a book's chunks, zero where it has none; lines are counted before the join."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return table(spark, sf_dir, "part").select("p_partkey").join(counts, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("q", F.lit(0.0)).alias("size"))


@query("reconcile_status", """WITH r AS (SELECT doc_id % 100 AS k, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT doc_id % 100 AS k, count(*) AS n FROM documents WHERE lang <> 'es' OR n_chars > 1000 GROUP BY 1), v AS (SELECT vec_id % 110 AS k, count(*) AS n FROM embeddings GROUP BY 1)
SELECT k, coalesce(r.n, 0) AS n_rows, coalesce(t.n, 0) AS n_text, coalesce(v.n, 0) AS n_vectors,
  CASE WHEN coalesce(r.n, 0) = 0 THEN 'no_chunks' WHEN coalesce(t.n, 0) < r.n THEN 'text_incomplete' WHEN coalesce(v.n, 0) < r.n THEN 'vectors_incomplete' WHEN t.n > r.n OR v.n > r.n THEN 'surplus' ELSE 'done' END AS status
FROM r FULL JOIN t USING (k) FULL JOIN v USING (k)""")
def _(spark, sf_dir):
    docs, k = table(spark, sf_dir, "documents"), (F.col("doc_id") % 100).alias("k")
    return D.reconciled(docs.select(k), docs.where("lang <> 'es' or n_chars > 1000").select(k), table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 110).alias("k")), "k")


@query("inventory_rollup", "SELECT p_type, p_brand, count(*) AS n, sum(p_size)::BIGINT AS total, GROUPING_ID(p_type, p_brand)::INT AS level FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), ())")
def _(spark, sf_dir):
    return D.rollup_counts(table(spark, sf_dir, "part"), ["p_type", "p_brand"], "p_size")


@query("author_works_rollup", "SELECT p_brand, p_type, count(*) AS books, GROUPING_ID(p_brand, p_type)::INT AS level FROM part GROUP BY ROLLUP (p_brand, p_type)")
def _(spark, sf_dir):
    return C.author_works(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("monthly_verdicts", "WITH m AS (SELECT date_trunc('month', max(ts)) AS start FROM events), c AS (SELECT coalesce(nullif(event_type, ''), 'unknown') AS label, count(*) AS n FROM events, m WHERE ts >= start GROUP BY 1) SELECT label, n, round(100.0 * n / sum(n) OVER (), 4) AS percent FROM c")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", "event_type")
    start = rows.agg(F.date_trunc("month", F.max("ts")).cast("timestamp_ntz").alias("start"))
    return D.histogram(rows.crossJoin(F.broadcast(start)).where("ts >= start"), F.col("event_type"), "unknown")


@query("institution_report", "WITH c AS (SELECT r_name, o_orderstatus AS label, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY r_name), 4) AS percent FROM c")
def _(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    members = t("customer").join(F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return D.histogram(t("orders").join(members, F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderstatus"), "none", ["r_name"])


@query("library_search", f"SELECT p_partkey, p_name FROM part WHERE contains({FOLD.format('''concat_ws(' ', p_name, p_brand, p_type)''')}, 'widget')")
def _(spark, sf_dir):
    return C.library(table(spark, sf_dir, "part"), "WÍDGET", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("publisher_tabs", "SELECT source AS key, min_by(source, doc_id) AS label, count(*) AS n, source IN ('src3', 'src0') AS pinned FROM documents GROUP BY source")
def _(spark, sf_dir):
    return C.publisher_tabs(table(spark, sf_dir, "documents"), F.col("source"), "doc_id", ["src3", "src0"])


@query("publisher_works", "SELECT source, lang, count(*) AS books, sum(n_chars)::BIGINT AS chunks, (sum(count(*)) OVER (PARTITION BY source))::BIGINT AS all_books, (sum(sum(n_chars)) OVER (PARTITION BY source))::BIGINT AS all_chunks FROM documents GROUP BY source, lang")
def _(spark, sf_dir):
    return C.publisher_works(table(spark, sf_dir, "documents"), "source", "lang", "n_chars")


@query("century_groups", "SELECT ceil(abs(y) / 100.0)::INT AS century, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE year(o_orderdate) - (o_orderkey % 2000) END AS y FROM orders) GROUP BY 1")
def _(spark, sf_dir):
    year = F.when(F.col("o_orderkey") % 10 != 0, F.year("o_orderdate") - F.col("o_orderkey") % 2000)
    return C.by_century(table(spark, sf_dir, "orders").select(year.alias("y")), F.col("y"))


@query("council_groups", "SELECT o_orderpriority AS council, min(nullif(y, 0)) AS year, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE year(o_orderdate) END AS y FROM orders) GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("council"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.year("o_orderdate")).alias("y"))
    return C.councils(rows, "council", F.col("y"))


@query("multi_label_tabs", "WITH t AS (SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'a') THEN 'a' END AS x, CASE WHEN regexp_matches(lower(p_name), 're|st') THEN 'b' END AS y FROM part) SELECT p_partkey, unnest(CASE WHEN x IS NULL AND y IS NULL THEN ['others'] ELSE list_filter([x, y], lambda z: z IS NOT NULL) END) AS tab FROM t")
def _(spark, sf_dir):
    return D.multi_label(table(spark, sf_dir, "part"), F.lower("p_name"), {"a": "a", "b": "re|st"}).select("p_partkey", "tab")


@query("alias_containment", "SELECT DISTINCT n_name AS saint, p_partkey AS book_id FROM nation JOIN part ON contains(lower(p_name), substr('abcdefghijklmnopqrstuvwxy', n_nationkey + 1, 1))")
def _(spark, sf_dir):
    saints = table(spark, sf_dir, "nation").select(F.col("n_name").alias("saint"), F.expr("substring('abcdefghijklmnopqrstuvwxy', n_nationkey + 1, 1)").alias("alias"))
    return C.alias_books(saints, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("text")))


@query("dedupe_keys", r"WITH k AS (SELECT page_id, regexp_replace(lower(url), '^[a-z]+://(www\.|m\.|blog\.)?|[?#].*$|/$', '', 'g') AS key FROM pages) SELECT key, count(*) AS n, min(page_id) AS first FROM k GROUP BY key")
def _(spark, sf_dir):
    key = F.regexp_replace(F.lower("url"), r"^[a-z]+://(www\.|m\.|blog\.)?|[?#].*$|/$", "")
    return table(spark, sf_dir, "pages").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("url_language", r"SELECT page_id, coalesce(nullif(regexp_extract(p, '/([a-z]{2})/', 1), ''), nullif(regexp_extract(p, '[_-]([a-z]{2})\.[a-z]+$', 1), '')) AS language FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", L.url_language(F.col("url")).alias("language"))


@query("link_extract", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS place FROM pages), m AS (SELECT page_id, href, min(place) AS place FROM l GROUP BY ALL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS position, href FROM m""")
def _(spark, sf_dir):
    return H.links(table(spark, sf_dir, "pages"), "page_id")


@query("html_tags_stripped", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*(</[^s][^<]*)*</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def _(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"<(script|style)[^>]*>[^<]*(</[^s][^<]*)*</(script|style)>", " "), r"<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))


LATIN_SQL = "[" + ", ".join(f"'{w}'" for w in L.LATIN) + "]"


@query("lang_script", rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' +'), lambda x: length(x) > 1) AS w, length(regexp_replace(left(text, 300), '[^\x{{0370}}-\x{{03D6}}\x{{1F00}}-\x{{1FFF}}]', '', 'g')) AS greek FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: list_contains({LATIN_SQL}, x)))::INT AS hits, len(w)::INT AS words, greek::INT AS greek FROM w""")
def _(spark, sf_dir):
    hits = L.latin_hits(F.col("text"))
    greek = F.length(F.regexp_replace(F.substring("text", 1, 300), rf"[^{L.SCRIPTS['grc']}]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", hits["hits"].alias("hits"), hits["words"].alias("words"), greek.alias("greek"))


PROFILE_SQL = ", ".join(f"{{'n': len(list_filter(w, lambda x: list_contains({list(p)!r}, x))), 'o': {-i}, 'c': '{c}'}}" for i, (c, p) in enumerate(L.PROFILES.items()))


@query("lang_profile", rf"WITH w AS (SELECT doc_id, lang, string_split_regex(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), ' +') AS w FROM documents), b AS (SELECT doc_id, lang, list_max([{PROFILE_SQL}]) AS b FROM w) SELECT doc_id, lang, CASE WHEN b.n > 0 THEN b.c END AS detected FROM b")
def _(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", L.profile_of(F.col("text")).alias("detected"))


@query("book_classes", """SELECT doc_id, CASE WHEN c IN ('CONC', 'MAG', 'DZ') THEN 'documentos' ELSE 'patristica' END AS section, CASE WHEN c NOT IN ('CONC', 'MAG', 'DZ') THEN CASE WHEN lang IN ('en', 'fr', 'de', 'es') AND doc_id % 3 <> 0 OR doc_id % 2 = 1 THEN 'portuguesa' WHEN c = 'PG' THEN 'grega' WHEN c = 'PO' THEN 'oriental' ELSE 'latina' END END AS tradition,
  CASE c WHEN 'CONC' THEN 'concilio' WHEN 'MAG' THEN 'outro' WHEN 'DZ' THEN 'outro' END AS document_type FROM (SELECT doc_id, lang, ['PG', 'PL', 'PO', 'CONC', 'MAG', 'DZ', 'SC'][doc_id % 7 + 1] AS c FROM documents)""")
def _(spark, sf_dir):
    group = F.get(E.constants(["PG", "PL", "PO", "CONC", "MAG", "DZ", "SC"]), (F.col("doc_id") % 7).cast("int"))
    label = F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("Latin")
    return table(spark, sf_dir, "documents").select("doc_id", L.classify_book(group, label, F.col("doc_id") % 2 == 0).alias("c")).select("doc_id", "c.*")


@query("accuracy_metrics", f"""WITH v AS ({ORACLES["verify_reference"]}), {EXACT}, r AS (SELECT label = 'Confirmada (exata)' AS pos, label = 'Atribuição duvidosa' AS unsure, coalesce(risk = 'low', false) AS context, claim_id IN (SELECT item_id FROM x1) AS genuine FROM v)
SELECT count(*) AS n, round(count(*) FILTER (genuine AND pos) / count(*) FILTER (genuine), 6) AS top1, round(count(*) FILTER (genuine AND (pos OR unsure)) / count(*) FILTER (genuine), 6) AS top3,
  round(count(*) FILTER (NOT genuine AND pos) / count(*) FILTER (NOT genuine), 6) AS false_positive, round(count(*) FILTER (NOT genuine AND unsure) / count(*) FILTER (NOT genuine), 6) AS uncertain,
  round(count(*) FILTER (pos AND context) / nullif(count(*) FILTER (pos), 0), 6) AS context_rate FROM r""")
def _(spark, sf_dir):
    """AG20: verdicts without string similarity, held against whether a document contains the item at all, and how many of the
    positive ones their neighbours don't put in doubt."""
    docs = table(spark, sf_dir, "documents")
    found = verify(_claims(spark, sf_dir), chunks(spread(docs.select("doc_id", "text"))), docs.select("doc_id", F.col("source").alias("author")), similarity=False)
    folded = lambda name: spread(table(spark, sf_dir, name)).withColumn("f", T.fold(F.col("text")))
    held = R.containing(folded("benchmark").withColumnRenamed("f", "q"), folded("documents").select("doc_id", "f"), "item_id", ["doc_id"], "q", "f").select(F.col("item_id").alias("claim_id")).distinct().withColumn("genuine", F.lit(True))
    rows = found.select("claim_id", "code", F.coalesce(F.col("reference.risk") == "low", F.lit(False)).alias("context")).join(held, "claim_id", "left")
    return D.accuracy(rows, F.coalesce("genuine", F.lit(False)), F.col("code"), ["CONFIRMADA_EXATA"], ["ATRIBUICAO_DUVIDOSA"], F.col("context"))


@query("history_page", "SELECT event_id, user_id, event_type, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return D.page(rows, [F.col("ts").desc(), F.col("event_id").desc()], 100, 50).select("event_id", "user_id", "event_type", "total")


@query("json_props", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("normal_forms", r"SELECT doc_id, regexp_replace(regexp_replace(" + FOLD.format("h") + r", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(lower(strip_accents(h)), '[^\p{L}\p{N}]+', ' ', 'g')) AS letters, sha256(h) AS digest FROM (SELECT doc_id, text AS h FROM documents)")
def _(spark, sf_dir):
    head = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.slug(head).alias("slug"), T.letters_only(head).alias("letters"), F.sha2(head, 256).alias("digest"))


@query("url_numbers", r"SELECT page_id, nullif(regexp_extract(url, '/([0-9]{2,4})', 1), '') AS number, CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'plain' END AS scheme FROM pages")
def _(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", M.extract(url, r"/([0-9]{2,4})").alias("number"), F.when(url.startswith("https"), "secure").otherwise("plain").alias("scheme"))


@query("labels_in_order", "SELECT source, list(lang ORDER BY o) AS labels FROM (SELECT source, lang, min(doc_id) AS o FROM documents GROUP BY ALL) GROUP BY source")
def _(spark, sf_dir):
    return C.labels_in_order(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("language_coverage", "SELECT position::INT AS position, value, (SELECT count(*) FROM documents WHERE lang = value) AS n FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS position, unnest(['la', 'pt', 'en', 'fr', 'de', 'es']) AS value)")
def _(spark, sf_dir):
    return C.coverage(table(spark, sf_dir, "documents"), ["la", "pt", "en", "fr", "de", "es"], "lang")


@query("files_language", "SELECT source, list_sort(list(DISTINCT lang)) AS languages, CASE WHEN count(DISTINCT lang) > 1 THEN 'multi' ELSE min(lang) END AS language FROM documents GROUP BY source")
def _(spark, sf_dir):
    return D.languages_rollup(table(spark, sf_dir, "documents"), "source", "lang")


@query("upsert_books", "SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, coalesce(n.p_name, o.p_name) AS p_name, coalesce(n.p_size, o.p_size) AS p_size FROM (SELECT * FROM part WHERE p_size > 15) o FULL JOIN (SELECT p_partkey, CASE WHEN p_size < 25 THEN upper(p_name) END AS p_name, p_size + 1 AS p_size FROM part WHERE p_retailprice > 1000) n ON n.p_partkey = o.p_partkey")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    new = part.where("p_retailprice > 1000").select("p_partkey", F.when(F.col("p_size") < 25, F.upper("p_name")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return D.upsert(part.where("p_size > 15").drop("p_retailprice"), new, ["p_partkey"])


@query("delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return D.delete_cascade(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F", {"lines": (lines, "l_orderkey")})[1]["lines"]


@query("latest_versions", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return D.latest(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query("token_sets", r"SELECT item_id, len(list_intersect(a, b))::INT AS both, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS a, list_distinct(regexp_extract_all(lower(lead(text) OVER (ORDER BY item_id)), '[\p{L}\p{N}_]{4,}')) AS b FROM benchmark) WHERE b IS NOT NULL")
def _(spark, sf_dir):
    """ST2, ST3 on neighbouring items."""
    items = table(spark, sf_dir, "benchmark")
    pairs = items.select("item_id", "text").join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next")), "item_id")
    a, b = F.array_distinct(E.tokens(F.col("text"), 4)), F.array_distinct(E.tokens(F.col("next"), 4))
    return pairs.select("item_id", F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_except(a, b)).alias("only"))


@query("date_parts", "SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, [strftime(ts + INTERVAL 0 DAY, '%m-%d'), strftime(ts + INTERVAL 1 DAY, '%m-%d'), strftime(ts + INTERVAL 2 DAY, '%m-%d')] AS coming FROM events")
def _(spark, sf_dir):
    at = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", T2.month_label(at).alias("month"), T2.day_key(at).alias("day"), T2.iso(at).alias("iso"), T2.next_days(at, 3).alias("coming"))


ROMAN_SQL = "[" + ", ".join(repr(x) for x in "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI".split()) + "]"


@query("century_labels", f"SELECT o_orderkey, {ROMAN_SQL}[ceil(y / 100.0)::INT] AS century FROM (SELECT o_orderkey, year(o_orderdate) - (o_orderkey % 1900) AS y FROM orders)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", M.century_label(F.year("o_orderdate") - F.col("o_orderkey") % 1900).alias("century"))


@query("intrusion_scores", r"""WITH q AS (SELECT conv_id, turn, lower(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{5,}') AS w FROM conversations)
SELECT conv_id, turn, round(least(1.0, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(['hello', 'please', 'thanks', 'about'], x))) / len(w) + 0.25 * contains(t, 'of the')::INT ELSE 0.4 * contains(t, 'of the')::INT END), 6) AS score FROM q""")
def _(spark, sf_dir):
    """SC20 with a lexicon that occurs in the tables."""
    score = E.intrusion(F.col("text"), ("hello", "please", "thanks", "about"), ("of the",))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(score, 6).alias("score"))


@query("fixed_windows", r"SELECT doc_id, chunk, len(w)::INT AS n FROM (SELECT doc_id, 0 AS chunk, list_transform(generate_series(0, greatest(length(text) - 40, 0), 10), lambda s: substr(text, s + 1, 40)) AS w FROM documents)")
def _(spark, sf_dir):
    """W9: character windows of 40, stepping a quarter."""
    from ibidem.operators.chunk import character_windows

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.lit(0).alias("chunk"), F.size(character_windows(F.col("text"), F.lit(40))).alias("n"))


@query("tier_gating", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 >= 2 THEN o_totalprice END AS price, o_orderkey % 4 + 1 AS rank FROM orders")
def _(spark, sf_dir):
    plan = F.get(E.constants(["free", "basic", "pro", "institution"]), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", M.gated(F.col("o_totalprice"), plan, 3).alias("price"), M.plan_rank(plan).cast("long").alias("rank"))


@query("insert_absent", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey + 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_acctbal > 0 AND o.c_custkey = customer.c_custkey + 1)")
def _(spark, sf_dir):
    held = table(spark, sf_dir, "customer")
    return D.insert_absent(held.where("c_acctbal > 0").select("c_custkey"), held.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1).alias("c_custkey")), ["c_custkey"])[0]


@query("path_outcomes", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_size > 40 THEN 'missing' WHEN p_size > 20 THEN 'ok' ELSE 'fixed' END AS outcome FROM part) GROUP BY 1")
def _(spark, sf_dir):
    """SNK15: paths of which some have moved and some are gone."""
    part, name = table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf"))
    files = part.select(F.concat(F.lit("a/"), name).alias("path"))
    listing = part.where("p_size <= 40").select(F.concat(F.when(F.col("p_size") > 20, "a/").otherwise("b/"), name).alias("path"))
    return D.path_outcomes(files, listing).groupBy("outcome").agg(F.count("*").alias("n"))


@query("known_names", "SELECT s_suppkey, lower(s_name) IN (SELECT lower(replace(c_name, 'Customer', 'Supplier')) FROM customer WHERE c_acctbal > 0) AS known FROM supplier")
def _(spark, sf_dir):
    """JN21: names flagged that are known under a normal form."""
    t = lambda n: table(spark, sf_dir, n)
    known = t("customer").where("c_acctbal > 0").select(T.fold(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("k")).distinct().withColumn("known", F.lit(True))
    return t("supplier").join(known, T.fold(F.col("s_name")) == F.col("k"), "left").select("s_suppkey", F.coalesce("known", F.lit(False)).alias("known"))


@query("expected_inventory", "WITH e AS (SELECT unnest(['en', 'fr', 'la', 'pt']) AS lang) SELECT lang, coalesce((SELECT count(*) FROM documents d WHERE d.lang = e.lang), 0) AS n, CASE WHEN (SELECT count(*) FROM documents d WHERE d.lang = e.lang) > 0 THEN 'done' ELSE 'not_imported' END AS status FROM e")
def _(spark, sf_dir):
    """JN22, JN23: what should be there, with what is."""
    there = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.lit("done").alias("status"))
    return C.expected_rows(spark, [("en",), ("fr",), ("la",), ("pt",)], "lang string", there, "lang").select("lang", F.coalesce("n", F.lit(0)).alias("n"), "status")


@query("editions", "SELECT source, list_sort(list(DISTINCT lang)) AS editions, count(*) AS files, CASE WHEN count(DISTINCT lang) > 1 THEN ['several editions'] ELSE [] END AS risks FROM documents GROUP BY source")
def _(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("volume"), F.col("doc_id").cast("string").alias("file"), F.col("lang").alias("edition"))
    return C.editions(files, "source").select("source", "editions", F.size("files").cast("long").alias("files"), "risks")


@query("corrected_names", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'Three' WHEN 4 THEN 'Four' ELSE n_name END AS n_name FROM nation")
def _(spark, sf_dir):
    fixes = spark.createDataFrame([(3, "Three"), (4, "Four")], "n_nationkey int, n_name string")
    return D.corrected(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), fixes, "n_nationkey", "n_name")


@query("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def _(spark, sf_dir):
    return D.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 25)


@query("pope_kinds", "SELECT source AS pope, max(y)::INT AS year, count(*) AS n, count(DISTINCT lang) AS kinds FROM (SELECT source, lang, 1800 + doc_id % 200 AS y FROM documents) GROUP BY source")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("pope"), "lang", (1800 + F.col("doc_id") % 200).cast("int").alias("y"))
    return C.popes(rows, "pope", "lang", F.col("y"), "src0").select("pope", "year", "n", F.size("kinds").cast("long").alias("kinds"))
