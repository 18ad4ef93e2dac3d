"""Named queries of filters, joins, tallies and changes to tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ibidem.functions import evidence as E
from ibidem.functions import metadata as M
from ibidem.operators import neighbours as N
from ibidem.operators import tables as D
from ibidem.operators.chunk import chunks
from ibidem.operators.scan import numbered
from ibidem.sources import files as S
from ibidem.sources.files import spread, table

from . import catalog as C
from .ingest import vector_rows
from .registry import query


@query("part_filters", """SELECT p_partkey, p_name LIKE 'a%' AND p_name NOT ILIKE '%ET%' AS chosen, NOT (p_type LIKE '%A' OR p_type LIKE '%L') AS kept,
  contains(lower(p_name), 'widget') OR contains(lower(p_name), 'bolt') AS blocked, starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2') AS remote FROM part""")
def _(spark, sf_dir):
    """FLT6, FLT8, FLT10, FLT17."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", D.prefix_without(name, "a", "ET").alias("chosen"), D.not_suffixed(F.col("p_type"), ["A", "L"]).alias("kept"),
        D.blocked(name, ["Widget", "bolt"]).alias("blocked"), D.remote(F.col("p_brand"), ("Brand#1", "Brand#2")).alias("remote"),
    )


@query("selected_files", "SELECT url, length(html) AS size FROM pages WHERE regexp_matches(url, 'example') AND NOT regexp_matches(url, '/en/') AND length(html) <= 5000 AND url > 'https://b'")
def _(spark, sf_dir):
    """FLT9 without a limit."""
    files = table(spark, sf_dir, "pages").select("url", F.length("html").cast("long").alias("size"))
    return D.selected(files, "url", "size", "example", "/en/", 5000, "https://b")


@query("unfinished_orders", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderpriority FROM orders) WHERE status <> 'F' AND contains(lower(o_orderpriority), 'u')")
def _(spark, sf_dir):
    """FLT15: a status that is null is neither done nor unfinished."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_orderpriority")
    return D.unfinished(rows, "status", "F", name="o_orderpriority", search="U").select("o_orderkey")


@query("saint_works", r"""SELECT n_nationkey, r_name <> 'ASIA' AND n_nationkey % 4 <> 0 AND n_nationkey % 2 = 1 AS saint FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf_dir):
    """FLT14 on works made from nations."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    section = F.when(F.col("r_name") == "ASIA", "patristica").otherwise("outra")
    kind = F.when(F.col("n_nationkey") % 4 == 0, "concilio")
    author = F.concat(F.when(F.col("n_nationkey") % 2 == 1, "São ").otherwise("Dom "), "n_name")
    return rows.select("n_nationkey", C.saint_work(section, kind, author).alias("saint"))


@query("saint_search", "SELECT p_brand, count(*) AS n FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'et') GROUP BY 1")
def _(spark, sf_dir):
    """FLT18."""
    return C.search_groups(table(spark, sf_dir, "part"), "p_brand", ["p_name", "p_brand", "p_type"], "ÉT")


@query("missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf_dir):
    """JN10."""
    return D.missing_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("section_authors", """SELECT l_orderkey, l_linenumber, coalesce(o_orderpriority, l_returnflag) AS author, o_orderpriority IS NOT NULL AS changed
FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O') ON o_orderkey = l_orderkey""")
def _(spark, sf_dir):
    """JN16: lines take the priority of their order, if it is open, in place of their flag."""
    pages = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("author"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("author"))
    return D.tagged(lines, pages, ["l_orderkey"], "author")


@query("broken_groups", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)")
def _(spark, sf_dir):
    """JN24."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return D.among(lines, lines.where("l_quantity = 50"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("translation_audit", """WITH c AS (SELECT conv_id, count(*) AS n_chunks, count(*) FILTER (role = 'user') AS n_translated, count(*) FILTER (turn > 0) AS n_indexed FROM conversations GROUP BY 1)
SELECT conv_id, n_chunks, n_translated, n_indexed, greatest(n_chunks - n_translated, 0) AS lacking FROM c""")
def _(spark, sf_dir):
    """AG17: turns as chunks, those of users as translations, all but the first as indexed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return D.translation_audit(turns, turns.withColumn("language", F.col("role")), turns.where("turn > 0"), "conv_id", "user")


@query("best_pages", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_quantity) IN (SELECT l_orderkey, max(l_quantity) FROM lineitem GROUP BY 1) GROUP BY l_orderkey, l_quantity")
def _(spark, sf_dir):
    """AG22, AG23."""
    return D.best_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")


@query("title_groups", "SELECT title, first, n, row_number() OVER (ORDER BY first, title)::INT AS place FROM (SELECT coalesce(CASE WHEN p_size > 25 THEN p_type END, p_brand) AS title, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1)")
def _(spark, sf_dir):
    """AG24, AG27."""
    return D.numbered_groups(table(spark, sf_dir, "part"), F.coalesce(F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_brand")), "p_partkey")


@query("active_keys", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS active FROM orders")
def _(spark, sf_dir):
    """AG28."""
    return D.active(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked")), "revoked")


@query("volumes_in_order", "SELECT p_partkey, volume, row_number() OVER (ORDER BY volume NULLS LAST, p_partkey) AS place FROM (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size END AS volume FROM part) QUALIFY place <= 80")
def _(spark, sf_dir):
    """TK6, TK11: the first 80 of that order, with their places."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("volume"))
    first = D.preview(D.in_volumes(rows, "volume", "p_partkey"), [F.asc_nulls_last("volume"), "p_partkey"])
    return N.numbered_on(first.withColumn("all", F.lit(0)), first.limit(0).select(F.lit(0).alias("all"), F.lit(0).alias("place")), "all", [F.asc_nulls_last("volume"), "p_partkey"], "place").select("p_partkey", "volume", (F.col("place") + 1).alias("place"))


@query("ids_in_any", "SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings UNION SELECT page_id FROM pages")
def _(spark, sf_dir):
    """ST4."""
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("doc_id"))
    return D.ids_in_any("doc_id", t("documents", "doc_id"), t("embeddings", "vec_id"), t("pages", "page_id"))


@query("menu_choices", 'SELECT DISTINCT \'lang\' AS "column", lang AS value FROM documents WHERE lang <> \'\' UNION SELECT DISTINCT \'source\', source FROM documents WHERE source <> \'\'')
def _(spark, sf_dir):
    """ST5."""
    return D.choices(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("insert_rejected", "SELECT c_custkey + 1 AS c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM customer o WHERE o.c_acctbal > 0 AND o.c_custkey = customer.c_custkey + 1)")
def _(spark, sf_dir):
    """SNK6: the rows that an insert turns away."""
    held = table(spark, sf_dir, "customer")
    return D.insert_absent(held.where("c_acctbal > 0").select("c_custkey"), held.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1).alias("c_custkey")), ["c_custkey"])[1]


@query("delete_parents", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, sf_dir):
    """SNK5, SNK14: what is left of the parents."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return D.delete_cascade(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F", {"lines": (lines, "l_orderkey")})[0].select("o_orderkey")


@query("backfilled_names", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_size % 3 = 1 THEN p_brand ELSE p_name END AS name FROM part")
def _(spark, sf_dir):
    """SNK16: null and blank names are filled."""
    name = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).when(F.col("p_size") % 3 == 2, F.col("p_name"))
    return D.backfill(table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), "p_brand"), "name", F.col("p_brand")).select("p_partkey", "name")


@query("catalog_order", """WITH authors AS (SELECT s_suppkey AS author FROM supplier), w AS (SELECT l_suppkey AS author, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT author, row_number() OVER (ORDER BY coalesce(n, 0) = 0, coalesce(n, 0) DESC, author) AS place FROM authors LEFT JOIN w USING (author)""")
def _(spark, sf_dir):
    """TK7: places in the catalog's order."""
    authors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author"))
    books = table(spark, sf_dir, "part").limit(0).select(F.col("p_partkey").alias("book_id"), F.col("p_partkey").alias("author"))
    written = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("author")).agg(F.count("*").alias("n"))
    n = F.col("chunks")
    ordered = numbered(C.author_catalog(authors, books, written), [], [n == 0, -n, "author"], "place")
    return ordered.select("author", (F.col("place") + 1).alias("place"))


@query("council_order", """WITH g AS (SELECT o_orderpriority AS council, min(nullif(y, 0)) AS year, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE year(o_orderdate) END AS y FROM orders) GROUP BY 1)
SELECT council, year, n, row_number() OVER (ORDER BY coalesce(year, 9999), council) AS place FROM g""")
def _(spark, sf_dir):
    """AG9 with places: a council without a year comes last."""
    year = F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(F.year("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("council"), year.alias("y"))
    return numbered(C.councils(rows, "council", F.col("y")), [], [F.coalesce("year", F.lit(9999)), "council"], "place").withColumn("place", F.col("place") + 1)


@query("section_order", "SELECT p_partkey, coalesce(nullif(list_position(['ECONOMY', 'LARGE', 'SMALL'], split_part(p_type, ' ', 1)), 0), 99)::INT AS place FROM part")
def _(spark, sf_dir):
    """TK12."""
    kind = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ")[0].alias("kind"))
    return C.sections(kind, ["ECONOMY", "LARGE", "SMALL"], "kind").select("p_partkey", "place")


@query("vector_ids", "SELECT doc_id || '_0' AS id, doc_id, NULL AS language FROM documents JOIN embeddings ON vec_id = doc_id WHERE regexp_matches(text, '\\S') UNION ALL SELECT doc_id || '_0_translation_pt', doc_id, 'pt' FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'es' AND regexp_matches(text, '\\S')")
def _(spark, sf_dir):
    """SNK3, SNK4: the first chunk of documents that have a vector, and of Spanish ones a translation's."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    own = vectors.withColumn("chunk", F.lit(0))
    other = own.join(docs.where("lang = 'es'").select("doc_id"), "doc_id", "left_semi").withColumn("language", F.lit("pt"))
    return vector_rows(chunks(spread(docs.select("doc_id", "text"))), own, other).select("id", "doc_id", "language")


@query("index_documents", """WITH w AS (SELECT doc_id, source, lang, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, source, lang, (s / 400)::INT AS chunk, array_to_string(list_slice(w, s + 1, s + 500), ' ') AS text FROM (SELECT *, unnest(generate_series(0, len(w) - 1, 400)) AS s FROM w WHERE len(w) > 0))
SELECT doc_id || '_' || chunk AS id, doc_id, chunk, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS title, source || lang AS author, text, CASE WHEN chunk = 0 THEN lang END AS translation FROM c""")
def _(spark, sf_dir):
    """PRJ1, PRJ3."""
    docs = table(spark, sf_dir, "documents")
    books = docs.select("doc_id", F.col("source").alias("title"), F.when(F.col("lang") == "en", F.upper("source")).alias("canonical_title"), F.concat("source", "lang").alias("author"))
    other = docs.select("doc_id", F.lit(0).alias("chunk"), F.lit("pt").alias("language"), F.col("lang").alias("text"))
    return C.search_documents(chunks(spread(docs.select("doc_id", "text"))), books, other)


@query("readings", """WITH e AS (SELECT user_id, event_id, repeat(event_type, (event_id % 7 + 1)::INT) AS text FROM events),
f AS (SELECT user_id, min(event_id) AS o FROM e WHERE length(trim(text)) >= 40 GROUP BY 1), l AS (SELECT user_id, max((length(trim(text)), -event_id)) AS m FROM e GROUP BY 1)
SELECT e.user_id, e.text FROM e LEFT JOIN f USING (user_id) JOIN l USING (user_id) WHERE e.event_id = coalesce(f.o, -(l.m[2]))""")
def _(spark, sf_dir):
    """SRC6: of several readings the first that is long enough, else the longest."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("attempt"), F.expr("repeat(event_type, int(event_id % 7 + 1))").alias("text"))
    return S.best_attempt(rows, ["user_id"], enough=40)


@query("page_checks", r"""WITH p AS (SELECT page_id, string_split(html, '<p>') AS pages FROM pages)
SELECT page_id, len(list_filter(list_slice(pages, 1, 8), lambda x: length(trim(x)) > 50)) > 0 AS digital, len(pages) + greatest(12 - len(pages), 0) AS n_pages FROM p""")
def _(spark, sf_dir):
    """SRC3, SRC4: pages between paragraph tags, filled up to twelve."""
    pages = F.split("html", "<p>")
    return table(spark, sf_dir, "pages").select("page_id", S.is_digital(pages).alias("digital"), F.size(S.form_pages(F.regexp_replace("html", "<p>", "\f"), F.lit(12))).cast("long").alias("n_pages"))


@query("unread_pages", "SELECT page_id FROM pages WHERE sha1(html) NOT IN (SELECT sha1(html) FROM pages WHERE contains(url, '/en/'))")
def _(spark, sf_dir):
    """SRC5: pages that a content-addressed cache doesn't hold."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.sha1("html").alias("sha1"))
    return S.unread(rows, rows.where(F.col("url").contains("/en/")), "sha1").select("page_id")


@query("inventory_report", """SELECT '{' || '"lang":[' || (SELECT string_agg('{"name":"' || lang || '","n":' || n || ',"bytes":' || b || '}', ',' ORDER BY n DESC, lang) FROM (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS b FROM documents GROUP BY 1)) || ']}' AS report""")
def _(spark, sf_dir):
    """SNK9."""
    return S.report(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("assembled_titles", "SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN 'override' END, CASE WHEN p_size % 4 = 1 THEN p_brand END, CASE WHEN p_size % 4 = 2 THEN p_type END, p_name) AS title FROM part")
def _(spark, sf_dir):
    """SC59."""
    when = lambda k, value: F.when(F.col("p_size") % 4 == k, value)
    return table(spark, sf_dir, "part").select("p_partkey", M.assembled(F.col("p_name"), when(0, F.lit("override")), when(1, F.col("p_brand")), when(2, F.col("p_type"))).alias("title"))


@query("evidence_parts", "SELECT o_orderkey, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + 1 AS n, CASE WHEN o_totalprice / 500000 >= 0.3 THEN 'exact' WHEN o_totalprice / 500000 >= 0.1 THEN 'partial' ELSE 'semantic' END AS strategy FROM orders")
def _(spark, sf_dir):
    """AG26, SC32."""
    part = lambda k: F.when(F.col("o_orderkey") % k == 0, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.evidence_count(part(2), part(3), F.col("o_totalprice")).alias("n"), E.strategy(F.col("o_totalprice") / 500000).alias("strategy"))
