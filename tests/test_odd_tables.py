"""Named queries against their SQL on small tables with odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from test_queries import plain


def sides(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    frame = entry.queries()[name](spark, str(folder))
    columns = sorted(frame.columns)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    own = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    return own, sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_editions_of_volume_9999(spark, tmp_path):
    own, told = sides(spark, tmp_path, "editions", documents=([(9999, "a", "en", "s", 1), (7, "b", "en", "s", 1)], DOCUMENTS))
    assert own == told and len(own) == 1


@pytest.mark.parametrize("name", ["html_paragraphs", "sql_paragraphs"])
def test_paragraphs_with_cut_references(spark, tmp_path, name):
    page = "<h1>one &amp; two&amp</h1><p>a &quot;b&quot; &amp;lt; &am</p><p>&copy; c&lt</p><p>&copy;&nbsp;d &amp"
    own, told = sides(spark, tmp_path, name, pages=([(1, "u", page)], "page_id long, url string, html string"))
    assert own == told and len(own) == 4


def test_years_at_line_ends(spark, tmp_path):
    texts = ["+1 (758) 555-1449\nIn 1500 it", "1897\n", "in 1897", "é1449 1450é", "a\t1449", "1449 2001", None]
    own, told = sides(spark, tmp_path, "years_in_text", documents=([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS))
    assert own == told and len(own) == len(texts)


def test_volumes_at_line_ends(spark, tmp_path):
    texts = ["vol. 12\nof", "vol. 12 of", "Tome 7é", "t\n4 vol 5"]
    own, told = sides(spark, tmp_path, "text_rules", documents=([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS))
    assert own == told and len(own) == len(texts)


def test_hashed_vectors_of_odd_texts(spark, tmp_path, monkeypatch):
    """Repeated and missing keys, empty texts, texts without words and signs beyond the basic plane, cut some signs at a time."""
    from ibidem.operators import hashed_vectors as H

    monkeypatch.setattr(H, "SIGNS", 40)
    texts = ["The quick brown fox", "the quick, brown fox!", "brown foxes", "", None, "...", "a", "𝒜𝒷 quick\nfox", "über den quick", "the the the fox", "fox\tquick é"]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(2, "quick birds", "en", "s", 1), (2, None, "en", "s", 1), (None, "quick fox", "en", "s", 1)]
    items = [(0, "quick fox"), (1, "the brown"), (2, "zebra"), (3, ""), (4, "𝒜𝒷")]
    own, told = sides(spark, tmp_path, "hashed_vectors_top5", documents=(docs, DOCUMENTS), benchmark=(items, "item_id long, text string"))
    assert own == told and any(r[0] is None for r in own)


def test_languages_of_odd_texts(spark, tmp_path):
    texts = ["the of and", "Est non sed qui quod cum. per_ad ut", "λόγος εἰμί", "que e o", "le la 3les des", "", None, "...", " the ", "é est", "αβ the", "le le the the", "THE_of of2the"]
    docs = [(i, t, "en" if i % 2 else "es", "s", 1) for i, t in enumerate(texts)]
    own, told = sides(spark, tmp_path, "language_certainty", documents=(docs, DOCUMENTS))
    assert own == told and len(own) == len(texts)


def test_rules_of_odd_texts(spark, tmp_path):
    texts = ["Encyclical", "encíclica", "BULL bula", "bulb", "a letter", "letters", "concílio I", "concilio", "Paulus", "paulusx", "Editora  Loyola", "edicoes loyola é", "fato registro contato", "fato fatos registro, contatos", "vol. 012", "tomo 3", "t.7 vol 4", "xt 5", "são josé", "santo tomás", "santo agostinho", "ave  maria", "Santa  Rita", "a\t b\n\n c", "\x1fécruz", None, ""]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    for name in ("text_rules", "normalize_text"):
        own, told = sides(spark, tmp_path, name, documents=(docs, DOCUMENTS))
        assert own == told and len(own) == len(texts)


@pytest.mark.parametrize("quoted", [0, 1_000_000])
def test_quotes_of_odd_texts(spark, tmp_path, monkeypatch, quoted):
    """By an automaton of whole quotations, and by hashes of runs beside short quotations in blocks."""
    from ibidem.operators import retrieval as R

    monkeypatch.setattr(R, "QUOTED", quoted)
    texts = ["one two three four five six seven", "ONE  two\nthree four five six seven eight", "Öne two", "two", None, "𝒜 two three four five six 𝒷", "xone two three four five six sevenx"]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, "two", "en", "s", 1), (None, "one two", "en", "s", 1)]
    items = [(0, "one two three four five six seven"), (1, "two"), (2, "one two"), (3, "two"), (4, None), (5, "𝒜 two three four five six 𝒷"), (6, "nine")]
    own, told = sides(spark, tmp_path, "exact_quote_hits", documents=(docs, DOCUMENTS), benchmark=(items, "item_id long, text string"))
    assert own == told and len(own) > 20


def test_names_without_texts(spark):
    """The rows of names don't carry texts: 500 names a text of 100 000 signs are more than an array of strings holds."""
    from ibidem.operators import lexicon_match as L

    text = " ".join(f"n{i}" for i in range(500)).ljust(100_000)
    texts = spark.range(60).withColumn("t", F.lit(text)).coalesce(1)
    assert L.matches(texts, "t", [(f"n{i}", True, f"n{i}") for i in range(500)]).count() == 60 * 500


def test_author_catalog_by_bounded_groups(spark, tmp_path, monkeypatch):
    """Pairs of a book and an author are grouped in tasks of so many at most, whatever their number."""
    from ibidem.plans import catalog as C

    monkeypatch.setattr(C, "PAIRS", 10)
    suppliers, parts = [(i,) for i in range(1, 6)], [(i,) for i in range(1, 21)]
    lines = [(i * 7 % 20 + 1, i % 5 + 1) for i in range(90)] + [(None, 2), (3, None), (None, 2)]
    own, told = sides(spark, tmp_path, "author_catalog", supplier=(suppliers, "s_suppkey long"), part=(parts, "p_partkey long"), lineitem=(lines, "l_partkey long, l_suppkey long"))
    assert own == told and len(own) == 5
    rows = spark.createDataFrame([(i % 20, i % 3, 1) for i in range(95)], "book_id long, author long, n long")
    plan = C.author_catalog(rows.select("author"), rows.select("book_id", "author").limit(5), rows)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan
