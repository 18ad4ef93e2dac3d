"""The library in SQL: functions that Catalyst inlines, and a table function for the paragraphs of a page.

After register(spark), `SELECT verdict_code(...)`, `combined_score(text, semantic)`, `lexical_overlap(quote, text)` and
`FROM pages, LATERAL page_paragraphs(html)` work in any SQL of the session. The scalar functions are SQL themselves, so they're
planned with the query around them and run in generated code.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ibidem.functions import evidence as E
from ibidem.operators.shared import ship
from ibidem.sources.files import table
from ibidem.sources.html import paragraph_texts

from .queries import GRID_SQL
from .registry import query
from .text_queries import PARAGRAPHS_SQL

FUNCTIONS = {
    "verdict_code": (
        "combined DOUBLE, exact BOOLEAN, same_author BOOLEAN, fidelity STRING, anchor DOUBLE, intrusion DOUBLE, similarity DOUBLE",
        f"""CASE WHEN intrusion > 0 AND NOT exact THEN 'NAO_ENCONTRADA'
          WHEN exact THEN IF(same_author, 'CONFIRMADA_EXATA', 'ATRIBUICAO_DUVIDOSA')
          WHEN combined >= {E.COMBINED_LEAST} AND anchor >= {E.ANCHOR_LEAST} AND fidelity = 'fiel' THEN IF(same_author, 'TRADUCAO_FIEL', 'ATRIBUICAO_DUVIDOSA')
          WHEN combined >= {E.COMBINED_LEAST} AND anchor >= {E.ANCHOR_LEAST} AND fidelity = 'imprecisa' THEN 'TRADUCAO_IMPRECISA'
          WHEN same_author AND combined >= {E.PARAPHRASE_COMBINED} AND anchor >= {E.PARAPHRASE_ANCHOR} AND similarity >= {E.PARAPHRASE_SIMILARITY} THEN 'PARAFRASE_PLAUSIVEL'
          ELSE 'NAO_ENCONTRADA' END""",
    ),
    "combined_score": ("text_score DOUBLE, semantic_score DOUBLE", "CASE WHEN coalesce(text_score, 0) = 0 THEN 0.9D * least(coalesce(semantic_score, 0), 1) ELSE 0.65D * least(text_score, 1) + 0.35D * least(coalesce(semantic_score, 0), 1) END"),
    "lexical_overlap": (
        "quote STRING, passage STRING",
        r"""(SELECT IF(size(q) = 0, 0D, size(array_intersect(q, p)) / size(q)) FROM (SELECT
          array_distinct(regexp_extract_all(lower(quote), r'([\p{L}\p{N}_]{4,})', 1)) AS q, array_distinct(regexp_extract_all(lower(passage), r'([\p{L}\p{N}_]{4,})', 1)) AS p))""",
    ),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    from pyspark.sql.functions import udtf

    ship(spark)
    for name, (parameters, body) in FUNCTIONS.items():
        returned = "STRING" if name == "verdict_code" else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returned} RETURN {body}")

    class PageParagraphs:
        """SRC9 as a table function: position and text of a page's paragraphs."""

        def eval(self, html: str):
            yield from enumerate(paragraph_texts(html))

    spark.udtf.register("page_paragraphs", udtf(PageParagraphs, returnType="position int, text string"))


@query("sql_verdicts", GRID_SQL + " SELECT code, count(*) AS n, round(sum(combined), 4) AS combined FROM v GROUP BY code")
def _(spark, sf_dir):
    """SC36 in SQL."""
    register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("ibidem_lines")
    return spark.sql("""SELECT code, count(*) AS n, round(sum(combined), 4) AS combined FROM (
      SELECT (l_partkey % 101) / 100D AS combined, verdict_code((l_partkey % 101) / 100D, l_returnflag = 'R' AND l_linenumber = 1, l_linestatus = 'F',
        CASE WHEN l_quantity > 40 THEN 'fiel' WHEN l_quantity > 30 THEN 'imprecisa' WHEN l_quantity > 20 THEN 'nao_encontrada' END,
        l_discount * 10, CASE WHEN l_tax > 0.07 THEN l_tax * 5 WHEN l_tax > 0.06 THEN 0.1D ELSE 0D END, (l_suppkey % 100) / 100D) AS code FROM ibidem_lines) GROUP BY code""")


@query("sql_overlaps", r"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS q, list_distinct(regexp_extract_all(lower(before), '[\p{L}\p{N}_]{4,}')) AS b FROM p WHERE before IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q) END, 6) AS overlap FROM t""")
def _(spark, sf_dir):
    """SC22 in SQL: how much of a turn's words the turn before has."""
    register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("ibidem_turns")
    return spark.sql("""SELECT conv_id, turn, round(lexical_overlap(text, before), 6) AS overlap
      FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM ibidem_turns) WHERE before IS NOT NULL""")


@query("sql_paragraphs", PARAGRAPHS_SQL)
def _(spark, sf_dir):
    """SRC9 in SQL, by a lateral join."""
    register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("ibidem_pages")
    return spark.sql("SELECT page_id, p.position, p.text FROM ibidem_pages, LATERAL page_paragraphs(html) p")


@query("sql_fusion", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0.9::DOUBLE * least(l_tax * 20, 1) ELSE 0.65::DOUBLE * least(l_discount * 12, 1) + 0.35::DOUBLE * least(l_tax * 20, 1) END, 6) AS score FROM lineitem")
def _(spark, sf_dir):
    """SC33 in SQL."""
    register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("ibidem_lines")
    return spark.sql("SELECT l_orderkey, l_linenumber, round(combined_score(l_discount * 12, l_tax * 20), 6) AS score FROM ibidem_lines")
