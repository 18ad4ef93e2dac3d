"""Functions against plain Python and small tables of cases."""

import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ibidem.functions import evidence as E
from ibidem.functions import language as L
from ibidem.functions import metadata as M
from ibidem.functions import text as T
from ibidem.operators import chunk as K


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def one(spark, value, f):
    return values(spark, [(value,)], "x string", f(F.col("x")))[0][0]


@pytest.mark.parametrize("text", ["", "  Água  e\tVINHO ", "é é Ωμέγα ἀρχή", "ÀÇñ\n\nß", "日本 x"])
def test_fold(spark, text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    assert one(spark, text, T.fold) == unicodedata.normalize("NFC", re.sub(r"\s+", " ", plain).strip().lower())


@pytest.mark.parametrize(("f", "text", "expected"), [
    (T.clean_ocr, "1Celebrem “a”  ‘b’ «c» 12x", "Celebrem \"a\" 'b' \"c\" 12x"),
    (T.author_core, "Santo Agostinho de Hipona", "agostinho hipona"),
    (T.slug, " Édition: Nova! ", "edition-nova"),
    (T.saint_form, "São João da Cruz", "joao da cruz"),
    (T.letters_only, "a—b's 2", "a b s 2"),
    (T.title_from_file, "x/De_Trinitate-vol-2.pdf", "De Trinitate vol 2"),
    (T.squeeze_lines, "a\r\n\r\n\r\n\r\nb  \nc\n", "a\n\nb\nc"),
    (T.fix_mojibake, "SÃ£o JoÃ£o", "São João"),
    (T.escape_markup, "a<b>&c", "a&lt;b&gt;&amp;c"),
    (T.decode_entities, "&lt;a&gt; &#233;&#xE9; &amp;lt; &mdash;", "<a> éé &lt; —"),
    (T.smart_title, "the history OF rome iv", "The History of Rome IV"),
    (T.path_part, "  a/b: c  ", "a b c"),
    (T.safe_file, "São João (1).pdf", "Sao_Joao_1_.pdf"),
    (E.quoted, 'Verify “one two” please', "one two"),
    (E.quoted, "Check: three four", "three four"),
    (E.attributed, 'frase atribuída a João: "x"', "João"),
    (L.code_of, "Latin e grego", "la+grc"),
    (L.code_of, "Português", "pt"),
    (L.script_of, "ἀρχή λόγος", "grc"),
    (L.script_of, "ab", None),
    (M.first_year, "in 1891 and 1931", 1891),
    (M.last_year, "in 1891 and 1931", 1931),
    (M.volume, "Opera vol. 03", 3),
    (M.pope, "Carta de Leão XIII", "Leo XIII"),
    (M.publisher, "Paulus, São Paulo", "Paulus"),
    (M.paragraph_kind, "CANON FIRST", "heading"),
    (M.noise_paragraph, "Home > News > Today", True),
    (M.prayer_kind, "Ave Maria", "BASE"), (M.prayer_kind, "Novena da Ave Maria", "NOV"), (M.prayer_kind, "Oração a São José", "JOSE"), (M.prayer_kind, "Santa Rita", "SANTAS"), (M.prayer_kind, "São Bento", "SANTOS"), (M.prayer_kind, "x", "DIV"),
    (M.publisher, "Edições  Loyola, 1999", "Loyola"), (M.publisher, "Loyola", None), (M.publisher, "Família Católica", "Editora Família Católica"),
    (M.route, "importar este arquivo", "ingest"), (M.route, "Quem disse isto?", "verify"), (M.route, "hello", "general"), (M.pope, "Carta de João Paulo II", "John Paul II"), (M.pope, "Paulus VI", "Paul VI"),
    (M.route, "Implante", "ingest"),  # a short key within a word
])
def test_cases(spark, f, text, expected):
    assert one(spark, text, f) == expected


def test_path_metadata(spark):
    found = values(spark, [("x/07 - Nicaea II (787)/acts_la.pdf",)], "x string", M.path_metadata(F.col("x")))[0][0]
    assert tuple(found) == (7, 787, "la", "Nicaea II")


@pytest.mark.parametrize(("left", "right", "same"), [("Santo Agostinho", "Agostinho de Hipona", True), ("Ana", "Anastasia", False), (None, "x", False), ("São Beda", "Beda", True), ("Leão", "Pio", False)])
def test_same_author(spark, left, right, same):
    assert values(spark, [(left, right)], "a string, b string", E.same_author(F.col("a"), F.col("b"))) == [(same,)]


@pytest.mark.parametrize(("year", "century", "label"), [(1, 1, "I"), (100, 1, "I"), (101, 2, "II"), (-50, 1, "-I"), (0, 0, ""), (1962, 20, "XX"), (None, None, None)])
def test_century(spark, year, century, label):
    assert values(spark, [(year,)], "y int", M.century(F.col("y")), M.century_label(F.col("y"))) == [(century, label)]


@pytest.mark.parametrize("n", [0, 1, 400, 401, 450, 500, 501, 900])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    text = " ".join(words)
    expected = [" ".join(words[i : i + 500]) for i in range(0, n, 400)]
    found = K.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk").collect()
    assert [r.text for r in found] == expected


def test_paged_chunks(spark):
    pages = [(1, "a b [503] c d"), (2, ""), (3, "e col. 504 f g")]
    whole = "".join(t + "\n" for _, t in pages)
    frame = spark.createDataFrame([(1, pages)], "book_id long, pages array<struct<page_number:int,text:string>>")
    found = K.paged_chunks(frame, size=4, step=3).orderBy("chunk").collect()
    spans = [(m.group(), m.start()) for m in re.finditer(r"\S+", whole)]
    for r in found:
        own = spans[3 * r.chunk : 3 * r.chunk + 4]
        assert r.text == " ".join(w for w, _ in own) and r.begin == own[0][1] and r.end == own[-1][1] + len(own[-1][0])
    assert [r.page for r in found] == [1, 1, 3, 3] and [r.column for r in found] == [0, 503, 504, 504]


def test_similarity(spark):
    rows = [("abcdefgh", "xx abcdxfgh yy zz abcdefgg"), ("abc", "xabcx"), ("abc", None)]
    found = values(spark, rows, "q string, t string", E.similarity_udf()(F.col("q"), F.col("t")))
    q, t = rows[0]
    best = 0.0
    for at in range(0, len(t) - len(q) + 1, 2):
        best = max(best, difflib.SequenceMatcher(None, q, t[at : at + len(q)]).ratio())
        if best >= 0.9:
            break
    assert found == [(best,), (1.0,), (None,)]


def test_page_and_excerpt(spark):
    pages = ["nothing here at all today", "before some words alpha1 beta2 gamma3 delta4 epsilon5 zeta6 after", "alpha1 beta2"]
    quote = "alpha1 beta2 gamma3 delta4 epsilon5 zeta6"
    frame = spark.createDataFrame([(quote, pages)], "q string, p array<string>")
    assert frame.select(E.page_of(F.col("q"), F.col("p"))).first()[0] == 2
    text = "First sentence here. Second one says alpha1 BETA2 gamma3 now and then some. Third."
    got = spark.createDataFrame([("alpha1 beta2", text)], "q string, t string").select(E.excerpt(F.col("q"), F.col("t")), E.viewer_range(F.col("q"), F.col("t"))["length"]).first()
    assert "alpha1 BETA2" in got[0] and got[1] == len("alpha1 beta2")


def test_translation(spark):
    rows = [("deus caritas est", "deus é amor", "deus é amor"), ("deus caritas est", "deus é amor", "algo totalmente diferente escrito modernamente hoje"), (None, None, None)]
    found = values(spark, rows, "o string, t string, q string", E.translation_udf()(F.col("o"), F.col("t"), F.col("q"))["verdict"])
    assert found[0] == ("faithful",) and found[1] == ("imprecise",)


def test_lexicon(spark):
    texts = spark.createDataFrame([(1, "Confissões de Agostinho"), (2, "Agostinho e Jerônimo"), (3, "nada")], "id long, text string")
    lexicon = spark.createDataFrame([("Agostinho", 1, "agostinho", 2), ("Agostinho", 1, "confissoes", 1), ("Jerônimo", 2, "jeronimo", 2)], "author string, ordinal int, pattern string, weight int")
    scores = M.lexicon_scores(texts, lexicon)
    first = {r.id: (r.author, r.score) for r in M.best_author(scores).collect()}
    none = {r.id: r.author for r in M.best_author(scores, ties="null").collect()}
    assert first == {1: ("Agostinho", 3), 2: ("Agostinho", 2)} and none == {1: "Agostinho", 2: None}
