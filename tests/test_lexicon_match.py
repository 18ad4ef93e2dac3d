"""Many forms at once, against a comparison of every text with every form."""

import random
import re

import pytest

from ibidem.functions import metadata as M
from ibidem.operators import lexicon_match as L
from ibidem.plans import catalog as C


def word(rng):
    return "".join(rng.choice("abcdeé ñ".replace(" ", "")) for _ in range(rng.randint(1, 4)))


def bounded(text, form):
    return re.search(rf"(?<![^\W]){re.escape(form)}(?![^\W])", text) is not None


@pytest.mark.parametrize("a_pass", [7, 200_000])
def test_forms(spark, monkeypatch, a_pass):
    monkeypatch.setattr(L, "FORMS_A_PASS", a_pass)
    rng = random.Random(5)
    forms = [(" ".join(word(rng) for _ in range(rng.randint(1, 2))), rng.random() < 0.5, f"n{i // 2}") for i in range(40)] + [("", True, "none")]
    texts = [(i, " ".join(word(rng) for _ in range(rng.randint(0, 30))), "x") for i in range(60)] + [(100, None, "x"), (101, "", None)]
    frame = spark.createDataFrame(texts, "id long, t string, more string")
    want = {(i, more, name) for i, t, more in texts for form, whole, name in forms if t and form and (bounded(t, form) if whole else form in t)}
    got = [(r.id, r.more, r.pattern) for r in L.matches(frame, "t", forms).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert L.matches(frame, "t", []).count() == 0 and L.matches(frame.limit(0), "t", forms).count() == 0


def test_large_lexicon(spark):
    """20 000 forms in one pass, with regular expressions beside them."""
    rows = [(f"author {i // 4}", i, rf"\b{'form' if i % 2 else 'name'} {i}\b", 1 + i % 2) for i in range(20_000)] + [("odd", 20_000, r"\bnumber [0-9]+\b", 5), ("plain", 20_001, "umbe", 1)]
    lexicon = spark.createDataFrame(rows, "author string, ordinal int, pattern string, weight int")
    texts = spark.createDataFrame([(i, f"Form {3 * i}, name {3 * i} and form {19_999 - 2 * i}; number{i} number {i}") for i in range(200)], "id long, text string")
    got = {(r.id, r.author): (r.score, r.ordinal) for r in M.lexicon_scores(texts, lexicon).collect()}
    want = {}
    for i in range(200):
        for author, ordinal, pattern, weight in [rows[j] for j in {3 * i, 19_999 - 2 * i}] + rows[-2:]:
            if re.search(pattern, f"form {3 * i}, name {3 * i} and form {19_999 - 2 * i}; number{i} number {i}"):
                score, first = want.get((i, author), (0, ordinal))
                want[i, author] = (score + weight, min(first, ordinal))
    assert got == want


def test_church_documents(spark):
    books = spark.createDataFrame([(1, "Encyclical X 1891 ", None), (2, "Letter", "the council of y"), (3, "none", "of z"), (4, "council 1962", "encyclical")], "id long, title string, sample string")
    known = spark.createDataFrame([(0, r"\bencyclical\b", None, 1900, "a"), (1, r"\bcouncil\b", "Acts", None, "b")], "ordinal int, pattern string, canonical_title string, default_year int, author string")
    got = {r.id: tuple(r)[1:] for r in M.church_document(books, known).collect()}
    assert got == {1: ("Encyclical X 1891", 1891, "Encyclical X 1891 — 1891", "a"), 2: ("Acts", None, "Acts", "b"), 4: ("council 1962", 1962, "council 1962 — 1962", "a")}


def test_aliases(spark):
    saints = spark.createDataFrame([("A", "Éa"), ("A", "b"), ("B", "ea"), ("C", " "), ("C", None)], "saint string, alias string")
    books = spark.createDataFrame([(1, "an Ear"), (2, "beacon"), (3, None)], "book_id long, text string")
    assert {tuple(r) for r in C.alias_books(saints, books).collect()} == {("A", 1), ("B", 1), ("A", 2), ("B", 2)}
