"""The letter model of languages: against plain Python, and held out against the profiles of stop words."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ibidem.functions.language import profile_of
from ibidem.operators.language_model import ALPHA, LanguageModel


def grams(text):
    return [f"_{w}_"[i : i + 3] for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for i in range(len(w))]


def test_against_plain(spark):
    known = [("en", "the cat and the dog"), ("en", "this is the end"), ("de", "der hund und die katze"), ("de", None), (None, "zzz"), ("fr", "le chat et le chien")]
    asked = [(1, "the dog"), (2, "und die"), (3, "le chien, c'est moi"), (4, ""), (5, None), (6, "zzz qqq"), (7, "x" * 5)]
    counts = {x: Counter(g for lang, t in known if lang == x for g in grams(t)) for x in ("de", "en", "fr")}
    size = len(set().union(*counts.values()))
    prior = Counter(lang for lang, _ in known if lang)
    model = LanguageModel.learn(spark.createDataFrame(known, "lang string, text string"))
    got = {r.id: (r.detected, r.certainty) for r in model.tell(spark.createDataFrame(asked, "id long, text string"), "id").collect()}
    for k, text in asked:
        logs = {x: math.log(prior[x] / 5) + sum(math.log((c[g] + ALPHA) / (sum(c.values()) + ALPHA * size)) for g in grams(text)) for x, c in counts.items()}
        best = min(logs, key=lambda x: (-logs[x], x))
        assert got[k][0] == best and got[k][1] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    assert model.tell(spark.createDataFrame([], "id long, text string"), "id").count() == 0


def test_held_out(spark):
    """On documents that it hasn't learned from, and on single lines of them, it is right more often than the profiles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = LanguageModel.learn(docs.where("doc_id % 3 <> 1"))
    held = docs.where("doc_id % 3 = 1")
    for text, least in ((F.col("text"), 0.97), (F.substring("text", 1, 40), 0.85)):
        rows = held.select("doc_id", "lang", text.alias("text"))
        told = model.tell(rows, "doc_id").join(rows, "doc_id").select(F.avg((F.col("detected") == F.col("lang")).cast("int"))).first()[0]
        profile = rows.select(F.avg(F.coalesce(profile_of(F.col("text")) == F.col("lang"), F.lit(False)).cast("int"))).first()[0]
        print(told, profile)
        assert told >= least and told >= profile


def test_cascade(spark):
    model = LanguageModel.learn(spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")], "lang string, text string"))
    rows = [(1, "der hund", "English"), (2, "ἀρχή λόγος", None), (3, "et in non est sed qui per quod", None), (4, "die katze", None), (5, "the dog", "")]
    got = {r.id: (r.detected, r.certainty) for r in model.cascade(spark.createDataFrame(rows, "id long, text string, hint string"), "id", hint="hint").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "grc", 3: "la", 4: "de", 5: "en"}
    assert got[1][1] == 1 and got[2][1] == 0.9 and got[3][1] == 0.85 and 0.5 < got[4][1] <= 1
