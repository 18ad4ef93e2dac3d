"""SC43: languages told by a naive Bayes model of letter trigrams, learned from labelled texts by Spark.

A trigram is three signs of a word with a mark before and after it, in lower case. P(trigram | language) is its count plus
ALPHA, over all of the language's trigrams plus ALPHA times the number of distinct ones; a language's prior is its share of
the texts. Training is one aggregate over all labelled texts; the model has a row for each trigram, which are few in any set of
alphabets, and is broadcast while they're at most MOST_GRAMS, else joined.

Defined results: a text without letters gets the most frequent language; null labels aren't learned from; ties go to the
language that comes first by name; without any labelled text nothing is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ibidem.functions.language import code_of, is_latin, script_of

from .shared import small, written

ALPHA, MOST_GRAMS = 0.5, 1_000_000


def trigrams(text: Column) -> Column:
    marked = F.concat(F.lit("_"), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", "_ _"), F.lit("_"))
    return F.regexp_extract_all(marked, F.lit("(?=([^ ]{3}))"), F.lit(1))


class LanguageModel:
    """Log probabilities: `grams` (gram, logs: an array by language), and for each language its name, prior and that of an unseen trigram."""

    def __init__(self, grams: DataFrame, languages: list[str], priors: list[float], unseen: list[float]):
        self.grams, self.languages, self.priors, self.unseen = grams, languages, priors, unseen

    @classmethod
    def learn(cls, texts: DataFrame, language: str = "lang", text: str = "text") -> LanguageModel:
        import math

        rows = texts.where(F.col(language).isNotNull())
        counts = written(rows.select(F.col(language).alias("lang"), F.explode(trigrams(F.col(text))).alias("gram")).groupBy("gram", "lang").agg(F.count("*").alias("n")))
        docs = {r["lang"]: r["n"] for r in rows.groupBy(F.col(language).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row for each language
        sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        size, names = counts.select("gram").distinct().count(), sorted(docs)
        below = [sums.get(x, 0) + ALPHA * size for x in names]
        n = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
        logs = F.array(*[F.log((F.coalesce(F.col("_n")[x], F.lit(0)) + ALPHA) / F.lit(float(b))) for x, b in zip(names, below, strict=True)])
        grams = written(counts.groupBy("gram").agg(n.alias("_n")).select("gram", logs.alias("logs")))
        return cls(grams, names, [math.log(docs[x] / sum(docs.values())) for x in names], [math.log(ALPHA / b) if b else 0.0 for b in below])

    def tell(self, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, detected, certainty (the posterior probability) of every text; keys that occur twice count as one text."""
        grams = F.broadcast(self.grams) if small(self.grams, MOST_GRAMS) else self.grams
        spread = texts.select(key, F.explode_outer(trigrams(F.col(text))).alias("gram")).join(grams, "gram", "left")
        seen = F.col("gram").isNotNull()
        part = lambda i: F.sum(F.when(seen, F.coalesce(F.col("logs")[i], F.lit(self.unseen[i]))).otherwise(0.0)) + self.priors[i]
        sums = spread.groupBy(key).agg(*[part(i).alias(f"_{i}") for i in range(len(self.languages))])
        every = F.array(*[F.struct(F.col(f"_{i}").alias("log"), F.lit(-i).alias("order"), F.lit(x).alias("lang")) for i, x in enumerate(self.languages)])
        best = F.array_max(every)
        return sums.select(key, best["lang"].alias("detected"), (1 / F.aggregate(every, F.lit(0.0), lambda a, x: a + F.exp(x["log"] - best["log"]))).alias("certainty"))

    def cascade(self, texts: DataFrame, key: str, text: str = "text", hint: str | None = None) -> DataFrame:
        """SC43, SC44: key, detected, certainty: a hint, else the script (0.90), else Latin (0.85), else the model with its own
        certainty; only texts that none of the first three tells are cut into trigrams."""
        hinted = F.nullif(code_of(F.col(hint)), F.lit("")) if hint else F.lit(None).cast("string")
        script, latin = script_of(F.col(text)), F.when(is_latin(F.col(text)), "la")
        sure = F.when(hinted.isNotNull(), 1.0).when(script.isNotNull(), 0.90).when(latin.isNotNull(), 0.85)
        first = texts.select(key, F.col(text).alias("_text"), F.coalesce(hinted, script, latin).alias("detected"), sure.alias("certainty"))
        told = self.tell(first.where("detected is null"), key, "_text")
        return first.where("detected is not null").select(key, "detected", "certainty").unionByName(told)
