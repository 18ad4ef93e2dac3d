"""The best rows of queries, kept in tasks, against every pair in plain Python."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from ibidem.operators.retrieval import nearest_vectors


def similar(a, b, metric):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return 0.0
    if metric == "cosine":
        found = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    else:
        found = 1 - sum((x - y) ** 2 for x, y in zip(a, b))
    return float(Decimal(repr(max(0.0, found))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def best(queries, vectors, k, metric):
    out = set()
    for q, a in queries:
        found = {}
        for *key, b in vectors:
            found[tuple(key)] = max(found.get(tuple(key), 0.0), similar(a, b, metric))
        for rank, (key, score) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, *key, score, rank))
    return out


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("block", [None, 7])
def test_nearest_vectors(spark, metric, block):
    """Copies, ties, far vectors (all at 0), null and odd ones, and keys that occur in two collections."""
    draw = random.Random(5)
    some = [[draw.choice((0.5, 0.25, -0.5, 1.0)) for _ in range(3)] for _ in range(40)]
    far = [[draw.uniform(-90, 90) for _ in range(3)] for _ in range(40)]
    vectors = [(i // 2, i % 3, draw.choice(some + far)) for i in range(300)] + [(400, 1, None), (401, 1, [1.0, None, 1.0]), (402, 1, [1.0, 2.0]), (-1, 1, [9.0, 9.0, 9.0])]
    vectors += [(i // 2, i % 3, v) for i, v in enumerate(some)]
    queries = list(enumerate(some[:15] + far[:15])) + [(90, [1.0, 2.0]), (91, None)]
    asked = spark.createDataFrame(queries, "q long, v array<double>")
    held = spark.createDataFrame(vectors, "a long, b long, v array<double>").repartition(3)
    got = {tuple(r[c] for c in ("q", "a", "b", "score", "rank")) for r in nearest_vectors(asked, held, "q", ["a", "b"], "v", 4, metric, block or 500).collect()}
    assert got == best(queries, vectors, 4, metric)
    one = spark.createDataFrame([(i, v) for i, (_, _, v) in enumerate(vectors)], "k long, v array<double>").repartition(3)
    got = {tuple(r[c] for c in ("q", "k", "score", "rank")) for r in nearest_vectors(asked, one, "q", "k", "v", 4, metric, block).collect()}
    assert got == best(queries, [(i, v) for i, (_, _, v) in enumerate(vectors)], 4, metric)


def test_pairs_stay_in_tasks(spark):
    """The pairs of queries and vectors aren't rows of the plan: no generator, and the vectors' numbers are products of matrices."""
    held = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "k long, v array<double>")
    frame = nearest_vectors(held.withColumnRenamed("k", "q"), held, "q", "k", "v", 3)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan and frame.count() == 150


def test_bm25_top(spark):
    """The best documents against all scores, with copies, ties, empty and null texts, and words in every text; scores are formed
    where documents are read, so pairs aren't rows of the plan."""
    from pyspark.sql import functions as F

    from ibidem.operators import retrieval as R

    draw = random.Random(3)
    texts = [" ".join(draw.choice("a b c d e f g h the the the".split()) for _ in range(draw.randint(1, 9))) for _ in range(120)]
    texts += [texts[0]] * 30 + ["", None, "zzz", "the a the a"]
    docs = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "d long, c long, text string").repartition(3)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:30], "zzz the the", "nothing", "", None])], "q long, text string")
    frame = R.bm25_top(asked, docs, "q", ["d", "c"], F.col("text"), F.col("text"), 4)
    every = R.bm25(asked, docs, "q", ["d", "c"], F.col("text"), F.col("text")).withColumn("score", F.round("score", 6))
    want = R.top_k(every, "q", [F.col("score").desc(), "d", "c"], 4)
    rows = lambda f: sorted(tuple(r[c] for c in ("q", "d", "c", "score", "rank")) for r in f.collect())
    assert rows(frame) == rows(want) and len({r[0] for r in rows(frame)}) == 31
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_character_windows_of_a_long_text(spark):
    """The windows of a text of a million signs take time in proportion to it, and are those of a loop."""
    import time

    from pyspark.sql import functions as F

    from ibidem.operators.chunk import character_windows

    for text, n in (("aé😀\nb" * 9, 7), ("", 5), ("abc", 40), ("x" * 41, 40), ("abcdef", 1)):
        got = spark.createDataFrame([(text, n)], "t string, n int").select(character_windows(F.col("t"), F.col("n"))).first()[0]
        assert got == [text[s : s + n] for s in range(0, max(len(text) - n, 0) + 1, max(1, n // 4))]
    long = spark.range(1).select(F.repeat(F.lit("abcdé"), 200_000).alias("t"))
    began = time.time()
    assert long.select(F.size(character_windows(F.col("t"), F.lit(40)))).first()[0] == 99_997
    assert time.time() - began < 15
