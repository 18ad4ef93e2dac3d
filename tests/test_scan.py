"""Prefix scans by ranges against windows by key, with a key that has most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ibidem.operators import neighbours as N
from ibidem.operators import scan as S


def rows_of(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    held = [(rng.choice(["hot", "hot", "hot", "a", "b", None, f"k{i}"]), i, rng.choice([None, None, None, f"v{i}"])) for i in range(600)]
    return spark.createDataFrame(held, "k string, at int, v string").repartition(5)


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_scans(rows, ranges):
    w = Window.partitionBy("k").orderBy("at")
    want = rows.withColumns({"f": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": (F.row_number().over(w) - 1).cast("long"), "p": F.lag("v").over(w), "x": F.lead("v").over(w)})
    assert rows_of(S.filled(rows, ["k"], ["at"], F.col("v"), "f", ranges), ["k", "at", "v", "f"]) == rows_of(want, ["k", "at", "v", "f"])
    assert rows_of(S.numbered(rows, ["k"], ["at"], "n", ranges), ["k", "at", "n"]) == rows_of(want, ["k", "at", "n"])
    assert rows_of(S.beside(rows, ["k"], ["at"], F.col("v"), 1, "p", ranges), ["k", "at", "p"]) == rows_of(want, ["k", "at", "p"])
    assert rows_of(S.beside(rows, ["k"], ["at"], F.col("v"), -1, "x", ranges), ["k", "at", "x"]) == rows_of(want, ["k", "at", "x"])


def test_no_large_task(rows):
    """A key that has most rows lies in many ranges, none of which is much larger than the others."""
    sizes = [r["count"] for r in S.Ranges(rows, ["k"], ["at"], 12).rows.groupBy("_range").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * sorted(sizes)[6]


def test_same_either_way(rows, monkeypatch):
    marks = rows.where("v is not null").select("k", (F.col("at") + 1).alias("at"), "v")
    asked = rows.select("k", "at", F.col("at").alias("id"))
    known = rows.limit(0).select("k", F.lit(4).alias("seq"))

    def all_of():
        return [
            rows_of(N.as_of_join(asked, marks, ["k"], "at", ["v"]), ["k", "at", "id", "v"]),
            rows_of(N.forward_fill(rows, "k", ["at"], F.col("v"), "f"), ["k", "at", "v", "f"]),
            rows_of(N.numbered_on(rows, known, "k", ["at"]), ["k", "at", "seq"]),
            rows_of(N.nearest(rows, "k", ["at"], "v"), ["k", "at", "previous", "next"]),
        ]

    want = all_of()
    monkeypatch.setattr(S, "MOST_ROWS", 20)
    assert S.hot(rows, ["k"]) and all_of() == want
