"""RT6: vectors of texts without a model: signed hashing of character grams, weighed by the corpus.

A feature is a run of `gram` signs of a word of the folded text, with a mark before and after the word, so words that differ by
a letter (an ending, a slip, a misread sign) share most of theirs. A feature's hash gives its place among `dims` and its sign;
equal places add up. Weights are (1 + ln tf) times ln((1 + n) / (1 + df)) + 1, and a vector has length 1.

Texts of a search are cut once, where they are read, to a row each of its places and values, which is written; frequencies of
places are at most `dims` numbers and are broadcast. A second pass weighs the rows and hands on those places that queries have,
and a task's best alone leave it (`best.py`). Rows that share a key are one text; they are rare, and alone are shuffled.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ibidem.functions.text import fold

from .best import sparse_top
from .shared import ship, written

DIMS, GRAM = 1 << 16, 4
_VECTOR = [StructField("at", ArrayType(IntegerType())), StructField("value", ArrayType(DoubleType()))]


#: Signs of texts that are cut at a time.
SIGNS = 1_000_000


def marked(text: Column, gram: int = GRAM) -> Column:
    """A text's words with a mark before and marks after each, so that the shortest has a gram."""
    after = "_" * (gram - 2)
    return F.concat(F.lit("_"), F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", f"{after} _"), F.lit(after))


def features(text: Column, gram: int = GRAM) -> Column:
    """The grams of a text's words, with repeats; a match takes a whole sign, so none begins within one."""
    return F.regexp_extract_all(marked(text, gram), F.lit(rf"(?s)(?=([^ ]{{{gram}}}))."), F.lit(1))


def entries(rows: DataFrame, key: list[str], text: Column, dims: int = DIMS, gram: int = GRAM) -> DataFrame:
    """key, place, value: the signed sums of 1 + ln tf of the features at each place."""
    counted = rows.select(*key, F.explode(features(text, gram)).alias("feature")).groupBy(*key, "feature").agg(F.count("*").alias("tf"))
    number = F.conv(F.substring(F.md5("feature"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.floor(number / dims) % 2 == 0, 1.0).otherwise(-1.0)
    return counted.select(*key, F.pmod(number, F.lit(dims)).cast("int").alias("place"), (sign * (1 + F.log("tf"))).alias("v")).groupBy(*key, "place").agg(F.sum("v").alias("value")).where("abs(value) > 1e-9")


def frequencies(found: DataFrame, n: int) -> DataFrame:
    """place, idf: at most a row for each of the places."""
    df = found.groupBy("place").agg(F.count("*").alias("df"))
    return df.select("place", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def unit(found: DataFrame, key: list[str], idf: DataFrame, n: int, wanted: DataFrame | None = None) -> DataFrame:
    """key, place, weight of vectors of length 1; of the places wanted, if some are given."""
    unseen = F.log(F.lit(1.0 + n)) + 1
    weighed = found.join(F.broadcast(idf), "place", "left").select(*key, "place", (F.col("value") * F.coalesce("idf", unseen)).alias("w"))
    lengths = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    own = weighed if wanted is None else weighed.join(F.broadcast(wanted), "place", "left_semi")
    return own.join(lengths, key).select(*key, "place", (F.col("w") / F.col("length")).alias("weight"))


@lru_cache(1 << 20)
def _number(gram: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big")


def cut(texts: list[str], dims: int, gram: int):
    """(numbers of texts, places, values) of marked texts, by text and place: what `entries` has, summed by the order of grams."""
    import numpy as np

    signs = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")  # a line's end is no sign of a marked text
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    free = np.concatenate([[0], np.cumsum((signs == 32) | (signs == 10))])
    start = np.flatnonzero(free[gram:] == free[:-gram]) if len(signs) >= gram else np.zeros(0, np.int64)
    there = np.zeros(int(signs.max(initial=0)) + 1, bool)
    there[signs] = True
    code, n = (np.cumsum(there) - 1)[signs], int(there.sum())
    found = code[start]
    for k in range(1, gram):  # a number for each gram, in the order of its signs
        if (int(found.max(initial=0)) + 1) * n >= 1 << 62:
            found = np.unique(found, return_inverse=True)[1]
        found = found * n + code[start + k]
    found = np.unique(found, return_inverse=True)[1]
    first = np.zeros(int(found.max(initial=-1)) + 1, np.int64)
    first[found] = start
    at = first[:, None] + np.arange(gram)
    names = signs[at].tobytes().decode("utf-32-le") if len(first) else ""
    number = np.fromiter(map(_number, (names[i : i + gram] for i in range(0, len(names), gram))), np.int64, len(first))
    pair, tf = np.unique(of[start] * max(len(first), 1) + found, return_counts=True)
    doc, kind = np.divmod(pair, max(len(first), 1))
    value = np.where(number[kind] // dims % 2 == 0, 1.0, -1.0) * (1 + np.log(tf))
    place = number[kind] % dims
    order = np.argsort(doc * dims + place, kind="stable")  # of a place by grams
    doc, place, value = doc[order], place[order], value[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
    total = np.add.reduceat(value, new) if len(new) else value
    kept = np.abs(total) > 1e-9
    return doc[new][kept], place[new][kept], total[kept]


def _lists(n: int, rows, *columns):
    """Arrow arrays of lists, one for each of n rows, of columns whose entries are of `rows`, in order."""
    import numpy as np
    import pyarrow as pa

    ends = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]


def vectors(rows: DataFrame, key: list[str], text: Column, dims: int = DIMS, gram: int = GRAM) -> DataFrame:
    """key, at, value: the places of each key's text, in order, and its value at each; a row a key."""
    ship(rows.sparkSession)
    named = rows.select(*key, text.alias("_text"))
    again = written(named.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    alone, merged = named, None
    if not again.isEmpty():
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
        alone, shared = (named.alias("a").join(again.alias("b"), same, how) for how in ("left_anti", "left_semi"))
        sums = entries(shared, key, F.col("_text"), dims, gram).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("e"))
        merged = sums.select(*key, F.col("e.place").alias("at"), F.col("e.value").alias("value"))

    def work(parts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in parts:
            size = np.cumsum(pc.utf8_length(part.column(len(key))).to_numpy())
            a = 0
            while a < len(part):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SIGNS, side="right")))
                few = part.slice(a, b - a)
                doc, place, value = cut(few.column(len(key)).to_pylist(), dims, gram)
                yield pa.RecordBatch.from_arrays([*few.columns[: len(key)], *_lists(len(few), doc, place.astype(np.int32), value)], [*key, "at", "value"])
                a = b

    schema = StructType([*[named.schema[c] for c in key], *_VECTOR])
    out = alone.select(*key, marked(F.col("_text"), gram).alias("_text")).mapInArrow(work, schema)
    return out if merged is None else out.unionByName(merged)


def hashed_top(queries: DataFrame, docs: DataFrame, query_key: str, key: list[str], query: Column, text: Column, k: int, dims: int = DIMS, gram: int = GRAM) -> DataFrame:
    """TK2 by hashed vectors: query_key, key, score (the cosine, rounded to 6 places), rank of the k nearest documents of each
    query that have a cosine above 0; ties go by key."""
    held = written(vectors(docs, key, text, dims, gram))
    n = docs.count()
    idf = written(frequencies(held.select(F.explode("at").alias("place")), n))  # `dims` rows at most
    asked = written(unit(entries(queries, [query_key], query, dims, gram), [query_key], idf, n))
    known = idf.join(asked.select("place").distinct().withColumn("_there", F.lit(True)), "place", "left").toArrow()  # as many
    sent = held.sparkSession.sparkContext.broadcast((known["place"].to_numpy(), known["idf"].to_numpy(), known["_there"].is_valid().to_numpy()))

    def work(parts):
        import numpy as np
        import pyarrow as pa

        place, idf, there = sent.value
        weight, wanted = np.ones(dims), np.zeros(dims, bool)
        weight[place], wanted[place] = idf, there
        for part in parts:
            size = part.column(len(key)).value_lengths().to_numpy()
            at, value = (c.flatten().to_numpy() for c in part.columns[len(key) :])
            of = np.repeat(np.arange(len(part)), size)
            w = value * weight[at]
            length = np.sqrt(np.bincount(of, w * w, minlength=len(part)))
            own = wanted[at]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], *_lists(len(part), of[own], at[own], w[own] / length[of[own]])], [*key, "at", "value"])

    near = held.mapInArrow(work, held.schema)
    return sparse_top(near, asked.withColumnRenamed("place", "at"), query_key, key, k).where("score > 0")
