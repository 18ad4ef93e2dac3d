"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the direct sum of two binary Golay codes [23, 12], perfect of covering radius 3,
over the first 46 bits of a fingerprint; every 64-bit word lies within the covering radius 6 (in those bits) of one of the
2**24 anchors. Two fingerprints within 2 bits have a midpoint within 1 bit of each, so both lie within covering radius
plus 1 of the midpoint's anchor. Replicating each distinct fingerprint to the anchors of all points within half the
threshold (about 10 anchors in place of about 70 for one-sided replication at the whole threshold) therefore brings
every linked pair together under at least one anchor, where pairs are compared exactly.

An anchor with more than `most` members (a large group of near copies) isn't compared pairwise: its members are linked
exactly through their midpoints, a star of at most 65 distinct fingerprints around each point. Only distinct fingerprints
take part, so copies never meet one another in a task. Links become components by alternating star contraction, which
runs as Spark jobs with a checkpoint a round.

Defined results: null or wordless text has fingerprint zero, linked like any other; repeated rows stay; a null doc_id
keeps its fingerprint and takes the component of its fingerprint; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

#: The Golay code's generator polynomial x^11+x^9+x^7+x^6+x^5+x+1, its length and the bits of a check.
GOLAY, GOLAY_BITS, GOLAY_CHECK = 0b101011100011, 23, 11


@cache
def _golay_errors():
    """For each of the 2048 syndromes the error pattern of least weight (at most 3 bits), and syndromes of low and high halves."""
    import itertools

    import numpy as np

    def rest(word: int) -> int:
        for k in range(GOLAY_BITS - 1, GOLAY_CHECK - 1, -1):
            if word >> k & 1:
                word ^= GOLAY << (k - GOLAY_CHECK)
        return word

    single = [rest(1 << k) for k in range(GOLAY_BITS)]
    errors = np.zeros(1 << GOLAY_CHECK, np.uint64)
    for n in range(4):
        for bits in itertools.combinations(range(GOLAY_BITS), n):
            s = 0
            for b in bits:
                s ^= single[b]
            errors[s] = sum(1 << b for b in bits)
    low = np.array([rest(w) for w in range(1 << 12)], np.int64)
    high = np.array([rest(w << 12) for w in range(1 << 11)], np.int64)
    return errors, low, high


def nearest_anchor(points):
    """The anchor (46 bits) of each 64-bit point of a numpy array: each 23-bit block goes to its nearest code word."""
    import numpy as np

    errors, low, high = _golay_errors()
    points = points.astype(np.uint64)
    out = np.zeros_like(points)
    for shift in (0, GOLAY_BITS):
        block = (points >> np.uint64(shift)) & np.uint64((1 << GOLAY_BITS) - 1)
        block ^= errors[low[(block & np.uint64(0xFFF)).astype(np.int64)] ^ high[(block >> np.uint64(12)).astype(np.int64)]]
        out |= block << np.uint64(shift)
    return out


def anchors_within(points):
    """(index of the point, anchor) of every anchor of a point within one bit of each given point, without repeats."""
    import numpy as np

    flips = np.array([0] + [1 << k for k in range(2 * GOLAY_BITS)], np.uint64)
    found = np.sort(nearest_anchor(points[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, _ = np.nonzero(new)
    return rows, found[new]


def _text_fingerprints(texts: list):
    """The fingerprints of texts: majority of the bits of XXH64 (seed 42) over their word shingles."""
    import re

    import numpy as np
    import xxhash

    split, digest = re.compile(r"[^\x20\x09-\x0D]+").findall, xxhash.xxh64_intdigest
    lower = {c: c + 32 for c in range(65, 91)}
    out = np.zeros(len(texts), np.uint64)
    places = np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        words = split((text if text.islower() and text.isascii() else text.translate(lower))) if text else []
        n = len(words)
        if not n:
            continue
        whole = " ".join(words).encode()
        if n <= 3:
            hashes = np.array([digest(whole, 42)], np.uint64)
        else:
            size = np.fromiter(map(len, [w.encode() for w in words] if len(whole) != sum(map(len, words)) + n - 1 else words), np.int64, n)
            end = np.cumsum(size) + np.arange(n)
            start = end - size
            view = memoryview(whole)
            hashes = np.fromiter([digest(view[a:b], 42) for a, b in zip(start[:-2].tolist(), end[2:].tolist(), strict=True)], np.uint64, n - 2)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = ((2 * ones > len(hashes)).astype(np.uint64) << places).sum(dtype=np.uint64)
    return out


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the fingerprint as a signed 64-bit fp in place of the text, their last column."""
    ship(rows.sparkSession)

    def work(parts):
        import numpy as np
        import pyarrow as pa

        for part in parts:
            fp = _text_fingerprints(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], [*part.schema.names[:-1], "fp"])

    return rows.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "fp long"]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit fp for each row."""
    return _marked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def links(points: DataFrame, threshold: int = 2, most: int = 256) -> DataFrame:
    """Links (a, b), a < b, among distinct fingerprints `fp` within `threshold` (at most 2) bits.

    Under a crowded anchor they're stars over midpoints, which join exactly what is linked; else they're all the pairs.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("anchors are laid out for thresholds up to 2")

    def deal(parts):
        import numpy as np
        import pyarrow as pa

        for part in parts:
            fp = part.column(0).to_numpy()
            for k in range(0, len(fp), 1 << 14):
                own = fp[k : k + (1 << 14)]
                rows, anchor = anchors_within(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own[rows])], ["anchor", "fp"])

    placed = materialize(points.select("fp").mapInArrow(deal, "anchor long, fp long"), "anchors")
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(sizes, "anchor")
    quiet = placed.where(F.col("n") <= most).select("anchor", "fp")
    pairs = quiet.withColumnRenamed("fp", "a").join(quiet.withColumnRenamed("fp", "b"), "anchor").where("a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold).select("a", "b")
    crowded = placed.where(F.col("n") > most).select("fp").distinct()
    return pairs.unionByName(_midpoint_stars(crowded, threshold)).distinct()


def _midpoint_stars(points: DataFrame, threshold: int) -> DataFrame:
    """Links among all fingerprints within `threshold` bits, from each to the least one around the same midpoint."""
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64 if threshold == 2 else 0)]
    if threshold == 1:  # no midpoint lies between: the ends themselves are the points, met from the lesser side
        own = points.select(F.col("fp").alias("a"))
        near = points.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)])).alias("a"))
        return near.join(own, "a").where("a < fp").select("a", F.col("fp").alias("b"))
    around = points.select("fp", F.explode(F.array(*flips)).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    return around.join(least, "mid").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b), for every node that has an edge.

    Alternating star contraction: in each round every node links its greater neighbours, then its lesser ones, to its least
    neighbour. Rounds grow with the logarithm of a component's size, and each ends in a table in the shared folder.
    """
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.join(low, "u")
        small = kept.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        state = materialize(small.where("u <> v").distinct(), "links")
        now = state.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before is not None and (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    roots = state.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return materialize(roots.unionByName(tops).groupBy("node").agg(F.min("root").alias("root")), "roots")


def _rooted(marked: DataFrame, threshold: int, most: int) -> DataFrame:
    """Every distinct fp, the least doc_id that has it, and root, the least fingerprint reachable over links."""
    points = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points, threshold, most))
    return points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, most: int = 256) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) for every row."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _rooted(marked, threshold, most)
    owner = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(owner, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, threshold: int = 2, most: int = 256, most_keys: int = 1_000_000) -> DataFrame:
    """One row of docs for each component: that with its least doc_id, or, where no row in it has one, the least by hashes.

    Rows are told apart by doc_id and 128 bits of hashes of the text. Repeated rows of both are copies of one document, and
    one of them stays; rows of one doc_id, or without any, whose texts aren't linked are of different components and all stay.

    Keys alone are shuffled to tell which rows go, and which stay but are repeated. While these are at most most_keys, they are
    broadcast and the documents stay where they are read; only repeated ones are shuffled.
    """
    text = F.col("text").cast("string")
    keys = {"_id": F.col("doc_id").cast("long"), "_x": F.xxhash64(text), "_y": F.xxhash64(F.lit(1), text)}
    marked = materialize(_marked(docs.select(*[k.alias(n) for n, k in keys.items()], text.alias("text"))), "fingerprints")
    of = _rooted(marked.withColumnRenamed("_id", "doc_id"), threshold, most).select("fp", "root")
    known = materialize(marked.join(of, "fp").groupBy("root", "fp", *keys).agg(F.count("*").alias("n")), "rows")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "fp", "_x", "_y")
    best = known.groupBy("root").agg(F.min(order).alias("_best")).select(*[F.col(f"_best.{n}").alias(f"_best{n}") for n in keys], F.lit(True).alias("_stays"))
    same_key = F.col("_x") == F.col("_best_x")  # by key, not by root, which a third of all rows may have
    for n in ("_y", "_id"):
        same_key = same_key & F.col(n).eqNullSafe(F.col(f"_best{n}"))
    told = known.join(best, same_key, "left").withColumn("_stays", F.coalesce("_stays", F.lit(False)))
    named = [F.col(n).alias(f"_of{n}") for n in keys]
    marks = materialize(told.where("not _stays or n > 1").select(*named, "_stays"), "marks")
    marks = F.broadcast(marks) if marks.count() <= most_keys else marks
    met = (F.col("_x") == F.col("_of_x")) & (F.col("_y") == F.col("_of_y")) & F.col("_id").eqNullSafe(F.col("_of_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[k.alias(n) for n, k in keys.items()])
    rows = rows.join(marks, met, "left")
    stay = rows.where("_stays is null").select("_row").union(rows.where("_stays").dropDuplicates(list(keys)).select("_row"))
    return stay.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
