"""Best-fit packing of tokenized documents by large-item matching.

Only lengths matter to the packing, and a length is at most the capacity, so the corpus comes down to a histogram of
`capacity` counters. The plan is made on that histogram: pieces above a third of the capacity, of which a sequence holds
two at most, are matched greedily, longest first, each with the longest partner that fits (which makes the most pairs);
smaller pieces, longest first, go into the tightest gap that holds them, and new sequences are opened only when no gap is
left. Runs of equal sequences are handled together, so the plan's size depends on the capacity, not on the documents. The
pieces, numbered within their length by a distributed count, then look their places up.

Defined results: null text is empty and holds the end id alone; repeated rows are packed as often as they occur; null
doc_id is kept; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: whole ones, or cut from the end into full pieces, so that only the first may be shorter."""
    ship(docs.sparkSession)
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")

    def work(parts):
        import zlib

        import pyarrow as pa

        from .tokens import batches, encoder

        tail = end_id.to_bytes(4, "little")
        for part in parts:
            names, texts = part.column(0).to_pylist(), part.column(1)
            for a, b in batches(texts):
                rows: list[tuple] = []
                for doc, ids in zip(names[a:b], encoder(tokenizer_path).encode(texts[a:b]), strict=True):
                    ids = b"".join((ids, tail))
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                        own = ids if len(edges) == 2 else ids[4 * i : 4 * j]
                        rows.append((doc, k, i, j - i, zlib.crc32(own), own) if with_ids else (doc, k, i, j - i, zlib.crc32(own)))
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (length, rank, sequence, offset): the run's k-th piece goes to the k-th sequence from there, at that offset.

    Ranks of a length count from 0 and its runs are in order; a run ends where the next of its length begins.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many) that have it
    open_gaps: list[int] = []
    opened = 0

    def put(size: int, first: int, n: int, offset: int) -> None:
        runs.append((size, used[size], first, offset))
        used[size] += n
        left[size] -= n
        gap = capacity - offset - size
        if gap:
            if gap not in gaps:
                insort(open_gaps, gap)
            gaps.setdefault(gap, []).append((first, n))

    def take(gap: int, most: int) -> tuple[int, int]:
        first, n = gaps[gap].pop()
        if n > most:
            gaps[gap].append((first + most, n - most))
            n = most
        if not gaps[gap]:
            del gaps[gap]
            open_gaps.pop(bisect_left(open_gaps, gap))
        return first, n

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            partner = next((p for p in reversed(large) if p <= capacity - size and left[p] > (p == size)), None)
            n = left[size] if partner is None else left[size] // 2 if partner == size else min(left[size], left[partner])
            first, opened = opened, opened + n
            put(size, first, n, 0)
            if partner is not None:
                take(capacity - size, n)
                put(partner, first, n, size)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(open_gaps, size)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = take(gap, left[size])
                put(size, first, n, capacity - gap)
            else:
                n = -(-left[size] // (capacity // size))
                first, opened = opened, opened + n
                put(size, first, n, 0)
    return runs


def pack(cut: DataFrame, capacity: int = 1024, rows_a_part: int = 2_000, most_parts: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length. `cut` is written to the shared folder first."""
    spark = cut.sparkSession
    parts = materialize(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(histogram, capacity)
    # Ranks: a length, which may hold a third of the pieces, is split by a salt; its pieces are numbered within the salt
    # and counted on from the salts before.
    salts = max(1, min(-(-sum(histogram.values()) // rows_a_part), most_parts))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own")).drop("base", "own", "salt")
    held = spark.sparkContext.broadcast(_lookup(runs))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        lengths, ranks, sequences, offsets, first = held.value
        for b in batches:
            size, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            at = np.searchsorted(first, size * (1 << 40) + rank, side="right") - 1
            columns = [*b.columns[:-1], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items() if n != "rank") + ", sequence_id long, offset long"
    return ranked.select(*[n for n in kinds if n != "rank"], "rank").mapInArrow(place, schema)


def _lookup(runs):
    """Arrays of the runs in order of length and rank, with a joint key for a binary search."""
    import numpy as np

    table = np.array(sorted(runs) or [(0, 0, 0, 0)], np.int64)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3], table[:, 0] * (1 << 40) + table[:, 1]


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit) and the pieces in them in order."""
    placed = pack(pieces(docs, tokenizer_path, capacity, end_id, with_ids=True), capacity)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    whole = placed.groupBy("sequence_id").agg(held.alias("held"))  # a sequence holds `capacity` ids at most
    joined = F.aggregate("held", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.transform("held", lambda x: x.dropFields("ids")).alias("pieces"))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    out = pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
