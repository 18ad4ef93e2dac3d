"""Token-id shards whose document boundaries are Elias-Fano coded.

A shard file holds documents in ascending doc_id order: their token ids as one concatenated little-endian array (16 bits an
id where all fit, else 32), and two Elias-Fano sequences, the ends of the documents in that array and their doc_ids. Each
sequence takes about 2 + log2(universe / n) bits a document; a sampled select structure (the place of every 256th one-bit
as 32 bits) finds any boundary without decoding the rest. No table of 64-bit offsets is written. Shards hold at most
`ids_a_shard` ids (one document, if it alone is longer), so no task keeps more than that in memory.

Files are written under a name of their own attempt and then renamed, so a repeated task leaves the same file again.

Defined results: null text is empty (its document holds the end id alone); null doc_ids come first, repeated rows stay, in
order of their text; an empty table gives no files and an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, materialize, scratch, ship

MAGIC = b"EFTOKEN1"
SAMPLE = 256
#: Numbers of task and shard in a file's name.
PART = r"shard-(\d+)-(\d+)\.eft"
HEADER = struct.Struct("<8sQQQqB")  # magic, documents, null doc_ids, ids, least doc_id, bytes an id
SEQUENCE = struct.Struct("<QQB")  # values, bytes of the high part, low bits a value


class EliasFano:
    """An ascending sequence of non-negative integers: low bits packed, high bits in unary, select by samples."""

    def __init__(self, n: int, low_bits: int, low, high, samples):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values):
        import numpy as np

        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        lows = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return SEQUENCE.pack(self.n, len(self.high), self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data, at: int):
        """The sequence that begins at a place of the data, and the place after it."""
        import numpy as np

        n, n_high, bits = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        n_low, n_samples = (n * bits + 7) // 8, -(-n // SAMPLE)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, bits, low, high, samples), at + n_low + n_high + 4 * n_samples

    def select(self, i: int) -> int:
        """Value i, from the sample before it and the few words after that."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        word, need = place // 64, i % SAMPLE
        rest = self._word(word) >> (place % 64) << (place % 64)
        while (ones := rest.bit_count()) <= need:
            need -= ones
            word += 1
            rest = self._word(word)
        for _ in range(need):
            rest &= rest - 1
        upper = 64 * word + (rest & -rest).bit_length() - 1 - i
        first = i * self.low_bits
        held = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return upper << self.low_bits | held >> first % 8 & (1 << self.low_bits) - 1

    def _word(self, k: int) -> int:
        return int.from_bytes(self.high[8 * k : 8 * k + 8].tobytes(), "little")

    def all(self):
        """Every value."""
        import numpy as np

        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        upper = (ones - np.arange(self.n)).astype(np.uint64)
        if not self.low_bits:
            return upper
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return upper << np.uint64(self.low_bits) | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def write_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The file for documents in ascending order of doc_id, nulls first; ids are little-endian unsigned 32-bit."""
    import numpy as np

    known = np.array([d for d in doc_ids if d is not None], np.int64)
    whole = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(whole) or int(whole.max()) < 1 << 16 else 4
    least = int(known[0]) if len(known) else 0
    head = HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), len(whole), least, width)
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids]))
    names = EliasFano.of(known.view(np.uint64) - np.uint64(least % (1 << 64)))
    return head + ends.to_bytes() + names.to_bytes() + whole.astype(f"<u{width}").tobytes()


class Shard:
    """A shard file's content: doc_id, boundaries and ids of any document without decoding the others."""

    def __init__(self, data: bytes):
        import numpy as np

        magic, self.n_docs, self.n_null, self.n_ids, self.least, width = HEADER.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ends, at = EliasFano.read(data, HEADER.size)
        self.names, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self._signed(self.names.select(i - self.n_null))

    def _signed(self, gap: int) -> int:
        return gap + self.least

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self._signed(int(x)) for x in self.names.all().tolist()]


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, ids_a_shard: int = 2_000_000) -> DataFrame:
    """Encodes documents (doc_id, text) and writes them to files under path, whose names are in their order; a row for each file."""
    ship(docs.sparkSession)

    def work(parts):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import batches, encoder

        part_no, tail = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        store, top = file_system(path)
        names: list = []
        held: list[bytes] = []
        n = made = 0

        def flush():
            nonlocal n, made
            store.create_dir(top, recursive=True)
            name = f"shard-{part_no:06d}-{made:05d}.eft"
            attempt = f"{top}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(attempt) as f:
                f.write(write_shard(names, held))
            store.move(attempt, f"{top}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [part_no], "shard": [made], "n_docs": [len(names)], "n_ids": [n]})
            names.clear()
            held.clear()
            n, made = 0, made + 1
            return row

        for part in parts:
            docs_, texts = part.column(0).to_pylist(), part.column(1)
            for a, b in batches(texts):
                for doc, ids in zip(docs_[a:b], encoder(tokenizer_path).encode(texts[a:b]), strict=True):
                    size = len(ids) // 4 + 1
                    if names and n + size > ids_a_shard:
                        yield flush()
                    names.append(doc)
                    held.append(b"".join((ids, tail)))
                    n += size
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(work, "file string, part long, shard long, n_docs long, n_ids long"), "shards")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone: boundaries by select."""
    ship(spark)

    def work(parts):
        import zlib

        import pyarrow as pa

        for part in parts:
            for name, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                shard = Shard(data.as_buffer())
                bounds = [shard.bounds(i) for i in range(shard.n_docs)]
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in bounds]
                columns = [pa.array([name] * shard.n_docs, pa.string()), pa.array(shard.doc_ids(), pa.int64()), pa.array([a for a, _ in bounds], pa.int64()), pa.array([b - a for a, b in bounds], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    held = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.eft").load(path)
    held = held.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = materialize(held.mapInArrow(work, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"), "documents")
    # Bases: a file follows those of its task, and a task's files those of the tasks before; one row for each task is added up.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.regexp_extract("file", PART, 1).cast("long"))
    files = materialize(files.withColumn("shard", F.regexp_extract("file", PART, 2).cast("long")), "files")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    files = files.withColumn("own", own).join(F.broadcast(parts), "part").select("file", (F.col("base") + F.col("own")).alias("base"))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the documents' ids to shard files and reads the boundaries and checksums back from them."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    files = write_shards(docs, path, tokenizer_path, end_id)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, path)


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
