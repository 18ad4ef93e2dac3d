"""WARC archives: writing, deduplicating by revisit, and normalising a monolithic gzip file.

Pages become WARC/1.1 records. Of equal payloads of at least 1000 bytes the one with the largest page_id is a response and
the others are revisits that refer to it; a revisit keeps the HTTP headers (with the payload's length) and no payload.
Each task first writes its records as one gzip stream over the whole file, as naive tools do. The normaliser inflates that
stream once, in bounded pieces, finds the records by their Content-Length, writes each as a gzip member of its own and
notes every member's offset and length in a sidecar index. Any record can then be read alone, which is how they are read
back, and payload digests are verified then.

Which page a revisit refers to is a partial aggregate per digest and a join on the digest. The payloads that occur twice are
broadcast while they're at most MOST_SHARED, so that pages aren't shuffled; beyond that they're joined by shuffle, where
adaptive execution splits a payload that a third of the pages share. Archives are rolled at
`bytes_a_file`. Files are written under a name of their own attempt and renamed at the end, so repeated tasks do no harm.

Defined results: null html is an empty payload; null page_ids come last in precedence, and if only such share a payload
each is a response; repeated page_ids with the chosen id are all responses; an empty table gives no archives and an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, materialize, scratch, ship

LEAST_PAYLOAD = 1000
MOST_SHARED = 500_000  # digests of 40 signs and an id
CHUNK = 1 << 20
WHEN = "2024-01-01T00:00:00Z"


def record(page_id, url, kind: str, refers_to, digest: str, n_bytes: int, payload: bytes) -> bytes:
    """One WARC record; of a revisit the HTTP block ends after its headers."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    if kind == "response":
        block += payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": "".join(c for c in url or "" if c not in "\r\n"),
        "WARC-Date": WHEN,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def inflate(source, size: int = CHUNK):
    """The bytes of a gzip file of one or many members, in pieces of bounded size."""
    unpack = zlib.decompressobj(31)
    while data := source.read(size):
        while data:
            piece = unpack.decompress(data, 4 * size)
            if piece:
                yield piece
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)


def records(pieces):
    """Whole records from pieces of an inflated archive."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's headers")
                return
        size = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:size])
        del held[:size]


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def normalise(source, archive, index) -> int:
    """Rewrites a gzip archive with one member for each record, and writes offset, length and record id to the index."""
    offset = n = 0
    for whole in records(inflate(source)):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(whole) + pack.flush()
        archive.write(member)
        name = fields(whole[: whole.index(b"\r\n\r\n")])["warc-record-id"]
        index.write(f"{offset} {len(member)} {name}\n".encode())
        offset, n = offset + len(member), n + 1
    return n


def with_revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of every page."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    known = known.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "UTF-8"))})
    first = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.encode(text, "UTF-8")).alias("digest"), F.octet_length(text).alias("n"))
    first = first.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("of")).where("of > 1").select("digest", "first")
    first = materialize(first, "shared")
    few = first.limit(MOST_SHARED + 1).count() <= MOST_SHARED
    out = known.join(F.broadcast(first) if few else first, known["payload_digest"] == first["digest"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))}).drop("digest", "first", "of")


def write_archives(pages: DataFrame, path: str, bytes_a_file: int = 128 << 20) -> DataFrame:
    """Writes pages as archives under path, normalises them, and returns archive, index and records of each."""
    ship(pages.sparkSession)

    def work(parts):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        store, top = file_system(path)
        store.create_dir(top, recursive=True)
        number, made, out, size = TaskContext.get().partitionId(), 0, None, 0

        def finish():
            nonlocal made, out
            out.write(pack.flush())
            out.close()
            name = f"pages-{number:06d}-{made:05d}"
            with store.open_input_stream(f"{top}/{attempt}.mono") as source, store.open_output_stream(f"{top}/{attempt}.warc") as archive, store.open_output_stream(f"{top}/{attempt}.idx") as index:
                n = normalise(source, archive, index)
            store.delete_file(f"{top}/{attempt}.mono")
            store.move(f"{top}/{attempt}.warc", f"{top}/{name}.warc.gz")
            store.move(f"{top}/{attempt}.idx", f"{top}/{name}.warc.idx")
            made, out = made + 1, None
            return pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "index": [f"{name}.warc.idx"], "n_records": [n]})

        for part in parts:
            for i in range(part.num_rows):
                page_id, url, html, n_bytes, digest, kind, refers = (part.column(k)[i].as_py() for k in range(7))
                if out is None:
                    attempt, size = f"_{uuid.uuid4().hex}", 0
                    out, pack = store.open_output_stream(f"{top}/{attempt}.mono"), zlib.compressobj(1, zlib.DEFLATED, 31)
                whole = record(page_id, url, kind, refers, digest, n_bytes, html.encode() if kind == "response" else b"")
                out.write(pack.compress(whole))
                size += len(whole)
                if size >= bytes_a_file:
                    yield finish()
        if out is not None:
            yield finish()

    rows = pages.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return materialize(rows.mapInArrow(work, "archive string, index string, n_records long"), "archives")


def read_archives(spark: SparkSession, path: str, archives: DataFrame, records_a_task: int = 2000) -> DataFrame:
    """One row for each record, read from its own member by the offsets of the sidecar indexes. Full payloads are verified."""
    ship(spark)

    def entries(parts):
        import pyarrow as pa

        store, top = file_system(path)
        for part in parts:
            for archive, index in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{top}/{index}") as f:
                    rows = [tuple(map(int, x.split(b" ", 2)[:2])) for x in f.read().splitlines()]
                for k in range(0, len(rows), records_a_task):
                    own = rows[k : k + records_a_task]
                    yield pa.RecordBatch.from_pydict({"archive": [archive], "start": [own[0][0]], "sizes": [[n for _, n in own]]})

    def work(parts):
        import hashlib

        import pyarrow as pa

        store, top = file_system(path)
        number = lambda x: int(m) if (m := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for part in parts:
            for archive, start, sizes in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                rows = []
                with store.open_input_file(f"{top}/{archive}") as f:
                    f.seek(start)
                    for size in sizes:
                        whole = zlib.decompress(f.read(size), 31)
                        end = whole.index(b"\r\n\r\n")
                        head = fields(whole[:end])
                        body = whole.index(b"\r\n\r\n", end + 4) + 4
                        n, digest = int(fields(whole[end + 4 : body - 4])["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response":
                            payload = whole[body:-4]
                            if hashlib.sha1(payload).hexdigest() != digest or len(payload) != n:
                                raise ValueError(f"a payload of {archive} isn't what its record says")
                        rows.append((number(head["warc-record-id"]), head["warc-target-uri"], n, digest, head["warc-type"], number(head["warc-refers-to"]) if "warc-refers-to" in head else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spans = archives.select("archive", "index").mapInArrow(entries, "archive string, start long, sizes array<long>")
    spans = spans.repartition(max(2 * spark.sparkContext.defaultParallelism, 2), "archive", "start")
    return spans.mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages to normalised archives and reads every record back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    return read_archives(spark, path, write_archives(with_revisits(pages), path))


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
