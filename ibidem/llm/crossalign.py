"""Alignment of two tokenizers by segment deduplication.

A segment begins where white space follows a sign that is none. The vocabularies are read to see which white space neither
can merge with a sign before it (all but the carriage return, for the two at hand), and texts are split before that alone;
so the tokens of a text are those of its segments, joined. Most segments repeat, so each distinct one is encoded by both
tokenizers and aligned once in the whole corpus:

* documents are gathered to blocks of about `block_bytes` of text; a block is one row: its distinct segments, and its
  documents as numbers of these. Texts are read once and not shuffled;
* the segments of all blocks are dealt out and sorted, so equal ones follow one another in one task, which encodes and aligns
  a segment where it first comes and gives the alignment to every block that has it;
* blocks and their alignments meet and documents are composed: ids, groups and links of each.

A segment is in a block at most once, so even the commonest is one row a block, and no task holds more than a row of them.
Id pairs are counted within a block before they are shuffled; the counts are looked up by broadcast while pairs are few, and
else joined to the pairs of the blocks.

Groups are what lies between byte offsets where tokens of both end; the links of a group are all pairs of its tokens, held
as distinct id pairs with their number, so a long group takes no more room than its kinds of token.

Defined results: null or empty text has no tokens, as has a text that the tokens of one side don't spell out (U+2581 in it);
null doc_id is kept, repeated rows are documents of their own; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, table

BLOCK_BYTES = 20_000_000
BROADCAST_PAIRS = 4_000_000
SPACES = "\t\n\v\f\r "
#: What some library takes for white space: no segment begins right after one of these.
BLANK = frozenset(map(ord, SPACES)) | {0x85, 0xA0, 0x1680, 0x180E, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF} | set(range(0x1C, 0x20)) | set(range(0x2000, 0x200C))
BLOCKS = "block long, doc_ids array<long>, ends array<long>, codes binary, segments array<string>"
COMPOSED = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, pairs array<long>, borders array<long>, codes array<binary>, times array<binary>"
WEIGHED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
#: What ends each side of a group in an alignment; an id beyond it needs 32 bits.
END = 0xFFFF
#: Distinct segments whose alignments are read at a time, and segments of the documents that are composed at a time.
SEGMENTS, SLICE = 10_000, 30_000
#: Links of one group that are written out one by one; larger groups are counted by kinds of token first.
LISTED = 4096


class Tokenizers:
    """The byte-level tokenizer A and the piece tokenizer B, over segments."""

    def __init__(self, path_a: str, path_b: str):
        import json

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        signs = _byte_signs()
        self.bytes_a = {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.blank = self.b.piece_to_id("▁")
        step = json.loads(self.a.pre_tokenizer.__getstate__()) if self.a.pre_tokenizer else {}  # without the vocabulary, which is large
        regular = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and self.a.normalizer is None
        if max(*self.bytes_a, len(self.bytes_b)) > END:
            raise ValueError("an id takes more than 16 bits")
        self.safe = "".join(c for c in SPACES if not self._merged(c)) if regular else ""

    def _merged(self, space: str) -> bool:
        """Whether some entry of a vocabulary goes on with this sign after one that isn't white space, or B's own first blank merges with it."""
        for entry in [*self.bytes_a.values(), *self.bytes_b]:
            at = entry.find(space.encode(), 1)
            while at > 0:
                if ord(entry[:at].decode(errors="replace")[-1]) not in BLANK:
                    return True
                at = entry.find(space.encode(), at + 1)
        return space != " " and any(entry.startswith(f" {space}".encode()) for entry in self.bytes_b)

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each segment. B puts a blank before what it encodes: that stands for a segment's first space, and
        goes again where a segment begins with other white space."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s.removeprefix(" ") for s in segments], num_threads=1)
        return [(x, (y or [self.blank]) if s.startswith(" ") else y[1:]) for s, x, y in zip(segments, a, b, strict=True)]

    def align(self, segment: str, a: list[int], b: list[int]) -> bytes | None:
        """The groups: ids of A, END, ids of B, END, and so on, 16 bits each; None where the ids don't spell the segment."""
        spelled = segment.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != spelled or b"".join(map(self.bytes_b.__getitem__, b)) != spelled:
            return None
        out, i, j = array("H"), 0, 0
        while i < len(a):
            first_a, first_b, end_a, end_b = i, j, len(self.bytes_a[a[i]]), len(self.bytes_b[b[j]])
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a += len(self.bytes_a[a[i]])
                    i += 1
                else:
                    end_b += len(self.bytes_b[b[j]])
                    j += 1
            out.extend(a[first_a:i])
            out.append(END)
            out.extend(b[first_b:j])
            out.append(END)
        return out.tobytes()


def _byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write each byte as: itself where it shows, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


_held: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair per worker process and files."""
    if (path_a, path_b) not in _held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _held[path_a, path_b] = Tokenizers(path_a, path_b)
    return _held[path_a, path_b]


def split(texts, safe: str):
    """The segments of space + text of each text of an Arrow array (null: none) as one large_string array, and how many each has."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), nothing)
    whole = pc.if_else(pc.not_equal(texts, nothing), pc.binary_join_element_wise(space, texts, nothing), nothing)
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    start, stop = int(ends[0]), int(ends[-1])
    view = np.frombuffer(data, np.uint8)[start:stop] if stop > start else np.zeros(0, np.uint8)
    begins = np.zeros(len(view) + 1, bool)
    if len(view):
        begins[1:-1] = _table(safe)[view[1:]] & ~_table(map(chr, BLANK & set(range(128))))[view[:-1]]
        odd = np.flatnonzero(begins)
        odd = odd[view[odd - 1] >= 0x80]  # the sign before has several bytes: is it white space?
        begins[odd] = ~_blank_before(view, odd)
    begins[ends - start] = True
    edges = np.flatnonzero(begins)
    counts = np.searchsorted(edges, ends[1:] - start) - np.searchsorted(edges, ends[:-1] - start)
    segments = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64) + start), data])
    return segments, counts


def _table(signs):
    import numpy as np

    out = np.zeros(256, bool)
    out[[ord(c) for c in signs]] = True
    return out


def _blank_before(view, at):
    import numpy as np

    def last(n):
        places = np.maximum(at[:, None] - np.arange(n, 0, -1), 0)
        return (view[places].astype(np.int64) << (8 * np.arange(n - 1, -1, -1))).sum(axis=1)

    kinds = {n: [int.from_bytes(chr(c).encode(), "big") for c in BLANK if len(chr(c).encode()) == n] for n in (2, 3)}
    return np.isin(last(2), kinds[2]) | np.isin(last(3), kinds[3])


def packed(numbers):
    """Numbers of 32 bits as bytes, compressed: small ones are frequent, so their bytes go by place."""
    import numpy as np
    import pyarrow as pa

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes):
    import numpy as np
    import pyarrow as pa

    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _list(values, kind):
    """An Arrow array of one list."""
    import pyarrow as pa

    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents by blocks, written: distinct segments of a block, the numbers of its documents' segments, where each document ends."""
    ship(docs.sparkSession)

    def work(parts):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import batches

        held: list = []
        size, name = 0, TaskContext.get().partitionId() << 32

        def block():
            names = pa.concat_arrays([x for x, _ in held])
            cut = [split(texts, tokenizers(path_a, path_b).safe) for _, texts in held]
            held.clear()
            ends = np.cumsum(np.concatenate([n for _, n in cut]))
            coded = pa.chunked_array([x for x, _ in cut]).dictionary_encode().chunks  # with one dictionary
            codes = np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in coded)])
            columns = [pa.array([name]), _list(names, pa.int64()), _list(ends, pa.int64()), pa.array([packed(codes)], pa.binary()), _list(coded[-1].dictionary if coded else pa.array([], pa.string()), pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "ends", "codes", "segments"])

        for part in parts:
            for a, b in batches(part.column(1), min(block_bytes, 8_000_000) // 2):
                few = part.slice(a, b - a)
                more = few.column(1).nbytes
                if held and size + more > block_bytes:
                    yield block()
                    size, name = 0, name + 1
                held.append((few.column(0), few.column(1)))
                size += more
        if held:
            yield block()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(named.mapInArrow(work, BLOCKS), "blocks")


def aligned(segments: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """of, code, aligned for rows (of, code, segment): every distinct segment is encoded and aligned once."""

    def work(parts):
        import pyarrow as pa

        from .tokens import batches

        both, last, result = tokenizers(path_a, path_b), None, None
        for part in parts:
            for a, b in batches(part.column(2), 200_000):
                few = part.slice(a, b - a)
                names = few.column(2).to_pylist()
                new = [s for s, before in zip(names, [last, *names], strict=False) if s != before]
                found, out = zip(new, both.encode(new), strict=True), []
                for s in names:
                    if s != last:
                        last, ids = next(found)
                        result = both.align(s, *ids)
                    out.append(result)
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(out, pa.binary())], ["of", "code", "aligned"])

    return segments.repartition("segment").sortWithinPartitions("segment").mapInArrow(work, "of long, code int, aligned binary")


class Alignments:
    """The alignments of a block's segments: numbers of ids and groups, groups as text, and links as distinct id pairs. They are
    read some at a time, so little more than the result is in memory."""

    def __init__(self, payloads):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        payloads = pc.fill_null(payloads.cast(pa.large_binary()), b"")
        parts = [self._part(payloads[k : k + SEGMENTS]) for k in range(0, len(payloads), SEGMENTS)]
        parts = parts or [self._part(payloads)]
        self.n_a, self.n_b, self.n_groups, n_links = (np.concatenate([x[k] for x in parts]) for k in range(4))
        self.groups = pa.concat_arrays([x[4] for x in parts])
        self.pairs = np.unique(np.concatenate([np.unique(x[5]) for x in parts]))
        self.pair = np.concatenate([np.searchsorted(self.pairs, x[5]).astype(np.int32) for x in parts])  # by number
        self.times = np.concatenate([x[6] for x in parts])
        self.edges = np.concatenate([[0], np.cumsum(n_links)])

    def _part(self, payloads) -> tuple:
        """n_a, n_b, n_groups and numbers of distinct links of some segments, their groups, the links one after the other, and how often."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        _, offsets, data = payloads.buffers()
        edges = np.frombuffer(offsets, np.int64)[payloads.offset : payloads.offset + len(payloads) + 1] // 2
        flat = np.frombuffer(data, np.uint16)[edges[0] : edges[-1]].astype(np.int64) if data else np.zeros(0, np.int64)
        n = len(payloads)
        ends = np.flatnonzero(flat == END)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
        sizes = ends - starts
        first, last = (np.searchsorted(ends, e - edges[0]) // 2 for e in (edges[:-1], edges[1:]))  # groups of each segment
        of = np.repeat(np.arange(n), last - first)
        n_a, n_b = (np.bincount(of, sizes[k::2], minlength=n).astype(np.int64) for k in (0, 1))
        kinds, at = np.unique(flat, return_inverse=True)
        digits = pa.array(map(str, kinds.tolist()), pa.large_string())
        sides = [self._joined(digits.take(pa.array(at[_spread(starts[k::2], sizes[k::2])])), sizes[k::2], ",") for k in (0, 1)]
        groups = self._joined(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), last - first, ";")
        listed = sizes[0::2] * sizes[1::2] <= LISTED
        rows = np.flatnonzero(listed)
        n_links = sizes[0::2][rows] * sizes[1::2][rows]
        at = _spread(np.zeros(len(rows), np.int64), n_links)
        group = np.repeat(rows, n_links)
        x, y = flat[starts[0::2][group] + at // sizes[1::2][group]], flat[starts[1::2][group] + at % sizes[1::2][group]]
        pairs, times, owners = [x << 32 | y], [np.ones(len(at), np.int64)], [of[group]]
        for g in np.flatnonzero(~listed):
            (x, n_x), (y, n_y) = (np.unique(flat[starts[k] : ends[k]], return_counts=True) for k in (2 * g, 2 * g + 1))
            pairs.append((x[:, None] << 32 | y[None]).ravel())
            times.append((n_x[:, None] * n_y[None]).ravel())
            owners.append(np.full(len(pairs[-1]), of[g]))
        owner, pair, times = summed(np.concatenate(owners), np.concatenate(pairs), np.concatenate(times))
        return n_a, n_b, last - first, np.bincount(owner, minlength=n), groups, pair, times

    @staticmethod
    def _joined(texts, sizes, sign: str):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(edges, texts), pa.scalar(sign, pa.large_string()))


def _spread(starts, sizes):
    """starts[k], starts[k] + 1, ... of each run of so many places."""
    import numpy as np

    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[: len(sizes)], sizes) + np.arange(int(sizes.sum()))


def summed(rows, columns, values):
    """Sums of values of equal (row, column), in order."""
    import numpy as np

    order = np.lexsort((columns, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
    at = np.flatnonzero(new)
    return rows[at], columns[at], np.add.reduceat(values, at) if len(at) else values


def _compose(left, right, with_groups: bool):
    """The documents of one block: left is its row, right its segments' alignments."""
    import numpy as np
    import pyarrow as pa

    own = Alignments(right.sort_by("code").column("aligned").combine_chunks())
    names, ends = (left.column(c).combine_chunks().flatten() for c in ("doc_ids", "ends"))
    ends, codes = ends.to_numpy(), unpacked(left.column("codes")[0].as_py())
    made, a = [], 0
    while a < len(ends):  # some documents at a time; their pairs are packed before the next come
        start = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, start + SLICE, side="right")))
        *few, pair, times = _compose_some(own, codes[start : ends[b - 1]].astype(np.int64), np.diff(ends[a:b], prepend=start), with_groups)
        made.append((*few, packed(pair), packed(times)))
        a = b
    kinds = [*(pa.int64() for _ in range(4)), pa.string(), pa.string()]
    lists = [pa.chunked_array([x[k] for x in made], t).combine_chunks() for k, t in enumerate(kinds)]
    borders = np.concatenate([[0], np.cumsum(np.concatenate([x[6] for x in made]))])
    columns = [left.column("block"), _list(names, pa.int64()), *(_list(x, k) for x, k in zip([*lists, own.pairs, borders], [*kinds, pa.int64(), pa.int64()], strict=True))]
    return columns + [_list(pa.array([x[k] for x in made], pa.binary()), pa.binary()) for k in (7, 8)]


def _compose_some(own: Alignments, codes, sizes, with_groups: bool) -> tuple:
    """n_a, n_b, n_groups, n_links, digests and groups of documents whose segments are codes, so many each; how many pairs each
    has, and these and how often, by number."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    keep = (np.bincount(doc[own.n_groups[codes] == 0], minlength=n) == 0)[doc]
    doc, codes = doc[keep], codes[keep]
    totals = [np.bincount(doc, x[codes], minlength=n).astype(np.int64) for x in (own.n_a, own.n_b, own.n_groups)]
    groups = own._joined(own.groups.take(pa.array(codes)), np.bincount(doc, minlength=n), ";")
    digests = [hashlib.sha256(g.as_buffer()).hexdigest() if k else "" for g, k in zip(groups, totals[2].tolist(), strict=True)]
    # Distinct segments of each document, then their links, added up for each document and pair.
    of, code, times = summed(doc, codes, np.ones(len(doc), np.int64))
    n_links = np.diff(own.edges)[code]
    at = _spread(own.edges[code], n_links)
    of, pair, times = summed(np.repeat(of, n_links), own.pair[at], own.times[at] * np.repeat(times, n_links))
    links = np.bincount(of, times, minlength=n).astype(np.int64)
    shown = groups.cast(pa.string()) if with_groups else pa.nulls(n, pa.string())
    return *map(pa.array, totals), pa.array(links), pa.array(digests, pa.string()), shown, np.bincount(of, minlength=n), pair, times


def composed(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES, with_groups: bool = False) -> DataFrame:
    """A row for each block, written: its documents' numbers of tokens, groups and links, digests of the groups (and the groups, if
    wanted), the block's distinct id pairs, and by number which each document has linked how often."""
    import pyarrow as pa

    held = blocks(docs, path_a, path_b, block_bytes)
    segments = held.select(F.col("block").alias("of"), F.posexplode("segments").alias("code", "segment"))
    names = [f.split()[0] for f in COMPOSED.split(", ")]

    def compose(left, right):
        return pa.Table.from_arrays(_compose(left, right, with_groups), names)

    found = aligned(segments, path_a, path_b).groupBy("of")
    return materialize(held.drop("segments").groupBy("block").cogroup(found).applyInArrow(compose, COMPOSED), "composed")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, how many documents hold it linked, and whether no pair of its A id is held by more; written."""

    def work(parts):
        import numpy as np
        import pyarrow as pa

        for part in parts:
            for pairs, codes in zip(part.column(0), part.column(1), strict=True):
                n = np.zeros(len(pairs.values), np.int64)
                for few in codes.values:
                    n += np.bincount(unpacked(few.as_py()), minlength=len(n))  # a document has a pair once
                keep = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(pairs.values.to_numpy()[keep]), pa.array(n[keep])], ["pair", "n"])

    counted = rows.select("pairs", "codes").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialize(counted.select("pair", "n", F.shiftright("pair", 32).alias("a")), "pairs")
    top = counted.groupBy("a").agg(F.max("n").alias("top"))
    return materialize(counted.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")


def _weigh(block, n, best):
    """Rows of a block's documents, from the counts of its pairs; some documents' pairs are unpacked at a time."""
    import numpy as np
    import pyarrow as pa

    columns = {c: block.column(c).combine_chunks().flatten() for c in block.column_names if c != "block"}
    borders, start = columns["borders"].to_numpy(), 0
    n_best, count_sum = np.zeros((2, len(columns["doc_ids"])), np.int64)
    for few in zip(columns["codes"], columns["times"], strict=True):
        code, times = (unpacked(x.as_py()).astype(np.int64) for x in few)
        size = np.diff(np.clip(borders, start, start + len(code)))
        own = np.flatnonzero(size)
        first, start = np.cumsum(size[own]) - size[own], start + len(code)
        if len(own):  # the pairs of a document follow one another
            n_best[own] = np.add.reduceat(np.where(best[code], times, 0), first)
            count_sum[own] = np.add.reduceat(times * n[code], first)
    columns |= {"doc_id": columns["doc_ids"], "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    names = [f.split()[0] for f in WEIGHED.split(", ")]
    return pa.Table.from_arrays([columns[c] for c in names], names)


def weighed(rows: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each document, with n_best and count_sum, from the counts of all documents' pairs."""
    if counts.count() > most:
        own = rows.select(F.col("block").alias("of"), F.posexplode("pairs").alias("code", "pair"))
        met = own.join(counts, "pair", "left").select("of", "code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(False)).alias("best"))

        def compose(left, right):
            right = right.sort_by("code")
            return _weigh(left, right.column("n").to_numpy(), right.column("best").to_numpy())

        return rows.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(compose, WEIGHED)
    table_ = counts.orderBy("pair").toArrow()  # `most` rows of 17 bytes at most
    known = rows.sparkSession.sparkContext.broadcast([table_.column(c).to_numpy() for c in ("pair", "n", "best")])

    def work(parts):
        import numpy as np
        import pyarrow as pa

        pairs, n, best = known.value
        for part in parts:
            for k in range(len(part)):
                block = pa.Table.from_batches([part.slice(k, 1)])
                own = block.column("pairs").combine_chunks().flatten().to_numpy()
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))  # pairs of no document have no count, and no use
                yield from _weigh(block, n[at] if len(n) else own, best[at] if len(n) else own > 0).to_batches()

    return rows.mapInArrow(work, WEIGHED)


def alignment(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document, and its groups if wanted."""
    rows = composed(docs, path_a, path_b, block_bytes, with_groups)
    out = weighed(rows, pair_counts(rows))
    return out if with_groups else out.drop("groups")


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
