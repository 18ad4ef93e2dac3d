"""Encoding with the `tokenizers` library, each distinct piece of a batch once.

Byte-level BPE never merges across a pre-token, and no pre-token holds a non-space followed by white space. Where a text
has no two white-space signs in a row, cutting it before each space or line feed is cutting at pre-token borders, so the
ids of the pieces, joined, are the ids of the text. Most pieces repeat: the distinct ones of a batch are encoded as one
text, their ids are told apart by the bytes they stand for, and Arrow joins them into the ids of the texts. Texts with
other white space are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in a row or at an end, and any sign other than space and line feed that a tokenizer may take for white space.
IRREGULAR = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has one sign for each byte
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.feed = len(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def encode(self, texts: pa.Array) -> list[memoryview | bytes]:
        """The ids of each text as bytes; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list = [b""] * len(texts)
        filled = pc.not_equal(texts, "")
        odd = pc.and_(filled, pc.match_substring_regex(texts, IRREGULAR))
        even = np.flatnonzero(pc.and_not(filled, odd).to_numpy(zero_copy_only=False))
        if len(even):
            rows = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
            coded = rows.values.dictionary_encode()
            first = np.zeros(len(coded), bool)  # a text's first piece has no space before it
            first[rows.offsets.to_numpy()[:-1]] = True
            number = coded.indices.to_numpy().astype(np.int64) * 2 + first
            seen = np.zeros(2 * len(coded.dictionary), bool)
            seen[number] = True
            used = np.flatnonzero(seen)
            place = np.cumsum(seen) - 1
            joined = self._pieces(coded.dictionary.take(pa.array(used >> 1)), (used & 1).astype(bool)).take(pa.array(place[number]))
            _, offsets, data = joined.buffers()
            ends = np.frombuffer(offsets, np.int64)[: len(joined) + 1][rows.offsets.to_numpy()].tolist()
            view = memoryview(data).cast("B")
            for k, i in enumerate(even.tolist()):
                out[i] = view[ends[k] : ends[k + 1]]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i].as_py() for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _pieces(self, names: pa.Array, first) -> pa.Array:
        """The ids of pieces; a first piece gets a line feed before it, whose ids go again, and others their space."""
        before = np.where(first, "\n", np.where(pc.starts_with(names, "\n").to_numpy(zero_copy_only=False), "", " "))
        spaced = pc.binary_join_element_wise(pa.array(before, pa.large_string()), names, pa.scalar("", pa.large_string()))
        _, offsets, data = spaced.buffers()
        borders = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        ids = [np.zeros(0, "<u4")]
        for k in range(0, len(names), 50_000):  # the library's own results take some hundred bytes an id
            text = str(memoryview(data)[borders[k] : borders[min(k + 50_000, len(names))]], "utf-8")
            ids.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
        ids = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        at = np.minimum(np.searchsorted(ends, borders - borders[0]), len(ends) - 1)
        if not (ends[at] == borders - borders[0]).all():  # e.g. an added token with white space of its own
            alone = self.tokenizer.encode_batch_fast(pc.if_else(pa.array(first), names, spaced).to_pylist(), add_special_tokens=False)
            return pa.array([np.array(e.ids, dtype="<u4").tobytes() for e in alone], pa.large_binary())
        keep = np.ones(len(ids), bool)
        for k in range(self.feed):
            keep[at[:-1][first] + k] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer((kept[at] * 4).astype(np.int64)), pa.py_buffer(ids[keep].tobytes())])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches(texts: pa.Array, most_bytes: int = 8_000_000):
    """Index ranges of consecutive texts of about most_bytes in all, so that memory doesn't follow the Arrow batch."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
        yield start, end
        start = end
