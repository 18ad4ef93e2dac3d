"""Packing: every piece once, gapless, within capacity, few sequences; ids as the library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from ibidem.llm import packing as P
from ibidem.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "a\t b  \n c", "x!\x1c y", " lead", "tail ", "", "a  b\n\nc \n", "é è  z", "don't can't", "1 2\n3", "<|endoftext|> a", "q <|endoftext|> a<|endoftext|>b\nz", "a\r\n b", "\x85 a\x85 b", "abc\nd… e\nf", "\n", "…", None, "日本 語\nx", "a​b c", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def plain(encoder, text):
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder(encoder, spark, tables):
    texts = ODD + [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert all(bytes(got) == plain(encoder, t) for t, got in zip(texts, encoder.encode(pa.array(texts)), strict=True))


def check(rows, texts, encoder, capacity):
    of, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        at = 0
        for r in held:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, text in texts.items():
        ids = plain(encoder, text) + (2).to_bytes(4, "little")
        own, at = sorted(of[doc], key=lambda r: r.piece), 0
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)]) and (len(own) == 1 or r.piece == 0 or r.length == capacity)
            at += r.length
        assert at * 4 == len(ids) and (len(own) > 1) == (len(ids) > 4 * capacity)
    return len(bins)


def test_query(spark, tables, encoder):
    rows = P.op7(spark, tables).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    bins = check(rows, texts, encoder, 1024)
    assert bins <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1


def test_edges(spark, encoder):
    texts = {i: t for i, t in enumerate(ODD)} | {100: "word " * 5000, None: "x y"}
    docs = spark.createDataFrame([(k, v, 1, "s") for k, v in texts.items()], "doc_id long, text string, length int, offset string")
    check(P.packed(docs, PATH, 64).collect(), texts, encoder, 64)
    twice = P.packed(docs.unionAll(docs), PATH, 64)
    assert twice.count() == 2 * P.packed(docs, PATH, 64).count()
    assert P.packed(docs.limit(0), PATH).count() == 0
    for r in P.sequences(docs, PATH, 64).collect():
        assert len(r.ids) == 4 * sum(p.length for p in r.pieces) <= 4 * 64


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 200))}
    runs = P.plan(counts, capacity)
    of = defaultdict(list)
    for size, rank, sequence, offset in runs:
        of[size].append((rank, sequence, offset))
    bins = defaultdict(list)
    for size, n in counts.items():
        own = of[size]
        assert [r for r, _, _ in own] == sorted(r for r, _, _ in own)
        for (rank, sequence, offset), nxt in zip(own, [r for r, _, _ in own[1:]] + [n], strict=True):
            for k in range(nxt - rank):
                bins[sequence + k].append((offset, size))
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity
    # No two sequences could be joined, beyond what greedy packing leaves: at most one is half empty.
    assert sum(sum(s for _, s in held) * 2 <= capacity for held in bins.values()) <= 1


def test_large_pairs_are_most():
    assert len({s for _, _, s, _ in P.plan({7: 2, 3: 2, 5: 2}, 10)}) <= 3
    with pytest.raises(ValueError):
        P.plan({11: 1}, 10)
