"""Elias-Fano sequences and token shards: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from ibidem.llm import eliasfano as X

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 50), max_size=700))
def test_sequence(values):
    values = sorted(values)
    got, end = X.EliasFano.read(data := X.EliasFano.of(values).to_bytes(), 0)
    assert end == len(data) and got.all().tolist() == values
    assert [got.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        got.select(len(values))


def test_space():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    bits = 8 * len(X.EliasFano.of(values).to_bytes()) / len(values)
    assert bits < 2 + np.log2(values[-1] / len(values)) + 0.5


def test_shard():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 1, 70_000, 2)]
    shard = X.Shard(X.write_shard([None, -5, -5, 1 << 62], ids))
    assert shard.doc_ids() == [None, -5, -5, 1 << 62] and [shard.doc_id(i) for i in range(4)] == shard.doc_ids()
    assert shard.bounds(2) == (4, 70_004) and shard.ids[4:70_004].astype("<u4").tobytes() == ids[2]
    assert shard.ids.itemsize == 4 and X.Shard(X.write_shard([1], [ids[0]])).ids.itemsize == 2


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_query(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in X.op2(spark, tables).collect()), key=str) == expected(rows)


def test_edges(spark, tmp_path):
    rows = [(3, "a b"), (3, "a b"), (1, None), (2, ""), (None, "c"), (7, "word " * 9000), (-4, "x")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    files = X.write_shards(docs, f"file://{tmp_path}/t", PATH, ids_a_shard=5)
    assert files.count() >= 3
    assert sorted((tuple(r) for r in X.read_shards(spark, f"file://{tmp_path}/t").collect()), key=str) == expected(rows)
    assert X.encoded(docs.limit(0), PATH).count() == 0


def test_rows_come_through_select(spark, tables, monkeypatch):
    """Boundaries of the query are those that select returns, and no writer's report takes part."""
    files = X.write_shards(spark.read.parquet(f"{tables}/documents.parquet"), f"file://{X.scratch(spark, 'x').removeprefix('file://')}", PATH)
    assert set(files.columns) == {"file", "part", "shard", "n_docs", "n_ids"}
    values = np.cumsum(np.random.default_rng(3).integers(0, 5000, 3000))
    whole = X.EliasFano.read(X.EliasFano.of(values).to_bytes(), 0)[0]
    assert [whole.select(i) for i in range(3000)] == values.tolist() == whole.all().tolist()
    dense = X.EliasFano.of(np.repeat([0, 7, 7, 100_000], 700))
    assert [dense.select(i) for i in range(2800)] == dense.all().tolist()
