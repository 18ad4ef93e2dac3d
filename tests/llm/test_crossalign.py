"""Cross-tokenizer alignment against whole texts encoded by the libraries and aligned one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from ibidem.llm import crossalign as C

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\tb\n\nc \r\nd", "if (x) {\r\n}\r\n", "};\r x", "\xa0 a\xa0 b \xa0c", "a　 b  c", "x\x85 y\x1c z", "don't can't  we'll", "日本 語\nテキスト", "😀😀 😀‍ x", "é é",
    "<|endoftext|> a<|endoftext|>", "<s> a </s><unk> <0x41>", "a▁b c", "▁", "\x00 a\x00", "=" * 300 + " " * 40 + "-" * 77, "word " * 3000, "xyz" * 2000, "\t\tcode\v\fmore", "﻿ x﻿", "ﬁ ½ ① Ａ",
]


@pytest.fixture(scope="module")
def both():
    return C.Tokenizers(A, B)


def tokens(both, text):
    """Ids and byte lengths of both for the whole text, or nothing."""
    if not text:
        return [], []
    a = [(i, both.bytes_a[i]) for i in both.a.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, both.bytes_b[i]) for i in both.b.encode(text)]
    spelled = f" {text}".encode()
    return (a, b) if b"".join(x for _, x in a) == spelled == b"".join(x for _, x in b) else ([], [])


def aligned(both, text):
    """n_a, n_b, groups, links as a list of id pairs: cuts are the offsets that both have."""
    a, b = tokens(both, text)
    ends = [set(), set()]
    for side, own in enumerate((a, b)):
        at = 0
        for _, x in own:
            at += len(x)
            ends[side].add(at)
    cuts, groups, links = ends[0] & ends[1], [([], [])], []
    for side, own in enumerate((a, b)):
        at = k = 0
        for i, x in own:
            groups[k][side].append(i)
            at += len(x)
            if at in cuts:
                k += 1
                if k == len(groups):
                    groups.append(([], []))
    groups = [g for g in groups if g[0]]
    for x, y in groups:
        links += [(i, j) for i in x for j in y]
    return len(a), len(b), groups, links


def plain(both, texts):
    found = [aligned(both, t) for t in texts]
    counts = Counter(p for *_, links in found for p in set(links))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for n_a, n_b, groups, links in found:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest, shown))
    return out


def test_safe_white_space(both):
    assert set(both.safe) == set(" \t\n\v\f")  # B has pieces such as ");\r"


def test_segments(both):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é\xa0　\t\n\r ▁".replace("▁", "") + "  ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    segments, counts = C.split(pa.array(texts, pa.string()), both.safe)
    parts, at = segments.to_pylist(), 0
    ids = both.encode(parts)
    for text, n in zip(texts, counts.tolist(), strict=True):
        own, coded = parts[at : at + n], ids[at : at + n]
        at += n
        assert "".join(own) == (f" {text}" if text else "")
        if text:
            assert [i for x, _ in coded for i in x] == both.a.encode(f" {text}", add_special_tokens=False).ids
            if "▁" not in text:
                assert [i for _, y in coded for i in y] == both.b.encode(text)
    assert at == len(parts)
    sliced, _ = C.split(pa.array(["zz", *texts], pa.string()).slice(1), both.safe)
    assert sliced.to_pylist() == parts


def test_query(spark, tables, both):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(docs, plain(both, [r.text for r in docs]), strict=True)}
    rows = C.op12(spark, tables).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {k: v[:7] for k, v in want.items()} and len(rows) == len(docs)


@pytest.mark.parametrize("block_bytes", [1, 400, C.BLOCK_BYTES])
def test_edges(spark, both, block_bytes):
    texts = ODD + ["a  b", "a  b", "Other words, and words."]
    rows = [(None if i % 5 == 4 else i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs int")
    want = sorted((str(d), *w) for (d, *_), w in zip(rows, plain(both, texts), strict=True))
    assert want == sorted((str(r.doc_id), *tuple(r)[1:]) for r in C.alignment(docs, A, B, block_bytes, with_groups=True).collect())
    assert C.alignment(docs.limit(0), A, B).count() == 0
    assert [tuple(r)[1:] for r in C.alignment(docs.where("text is null"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_many_pairs_by_join(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = C.composed(docs, A, B, 100_000)
    counts = C.pair_counts(rows)
    assert rows.count() > 1
    assert sorted(map(tuple, C.weighed(rows, counts, 0).collect())) == sorted(map(tuple, C.weighed(rows, counts).collect()))


def test_large_groups(monkeypatch, both, spark):
    """Groups whose links are counted by kinds of token give the same."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    want = sorted(map(tuple, C.alignment(docs, A, B).collect()))
    monkeypatch.setattr(C, "SLICE", 10)
    codes = pa.chunked_array([C.split(pa.array(["a b", "b c"]), both.safe)[0], C.split(pa.array(["c d a"]), both.safe)[0]]).dictionary_encode().combine_chunks()
    assert codes.dictionary.to_pylist() == [" a", " b", " c", " d"] and codes.indices.to_pylist() == [0, 1, 1, 2, 2, 3, 0]
    monkeypatch.setattr(C, "LISTED", 2)
    payloads = pa.array([both.align(s, *both.encode([s])[0]) for s in [" =====", " " + "😀" * 9, " a", " ▁"]], pa.binary())
    monkeypatch.setattr(C, "SEGMENTS", 1)
    few = C.Alignments(payloads)
    monkeypatch.setattr(C, "LISTED", 4096)
    monkeypatch.setattr(C, "SEGMENTS", 9)
    many = C.Alignments(payloads)
    for name in ("n_a", "n_b", "n_groups", "pairs", "pair", "times", "edges"):
        assert getattr(few, name).tolist() == getattr(many, name).tolist()
    assert few.n_groups[3] == 0 and want


def test_pairs_by_slice(both, monkeypatch):
    """The pairs of a block's documents are packed some documents at a time, so no array follows the whole block."""
    segments, counts = C.split(pa.array([f"word{i % 7} other{i} text" for i in range(400)]), both.safe)
    coded = segments.dictionary_encode()
    found = coded.dictionary.to_pylist()
    left = pa.table({"block": [0], "doc_ids": [list(range(400))], "ends": [counts.cumsum().tolist()], "codes": [C.packed(coded.indices.to_numpy())]})
    right = pa.table({"code": range(len(found)), "aligned": pa.array([both.align(s, *ids) for s, ids in zip(found, both.encode(found), strict=True)], pa.binary())})
    sizes, packed = [], C.packed
    monkeypatch.setattr(C, "SLICE", 100)
    monkeypatch.setattr(C, "packed", lambda numbers: sizes.append(len(numbers)) or packed(numbers))
    C._compose(left, right, False)
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 10
