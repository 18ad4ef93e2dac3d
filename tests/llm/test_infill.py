"""Fill-in-the-middle: cuts against a list of all units, and the exact text rebuilt."""

import hashlib
import random
import re

import pytest

from ibidem.llm import infill as I

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", " a", "a ", "a b ", "\x0b\x0c\r\ta\x1cb\x85c\xa0d", "é è  z", "日本 語\n\nx 😀 y", "<P> a b c", "a<S>b c d e", "x <M", "< P> <S y> z", "word " * 500, "ß" * 3000 + " end"]


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or h[2] % 100 >= 50 or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(30))
def test_checkpoints(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "é", "語", "😀", " ", "  ", "\n", "\t"]) for _ in range(rng.choice([0, 1, 7, 200, 2000])))
    units = UNIT.findall(text)
    index = I.Checkpoints(text.encode(), rng.choice([1, 2, 3, 64]), rng.choice([1, 2, 5, 64, 1 << 20]))
    assert index.n == len(units) and index.n_points == len(text)
    assert len(index.at) <= 1 + len(units) / index.every
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.cut(k) == (len(before.encode()), len(before))
    with pytest.raises(IndexError):
        index.cut(index.n + 1)


def test_query(spark, tables):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = I.op13(spark, tables).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, prefix, middle, output = plain(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(texts[r.doc_id]))


def test_edges(spark):
    rows = [(i, t, f"x{i}", i) for i in range(12) for t in ODD] + [(None, t, None, 0) for t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `n chars` int")
    out = I.infilled(docs)
    assert out.columns == [*docs.columns, "infill"]
    from pyspark.sql import functions as F

    got = out.withColumn("back", I.restored(F.col("text"), F.col("infill.form"))).collect()
    want = sorted((str(d), *map(str, plain(d, t)), str(f), str(k), t or "") for d, t, f, k in rows)
    assert want == sorted((str(r.doc_id), *map(str, (r.infill.n, r.infill.form, r.infill.prefix_chars, r.infill.middle_chars, r.text)), str(r.form), str(r["n chars"]), r.back) for r in got)
    assert {r.infill.form for r in got} == {"plain", "psm", "spm"}
    assert I.infilled(docs.limit(0)).count() == 0


def test_long_text():
    text = "wörd " * 600_000 + "end"
    index = I.Checkpoints(text.encode())
    assert index.n == 600_001 and len(index.at) <= 1 + index.n / 64
    assert index.cut(599_999) == (6 * 599_999 - 1, 5 * 599_999 - 1)
    for doc_id in range(8):
        assert I.transform(doc_id, text) == plain(doc_id, text)
