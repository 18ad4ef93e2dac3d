"""Near-duplicates against brute force; exactness of the covering; nulls, ties and empty tables."""

import re

import numpy as np
import xxhash

from ibidem.llm import simhash as S

LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points, threshold):
    parent = list(range(len(points)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= threshold:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(points))]


def test_query(spark, tables):
    found = S.op10(spark, tables).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    points = [int(r.fingerprint, 16) for r in found]
    assert len(found) == len(docs) and all(p == fingerprint(docs[r.doc_id]) for p, r in zip(points, found))
    least = {}
    tops = groups(points, 2)
    for t, r in zip(tops, found):
        least[t] = min(least.get(t, r.doc_id), r.doc_id)
    assert all(r.component_id == least[t] for t, r in zip(tops, found))


def test_golay_covers():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.int64).view(np.uint64)
    gap = np.bitwise_count((x & np.uint64((1 << 46) - 1)) ^ S.nearest_anchor(x))
    assert gap.max() <= 6
    assert (S.nearest_anchor(S.nearest_anchor(x)) == S.nearest_anchor(x)).all()


def test_links_are_exact(spark):
    rng = np.random.default_rng(1)
    points = set()
    for b in rng.integers(0, 1 << 63, 15, dtype=np.int64).tolist():
        points.add(b)
        for _ in range(20):
            x = b
            for k in rng.integers(0, 64, 3).tolist():
                x ^= (1 << k) if k < 63 else -(1 << 63)
            points.add(x)
    points = sorted(points)
    frame = spark.createDataFrame([(p,) for p in points], "fp long")
    expected = {(a, b) for a in points for b in points if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert {(r.a, r.b) for r in S.links(frame, 2, most=10**6).collect()} == expected
    quiet = {(r.node, r.root) for r in S.components(S.links(frame, 2, most=10**6)).collect()}
    assert {(r.node, r.root) for r in S.components(S.links(frame, 2, most=1)).collect()} == quiet  # every anchor crowded


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    found = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "Aa bb cc dd"), (3, "aA BB cc dd"), (9, None), (8, ""), (7, " \t\n"), (4, long), (2, long), (2, long), (None, "aa bb cc dd"), (6, "é É")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, fp int").withColumnRenamed("fp", "component_id")
    found = S.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r.component_id for r in found}
    assert got[5] == got[3] == 3 and got[9] == got[8] == got[7] == 7 and got[4] == got[2] == 2 and got[None] == 3
    kept = S.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7] and kept.columns == docs.columns
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    """Several documents without an id, and one id with two texts: each component leaves one row, whatever the ids."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (4, text(3)), (5, text(5)), (5, text(6)), (5, text(6)), (6, text(6)), (None, None), (None, "")]
    kept = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, text(1)), (0, text(2)), (4, text(3)), (5, text(5)), (5, text(6)), (0, "")])
