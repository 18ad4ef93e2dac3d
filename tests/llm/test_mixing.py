"""Mixing: targets by water filling, copies by draws, against plain Python; sums near their targets."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from ibidem.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, most):
    """Targets by adding full sources one at a time."""
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(weights[s] for s in sizes if s not in full)
        level = Fraction(total - sum(most * sizes[s] for s in full), rest) if rest else Fraction(0)
        over = [s for s in sizes if s not in full and most * sizes[s] < level * weights[s]]
        if not over:
            return {s: Fraction(most * sizes[s]) if s in full else level * weights[s] for s in sizes}
        full.add(over[0])


def plain(rows, most=3):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    sizes, of = defaultdict(int), []
    for doc, text, source in rows:
        key = hashlib.md5(f"{'' if doc is None else doc}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        of.append((doc, source, len(WORD.findall(text or "")), int(key[:8], 16), int(key[8:16], 16)))
        sizes[source] += of[-1][2]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    targets, out = {s: float(t) for s, t in filled(sizes, weights, most).items()}, []
    for source in order:
        own = [r for r in of if r[1] == source]
        rate = min(targets[source] / sizes[source], most) if sizes[source] else 0
        part = rate - int(rate)

        def copies(r, k, rate=rate, part=part):
            return int(rate) + ((r[3] + k * r[4]) % 2**32 < part * 2**32) if rate else 0

        seed = min(range(M.SEEDS), key=lambda k: (abs(sum(r[2] * copies(r, k) for r in own) - targets[source]), k))
        out += [(r[0], r[2], sizes[source], targets[source], r[2] * copies(r, seed)) for r in own]
    return out


def got(frame):
    return [(r.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in frame.collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def alike(left, right):
    left, right = sorted(left, key=key), sorted(right, key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3], rel=1e-12)


def test_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = M.op11(spark, tables).collect()
    alike([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows], plain([(r.doc_id, r.text, r.source) for r in docs.collect()]))
    again = M.op11(spark, tables).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_near_target(spark):
    rows = M.op11(spark, "/root/testdata/sf0.01").collect()
    taken, target = defaultdict(int), {}
    of = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in rows:
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
        assert r.taken in (r.size * r.copies, 0) and r.copies <= 3
    assert all(abs(taken[s] - target[s]) <= 0.04 * target[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))


EDGES = [(1, None, "a", "x"), (2, "", "b", "x"), (None, "w " * 40, "b", "y"), (None, "w " * 40, "b", "y"), (3, "u v w", None, None), (3, "u v w", None, None), (4, "k", "\U0001f600", "z"), (5, "k\x0bk\x1fk", "ﬁ", "z"), (6, "word " * 30000, "", "q")]


def test_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, source string, size string")
    alike(got(M.mixture(docs)), plain([r[:3] for r in EDGES]))
    assert M.mixture(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    assert {r.copies for r in M.mixture(docs.where("doc_id < 3")).collect()} == {0}  # no words at all
    out = M.mixed(docs)
    assert out.columns == docs.columns
    copies = {(r.doc_id, r.source): r.copies for r in M.mixture(docs).collect()}
    for r in docs.distinct().collect():
        n_rows = sum(e[:3] == (r.doc_id, r.text, r.source) for e in EDGES)
        assert sum(x == r for x in out.collect()) == n_rows * copies[r.doc_id, r.source]


def test_full_sources_and_many(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 == 0 else f"s{i % 40:02}") for i in range(900)] + [(1000, "w " * 3000, "whale")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain(rows)
    assert any(r[3] == 3 * r[2] for r in want)  # some sources are full
    alike(got(M.mixture(docs)), want)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    alike(got(M.mixture(docs)), want)
