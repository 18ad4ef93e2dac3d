"""Leaks against brute force; tolerance to changed words; edges."""

import itertools
import random
import re

from ibidem.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def verbatim(docs, items):
    padded = {k: f" {' '.join(words(t))} " for k, t in docs}
    return {(d, i) for d, text in padded.items() for i, t in items if f" {' '.join(words(t))} " in text}


def test_query(spark, tables):
    folder = "/root/testdata/sf0.01"
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{folder}/{n}.parquet").select("doc_id" if n == "documents" else "item_id", "text").collect()]
    found = D.op4(spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in found} == verbatim(read("documents"), read("benchmark"))
    texts, items = dict(read("documents")), dict(read("benchmark"))
    for r in found:
        assert r.matched == r.length == r.item_tokens
        assert words(texts[r.doc_id])[r.start : r.start + r.length] == words(items[r.item_id])


def test_masks_tolerate_changes():
    def safe(n, changed):
        for bad in itertools.combinations(range(n), changed):
            if not any(all(c == "0" or p + i not in bad for i, c in enumerate(m)) for m in D.MASKS for p in range(n - len(m) + 1)):
                return False
        return True

    assert safe(12, 1) and safe(16, 2) and safe(24, 3)


def best(text, item):
    """Equal tokens of the best stretch on any diagonal, under +1 and -4."""
    top = (0, 0)
    for diagonal in range(-len(item), len(text)):
        score = equal = 0
        for k in range(len(item)):
            at = diagonal + k
            if not 0 <= at < len(text):
                score = equal = 0
                continue
            same = text[at] == item[k]
            score, equal = score + (1 if same else -4), equal + same
            if score < 0:
                score = equal = 0
            top = max(top, (score, equal))
    return top[1]


def test_changed_passages(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(30))) for i in range(4)]
    docs = []
    for k in range(40):
        own = items[k % 4][1].split()
        for j in rng.sample(range(30), k % 7):
            own[j] = "changed"
        cut = rng.randint(0, 12)
        docs.append((k, " ".join([f"f{k}"] * rng.randint(0, 9) + own[cut:] + ["end"])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(frame, benchmark).collect()}
    expected = {(d, i): n for d, t in docs for i, s in items if (n := best(words(t), words(s))) >= 13}
    assert found == {k: n for k, n in expected.items() if k in found}
    assert all(k in found for k, n in expected.items() if n >= 16)  # fewer tokens may lack a seed
    shuffled = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(frame, benchmark, most_seeds=1).collect()}
    assert shuffled == found


def test_edges(spark):
    item = " ".join(f"word{i}" for i in range(20))
    rows = [(1, item.upper().replace(" ", ", ")), (1, item), (2, None), (3, ""), (None, f"x {item} y"), (4, "word1 word2 word3"), (5, "z " * 30_000 + item)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.matched, r.start) for r in D.overlaps(docs, benchmark).collect()}
    assert found == {(1, 7, 20, 0), (None, 7, 20, 1), (5, 7, 20, 30_000)}
    kept = D.clean(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns
    assert D.overlaps(docs.limit(0), benchmark).count() == D.overlaps(docs, benchmark.limit(0)).count() == 0


def test_spaced_changes_in_short_items(spark):
    """Two or three changes anywhere in items of 15 to 25 tokens: whatever has a seed and is equal in more than four of five is found."""
    benchmark, docs, expected = [], [], {}
    for n, changed in ((15, 2), (20, 2), (20, 3), (24, 3), (25, 3)):
        benchmark.append((n, " ".join(f"t{n}x{j}" for j in range(n))))
        for bad in list(itertools.combinations(range(n), changed))[:: 1 if changed == 2 else 9]:
            if any(all(c == "0" or p + i not in bad for i, c in enumerate(m)) for m in D.MASKS for p in range(n - len(m) + 1)):
                docs.append((len(docs), "before " + " ".join("changed" if j in bad else f"t{n}x{j}" for j in range(n)) + " after"))
                expected[docs[-1][0], n] = n - changed
    found = {(r.doc_id, r.item_id): (r.matched, r.start, r.length) for r in D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")).collect()}
    assert found.keys() == expected.keys()
    assert all(min(13, -(-4 * k[1] // 5)) <= m <= expected[k] for k, (m, _, _) in found.items())


def test_stretch_that_scores_less(spark):
    """Twelve tokens in a row score more than fifteen with one change among them, but these decide."""
    item = [f"w{j}" for j in range(60)]
    own = [w if j < 12 or 30 <= j < 46 and j != 38 else f"other{j}" for j, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(own[:30]))], "doc_id long, text string")
    found = D.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.matched, r.start, r.length) for r in found] == [(1, 15, 30, 16)]


def test_clean_by_row(spark):
    """A leaked row without an id, or with one that other rows have, takes none of these along."""
    item = " ".join(f"word{i}" for i in range(20))
    rows = [(None, f"x {item} y"), (None, "a clean text"), (None, None), (1, item), (1, "another clean text"), (2, "a clean text")]
    kept = D.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "a clean text"), (1, "another clean text"), (2, "a clean text")]


def test_recall_of_thirteen_to_fifteen_equal_tokens(spark):
    """Of stretches whose best part has 13 to 15 equal tokens, by brute force, how many the seeds find; and none beside them
    but those that the whole item or a stretch that is four in five equal from both ends decides."""
    rng, items, docs = random.Random(5), [], []
    for k in range(400):
        n = 13 + k % 6
        words_ = [f"w{k}x{i}" for i in range(n + 24)]  # the item goes on, so the stretch alone decides
        held = words_[12 : 12 + n]
        for at in rng.sample(range(1, n - 1), k // 6 % 3):
            held[at] = "other"
        items.append((k, " ".join(words_)))
        docs.append((k, " ".join([*(f"a{k}x{i}" for i in range(20)), *held, *(f"b{k}x{i}" for i in range(20))])))
    found = {(r.doc_id, r.item_id) for r in D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(d == i for d, i in found)
    reached = {k: best(words(docs[k][1]), words(items[k][1])) for k in range(400)}
    near = [k for k, n in reached.items() if 13 <= n <= 15]
    assert len(near) > 100 and sum((k, k) in found for k in near) == len(near)  # measured: all of them
    assert all((k, k) in found for k, n in reached.items() if n > 15)
