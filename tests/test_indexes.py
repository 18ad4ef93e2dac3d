"""Kept indexes: the text index against a scan, versions, the vector index's recall."""

import pytest
from pyspark.sql import functions as F

from ibidem.operators import retrieval as R
from ibidem.operators.shared import fresh_folder
from ibidem.operators.text_index import TextIndex
from ibidem.operators.vector_index import VectorIndex
from ibidem.operators.versions import Versions

TEXTS = {1: "grace and peace", 2: "peace be with you and with all", 3: "the grace of the lord", 4: "", 5: None, 6: "all is grace grace grace", 7: "Et in terra pax"}


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "k long, text string")


def queries(spark):
    return spark.createDataFrame([(1, "grace peace"), (2, "with all the lord"), (3, "nothing here?"), (4, "pax grace grace")], "q long, text string")


def found(frame):
    return sorted((r.q, r.k, r.score, r["rank"]) for r in frame.collect())


def scan(spark, texts):
    return found(R.bm25_top(queries(spark), docs(spark, texts).fillna("", ["text"]), "q", ["k"], F.col("text"), F.col("text"), 3))


def search(index):
    return found(index.top(queries(index.spark), "q", ["k"], F.col("text"), 3))


def test_text_index(spark):
    index = TextIndex.create(spark, fresh_folder(spark), buckets=8)
    assert search(index) == []
    index.upsert(docs(spark, TEXTS), ["k"], F.col("text"))
    assert search(index) == scan(spark, TEXTS)
    before = index.pieces()
    index.upsert(docs(spark, {2: "grace", 9: "grace"}), ["k"], F.col("text"))  # one term: one bucket gets a piece
    now = {**TEXTS, 2: "grace", 9: "grace"}
    assert search(index) == scan(spark, now)
    changed = [b for b, paths in index.pieces().items() if paths != before.get(b)]
    assert len(changed) == 1 and index.pieces()[changed[0]][0] == before[changed[0]][0]
    index.delete(docs(spark, {1: "", 77: ""}).select("k"), ["k"])
    del now[1]
    assert search(index) == scan(spark, now)
    for i in range(5):
        now[20 + i % 2] = f"peace and grace number {i}"
        index.upsert(docs(spark, {20 + i % 2: now[20 + i % 2]}), ["k"], F.col("text"))
    pieces = index.pieces()
    assert search(index) == scan(spark, now)
    merged = index.merge(["k"], 3)
    assert merged and all(len(index.pieces()[b]) == 1 for b in merged)
    assert all(index.pieces()[b] == pieces[b] for b in pieces if b not in merged)
    assert search(index) == scan(spark, now)
    index.merge(["k"], 0)
    assert not [r for r in index.versions.current()[1] if r.kind == "stale"] and search(index) == scan(spark, now)
    index.upsert(docs(spark, {1: "grace"}), ["k"], F.col("text"))
    assert search(index) == scan(spark, now | {1: "grace"})
    again = TextIndex(spark, index.versions.folder, buckets=8)
    assert search(again) == search(index)
    index.upsert(docs(spark, {}), ["k"], F.col("text"))
    assert search(index) == search(again)
    with pytest.raises(ValueError, match="twice"):
        index.upsert(docs(spark, {1: "a"}).unionAll(docs(spark, {1: "b"})), ["k"], F.col("text"))


def test_failed_writer(spark):
    """A writer that fails half-way changes nothing that a reader sees; nor does one that comes second."""
    index = TextIndex.create(spark, fresh_folder(spark), buckets=4)
    index.upsert(docs(spark, TEXTS), ["k"], F.col("text"))
    held = search(index)
    broken = F.when(F.col("k") == 3, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text"))
    with pytest.raises(Exception, match="lost"):
        index.upsert(docs(spark, {1: "other", 3: "x"}), ["k"], broken)
    assert search(index) == held and index.versions.current()[0] == 1
    with pytest.raises(RuntimeError, match="has changed"):
        index.versions.publish(0, [])
    other = Versions(spark, index.versions.folder)
    path, n = other.write(spark.range(7), "ids")
    assert n == 7 and other.current() == index.versions.current()
    other.publish(1, [("ids", 0, path, 0, None)])
    assert index.versions.current()[0] == 2


def test_vector_index(spark):
    """Recall of at least 0.9 from two fifths of the lists (half of the vectors) without structure, from a tenth of clusters."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    exact = {(r.q, r.vec_id) for r in R.nearest_vectors(asked, v, "q", "vec_id", "embedding", 5, "cosine").collect()}
    index = VectorIndex.build(v, fresh_folder(spark), "vec_id", "embedding", 44, "cosine")
    got = {(r.q, r.key) for r in index.top(asked, "q", "embedding", 5, 18).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    assert index.candidates(asked, "q", "embedding", 18).count() <= 0.56 * v.count() * asked.count()
    assert {(r.q, r.key) for r in index.top(asked, "q", "embedding", 5, 44, 40).collect()} == exact
    # Clusters: each vector moved towards one of 44 others.
    centre = v.where("vec_id < 44").select(F.col("vec_id").alias("c"), F.col("embedding").alias("e"))
    near = F.zip_with("e", "embedding", lambda a, b: (3 * a + b).cast("float"))
    v = v.join(F.broadcast(centre), F.col("vec_id") % 44 == F.col("c")).select("vec_id", near.alias("embedding"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    exact = {(r.q, r.vec_id) for r in R.nearest_vectors(asked, v, "q", "vec_id", "embedding", 5, "cosine").collect()}
    index = VectorIndex.build(v, fresh_folder(spark), "vec_id", "embedding", 44, "cosine", sample=1000)
    got = {(r.q, r.key) for r in index.top(asked, "q", "embedding", 5, 4).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    assert index.candidates(asked, "q", "embedding", 4).count() <= 0.2 * v.count() * asked.count()


def test_vector_changes(spark):
    rows = [(i, [float(i), float(i % 3), 0.0]) for i in range(30)] + [(77, None)]
    v = spark.createDataFrame(rows, "k long, v array<double>")
    index = VectorIndex.build(v, fresh_folder(spark), "k", "v", 4, rows_a_file=3)
    index.add(spark.createDataFrame([(3, [100.0, 0.0, 0.0]), (40, [5.0, 5.0, 5.0])], v.schema), "k", "v")
    index.delete(v.where("k = 7"), "k")
    again = VectorIndex(spark, index.versions.folder)
    want = {k: x for k, x in rows if x and k not in (7, 3)} | {3: [100.0, 0.0, 0.0], 40: [5.0, 5.0, 5.0]}
    assert {r.key: list(r.vector) for r in again.vectors().collect()} == want
    asked = spark.createDataFrame([(1, [100.0, 0.1, 0.0]), (2, [7.0, 1.0, 0.0])], "q long, v array<double>")
    got = {(r.q, r["rank"]): r.key for r in again.top(asked, "q", "v", 1, 4).collect()}
    exact = {(r.q, r["rank"]): r.k for r in R.nearest_vectors(asked, spark.createDataFrame(list(want.items()), v.schema), "q", "k", "v", 1).collect()}
    assert got == exact and got[1, 1] == 3
