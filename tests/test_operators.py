"""Operators on small tables: neighbours, rewrites, sources, streaming, verification."""

import json

from pyspark.sql import functions as F

from ibidem.operators import neighbours as N
from ibidem.operators import retrieval as R
from ibidem.operators import tables as D
from ibidem.operators.chunk import chunks
from ibidem.plans import catalog as C
from ibidem.plans.verify import verify, verify_tasks
from ibidem.sources import files as S
from ibidem.sources import html as H
from ibidem.streaming import ingest as I


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_budget(spark):
    files = spark.createDataFrame([(i, i * 10, 1000 - i) for i in range(1, 50)], "k long, size long, used long")
    total, expected = 0, set()
    for i in range(1, 50):
        total += i * 10
        expected.add((i, total, total <= 500))
    for buckets in (1, 4, 64):
        assert set(map(tuple, N.within_budget(files, "size", "used", "k", 500, buckets).select("k", "running", "kept").collect())) == expected


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("b", 0, 12), (None, 3, 13)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 1, "w")], "k string, at int, v string")
    assert rows(N.as_of_join(left, right, ["k"], "at", ["v"]).select("id", "v")) == [(10, None), (11, "y"), (12, None), (13, None)]


def test_rewrites(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 9)], "k int, v string, n int")
    assert rows(D.upsert(old, new, ["k"])) == [(1, "a", None), (2, "b", 7), (3, "c", 9)]
    table, rejected = D.insert_absent(old, new, ["k"])
    assert rows(table.select("k")) == [(1,), (2,), (3,)] and rows(rejected.select("k")) == [(2,)]
    parents, children = D.delete_cascade(old, "k", F.col("n") == 5, {"c": (new, "k")})
    assert rows(parents.select("k")) == [(1,)] and rows(children["c"].select("k")) == [(3,)]
    assert rows(D.backfill(spark.createDataFrame([(1, " "), (2, "x")], "k int, e string"), "e", F.lit("new"))) == [(1, "new"), (2, "x")]
    fixes = spark.createDataFrame([(2, "B")], "k int, v string")
    assert rows(D.corrected(old, fixes, "k", "v").select("k", "v")) == [(1, "a"), (2, "B")]
    listing = spark.createDataFrame([("new/a.pdf",), ("b.pdf",)], "path string")
    files = spark.createDataFrame([("old/a.pdf",), ("b.pdf",), ("c.pdf",)], "path string")
    assert rows(D.path_outcomes(files, listing).select("path", "outcome")) == [("b.pdf", "ok"), ("c.pdf", "missing"), ("old/a.pdf", "fixed")]


def test_containing_short_and_cut(spark):
    quotes = spark.createDataFrame([(1, "two three"), (2, "ne two three four five six seve"), (3, "zero")], "q long, s string")
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "two  three")], "d long, t string")
    assert rows(R.containing(quotes, docs, "q", ["d"], "s", "t")) == [(1, 1), (2, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a", "year": 1}\nnot json\n\n{"path": "b", "year": 2}\n')
    assert rows(S.manifest(spark, str(tmp_path / "m.jsonl"), "path string, year int")) == [("a", 1), ("b", 2)]
    (tmp_path / "i.json").write_text(json.dumps([{"Path": "x/A.PDF", "Name": "A.PDF", "Size": 3}, {"Path": "b.txt", "Name": "b.txt", "Size": 4}]))
    assert rows(S.inventory(spark, str(tmp_path / "i.json"))) == [("x/A.PDF", "A.PDF", 3)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"123")
    assert [r.length for r in S.folder(spark, str(tmp_path / "f")).collect()] == [3]
    attempts = spark.createDataFrame([(1, 1, "short"), (1, 2, "x" * 90), (1, 3, "y" * 99), (2, 1, "ab"), (2, 2, "abc")], "p int, attempt int, text string")
    assert rows(S.best_attempt(attempts, ["p"])) == [(1, "x" * 90), (2, "abc")]
    found = json.loads(S.report(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "x string, n int"), ["x"], "n").first()[0])
    assert found == {"x": [{"name": "b", "n": 2, "bytes": 5}, {"name": "a", "n": 1, "bytes": 1}]}
    assert S.replace_checked(attempts, str(tmp_path / "new")) == 5


PAGE = """<html><nav><a href="/n">Nav</a></nav><script>var a = "<p>no</p>";</script><article><h2>One &amp; two</h2>
<p>First paragraph that is long enough to be kept, surely.<p>Second unclosed paragraph, it is long enough to be kept.</p>
<a href="/a">A</a> <ul><li>Item 1891 <a href="/b">B</a></li></ul><h3>Next</h3><a href="/a">again</a></article></html>"""


def test_html(spark):
    page = spark.createDataFrame([(1, PAGE)], "id long, html string")
    text = page.select(H.strip(F.col("html"))).first()[0]
    assert "One & two" in text and "no" not in text.split() and "<" not in text
    assert page.select(H.block_texts(F.col("html"))).first()[0] == ["First paragraph that is long enough to be kept, surely.", "Second unclosed paragraph, it is long enough to be kept."]
    assert rows(H.links(page, "id", prefer="/b").select("position", "href")) == [(0, "/b"), (1, "/n"), (2, "/a")]
    assert rows(H.headed_links(page, "id").select("heading", "href", "label")) == [("Next", "/a", "again"), ("One & two", "/a", "A"), ("One & two", "/b", "B"), (None, "/n", "Nav")]
    assert rows(H.row_links(page, "id").select("href", "year")) == [("/b", 1891)]
    assert [r.text for r in H.paragraphs(page, "id").orderBy("position").collect()][:1] == ["One & two"]


def test_verify_round_trip(spark):
    text = " ".join(f"word{i}" for i in range(900))
    docs = spark.createDataFrame([(1, text, "Agostinho de Hipona"), (2, "other things entirely here", "Jerônimo")], "doc_id long, text string, author string")
    held = chunks(docs)
    starts = [(i * 10 + r.chunk, r.text[:300].rsplit(" ", 1)[0], who) for i, who in enumerate(("Santo Agostinho", "Jerônimo")) for r in held.where("doc_id = 1").collect()]
    across = (99, " ".join(f"word{i}" for i in range(480, 520)), "Agostinho")
    fake = (98, "uma releitura que pretende ressignificar word5 word6", "Agostinho")
    claims = spark.createDataFrame([*starts, across, fake, (97, "zzz qqq", "")], "claim_id long, quote string, attributed_to string")
    found = {r.claim_id: r.code for r in verify(claims, held, docs.select("doc_id", "author")).collect()}
    assert {found[k] for k, _, who in starts if who == "Santo Agostinho"} == {"CONFIRMADA_EXATA"}
    assert {found[k] for k, _, who in starts if who == "Jerônimo"} == {"ATRIBUICAO_DUVIDOSA"}
    assert found[99] == "CONFIRMADA_EXATA" and found[98] == found[97] == "NAO_ENCONTRADA"
    tasks = spark.createDataFrame([(1, 'Verify “word1 word2 word3 word4” atribuída a Agostinho')], "claim_id long, task string")
    assert verify_tasks(tasks, held, docs.select("doc_id", "author")).first().code == "CONFIRMADA_EXATA"


def test_catalog(spark):
    files = spark.createDataFrame([(1, 2, "b", "x"), (1, 1, "a", "y"), (2, None, "c", None)], "book int, volume int, file string, edition string")
    assert rows(C.editions(files, "book").select("book", "risks")) == [(1, ["several editions"]), (2, ["no edition", "volume unknown"])]
    popes = spark.createDataFrame([("Leo", "bull", 1891), ("Leo", "letter", 1880), ("Others", "bull", 2000), ("Pius", "bull", 1903)], "p string, k string, y int")
    assert [r.p for r in C.popes(popes, "p", "k", F.col("y"), "Others").collect()] == ["Pius", "Leo", "Others"]
    assert [r.x for r in C.collated(spark.createDataFrame([("b",), ("Á",), ("a",), ("C",)], "x string"), "x").collect()][-1] == "C"


def test_stream(spark, tmp_path):
    source = spark.createDataFrame([(i, f"text of {i}") for i in range(5)], "doc_id long, text string")
    source.write.parquet(str(tmp_path / "in"))
    docs = I.stream_of(spark, str(tmp_path / "in"), source.schema)
    I.ingest(docs, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").count() == 5
    I.ingest(docs, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_stream_equals_batch(spark, tables):
    from ibidem.sources.files import table

    events = table(spark, tables, "events")
    live = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(tables)
    q = I.monthly(live.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("monthly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "30 days")["start"].alias("start"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    assert rows(spark.table("monthly")) == rows(batch)


def test_clear(spark):
    from ibidem.operators import shared

    kept = shared.written(spark.range(3))
    assert kept.count() == 3 and shared.clear(spark) >= 1
    assert shared.clear(spark) == 0
