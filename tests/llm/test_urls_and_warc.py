"""URL rules and WARC archives: cases, brute force, round trips."""

import gzip
import hashlib
import io
import re
import zlib

import duckdb

from ibidem.llm import urlfilter as U
from ibidem.llm import warc as W


def rule_of(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[3] if fit else None, max(fit)[4] if fit else "allow"


URLS = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/148.html", "https://example.org", "http://x.com/fr/", "http://x.com/de/1", "http://xcom/de/1", "com://com/de/", "no url", None, "http:///p", "http://org.evil/es/", "http://u@example.org:80/es/", "http://example.org/en/1\n2", "ftp://a.b.c.example.org/en/1", "http://é.org/"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(list(U.RULES), "action string, host string, path string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()}
    assert found == {i: rule_of(u, U.RULES) for i, u in enumerate(URLS + URLS[:2])}
    assert U.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge(pages, rules.limit(0)).collect()} == {"allow"}
    more = [("block", "org", "/"), (None, "com", "/"), ("block", "é.org", "")]
    both = rules.unionAll(spark.createDataFrame(more, rules.schema))
    assert {r.page_id: r.rule for r in U.judge(pages, both).collect()} == {i: rule_of(u, [*U.RULES, more[0], more[2]])[2] for i, u in enumerate(URLS + URLS[:2])}


def test_long_urls(spark):
    """A host of 100 000 labels and a path of a megabyte have as many expressions as others."""
    urls = ["http://" + "a." * 100_000 + "example.org/es/x", "http://x.com/de/" + "p/" * 500_000, "http://" + "." * 50_000 + "com/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(list(U.RULES), "action string, host string, path string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()} == {i: rule_of(u, U.RULES) for i, u in enumerate(urls)}


def against_sql(spark, tables, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tables}/pages.parquet'")
    frame = query(spark, tables)
    wanted = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(wanted, key=str)


def test_queries(spark, tables):
    against_sql(spark, tables, U.op3, U.OP3_SQL)
    against_sql(spark, tables, W.op6, W.OP6_SQL)


def test_normaliser():
    whole = [W.record(i, f"http://x/{i}", "response", None, "d" * 40, 5 + i, b"\r\n\r\n" + b"y" * (1 + i)) for i in range(50)]
    for source in (gzip.compress(b"".join(whole)), b"".join(map(gzip.compress, whole))):
        archive, index = io.BytesIO(), io.BytesIO()
        assert W.normalise(io.BytesIO(source), archive, index) == 50
        data = archive.getvalue()
        assert gzip.decompress(data) == b"".join(whole)
        for line, expected in zip(index.getvalue().splitlines(), whole, strict=True):
            at, size, _ = line.split(b" ", 2)
            assert zlib.decompress(data[int(at) : int(at) + int(size)], 31) == expected


def test_archives(spark, tmp_path):
    big, other = "é" * 800, "b" * 3000
    rows = [(1, "http://a/\r\nX: y", big), (5, "u", big), (3, "u", big), (2, None, None), (4, "u", ""), (6, "u", "s"), (7, "u", "s"), (8, "u", other * 500), (9, "u", other * 500), (9, "u", other * 500), (None, "u", big), (None, "u", "n" * 1200), (None, "u", "n" * 1200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    written = W.write_archives(W.with_revisits(pages), f"file://{tmp_path}/w", bytes_a_file=4000)
    assert sum(r.n_records for r in written.collect()) == len(rows)
    assert not [p for p in (tmp_path / "w").iterdir() if not p.name.startswith((".", "pages-"))]
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_archives(spark, f"file://{tmp_path}/w", written).collect()), key=str)
    size = lambda t: len((t or "").encode())
    top = {t: max((k for k, _, x in rows if x == t and k is not None), default=None) for _, _, t in rows if size(t) >= 1000}
    kind = lambda k, t: ("revisit", top[t]) if top.get(t) is not None and k != top[t] else ("response", None)
    assert found == sorted(((k, size(t), hashlib.sha1((t or "").encode()).hexdigest(), *kind(k, t)) for k, _, t in rows), key=str)
    assert W.archived(pages.limit(0)).count() == 0
