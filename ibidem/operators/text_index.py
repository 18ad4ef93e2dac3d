"""RT1, SNK2, SNK5: an inverted index that is kept: postings by bucket of term, upserts and deletes, merges in rounds.

Postings (term, key, tf, dl, seq) lie in buckets by the hash of the term. A batch of documents is written as one set of
pieces, of the buckets that its terms fall into, under a sequence number; nothing that is there is rewritten. Keys that were
there before, and keys that are deleted, go to a list (key, seq): a posting whose seq is less than that of its key's entry is
dead. So an upsert costs what its own documents hold. Once a bucket has more than `most_pieces` pieces, merge() makes them
one, without dead postings, and leaves all other buckets as they are; when no bucket has an old piece left, the list goes.

A search reads the buckets of its queries' terms alone; rows are sorted by term, so for few terms the files' statistics leave
out most of these. Its scores are those of a scan of all texts.

Versions make every change show whole. Frequent terms: a bucket's rows are dealt to files by a salt of the key, so a term that
all documents have is many files' work.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ibidem.functions.evidence import tokens

from .best import sparse_top
from .retrieval import B, K1, MOST_TERMS, terms_table, top_k, weighed
from .shared import small, written
from .versions import Versions

MOST_STALE, FEW_TERMS = 1_000_000, 1_000


class TextIndex:
    """An inverted index in a folder, over documents with the key columns given."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256, least: int = 1, rows_a_file: int = 2_000_000):
        self.spark, self.versions, self.buckets, self.least, self.rows_a_file = spark, Versions(spark, folder), buckets, least, rows_a_file

    @classmethod
    def create(cls, spark: SparkSession, folder: str, **options) -> TextIndex:
        Versions.create(spark, folder)
        return cls(spark, folder, **options)

    def upsert(self, docs: DataFrame, key: list[str], text: Column) -> int:
        """Adds documents, in place of those with the same key; the new version. A key that occurs twice in docs is an error."""
        number, rows = self.versions.current()
        seq = 1 + max((r.seq for r in rows), default=0)
        cut = docs.select(*key, tokens(F.coalesce(text, F.lit("")), self.least).alias("_t"))
        path, n = self.versions.write(cut.select(*key, F.size("_t").alias("dl")).withColumn("seq", F.lit(seq)), "docs")
        own = self.versions.read([path])
        if n != own.select(*key).distinct().count():
            raise ValueError("a key occurs twice in one batch")
        before = self._live(rows, key)
        facts = self._facts(rows)
        if before is not None:
            stale, n_stale, lost = self._stale(before.join(own.select(*key), key, "left_semi"), key, seq)
            rows, facts = [*rows, *stale], {"n": facts["n"] - n_stale, "tokens": facts["tokens"] - lost}
        total = own.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        spread = cut.select(*key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(*key, "term").agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"))
        made = self._pieces(spread.withColumn("seq", F.lit(seq)).withColumn("bucket", self._bucket(F.col("term"))), key, total, seq)
        facts = {"n": facts["n"] + n, "tokens": facts["tokens"] + total}
        return self._publish(number, [*rows, ("docs", 0, path, seq, None), *made], facts)

    def delete(self, keys: DataFrame, key: list[str]) -> int:
        """Takes documents away; the new version."""
        number, rows = self.versions.current()
        seq = 1 + max((r.seq for r in rows), default=0)
        before = self._live(rows, key)
        if before is None:
            return number
        facts = self._facts(rows)
        stale, n, lost = self._stale(before.join(keys.select(*key).distinct(), key, "left_semi"), key, seq)
        return self._publish(number, [*rows, *stale], {"n": facts["n"] - n, "tokens": facts["tokens"] - lost})

    def merge(self, key: list[str], most_pieces: int = 4) -> list[int]:
        """Makes one piece of the pieces of each bucket that has more than so many; the buckets."""
        number, rows = self.versions.current()
        pieces: dict[int, list] = {}
        for r in rows:
            if r.kind == "postings":
                pieces.setdefault(r.part, []).append(r)
        full = sorted(b for b, held in pieces.items() if len(held) > most_pieces)
        if not full:
            return []
        seq = max(r.seq for r in rows)
        old = [r for b in full for r in pieces[b]]
        kept = self._fresh(self._postings(old), rows, key).select(*key, "term", "tf", "dl", "seq", "bucket")
        made = self._pieces(kept, key, sum(json.loads(r.facts)["tokens"] for r in old), seq)
        rest = [r for r in rows if r not in old and r.kind != "facts"]
        # Once everything has been written after all the keys of the list had gone, the list says nothing any more.
        oldest = min((r.seq for r in [*rest, *_rows(made)] if _kind(r) == "postings"), default=seq)
        live = self._live(rows, key)
        path, _ = self.versions.write(live.select(*key, "dl", "seq"), "docs")
        rest = [r for r in rest if r.kind != "docs" and not (r.kind == "stale" and r.seq <= oldest)]
        self._publish(number, [*rest, ("docs", 0, path, seq, None), *made], self._facts(rows))
        return full

    def pieces(self) -> dict[int, list[str]]:
        """The paths of each bucket's pieces."""
        found: dict[int, list[str]] = {}
        for r in self.versions.current()[1]:
            if r.kind == "postings":
                found.setdefault(r.part, []).append(r.path)
        return found

    def top(self, queries: DataFrame, query_key: str, key: list[str], query: Column, k: int) -> DataFrame:
        """TK1: query_key, key, score (rounded to 6 places) and rank of the k best documents of each query; ties go by key."""
        wanted, met, weights, mean = self._met(queries, query_key, key, query)
        if met is None or not small(wanted, MOST_TERMS):
            scored = self.scores(queries, query_key, key, query).withColumn("score", F.round("score", 6))
            return top_k(scored, query_key, [F.col("score").desc(), *key], k)
        # Postings meet again by document, once, and the best documents of each task leave it: scores aren't shuffled.
        numbers = self.spark.createDataFrame(terms_table(wanted.select("term").distinct().orderBy("term").toArrow()["term"]))
        asked = wanted.join(weights, "term").join(numbers, "term").select(query_key, "at", (F.col("qtf") * F.col("idf")).alias("weight"))
        held = met.join(F.broadcast(numbers), "term").groupBy(*key).agg(F.max("dl").alias("dl"), F.array_sort(F.collect_list(F.struct("at", "tf"))).alias("_e"))
        held = held.select(*key, "dl", F.col("_e.at").alias("at"), F.col("_e.tf").alias("tf"))
        return sparse_top(written(weighed(held, mean)), written(asked), query_key, key, k)

    def scores(self, queries: DataFrame, query_key: str, key: list[str], query: Column) -> DataFrame:
        """query_key, key, score by BM25 of every document that shares a term with a query."""
        wanted, met, weights, mean = self._met(queries, query_key, key, query)
        if met is None:
            return wanted.select(query_key, *[F.lit(None).alias(c) for c in key], F.lit(0.0).alias("score")).limit(0)
        few, asked = small(wanted, MOST_TERMS), wanted.join(weights, "term")
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        return met.join(F.broadcast(asked) if few else asked, "term").groupBy(query_key, *key).agg(F.sum(part).alias("score"))

    def _met(self, queries: DataFrame, query_key: str, key: list[str], query: Column) -> tuple:
        """The queries' terms (query_key, term, qtf); the live postings of these, or None; (term, idf); the documents' mean length."""
        _, rows = self.versions.current()
        wanted = queries.select(query_key, F.explode(tokens(query, self.least)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
        held = [r for r in rows if r.kind == "postings"]
        if not held:
            return wanted, None, None, 0.0
        facts = self._facts(rows)
        few = small(wanted, MOST_TERMS)
        met = self._postings(held)
        if few:
            asked = {r[0] for r in wanted.select(self._bucket(F.col("term"))).distinct().collect()}  # `buckets` at most
            met = self._postings([r for r in held if r.part in asked] or held[:1])
        terms = wanted.select("term").distinct()
        if small(terms, FEW_TERMS):  # then parquet's statistics leave out what lies between
            met = met.where(F.col("term").isin([r["term"] for r in terms.collect()]))
        met = written(self._fresh(met.join(F.broadcast(terms) if few else terms, "term", "left_semi"), rows, key))
        mean = facts["tokens"] / max(facts["n"], 1)
        df = met.groupBy("term").agg(F.count("*").alias("df"))
        weights = df.select("term", F.log(1 + (F.lit(facts["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        return wanted, met, weights, mean

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _pieces(self, postings: DataFrame, key: list[str], total: int, seq: int) -> list[tuple]:
        """Writes postings that have their bucket, sorted by term; a manifest row for each bucket that has any."""
        salts = max(1, -(-total // (self.buckets * self.rows_a_file)))
        dealt = postings.repartition("bucket", F.pmod(F.xxhash64(*key), F.lit(salts))).sortWithinPartitions("bucket", "term", *key)
        path, _ = self.versions.write(dealt, "postings", ["bucket"])
        counts = self.versions.read([path], dealt.schema).groupBy("bucket").agg(F.sum("tf").alias("n")).collect()  # `buckets` rows at most
        return [("postings", r["bucket"], f"{path}/bucket={r['bucket']}", seq, json.dumps({"tokens": r["n"]})) for r in counts]

    def _postings(self, held: list) -> DataFrame:
        """The pieces named, with their buckets."""
        found = self.versions.read(sorted({r.path for r in held}))
        return found.withColumn("bucket", self._bucket(F.col("term")))

    def _stale(self, gone: DataFrame, key: list[str], seq: int) -> tuple[list[tuple], int, int]:
        """Writes the keys of documents that go as dead before seq; manifest rows, how many there are, and their tokens."""
        path, n = self.versions.write(gone.select(*key, "dl").withColumn("seq", F.lit(seq)), "stale")
        lost = self.versions.read([path]).agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        return ([("stale", 0, path, seq, None)] if n else []), n, lost

    def _dead(self, rows: list, key: list[str]) -> DataFrame | None:
        paths = [r.path for r in rows if _kind(r) == "stale"]
        return self.versions.read(paths).groupBy(*key).agg(F.max("seq").alias("_dead")) if paths else None

    def _fresh(self, postings: DataFrame, rows: list, key: list[str]) -> DataFrame:
        """Postings, or documents, that aren't dead."""
        dead = self._dead(rows, key)
        if dead is None:
            return postings
        dead = F.broadcast(dead) if small(dead, MOST_STALE) else dead
        return postings.join(dead, key, "left").where("_dead is null or seq >= _dead").drop("_dead")

    def _live(self, rows: list, key: list[str]) -> DataFrame | None:
        """key, dl, seq of the documents that are there."""
        paths = [r.path for r in rows if r.kind == "docs"]
        return self._fresh(self.versions.read(paths), rows, key) if paths else None

    @staticmethod
    def _facts(rows: list) -> dict:
        return json.loads(next((r.facts for r in rows if r.kind == "facts"), '{"n": 0, "tokens": 0}'))

    def _publish(self, number: int, rows: list, facts: dict) -> int:
        kept = [tuple(r) for r in rows if _kind(r) != "facts"]
        return self.versions.publish(number, [*kept, ("facts", 0, "", 0, json.dumps(facts))])


def _kind(row) -> str:
    return row[0]


def _rows(made: list[tuple]):
    from pyspark.sql import Row

    return [Row(kind=k, part=p, path=path, seq=s, facts=f) for k, p, path, s, f in made]
