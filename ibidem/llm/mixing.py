"""Mixing sources to target weights by repetition rates.

The words of each source are added up, the total is shared among the sources by weight, and no source gets more than `most`
times what it has: what is above that goes to the other sources by weight until none is above (a water level, found by one
sum over the sources a round). A source's rate is its target over its size. Each of its documents is emitted floor(rate)
times, plus one copy by a Bernoulli draw with the rest of the rate as its probability.

Draws come from a hash of the document, so reruns agree and no document waits for another. A document has SEEDS draws,
(h1 + k * h2) mod 2**32 for seed k, and a source takes the seed under which its words come nearest to its target; the sums
under all seeds are taken in one aggregate. So few or very long documents don't leave a source far off.

Documents are read once, for their sizes and hashes; all the rest works on that small table. Sources are ranked by range
partitions, not in one task, and aggregates combine before they shuffle, so a source may hold any share of the rows.

Defined results: null text has size 0 and is taken as often as any other; a null source is a source and the last; a null
doc_id counts as an empty one in the hash; repeated rows are taken alike; a source without words has target, rate and taken
words of zero; an empty table gives an empty result. Other columns, of whatever name, come along unchanged in `mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, same, table, words

WEIGHTS = (5, 2, 1)
MOST = 3
SEEDS = 32
DRAWS = 1 << 32
BROADCAST_SOURCES = 100_000
SALTS = 64


def measured(docs: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named, with source, size in words, and the two numbers that the draws come from."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    found = docs.select(*columns, F.col("source").cast("string").alias("source"), F.size(words(text)).cast("long").alias("size"), key.alias("key"))
    h1, h2 = (F.conv(F.substring("key", at, 8), 16, 10).cast("long") for at in (1, 9))
    return found.select(*columns, "source", "size", h1.alias("h1"), h2.alias("h2"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0 in order of code points with null last: ranges in order, counted, and numbered on from those before."""
    dealt = sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("own", own).join(F.broadcast(bases), "range").withColumn("rank", F.col("base") + F.col("own")).drop("range", "own", "base")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source and source_size, with weight, target and rate. The weights repeat over the sources in order."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = materialize(ranked(sources).select("source", "source_size", weight.alias("weight")), "weights")
    total = held.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    limit, level, n_full = F.col("source_size") * most, 0.0, -1
    while True:  # each round fills one more source at least, all that lie below the level at once
        full = limit < F.lit(level) * F.col("weight")
        row = held.agg(
            F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("rest")
        ).first()
        if row["n"] == n_full or not row["rest"]:
            break
        n_full, level = row["n"], (total - row["given"]) / row["rest"]
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return held.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def drawn(seed: Column | int) -> Column:
    """Whether the draw of that seed gives the copy that the rest of the rate stands for."""
    return F.pmod(F.col("h1") + seed * F.col("h2"), F.lit(DRAWS)) < (F.col("rate") - F.floor("rate")) * float(DRAWS)


def _joined(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Rows with what is known of their source: by broadcast while sources are few, else over salted sources."""
    sources = sources.withColumnRenamed("source", "of")
    if n_sources <= BROADCAST_SOURCES:
        return sizes.join(F.broadcast(sources), same(F.col("source"), F.col("of"))).drop("of")
    salted = sources.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = sizes.withColumn("salt", F.pmod(F.xxhash64("h1", "h2"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same(F.col("source"), F.col("of")) & (F.col("salt") == F.col("salt_of"))).drop("of", "salt", "salt_of")


def plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """For each source its size, weight, target, rate and seed, and how many sources there are."""
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    n = sources.count()
    rows = _joined(sizes, sources, n)
    sums = rows.groupBy("source").agg(*[F.sum(F.when(drawn(k), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)])
    sums = sums.select(F.col("source").alias("of"), F.array(*[f"s{k}" for k in range(SEEDS)]).alias("sums"))
    off = F.transform("sums", lambda s: F.abs(F.floor("rate") * F.col("source_size") + s - F.col("target")))
    chosen = sources.join(sums, same(F.col("source"), F.col("of"))).withColumn("off", off)
    seed = F.array_position("off", F.array_min("off")) - 1
    return materialize(chosen.select("source", "source_size", "weight", "target", "rate", seed.alias("seed")), "mix"), n


def _taken(rows: DataFrame, sources: DataFrame, n_sources: int, columns: Sequence[str]) -> DataFrame:
    copies = (F.floor("rate") + drawn(F.col("seed")).cast("long")).cast("int")
    shown = F.when(F.col("source_size") > 0, copies).otherwise(0).alias("copies")
    return _joined(rows, sources, n_sources).select(*columns, "source", "size", "source_size", "target", "rate", shown)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, rate and copies."""
    sizes = materialize(measured(docs), "sizes")
    return _taken(sizes, *plan(sizes, weights, most), ["doc_id"])


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, whole, with its columns. Documents are read twice, for the
    plan and for the mix, and stay where they are read while sources are few."""
    found = plan(materialize(measured(docs), "sizes"), weights, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    taken = _taken(measured(whole, ["row"]), *found, ["row"]).where(F.col("copies") > 0)
    emitted = taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return emitted.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op11(spark, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP11_SQL = f"""
WITH RECURSIVE measured AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key
  FROM documents
), sizes AS MATERIALIZED (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
    CAST(concat('0x', substr(key, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(key, 9, 8)) AS BIGINT) AS h2
  FROM measured
), sources AS MATERIALIZED (
  SELECT source, source_size, list_extract([{", ".join(map(str, WEIGHTS))}], CAST(rank % {len(WEIGHTS)} + 1 AS INT)) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sizes GROUP BY source)
), levels AS (
  SELECT 0 AS round, CAST(0 AS DOUBLE) AS level, CAST(-1 AS BIGINT) AS n_full
  UNION ALL
  SELECT round + 1, (SELECT CAST(sum(source_size) AS DOUBLE) - coalesce(sum(source_size * {MOST}) FILTER (source_size * {MOST} < level * weight), 0) FROM sources)
      / (SELECT sum(weight) FILTER (source_size * {MOST} >= level * weight) FROM sources),
    (SELECT count(*) FROM sources WHERE source_size * {MOST} < level * weight)
  FROM levels WHERE n_full <> (SELECT count(*) FROM sources WHERE source_size * {MOST} < level * weight)
), final AS (
  SELECT source, source_size, target, least(target / source_size, {MOST}.0::DOUBLE) AS rate
  FROM (SELECT source, source_size, least(CAST(source_size * {MOST} AS DOUBLE), (SELECT arg_max(level, round) FROM levels) * weight) AS target FROM sources)
), sums AS (
  SELECT s.source, k, any_value(f.target) AS target,
    any_value(floor(rate) * f.source_size) + sum(CASE WHEN (h1 + k * h2) % {DRAWS} < (rate - floor(rate)) * {DRAWS} THEN size ELSE 0 END) AS got
  FROM sizes s JOIN final f ON s.source IS NOT DISTINCT FROM f.source, range({SEEDS}) t(k) GROUP BY s.source, k
), seeds AS (
  SELECT source, k AS seed FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(got - target), k) = 1
)
SELECT doc_id, size, source_size, target, size * copies AS taken, CAST(copies AS INT) AS copies
FROM (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(rate) AS BIGINT) + CASE WHEN (h1 + seed * h2) % {DRAWS} < (rate - floor(rate)) * {DRAWS} THEN 1 ELSE 0 END ELSE 0 END AS copies
  FROM sizes s JOIN final f ON s.source IS NOT DISTINCT FROM f.source JOIN seeds d ON s.source IS NOT DISTINCT FROM d.source
)
"""
