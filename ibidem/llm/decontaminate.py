"""Benchmark decontamination by spaced seeds, by DataFrame functions alone.

Texts are lower-cased and cut into runs of letters and digits. A seed looks at the tokens where its mask has a one and
ignores the others, so an overlap with a changed word still has seeds that agree. Hashes of every position of every text
under every mask are joined with those of the benchmark; each hit names an item and a diagonal (place in the document less
place in the item). Around it the tokens of text and item on that diagonal are compared, and the best stretch is taken
under +1 for an equal and -4 for a different token, so that four in five are equal throughout; of stretches of one score
that with more equal tokens. An item counts as leaked where the stretch holds at least LEAST equal tokens, or the whole
item up to a fifth if it is shorter. Where that stretch doesn't, two others are tried: any stretch that is four in five
equal from either end to every place within, though another scores more, and all of the diagonal, where more than four in
five of the item's tokens are equal (exactly four in five for items whose share isn't beyond LEAST). What is reported is
the stretch that decided.

The benchmark's hashes are broadcast while they're at most `most_seeds` rows; then documents aren't shuffled: only hits with
the tokens around them leave the scan. Hashes of a larger benchmark are joined by shuffle with those of the documents' places,
which carry no tokens; the diagonals that were hit, each once, then fetch the tokens of their documents by 128 bits of hashes.

Defined results: null or empty text has no overlap, and an item of fewer tokens than the shortest mask none either; null
doc_ids are reported as such; repeated rows give one row per doc_id and item, with the best overlap; an empty table on
either side gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Which of the tokens in a row a seed looks at: three masks of weight seven.
MASKS = ("1101100111", "1110010111", "11011001011")
LEAST = 13


def token_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seeds(tokens: str, at: str, size: str) -> Column:
    """The seeds of all masks at a place, as an array of hashes; null where a mask would pass the end."""
    own = []
    for k, mask in enumerate(MASKS):
        places = [i for i, c in enumerate(mask) if c == "1"]
        seed = F.xxhash64(F.lit(k), *[F.get(tokens, F.col(at) + i) for i in places])
        own.append(F.when(F.col(at) + len(mask) <= F.col(size), seed))
    return F.array(*own)


def _seeded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row (kept columns, tokens, size, at, seed) for each place and mask. Tokens stay in place, uncopied, in one stage."""
    sized = rows.withColumn("size", F.size("tokens")).where(F.col("size") >= min(map(len, MASKS)))
    placed = sized.select(*keep, "tokens", "size", F.posexplode("tokens").alias("at", "_token"))
    return placed.select(*keep, "tokens", "size", "at", F.explode(_seeds("tokens", "at", "size")).alias("seed")).where("seed is not null")


def _bound(build, *values: Column) -> Column:
    """build(*values) with every value computed once, though build names it many times, also within lambdas."""
    if not values:
        return build()
    return F.get(F.transform(F.array(values[0]), lambda v: _bound(lambda *more: build(v, *more), *values[1:])), 0)


def _even(places: Column) -> Column:
    """(equal, begin, end) of the stretch of most equal tokens that no start or end of it takes below four in five."""
    n = F.size(places)

    def reach(levels: Column, i: Column) -> Column:
        """The last equal token, by number, to which such a stretch goes from the i-th."""

        def step(s: Column, j: Column) -> Column:
            level = F.get(levels, j)
            on = s["on"] & (level >= F.get(levels, i))
            higher = on & (level >= s["top"])
            return F.struct(on.alias("on"), F.when(higher, level).otherwise(s["top"]).alias("top"), F.when(higher, j).otherwise(s["last"]).alias("last"))

        return F.aggregate(F.sequence(i, n - 1), F.struct(F.lit(True).alias("on"), F.get(levels, i).alias("top"), i.alias("last")), step)["last"]

    def longest(levels: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((reach(levels, i) - i + 1).alias("equal"), (-i).alias("first")))
        return _bound(lambda e: F.struct(e["equal"].alias("equal"), F.get(places, -e["first"]).alias("begin"), (F.get(places, e["equal"] - e["first"] - 1) + 1).alias("end")), F.array_max(ends))

    return _bound(longest, F.transform(places, lambda p, i: 5 * i - 4 * p))


def _decided(best: Column, places: Column, item_tokens: Column, least: int) -> Column:
    """The stretch (equal, begin, end) by which an item counts as leaked on a diagonal, or null; places are the equal tokens'."""
    n, share = F.size(places), F.ceil(item_tokens * 0.8)
    need = F.least(F.lit(least), share)
    whole = F.struct(n.alias("equal"), F.get(places, F.lit(0)).alias("begin"), (F.get(places, n - 1) + 1).alias("end"))
    most = (5 * n > 4 * item_tokens) | ((n >= share) & (share <= least))
    return F.when(best["equal"] >= need, best).when(n >= need, F.when(most, whole).otherwise(_bound(lambda e: F.when(e["equal"] >= need, e), _even(places))))


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, most_seeds: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, matched (equal tokens), item_tokens, start and length (tokens of the document) of each leaked item."""
    return _overlaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], benchmark, least, most_seeds)


def _overlaps(docs: DataFrame, ids: list[str], benchmark: DataFrame, least: int, most_seeds: int = 2_000_000) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("tokens"))
    seeds = _seeded(items, ["item_id"]).select("seed", "item_id", F.col("at").alias("item_at"), F.col("size").alias("item_tokens")).distinct()
    few = seeds.limit(most_seeds + 1).count() <= most_seeds
    texts = docs.select(*ids, token_hashes(F.col("text")).alias("tokens"))
    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    if few:
        hits = _seeded(texts, ids).join(F.broadcast(seeds), "seed").select(*ids, "tokens", "size", "item_id", diagonal, "item_tokens")
    else:
        keys = ["_key_x", "_key_y"]
        keyed = texts.withColumns({"_key_x": F.xxhash64("tokens"), "_key_y": F.xxhash64(F.lit(1), "tokens")})
        met = _seeded(keyed, keys).select(*keys, "at", "seed").join(seeds, "seed").select(*keys, "item_id", diagonal, "item_tokens").distinct()
        hits = keyed.withColumn("size", F.size("tokens")).join(met, keys).select(*ids, "tokens", "size", "item_id", "diagonal", "item_tokens")
    first = F.greatest(F.col("diagonal"), F.lit(0))
    around = F.slice("tokens", first + 1, F.least(F.col("size"), F.col("diagonal") + F.col("item_tokens")) - first)
    hits = hits.select(*ids, "item_id", "diagonal", "item_tokens", around.alias("around"))
    # A repeated doc_id may have other tokens on the same diagonal, so the tokens belong to the key.
    hits = hits.groupBy(*ids, "item_id", "diagonal", "item_tokens", F.hash("around").alias("_h"), F.xxhash64("around").alias("_x")).agg(F.first("around").alias("around"))
    compared = hits.join(items.select("item_id", F.col("tokens").alias("item")).distinct(), "item_id").where(F.size("item") == F.col("item_tokens"))
    part = F.slice("item", F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("around"))
    equal = F.zip_with("around", part, lambda a, b: a == b)
    start = F.struct(*[F.lit(0).alias(n) for n in ("i", "score", "begin", "equal", "best", "best_begin", "best_end", "best_equal")])

    def step(s: Column, same: Column) -> Column:
        score = s["score"] + F.when(same, 1).otherwise(-4)
        fresh = score < 0
        count = s["equal"] + same.cast("int")
        better = (score > s["best"]) | ((score == s["best"]) & (count > s["best_equal"]))
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(
            (s["i"] + 1).alias("i"), F.greatest(score, F.lit(0)).alias("score"), F.when(fresh, s["i"] + 1).otherwise(s["begin"]).alias("begin"), F.when(fresh, 0).otherwise(count).alias("equal"),
            pick(score, s["best"]).alias("best"), pick(s["begin"], s["best_begin"]).alias("best_begin"), pick(s["i"] + 1, s["best_end"]).alias("best_end"), pick(count, s["best_equal"]).alias("best_equal"),
        )

    best = F.aggregate(equal, start, step)
    best = F.struct(best["best_equal"].alias("equal"), best["best_begin"].alias("begin"), best["best_end"].alias("end"))
    places = F.array_compact(F.transform(equal, lambda same, i: F.when(same, i)))
    decided = _bound(lambda b, p: _decided(b, p, F.col("item_tokens"), least), best, places)
    found = compared.withColumn("found", decided).where("found is not null")
    offset = F.greatest(F.col("diagonal"), F.lit(0)) + F.col("found.begin")
    best = F.max(F.struct(F.col("found.equal").alias("matched"), (-offset).alias("at"), (F.col("found.end") - F.col("found.begin")).alias("length")))
    out = found.groupBy(*ids, "item_id").agg(best.alias("b"), F.max("item_tokens").alias("item_tokens"))
    return out.select(*ids, "item_id", F.col("b.matched").alias("matched"), "item_tokens", (-F.col("b.at")).alias("start"), F.col("b.length").alias("length"))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, most_keys: int = 1_000_000) -> DataFrame:
    """The rows of docs whose own text has no leaked item, whatever their doc_ids; texts are known by 128 bits of hashes.

    While at most most_keys texts have one, these keys are broadcast and documents stay where they are read."""
    text = F.col("text").cast("string")
    keys = {"_row_x": F.xxhash64(text), "_row_y": F.xxhash64(F.lit(1), text)}
    bad = _overlaps(docs.select(*[k.alias(n) for n, k in keys.items()], "text"), list(keys), benchmark, least).select(*keys).distinct()
    bad = materialize(bad, "leaked")
    bad = F.broadcast(bad) if bad.count() <= most_keys else bad
    return docs.withColumns(keys).join(bad, list(keys), "left_anti").select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
