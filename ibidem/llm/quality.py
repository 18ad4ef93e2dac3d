"""Quality rules with robust multivariate outliers, by DataFrame functions alone.

Each text gives base counts and a vector of five transformed statistics. For every language and source the minimum
covariance determinant is estimated: that mean and covariance of 75 % of the rows whose determinant is least. It is sought
from four deterministic starts (medians and quartiles; mean and covariance; covariance of the hyperbolic tangents of robust
scores; covariance of their spatial signs) by concentration steps, which take mean and covariance of the 75 % of rows
nearest by Mahalanobis distance and never raise the determinant. After two steps the two starts of least determinant go on
until no determinant falls any more, and the least one wins. A step is one pass over the vectors: rows are counted and their
products summed by distance, in narrow bands on a logarithmic scale, and the bands that hold the nearest 75 % are added up,
the last one in part. All that moves between tasks are these sums, combined before the shuffle, so a source with a third of
all rows is no heavier than the others. A group of fewer than 50 usable rows can't be estimated by itself, whatever the size
of the table, and is estimated with the other such groups of its language, or of all.

Statistics that are constant over good text (no symbols at all) would make covariances singular; FLOORS are standard
deviations below which a difference doesn't count, added to every covariance.

Defined results: null or wordless text has zero counts and fails the base rules, as does any text of fewer than 50 words;
null lang or source is a group like any other; where fewer than 11 usable rows remain to estimate from, nothing is an
outlier; repeated rows each get their verdict; an empty table gives an empty result; other columns pass through annotate()
untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, materialize, words

STATISTICS = ("word_length", "symbols", "capitals", "marks", "repeats")
FLOORS = (0.05, 0.25, 0.2, 0.2, 0.12)
#: Rows nearest to a group's centre that a concentration step takes, and what makes their covariance consistent for five
#: normal variables: 0.75 / P(chi2 with 7 degrees <= the 0.75 quantile of chi2 with 5).
SHARE, CONSISTENT = 0.75, 1.41
#: Squared distance beyond which a row is an outlier: the quantile of chi2 with 5 degrees that one normal row in 10**8 exceeds.
CUTOFF = 45.8
LEAST_ROWS, LEAST_ESTIMATE = 50, 11
#: Distances of one band differ by a factor of 2 ** (1 / BANDS) at most; a determinant that falls by less than a share of
#: FALL has stopped falling.
BANDS, FALL = 128, 1e-4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _windows(w: Column, n: Column) -> Column:
    """Hashes of the 3-word windows of an array of words; none where there are fewer than two windows."""
    two = F.zip_with(w, F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(two, F.slice(w, 3, n), lambda a, b: F.xxhash64(a, b)), 1, n - 2)
    return F.when(n >= 4, windows).otherwise(F.array().cast("array<bigint>"))


def base_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct `base` of the base counts and `shape` (letters in upper case, marks) to rows."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = rows.withColumns({"_t": t, "_w": words(t)})
    n = F.size("_w")
    cut = cut.withColumns({"_g": _windows(F.col("_w"), n), "_p": F.regexp_replace("_t", WORD_BREAK, "")})
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = cut.withColumns({"_l": lines, "_s": F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))})
    m = F.size("_s")
    equal = F.zip_with("_s", F.slice("_s", 2, m), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    cut = cut.withColumn("_e", equal)
    twice = F.zip_with("_e", F.concat(F.array(F.lit(False)), F.slice("_e", 1, m - 1)), lambda a, b: a | b)
    places = F.sort_array(F.filter(F.zip_with("_s", twice, lambda s, f: F.when(f, s["i"])), lambda x: x.isNotNull()))
    cut = cut.withColumn("_r", places)
    spans = F.zip_with("_r", F.slice("_r", 2, F.size("_r")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.when(F.col("_r").isNull(), F.lit(0)).otherwise(F.aggregate(spans, F.lit(0), lambda a, x: a + x))
    counts = {
        "n_words": n,
        "word_chars": F.length("_p"),
        "n_symbols": F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", "")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
    }
    shape = F.struct(
        F.length(F.regexp_replace("_p", r"[^\p{Lu}]+", "")).alias("capitals"),
        F.length(F.regexp_replace("_p", r"[\p{L}\p{N}]+", "")).alias("marks"),
    )
    base = F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])
    return cut.select(*rows.columns, base.alias("base"), shape.alias("shape"))


def statistics(base: str = "base", shape: str = "shape") -> list[Column]:
    """The transformed statistic vector; null for a text without words."""
    n, chars = F.col(f"{base}.n_words"), F.col(f"{base}.word_chars")
    share = lambda c, of: c / F.when(of > 0, of)
    return [
        F.log(share(chars, n)),
        F.asinh(10 * share(F.col(f"{base}.n_symbols"), n)),
        F.log(share(F.col(f"{shape}.capitals"), chars) + 0.01),
        F.log(share(F.col(f"{shape}.marks"), chars) + 0.01),
        F.sqrt(share(F.col(f"{base}.n_repeat_words"), n)),
    ]


def base_failed(base: str = "base") -> Column:
    n = F.col(f"{base}.n_words")
    return (n < 50) | (100 * F.col(f"{base}.n_repeat_words") > 50 * n)


def _distance(centre: str = "centre", factor: str = "factor") -> Column:
    """Squared Mahalanobis distance of columns x0.. from a centre, by forward substitution in the Cholesky factor."""
    p, done = len(STATISTICS), []
    for i in range(p):
        y = F.col(f"x{i}") - F.col(centre)[i]
        for j, z in enumerate(done):
            y = y - F.col(factor)[i * p + j] * z
        done.append(y / F.col(factor)[i * p + i])
    total = done[0] * done[0]
    for y in done[1:]:
        total = total + y * y
    return total


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATISTICS)) for j in range(i, len(STATISTICS))]


def _factored(moments: DataFrame, scale: float) -> DataFrame:
    """grp, start, n, centre, the Cholesky factor (row by row) and half the determinant's logarithm, from means m_i and mean
    products m_i_j."""
    p = len(STATISTICS)
    cov = lambda i, j: scale * (F.col(f"m_{j}_{i}") - F.col(f"m_{i}") * F.col(f"m_{j}")) + (FLOORS[i] ** 2 if i == j else 0)
    frame = moments
    for i in range(p):  # each entry becomes a column, as it is used many times
        for j in range(i + 1):
            entry = cov(i, j)
            for k in range(j):
                entry = entry - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            entry = F.sqrt(F.greatest(entry, F.lit(1e-9))) if i == j else entry / F.col(f"l_{j}_{j}")
            frame = frame.withColumn(f"l_{i}_{j}", entry)
    factor = F.array(*[F.col(f"l_{i}_{j}") if j <= i else F.lit(0.0) for i in range(p) for j in range(p)])
    size = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, p)), F.log(F.col("l_0_0")))
    return frame.select("grp", "start", "n", F.array(*[F.col(f"m_{i}") for i in range(p)]).alias("centre"), factor.alias("factor"), size.alias("size"))


def _starts(vectors: DataFrame) -> DataFrame:
    """Four starts of each group, as _factored returns them."""
    p = len(STATISTICS)
    quartiles = vectors.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(p)])
    scale = lambda i: F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2)) + FLOORS[i] ** 2)
    robust = materialize(quartiles.select("grp", *[F.col(f"q{i}")[1].alias(f"c{i}") for i in range(p)], *[scale(i).alias(f"s{i}") for i in range(p)]), "mcd")
    scored = vectors.join(_beside(robust)(robust), "grp").withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"s{i}") for i in range(p)})
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")))
    scored = scored.withColumns({"length": length, **{f"t{i}": F.tanh(f"z{i}") for i in range(p)}})
    sums = [F.avg(f"x{i}").alias(f"x{i}") for i in range(p)] + [F.avg(f"t{i}").alias(f"t{i}") for i in range(p)]
    for i, j in _pairs():
        sign = F.when(F.col("length") > 0, F.col(f"z{i}") * F.col(f"z{j}") / (F.col("length") * F.col("length"))).otherwise(0.0)
        sums += [F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"x{i}_{j}"), F.avg(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"t{i}_{j}"), F.avg(sign).alias(f"u{i}_{j}")]
    sums += [F.first(f"{c}{i}").alias(f"{c}{i}") for c in "cs" for i in range(p)]
    means = scored.groupBy("grp").agg(F.count("*").alias("n"), *sums)
    around = lambda i, j, spread: F.col(f"c{i}") * F.col(f"c{j}") + spread * F.col(f"s{i}") * F.col(f"s{j}")
    #: What makes the covariance of tanh of a normal variable 1, and that of spatial signs in p dimensions.
    of_tanh, of_signs = 1 / 0.3943, p
    spreads = {
        0: lambda i, j: around(i, j, F.lit(1.0 if i == j else 0.0)),
        1: lambda i, j: F.col(f"x{i}_{j}"),
        2: lambda i, j: around(i, j, of_tanh * (F.col(f"t{i}_{j}") - F.col(f"t{i}") * F.col(f"t{j}"))),
        3: lambda i, j: around(i, j, of_signs * F.col(f"u{i}_{j}")),
    }
    starts = [F.struct(F.lit(k).alias("start"), *[F.col(f"{'x' if k == 1 else 'c'}{i}").alias(f"m_{i}") for i in range(p)], *[of(i, j).alias(f"m_{i}_{j}") for i, j in _pairs()]) for k, of in spreads.items()]
    return _factored(means.select("grp", "n", F.explode(F.array(*starts)).alias("m")).select("grp", "n", "m.*"), 1.0)


def _concentrated(vectors: DataFrame, now: DataFrame, beside) -> DataFrame:
    """Mean and covariance of the nearest SHARE of the rows of each group, by each start's estimate."""
    p = len(STATISTICS)
    far = vectors.join(beside(now.select("grp", "start", "centre", "factor")), "grp").withColumn("band", F.floor(BANDS * F.log2(_distance() + 1e-9)).cast("int"))
    sums = [F.sum(f"x{i}").alias(f"m_{i}") for i in range(p)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m_{i}_{j}") for i, j in _pairs()]
    bands = far.groupBy("grp", "start", "band").agg(F.count("*").alias("n"), *sums)
    w = Window.partitionBy("grp", "start")  # a row for each band
    bands = bands.withColumns({"all": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))})
    wanted = F.ceil(SHARE * F.col("all"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wanted - (F.col("upto") - F.col("n"))) / F.col("n")))
    names = [f"m_{i}" for i in range(p)] + [f"m_{i}_{j}" for i, j in _pairs()]
    near = bands.withColumn("part", part).groupBy("grp", "start").agg(F.max("all").alias("n"), *[(F.sum(F.col("part") * F.col(c)) / F.sum(F.col("part") * F.col("n"))).alias(c) for c in names])
    return _factored(near, CONSISTENT)


def estimates(vectors: DataFrame) -> DataFrame:
    """grp, n, centre, factor, size: the minimum covariance determinant estimates of rows (grp, x0..x4).

    A start goes on as long as a step lowers its determinant by FALL, so it ends; groups whose starts have all ended aren't
    read any more.
    """
    now = materialize(_starts(vectors), "mcd")
    beside = _beside(now)
    first = lambda rows, k: rows.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy("size", "start"))).where(F.col("_r") <= k).drop("_r")
    fields, done, step = ("centre", "factor", "size"), [], 0
    while True:
        old = now.select("grp", "start", *[F.col(c).alias(f"_{c}") for c in fields])
        fell = F.coalesce(F.col("_size") - F.col("size") >= FALL / 2, F.lit(False)) if step else F.lit(True)  # the starts aren't estimates
        both = _concentrated(vectors, now, beside).join(old, ["grp", "start"]).withColumn("fell", fell)
        both = materialize(first(both, 2) if step == 1 else both, "mcd")
        lesser = [F.when(F.col("size") <= F.col("_size"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in fields]
        done.append(both.where("not fell").select("grp", "start", "n", *lesser))
        now, step = both.where("fell").select("grp", "start", "n", *fields), step + 1
        if now.isEmpty():
            return first(reduce(DataFrame.unionByName, done), 1).drop("start")


def _beside(groups: DataFrame, most: int = 20_000):
    """How to join a row for each group: by broadcast while there are few groups, so that a large group isn't shuffled to one
    task; else as Spark plans it, where adaptive execution splits large groups."""
    return F.broadcast if groups.limit(most + 1).count() <= most else lambda frame: frame


def annotate(docs: DataFrame, carry: list[str] | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """row (a struct of the carried columns, all by default), base, base_failed, distance and kept of every document."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"), F.struct("lang", "source").alias("key"), F.col("text"))
    found = base_counts(carried).select("row", "key", "base", base_failed().alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(statistics())])
    found = materialize(found, "statistics")
    usable = found.where(F.col("base.n_words") >= 50)
    # Groups: language and source, or the small ones of a language together, or those of all.
    sizes = materialize(usable.groupBy("key").agg(F.count("*").alias("n")), "groups")
    name = lambda *c: F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("?")) for x in c])
    small = sizes.where(F.col("n") < LEAST_ROWS).groupBy(F.col("key.lang").alias("lang")).agg(F.sum("n").alias("of_lang"))
    lang_of = sizes.join(small, F.col("key.lang").eqNullSafe(small["lang"]), "left").drop("lang")
    own, lang = name(F.col("key.lang"), F.col("key.source")), name(F.col("key.lang"))
    groups = lang_of.select("key", F.when(F.col("n") >= LEAST_ROWS, own).when(F.col("of_lang") >= LEAST_ROWS, lang).otherwise(F.lit("all")).alias("grp"))
    groups = materialize(groups, "groups")
    beside = _beside(groups)
    placed = found.join(beside(groups), found["key"].eqNullSafe(groups["key"]), "left").drop(groups["key"])
    fitted = estimates(placed.where("base.n_words >= 50").select("grp", *[f"x{i}" for i in range(len(STATISTICS))]))
    judged = placed.join(beside(fitted), "grp", "left").withColumn("distance", F.when(F.col("n") >= LEAST_ESTIMATE, _distance()))
    outlier = F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return judged.select("row", "base", "base_failed", "distance", (~F.col("base_failed") & ~outlier).alias("kept"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass the base rules and aren't outliers."""
    return annotate(docs).where("kept").select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = annotate(table(spark, sf_dir, "documents"), carry=["doc_id", "lang", "source"])
    return found.select("row.doc_id", *[F.col(f"base.{c}").alias(c) for c in BASE], "base_failed", "kept", F.round("distance", 4).alias("distance"))
