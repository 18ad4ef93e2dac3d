"""Toxic spans by a linear-chain conditional random field, and documents scored by them.

Labels are of documents. Words and word beginnings that occur in toxic documents and hardly elsewhere, beyond chance, mark
the tokens of toxic documents as toxic; these labelled tokens train a two-state chain with features for words, their
beginnings of four to six letters, a bias and transitions, by gradient ascent on the conditional likelihood. For any text,
the forward-backward algorithm gives every token's marginal probability of being toxic; tokens at or above one half form
the offending spans, and the expected number of toxic tokens, through a logistic curve fitted on the labelled documents,
gives the document's score.

The field is fitted on the driver from a sample of at most MOST_TOXIC and MOST_CLEAN labelled documents, whole, in the
order of a hash of their ids. Scoring is one pass over each text in Arrow batches without a shuffle: chains of all
documents of a batch are laid end to end, cut into equal blocks, and every block advances at once.

Defined results: null or empty text has no tokens and the curve's lowest score; a document without usable labels for both
classes to learn from leaves a model that scores everything 0; repeated rows are scored alike, and of several
texts of one labelled id the least is learned from; null ids are scored; null
labels are left out; an empty table gives an empty result; other columns pass through, and clashing names go to the result.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

MOST_TOXIC, MOST_CLEAN = 700, 1400
THRESHOLD = 0.7
#: Log-likelihood ratio, beyond the logarithm of the number of candidates, from which a word or beginning marks tokens, and
#: the share of its documents that are toxic.
CHANCE, PURITY = 3.0, 0.9
BEGINNINGS = (4, 5, 6)
#: Marginals below this are the bias of the field, which would add up over long texts; they don't count.
FLOOR = 0.05
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„¿¡…–—"


def features(token: str) -> list[str]:
    """The word itself and its beginnings; a token is a lower-case run of non-space without punctuation at its ends."""
    return [f"={token}", *(token[:k] for k in BEGINNINGS if len(token) >= k)]


def tokens(texts):
    """Lower-case tokens of an Arrow array of texts: (unique names, number of each token, its document, its start, its length)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for sign in "\t\n\v\f\r":
        plain = pc.replace_substring(plain, sign, " ")
    rows = pc.split_pattern(plain, " ")
    edges = rows.offsets.to_numpy()
    size = pc.utf8_length(rows.values).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), np.diff(edges))
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    start = start - start[np.minimum(edges[:-1], max(len(start) - 1, 0))][doc] if len(start) else start
    coded = rows.values.dictionary_encode()
    full = size > 0
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()[full], doc[full], start[full], size[full]


def marginals(score, first, transition):
    """P(state 1) of every token of chains laid end to end. score: of state 1 over 0; first: where a chain begins;
    transition: 2 x 2 log weights. Blocks of the sequence advance together: first their matrices are multiplied, then the
    blocks are joined in order, then messages run within them."""
    import numpy as np

    return _messages(score, first, transition, False)[0] if len(score) else np.zeros(0)


def _messages(score, first, transition, with_pairs: bool = True):
    """Marginals, and the summed joint probabilities of neighbouring states within chains (2 x 2)."""
    import numpy as np

    n = len(score)
    length = max(1, int(math.sqrt(n)))
    blocks = -(-n // length)
    shape = (blocks, length)
    weight = np.ones(blocks * length)
    weight[:n] = np.exp(np.clip(score, -30, 30))
    new = np.ones(blocks * length, bool)  # padding: chains of their own
    new[:n] = first
    e, new = weight.reshape(shape).T.copy(), new.reshape(shape).T.copy()
    a = np.exp(transition)
    step = np.where(new[None, None], 1.0, a[:, :, None, None])  # [from, to, place, block]
    step[:, 1] *= e
    product = np.repeat(np.eye(2)[:, :, None], blocks, axis=2)
    for k in range(length):
        m = step[:, :, k]
        product = np.stack([[product[i, 0] * m[0, j] + product[i, 1] * m[1, j] for j in range(2)] for i in range(2)])
        product /= product.sum(axis=(0, 1))
    into, out = np.empty((2, blocks)), np.empty((2, blocks))
    vector = np.array([0.5, 0.5])
    for b in range(blocks):
        into[:, b] = vector
        vector = vector @ product[:, :, b]
        vector /= vector.sum()
    vector = np.array([0.5, 0.5])
    for b in reversed(range(blocks)):
        out[:, b] = vector
        vector = product[:, :, b] @ vector
        vector /= vector.sum()
    forward = np.empty((2, length, blocks))
    now = into
    for k in range(length):
        m = step[:, :, k]
        now = np.stack([now[0] * m[0, 0] + now[1] * m[1, 0], now[0] * m[0, 1] + now[1] * m[1, 1]])
        now /= now.sum(axis=0)
        forward[:, k] = now
    backward = np.empty((2, length, blocks))
    now = out
    for k in reversed(range(length)):
        backward[:, k] = now
        m = step[:, :, k]
        now = np.stack([m[0, 0] * now[0] + m[0, 1] * now[1], m[1, 0] * now[0] + m[1, 1] * now[1]])
        now /= now.sum(axis=0)
    both = forward * backward
    p = (both[1] / both.sum(axis=0)).T.ravel()[:n]
    if not with_pairs:
        return p, None
    before = np.concatenate([into[:, None], forward[:, :-1]], axis=1)
    joint = before[:, None] * step * backward[None]
    joint = joint / joint.sum(axis=(0, 1))
    joint[:, :, new] = 0
    return p, joint.sum(axis=(2, 3))


class Field:
    """A fitted chain: feature weights, bias, transitions, and the curve from expected toxic tokens to a score."""

    def __init__(self, weights: dict[str, float], bias: float, transition, slope: float, offset: float):
        self.weights, self.bias, self.transition, self.slope, self.offset = weights, bias, transition, slope, offset
        self.begin = {f for f in weights if f[:1] != "="}

    def emission(self, name: str) -> float:
        token = name.strip(PUNCTUATION)
        if token[: BEGINNINGS[0]] not in self.begin and f"={token}" not in self.weights:
            return self.bias
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))

    def read(self, texts):
        """(expected toxic tokens of each text, document, start, length and marginal of each token)."""
        import numpy as np

        names, number, doc, start, size = tokens(texts)
        scores = np.array([self.emission(x) for x in names] or [0.0])
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        p = marginals(scores[number], first, self.transition)
        return np.bincount(doc, np.where(p >= FLOOR, p, 0), minlength=len(texts)), doc, start, size, p

    def score(self, expected):
        import numpy as np

        return 1 / (1 + np.exp(-(self.slope * np.log(expected + 0.1) + self.offset)))


def fit(texts: list, toxic: list[int], rounds: int = 40) -> Field | None:
    """The field for labelled documents; None where one class is missing or no word tells them apart."""
    import numpy as np
    import pyarrow as pa

    names, number, doc, _, _ = tokens(pa.array(texts, pa.large_string()))
    single = _no_copies(number, doc, len(texts))
    texts, y = [texts[i] for i in single], np.array(toxic, bool)[single]
    if not y.any() or y.all():
        return None
    names, number, doc, _, _ = tokens(pa.array(texts, pa.large_string()))
    bare = [x.strip(PUNCTUATION) for x in names]
    kinds = [_numbered([f"={x}" for x in bare]), *(_numbered([x[:k] if len(x) >= k else "" for x in bare]) for k in BEGINNINGS)]
    rate, candidates, scores = y.mean(), 1, []
    for own, of in kinds:  # documents with each feature, by class; strings are kept once a kind
        pairs = np.unique(doc.astype(np.int64) * len(own) + of[number])
        toxic_too = y[pairs // len(own)]
        t, c = (np.bincount(pairs[which] % len(own), minlength=len(own)) for which in (toxic_too, ~toxic_too))
        n = np.maximum(t + c, 1)
        ratio = t * np.log(np.maximum(t, 1e-9) / (n * rate)) + c * np.log(np.maximum(c, 1e-9) / (n * (1 - rate)))
        scores.append(np.where((t > 0) & (t >= PURITY * n) & (own != ""), ratio, -np.inf))
        candidates += int(((t > 0) & (n > 2)).sum())
    least = CHANCE + math.log(candidates)
    marked = np.any([score[of] >= least for score, (_, of) in zip(scores, kinds, strict=True)], axis=0)
    label = marked[number] & y[doc]
    if not label.any():
        return None
    hit = np.unique(number[label])
    known: list[str] = []
    token_of, feature_of = [], []
    for own, of in kinds:  # features of the toxic tokens' names; any other token has the bias alone
        own_hit = np.bincount(of[hit], minlength=len(own)) > 0
        own_hit[own == ""] = own_hit[own == "="] = False
        place = np.cumsum(own_hit) - 1 + len(known)
        with_feature = np.flatnonzero(own_hit[of])
        token_of.append(with_feature)
        feature_of.append(place[of[with_feature]])
        known += own[own_hit].tolist()
    token_of, feature_of = np.concatenate(token_of), np.concatenate(feature_of)
    del kinds, scores, bare
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    begins = np.flatnonzero(first)
    cuts = [*begins[np.unique(np.searchsorted(begins, np.arange(0, len(doc), 200_000)).clip(max=len(begins) - 1))].tolist(), len(doc)]
    w, bias, trans = np.zeros(len(known)), -3.0, np.zeros((2, 2))
    true_tokens = np.bincount(number, label, len(names))
    inner = ~first[1:]
    true_pairs = np.array([[((label[:-1] == i) & (label[1:] == j) & inner).sum() for j in range(2)] for i in range(2)], float)
    state = [np.zeros(len(known) + 5), np.zeros(len(known) + 5)]
    for r in range(1, rounds + 1):
        score = bias + np.bincount(token_of, w[feature_of], len(names))
        p, joint = np.empty(len(doc)), np.zeros((2, 2))
        for a, b in zip(cuts, cuts[1:], strict=False):  # whole documents, some hundred thousand tokens at a time
            p[a:b], pairs_here = _messages(score[number[a:b]], first[a:b], trans)
            joint += pairs_here
        by_token = true_tokens - np.bincount(number, p, len(names))
        gradient = np.concatenate([np.bincount(feature_of, by_token[token_of], len(known)) - 0.1 * w, [by_token.sum()], (true_pairs - joint - 0.1 * trans).ravel()])
        state = [0.9 * state[0] + 0.1 * gradient, 0.99 * state[1] + 0.01 * gradient**2]
        move = 0.25 * (state[0] / (1 - 0.9**r)) / (np.sqrt(state[1] / (1 - 0.99**r)) + 1e-8)
        w, bias, trans = w + move[:-5], bias + move[-5], trans + move[-4:].reshape(2, 2)
    field = Field({f: float(w[k]) for k, f in enumerate(known)}, float(bias), trans, 1.0, 0.0)
    x = np.log(np.concatenate([field.read(pa.array(texts[k : k + 200], pa.large_string()))[0] for k in range(0, len(texts), 200)]) + 0.1)
    field.slope, field.offset = _curve(x, y)
    pa.default_memory_pool().release_unused()  # the driver has more to do
    return field


def _no_copies(number, doc, n: int):
    """Documents but for those whose least hash of three neighbouring tokens, under any of four hashes, an earlier one has.

    Copies of one document would make its rare words seem to go with its label.
    """
    import numpy as np

    code = (number[:-2].astype(np.uint64) * np.uint64(1_000_003) + number[1:-1].astype(np.uint64)) * np.uint64(1_000_033) + number[2:].astype(np.uint64)
    owner = doc[:-2]
    whole = owner == doc[2:]
    code, owner = code[whole], owner[whole]
    copies = np.zeros(n, bool)
    for k in range(4):
        mixed = (code ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, owner, mixed)
        full = np.flatnonzero(least != np.iinfo(np.uint64).max)
        _, seen = np.unique(least[full], return_index=True)
        copies[np.setdiff1d(full, full[seen])] = True
    return np.flatnonzero(~copies).tolist()


def _numbered(values: list[str]):
    """The distinct values, and the number of each value among them."""
    import numpy as np

    own: dict[str, int] = {}
    of = np.fromiter((own.setdefault(v, len(own)) for v in values), np.int64, len(values))
    return np.array(list(own), object), of


def _curve(x, y):
    """Slope and offset of a logistic regression by Newton's method, with a small penalty on both."""
    import numpy as np

    design, b = np.stack([x - x.mean(), np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ b))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        move = np.linalg.solve(hessian, design.T @ (y - p) - 0.5 * b)
        b = b + np.clip(move, -2, 2)
    return float(b[0]), float(b[1] - b[0] * x.mean())


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids are in no bucket."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from labelled documents that aren't held out (crc32 of the id, modulo 3, is 1)."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_toxic is not null and _id is not null")
    known = known.where(bucket(F.col("_id"), 3) != 1).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sampled = []
    for value, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):  # bounded: the ids come first, then their texts
        sampled += [(r[0], value) for r in known.where(F.col("_toxic") == value).orderBy(F.xxhash64("_id"), "_id").limit(most).collect()]
    if not sampled:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sampled, "_id long, _toxic int"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id", "_toxic").agg(F.min("text").alias("text")).orderBy("_id").collect()
    return fit([r["text"] for r in rows], [r["_toxic"] for r in rows])


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """Adds score (0 to 1), toxic_tokens (their expected number) and spans (start, length, marginal of tokens at 0.5 or more)."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(field)
    docs = docs.drop("score", "toxic_tokens", "spans")
    added = "score double, toxic_tokens double, spans array<struct<start: int, length: int, marginal: double>>"

    def work(parts):
        import numpy as np
        import pyarrow as pa

        from .tokens import batches

        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("marginal", pa.float64())]))
        for part in parts:
            at = part.schema.get_field_index("text")
            for a, b in batches(part.column(at), 2_000_000):
                own = part.slice(a, b - a)
                if held.value is None:
                    expected, score, spans = np.zeros(b - a), np.zeros(b - a), pa.array([[]] * (b - a), kind)
                else:
                    expected, doc, start, size, p = held.value.read(own.column(at))
                    score, hot = held.value.score(expected), p >= 0.5
                    edges = np.searchsorted(doc[hot], np.arange(b - a + 1)).astype(np.int32)
                    values = pa.StructArray.from_arrays([pa.array(start[hot].astype(np.int32)), pa.array(size[hot].astype(np.int32)), pa.array(p[hot])], fields=list(kind.value_type))
                    spans = pa.ListArray.from_arrays(pa.array(edges), values)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score), pa.array(expected), spans], [*own.schema.names, "score", "toxic_tokens", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(work, f"{schema}, {added}")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return tag(docs, train(docs, labels))


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_tokens", "spans")
