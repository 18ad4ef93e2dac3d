"""Fill-in-the-middle transformation with a sparse index of checkpoints.

A text is cut by units: a word with the white space before it, or white space at the end. Counting reads the text's bytes
once, in blocks, and keeps the byte and code-point offset before every EVERY-th unit alone. A cut then is found by a binary
search for the checkpoint before it and a short rescan, so a long text needs no list of its units: about one pair of numbers
for each 64 of them.

Which units are cut at, and the form of the output, come from the sha256 of seed and doc_id, so reruns agree. Texts that
hold a sentinel stay plain, so prefix, suffix and middle can always be told apart again: `restored` does that with string
functions of Spark alone.

Defined results: null text is empty; an empty text is plain; a null doc_id counts as an empty one in the hash; white space
alone is one unit; repeated rows stay and are treated alike; an empty table gives an empty result. Other columns, of
whatever name, come along unchanged in `infilled`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship, table

EVERY = 64
BLOCK = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Checkpoints:
    """Where every `every`-th unit of a text begins, in bytes and in code points, with the number of its units."""

    def __init__(self, data: bytes, every: int = EVERY, block: int = BLOCK):
        import numpy as np

        self.data, self.every = data, every
        view = np.frombuffer(data, np.uint8)
        at, points, n, n_points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0, 0
        for start in range(0, len(view), block):
            ends = start + self._ends(view, start, min(start + block, len(view)))
            first = -(n + 1) % every  # the place among the block's ends of the next unit whose number is a multiple
            kept = ends[first::every]
            leads = (view[start : start + block] & 0xC0) != 0x80
            at.append(kept)
            points.append(n_points + np.concatenate([[0], np.cumsum(leads)])[kept - start] if len(kept) else kept)
            n, n_points = n + len(ends), n_points + int(np.count_nonzero(leads))
        self.at, self.points = np.concatenate(at), np.concatenate(points)
        self.n, self.n_points = n, n_points

    @staticmethod
    def _ends(view, start: int, stop: int):
        """The places after the units that end within view[start:stop], counted from start."""
        import numpy as np

        own = view[start : min(stop + 1, len(view))]  # with the byte after, which tells whether a word goes on
        space = (own == 32) | ((own >= 9) & (own <= 13))
        over = ~space[: stop - start]
        over[: len(own) - 1] &= space[1:]
        if stop == len(view):
            over[-1] = True  # the last unit, a word or white space
        return np.flatnonzero(over) + 1

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset after the first `unit` units: the checkpoint before, then a rescan up to the unit's end."""
        import numpy as np

        if not 0 <= unit <= self.n:
            raise IndexError(unit)
        if unit == self.n:
            return len(self.data), self.n_points
        numbers = range(0, len(self.at) * self.every, self.every)  # the unit that each checkpoint stands before
        k = _last_at_most(numbers, unit)
        byte, point, rest = int(self.at[k]), int(self.points[k]), unit - numbers[k]
        if rest:
            stop = int(self.at[k + 1]) if k + 1 < len(self.at) else len(self.data)
            view = np.frombuffer(self.data, np.uint8)[byte:stop]
            end = int(self._ends(view, 0, len(view))[rest - 1])
            point += int(np.count_nonzero((view[:end] & 0xC0) != 0x80))
            byte += end
        return byte, point


def _last_at_most(numbers, value: int) -> int:
    from bisect import bisect_right

    return bisect_right(numbers, value) - 1


def transform(doc_id: int | None, text: str | None, seed: int = 42, share: int = 50, spm: int = 80) -> tuple:
    """n, form, code points of prefix and middle (None where plain), and the output, of one document."""
    import hashlib

    text = text or ""
    data = text.encode()
    index = Checkpoints(data)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= share or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, text
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_points), (b, b_points) = index.cut(low), index.cut(high)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    form = "spm" if h4 % 100 < spm else "psm"
    parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return index.n, form, a_points, b_points - a_points, "".join(parts)


def infilled(docs: DataFrame, seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """Every document, with the text transformed: the columns of docs (text as it comes out), then n, form, prefix_chars and
    middle_chars in a struct `infill`. `share` in a hundred texts are transformed, `spm` in a hundred of these begin with the suffix."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = [inner.schema["others"]]
    held += [StructField(n, LongType()) for n in ("n", "prefix_chars", "middle_chars")] + [StructField(n, StringType()) for n in ("form", "output")]

    def work(parts):
        import pyarrow as pa

        for part in parts:
            for few in _slices(part):
                rows = [transform(d, t, seed, share, spm) for d, t in zip(few.column(1).to_pylist(), few.column(2).to_pylist(), strict=True)]
                n, form, prefix, middle, text = zip(*rows, strict=True)
                columns = [few.column(0)] + [pa.array(c, pa.int64()) for c in (n, prefix, middle)] + [pa.array(c, pa.string()) for c in (form, text)]
                yield pa.RecordBatch.from_arrays(columns, ["others", "n", "prefix_chars", "middle_chars", "form", "output"])

    out = inner.mapInArrow(work, StructType(held))
    shown = [F.col("output").alias("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns]
    return out.select(*shown, F.struct("n", "form", "prefix_chars", "middle_chars").alias("infill"))


def _slices(part):
    """A batch in slices of about 8 MB of text, so that memory doesn't follow the Arrow batch."""
    from .tokens import batches

    for a, b in batches(part.column(2)):
        yield part.slice(a, b - a)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form: what lies between the sentinels, in order."""
    last = F.substring_index(output, MIDDLE, -1)
    before = F.substring_index(output, MIDDLE, 1)  # both first parts
    psm = F.concat(F.replace(F.substring_index(before, SUFFIX, 1), F.lit(PREFIX), F.lit("")), last, F.substring_index(before, SUFFIX, -1))
    spm = F.concat(F.substring_index(before, PREFIX, -1), last, F.replace(F.substring_index(before, PREFIX, 1), F.lit(SUFFIX), F.lit("")))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13(spark, sf_dir: str) -> DataFrame:
    out = infilled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    form, text = F.col("infill.form"), F.col("text")
    return out.select(
        "doc_id", F.col("infill.n").alias("n"), form.alias("form"), F.col("infill.prefix_chars").alias("prefix_chars"), F.col("infill.middle_chars").alias("middle_chars"),
        F.sha2(text, 256).alias("output_sha256"), F.sha2(restored(text, form), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS digest
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST(concat('0x', substr(digest, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(digest, 9, 8)) AS BIGINT) AS h2,
    CAST(concat('0x', substr(digest, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(digest, 25, 8)) AS BIGINT) AS h4
  FROM units
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s
  FROM cuts
), outputs AS (
  SELECT doc_id, n, form, length(p) AS pc, length(m) AS mc,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END AS output
  FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN pc END AS prefix_chars, CASE WHEN form <> 'plain' THEN mc END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN concat(substr(output, 4, strpos(output, '<S>') - 4), substr(output, strpos(output, '<M>') + 3), substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3))
    ELSE concat(substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3), substr(output, strpos(output, '<M>') + 3), substr(output, 4, strpos(output, '<P>') - 4)) END) AS restored_sha256
FROM outputs
"""
