"""JN13, SC48 to SC53: many forms at once, by an automaton.

The forms of a lexicon are sought in a text in one pass over its signs, however many there are (Aho and Corasick's automaton,
built once a worker from a broadcast list), in place of a comparison of every text with every form. Texts stay where they are
read. Lexicons of more than `forms_a_pass` forms take several passes.

A form counts once for each text. A whole form has no letter, digit or underscore right before or after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import ship

FORMS_A_PASS = 200_000
#: Texts whose names leave a task at once.
ROWS = 1000
#: Patterns that are plain forms, whole or not; others are regular expressions.
WHOLE, PLAIN = r"^\\b([\p{L}\p{N}_](?:[\p{L}\p{N}_ ]*[\p{L}\p{N}_])?)\\b$", r"^([\p{L}\p{N}_ ]+)$"

_built: dict = {}


def automaton(token: str, forms: list[tuple[str, bool]]):
    """One automaton a worker and list of forms (form, whole)."""
    if token not in _built:
        import ahocorasick

        made: dict[str, list[int]] = {}
        for i, (form, _) in enumerate(forms):
            made.setdefault(form, []).append(i)
        tree = ahocorasick.Automaton()
        for form, numbers in made.items():
            tree.add_word(form, (len(form), tuple(numbers)))
        if made:
            tree.make_automaton()
        _built.clear()
        _built[token] = tree if made else None
    return _built[token]


def hits(tree, text: str, forms: list[tuple[str, bool]]) -> set[int]:
    """Numbers of the forms that a text holds."""
    found: set[int] = set()
    word = lambda at: 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")
    for end, (size, numbers) in tree.iter(text) if tree is not None else ():
        free = None
        for i in numbers:
            if i in found:
                continue
            if forms[i][1]:
                if free is None:
                    free = not word(end - size) and not word(end + 1)
                if not free:
                    continue
            found.add(i)
    return found


def matches(texts: DataFrame, text: str, forms: list[tuple[str, bool, str]], name: str = "pattern") -> DataFrame:
    """The rows of texts without the text, and the name of each form (form, whole, name) that it holds; a row for each name."""
    import uuid

    ship(texts.sparkSession)
    others = [f for f in texts.schema.fields if f.name != text]
    schema = StructType([*others, StructField(name, StringType())])
    parts = []
    for start in range(0, max(len(forms), 1), FORMS_A_PASS):
        few = [f for f in forms[start : start + FORMS_A_PASS] if f[0]]
        held, token = texts.sparkSession.sparkContext.broadcast(few), uuid.uuid4().hex

        def work(batches, held=held, token=token):
            import pyarrow as pa

            own = [(form, whole) for form, whole, _ in held.value]
            tree = automaton(token, own)
            for part in batches:
                texts_, rest = part.column(part.schema.get_field_index(text)), part.select([f.name for f in others])  # texts aren't repeated
                for start in range(0, len(part), ROWS):
                    at, names = [], []
                    for k, value in enumerate(texts_.slice(start, ROWS), start):
                        told = {held.value[i][2] for i in hits(tree, value.as_py() or "", own)}
                        at += [k] * len(told)
                        names += sorted(told)
                    columns = rest.take(pa.array(at, pa.int64())).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string())], [*(f.name for f in others), name])

        parts.append(texts.mapInArrow(work, schema))
    out = reduce(DataFrame.unionByName, parts)
    return out if len(parts) == 1 else out.distinct()


def met(texts: DataFrame, text: str, lexicon: DataFrame, regular) -> DataFrame:
    """texts (without the text) joined with the rows of a lexicon whose `pattern` occurs: plain forms by automaton; what's left, as
    regular expressions, meets every text, after `regular` has checked how many there are."""
    told = lexicon.select("pattern").distinct().select(
        "pattern", F.regexp_extract("pattern", WHOLE, 1).alias("whole"), F.regexp_extract("pattern", PLAIN, 1).alias("plain")
    ).withColumn("is_plain", (F.col("whole") != "") | (F.col("plain") != ""))
    rows = told.where("is_plain").collect()
    found = matches(texts, text, [(r["whole"] or r["plain"], bool(r["whole"]), r["pattern"]) for r in rows])
    out = found.join(F.broadcast(lexicon) if len(rows) <= FORMS_A_PASS else lexicon, "pattern")
    others = lexicon.join(F.broadcast(told.where("not is_plain").select("pattern")), "pattern")
    if others.isEmpty():
        return out
    return out.unionByName(texts.join(regular(others), F.expr(f"`{text}` rlike pattern")).drop(text))
