"""Normal forms of text, as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that isn't a single blank, in Java's regular expressions.
SPACES = r"(?U) \s+|[\s&&[^ ]]\s*"


@cache
def _accents() -> tuple[str, str]:
    """Precomposed letters of the Latin, Greek and Cyrillic blocks, and their base letters, by Unicode decomposition."""
    source, target = [], []
    for lo, hi in ((0xC0, 0x24F), (0x370, 0x52F), (0x1E00, 0x1FFF)):
        for c in map(chr, range(lo, hi + 1)):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c:
                source.append(c)
                target.append(base)
    return "".join(source), "".join(target)


def strip_accents(text: Column) -> Column:
    """A text of ASCII alone has none and stays as it is."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", ""))


def collapse(text: Column) -> Column:
    """A single blank stays; runs of white space, and other white space, become one."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def fold(text: Column) -> Column:
    """SC1: without accents, white space collapsed, lower case."""
    return F.lower(collapse(strip_accents(text)))


def clean_ocr(text: Column) -> Column:
    """SC2: digits glued before a capital go, curly and angle quotes become plain, white space collapses."""
    bare = F.regexp_replace(text, r"(?U)\b\d+(?=\p{Lu})", "")
    return collapse(F.translate(bare, "“”‘’«»", "\"\"''\"\""))


def alias_form(text: Column) -> Column:
    """SC3: lower case without accents, trimmed; inner white space stays."""
    return F.trim(strip_accents(F.lower(text)))


def author_core(text: Column) -> Column:
    """SC4: a name without honorifics and particles, which are fixed values."""
    bare = F.regexp_replace(alias_form(F.coalesce(text, F.lit(""))), r"\b(santo|santa|sao|beato|beata|papa|padre)\b", " ")
    return collapse(F.regexp_replace(bare, r"\b(de|da|do|dos|das|e)\b", " "))


def plain_words(text: Column) -> Column:
    """SC5: folded, punctuation to spaces."""
    return collapse(F.regexp_replace(F.lower(strip_accents(text)), r"[^\p{L}\p{N}_\s]", " "))


def letters_only(text: Column) -> Column:
    """SC6: folded, all but letters and digits to spaces."""
    return collapse(F.regexp_replace(F.lower(strip_accents(text)), r"[^\p{L}\p{N}]+", " "))


def saint_form(text: Column) -> Column:
    """SC7: a saint's name without honorifics."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(text)), r"\b(sao|santo|santa|beato|beata|sto|sta)\b", " "), r"[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    """SC8: folded, runs of other signs to one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def file_key(name: Column) -> Column:
    """SC9: a file name as a key: no extension, no long numbers, no words of format."""
    bare = F.regexp_replace(F.regexp_replace(fold(name), r"\.[a-z0-9]{2,5}$", ""), r"[^a-z0-9]+", " ")
    return collapse(F.regexp_replace(bare, r"\b(\d{7,}|pdf|ocr|scan|copy|copia|final)\b", " "))


def session_key(text: Column) -> Column:
    """SC10: a compact key in which 'session IV' and 'session 4' agree; longer numerals are rewritten first."""
    out = letters_only(text)
    for numeral, number in (("viii", 8), ("vii", 7), ("iii", 3), ("iv", 4), ("vi", 6), ("ix", 9), ("ii", 2), ("x", 10), ("v", 5), ("i", 1)):
        out = F.regexp_replace(out, rf"\b(sess(?:ao|ion|io)|session) {numeral}\b", f"$1 {number}")
    return F.regexp_replace(out, " ", "")


def limited(text: Column, limit: int = 240) -> Column:
    """Text of at most limit signs, the last an ellipsis if some are cut."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def title_from_file(name: Column, limit: int = 240) -> Column:
    """SC11: a readable title from a file name."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[A-Za-z0-9]{2,5}$", "")
    bare = F.regexp_replace(F.regexp_replace(stem, r"[-_ ]+[0-9a-f]{8,}$", ""), r"[_\-]+", " ")
    return limited(collapse(bare), limit)


def squeeze_lines(text: Column) -> Column:
    """SC12: line feeds only, at most one blank line in a row, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


#: SC13. UTF-8 read as Latin-1, by what it should be.
MOJIBAKE = {"Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú", "Ã£": "ã", "Ãµ": "õ", "Ã§": "ç", "Ã¢": "â", "Ãª": "ê", "â€™": "’", "â€œ": "“", "â€": "”", "Â ": " "}


def fix_mojibake(text: Column) -> Column:
    for wrong, right in MOJIBAKE.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def composed_udf():
    """SC13: Unicode composition (NFC), for which Spark has no function of its own; over Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def composed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return composed


def safe_file(name: Column, limit: int = 120) -> Column:
    """SC14: an ASCII file name of at most limit signs; the extension stays."""
    ascii_name = F.regexp_replace(F.regexp_replace(strip_accents(name), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", "")
    suffix = F.regexp_extract(ascii_name, r"(\.[A-Za-z0-9]{1,8})$", 1)
    stem = F.substring(ascii_name, F.lit(1), F.length(ascii_name) - F.length(suffix))
    return F.concat(F.substring(stem, F.lit(1), F.lit(limit) - F.length(suffix)), suffix)


#: SC15. Named character references that decode() knows; numeric ones in ASCII and Latin-1 follow by rule.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»"}


def decode_entities(text: Column) -> Column:
    """Named references of ENTITIES, decimal and hexadecimal ones up to 255; the ampersand last."""
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    numeric = F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,3});"), F.lit(1))
    text = F.aggregate(F.array_distinct(numeric), text, lambda out, d: F.replace(out, F.concat(F.lit("&#"), d, F.lit(";")), F.when(d.cast("int") < 256, F.decode(F.unhex(F.lpad(F.hex(d.cast("int")), 2, "0")), "ISO-8859-1")).otherwise(F.concat(F.lit("&#"), d, F.lit(";")))))
    hexes = F.regexp_extract_all(text, F.lit(r"&#[xX]([0-9a-fA-F]{1,2});"), F.lit(1))
    text = F.aggregate(F.array_distinct(hexes), text, lambda out, d: F.replace(F.replace(out, F.concat(F.lit("&#x"), d, F.lit(";")), F.decode(F.unhex(F.lpad(d, 2, "0")), "ISO-8859-1")), F.concat(F.lit("&#X"), d, F.lit(";")), F.decode(F.unhex(F.lpad(d, 2, "0")), "ISO-8859-1")))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def escape_markup(text: Column) -> Column:
    """SC16."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def roman(number: Column, most: int = 100) -> Column:
    """SC17: the numeral of 1 to most; empty for 0 and beyond."""
    def numeral(n: int) -> str:
        out = ""
        for value, sign in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out, n = out + sign * (n // value), n % value
        return out

    table = F.array(*[F.lit(numeral(n)) for n in range(1, most + 1)])
    return F.when(number.between(1, most), F.element_at(table, number.cast("int"))).otherwise(F.lit(""))


SMALL_WORDS = ("a", "ad", "and", "da", "das", "de", "do", "dos", "e", "em", "et", "in", "of", "on", "the", "to")


def smart_title(text: Column) -> Column:
    """SC18: words with a capital, small ones lower unless first, Roman numerals upper; white space stays."""
    cut = F.split(text, r"(?<=\s)(?=\S)")
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])

    def one(word: Column, i: Column) -> Column:
        bare = F.lower(F.rtrim(word))
        shaped = F.when(bare.rlike(r"^[ivxlcdm]+[.,;:]?$") & (F.length(bare) > 1), F.upper(word)).when((i > 0) & F.array_contains(small, bare), F.lower(word))
        return shaped.otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word)))))

    return F.array_join(F.transform(cut, one), "")


def path_part(text: Column, limit: int = 120, default: str = "untitled") -> Column:
    """SC19: text fit for a folder's name."""
    plain = F.regexp_replace(F.translate(text, "–—", "--"), r'[<>:"/\\|?*]+', " ")
    return F.coalesce(F.nullif(F.rtrim(F.substring(collapse(plain), 1, limit)), F.lit("")), F.lit(default))
