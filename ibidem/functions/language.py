"""Languages: labels, scripts, Latin, profiles, classification of books."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import constants, lookup

#: Labels of languages by ISO code.
LABELS = {
    "la": "la", "lat": "la", "latin": "la", "latim": "la", "grc": "grc", "el": "grc", "greek": "grc", "grego": "grc", "ancient greek": "grc", "grego antigo": "grc",
    "pt": "pt", "por": "pt", "portuguese": "pt", "português": "pt", "es": "es", "spa": "es", "spanish": "es", "espanhol": "es", "en": "en", "eng": "en", "english": "en", "inglês": "en",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "francês": "fr", "it": "it", "ita": "it", "italian": "it", "italiano": "it", "de": "de", "ger": "de", "deu": "de", "german": "de", "alemão": "de",
    "he": "he", "heb": "he", "hebrew": "he", "hebraico": "he", "syc": "syc", "syriac": "syc", "siríaco": "syc", "coptic": "cop", "copta": "cop", "arabic": "ar", "árabe": "ar", "ethiopic": "gez", "etíope": "gez", "ge'ez": "gez",
}
MODERN = ("pt", "es", "fr", "it", "en", "de")
EASTERN = ("syc", "cop", "ar", "gez", "he")
#: First and last code point of each script, by language, as classes of a regular expression.
SCRIPTS = {
    "grc": r"\x{0370}-\x{03D6}\x{1F00}-\x{1FFF}", "syc": r"\x{0700}-\x{074F}", "cop": r"\x{2C80}-\x{2CFF}\x{03E2}-\x{03EF}", "hy": r"\x{0530}-\x{058F}",
    "ka": r"\x{10D0}-\x{10FF}", "gez": r"\x{1200}-\x{137F}", "he": r"\x{0590}-\x{05FF}", "ar": r"\x{0600}-\x{06FF}",
}
#: Words that mark Latin.
LATIN = ("est", "non", "sed", "qui", "quod", "cum", "per", "ad", "ut", "enim", "autem", "etiam", "iam", "nunc", "sibi", "ipse", "esse", "erat", "ergo", "sanctus", "ecclesia", "deus", "dominus", "christus", "spiritus", "pater", "filius", "verbum", "gratia", "salus", "fides")
#: Stop words by which a profile tells modern languages apart.
PROFILES = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "with"),
    "fr": ("le", "la", "les", "et", "des", "une", "est", "dans", "pour", "qui"),
    "de": ("der", "die", "und", "das", "ist", "ein", "von", "den", "mit", "zu"),
    "es": ("el", "los", "las", "que", "y", "una", "por", "con", "del", "se"),
    "pt": ("o", "os", "as", "que", "e", "uma", "por", "com", "do", "não"),
}
#: Collections that hold documents, with their type.
DOCUMENT_TYPES = {"CONC": "concilio", "MAG": "outro", "CIC": "catecismo", "CDC": "direito_canonico", "CCEO": "direito_canonico", "DZ": "outro"}


def code_of(label: Column) -> Column:
    """SC40: the ISO code of a label; of several joined by / + , ; | or ' e ', the codes joined by +, each once."""
    plain = F.lower(F.trim(label))
    parts = F.filter(F.transform(F.split(F.regexp_replace(plain, r"\s+e\s+", "/"), r"[/+,;|]"), lambda p: F.trim(p)), lambda p: p != "")
    codes = F.array_distinct(F.transform(parts, lambda p: F.coalesce(lookup(LABELS, p), p)))
    return F.when(F.size(parts) > 1, F.array_join(codes, "+")).otherwise(F.coalesce(lookup(LABELS, plain), plain))


def codes_of(label: Column) -> Column:
    return F.split(code_of(label), r"\+")


def latin_hits(text: Column) -> Column:
    """struct(hits, words): marking words, and words of two or more signs."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.struct(F.size(F.filter(words, lambda w: w.isin(*LATIN))).alias("hits"), F.size(F.filter(words, lambda w: F.length(w) > 1)).alias("words"))


def is_latin(text: Column) -> Column:
    """SC41: four or more marking words that are 8 % of all."""
    found = latin_hits(text)
    return F.coalesce((found["hits"] >= 4) & (found["hits"] >= 0.08 * found["words"]), F.lit(False))


def script_of(text: Column) -> Column:
    """SC42: the language whose script has most, and at least three, of the first 300 signs; the script met first wins ties."""
    head = F.substring(text, 1, 300)
    every = [F.struct(F.length(F.regexp_replace(head, rf"[^{r}]", "")).alias("n"), (-F.length(F.regexp_extract(head, rf"^([^{r}]*)", 1))).alias("first"), F.lit(code).alias("code")) for code, r in SCRIPTS.items()]
    best = F.array_max(F.array(*every))
    return F.when((F.octet_length(head) > F.length(head)) & (best["n"] >= 3), best["code"])  # none of them has ASCII signs


def _among(words):
    return lambda w: F.array_contains(constants(words), w)


def profile_of(text: Column) -> Column:
    """The modern language whose stop words are most frequent; null where none occurs. Stands in for a statistical detector."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*{w for p in PROFILES.values() for w in p}))
    size = lambda few: [F.struct(F.size(F.filter(few, _among(p))).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, p) in enumerate(PROFILES.items())]
    best = F.transform(F.array(words), lambda few: F.array_max(F.array(*size(few))))[0]  # the words are cut once
    return F.get(F.transform(F.array(best), lambda b: F.when(b["n"] > 0, b["code"])), F.lit(0))


def query_language(text: Column, hint: Column | None = None) -> Column:
    """SC43: hint, else script, else Latin, else profile, else unknown."""
    hinted = F.nullif(code_of(hint), F.lit("")) if hint is not None else F.lit(None).cast("string")
    return F.coalesce(hinted, script_of(text), F.when(is_latin(text), "la"), profile_of(text), F.lit("unknown"))


def signs(text: Column) -> Column:
    """What tells a text's language: struct(script, latin, profile). Where several rules read it, make it a column of its own."""
    return F.struct(script_of(text).alias("script"), is_latin(text).alias("latin"), profile_of(text).alias("profile"))


def certainty(text: Column, stored: Column, told: Column | None = None) -> Column:
    """SC44: struct(detected, certainty, agrees): 0.90 by script, 0.85 Latin, 0.6 by profile, 0 unknown; told: the text's signs."""
    told = signs(text) if told is None else told
    detected = F.coalesce(told["script"], F.when(told["latin"], "la"), told["profile"], F.lit("unknown"))
    sure = F.when(told["script"].isNotNull(), 0.90).when(told["latin"], 0.85).when(told["profile"].isNotNull(), 0.60).otherwise(0.0)
    return F.struct(detected.alias("detected"), sure.alias("certainty"), F.array_contains(codes_of(stored), detected).alias("agrees"))


def extracted_languages(text: Column, current: Column, told: Column | None = None) -> Column:
    """SC45: the current label joined by / with Latin and with Greek of 20 signs or more; modern translations stay as they are."""
    greek = F.length(F.regexp_replace(text, rf"[^{SCRIPTS['grc']}]", "")) >= 20
    found = F.array_distinct(F.filter(F.array(current, F.when(is_latin(text) if told is None else told["latin"], "la"), F.when(greek, "grc")), lambda x: x.isNotNull()))
    return F.when(F.arrays_overlap(codes_of(F.coalesce(current, F.lit(""))), constants(MODERN)), current).otherwise(F.nullif(F.array_join(found, "/"), F.lit("")))


def occurrences(text: Column, marker: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def is_english(text: Column, english=(" the ", " and ", " of "), other=(" que ", " de ", " la ")) -> Column:
    """SC46: English markers outnumber the others."""
    plain = F.lower(text)
    total = lambda markers: sum((occurrences(plain, m) for m in markers), F.lit(0))
    return total(english) > total(other)


def classify_book(collection: Column, language: Column, primary: Column) -> Column:
    """SC47: struct(section, tradition, document_type)."""
    group, codes = F.upper(F.trim(collection)), codes_of(language)
    has = lambda values: F.arrays_overlap(codes, constants(values))
    document = group.isin(*DOCUMENT_TYPES)
    tradition = F.when(~primary | has(MODERN), "portuguesa").when((group == "PG") | has(("grc", "el")), "grega").when((group == "PO") | has(EASTERN), "oriental").otherwise("latina")
    return F.struct(F.when(document, "documentos").otherwise("patristica").alias("section"), F.when(~document, tradition).alias("tradition"), F.when(document, lookup(DOCUMENT_TYPES, group)).alias("document_type"))


def url_language(url: Column) -> Column:
    """SC62: a two-letter path segment, or a suffix _xx before the extension."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/([a-z]{2})/", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"[_-]([a-z]{2})\.[a-z]+$", 1), F.lit("")))


def swap_language(url: Column, language: str) -> Column:
    """SC62: the URL with another language in its path; null where it has none."""
    return F.when(url_language(url).isNotNull(), F.regexp_replace(url, r"^([a-z]+://[^/?#]*(?:/[^/?#]*?)*?)/[a-z]{2}/", rf"$1/{language}/"))


#: SC69d: names shown for codes.
NAMES = {"la": "Latin", "grc": "Greek", "pt": "Portuguese", "es": "Spanish", "en": "English", "fr": "French", "it": "Italian", "de": "German", "he": "Hebrew", "syc": "Syriac", "ar": "Arabic", "cop": "Coptic", "gez": "Ethiopic"}


def shown(label: Column) -> Column:
    """SC69d: the names of a label's languages, each once, joined by ' / '; a code without a name in capitals."""
    names = F.transform(codes_of(label), lambda c: F.coalesce(lookup(NAMES, c), F.upper(c)))
    return F.array_join(F.array_distinct(F.filter(names, lambda n: n != "")), " / ")
