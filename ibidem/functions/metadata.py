"""Metadata read from titles, paths and text by ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ibidem.operators.lexicon_match import met
from ibidem.operators.shared import lexicon as bounded

from .lexicon import POPES
from .text import fold, letters_only, roman, title_from_file


def first_rule(text: Column, rules: dict[str, str], parts: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The name of the first rule whose pattern occurs; parts: strings of which a rule's pattern needs one, which are sought first."""
    met = lambda name: has_any(text, parts[name]) & text.rlike(rules[name]) if parts else text.rlike(rules[name])
    return F.coalesce(*[F.when(met(name), name) for name in rules])


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of some strings. Those with the same four first signs are sought only where these are."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[:4], []).append(word)
    either = lambda few: reduce(lambda a, b: a | b, [text.contains(w) for w in few])
    return reduce(lambda a, b: a | b, [either(few) if len(few) == 1 else text.contains(head) & either(few) for head, few in groups.items()])


def extract(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that occurs."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def one_run(text: Column) -> Column:
    """A text with an x for every sign that isn't printable ASCII, line ends too: such a sign is a word's sign, so a number beside
    it doesn't stand alone."""
    return F.regexp_replace(text, r"[^ -~]", "x")


def first_year(text: Column) -> Column:
    """SC58."""
    return extract(text, r"\b(1[0-9]{3}|20[0-9]{2})\b").cast("int")


def last_year(text: Column) -> Column:
    """SC69."""
    years = F.regexp_extract_all(text, F.lit(r"\b((?:18|19|20)[0-9]{2})\b"), F.lit(1))
    return F.when(F.size(years) > 0, F.element_at(years, -1)).cast("int")


def volume(text: Column) -> Column:
    return extract(F.lower(text), r"\b(?:vol(?:ume)?|tom(?:e|o)?|t)[. ]*0*([0-9]{1,3})\b").cast("int")


def volume_in(lower: Column) -> Column:
    """SC58 of a whole text in lower case, whose signs beyond printable ASCII are a word's; most texts have no such number at all."""
    return F.when(lower.rlike(r"[lemot][. ]*[0-9]"), volume(one_run(lower)))


DOCUMENT_KINDS = {"encyclical": r"enc[yi]clic", "bull": r"\bbula?l?\b", "exhortation": r"exhorta", "constitution": r"constitu", "letter": r"\b(letter|carta|epistle)\b", "council": r"\b(council|conc[ií]lio)\b"}
#: What a text must hold for these patterns to occur.
KIND_PARTS = {"encyclical": ("clic",), "bull": ("bul",), "exhortation": ("exhorta",), "constitution": ("constitu",), "letter": ("letter", "carta", "epistle"), "council": ("council", "conc")}


def document_kind(text: Column, lower: Column | None = None) -> Column:
    return F.coalesce(first_rule(F.lower(text) if lower is None else lower, DOCUMENT_KINDS, KIND_PARTS), F.lit("other"))


def pope(text: Column) -> Column:
    """SC61: a pope's name with its numeral, whatever the form of the name; of several the first in the lexicon's order."""
    plain = letters_only(text)
    found = []
    for name, forms in POPES.items():
        numeral = F.regexp_extract(plain, rf"\b(?:{'|'.join(forms)}) ([ivx]+)\b", 1)
        found.append(F.when(numeral != "", F.concat(F.lit(name + " "), F.upper(numeral))))
    return F.coalesce(*found)


def translator(text: Column) -> Column:
    """SC56: a translator's name of two to six words in capitals, without words of an edition."""
    name = extract(text, r"(?i:translated by|translation by|translator:|traduzido por|tradução de)\s+([A-ZÀ-Ý][\p{L}.'-]+(?:\s+(?:de|da|do|von|van|[A-ZÀ-Ý][\p{L}.'-]*)){1,5})")
    cut = F.regexp_replace(name, r"(?i)\s+(edition|edição|press|publisher|editora)\b.*$", "")
    return F.when((F.length(cut) >= 5) & ~F.lower(cut).rlike(r"unknown|anonymous|copyright"), cut)


#: SC57. Publishers in the order in which they're sought, with the folded forms that tell them, as whole words.
PUBLISHERS = {
    "Paulus": ("paulus",), "Loyola": ("editora loyola", "edicoes loyola", "loyola editora"), "Vozes": ("vozes",), "Paulinas": ("paulinas",), "Ecclesiae": ("ecclesiae",),
    "Editora Família Católica": ("familia catolica",), "Apostolado Sociedade Católica": ("apostolado sociedade catolica",), "Realeza": ("realeza",), "Quadrante": ("quadrante",),
    "Cultor de Livros": ("cultor de livros",), "Permanência": ("permanencia",), "Cristo Rei": ("cristo rei",), "Cléofas": ("cleofas",), "Molokai": ("molokai",), "Santuário": ("santuario",),
}


def publisher_rules() -> dict[str, str]:
    """A pattern on folded text for each publisher."""
    return {name: r"\b(?:" + "|".join(forms) + r")\b" for name, forms in PUBLISHERS.items()}


def publisher(text: Column, folded: Column | None = None) -> Column:
    """SC57."""
    return first_rule(fold(text) if folded is None else folded, publisher_rules(), PUBLISHERS)


def publisher_label_ok(label: Column) -> Column:
    """FLT13: a label of 2 to 60 signs that isn't a number, a code or a placeholder."""
    return F.coalesce(F.length(F.trim(label)).between(2, 60) & ~label.rlike(r"^\s*[0-9]+\s*$") & ~F.lower(label).isin("unknown", "n/a", "none", "-"), F.lit(False))


def path_metadata(path: Column) -> Column:
    """SC60: struct(number, year, language, title) of a path '<number> - <title> (<year>)/<file>_<language>.pdf'."""
    parts = F.split(path, "/")
    folder, name = F.element_at(parts, -2), F.element_at(parts, -1)
    title = F.trim(F.regexp_replace(F.regexp_replace(folder, r"^\s*[0-9]{1,3}\s*[-.]\s*", ""), r"\s*\(?[0-9]{3,4}\)?\s*$", ""))
    return F.struct(
        extract(folder, r"^\s*([0-9]{1,3})\s*[-.]").cast("int").alias("number"),
        extract(folder, r"\b([0-9]{3,4})\)?\s*$").cast("int").alias("year"),
        extract(name, r"_([a-z]{2})\.[A-Za-z0-9]+$").alias("language"),
        title.alias("title"),
    )


#: SC66. Groups of prayers in the order in which they're sought, with keywords of folded titles, within words too;
#: those of BASE are whole titles.
PRAYERS = (
    ("NOV", ("novena", "triduo", "decenario", "trintena")),
    ("VIACR", ("via-sacra", "via sacra", "sete palavras", "cruz", "sagrada face")),
    ("SEQ", ("sequencia", "te deum", "gloria a deus nas alturas", "ritos iniciais")),
    ("EUCA", ("eucarist", "sacramentado", "santissimo", "alma de cristo", "comunhao", "missa", "acolito", "corpus christi", "preciosissimo sangue", "sangue de jesus", "santas chagas", "chagas")),
    ("ESP", ("espirito santo", "pentecostes", "veni creator", "vem, espirito", "sabedoria de salomao", "divino espirito")),
    ("DOUT", (
        "santo agostinho", "santo afonso", "santo alberto", "santo ambrosio", "santo anselmo", "santo atanasio", "santo efram", "santo efrem", "santo hilario", "santo irineu", "sao basilio",
        "sao bernardo", "sao boaventura", "sao cirilo", "sao gregorio", "sao jeronimo", "sao joao crisostomo", "sao joao da cruz", "sao joao damasceno", "sao joao de avila", "sao leao magno",
        "sao lourenco de brindisi", "sao pedro crisologo", "sao pedro damiao", "sao roberto belarmino", "sao tomas de aquino", "santa catarina de sena", "santa hildegarda", "santa teresa de avila",
        "tarde te amei", "gregorio de narek",
    )),
    ("BIBLIA", ("biblia", "evangelho", "padre jonas", "palavra de deus", "prologo do evangelho")),
    ("DIARIA", ("oracao da manha", "oracao da noite", "oferecimento do dia", "exame de consciencia", "ato de contricao", "confissao")),
    ("BASE", ("ave-maria", "ave maria", "creio", "gloria ao pai", "o credo niceno-constantinopolitano", "oracao do creio", "pai-nosso", "pai nosso", "persignacao", "santo anjo do senhor")),
    ("JOSE", ("sao jose", "pai adotivo de jesus", "jose dormindo", "coracao de sao jose")),
    ("MARIA", (
        "nossa senhora", "maria,", "maria santissima", "mariano", "mariana", "rosario", "salve-rainha", "salve rainha", "angelus", "magnificat", "imaculada", "aparecida", "fatima", "lourdes", "carmo",
        "perpetuo socorro", "desatadora", "pieta", "virgem", "auxiliadora", "desterro", "guadalupe", "nazare",
    )),
    ("SANTOS", ("sao luigi maria",)),
    ("SANTAS", ("santa ", "santas ", "nha chica", "madre teresa", "teresinha", "rita", "clara", "gianna", "edwiges", "luzia", "margarida", "paulina", "dulce")),
    ("SANTOS", ("sao ", "santo ", "santos ", "arcanjo", "anjo da guarda", "anjos", "beato", "padre pio", "carlo acutis", "pier giorgio")),
)


def prayer_kind(title: Column, folded: Column | None = None) -> Column:
    """SC66: the group of the first keyword that a title has, DIV if it has none."""
    plain = fold(title) if folded is None else folded
    told = [F.when(plain.isin(*words) if code == "BASE" else has_any(plain, words), code) for code, words in PRAYERS]
    return F.coalesce(*told, F.lit("DIV"))


#: SC68. Keywords by which a request's task is told, within words too.
ROUTES = {
    "ingest": ("pdf", "upload", "upar", "ingest", "ingerir", "importar", "patrologia", "pg", "pl", "concilio", "concílio", "ecumenico", "ecuménico"),
    "verify": ("cita", "atribu", "disse", "escreveu"),
}


def route(task: Column, lower: Column | None = None) -> Column:
    """SC68: the first task of which a keyword occurs, within words too."""
    plain = F.lower(task) if lower is None else lower
    return F.coalesce(*[F.when(plain.contains(word), name) for name, words in ROUTES.items() for word in words], F.lit("general"))


def paragraph_kind(text: Column) -> Column:
    """SC64."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    capital = (F.length(letters) > 0) & (F.upper(letters) == letters)
    return F.when(capital & (F.length(text) <= 90), "heading").when((F.length(text) <= 90) & text.rlike(r"^(chapter|canon|session|part|article|[IVXLC]+\.)\b"), "subheading").otherwise("body")


def noise_paragraph(text: Column) -> Column:
    """SC65: navigation, copyright, breadcrumbs, a slug or a stray tag."""
    plain = F.lower(F.trim(text))
    return plain.rlike(r"^(home|back|next|previous|top|index|print|share|search)$|copyright|all rights reserved|javascript") | text.rlike(r"^\S+( > \S+)+$|^[a-z]+([A-Z][a-z]+){2,}$|^</?[a-z]+>?$")


def traditions(tradition: Column, languages: Column) -> Column:
    """SC67: the traditions of a book; one in Greek and Latin belongs to both."""
    both = F.array_contains(languages, "grc") & F.array_contains(languages, "la")
    return F.when(both, F.array(F.lit("grega"), F.lit("latina"))).otherwise(F.array(F.coalesce(tradition, F.lit("other"))))


def century(year: Column) -> Column:
    """SC70: the century of a year; 0 for year 0."""
    return F.ceil(F.abs(year) / 100).cast("int")


def century_label(year: Column) -> Column:
    return F.when(year.isNotNull(), F.concat(F.when(year < 0, F.lit("-")).otherwise(F.lit("")), roman(century(year))))


def plan_rank(plan: Column, plans=("free", "basic", "pro", "institution")) -> Column:
    """SC76: the place of a plan, 0 for none."""
    return F.coalesce(F.array_position(F.array(*[F.lit(p) for p in plans]), plan), F.lit(0)).cast("int")


def gated(value: Column, plan: Column, least: int) -> Column:
    """FLT12: a value shown from a plan's rank on."""
    return F.when(plan_rank(plan) >= least, value)


def centre(text: Column, length: int = 400, cap: int = 800) -> Column:
    """SC69c: the middle of a text; short texts whole, at most cap signs."""
    return F.when(F.length(text) > length, F.substring(text, F.greatest(F.floor(F.length(text) / 2).cast("int") - length // 2, F.lit(0)) + 1, F.lit(length))).otherwise(F.substring(text, 1, cap))


def lexicon_scores(texts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """SC48, SC52: for each text and author of a lexicon (author, ordinal, pattern, weight), the sum of the weights of its
    patterns that occur in the folded text. Plain forms, between word borders or not, are sought all at once; regular expressions
    are tried one by one, and are few, which is checked."""
    return _met(texts, lexicon, key, text).groupBy(key, "author").agg(F.sum("weight").alias("score"), F.min("ordinal").alias("ordinal"))


def best_author(scores: DataFrame, key: str = "id", least: int = 2, ties: str = "first") -> DataFrame:
    """AG22, SC48, SC52: the author of the highest score from `least` on. On a tie the first of the lexicon, or null."""
    rank = F.struct("score", (-F.col("ordinal")).alias("o"), "author")
    top = scores.groupBy(key).agg(F.max(rank).alias("b"), F.max("score").alias("m"), F.collect_list("score").alias("all"))
    tied = F.size(F.filter("all", lambda s: s == F.col("m"))) > 1
    author = F.when(F.col("m") >= least, F.when(tied, F.lit(None)).otherwise(F.col("b.author")) if ties == "null" else F.col("b.author"))
    return top.select(key, author.alias("author"), F.col("m").alias("score"), (F.col("m") < least + 1).alias("weak"))


def _met(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    return met(texts.select(key, fold(F.col(text)).alias("_text")), "_text", lexicon, bounded)


def first_title(texts: DataFrame, titles: DataFrame, key: str = "id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """SC49, SC50: the title of the first pattern (title, ordinal, pattern) that occurs, with more columns of its row if named."""
    first = _met(texts, titles, key, text).groupBy(key).agg(F.min_by(F.struct("title", *more), "ordinal").alias("_b"))
    return first.select(key, *[F.col("_b")[c].alias(c) for c in ("title", *more)])


def church_document(books: DataFrame, documents: DataFrame, key: str = "id", title: str = "title", sample: str = "sample") -> DataFrame:
    """SC50: what the first document (ordinal, pattern, canonical_title, default_year, and more if there is) that a book's title or
    sample names says of the book: key, canonical_title (else the title), year (the title's, else the default), edition_label
    (both), and the columns besides. Books that name none are left out."""
    more = [c for c in documents.columns if c not in ("ordinal", "pattern", "canonical_title", "default_year")]
    texts = books.select(key, F.concat_ws("\n", title, sample).alias("_all"))
    first = first_title(texts, documents.withColumnRenamed("canonical_title", "title"), key, "_all", ("default_year", *more)).withColumnRenamed("title", "_canonical")
    found = first.join(books.select(key, F.col(title).alias("_title")), key)
    name, year = F.coalesce(F.nullif("_canonical", F.lit("")), F.trim("_title")), F.coalesce(first_year(F.col("_title")), F.col("default_year").cast("int"))
    label = F.when((name != "") & year.isNotNull(), F.concat(name, F.lit(" — "), year.cast("string"))).otherwise(F.coalesce(name, F.lit("")))
    return found.select(key, name.alias("canonical_title"), year.alias("year"), label.alias("edition_label"), *more)


def collected_volumes(texts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text", least: int = 3) -> DataFrame:
    """SC53: labels of which at least so many patterns occur."""
    return _met(texts, lexicon, key, text).groupBy(key, F.col("author").alias("label")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def assembled(row: Column, override: Column, church: Column, patristic: Column) -> Column:
    """SC59: a field by precedence: override, church document, patristic, generic."""
    return F.coalesce(override, church, patristic, row)


def file_metadata(path: Column) -> Column:
    """SC11, SC58 of a path: struct(title, volume, year, kind, pope)."""
    title = title_from_file(path)
    return F.struct(title.alias("title"), volume(title).alias("volume"), first_year(path).alias("year"), document_kind(path).alias("kind"), pope(path).alias("pope"))


def alias_of(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """SC51: adds the canonical name of a folded alias (alias, canonical), else the name itself."""
    from .text import alias_form

    table = aliases.groupBy(alias_form(F.col("alias")).alias("_alias")).agg(F.min("canonical").alias("canonical"))
    return names.join(table, alias_form(F.col(name)) == F.col("_alias"), "left").withColumn("canonical", F.coalesce("canonical", name)).drop("_alias")


def fuzzy_kind(names: DataFrame, kinds: DataFrame, name: str = "name") -> DataFrame:
    """SC69b, JN14: the kind (kind, ordinal) equal to a name, else the first in order of which one lies in the other."""
    table = bounded(kinds.select(F.lower("kind").alias("_kind"), F.col("kind"), "ordinal"))
    plain = F.lower(F.trim(F.col(name)))
    met = names.select(name).distinct().join(table, plain.contains(F.col("_kind")) | F.col("_kind").contains(plain))
    order = Window.partitionBy(name).orderBy((plain == F.col("_kind")).desc(), "ordinal")
    best = met.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(name, "kind")
    return names.join(best, name, "left")


#: SC54: words and spellings that tell Brazilian Portuguese.
BRAZILIAN = ("você", "vocês", "equipe", "ônibus", "trem", "fato", "contato", "registro", "gênero", "acadêmico", "econômico", "esporte")


def is_brazilian(text: Column, markers=BRAZILIAN, least: int = 3, lower: Column | None = None) -> Column:
    """SC54: at least so many of the markers occur as words."""
    lower = F.lower(text) if lower is None else lower
    words = F.array_distinct(F.split(F.regexp_replace(lower, r"[^\p{L}]+", " "), " "))
    held = reduce(lambda a, b: a + b, [lower.contains(m).cast("int") for m in markers]) >= least  # within words too, before texts are cut
    return F.coalesce(held & (F.size(F.array_intersect(words, F.array(*[F.lit(m) for m in markers]))) >= least), F.lit(False))


def parsed_record(text: Column) -> Column:
    """SC55: struct(year, volume, kind, pope, publisher, translator, brazilian) read from the text of a title page."""
    return F.struct(
        first_year(text).alias("year"), volume(text).alias("volume"), document_kind(text).alias("kind"), pope(text).alias("pope"),
        publisher(text).alias("publisher"), translator(text).alias("translator"), is_brazilian(text).alias("brazilian"),
    )
