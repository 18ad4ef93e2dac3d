"""Evidence about a quotation and the deterministic verdict drawn from it."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alias_form, author_core, clean_ocr, fold, plain_words

#: SC20. Words and phrases of modern academic prose.
MODERN_WORDS = (
    "reinterpretação", "ressignificação", "ressignificar", "ressignifica", "releitura", "desconstrução", "reapropriação", "reapropria", "paradigmático", "paradigmaticamente",
    "epistemológico", "epistêmico", "contextualização", "contextualizar", "intertextualidade", "narratividade", "performatividade", "reinterpreta", "ressignificam", "posteriores", "releituras",
)
MODERN_PHRASES = (
    "intérpretes posteriores", "construção viva", "legado vivo", "participação ativa", "reinterpretação da tradição", "ativamente na construção", "cada comunidade participa", "hermenêutica do", "ao longo da história",
)
#: SC22. The words of four or more letters that don't count.
STOP_WORDS = ("para", "isto", "este", "esta", "esse", "essa", "seus", "suas", "todo", "toda", "todos", "todas", "também", "mais", "quando", "como", "isso", "eles", "elas", "nela", "nele", "dele", "dela", "quod")

#: Thresholds of the verdict.
ANCHOR_LEAST, COMBINED_LEAST = 0.18, 0.55
PARAPHRASE_COMBINED, PARAPHRASE_ANCHOR, PARAPHRASE_SIMILARITY = 0.78, 0.75, 0.50
#: Codes of the verdict, with label and confidence.
VERDICTS = {
    "CONFIRMADA_EXATA": ("Confirmada (exata)", "Alta"),
    "TRADUCAO_FIEL": ("Tradução fiel confirmada", "Alta"),
    "TRADUCAO_IMPRECISA": ("Tradução imprecisa", "Média"),
    "PARAFRASE_PLAUSIVEL": ("Paráfrase/variante localizada", "Média"),
    "ATRIBUICAO_DUVIDOSA": ("Atribuição duvidosa", "Baixa"),
    "NAO_ENCONTRADA": ("Não encontrada", "Nenhuma"),
}
#: The public outcome and safety level of a code, and the next lower outcome with its level.
PUBLIC = {
    "CONFIRMADA_EXATA": ("confirmado", "alto"),
    "TRADUCAO_FIEL": ("confirmado", "médio-alto"),
    "CORRESPONDENCIA_FORTE": ("provável", "médio"),
    "ATRIBUICAO_DUVIDOSA": ("inconclusivo", "baixo"),
    "TRADUCAO_IMPRECISA": ("inconclusivo", "baixo"),
    "PARAFRASE_PLAUSIVEL": ("inconclusivo", "baixo"),
    "NAO_ENCONTRADA": ("não sustentado", "crítico"),
}
#: What a doubt lowers an outcome and its level to.
LOWER = {"confirmado": "provável", "provável": "inconclusivo", "inconclusivo": "não sustentado", "não sustentado": "não sustentado"}
LOWER_LEVEL = {"confirmado": "médio", "provável": "baixo", "inconclusivo": "crítico", "não sustentado": "crítico"}
EXPLANATIONS = {
    "CONFIRMADA_EXATA": "The quotation occurs word for word in a work of this author.",
    "TRADUCAO_FIEL": "The quotation follows a stored translation of the passage closely.",
    "TRADUCAO_IMPRECISA": "The quotation follows a stored translation only in part.",
    "PARAFRASE_PLAUSIVEL": "A passage of this author comes close, but the wording differs.",
    "ATRIBUICAO_DUVIDOSA": "The passage was found, but not under this author.",
    "NAO_ENCONTRADA": "No passage of the collection supports the quotation.",
}


def constants(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def tokens(text: Column, least: int) -> Column:
    """Lower-case runs of letters, digits and underscores of at least so many signs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}})"), F.lit(1))


def token_set(text: Column, least: int = 4, stop=STOP_WORDS) -> Column:
    return F.array_except(F.array_distinct(tokens(text, least)), constants(stop) if stop else F.array().cast("array<string>"))


def intrusion(quote: Column, words=MODERN_WORDS, phrases=MODERN_PHRASES) -> Column:
    """SC20: share of modern words, plus a quarter for each modern phrase; at most 1."""
    long = tokens(quote, 5)
    marked = F.size(F.filter(long, lambda t: F.array_contains(constants(words), t)))
    found = F.size(F.filter(constants(phrases), lambda p: F.lower(quote).contains(p)))
    return F.least(F.lit(1.0), F.when(F.size(long) > 0, marked / F.size(long) + 0.25 * found).otherwise(0.4 * found))


def coverage(quote: Column, reference: Column) -> Column:
    """Share of a quotation's distinct words of over three signs, cut at white space, that a reference has; null if none."""
    own = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"(?U)\s+"), lambda w: F.length(w) > 3))
    return F.size(F.array_intersect(own(quote), own(reference))) / F.nullif(F.size(own(quote)), F.lit(0))


def fidelity(quote: Column, reference: Column) -> Column:
    """SC21."""
    share = F.coalesce(coverage(quote, reference), F.lit(0.0))
    return F.when(share >= 0.40, "fiel").when(share >= 0.20, "imprecisa").otherwise("nao_encontrada")


def anchor(quote: Column, source: Column, translation: Column | None = None, stop=STOP_WORDS) -> Column:
    """SC22: share of a quotation's significant words found in the source or its translation."""
    own, found = token_set(quote, 4, stop), token_set(source, 4, stop)
    if translation is not None:
        found = F.array_union(found, F.coalesce(token_set(translation, 4, stop), F.array().cast("array<string>")))
    return F.coalesce(F.size(F.array_intersect(own, found)) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0))


def plain_anchor(quote: Column, source: Column) -> Column:
    """SC23: the same over plain words of four signs, without a stop list."""
    own = lambda t: F.array_distinct(F.filter(F.split(plain_words(t), " "), lambda w: F.length(w) >= 4))
    return F.coalesce(F.size(F.array_intersect(own(quote), own(source))) / F.nullif(F.size(own(quote)), F.lit(0)), F.lit(0.0))


def exact_match(quote: Column, text: Column) -> Column:
    """SC24: the quotation, or its cleaned and folded form, lies in the text."""
    raw, clean = F.lower(F.trim(F.coalesce(quote, F.lit("")))), fold(clean_ocr(F.coalesce(quote, F.lit(""))))
    return (raw != "") & (F.coalesce(text, F.lit("")) != "") & (F.lower(text).contains(raw) | ((clean != "") & fold(text).contains(clean)))


def same_author(left: Column, right: Column) -> Column:
    """JN15: names agree, whole or without honorifics, or one of six or more signs lies in the other. Null agrees with none."""
    def close(a: Column, b: Column) -> Column:
        return (a == b) | ((F.length(a) >= 6) & b.contains(a)) | ((F.length(b) >= 6) & a.contains(b))

    a, b = author_core(left), author_core(right)
    whole = close(alias_form(left), alias_form(right))
    return F.coalesce((left != "") & (right != "") & (whole | ((a != "") & (b != "") & close(a, b))), F.lit(False))


def combine(text_score: Column, semantic_score: Column, author: Column) -> Column:
    """SC33."""
    text, semantic = F.least(text_score, F.lit(1.0)), F.least(semantic_score, F.lit(1.0))
    return F.when(text == 0, semantic * 0.9).otherwise(text * 0.65 + semantic * 0.35) + F.when(author, 0.2).otherwise(0.0)


def penalized(score: Column, attributed: Column, author: Column, exact: Column) -> Column:
    """SC34."""
    return score * F.when(attributed & ~author, F.when(exact, 0.6).otherwise(0.4)).otherwise(1.0)


def selection(score: Column, exact: Column, author: Column) -> Column:
    """SC35."""
    return score + F.when(exact, 2.0).otherwise(0.0) + F.when(author, 0.2).otherwise(0.0)


def verdict_code(combined: Column, exact: Column, author: Column, fidelity_: Column, anchor_: Column, intrusion_: Column, similarity: Column) -> Column:
    """SC36: the first rule that holds."""
    supported = (combined >= COMBINED_LEAST) & (anchor_ >= ANCHOR_LEAST)
    faithful, loose = fidelity_.eqNullSafe("fiel") & supported, fidelity_.eqNullSafe("imprecisa") & supported
    near = author & (combined >= PARAPHRASE_COMBINED) & (anchor_ >= PARAPHRASE_ANCHOR) & (similarity >= PARAPHRASE_SIMILARITY)
    return (
        F.when((intrusion_ > 0) & ~exact, "NAO_ENCONTRADA")
        .when(exact, F.when(author, "CONFIRMADA_EXATA").otherwise("ATRIBUICAO_DUVIDOSA"))
        .when(faithful, F.when(author, "TRADUCAO_FIEL").otherwise("ATRIBUICAO_DUVIDOSA"))
        .when(loose, "TRADUCAO_IMPRECISA")
        .when(near, "PARAFRASE_PLAUSIVEL")
        .otherwise("NAO_ENCONTRADA")
    )


def label(code: Column) -> Column:
    return lookup({k: v[0] for k, v in VERDICTS.items()}, code)


def confidence(code: Column) -> Column:
    return lookup({k: v[1] for k, v in VERDICTS.items()}, code)


def explanation(code: Column) -> Column:
    """SC38: a template for each code; nothing here decides."""
    return lookup(EXPLANATIONS, code)


def public_verdict(code: Column, intrusion_: Column, conflicts: Column) -> Column:
    """SC37: struct(verdict, level). A high intrusion and any conflict each lower the outcome; the level is that of what
    the lowered outcome would be lowered to."""
    outcome = F.coalesce(lookup({k: v[0] for k, v in PUBLIC.items()}, code), F.lit("não sustentado"))
    level = F.coalesce(lookup({k: v[1] for k, v in PUBLIC.items()}, code), F.lit("crítico"))
    for doubt in (intrusion_ > 0.3, conflicts > 0):
        lowered = lookup(LOWER, outcome)
        level = F.when(doubt, lookup(LOWER_LEVEL, lowered)).otherwise(level)
        outcome = F.when(doubt, lowered).otherwise(outcome)
    return F.struct(outcome.alias("verdict"), level.alias("level"))


def strategy(score: Column) -> Column:
    """SC32."""
    return F.when(score >= 0.3, "exact").when(score >= 0.1, "partial").otherwise("semantic")


def context_risk(before: Column, after: Column, markers=("não", "nunca", "falso", "not", "never", "heresy")) -> Column:
    """SC30: unknown without neighbours, high where one holds a word of negation, else low."""
    around = F.lower(F.concat_ws(" ", before, after))
    hit = F.exists(constants(markers), lambda m: around.contains(m))
    return F.when(before.isNull() & after.isNull(), "unknown").when(hit, "high").otherwise("low")


def quoted(task: Column) -> Column:
    """SC31: what stands in quotation marks, else after the first colon, else all."""
    marked = F.regexp_extract(task, r'(?s)["“”«»](.*?)["“”«»]', 1)
    after = F.regexp_extract(task, r"(?s):\s*(.+)$", 1)
    return F.trim(F.coalesce(F.nullif(marked, F.lit("")), F.nullif(after, F.lit("")), task))


def attributed(task: Column) -> Column:
    """SC31: the author that a request names; empty if none."""
    honorific = r"(?:São|Santo|Santa|Beato|Papa|Padre|San)"
    patterns = (r'(?iu)atribu[íi]d[ao]\s+a\s+([^:,\n"]+)', rf"(?iu)\bde\s+({honorific}\s+[\p{{L}}\p{{N}}_]+(?:\s+[\p{{L}}\p{{N}}_]+)?)", rf"(?iu)\bsegundo\s+({honorific}\s+[\p{{L}}\p{{N}}_]+(?:\s+[\p{{L}}\p{{N}}_]+)?)")
    return F.trim(F.coalesce(*[F.nullif(F.regexp_extract(task, p, 1), F.lit("")) for p in patterns], F.lit("")))


def excerpt(quote: Column, text: Column) -> Column:
    """SC26: the quotation's place in the text with 20 signs around it, else from the sentence that shares most words."""
    folded, wanted = fold(text), fold(clean_ocr(quote))
    ratio = F.length(text) / F.greatest(F.length(folded), F.lit(1))
    at = F.call_function("locate", wanted, folded) - 1
    begin = F.greatest(F.lit(0), F.floor(at * ratio).cast("int") - 20)
    end = F.least(F.length(text), F.floor((at + F.length(wanted)) * ratio).cast("int") + 20)
    direct = F.trim(F.substring(text, begin + 1, end - begin))
    own = F.array_distinct(F.filter(F.split(wanted, " "), lambda w: F.length(w) >= 4))
    sentences = F.split(text, r"(?<=[.!?])\s+|\n")
    shares = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(own, F.array_distinct(F.split(fold(s), " ")))).alias("n"), (-i).alias("i")))
    best = -F.array_max(shares)["i"]
    target = F.length(quote) * 1.5
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"))
    more = F.aggregate(F.slice(sentences, best + 1, 10), start, lambda a, s: F.when((a["n"] >= target) & (a["n"] > 0), a).otherwise(F.struct(F.concat_ws(" ", F.nullif(a["t"], F.lit("")), s).alias("t"), (a["n"] + F.length(s)).alias("n"))))["t"]
    found = F.when(F.length(F.trim(more)) >= 40, F.trim(more)).otherwise(F.substring(text, 1, 500))
    return F.when((wanted != "") & folded.contains(wanted), direct).when(F.size(own) == 0, F.substring(text, 1, 400)).when(F.size(sentences) <= 2, F.substring(text, 1, 500)).otherwise(found)


def page_of(text: Column, pages: Column, least: int = 5) -> Column:
    """SC27: the page (from 1) where a passage begins: whole, else by windows of words from long to short, else by shared words."""
    whole = fold(clean_ocr(text))
    words = F.filter(F.split(whole, " "), lambda w: F.length(w) >= 4)
    folded = F.transform(pages, lambda p: fold(clean_ocr(p)))
    first = lambda needle: F.array_position(F.transform(folded, lambda p: p.contains(needle)), True)
    head = F.slice(words, 1, 45)
    found = []
    for size in (24, 18, 14, 10, 8, 6, 5):
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(head) - size + 1, F.lit(1))), lambda i, n=size: first(F.array_join(F.slice(head, i, n), " ")))
        hits = F.filter(windows, lambda x: x > 0)
        found.append(F.when((F.size(head) >= size) & (F.size(hits) > 0), F.element_at(hits, 1)))
    shared = lambda n: F.transform(folded, lambda p, i: F.struct(F.size(F.array_intersect(F.array_distinct(F.slice(words, 1, n)), F.array_distinct(F.split(p, " ")))).alias("n"), (-i).alias("i")))
    near, wide = F.array_max(shared(40)), F.array_max(shared(200))
    floor = F.greatest(F.lit(least), F.floor(F.size(F.array_distinct(F.slice(words, 1, 40))) * 0.30))
    by_words = F.when(near["n"] >= floor, 1 - near["i"]).when(wide["n"] >= least, 1 - wide["i"])
    direct = first(whole)
    return F.when((F.size(words) >= 5) & (F.size(pages) > 0), F.when(direct > 0, direct).otherwise(F.coalesce(*found, by_words))).cast("int")


def viewer_range(quote: Column, text: Column) -> Column:
    """SC28: struct(begin, length) in the folded text of the quotation, or of its first window of words that occurs."""
    from .text import letters_only

    whole, body = letters_only(quote), letters_only(text)
    words = F.split(whole, " ")
    tries = [F.array(whole)]
    for size in (12, 10, 8, 6, 5):
        tries.append(F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i, n=size: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>")))
    hit = F.get(F.filter(F.concat(*tries), lambda w: (w != "") & body.contains(w)), F.lit(0))
    return F.when(hit.isNotNull(), F.struct((F.call_function("locate", hit, body) - 1).alias("begin"), F.length(hit).alias("length")))


def evidence_count(*parts: Column) -> Column:
    """AG26: how many parts are present."""
    return F.size(F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull()))


def similarity_udf():
    """SC25, as an Arrow UDF: 1 where the folded quotation lies in the folded text, else the best ratio over windows of its
    length, stepping a quarter of it and ending at the first of 0.90. Meant for the one best candidate of a claim."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def similarity(quote: pd.Series, text: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(q, t):
            if q is None or t is None:
                return None
            if q in t:
                return 1.0
            best = 0.0
            for at in range(0, max(1, len(t) - len(q) + 1), max(1, len(q) // 4)):
                best = max(best, SequenceMatcher(None, q, t[at : at + len(q)]).ratio())
                if best >= 0.90:
                    break
            return best

        return pd.Series([one(q, t) for q, t in zip(quote, text, strict=True)], dtype="float64")

    return similarity


def translation_udf():
    """SC29: struct(content, semantic, added, verdict) of original, translation and quotation, all in plain words."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("content double, semantic double, added int, verdict string")
    def judge(original: pd.Series, translation: pd.Series, quote: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        rows = []
        for o, t, q in zip(original.fillna(""), translation.fillna(""), quote.fillna(""), strict=True):
            content, semantic = SequenceMatcher(None, o[:500], t[:500]).ratio(), SequenceMatcher(None, q, t).ratio()
            added = len({w for w in q.split() if len(w) >= 7} - set(t.split()))
            doubts = (content < 0.12) + (semantic < 0.55) + (added > 2)
            verdict = "faithful" if not doubts else "adapted" if doubts == 1 and added > 2 else "paraphrase" if semantic >= 0.55 and content < 0.12 else "imprecise"
            rows.append((round(content, 3), round(semantic, 3), added, verdict))
        return pd.DataFrame(rows, columns=["content", "semantic", "added", "verdict"])

    return judge
