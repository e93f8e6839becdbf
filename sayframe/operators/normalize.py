"""Rules that turn written forms into spoken ones, as exact edits, in the languages of RULES."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import change_id_column, json_column
from ..functions.numerals import LANGUAGES, number_words_sql
from ..functions.text import AFTER, BEFORE, FEW, PIECES, cut, exploded, let, once, running, spans, spans_sql, sql_string
from ..functions.unicode import language_key, nfc_edits
from ..model import ORIGIN, PreparationProfile

INITIALISM_RULE = "sequence.parenthesized-initialism"
INITIALISM_PATTERN = r"(?<=\()[A-Z]{2,8}(?=\))"


@dataclass(frozen=True)
class LanguageRules:
    """Words of one language: measures with singular and plural, abbreviations, signs, and the names of capitals that are spelled
    as words of their own. Longer abbreviations come before shorter ones that begin alike."""

    measures: dict[str, tuple[str, str]]
    abbreviations: dict[str, str]
    slash: str
    symbols: dict[str, str]
    inches: tuple[str, str] | None = None


# Fixed values.
RULES = {
    "en": LanguageRules(
        {"kg": ("kilogram", "kilograms"), "g": ("gram", "grams"), "km": ("kilometer", "kilometers"), "cm": ("centimeter", "centimeters"), "mm": ("millimeter", "millimeters"), "ml": ("milliliter", "milliliters"), "lb": ("pound", "pounds"), "ft": ("foot", "feet")},
        {"Dr.": "Doctor", "Mr.": "Mister", "Mrs.": "Missus", "Prof.": "Professor", "vs.": "versus", "etc.": "et cetera"}, "slash", {"&": "and", "%": "percent", "+": "plus", "=": "equals", "€": "euros", "$": "dollars", "£": "pounds", "°": "degrees"}, ("inch", "inches"),
    ),
    "de": LanguageRules(
        {"kg": ("Kilogramm", "Kilogramm"), "g": ("Gramm", "Gramm"), "km": ("Kilometer", "Kilometer"), "cm": ("Zentimeter", "Zentimeter"), "mm": ("Millimeter", "Millimeter"), "ml": ("Milliliter", "Milliliter")},
        {"Dr.": "Doktor", "Prof.": "Professor", "Hr.": "Herr", "Nr.": "Nummer", "bzw.": "beziehungsweise", "usw.": "und so weiter", "z. B.": "zum Beispiel", "z.B.": "zum Beispiel"}, "Schrägstrich", {"&": "und", "%": "Prozent", "+": "plus", "=": "gleich", "€": "Euro", "$": "Dollar", "£": "Pfund", "°": "Grad"},
    ),
    "fr": LanguageRules(
        {"kg": ("kilogramme", "kilogrammes"), "g": ("gramme", "grammes"), "km": ("kilomètre", "kilomètres"), "cm": ("centimètre", "centimètres"), "mm": ("millimètre", "millimètres"), "ml": ("millilitre", "millilitres")},
        {"Dr": "Docteur", "Mme": "Madame", "Mlle": "Mademoiselle", "n°": "numéro", "etc.": "et cetera"}, "barre oblique", {"&": "et", "%": "pour cent", "+": "plus", "=": "égale", "€": "euros", "$": "dollars", "£": "livres", "°": "degrés"},
    ),
    "es": LanguageRules(
        {"kg": ("kilogramo", "kilogramos"), "g": ("gramo", "gramos"), "km": ("kilómetro", "kilómetros"), "cm": ("centímetro", "centímetros"), "mm": ("milímetro", "milímetros"), "ml": ("mililitro", "mililitros")},
        {"Sra.": "Señora", "Sr.": "Señor", "Dra.": "Doctora", "Dr.": "Doctor", "Ud.": "usted", "etc.": "etcétera"}, "barra", {"&": "y", "%": "por ciento", "+": "más", "=": "igual a", "€": "euros", "$": "dólares", "£": "libras", "°": "grados"},
    ),
}

_EDITS = "array<struct<start:int,size:int,rank:int,end:int,replacement:string,stage:string,kind:string,rule:string,domain:string,number:bigint,noun:boolean>>"


#: Parts of speech that are no measure.
_NO_MEASURE = "NOT IN ('NOUN', 'PROPN', 'X', 'SYM')"


def _edit(rank: int, s: Column, replacement: Column, stage: str, rule: str, domain: str | None) -> Column:
    return F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("size"), F.lit(rank).alias("rank"), s["end"].alias("end"), replacement.alias("replacement"), F.lit(stage).alias("stage"), F.lit("structured" if stage == "structured" else "normalization").alias("kind"), F.lit(rule).alias("rule"), F.lit(domain).cast("string").alias("domain"), F.lit(None).cast("bigint").alias("number"), F.lit(False).alias("noun"))


#: The options of a profile that change white space.
WHITESPACE = ("normalize_whitespace", "strip_outer_whitespace", "collapse_horizontal_whitespace", "normalize_line_whitespace", "collapse_blank_lines")


def spoken_space(run: Column, outer: Column, profile: PreparationProfile) -> Column:
    """What a run of white space becomes; `outer` says that it starts or ends its text.

    normalize_whitespace: line ends as line feeds, other white space as blanks. normalize_line_whitespace: none at the
    ends of lines. collapse_horizontal_whitespace: one blank for several. collapse_blank_lines: one empty line for
    several. strip_outer_whitespace: none at the ends of the text.
    """
    if profile.normalize_whitespace:
        run = F.regexp_replace(F.regexp_replace(run, r"\r\n?|[\x{85}\x{2028}\x{2029}]", "\n"), r"[^\n]", " ")
    if profile.normalize_line_whitespace:
        run = F.regexp_replace(run, r"[^\r\n]+(?=[\r\n])|(?<=\n)[^\r\n]+(?=[\r\n])", "")
    if profile.collapse_horizontal_whitespace:
        run = F.regexp_replace(run, r"[^\r\n]{2,}", " ")
    if profile.collapse_blank_lines:
        run = F.regexp_replace(run, r"(\r?\n)(?:[^\r\n]*\r?\n){2,}", "$1$1")
    return F.when(outer, "").otherwise(run) if profile.strip_outer_whitespace else run


def _alternatives(words) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _lookup(table: dict[str, str], key: str) -> str:
    """SQL: the table's value, or null."""
    return f"try_element_at(map({', '.join(sql_string(x) for pair in table.items() for x in pair)}), {key})"


def common_edits(profile: PreparationProfile) -> list[Column]:
    """Edits that do not depend on the language: white space, and canonical composition (NFC)."""
    text, out = F.col("text"), []
    if any(getattr(profile, o) for o in WHITESPACE):
        run = lambda s: cut(text, s["start"], s["end"])
        spaced = lambda s: spoken_space(run(s), (s["start"] == 0) | (s["end"] == F.length(text)), profile)
        out.append(F.transform(spans("text", r"[\s\p{Z}]+"), lambda s: _edit(5, s, F.nullif(spaced(s), run(s)), "whitespace", "text.whitespace", None)))
    if profile.normalize_unicode:
        out.append(F.transform(nfc_edits(text), lambda e: _edit(6, e, e["replacement"], "unicode", "text.nfc", None)))
    return out


def language_edits(profile: PreparationProfile) -> str:
    """The expression of the edits by the rules of a unit's language, over the columns text, linguistic_tokens and _base
    (the language). All languages share the search; what a language lacks is no edit.

    quantity: a whole number and a measure; `in` counts as inches only where a token hint calls it a noun, and a hint of
    another part of speech keeps a measure from being one. initialism: two to eight capitals in brackets are spelled;
    with generic_acronym_mode "spell" others that have no vowel or are of two letters, too. sequence: with
    sequence_fallback_mode "spell" runs of letters and digits are spelled. slash: words with a slash. symbol: with a
    symbol_mode other than "none" the signs of the language, as words. abbreviation, number.
    """
    out, surface = [], "substring(text, s.start + 1, s.end - s.start)"
    spelled = f"array_join(split({surface}, ''), ' ')"
    known = f"_base IN ({', '.join(map(sql_string, RULES))})"
    own = lambda key: f"concat(_base, ':', {key})"
    table = lambda of: {f"{lang}:{k}": v for lang, r in RULES.items() for k, v in of(r).items()}

    def add(pattern: str, rank: int, stage: str, rule: str, domain: str, replacement: str, number: str = "CAST(NULL AS BIGINT)", noun: bool = False, keep: str = "true") -> None:
        kind = "structured" if stage == "structured" else "normalization"
        name = f"'{rule}'" if "." in rule else f"concat(_base, '.{rule}')"
        edit = f"struct(s.start AS start, s.start - s.end AS size, {rank} AS rank, s.end AS end, {replacement} AS replacement, '{stage}' AS stage, '{kind}' AS kind, {name} AS rule, '{domain}' AS domain, {number} AS number, {str(noun).lower()} AS noun)"
        found = spans_sql("text", pattern) if keep == "true" else f"filter({spans_sql('text', pattern)}, s -> {keep})"
        out.append(f"transform({found}, s -> {edit})")

    if profile.expand_structured:
        n, unit = f"CAST(regexp_extract({surface}, '^([0-9]+)', 1) AS BIGINT)", f"regexp_extract({surface}, '([a-z]+)$', 1)"
        hint = lambda back, test: f"coalesce(exists(linguistic_tokens, t -> t.start = s.end - {back} AND t.pos {test}), false)"
        names = table(lambda r: {k: v[1] for k, v in r.measures.items()} | {f"{k}:1": v[0] for k, v in r.measures.items()})
        name = _lookup(names, own(f"{unit} || CASE WHEN {n} = 1 THEN ':1' ELSE '' END"))
        add(rf"(?=[0-9]){BEFORE}[0-9]{{1,9}} ?(?:{_alternatives({k for r in RULES.values() for k in r.measures})}){AFTER}", 0, "structured", "quantity", "quantities", f"' ' || {name}", n, True, f"NOT {hint(f'length({unit})', _NO_MEASURE)}")
        inch = _lookup({f"{lang}:{k}": f" {r.inches[k]}" for lang, r in RULES.items() if r.inches for k in (0, 1)}, own(f"CASE WHEN {n} = 1 THEN '0' ELSE '1' END"))
        add(rf"(?=[0-9]){BEFORE}[0-9]{{1,9}} in[.]", 0, "structured", "quantity", "quantities", f"{inch} || CASE WHEN s.end = length(text) THEN '.' ELSE '' END", n, True, hint(3, "= 'NOUN'"))
        add(INITIALISM_PATTERN, 1, "structured", INITIALISM_RULE, "sequences", f"CASE WHEN {known} THEN {spelled} END")
        slash = _lookup({lang: f" {r.slash} " for lang, r in RULES.items()}, "_base")
        add(rf"(?=\p{{L}}){BEFORE}\p{{L}}+/\p{{L}}+(?![\p{{L}}\p{{N}}_/])", 2, "structured", "slash", "symbols", f"replace({surface}, '/', {slash})")
        if profile.generic_acronym_mode == "spell":
            add(rf"(?=[A-Z]){BEFORE}(?:[A-Z]{{2}}|[B-DF-HJ-NP-TV-XZ]{{3,8}}){AFTER}", 7, "structured", "sequence.acronym", "sequences", f"CASE WHEN {known} THEN {spelled} END")
        if profile.sequence_fallback_mode == "spell":
            add(rf"{BEFORE}(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{{2,24}}{AFTER}", 8, "structured", "sequence.fallback", "sequences", f"CASE WHEN {known} THEN {spelled} END")
        if profile.symbol_mode != "none":
            before, after = r"CASE WHEN s.start > 0 AND NOT substring(text, s.start, 1) RLIKE '[\\s\\p{Z}]' THEN ' ' ELSE '' END", r"CASE WHEN s.end < length(text) AND NOT substring(text, s.end + 1, 1) RLIKE '[\\s\\p{Z}\\p{P}]' THEN ' ' ELSE '' END"
            signs = re.escape("".join(sorted({k for r in RULES.values() for k in r.symbols})))
            add(rf"(?<!\p{{S}})[{signs}](?!\p{{S}})", 9, "structured", "symbol", "symbols", f"{before} || {_lookup(table(lambda r: r.symbols), own(surface))} || {after}")
    if profile.expand_abbreviations:
        firsts = "".join(sorted({k[0] for r in RULES.values() for k in r.abbreviations}))
        add(f"(?=[{firsts}]){BEFORE}(?:{_alternatives({k for r in RULES.values() for k in r.abbreviations})}){AFTER}", 3, "abbreviations", "abbreviation", "abbreviations", _lookup(table(lambda r: r.abbreviations), own(surface)))
    if profile.expand_numbers:
        add(r"(?=[0-9])(?<![\p{L}\p{N}_/:.,+*=<>^-])[0-9]{1,9}(?![\p{L}\p{N}_/:+*=<>^-]|[.,][0-9])", 4, "numbers", "number", "numbers", f"CASE WHEN {known} THEN '' END", f"CAST({surface} AS BIGINT)")
    return f"concat({', '.join([f'CAST(array() AS {_EDITS})', *(f'coalesce({x}, CAST(array() AS {_EDITS}))' for x in out)])})"


def proposed_edits(profile: PreparationProfile) -> Column:
    """All edits that the rules propose for a unit, without regard to each other, in order of place."""
    none = F.array().cast(_EDITS)
    every = F.concat(F.expr(language_edits(profile)), *[F.coalesce(x.cast(_EDITS), none) for x in common_edits(profile)])
    return F.sort_array(F.filter(every, lambda e: e["replacement"].isNotNull()))


def _spoken(edits: str) -> str:
    """The expression of chosen edits with the words of their numbers before their replacements."""
    words = "CASE _base " + " ".join(f"WHEN '{lang}' THEN {number_words_sql('e.number', lang, 'e.noun')}" for lang in LANGUAGES) + " END"
    fields = ", ".join(f"e.{f} AS {f}" for f in ("start", "end", "stage", "kind", "rule", "domain"))
    source = "CASE WHEN size(ps) = 1 THEN substring(ps[0], e.start + 1, e.end - e.start) ELSE substring(array_join(slice(ps, shiftright(e.start, 8) + 1, shiftright(e.end - 1, 8) - shiftright(e.start, 8) + 1), ''), e.start - (shiftright(e.start, 8) * 256) + 1, e.end - e.start) END"
    made = f"transform({edits}, e -> struct({fields}, CASE WHEN e.number IS NULL THEN e.replacement ELSE concat({words}, e.replacement) END AS replacement, {source} AS source))"
    return f"transform(array({PIECES}), ps -> {made})[0]"


def edited(units: DataFrame, profile: PreparationProfile | None = None, blocked: str = "protected_spans", name: str = "_own") -> DataFrame:
    """The units, each with its changes by the rules as an array in order of place, made where the unit is read. None of
    them touches a blocked span or another change.

    Of proposals that overlap, the first counts; at one place the longest, then the first rule. Units in a language
    without rules have only changes of white space and composition.
    """
    profile = profile or PreparationProfile()
    base = F.split(language_key(F.col("language")), "-")[0]
    found = units.withColumn("_base", base).withColumn("_edits", proposed_edits(profile))
    free = F.filter("_edits", lambda e: ~F.coalesce(F.exists(F.col(blocked), lambda p: (p["start"] < e["end"]) & (e["start"] < p["end"])), F.lit(False)))
    # Proposals are in order of place, so a chosen one begins behind the end of the last that was chosen before.
    few = lambda es: F.aggregate(es, F.array().cast(_EDITS), lambda done, e: F.when(e["start"] >= F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)), F.array_append(done, e)).otherwise(done))
    many = lambda es: let(running(es, 0, lambda end, e: F.when(e["start"] >= end, e["end"]).otherwise(end)), lambda ends: F.filter(es, lambda e, i: e["start"] >= F.get(ends, i)))
    chosen = let(free, lambda es: F.when(F.size(es) <= FEW, few(es)).otherwise(many(es)))

    def made(es: Column) -> Column:
        one = lambda said: lambda e: F.struct(
            e["start"].alias("source_start"), e["end"].alias("source_end"), change_id_column(F.col("unit_id"), e["start"], e["end"], e["source"]).alias("id"), e["source"].alias("source"), e["replacement"].alias("replacement"),
            F.array(e["stage"]).alias("stages"), e["kind"].alias("kind"), e["rule"].alias("rule"), e["domain"].alias("recognition_domain"), said.alias("provenance"), F.when(~e["rule"].startswith("text."), F.col("_base")).alias("language"),
        )
        return let(json_column(origin=F.lit(f"{ORIGIN}.rules"), language=F.col("language")), lambda said: F.transform(es, one(said)))

    return once(found.withColumn("_chosen", chosen), name, made(F.expr(_spoken("_chosen")))).drop("_base", "_edits", "_chosen")


def normalize(units: DataFrame, profile: PreparationProfile | None = None, blocked: str = "protected_spans") -> DataFrame:
    """The changes of `edited` as rows."""
    return edited(units, profile, blocked).select("unit_id", exploded("_own")).select("unit_id", "x.*")
