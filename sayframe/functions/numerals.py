"""Whole numbers in words, in the languages of LANGUAGES, from 0 to 999,999,999.

Each language has small grammars for numbers below a thousand, in the forms that stand at the end, before the word for
thousand and before a noun; tables of these are made by rule, and a number's words are put together from its three groups of
digits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from .text import sql_string

# The words of numbers.
_EN = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", "twenty thirty forty fifty sixty seventy eighty ninety")
_DE = ("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn", "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig")
_FR = ("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf", "vingt trente quarante cinquante soixante")
_ES = (
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve",
    "treinta cuarenta cincuenta sesenta setenta ochenta noventa", "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos",
)

END, THOUSANDS, NOUN = "end", "thousands", "noun"


def _english(n: int, form: str) -> str:
    ones, tens = (x.split() for x in _EN)
    if n >= 100:
        return f"{ones[n // 100]} hundred" + (f" {_english(n % 100, form)}" if n % 100 else "")
    return ones[n] if n < 20 else tens[n // 10 - 2] + (f"-{ones[n % 10]}" if n % 10 else "")


def _german(n: int, form: str) -> str:
    ones, tens = (x.split() for x in _DE)
    first = lambda k: "ein" if k == 1 else ones[k]
    if n >= 100:
        return f"{first(n // 100)}hundert" + (_german(n % 100, form) if n % 100 else "")
    if n < 20:
        return ones[n] if form == END else first(n)
    return (f"{first(n % 10)}und" if n % 10 else "") + tens[n // 10 - 2]


def _french(n: int, form: str) -> str:
    ones, tens = (x.split() for x in _FR)
    if n >= 100:
        head = "cent" if n < 200 else f"{ones[n // 100]} cent"
        return f"{head} {_french(n % 100, form)}" if n % 100 else head + "s" * (n >= 200 and form != THOUSANDS)
    if n < 20:
        return ones[n]
    if n < 70:
        return tens[n // 10 - 2] + ("" if n % 10 == 0 else " et un" if n % 10 == 1 else f"-{ones[n % 10]}")
    if n < 80:
        return "soixante" + (" et onze" if n == 71 else f"-{ones[n - 60]}")
    return ("quatre-vingt" + "s" * (form != THOUSANDS)) if n == 80 else f"quatre-vingt-{ones[n - 80]}"


def _spanish(n: int, form: str) -> str:
    ones, tens, hundreds = (x.split() for x in _ES)
    if n == 100:
        return "cien"
    if n > 100:
        return hundreds[n // 100 - 1] + (f" {_spanish(n % 100, form)}" if n % 100 else "")
    if n % 10 == 1 and n != 11 and form != END:
        return {1: "un", 21: "veintiún"}.get(n, f"{tens[n // 10 - 3]} y un")
    return ones[n] if n < 30 else tens[n // 10 - 3] + (f" y {ones[n % 10]}" if n % 10 else "")


@dataclass(frozen=True)
class Numerals:
    """below: words of a number below a thousand in a form. one_thousand, thousand: how 1,000 begins and what follows the other
    thousands. million: the words of one million, and what follows more of them. glue: between thousands and the rest."""

    below: object
    one_thousand: str
    thousand: str
    million: tuple[str, str]
    glue: str = " "


LANGUAGES = {
    "en": Numerals(_english, "one thousand", " thousand", ("one million", " million")), "de": Numerals(_german, "eintausend", "tausend", ("eine Million", " Millionen"), ""),
    "fr": Numerals(_french, "mille", " mille", ("un million", " millions")), "es": Numerals(_spanish, "mil", " mil", ("un millón", " millones")),
}


@lru_cache
def _table(language: str, form: str) -> str:
    return "|".join(LANGUAGES[language].below(n, form) for n in range(1000))


def number_words_sql(number: str, language: str, noun: str = "false") -> str:
    """The expression of a number's words, in the form before a noun where `noun` holds. Null below 0 and beyond
    999,999,999."""
    g = LANGUAGES[language]
    of = lambda k, f: f"get(split({sql_string(_table(language, f))}, '[|]'), CAST({k} AS INT))"
    millions, thousands, rest = f"{number} div 1000000", f"{number} div 1000 % 1000", f"{number} % 1000"
    high = f"CASE WHEN {millions} = 1 THEN {sql_string(g.million[0])} WHEN {millions} > 1 THEN concat({of(millions, NOUN)}, {sql_string(g.million[1])}) END"
    middle = f"CASE WHEN {thousands} = 1 THEN {sql_string(g.one_thousand)} WHEN {thousands} > 1 THEN concat({of(thousands, THOUSANDS)}, {sql_string(g.thousand)}) END"
    low = f"CASE WHEN {rest} > 0 OR {number} = 0 THEN CASE WHEN {noun} THEN {of(rest, NOUN)} ELSE {of(rest, END)} END END"
    return f"CASE WHEN {number} BETWEEN 0 AND 999999999 THEN concat_ws(' ', {high}, nullif(concat_ws({sql_string(g.glue)}, {middle}, {low}), '')) END"
