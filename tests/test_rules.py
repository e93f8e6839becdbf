"""Rules of four languages, numbers in words, and the options of a profile."""

import pytest
from pyspark.sql import functions as F

from sayframe.functions.numerals import number_words_sql
from sayframe.model import PreparationProfile
from sayframe.operators import normalize
from sayframe.plans.prepare import prepare_run, prepare_units
from sayframe.sources.units import text_units
from tests.test_prepare import make, spoken

NUMBERS = {
    "en": {0: "zero", 13: "thirteen", 40: "forty", 101: "one hundred one", 999_999: "nine hundred ninety-nine thousand nine hundred ninety-nine", 1_000_001: "one million one", 20_000_000: "twenty million"},
    "de": {1: "eins", 16: "sechzehn", 31: "einunddreißig", 101: "einhunderteins", 1000: "eintausend", 21_001: "einundzwanzigtausendeins", 1_000_000: "eine Million", 2_000_017: "zwei Millionen siebzehn"},
    "fr": {21: "vingt et un", 71: "soixante et onze", 80: "quatre-vingts", 91: "quatre-vingt-onze", 200: "deux cents", 201: "deux cent un", 1000: "mille", 80_000: "quatre-vingt mille", 200_200: "deux cent mille deux cents", 80_000_000: "quatre-vingts millions"},
    "es": {16: "dieciséis", 21: "veintiuno", 31: "treinta y uno", 100: "cien", 101: "ciento uno", 500: "quinientos", 1000: "mil", 21_000: "veintiún mil", 31_000: "treinta y un mil", 100_000: "cien mil", 1_000_000: "un millón", 21_000_000: "veintiún millones"},
}


@pytest.mark.parametrize("language", NUMBERS)
def test_numbers(spark, language):
    frame = spark.createDataFrame([(n,) for n in [*NUMBERS[language], -1, 10**9]], "n long")
    got = {r["n"]: r["w"] for r in frame.select("n", F.expr(number_words_sql("n", language)).alias("w")).collect()}
    assert got == {**NUMBERS[language], -1: None, 10**9: None}
    one = {"en": "one", "de": "ein", "fr": "un", "es": "un"}[language]
    assert spark.range(1, 2).select(F.expr(number_words_sql("id", language, "true"))).first()[0] == one


def test_rules_of_languages(spark):
    texts = {"en_US": "Dr. Lee: 2 kg, 1 g & 21", "de-DE": "Nr. 21, z. B. 1 kg ja/nein", "fr": "Mme a 80 km", "es": "Sra. Lee: 21 kg", "it": "Dr. 2 kg"}
    rows = spark.createDataFrame([(i, str(i), t, lang) for i, (lang, t) in enumerate(texts.items())], "o long, id string, t string, l string")
    result = prepare_units(text_units(rows, "id", "t", "l", "prose", "o"))
    assert spoken(result.units) == ["Doctor Lee: two kilograms, one gram & twenty-one", "Nummer einundzwanzig, zum Beispiel ein Kilogramm ja Schrägstrich nein", "Madame a quatre-vingts kilomètres", "Señora Lee: veintiún kilogramos", "Dr. 2 kg"]
    assert {(r["unit_id"], r["language"]) for r in result.changes.collect()} == {("0", "en"), ("1", "de"), ("2", "fr"), ("3", "es")}


def test_options(spark):
    run = lambda text, **options: spoken(prepare_run(make(spark, text), PreparationProfile(**options)))[0]
    text = "café & 5% of AB12 XML in HTML NASA 3+4"
    assert run(text) == text.replace("5%", "five%")
    everything = run(text, normalize_unicode=True, symbol_mode="all", generic_acronym_mode="spell", sequence_fallback_mode="spell")
    assert everything == "café and five percent of A B 1 2 X M L in H T M L NASA 3 plus 4"
    assert run("1 g", expand_structured=False) == "one g" and run("1 g", expand_structured=False, expand_numbers=False) == "1 g"


def test_hints(spark):
    rows = spark.createDataFrame([(0, "a", "The box is 2 in.", [(13, 16, "in.", "NOUN", None, None, None)]), (1, "b", "It is 2 in.", []), (2, "c", "2 ft", [(2, 4, "ft", "VERB", None, None, None)])], "o long, id string, t string, k array<struct<start:int,end:int,text:string,pos:string,tag:string,lemma:string,language:string>>")
    assert spoken(prepare_run(text_units(rows, "id", "t", "en", "prose", "o", linguistic_tokens="k"))) == ["The box is two inches.", "It is two in.", "two ft"]


def test_alternatives_are_longest_first():
    assert normalize._alternatives(["Dr.", "Dra."]) == r"Dra\.|Dr\."
