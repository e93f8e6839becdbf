"""Lexical review, maps as JSON, white space options and the views of a result."""

import pytest
from pyspark.sql import functions as F

from sayframe.model import PreparationProfile, SpeechOverride
from sayframe.operators import lexical, mapping
from sayframe.plans.prepare import prepare_run, prepare_text, prepare_units
from tests.test_prepare import make, spoken

WORDS = "normalized string, known boolean, frequency_rank int, frequency_count int"


def test_review_of_a_result_with_ranks(spark):
    words = spark.createDataFrame([("geomorphology", True, 48231, 3), ("rareword", True, 20000, 2)], WORDS)
    result = prepare_units(make(spark, "geomorphology. rareword rareword.", language="en"))
    found = lexical.review_lexicon(result, lexical.LexicalProvider("en", words)).collect()
    assert [r["normalized"] for r in found] == ["rareword", "geomorphology"]
    assert all("rare_word" in r["reasons"] for r in found) and found[1]["frequency_count"] == 3
    assert lexical.units_reviewed(result).first()["units_reviewed"] == 1
    assert [r["normalized"] for r in lexical.review_lexicon(result, words, min_count=2, max_items=1).collect()] == ["rareword"]


def test_review_of_links_signs_and_protected_words(spark):
    units = make(spark, "iPhone NASA café 123 user@example.com https://example.org I", "Siobhan and Siobhan", language="en", spans={1: [(0, 7, None), (12, 19, None)]})
    found = {r["normalized"]: r for r in lexical.review_lexicon(units, include_all_tokens=True).collect()}
    assert set(found) == {"iphone", "nasa", "café", "and"}
    assert ("mixed_case" in found["iphone"]["reasons"], "all_caps" in found["nasa"]["reasons"]) == (True, True)
    assert "contains_unusual_graphemes" in found["café"]["reasons"]


def test_provider_checks(spark):
    words = spark.createDataFrame([("siobhan", False, None, None)], WORDS)
    units = make(spark, "We met Siobhan. Siobhan returned.", "SIOBHAN.", language="en-GB")
    found = lexical.review_lexicon(units, lexical.LexicalProvider("en", words), unknown_only=True).collect()
    assert [(r["surface"], r["count"], [(o["unit_id"], o["sentence_index"]) for o in r["occurrences"]]) for r in found] == [("Siobhan", 3, [("u0", 0), ("u0", 1), ("u1", 0)])]
    assert lexical.review_lexicon(units, unknown_only=True).isEmpty()
    with pytest.raises(ValueError, match="another language"):
        lexical.review_lexicon(units, lexical.LexicalProvider("de", words))
    law = words.withColumn("domain", F.lit(None).cast("string")).unionByName(words.withColumns({"known": F.lit(True), "domain": F.lit("law")}))
    provider = lexical.LexicalProvider("en", law, domains=("law",))
    known = lambda **of: [r["known"] for r in lexical.review_lexicon(units, provider, include_all_tokens=True, **of).where("normalized = 'siobhan'").collect()]
    assert (known(), known(domain="law")) == ([False], [True])
    for bad in ({"domain": "art"}, {"domain": "law", "lexicon": words}):
        with pytest.raises(ValueError):
            lexical.review_lexicon(units, **{"lexicon": provider, **bad})
    with pytest.raises(ValueError):
        lexical.LexicalProvider("en", words, ("segment",))


def test_maps_as_json(spark):
    runs = prepare_run(make(spark, "2 kg", "", "plain"))
    back = runs.select("source_map", mapping.from_json(mapping.to_json(runs["source_map"])).alias("back")).collect()
    assert all(r["source_map"] == r["back"] for r in back)
    for bad in ('{"source_length":-1,"output_length":-1,"source_left":[],"source_right":[],"output_left":[],"output_right":[]}', '{"source_length":1}', '{"source_length":1,"output_length":1,"source_left":[1,0],"source_right":[1,1],"output_left":[0,1],"output_right":[0,1]}', "x"):
        with pytest.raises(Exception, match="map"):
            spark.createDataFrame([(bad,)], "j string").select(mapping.from_json(F.col("j"))).collect()


def test_white_space(spark):
    text = "\t a   b \r\n \n\n\n c 2 kg  "
    profile = {"normalize_whitespace": True, "normalize_line_whitespace": True, "collapse_horizontal_whitespace": True, "collapse_blank_lines": True, "strip_outer_whitespace": True}
    assert spoken(prepare_text(make(spark, text), profile=PreparationProfile(**profile)).units) == ["a b\n\n c two kilograms"]
    assert spoken(prepare_text(make(spark, text), profile=PreparationProfile(strip_outer_whitespace=True)).units) == ["a   b \r\n \n\n\n c two kilograms"]
    assert spoken(prepare_text(make(spark, text, " ", ""), profile=PreparationProfile()).units) == ["\t a   b \r\n \n\n\n c two kilograms  ", " ", ""]
    guarded = make(spark, "a  b  c", spans={0: [(1, 3, None)]})
    assert spoken(prepare_text(guarded, profile=PreparationProfile(collapse_horizontal_whitespace=True)).units) == ["a  b c"]


def test_views_of_a_result(spark):
    result = prepare_text(make(spark, "2 kg", "plain", "� €"), [SpeechOverride("zzz", "y")])
    assert [r["unit_id"] for r in result.changed.collect()] == ["u0"]
    codes = lambda frame: {r["code"] for r in frame.collect()}
    assert codes(result.warnings) | codes(result.errors) == codes(result.issues)
    assert "qa.replacement_character" in codes(result.errors) and "qa.currency_symbol" in codes(result.warnings)


def test_words_without_places_are_the_same_words(spark):
    texts = ["Go to www.a.org/x now. Mail me@x.io's or b.net, Dr. No! Éa it's 12 ﷐a", "x-www.c.de http://d.e. Then Again\n\nnew line", "", "  ", "Head words. tail Words", "plain one. Plain two"]
    units = make(spark, *texts, spans={4: [(0, 7, "head")], 5: [(3, 7, "cross")]})
    whole = lexical._words(units).select("ordinal", "language", "surface", "_starts")
    own = lexical._surfaces(units)
    assert own.columns == whole.columns
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, whole.collect())) != []
    assert lexical._surfaces(units.limit(0)).isEmpty()


def test_of_two_abbreviations_in_a_row_the_second_ends_its_sentence(spark):
    """As in the SQL of the reviews: "No. No. Ñllí" starts a sentence, "No. Ñllí" does not."""
    texts = ["a la ñasez. No. No. Ñllí ñja", "a la ñasez. No. Ñllí ñja", "No. No. No. Ñllí", "Prof.' Dr.) Lee", "etc. x No. Ñllí", "a\ufdd0b\ufdd2c. D"]
    units = make(spark, *texts)
    words = lexical._words(units).select("ordinal", "language", "surface", "_starts")
    assert sorted(map(tuple, lexical._surfaces(units).collect())) == sorted(map(tuple, words.collect()))
    assert [[r["surface"] for r in words.where("_starts").collect() if r["ordinal"] == i] for i in range(6)] == [["a", "No", "Ñllí"], ["a", "No"], ["No", "No"], ["Prof", "Lee"], ["etc"], ["a", "D"]]
    found = lambda i: {r["normalized"]: r["reasons"] for r in lexical.review_lexicon(units.where(f"ordinal = {i}"), occurrences=False).collect()}
    assert "ñllí" not in found(0) and found(1)["ñllí"] == ["proper_name_candidate"]
