import re

import pytest

from sayframe.functions.identity import canonical_json, stable_id, unit_fingerprints
from sayframe.model import InvalidUnitError, OverrideScope, PreparationProfile, SpeechOverride
from sayframe.operators import edits, qa, sentences
from sayframe.plans.prepare import prepare_run, prepare_text, prepare_units
from sayframe.sources.units import text_units


def make(spark, *texts, language="en-US", spans=None):
    rows = [(i, f"u{i}", t, language, (spans or {}).get(i, [])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "o long, id string, t string, l string, p array<struct<start:int,end:int,reason:string>>")
    return text_units(df, "id", "t", "l", "prose", "o", protected_spans="p")


def spoken(frame):
    return [r["spoken_text"] for r in frame.orderBy("ordinal").select("spoken_text").collect()]


def test_rules_and_consistency(spark):
    u = make(spark, "Someone (ART) agreed. ART’s module opened.", "Later ART checked it.", "art ARTs ART-like START ART2 ARTé.", "2 kg", "  Hello\n\n", "open/close")
    result = prepare_units(u)
    assert spoken(result.units) == ["Someone (A R T) agreed. A R T’s module opened.", "Later A R T checked it.", "art ARTs ART-like START ART2 ARTé.", "two kilograms", "  Hello\n\n", "open slash close"]
    assert edits.verify(result.units).isEmpty()
    c = [r for r in result.changes.collect() if r["unit_id"] == "u3"][0]
    assert (c["source_start"], c["source_end"], c["output_start"], c["output_end"], c["rule"], c["stages"], c["language"]) == (0, 4, 0, 13, "en.quantity", ["structured"], "en")
    assert spoken(prepare_text(make(spark, "(ART)", "ART")).units) == ["(A R T)", "ART"]
    assert spoken(prepare_units(make(spark, "ART reste.", language="fr-FR")).units) == ["ART reste."]


def test_overrides(spark):
    every, unit, here = SpeechOverride("ART", "all"), SpeechOverride("ART", "unit", scope=OverrideScope("unit", "u0")), SpeechOverride("ART", "occurrence", scope=OverrideScope("occurrence", "u0", 0, 3))
    assert spoken(prepare_text(make(spark, "ART"), [every, unit, here]).units) == ["occurrence"]
    guarded = prepare_text(make(spark, "2 and ART", spans={0: [(0, 1, None), (6, 9, None)]}), [SpeechOverride("ART", "A R T")])
    assert spoken(guarded.units) == ["2 and ART"]
    assert "override.protected_overlap" in [r["code"] for r in guarded.issues.collect()]
    nested = prepare_text(make(spark, "ART"), [SpeechOverride("ART", "x", "literal"), SpeechOverride("AR", "unit", "literal", scope=OverrideScope("unit", "u0"))])
    assert spoken(nested.units) == ["unitT"]
    with pytest.raises(Exception, match="different replacements"):
        prepare_text(make(spark, "ART"), [SpeechOverride("ART", "a"), SpeechOverride("ART", "b")]).units.collect()
    with pytest.raises(Exception, match="exactly match"):
        prepare_text(make(spark, "ART"), [SpeechOverride("XYZ", "a", scope=OverrideScope("occurrence", "u0", 0, 3))]).units.collect()


def test_qa_codes(spark):
    text = "� € 12/31/2024 at 12:30 ABC IV 2+2  ﷐"
    codes = {r["code"] for r in qa.check_units(make(spark, text)).collect()}
    assert codes == {f"qa.{x}" for x in ("replacement_character", "currency_symbol", "residual_digits", "date_candidate", "time_candidate", "initialism_candidate", "roman_numeral_candidate", "operator_heavy", "private_use", "noncharacter")}
    assert "qa.residual_digits" not in {r["code"] for r in qa.check_units(make(spark, text), PreparationProfile(expand_numbers=False)).collect()}
    assert qa.check_units(make(spark, "")).isEmpty()


def test_identity(spark):
    u = text_units(spark.createDataFrame([("u1", "2 kg")], "id string, t string"), "id", "t", "en-US")
    assert unit_fingerprints(u, "pf", "of", "rf").first()["fingerprint"] == "8237afcd63fd71127ab9ba4d9ed96a58e926fee10d63137d61413e8629a65be5"
    assert canonical_json({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'
    for bad in (lambda: stable_id("a:b", {}), lambda: canonical_json(float("nan"))):
        with pytest.raises(ValueError):
            bad()


def test_chunks_and_maps(spark):
    text = "One sentence here. Another, rather longer sentence follows! " + "x" * 60 + " end"
    rows = sentences.split_prepared_text(make(spark, text, ""), 24, "text").orderBy("part").collect()
    assert "".join(r["text"] for r in rows) == text and max(len(r["text"]) for r in rows) <= 24
    m = prepare_run(make(spark, "2 kg")).first()["source_map"]
    assert (m["source_left"][0], m["source_right"][0], m["source_left"][4], m["source_right"][4]) == (0, 13, 13, 13)


def test_validation(spark):
    with pytest.raises(InvalidUnitError):
        prepare_units(make(spark, "abc", spans={0: [(0, 9, None)]}))
    with pytest.raises(ValueError):
        OverrideScope("unit")
    assert re.fullmatch(r"ovr:v1:[0-9a-f]{20}", SpeechOverride("a", "b").id)
