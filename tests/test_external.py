"""Edits of another normaliser: good ones, and each way to be wrong."""

import json

import pytest

from sayframe.model import MappingError, SpeechOverride
from sayframe.operators import external
from sayframe.plans.prepare import prepare_run, prepare_text, prepare_units
from tests.test_prepare import make, spoken

EDIT = "unit_id string, source_start int, source_end int, source string, replacement string"


def proposal(spark, *rows, more="", names=EDIT):
    return spark.createDataFrame(list(rows), names + more)


def test_good_edits(spark):
    units = make(spark, "2 kg and ART", "plain", "(ÉÀ) ÉÀ", language="fr-FR")
    good = proposal(spark, ("u0", 0, 4, "2 kg", "deux kilos", 0, 10, ["numbers"], None, 0.5, ["a", "b"]), ("u2", 1, 3, "ÉÀ", "É À", None, None, None, "sequence.parenthesized-initialism", None, None), more=", output_start int, output_end int, stages array<string>, rule string, evidence_score double, evidence_cues array<string>")
    said = spark.createDataFrame([("u0", "deux kilos and ART", ["odd", "odder"]), ("u2", "(É À) ÉÀ", None)], "unit_id string, spoken_text string, warnings array<string>")
    result = prepare_units(units, [SpeechOverride("ART", "A R T")], edits=good, outputs=said)
    assert spoken(result.units) == ["deux kilos and A R T", "plain", "(É À) É À"]
    change = {(r["unit_id"], r["source_start"]): r for r in result.changes.collect()}
    first = change["u0", 0]
    assert json.loads(first["provenance"]) == {"origin": "sayframe.external", "language": "fr-FR", "evidence_score": 0.5, "evidence_cues": ["a", "b"]}
    assert (first["kind"], first["language"], first["stages"], change["u2", 1]["stages"]) == ("normalization", None, ["numbers"], [])
    assert [r["message"] for r in result.issues.where("code = 'sayframe.external.warning'").orderBy("ordinal", "pass", "pos").collect()] == ["odd", "odder"]
    assert spoken(prepare_run(units, edits=good.limit(0))) == ["2 kg and ART", "plain", "(ÉÀ) ÉÀ"]


WRONG = {
    "field is null": [("u0", 0, 1, None, "x")], "outside": [("u0", 5, 99, "x", "y")], "lies outside": [("u0", 2, 2, "", "y")], "overlap": [("u0", 0, 3, "one", "x"), ("u0", 2, 5, "e t", "y")],
    "source is not": [("u0", 0, 3, "two", "x")], "protected": [("u0", 4, 7, "two", "x")], "unit is unknown": [("gone", 0, 3, "one", "x")],
}


@pytest.mark.parametrize("said", WRONG)
def test_wrong_edits(spark, said):
    units = make(spark, "one two three", spans={0: [(5, 6, None)]})
    with pytest.raises(MappingError, match=said):
        prepare_text(units, edits=proposal(spark, *WRONG[said]))


def test_wrong_outputs(spark):
    units, edit = make(spark, "one two", "x"), proposal(spark, ("u0", 0, 3, "one", "1"))
    problems = lambda edits, *outputs, kind="unit_id string, spoken_text string": {(r["unit_id"], r["problem"]) for r in external.edit_problems(units, edits, spark.createDataFrame(list(outputs), kind)).collect()}
    assert problems(edit, ("u0", "1 two"), ("u1", "x")) == set()
    assert problems(edit, ("u0", "2 two")) == {("u0", "the output does not have a replacement at its place")}
    assert problems(edit, ("u0", "1 two!"), ("u1", "y")) == {("u0", "the edits do not rebuild the output"), ("u1", "the edits do not rebuild the output")}
    assert problems(edit, ("u0", None), ("u9", "x")) == {("u0", "the output is null"), ("u9", "the output's unit is unknown")}
    assert problems(edit, ("u0", "1 two"), ("u0", "1 two")) == {("u0", "a unit has several outputs")}
    moved = proposal(spark, ("u0", 0, 3, "one", "1", 1, 2), more=", output_start int, output_end int")
    assert problems(moved, ("u0", "1 two")) == {("u0", "an edit's output place is not where the edits before put it")}
    kind = "unit_id string, spoken_text string, source_map struct<source_length:int,output_length:int,source_left:array<int>,source_right:array<int>,output_left:array<int>,output_right:array<int>>"
    assert problems(edit, ("u0", "1 two", (6, 5, [], [], [], [])), kind=kind) == {("u0", "the map's lengths are not those of the texts")}
    assert problems(edit, ("u0", "1 two", (7, 5, [], [], [], [])), kind=kind) == {("u0", "the map's arrays do not fit")}
    with pytest.raises(MappingError, match="override"):
        prepare_text(units, [SpeechOverride("one", "eins")], edits=edit)
    with pytest.raises(ValueError, match="lack"):
        external.edit_problems(units, edit.drop("source"))
