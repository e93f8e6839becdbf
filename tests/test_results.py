"""Stores of results, progress, and maps put together."""

import pytest
from pyspark.sql import functions as F

from sayframe.model import SpeechOverride
from sayframe.operators import mapping, serialize
from sayframe.plans.prepare import prepare_run, prepare_text, prepare_units
from tests.test_prepare import make, spoken


def test_store(spark, tmp_path):
    result = prepare_text(make(spark, "2 kg and (ART)", "", "plain €"), [SpeechOverride("and", "&")])
    serialize.write_result(result, f"{tmp_path}/r")
    back = serialize.read_result(spark, f"{tmp_path}/r")
    assert spoken(back["units"]) == spoken(result.units) and back["stats"].collect() == result.stats.collect()
    assert (back["override_fingerprint"], back["prepared_fingerprint"]) == (result.override_fingerprint, result.prepared_fingerprint())
    key = lambda frame: sorted((r["unit_id"], r["id"], r["output_start"], r["provenance"]) for r in frame.collect())
    assert key(back["changes"]) == key(result.changes) and len(key(back["changes"])) == 3
    assert sorted(r["code"] for r in back["issues"].collect()) == sorted(r["code"] for r in result.issues.collect())
    old = spark.createDataFrame([(0, '{"unit_id":"a","source_text":"x","spoken_text":"y","role":"prose","changes":[{"id":"c","unit_id":"a","source_start":0,"source_end":1,"source":"x","replacement":"y"}]}')], "ordinal long, json string")
    old.write.mode("overwrite").parquet(f"{tmp_path}/r/units")
    row = serialize.read_result(spark, f"{tmp_path}/r")["units"].first()
    assert (row["language"], row["issues"], row["changes"][0]["stages"], row["changes"][0]["kind"], row["changes"][0]["provenance"]) == (None, [], [], "normalization", "{}")
    spark.createDataFrame([("other.v1", "", "", "", "")], serialize.MANIFEST).write.mode("overwrite").parquet(f"{tmp_path}/r/manifest")
    with pytest.raises(ValueError, match="other.v1"):
        serialize.read_result(spark, f"{tmp_path}/r")
    assert serialize.preparation_result_to_dict is serialize.result_to_dict


def test_progress(spark):
    units, seen = make(spark, "2 kg", "plain"), []
    result = prepare_units(units, on_progress=seen.append)
    assert [(e.kind, e.completed, e.total, e.unit_id, e.language, e.role) for e in seen] == [(k, n, 2, u, "en-US", "prose") for u, n in (("u0", 0), ("u1", 1)) for k, n in (("unit.started", n), ("unit.completed", n + 1))]
    assert spoken(result.units) == ["two kilograms", "plain"]
    result.release()

    def fail(event):
        raise RuntimeError(event.unit_id)

    with pytest.raises(RuntimeError, match="u0"):
        prepare_units(units, on_progress=fail)


def test_maps_put_together(spark):
    runs = prepare_run(make(spark, "", "2 kg", "a", "", "3 kg b", "")).withColumn("g", F.lit(1))
    whole = mapping.concatenate(runs, "g", "ordinal")
    m = whole.first()["source_map"]
    assert whole.select(mapping.problem(F.col("source_map"))).first()[0] is None
    assert (m["source_length"], m["output_length"]) == (11, len("two kilogramsathree kilograms b"))
    assert (m["source_left"][4], m["source_right"][4], m["source_left"][5], m["source_right"][5]) == (13, 13, 14, 14)
    none = mapping.concatenate(runs.where("text = ''"), "g", "ordinal").first()["source_map"]
    assert (none["source_length"], none["source_left"], none["output_right"]) == (0, [0], [0])


def test_many_maps_in_proportion(spark):
    maps = spark.range(100_000).select((F.col("id") % 1).alias("g"), F.col("id").alias("o"), mapping.identity(F.lit(3)).alias("source_map"))
    m = mapping.concatenate(maps, "g", "o").select(F.col("source_map.source_length").alias("n"), F.element_at("source_map.output_right", -1).alias("last"), F.size("source_map.source_left").alias("size")).first()
    assert tuple(m) == (300_000, 300_000, 300_001)
