"""Pieces of texts and sums before places, against Python, over the borders of their stretches."""

from pyspark.sql import functions as F

from sayframe.functions.text import cutting, running_sums
from sayframe.operators import edits, mapping


def test_cuts_are_those_of_the_whole_text(spark):
    text = "".join(chr(0x10400 + i % 40) if i % 7 == 0 else chr(97 + i % 26) for i in range(1100))
    spans = [(0, 0), (0, 1), (0, 256), (255, 256), (255, 257), (256, 256), (256, 512), (100, 1100), (511, 513), (1099, 1100), (1100, 1100)]
    rows = spark.createDataFrame([(text, [{"a": a, "b": b} for a, b in spans])], "t string, s array<struct<a:int,b:int>>")
    assert rows.select(cutting(F.col("t"), lambda piece: F.transform("s", lambda x: piece(x["a"], x["b"])))).first()[0] == [text[a:b] for a, b in spans]
    changes = [(a, a + 1, text[a], "<>") for a in range(0, 1100, 3)]
    made = spark.createDataFrame([(text, changes)], "t string, e array<struct<source_start:int,source_end:int,source:string,replacement:string>>")
    got = made.select(edits.rebuild(F.col("t"), F.col("e")).alias("r"), edits.problem(F.col("t"), F.col("e")).alias("p")).first()
    assert got["r"] == "".join("<>" if i % 3 == 0 else c for i, c in enumerate(text)) and got["p"] is None


def test_sums_before_places(spark):
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 129, 700):
        values = [i * 37 % 11 for i in range(n)]
        assert spark.createDataFrame([(values,)], "v array<int>").select(running_sums(F.col("v"))).first()[0] == [sum(values[:i]) for i in range(n)]


def test_native_sorting_and_sequences(spark):
    """Maps are made and checked without a comparison or an addition for each place."""
    m = mapping.source_output_map(F.col("t"), F.col("t"), F.array().cast("array<struct<source_start:int,source_end:int,output_start:int,output_end:int>>"))
    plan = spark.range(1).select(F.lit("abc").alias("t")).select(m.alias("m")).select(mapping.problem(F.col("m")).alias("p"), "m.source_left")._jdf.queryExecution().analyzed().toString()
    assert "array_sort" not in plan
    assert spark.range(1).select(F.lit("abc").alias("t")).select(m.alias("m")).select("m.source_left", mapping.problem(F.col("m")).alias("p")).first()[:] == ([0, 1, 2, 3], None)
