"""Long texts in pieces against whole texts."""

import pytest
from pyspark.sql import functions as F

from sayframe.functions.text import LINK_PATTERN, TOKEN_PATTERN, matches
from sayframe.operators.large import check_large, cut_texts, span_rows, spread
from sayframe.operators.qa import check_units
from sayframe.sources.units import text_units
from tests.test_prepare import make

TEXTS = [
    "At 12:30 pm on 1/2/2024 and 12:30\n  PM, x 3  + 4 y z NASA\tXIV. \U0001f600 é́a ≥ ** b 7 € c%",
    "no_break_at_all_" * 40 + "12/1/2020",
    "www.a.org/x_1 it's a-b c me@x.io, Dr. No ﷐  end",
    "",
    "   ",
    "a \U00010400\U00010400 12 a",
    "ABC " * 300 + "12",
    "x",
]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("size", [1, 5, 64, 1000])
def test_pieces_show_what_the_whole_shows(spark, size):
    units = make(spark, *TEXTS, spans={0: [(3, 8, "a"), (40, 46, "b")], 6: [(0, 500, "head"), (898, 903, "cross")]})
    null = text_units(spark.createDataFrame([(99, "n", None)], "o long, id string, t string"), "id", "t", "en", "prose", "o")
    units = units.unionAll(null)
    assert rows(check_large(units, size=size)) == rows(check_units(units))
    for pattern in (LINK_PATTERN, TOKEN_PATTERN, r"\p{Nd}+"):
        whole = units.select("unit_id", "ordinal", F.explode(matches("text", pattern)).alias("m")).select("unit_id", "ordinal", "m.*")
        assert rows(span_rows(units, pattern, size)) == rows(whole)
    pieces = cut_texts(units, size).orderBy("ordinal", "piece").collect()
    joined = {}
    for p in pieces:
        assert p["offset"] == len(joined.get(p["ordinal"], ""))
        joined[p["ordinal"]] = joined.get(p["ordinal"], "") + p["text"]
    assert joined == {i: t for i, t in enumerate(TEXTS) if t}
    assert check_large(units.limit(0), size=size).isEmpty()


def test_one_huge_text_uses_all_tasks(spark):
    units = make(spark, "word 12 " * 400_000, "short 7")
    dealt = spread(units).groupBy(F.spark_partition_id().alias("task")).agg(F.max(F.length("text")).alias("longest"), F.count("*").alias("pieces")).where("pieces > 5").collect()
    assert len(dealt) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["longest"] for r in dealt) < 70_000
    found = check_large(units).groupBy("unit_id").agg(F.count("*").alias("n"), F.max("source_end").alias("last"), F.countDistinct("source_start").alias("starts")).orderBy("unit_id").collect()
    assert [tuple(r) for r in found] == [("u0", 400_000, 3_199_999, 400_000), ("u1", 1, 7, 1)]
