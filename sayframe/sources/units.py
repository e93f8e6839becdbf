"""Text units: rows with an order, an id, a text, its language and role, and protected spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import SPAN, TOKEN, InvalidUnitError



def text_units(df: DataFrame, unit_id: str, text: str, language: str | Column = "en-US", role: str | Column = "prose", order: str | None = None, protected_spans: str | None = None, metadata: str | None = None, linguistic_tokens: str | None = None) -> DataFrame:
    """Units of a table. `order` gives the ordinal (a long that need not be dense, unique in the result); without it the
    rows are numbered in the order of their ids' sort, by ranges, without gathering them in one task."""
    column = lambda c: F.col(c) if isinstance(c, str) and c in df.columns else F.lit(c) if isinstance(c, str) else c
    spans = F.col(protected_spans).cast(f"array<{SPAN}>") if protected_spans else F.array().cast(f"array<{SPAN}>")
    tokens = F.col(linguistic_tokens).cast(f"array<{TOKEN}>") if linguistic_tokens else F.array().cast(f"array<{TOKEN}>")
    ordinal = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    rows = df if order else df.sort(unit_id)
    return rows.select(
        ordinal.alias("ordinal"), F.col(unit_id).cast("string").alias("unit_id"), F.col(text).alias("text"), column(language).alias("language"),
        F.coalesce(column(role), F.lit("prose")).alias("role"), spans.alias("protected_spans"), (F.col(metadata) if metadata else F.lit("{}")).alias("metadata"), tokens.alias("linguistic_tokens"),
    )


def validate_units(units: DataFrame) -> DataFrame:
    """(unit_id, problem) for each broken rule: empty ids and roles, blank languages, null texts, spans and tokens out
    of bounds or order, tokens whose text is not that of their span, and ids that occur twice."""
    size = F.length("text")

    def disorder(c: str) -> Column:
        s = F.coalesce(F.col(c), F.array().cast(units.schema[c].dataType))
        bounds = F.exists(s, lambda x: x["start"].isNull() | x["end"].isNull() | (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > size))
        ordered = F.sort_array(F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        pairs = F.when(F.size(s) > 1, F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(ordered, i - 1)["end"] > F.get(ordered, i)["start"])).otherwise(False)
        return bounds | pairs

    checks = [
        ("id is empty", F.coalesce(F.col("unit_id"), F.lit("")) == ""),
        ("role is empty", F.coalesce(F.col("role"), F.lit("")) == ""),
        ("language is blank", F.trim(F.coalesce(F.col("language"), F.lit(""))) == ""),
        ("text is null", F.col("text").isNull()),
        ("protected spans are out of bounds or overlap", disorder("protected_spans")),
        ("linguistic tokens are out of bounds or overlap", disorder("linguistic_tokens")),
        ("a linguistic token's text is not that of its span", F.exists(F.coalesce(F.col("linguistic_tokens"), F.array().cast(f"array<{TOKEN}>")), lambda t: t["text"].isNotNull() & (t["text"] != F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"])))),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(said)) for said, bad in checks]))
    own = units.select("unit_id", F.explode(broken).alias("problem"))
    twice = units.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1").select("unit_id", F.lit("id occurs twice").alias("problem"))
    return own.unionAll(twice)


def require_valid(units: DataFrame) -> DataFrame:
    """The units, or InvalidUnitError with the first problem (by unit id)."""
    if bad := validate_units(units).orderBy("unit_id", "problem").limit(1).collect():
        raise InvalidUnitError(f"unit {bad[0]['unit_id']!r}: {bad[0]['problem']}")
    return units


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as units."""
    return text_units(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang", "source", "doc_id")


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note for each order, with a title, a quantity, a date and a time, and an initialism or words with a slash."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    # A group of a million rows is a few megabytes, and one task reads it; what is made of the rows takes far longer.
    t = t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    level = F.regexp_extract("o_orderpriority", "[A-Z]+", 0)
    rest = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("("), level, F.lit(") set."))).otherwise(F.concat(level, F.lit(" open/close.")))
    note = F.concat(F.lit("Dr. Lee ordered "), (F.col("o_custkey") % 50 + 1).cast("string"), F.lit(" kg on "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" at 12:30. Priority "), rest)
    return text_units(t.select("o_orderkey", note.alias("note")), "o_orderkey", "note", "en-US", "record", "o_orderkey")
