"""Spans and issues of very long texts, found by many tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import SPACE_CLASS, let, matches, running_sums
from ..model import SPAN, PreparationProfile
from .qa import check_units

#: Characters from which on a text is cut.
PIECE = 1 << 16


def cut_texts(units: DataFrame, size: int = PIECE) -> DataFrame:
    """The units' texts in pieces: one row for each, with `piece` (from 0), `offset` (characters before it), and the
    protected spans that reach into it, by its own places.

    A piece has more than `size` characters, save the last, and ends after a letter that white space follows. No issue,
    link or token lies across such a place, nor does any of them look past it, so what pieces show is what the whole
    shows, for any size. A text without such a place stays whole. Null and empty texts give no rows. Each piece looks at
    all protected spans of its text once.
    """
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{{int(size)}}}.*?\p{{L}}(?=[{SPACE_CLASS}])|.+"), F.lit(0))
    placed = let(parts, lambda p: F.arrays_zip(p.alias("text"), running_sums(F.transform(p, F.length)).alias("offset")))
    end = F.col("p.offset") + F.length("p.text")
    reach = F.filter("protected_spans", lambda s: (s["start"] < end) & (s["end"] > F.col("p.offset")))
    own = F.transform(reach, lambda s: F.struct((s["start"] - F.col("p.offset")).alias("start"), (s["end"] - F.col("p.offset")).alias("end"), s["reason"].alias("reason"))).cast(f"array<{SPAN}>")
    rows = units.select(*[c for c in units.columns if c != "text"], F.posexplode(placed).alias("piece", "p"))
    return rows.withColumns({"text": F.col("p.text"), "offset": F.col("p.offset"), "protected_spans": own}).drop("p")


def spread(units: DataFrame, size: int = PIECE) -> DataFrame:
    """(unit_id struct<id,offset>, ordinal, text, protected_spans): short texts where they are read, the pieces of long
    ones dealt over all tasks by their unit and number, so that one text's pieces do not meet in a task."""
    kept = units.select("unit_id", "ordinal", "text", "protected_spans")
    key = lambda offset: F.struct(F.col("unit_id").alias("id"), offset.cast("int").alias("offset")).alias("unit_id")
    short = kept.where(F.length("text") <= size).select(key(F.lit(0)), "ordinal", "text", "protected_spans")
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = cut_texts(kept.where(F.length("text") > size), size).repartition(tasks, "unit_id", "piece")
    return short.unionAll(long.select(key(F.col("offset")), "ordinal", "text", "protected_spans"))


def check_large(units: DataFrame, profile: PreparationProfile | None = None, size: int = PIECE) -> DataFrame:
    """The rows of qa.check_units, where a text of more than `size` characters is scanned by many tasks. The texts are
    read twice; only those that are cut are shuffled."""
    found = check_units(spread(units, size), profile)
    by = F.col("unit_id.offset")
    return found.withColumns({c: F.col(c) + by for c in ("pos", "source_start", "source_end")}).withColumn("unit_id", F.col("unit_id.id"))


def span_rows(units: DataFrame, pattern: str, size: int = PIECE) -> DataFrame:
    """(unit_id, ordinal, start, end, surface) of a pattern's matches, protected or not, as functions.text.matches finds
    them. The pattern's matches must not lie across a place between a letter and white space, as those of links, tokens
    and issues never do."""
    found = spread(units, size).select("unit_id", "ordinal", F.explode(matches("text", pattern)).alias("m"))
    by = F.col("unit_id.offset")
    return found.select(F.col("unit_id.id").alias("unit_id"), "ordinal", (F.col("m.start") + by).alias("start"), (F.col("m.end") + by).alias("end"), F.col("m.surface").alias("surface"))
