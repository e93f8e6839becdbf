"""Edits of texts: places in the output, application and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import cut, cutting, exploded as each, let, running_sums
from ..model import MappingError
from .qa import output_spans

EDIT = "struct<source_start:int,source_end:int,source:string,replacement:string>"


def with_offsets(changes: DataFrame) -> DataFrame:
    """Adds output_start and output_end from the growth of the edits before, within each unit."""
    order = Window.partitionBy("unit_id").orderBy("source_start").rowsBetween(Window.unboundedPreceding, -1)
    growth = F.length("replacement") - (F.col("source_end") - F.col("source_start"))
    start = F.col("source_start") + F.coalesce(F.sum(growth).over(order), F.lit(0)).cast("int")
    return changes.drop("output_start", "output_end").withColumn("output_start", start.cast("int")).withColumn("output_end", (start + F.length("replacement")).cast("int"))


def placed(edits: Column) -> Column:
    """The same for one unit's sorted array of edits: each gains output_start and output_end."""
    growth = F.transform(edits, lambda c: F.length(c["replacement"]) - (c["source_end"] - c["source_start"]))

    def place(before: Column) -> Column:
        start = lambda c, i: c["source_start"] + F.get(before, i)
        return F.transform(edits, lambda c, i: c.withField("output_start", start(c, i)).withField("output_end", start(c, i) + F.length(c["replacement"])))

    return let(running_sums(growth), place)


def rebuild(text: Column, edits: Column) -> Column:
    """The text with its sorted edits applied."""
    end = lambda i: F.coalesce(F.get(edits, i)["source_end"], F.lit(0))
    parts = cutting(text, lambda piece: F.transform(edits, lambda c, i: F.concat(piece(end(i - 1), c["source_start"]), c["replacement"])))
    return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(edits) - 1) + 1, F.length(text)))


def problem(text: Column, edits: Column) -> Column:
    """What is wrong with a sorted array of edits, or null: empty source spans, places out of the text, overlaps, stale sources."""
    out = let(F.length(text), lambda size: F.exists(edits, lambda c: (c["source_start"] < 0) | (c["source_end"] > size) | (c["source_start"] >= c["source_end"])))
    clash = F.size(edits) > 1
    clash = clash & F.exists(F.sequence(F.lit(1), F.greatest(F.size(edits) - 1, F.lit(1))), lambda i: F.coalesce(F.get(edits, i - 1)["source_end"] > F.get(edits, i)["source_start"], F.lit(False)))
    stale = cutting(text, lambda piece: F.exists(edits, lambda c: piece(c["source_start"], c["source_end"]) != c["source"]))
    return F.when(out, "an edit lies outside of its text").when(clash, "edits overlap").when(stale, "an edit's source is not in the text")


def apply_changes(units: DataFrame, changes: DataFrame, collect_errors: bool = False) -> DataFrame:
    """`units` with spoken_text and changes (an array sorted by place, with output places).

    Edits that overlap, lie outside or do not match their text raise MappingError's message at the action, or with
    collect_errors give a column `error` and no spoken_text. Edits of unknown units are left out.
    """
    fields = [c for c in changes.columns if c not in ("unit_id", "ordinal", "source_start", "source_end", "output_start", "output_end")]
    packed = changes.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("source_start", "source_end", *fields))).alias("changes"))
    kind = packed.schema["changes"].dataType
    met = units.join(packed, "unit_id", "left").withColumn("changes", F.coalesce("changes", F.array().cast(kind)))
    bad = problem(F.col("text"), F.col("changes"))
    met = met.withColumn("error", bad)
    if not collect_errors:
        met = met.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit(f"{MappingError.__name__}: unit "), F.col("unit_id"), F.lit(": "), F.col("error")))))
    good = F.col("error").isNull()
    out = met.withColumn("spoken_text", F.when(good, rebuild(F.col("text"), F.col("changes")))).withColumn("changes", placed(F.col("changes")))
    return out if collect_errors else out.drop("error")


def apply_own(units: DataFrame, changes: str) -> DataFrame:
    """The same for units that have their changes in a column, in order of place, cut from their texts and without overlaps."""
    kept = [c for c in units.columns if c not in ("unit_id", changes)]
    own = F.col(changes)
    return units.select("unit_id", *kept, placed(own).alias("changes"), rebuild(F.col("text"), own).alias("spoken_text"))


def exploded(prepared: DataFrame) -> DataFrame:
    """The changes of prepared units as rows in order: unit_id, ordinal, pos and the edit's fields."""
    return prepared.select("unit_id", "ordinal", each("changes", "pos")).select("unit_id", "ordinal", "pos", "x.*")


def verify(prepared: DataFrame) -> DataFrame:
    """(unit_id, problem) where texts, edits and protected spans do not fit together; empty for what apply_changes gives."""
    text, spoken, edits = F.col("text"), F.col("spoken_text"), F.col("changes")
    output = F.exists(edits, lambda c: cut(spoken, c["output_start"], c["output_end"]) != c["replacement"])
    kept = F.exists(F.zip_with("protected_spans", output_spans(F.col("protected_spans"), edits), lambda p, o: cut(spoken, o["start"], o["end"]) != cut(text, p["start"], p["end"])), lambda bad: bad)
    touched = F.exists("protected_spans", lambda p: F.exists(edits, lambda c: (p["start"] < c["source_end"]) & (c["source_start"] < p["end"])))
    found = F.coalesce(problem(text, edits), F.when(output, "a replacement is not at its place"), F.when(rebuild(text, edits) != spoken, "the spoken text is not that of its edits"), F.when(touched, "an edit touches a protected span"), F.when(kept, "a protected span is not as it was"))
    # Not as a filter, which would be computed once more, with all that the columns are made of.
    return prepared.select("unit_id", F.explode(let(found, lambda said: F.when(said.isNotNull(), F.array(said)))).alias("problem"))
