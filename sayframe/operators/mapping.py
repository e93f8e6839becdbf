"""Maps between places of a source text and its spoken text.

A map has for each place of either text the first (left) and last (right) place of the other that it stands for. At an
edit's start the left place is the edit's start and the right one its end; inside and at its end both are as at the
nearest side of their bias (left: the start, right: the end), and at its end both are the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAP = "struct<source_length:int,output_length:int,source_left:array<int>,source_right:array<int>,output_left:array<int>,output_right:array<int>>"


def _side(length: Column, edits: Column, a: str, b: str, bias: str) -> Column:
    """For each place 0..length of side a its place on side b, stretch by stretch: what lies before each edit, the edit,
    and the rest. An edit that is empty on side a holds its place there, of several the first."""
    none = F.array().cast("array<int>")

    def stretch(first: Column, last: Column, shift: Column) -> Column:
        return F.when(first <= last, F.sequence(first + shift, F.greatest(first, last) + shift)).otherwise(none)

    def behind(i: Column) -> tuple[Column, Column, Column, Column]:
        """Of edit i (or the text's start): its end, its shift, the first place behind it, whether it is empty."""
        c = F.get(edits, i)
        end, empty = F.coalesce(c[f"{a}_end"], F.lit(0)), F.coalesce(c[f"{a}_start"] == c[f"{a}_end"], F.lit(False))
        return end, F.coalesce(c[f"{b}_end"] - c[f"{a}_end"], F.lit(0)), end + empty.cast("int"), empty

    def each(c: Column, i: Column) -> Column:
        end, shift, free, empty = behind(i - 1)
        held = empty & (end == c[f"{a}_start"])
        count = F.greatest(c[f"{a}_end"] - c[f"{a}_start"], F.lit(1)) - held.cast("int")
        return F.concat(stretch(free, c[f"{a}_start"] - 1, shift), F.array_repeat(c[f"{b}_start" if bias == "left" else f"{b}_end"], count))

    _, shift, free, _ = behind(F.size(edits) - 1)
    return F.concat(F.flatten(F.transform(edits, each)), stretch(free, length, shift))


def source_output_map(text: Column, spoken: Column, edits: Column) -> Column:
    """The map of one unit from its placed edits."""
    n, m = F.length(text), F.length(spoken)
    return F.struct(
        n.alias("source_length"), m.alias("output_length"), _side(n, edits, "source", "output", "left").alias("source_left"), _side(n, edits, "source", "output", "right").alias("source_right"),
        _side(m, edits, "output", "source", "left").alias("output_left"), _side(m, edits, "output", "source", "right").alias("output_right"),
    ).cast(MAP)


def identity(length: Column) -> Column:
    same = F.sequence(F.lit(0), length)
    return F.struct(length.alias("source_length"), length.alias("output_length"), *[same.alias(c) for c in ("source_left", "source_right", "output_left", "output_right")]).cast(MAP)


def map_place(m: Column, place: Column, bias: str = "left", to: str = "output") -> Column:
    """The place on the other side; a place out of the text raises an error at the action."""
    if bias not in ("left", "right"):
        raise ValueError("bias is 'left' or 'right'")
    values = m[f"{'source' if to == 'output' else 'output'}_{bias}"]
    return F.when((place < 0) | (place >= F.size(values)), F.raise_error(F.lit("a place lies outside of its text")).cast("int")).otherwise(F.get(values, place))


def map_span(m: Column, start: Column, end: Column, to: str = "output") -> Column:
    return F.struct(map_place(m, start, "left", to).alias("start"), map_place(m, end, "right", to).alias("end"))


def concatenate(maps: DataFrame, group: str, order: str, column: str = "source_map") -> DataFrame:
    """(group, source_map): maps of one group one behind the other. Empty maps are left out; at a border the left one counts.

    Each map is moved by the lengths before it, and all are put together once, so the work is in proportion to their
    places. A group of empty maps has an empty one.
    """
    sides = ("source_left", "source_right", "output_left", "output_right")
    m = F.col("m")
    rows = maps.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(column).alias("m")).withColumn("some", ((m["source_length"] > 0) | (m["output_length"] > 0)).cast("int"))
    before = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumns({name: F.coalesce(F.sum(value).over(before), F.lit(0)).cast("int") for name, value in (("source", m["source_length"]), ("output", m["output_length"]), ("count", F.col("some")))})

    def moved(c: str) -> Column:
        own = F.when(F.col("some") == 0, F.slice(m[c], 1, 0)).when(F.col("count") == 0, m[c]).otherwise(F.slice(m[c], F.lit(2), F.greatest(F.size(m[c]) - 1, F.lit(0))))
        by = F.col("output" if c.startswith("source") else "source")
        return F.transform(own, lambda v: v + by)

    placed = sums.select("g", "o", "m", *[moved(c).alias(c) for c in sides])
    whole = placed.groupBy("g").agg(F.sum(m["source_length"]).cast("int").alias("source_length"), F.sum(m["output_length"]).cast("int").alias("output_length"), F.sort_array(F.collect_list(F.struct("o", *sides))).alias("all"))
    joined = F.struct("source_length", "output_length", *[F.flatten(F.col("all")[c]).alias(c) for c in sides]).cast(MAP)
    return whole.select(F.col("g").alias(group), F.when((F.col("source_length") == 0) & (F.col("output_length") == 0), identity(F.lit(0))).otherwise(joined).alias("source_map"))


def to_json(m: Column) -> Column:
    """A map as JSON with the six fields of its type."""
    return F.to_json(m)


def from_json(json: Column) -> Column:
    """The map that to_json wrote; null gives null. What is no map, lacks a field or breaks the order of places raises an
    error at the action."""
    m = F.from_json(json, MAP)
    fields = [m[c].isNull() for c in ("source_length", "output_length", "source_left", "source_right", "output_left", "output_right")]
    lacks = m.isNull()
    for missing in fields:
        lacks = lacks | missing
    wrong = F.when(lacks, "a map's field is missing or has another type").otherwise(problem(m))
    return F.when(json.isNull(), F.lit(None).cast(MAP)).when(wrong.isNull(), m).otherwise(F.raise_error(wrong).cast(MAP))


def problem(m: Column) -> Column:
    """What is wrong with a map, or null: lengths, order of left and right, range, falling places."""
    wrong = (m["source_length"] < 0) | (m["output_length"] < 0)
    for side, other in (("source", "output"), ("output", "source")):
        left, right, top = m[f"{side}_left"], m[f"{side}_right"], m[f"{other}_length"]
        wrong = wrong | (F.size(left) != m[f"{side}_length"] + 1) | (F.size(right) != F.size(left)) | F.exists(F.zip_with(left, right, lambda a, b: F.coalesce(a > b, F.lit(True))), lambda x: x)
        for arr in (left, right):
            wrong = wrong | F.exists(arr, lambda v: (v < 0) | (v > top)) | (arr != F.sort_array(arr))
    return F.when(wrong, "the map's arrays do not fit")
