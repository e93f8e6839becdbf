"""Edits of another normaliser in place of our rules: validated both ways, and refused as a whole where anything is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import json_column
from ..functions.text import cut
from ..model import ORIGIN, MappingError
from . import edits as applied, mapping

#: Columns of proposed edits that may be missing, with their types.
OPTIONAL = {
    "output_start": "int", "output_end": "int", "stages": "array<string>", "kind": "string", "rule": "string", "recognition_domain": "string", "language": "string",
    "recognition_evidence": "string", "evidence_source": "string", "evidence_score": "double", "evidence_cues": "array<string>",
}
_NEEDED = {"source_start": "int", "source_end": "int", "source": "string", "replacement": "string"}
_EVIDENCE = ("recognition_evidence", "evidence_source", "evidence_score", "evidence_cues")


def _complete(proposed: DataFrame) -> DataFrame:
    """The proposal with all columns, null where it lacks them; others are left out."""
    kinds = {**_NEEDED, **OPTIONAL}
    if lacking := [c for c in ("unit_id", *_NEEDED) if c not in proposed.columns]:
        raise ValueError(f"proposed edits lack {', '.join(lacking)}")
    return proposed.select("unit_id", *[(F.col(c) if c in proposed.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def edit_problems(units: DataFrame, proposed: DataFrame, outputs: DataFrame | None = None, blocked: str = "protected_spans") -> DataFrame:
    """(unit_id, problem): the first thing that is wrong with each unit's proposed edits; empty if all is well.

    proposed: unit_id, source_start, source_end, source, replacement, and any of OPTIONAL. outputs, if given: unit_id,
    spoken_text and maybe source_map, which the edits have to explain. In this order: a field is null; a place is empty,
    outside of the text or overlaps another; the source is not what the text has there; the reported output place is
    another than that which the edits before it make, or the output does not have the replacement there; the edits do not
    rebuild the output; its map does not fit; an edit touches a blocked span. Edits, and outputs, of unknown units are
    problems, too; so are several outputs of one unit. A unit without edits has its own text as output.
    """
    rows = _complete(proposed)
    packed = rows.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct(*_NEEDED, "output_start", "output_end"))).alias("_edits"))
    met = units.select("unit_id", "text", F.col(blocked).alias("_blocked")).join(packed, "unit_id", "left")
    met = met.withColumn("_edits", F.coalesce("_edits", F.array().cast(packed.schema["_edits"].dataType)))
    text, found = F.col("text"), F.col("_edits")
    null = F.exists(found, lambda e: e["source_start"].isNull() | e["source_end"].isNull() | e["source"].isNull() | e["replacement"].isNull())
    expected = applied.placed(F.transform(found, lambda e: F.struct(*[e[c].alias(c) for c in _NEEDED])))
    moved = F.exists(F.zip_with(found, expected, lambda e, x: (e["output_start"].isNotNull() & (e["output_start"] != x["output_start"])) | (e["output_end"].isNotNull() & (e["output_end"] != x["output_end"]))), lambda bad: bad)
    touched = F.exists("_blocked", lambda p: F.exists(found, lambda e: (p["start"] < e["source_end"]) & (e["source_start"] < p["end"])))
    checks = [F.when(null, "an edit's field is null"), applied.problem(text, found), F.when(moved, "an edit's output place is not where the edits before put it")]
    unknown = [rows.select("unit_id").join(units, "unit_id", "left_anti").distinct().select("unit_id", F.lit("the edits' unit is unknown").alias("problem"))]
    if outputs is not None:
        given = outputs.select("unit_id", F.col("spoken_text").alias("_said"), F.lit(True).alias("_given"), *([F.col("source_map").alias("_map")] if "source_map" in outputs.columns else []))
        unknown.append(given.select("unit_id").join(units, "unit_id", "left_anti").distinct().select("unit_id", F.lit("the output's unit is unknown").alias("problem")))
        unknown.append(given.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1").select("unit_id", F.lit("a unit has several outputs").alias("problem")))
        met = met.join(given.dropDuplicates(["unit_id"]), "unit_id", "left")
        said = F.when(F.col("_given"), F.col("_said")).otherwise(text)
        elsewhere = F.exists(expected, lambda x: cut(said, x["output_start"], x["output_end"]) != x["replacement"])
        checks += [F.when(said.isNull(), "the output is null"), F.when(elsewhere, "the output does not have a replacement at its place"), F.when(applied.rebuild(text, found) != said, "the edits do not rebuild the output")]
        if "_map" in given.columns:
            m = F.col("_map")
            lengths = (m["source_length"] != F.length(text)) | (m["output_length"] != F.length(said))
            checks.append(F.when(m.isNotNull() & lengths, "the map's lengths are not those of the texts").when(m.isNotNull(), mapping.problem(m)))
    first = F.coalesce(*checks, F.when(touched, "an edit touches a protected span or an override"))
    out = met.select("unit_id", first.alias("problem")).where("problem IS NOT NULL")
    for more in unknown:
        out = out.unionAll(more)
    return out


def require_edits(units: DataFrame, proposed: DataFrame, outputs: DataFrame | None = None, blocked: str = "protected_spans") -> None:
    """MappingError with the first problem, by unit. It is looked for at once, so no later selection can pass it by."""
    if bad := edit_problems(units, proposed, outputs, blocked).orderBy("unit_id", "problem").limit(1).collect():
        raise MappingError(f"unit {bad[0]['unit_id']!r}: {bad[0]['problem']}")


def external_changes(units: DataFrame, proposed: DataFrame, origin: str = f"{ORIGIN}.external") -> DataFrame:
    """The proposed edits as changes, with the fields of our own. Languages are taken as they are, null if unknown; the
    provenance has the unit's language, and what evidence there is."""
    rows = _complete(proposed).join(units.select("unit_id", F.col("language").alias("_language")), "unit_id")
    have = [c for c in _EVIDENCE if c in proposed.columns]

    def provenance(names: list[str], k: int = 0) -> Column:
        """JSON with those of the columns that are not null in a row."""
        if k == len(have):
            return json_column(origin=F.lit(origin), language=F.col("_language"), **{n: F.col(n) for n in names})
        return F.when(F.col(have[k]).isNotNull(), provenance([*names, have[k]], k + 1)).otherwise(provenance(names, k + 1))

    return rows.select(
        "unit_id", "source_start", "source_end", "source", "replacement", F.coalesce("stages", F.array().cast("array<string>")).alias("stages"), F.coalesce("kind", F.lit("normalization")).alias("kind"), "rule", "recognition_domain",
        provenance([]).alias("provenance"), "language",
    )


def external_warnings(units: DataFrame, outputs: DataFrame, origin: str = f"{ORIGIN}.external") -> DataFrame:
    """The outputs' warnings (an array of texts) as issues without a place, behind those of overrides."""
    rows = outputs.select("unit_id", F.posexplode("warnings").alias("n", "message")).join(units.select("unit_id", "ordinal", "language"), "unit_id")
    none = F.lit(None)
    return rows.select(
        "unit_id", "ordinal", F.lit(-1).alias("pass"), (F.col("n") + (1 << 30)).alias("pos"), F.lit(0).alias("code_rank"), F.lit(f"{origin}.warning").alias("code"), F.lit("warning").alias("severity"), none.cast("int").alias("source_start"), none.cast("int").alias("source_end"),
        none.cast("string").alias("text"), "message", json_column(origin=F.lit(origin), language=F.col("language")).alias("provenance"),
    )
