"""The same pronunciation of an initialism in all units of a language, once brackets have introduced it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.identity import canonical_json, change_id_column, json_column
from ..functions.text import SPACE_CLASS, chosen_sql, cut, let, spans, sql_string
from ..functions.unicode import casefold, language_key, nfc
from ..model import CHANGE_FIELDS, ORIGIN
from .normalize import INITIALISM_RULE

#: Runs of characters that no initialism may border on: letters, marks, numbers, connectors, dashes and apostrophes.
_RUN = r"[\p{L}\p{M}\p{N}\p{Pc}\p{Pd}'\x{2019}]+"


def seeds(changes: DataFrame, units: DataFrame) -> DataFrame:
    """Changes that introduce an initialism by spelling its letters: language_key, surface, spoken, change_id, unit_id, source_start.

    A letter is a character with its marks. There are two letters at least, as many spoken ones, each composes (NFC) to one
    alphabetic character, and both are the same but for case.
    """
    keys = units.select("unit_id", language_key(F.col("language")).alias("language_key"))
    return _spelled(changes.where(F.col("rule") == INITIALISM_RULE)).join(keys, "unit_id").selectExpr(*_SEED)


def own_seeds(units: DataFrame, changes: str) -> DataFrame:
    """The same from units that have their changes in a column."""
    rows = units.select("unit_id", language_key(F.col("language")).alias("language_key"), F.explode(F.filter(changes, lambda c: c["rule"] == INITIALISM_RULE)).alias("c"))
    return _spelled(rows.select("unit_id", "language_key", "c.*")).selectExpr(*_SEED)


_SEED = ("language_key", "source AS surface", "replacement AS spoken", "id AS change_id", "unit_id", "source_start")


def _spelled(changes: DataFrame) -> DataFrame:
    said = F.array_join(F.filter(F.split("replacement", f"[{SPACE_CLASS}]+"), lambda x: x != ""), " ")
    letters = F.array_join(F.regexp_extract_all("source", F.lit(r"(?s)(.\p{M}*)")), " ")
    # Both sides in one text, so that it is composed and folded once; the folding of a letter may have marks.
    alphabetic = let(nfc(F.concat(letters, F.lit("\n"), said)), lambda both: F.when(both.rlike(r"^\p{L}( \p{L})+\n\p{L}( \p{L})+$"), casefold(both)))
    folded = said.rlike(r"^.\p{M}*( .\p{M}*)+$") & let(F.split(alphabetic, "\n"), lambda x: F.get(x, F.lit(0)) == F.get(x, F.lit(1)))
    # Capitals A to Z that are spoken as they are written need no tables.
    plain = letters.rlike("^[A-Z]( [A-Z])+$") & (said == letters)
    return changes.where(F.when(plain, True).otherwise(folded))


def seed_groups(found: DataFrame, all_ids: bool = True) -> DataFrame:
    """One row for each (language_key, surface): ways (distinct pronunciations), the first seed and, with all_ids, all
    seeds' change ids, which only conflicts tell."""
    first = lambda *cols: F.min(F.struct(*cols))
    every = [F.array_join(F.array_sort(F.collect_set("change_id")), ", ").alias("seed_change_ids")] if all_ids else []
    return found.groupBy("language_key", "surface").agg(
        F.size(F.collect_set("spoken")).alias("ways"), first("change_id", "unit_id", "source_start", "spoken").alias("seed"), first("unit_id", "source_start", "change_id", "spoken").alias("earliest"), *every,
    )


def conflicts(groups: DataFrame) -> DataFrame:
    """An issue for each initialism with several pronunciations, at the earliest seed; none of them is applied."""
    return groups.where("ways > 1").select(
        F.col("earliest.unit_id").alias("unit_id"), F.lit(f"{ORIGIN}.initialism_conflict").alias("code"), F.lit("warning").alias("severity"), F.col("earliest.source_start").alias("source_start"),
        (F.col("earliest.source_start") + F.length("surface")).alias("source_end"), F.col("surface").alias("text"), F.concat(F.lit("Initialism "), "surface", F.lit(" is pronounced in several ways, so none is applied elsewhere.")).alias("message"),
        json_column(origin=F.lit(ORIGIN), language_key=F.col("language_key"), seed_change_ids=F.col("seed_change_ids")).alias("provenance"),
    )


def own_changes(units: DataFrame, agreed: Sequence[Row], own: str, name: str = "_more") -> DataFrame:
    """`units` with the rows of consistency_changes, and their ids, as an array in order of place: for few agreed groups,
    which the driver holds. `own` is the column of a unit's changes. No row is moved."""
    if not agreed:
        return units.withColumn(name, F.array().cast(CHANGE_FIELDS))
    note = lambda g: canonical_json({"origin": ORIGIN, "seed_change_id": g["seed"]["change_id"], "seed_rule": INITIALISM_RULE, "seed_surface": g["surface"]})
    known = F.from_json(F.lit(canonical_json({f"{g['language_key']}\n{g['surface']}": {"spoken": g["seed"]["spoken"], "note": note(g)} for g in agreed})), "map<string,struct<spoken:string,note:string>>")
    words = ", ".join(sql_string(w + end) for w in sorted({g["surface"] for g in agreed}) for end in ("", "'s", "\u2019s"))
    key = f"_key_of_{name}"
    text = F.col("text")

    def change(h: Column) -> Column:
        def named(v: Column, stem: Column) -> Column:
            return F.when(v.isNotNull(), F.struct(
                h["start"].alias("source_start"), h["end"].alias("source_end"), change_id_column(F.col("unit_id"), h["start"], h["end"], h["surface"]).alias("id"), h["surface"].alias("source"), F.concat(v["spoken"], F.substring(h["surface"], F.length(stem) + 1, F.length(h["surface"]))).alias("replacement"),
                F.array(F.lit("consistency")).alias("stages"), F.lit("consistency").alias("kind"), F.lit(f"{ORIGIN}.initialism-consistency").alias("rule"), F.lit(None).cast("string").alias("recognition_domain"), v["note"].alias("provenance"), F.col("language").alias("language"),
            ))

        stem = F.when(F.split(key, "-")[0] == "en", F.regexp_replace(h["surface"], r"['\x{2019}]s$", "")).otherwise(h["surface"])
        return let(stem, lambda s: let(F.try_element_at(known, F.concat(F.col(key), F.lit("\n"), s)), lambda v: named(v, s)))

    held = lambda spans, h, a, b: F.coalesce(F.exists(spans, lambda p: (p[a] < h["end"]) & (h["start"] < p[b])), F.lit(False))
    free = F.filter(F.expr(chosen_sql("text", _RUN, words)), lambda h: ~(held("protected_spans", h, "start", "end") | held(own, h, "source_start", "source_end")))
    return units.withColumn(key, language_key(F.col("language"))).withColumn(name, F.when(text.isNotNull(), F.array_compact(F.transform(free, change)))).drop(key)


def consistency_changes(units: DataFrame, prepared_changes: DataFrame, groups: DataFrame) -> DataFrame:
    """Changes for all other occurrences of an agreed initialism: whole runs of word characters that are the surface, in
    English also with 's, outside protected spans and changes. Runs are joined with the seeds by equality."""
    agreed = groups.where("ways = 1").select("language_key", "surface", "seed")
    text = F.col("text")
    held = prepared_changes.groupBy("unit_id").agg(F.collect_list(F.struct(F.col("source_start").alias("start"), F.col("source_end").alias("end"))).alias("taken"))
    runs = units.select("unit_id", "text", "language", "protected_spans", language_key(F.col("language")).alias("language_key"), F.explode(spans("text", _RUN)).alias("s"))
    surface = cut(text, F.col("s.start"), F.col("s.end"))
    english = F.split("language_key", "-")[0] == "en"
    stem = F.when(english, F.regexp_replace(surface, r"['\x{2019}]s$", "")).otherwise(surface)
    runs = runs.where(~F.exists("protected_spans", lambda p: (p["start"] < F.col("s.end")) & (F.col("s.start") < p["end"]))).select("unit_id", "language", "language_key", "s", surface.alias("source"), stem.alias("surface"))
    met = runs.join(agreed, ["language_key", "surface"]).join(held, "unit_id", "left")
    met = met.where(~F.coalesce(F.exists("taken", lambda p: (p["start"] < F.col("s.end")) & (F.col("s.start") < p["end"])), F.lit(False)))
    return met.select(
        "unit_id", F.col("s.start").alias("source_start"), F.col("s.end").alias("source_end"), "source", F.concat("seed.spoken", F.substring("source", F.length("surface") + 1, F.length("source"))).alias("replacement"),
        F.array(F.lit("consistency")).alias("stages"), F.lit("consistency").alias("kind"), F.lit(f"{ORIGIN}.initialism-consistency").alias("rule"), F.lit(None).cast("string").alias("recognition_domain"),
        json_column(origin=F.lit(ORIGIN), seed_change_id=F.col("seed.change_id"), seed_rule=F.lit(INITIALISM_RULE), seed_surface=F.col("surface")).alias("provenance"), "language",
    )
