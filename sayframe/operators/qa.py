"""Residual quality issues of texts, and their way back from spoken text to source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import AFTER, BEFORE, SPACE_CLASS, cut, exploded, spans_sql, sql_string
from ..model import ORIGIN, PreparationError, PreparationProfile

_PLANES = "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" for p in range(17))
_D = r"\p{Nd}"
#: code, severity, pattern, message, in the order in which issues of one place are listed. Those of pass 0 are found in
#: one walk over the characters, those of later passes one after the other.
RULES = [
    (0, "qa.replacement_character", "error", r"\x{FFFD}", "A replacement character remains."),
    (0, "qa.private_use", "warning", r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]", "A private-use character remains."),
    (0, "qa.noncharacter", "error", r"(?![\x{0}-\x{FDCF}])[\x{FDD0}-\x{FDEF}" + _PLANES + "]", "A noncharacter remains."),
    (0, "qa.disallowed_control", "error", r"[\p{Cc}\p{Cf}&&[^\t\n\r\x{200C}\x{200D}]]", "A control or format character remains."),
    (0, "qa.currency_symbol", "warning", r"\p{Sc}", "A currency symbol remains."),
    (0, "qa.measurement_symbol", "warning", r"[%\x{B0}\x{B5}\x{3BC}\x{2103}\x{2109}\x{3A9}]", "A symbol of a measure remains."),
    (1, "qa.residual_digits", "warning", _D + "+", "Digits remain although numbers are expanded."),
    (2, "qa.date_candidate", "warning", f"(?={_D}){BEFORE}{_D}{{1,4}}[/-]{_D}{{1,2}}[/-]{_D}{{1,4}}{AFTER}", "What looks like a date remains."),
    (3, "qa.time_candidate", "warning", f"(?={_D}){BEFORE}{_D}{{1,2}}:{_D}{{2}}(?:[{SPACE_CLASS}]*[aApP][mM])?{AFTER}", "What looks like a time remains."),
    (4, "qa.initialism_candidate", "warning", f"(?=[A-Z]){BEFORE}[A-Z]{{2,8}}{AFTER}", "What looks like an initialism remains."),
    (5, "qa.roman_numeral_candidate", "warning", f"(?=[IVXLCDM]){BEFORE}[IVXLCDM]{{2,}}{AFTER}", "What looks like a Roman numeral remains."),
    (6, "qa.operator_heavy", "warning", f"[=+*/<>^_]{{2,}}|{_D}+[{SPACE_CLASS}]*[=+*/<>^][{SPACE_CLASS}]*{_D}+", "Mathematical or operator text remains."),
]
#: What all characters of pass 0 are among; most texts have none of them, which is seen in one walk.
ODD = r"(?![\t\n\r\x{20}-\x{23}\x{26}-\x{7E}])[\p{Sc}\p{Cc}\p{Cf}\p{Co}\p{Cn}%\x{B0}\x{B5}\x{3BC}\x{2103}\x{2109}\x{3A9}\x{FFFD}]"
_HIT = "array<struct<pass:int,pos:int,rank:int,code:string,severity:string,start:int,end:int,message:string>>"


def scan(text: str, blocked: str, profile: PreparationProfile) -> Column:
    """array<struct<pass,pos,rank,code,severity,start,end,message>> of the issues outside blocked spans, in their order;
    text and blocked are columns' names."""
    found, odd = [], []
    free = f"NOT coalesce(exists({blocked}, p -> s.start < p.end AND p.start < s.end), false)"
    for rank, (turn, code, severity, pattern, message) in enumerate(RULES):
        if code == "qa.residual_digits" and not profile.expand_numbers:
            continue
        issue = f"struct({turn} AS pass, s.start AS pos, {rank} AS rank, '{code}' AS code, '{severity}' AS severity, s.start AS start, s.end AS end, {sql_string(message)} AS message)"
        (found if turn else odd).append(f"transform(filter({spans_sql(text, pattern)}, s -> {free}), s -> {issue})")
    found.append(f"CASE WHEN {text} RLIKE {sql_string(ODD)} THEN concat({', '.join(odd)}) ELSE CAST(array() AS {_HIT}) END")
    return F.expr(f"sort_array(concat({', '.join(found)}))")


def check_units(units: DataFrame, profile: PreparationProfile | None = None, text: str = "text", blocked: str = "protected_spans") -> DataFrame:
    """Issues of all units: unit_id, ordinal, pass, pos, code, severity, source_start, source_end, text, message.

    No row is moved: each unit is scanned where it is read. Null texts have no issues.
    """
    issues = F.explode(scan(text, blocked, profile or PreparationProfile())).alias("i")
    found = units.select("unit_id", "ordinal", F.col(text).alias("_t"), issues)
    return found.select(
        "unit_id", "ordinal", F.col("i.pass").alias("pass"), F.col("i.pos").alias("pos"), F.col("i.rank").alias("code_rank"), F.col("i.code").alias("code"), F.col("i.severity").alias("severity"),
        F.col("i.start").alias("source_start"), F.col("i.end").alias("source_end"), cut(F.col("_t"), F.col("i.start"), F.col("i.end")).alias("text"), F.col("i.message").alias("message"),
        F.lit(f'{{"origin":"{ORIGIN}.qa"}}').alias("provenance"),
    )


def output_spans(blocked: Column, changes: Column) -> Column:
    """Protected spans of the source at their places in the spoken text."""

    def moved(p: Column) -> Column:
        by = F.aggregate(F.filter(changes, lambda c: c["source_end"] <= p["start"]), F.lit(0), lambda a, c: a + F.length(c["replacement"]) - (c["source_end"] - c["source_start"]))
        return F.struct((p["start"] + by).alias("start"), (p["end"] + by).alias("end"), p["reason"].alias("reason"))

    return F.transform(blocked, moved)


def with_residual(prepared: DataFrame, profile: PreparationProfile | None = None, name: str = "_residual") -> DataFrame:
    """`prepared` with its issues as an array, in their order: those of spoken texts, mapped to the source.

    `prepared`: ordinal, unit_id, text, spoken_text, protected_spans and changes (array sorted by source_start). A hit
    that overlaps an edit is mapped to the first such edit's whole source; any other is moved back by the edits before
    it, within the source. The provenance has the place in the spoken text.
    """
    names = [f"_{k}_of_{name}" for k in ("blocked", "hits")]
    held = prepared.withColumn(names[0], output_spans(F.col("protected_spans"), F.col("changes")))
    held = held.withColumn(names[1], scan("spoken_text", names[0], profile or PreparationProfile()))
    # Behind an edit, places differ by what its own ends differ by.
    back = f"least(greatest({{0}} + coalesce(try_element_at(transform(filter(changes, c -> c.output_end <= {{0}}), c -> c.source_end - c.output_end), -1), 0), 0), length(text))"
    edit = "get(filter(changes, c -> h.start < c.output_end AND c.output_start < h.end), 0)"
    span = f"transform(array({edit}), e -> struct(coalesce(e.source_start, {back.format('h.start')}) AS start, coalesce(e.source_end, {back.format('h.end')}) AS end))[0]"
    # Canonical JSON, as of json_column: of numbers and our own name.
    provenance = f"""concat('{{"origin":"{ORIGIN}.qa","output_end":', h.end, ',"output_start":', h.start, '}}')"""
    row = f"struct(h.pass AS pass, h.pos AS pos, h.rank AS code_rank, h.code AS code, h.severity AS severity, s.start AS source_start, s.end AS source_end, substring(text, s.start + 1, s.end - s.start) AS text, h.message AS message, {provenance} AS provenance)"
    found = f"transform({names[1]}, h -> transform(array({span}), s -> {row})[0])"
    return held.withColumn(name, F.expr(found)).drop(*names)


def residual_rows(checked: DataFrame, name: str = "_residual") -> DataFrame:
    """The issues of with_residual as rows."""
    return checked.select("unit_id", "ordinal", exploded(name)).select("unit_id", "ordinal", "x.*")


def check_prepared(prepared: DataFrame, profile: PreparationProfile | None = None) -> DataFrame:
    """The issues of with_residual, found where the units are read."""
    return residual_rows(with_residual(prepared, profile))


def require_no_errors(issues: DataFrame) -> None:
    """PreparationError if an issue is an error; warnings never fail."""
    if first := issues.where("severity = 'error'").orderBy("ordinal", "pass", "pos").limit(1).collect():
        raise PreparationError(f"unit {first[0]['unit_id']!r}: {first[0]['message']}")
