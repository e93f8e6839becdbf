"""Counts of a preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def histogram(changes: DataFrame, what: str) -> DataFrame:
    """(name, edits) by stage, rule or recognition domain; rules that are null and domains that are null or empty do not count."""
    names = {"stage": changes.select(F.explode("stages").alias("name")), "rule": changes.select(F.col("rule").alias("name")).dropna(), "domain": changes.select(F.col("recognition_domain").alias("name")).where("name <> ''")}
    return names[what].groupBy("name").agg(F.count("*").alias("edits"))


def preparation_stats(checked: DataFrame, residual: str, issues: DataFrame | None = None) -> DataFrame:
    """One row: units_processed, units_changed, changes, structured_numeric_edits, source_digit_replacements,
    warning_count, error_count, and the maps stage_edits, rules and recognition_domains. `checked` has changes and, as
    `residual`, issues of each unit; `issues` are rows of others.

    Each unit is made once: it gives counts by kind and name, which are added up.
    """
    c, found, none = F.col("changes"), F.col(residual), F.array().cast("array<struct<what:string,name:string,n:bigint>>")
    row = lambda what, n, name=F.lit(""): F.struct(F.lit(what).alias("what"), name.alias("name"), F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint")).alias("n"))
    one = lambda what, name: row(what, F.lit(1), name)
    structured = F.filter(c, lambda x: F.array_contains(x["stages"], "structured") | (x["kind"] == "structured"))
    digits = F.filter(c, lambda x: x["source"].rlike(r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"))
    level = lambda of: F.size(F.filter(found, lambda i: i["severity"] == of))
    own = F.array(
        row("units", F.lit(1)), row("changed", F.col("text") != F.col("spoken_text")), row("changes", F.size(c)), row("structured", F.size(structured)), row("digits", F.size(digits)),
        row("warning", F.when(found.isNotNull(), level("warning"))), row("error", F.when(found.isNotNull(), level("error"))),
    )
    named = [
        F.flatten(F.transform(c, lambda x: F.transform(x["stages"], lambda s: one("stage", s)))), F.transform(F.filter(c, lambda x: x["rule"].isNotNull()), lambda x: one("rule", x["rule"])),
        F.transform(F.filter(c, lambda x: x["recognition_domain"] != ""), lambda x: one("domain", x["recognition_domain"])),
    ]
    rows = checked.select(F.explode(F.concat(own, *[F.coalesce(x, none) for x in named])).alias("x")).select("x.*")
    if issues is not None:
        rows = rows.unionAll(issues.select(F.col("severity").alias("what"), F.lit("").alias("name"), F.lit(1).cast("bigint").alias("n")))
    sums = rows.groupBy("what", "name").agg(F.sum("n").alias("n"))
    total = lambda what, name: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(name)
    as_map = lambda what, name: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("name", F.col("n").alias("edits")))))).alias(name)
    return sums.agg(
        total("units", "units_processed"), total("changed", "units_changed"), total("changes", "changes"), total("structured", "structured_numeric_edits"), total("digits", "source_digit_replacements"),
        total("warning", "warning_count"), total("error", "error_count"), as_map("stage", "stage_edits"), as_map("rule", "rules"), as_map("domain", "recognition_domains"),
    )
