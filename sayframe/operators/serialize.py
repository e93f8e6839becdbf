"""Results as JSON trees and back."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import CHANGES, ISSUES, RESULT_SCHEMA


def unit_json(prepared: DataFrame, issues: DataFrame) -> DataFrame:
    """(ordinal, unit_id, json) of each prepared unit with its changes and issues; nulls are kept."""
    order = F.struct("pass", "pos", "code_rank", *ISSUES.replace(",", "").split()[::2])
    by_unit = issues.groupBy("unit_id").agg(F.sort_array(F.collect_list(order)).alias("_issues"))
    return _json(prepared.join(by_unit, "unit_id", "left"))


def result_json(result: Any) -> DataFrame:
    """The same of a whole result. A unit's own issues are found with it, so only others are put together by unit."""
    if result.checked is None:
        return unit_json(result.units, result.issues)
    names = ISSUES.replace(",", "").split()[::2]
    order = lambda get: F.struct(*[get(n).alias(n) for n in ("pass", "pos", "code_rank", *names)])
    own = F.transform("_residual", lambda i: order(lambda n: F.col("unit_id") if n == "unit_id" else i[n]))
    if result.more_issues is None:
        return _json(result.checked.withColumn("_issues", own))
    by_unit = result.more_issues.groupBy("unit_id").agg(F.collect_list(order(F.col)).alias("_more_issues"))
    met = result.checked.join(by_unit, "unit_id", "left")
    return _json(met.withColumn("_issues", F.when(F.col("_more_issues").isNull(), own).otherwise(F.sort_array(F.concat(own, "_more_issues")))))


def _json(met: DataFrame) -> DataFrame:
    names = ISSUES.replace(",", "").split()[::2]
    plain = F.transform("_issues", lambda i: F.struct(*[i[n].alias(n) for n in names]))
    kind = f"array<struct<{', '.join(f'{n}:{t}' for n, t in zip(names, ISSUES.replace(',', '').split()[1::2]))}>>"
    unit = F.struct("unit_id", F.col("text").alias("source_text"), "spoken_text", "language", "role", "changes", F.coalesce(plain, F.array().cast(kind)).alias("issues"))
    return met.select("ordinal", "unit_id", F.to_json(unit, {"ignoreNullFields": "false"}).alias("json"))


def unit_from_json(df: DataFrame, column: str, schema: Any, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prepared units of JSON; fields that an older writer left out (language, stages, kind, provenance) get their defaults."""
    u = F.from_json(column, schema)
    rows = df.withColumn("_u", u).select(*keep, "_u.*")

    def full(c: Column) -> Column:
        return c.withField("stages", F.coalesce(c["stages"], F.array().cast("array<string>"))).withField("kind", F.coalesce(c["kind"], F.lit("normalization"))).withField("provenance", F.coalesce(c["provenance"], F.lit("{}")))

    whole = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    rows = rows.withColumns({"changes": F.transform(whole("changes"), full), "issues": F.transform(whole("issues"), lambda i: i.withField("provenance", F.coalesce(i["provenance"], F.lit("{}"))))})
    return rows.withColumnRenamed("source_text", "text")


def unit_schema() -> str:
    """The schema of a unit's JSON."""
    struct = lambda ddl: "struct<" + ", ".join(":".join(x.split(" ")) for x in ddl.split(", ")) + ">"
    return f"unit_id string, source_text string, spoken_text string, language string, role string, changes array<{struct(CHANGES)}>, issues array<{struct(ISSUES)}>"


def write_result(result: Any, path: str) -> None:
    """A result as a store: `units`, a row of JSON for each unit, in files by ranges of their order; `stats`; and `manifest`, one
    row with the schema and fingerprints, which is written last. Nothing but the fingerprint's stream passes the driver."""
    rows = result_json(result)
    rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.mode("overwrite").parquet(f"{path}/units")
    result.stats.write.mode("overwrite").parquet(f"{path}/stats")
    row = (RESULT_SCHEMA, result.profile_fingerprint, result.override_fingerprint, result.runtime_fingerprint, result.prepared_fingerprint())
    rows.sparkSession.createDataFrame([row], MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")


def read_result(spark: SparkSession, path: str) -> dict[str, Any]:
    """What write_result wrote: units, changes, issues and stats as frames, and the fingerprints. Fields that an older
    writer left out get their defaults; ValueError for another schema."""
    manifest = spark.read.parquet(f"{path}/manifest").first().asDict()
    if manifest.get("schema") != RESULT_SCHEMA:
        raise ValueError(f"unknown schema {manifest.get('schema')!r}")
    rows = spark.read.parquet(f"{path}/units")
    units = unit_from_json(rows, "json", unit_schema(), keep=("ordinal",))
    fields = lambda name: [f"x.{f}" for f in units.schema[name].dataType.elementType.names if f != "unit_id"]
    flat = lambda name: units.select("ordinal", "unit_id", F.posexplode(name).alias("pos", "x")).select("ordinal", "unit_id", "pos", *fields(name))
    return {**manifest, "units": units, "changes": flat("changes"), "issues": flat("issues"), "stats": spark.read.parquet(f"{path}/stats")}


MANIFEST = "schema string, profile_fingerprint string, override_fingerprint string, runtime_fingerprint string, prepared_fingerprint string"


def result_to_dict(result: Any) -> dict[str, Any]:
    """A whole (small) result as one JSON tree on the driver; larger ones are written as rows of unit_json."""
    units = [json.loads(r["json"]) for r in result_json(result).orderBy("ordinal").collect()]
    stats = result.stats.first().asDict(recursive=True)
    return {
        "schema": RESULT_SCHEMA, "units": units, "changes": [c for u in units for c in u["changes"]], "issues": [i for u in units for i in u["issues"]], "stats": stats,
        "profile_fingerprint": result.profile_fingerprint, "override_fingerprint": result.override_fingerprint, "runtime_fingerprint": result.runtime_fingerprint, "prepared_fingerprint": result.prepared_fingerprint(),
    }


def result_from_dict(spark: SparkSession, data: dict[str, Any]) -> dict[str, Any]:
    """The tree with `units` as a DataFrame; ValueError for another schema."""
    if data.get("schema") != RESULT_SCHEMA:
        raise ValueError(f"unknown schema {data.get('schema')!r}")
    rows = spark.createDataFrame([(i, json.dumps(u)) for i, u in enumerate(data["units"])], "ordinal long, json string")
    return {**data, "units": unit_from_json(rows, "json", unit_schema()), "stats": {"stage_edits": {}, "rules": {}, "recognition_domains": {}, **data["stats"]}}


#: The same under the names of serialised results.
preparation_result_to_dict, preparation_result_from_dict = result_to_dict, result_from_dict
