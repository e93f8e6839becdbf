"""prepare_units, prepare_text and prepare_run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import identity
from ..functions.identity import change_id_column
from ..functions.text import once
from ..model import RESULT_SCHEMA, SPAN, PreparationProfile
from ..operators import consistency, edits as applied, external, mapping, normalize as rules, overrides as policy, qa, sentences, stats as counting
from ..sources.units import require_valid

_FIELDS = ("source_start", "source_end", "id", "source", "replacement", "stages", "kind", "rule", "recognition_domain", "provenance", "language")


@dataclass
class PreparationResult:
    """Frames of one preparation. units: the unit with spoken_text and changes; issues are rows in (ordinal, pass, pos, code_rank) order."""

    units: DataFrame
    changes: DataFrame
    issues: DataFrame
    stats: DataFrame
    profile_fingerprint: str
    override_fingerprint: str
    runtime_fingerprint: str
    schema: str = RESULT_SCHEMA
    kept: DataFrame | None = None
    #: The units with their own issues as an array, and the issues that come from elsewhere (of overrides, conflicts), as rows.
    checked: DataFrame | None = None
    more_issues: DataFrame | None = None

    def release(self) -> None:
        """Gives back what the first pass keeps on the executors; later actions compute it again."""
        if self.kept is not None:
            self.kept.unpersist()

    @property
    def changed(self) -> DataFrame:
        """Units whose spoken text is another than their text."""
        return self.units.where("text <> spoken_text")

    @property
    def warnings(self) -> DataFrame:
        return self.issues.where("severity = 'warning'")

    @property
    def errors(self) -> DataFrame:
        return self.issues.where("severity = 'error'")

    def prepared_fingerprint(self) -> str:
        return identity.prepared_fingerprint(self.units)


def _with_ids(changes: DataFrame) -> DataFrame:
    return changes.withColumn("id", change_id_column(F.col("unit_id"), F.col("source_start"), F.col("source_end"), F.col("source")))


def first_pass(units: DataFrame, overrides: policy.Policy = (), profile: PreparationProfile | None = None, edits: DataFrame | None = None, outputs: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Changes by overrides and rules, and the issues of the overrides. Rules see the overrides' places as protected.

    With `edits` (and maybe `outputs` with spoken_text, source_map and warnings), these take the place of the rules, and
    MappingError is raised here if anything is wrong with them, or if one touches an override's place.
    """
    blocked, masked, more, issues = "protected_spans", units, None, None
    if isinstance(overrides, DataFrame) or overrides:
        resolved = policy.require_no_conflict(policy.resolve_overrides(policy.match_overrides(units, overrides)))
        taken = F.transform("selected", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("override").alias("reason"))).cast(f"array<{SPAN}>")
        blocked, masked = "_masked", resolved.withColumn("_masked", F.concat("protected_spans", taken))
        more, issues = policy.override_changes(resolved, overrides), policy.override_issues(resolved)
    if edits is None:
        changes = rules.normalize(masked, profile, blocked)
    else:
        external.require_edits(masked, edits, outputs, blocked)
        changes = external.external_changes(units, edits)
        if outputs is not None and "warnings" in outputs.columns:
            warned = external.external_warnings(units, outputs)
            issues = warned if issues is None else issues.unionByName(warned)
    changes = changes if edits is None else _with_ids(changes)
    return (changes if more is None else changes.unionByName(_with_ids(more))).select("unit_id", *_FIELDS), issues


def _together(units: DataFrame, profile: PreparationProfile) -> tuple[DataFrame, DataFrame | None] | None:
    """Units with their changes by rules and for consistency as `_changes`, and the issues of disputed initialisms. None if there are more than HELD initialisms, which the driver then does not hold.

    Only units with an initialism in brackets can introduce one, so only these are looked at for it.
    """
    found = consistency.own_seeds(rules.edited(units.where(F.col("text").rlike(rules.INITIALISM_PATTERN)), profile), "_own")
    groups = consistency.seed_groups(found, all_ids=False).limit(HELD + 1).collect()
    if len(groups) > HELD:
        return None
    more = consistency.own_changes(rules.edited(units, profile), [g for g in groups if g["ways"] == 1], "_own")
    changed = once(more, "_changes", F.when(F.size("_more") > 0, F.sort_array(F.concat("_own", "_more"))).otherwise(F.col("_own"))).drop("_own", "_more")
    keys = [(g["language_key"], g["surface"]) for g in groups if g["ways"] > 1]
    if not keys:
        return changed, None
    disputed = F.broadcast(units.sparkSession.createDataFrame(keys, "language_key string, surface string"))
    return changed, _named(F.broadcast(consistency.conflicts(consistency.seed_groups(found.join(disputed, ["language_key", "surface"], "left_semi")))), units)


def _named(conflicts: DataFrame, units: DataFrame) -> DataFrame:
    return conflicts.join(units.select("unit_id", "ordinal"), "unit_id").withColumns({"pass": F.lit(7), "pos": F.col("source_start"), "code_rank": F.lit(0)})


#: Initialisms up to which the driver holds what is agreed on them, so that each unit is prepared where it is read.
HELD = 1000


def _result(prepared: DataFrame, issues: DataFrame | None, overrides: policy.Policy, profile: PreparationProfile, strict: bool) -> PreparationResult:
    checked = qa.with_residual(prepared, profile)
    residual = qa.residual_rows(checked)
    found = residual if issues is None else issues.unionByName(residual)
    if strict:
        qa.require_no_errors(found)
    return PreparationResult(
        prepared, applied.exploded(prepared), found, counting.preparation_stats(checked, "_residual", issues), identity.profile_fingerprint(profile), policy.policy_fingerprint(overrides), identity.runtime_fingerprint(), checked=checked, more_issues=issues,
    )


def prepare_text(units: DataFrame, overrides: policy.Policy = (), profile: PreparationProfile | None = None, strict: bool = False, edits: DataFrame | None = None, outputs: DataFrame | None = None) -> PreparationResult:
    """Each unit by itself: overrides, rules (or the given edits) and issues, without consistency between units."""
    profile = profile or PreparationProfile()
    if _own(overrides, edits):
        return _result(applied.apply_own(rules.edited(units, profile), "_own"), None, overrides, profile, strict)
    changes, issues = first_pass(units, overrides, profile, edits, outputs)
    return _result(applied.apply_changes(units, changes), issues, overrides, profile, strict)


def _own(overrides: policy.Policy, edits: DataFrame | None) -> bool:
    """Whether a unit's own text and rules give all its changes of the first pass."""
    return edits is None and not isinstance(overrides, DataFrame) and not overrides


def prepare_units(units: DataFrame, overrides: policy.Policy = (), profile: PreparationProfile | None = None, strict: bool = False, validate: bool = True, edits: DataFrame | None = None, outputs: DataFrame | None = None, on_progress: Callable | None = None) -> PreparationResult:
    """All units together. Initialisms that one unit introduces are then spoken alike in all units of its language; where
    units disagree, an issue says so and nothing is applied. Results do not depend on the order of units.

    edits and outputs are those of another normaliser, in place of the rules (see first_pass). on_progress is called on the
    driver for each unit of the first pass (see streaming.stream.notify). strict raises PreparationError if an issue is an error. validate checks ids and spans first (InvalidUnitError).
    """
    profile = profile or PreparationProfile()
    units = require_valid(units) if validate else units
    if _own(overrides, edits) and on_progress is None and (done := _together(units, profile)):
        return _result(applied.apply_own(done[0], "_changes"), done[1], overrides, profile, strict)
    changes, issues = first_pass(units, overrides, profile, edits, outputs)
    changes = changes.persist()  # read three times; lost parts are computed again
    if on_progress is not None:
        from ..streaming.stream import notify

        notify(units, on_progress, changes)
    groups = consistency.seed_groups(consistency.seeds(changes, units))
    more = _with_ids(consistency.consistency_changes(units, changes, groups)).select("unit_id", *_FIELDS)
    disputes = _named(consistency.conflicts(groups), units)
    issues = disputes if issues is None else issues.unionByName(disputes)
    result = _result(applied.apply_changes(units, changes.unionByName(more)), issues, overrides, profile, strict)
    result.kept = changes
    return result


def prepare_run(units: DataFrame, profile: PreparationProfile | None = None, edits: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """Rules (or the given edits) only: each unit with spoken_text, changes and its source_map; no overrides, issues, sentences or consistency."""
    if edits is None:
        prepared = applied.apply_own(rules.edited(units, profile), "_own")
    else:
        prepared = applied.apply_changes(units, first_pass(units, (), profile, edits, outputs)[0])
    return prepared.withColumn("source_map", mapping.source_output_map(F.col("text"), F.col("spoken_text"), F.col("changes")))


def contexts(result: PreparationResult) -> DataFrame:
    return sentences.change_contexts(result.units)
