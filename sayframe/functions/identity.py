"""Canonical JSON, identifiers and fingerprints, on the driver and as columns."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from collections.abc import Iterable, Mapping
from importlib import metadata
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..model import PreparationProfile, SpeechOverride
from .text import let


def _check_json(value: Any) -> Any:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("JSON numbers are finite")
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("JSON keys are strings")
        return {k: _check_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_check_json(v) for v in value]
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    raise ValueError(f"{type(value).__name__} is no JSON value")


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(_check_json(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def stable_id(prefix: str, payload: Mapping[str, Any]) -> str:
    if not prefix or not isinstance(prefix, str) or ":" in prefix:
        raise ValueError("a prefix is a string without a colon, and not empty")
    return f"{prefix}:v1:{fingerprint(payload)[:20]}"


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def source_change_id(unit_id: str, source_start: int, source_end: int, source: str) -> str:
    return stable_id("chg", {"unit_id": unit_id, "source_start": source_start, "source_end": source_end, "source": source})


def _policy(o: SpeechOverride) -> dict[str, Any]:
    return {"surface": o.surface, "spoken": o.spoken, "match": o.match, "case_sensitive": o.case_sensitive, "scope": dataclasses.asdict(o.scope)}


def override_id(override: SpeechOverride) -> str:
    return stable_id("ovr", _policy(override))


def override_fingerprint(overrides: Iterable[SpeechOverride]) -> str:
    """Of the policy in its order; ids and provenance do not count."""
    return fingerprint([_policy(o) for o in overrides])


def profile_fingerprint(profile: PreparationProfile | Mapping[str, Any]) -> str:
    if isinstance(profile, PreparationProfile):
        return fingerprint(dataclasses.asdict(profile))
    if not isinstance(profile, Mapping):
        raise TypeError("a profile or a mapping is asked for")
    return fingerprint(dict(profile))


RUNTIME_PARTS = ("sayframe", "pyspark")


def runtime_versions() -> dict[str, str]:
    out = {}
    for name in RUNTIME_PARTS:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "unknown"
    return out


def runtime_fingerprint(versions: Mapping[str, str] | None = None) -> str:
    """Of the versions of RUNTIME_PARTS alone; others are ignored."""
    have = runtime_versions() if versions is None else versions
    return fingerprint({name: str(have.get(name, "unknown")) for name in RUNTIME_PARTS})


def json_column(**fields: Column) -> Column:
    """Canonical JSON of an object with these fields: sorted keys, nulls kept, and lower-case hex in escapes."""

    def lowered(text: Column) -> Column:
        for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
            # Only an escape's own backslash counts, one with an even number of backslashes before it.
            text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", f"$1\\\\u{code:04x}")
        return text

    whole = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return let(whole, lambda text: F.when(text.contains("\\u00"), lowered(text)).otherwise(text))


def stable_id_column(prefix: str, **fields: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:v1:"), F.substring(F.sha2(json_column(**fields), 256), 1, 20))


def change_id_column(unit_id: Column, start: Column, end: Column, source: Column) -> Column:
    return stable_id_column("chg", unit_id=unit_id, source_start=start, source_end=end, source=source)


def unit_fingerprints(units: DataFrame, profile: str, override: str, runtime: str) -> DataFrame:
    """(unit_id, fingerprint). Linguistic tokens count where there are some; metadata never does."""
    spans = F.transform(F.coalesce("protected_spans", F.array().cast(units.schema["protected_spans"].dataType)), lambda s: F.struct(s["end"].alias("end"), s["reason"].alias("reason"), s["start"].alias("start")))
    fields = {
        "id": F.col("unit_id"), "text_sha256": F.sha2("text", 256), "language": F.col("language"), "role": F.col("role"), "protected_spans": spans,
        "profile_fingerprint": F.lit(profile), "override_fingerprint": F.lit(override), "runtime_fingerprint": F.lit(runtime),
    }
    plain = json_column(**fields)
    if "linguistic_tokens" in units.columns:
        names = sorted(("start", "end", "text", "pos", "tag", "lemma", "language"))
        tokens = F.transform("linguistic_tokens", lambda t: F.struct(*[t[n].alias(n) for n in names]))
        plain = F.when(F.coalesce(F.size("linguistic_tokens"), F.lit(0)) > 0, json_column(**fields, linguistic_tokens=tokens)).otherwise(plain)
    return units.select("unit_id", F.sha2(plain, 256).alias("fingerprint"))


def prepared_fingerprint(prepared: DataFrame) -> str:
    """Of all (unit_id, spoken_text) in the order of `ordinal`.

    Units are encoded in parallel and sorted, then hashed one partition after the other on the driver, which holds one
    partition and the next.
    """
    digest = hashlib.sha256(b"[")
    # Kept, as a sort by ranges reads its rows twice: for the ranges, and to deal them out.
    rows = prepared.select("ordinal", json_column(unit_id=F.col("unit_id"), spoken_text=F.col("spoken_text")).alias("j")).persist(StorageLevel.DISK_ONLY)
    try:
        for i, row in enumerate(rows.sort("ordinal").select("j").toLocalIterator(prefetchPartitions=True)):
            digest.update((b"," if i else b"") + row["j"].encode())
    finally:
        rows.unpersist()
    digest.update(b"]")
    return digest.hexdigest()
