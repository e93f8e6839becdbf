"""Policies, schemas and errors of speech-text preparation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

#: Origin of what this library finds itself, and the id of its serialised results.
ORIGIN = "sayframe"
RESULT_SCHEMA = "sayframe.preparation.v2"

SPAN = "struct<start:int,end:int,reason:string>"
TOKEN = "struct<start:int,end:int,text:string,pos:string,tag:string,lemma:string,language:string>"
UNITS = f"ordinal long, unit_id string, text string, language string, role string, protected_spans array<{SPAN}>, metadata string, linguistic_tokens array<{TOKEN}>"
CHANGES = (
    "id string, unit_id string, source_start int, source_end int, output_start int, output_end int, source string, replacement string, "
    "stages array<string>, kind string, rule string, recognition_domain string, provenance string, language string"
)
#: The same of a unit's array of changes that have no output places yet.
CHANGE_FIELDS = (
    "array<struct<source_start:int,source_end:int,id:string,source:string,replacement:string,stages:array<string>,kind:string,rule:string,recognition_domain:string,provenance:string,language:string>>"
)
ISSUES = "code string, severity string, unit_id string, source_start int, source_end int, text string, message string, provenance string"


class SayframeError(Exception):
    """Any failure of this library."""


class PreparationError(SayframeError):
    """A preparation that cannot be carried out."""


class MappingError(PreparationError):
    """Edits that do not fit their text."""


class OverrideConflictError(PreparationError):
    """Overrides of equal priority that disagree about a place."""


class InvalidUnitError(PreparationError):
    """A unit, or an override for a unit, that breaks the data model."""


@dataclass(frozen=True)
class PreparationProfile:
    """Options of normalisation. Only those that this library's rules know have an effect; all enter the fingerprint."""

    use_spacy: bool = False
    symbol_mode: str = "none"
    normalize_unicode: bool = False
    normalize_whitespace: bool = False
    strip_outer_whitespace: bool = False
    collapse_horizontal_whitespace: bool = False
    normalize_line_whitespace: bool = False
    collapse_blank_lines: bool = False
    generic_acronym_mode: str = "known_only"
    sequence_fallback_mode: str = "preserve"
    expand_abbreviations: bool = True
    expand_structured: bool = True
    expand_numbers: bool = True

    def __post_init__(self) -> None:
        if self.sequence_fallback_mode not in ("preserve", "spell"):
            raise ValueError("sequence_fallback_mode is 'preserve' or 'spell'")
        if not self.symbol_mode or not isinstance(self.symbol_mode, str):
            raise ValueError("symbol_mode is a string that is not empty")


@dataclass(frozen=True)
class OverrideScope:
    """Where an override holds: all units, one unit, or one occurrence in a unit."""

    kind: str = "all"
    unit_id: str | None = None
    source_start: int | None = None
    source_end: int | None = None

    def __post_init__(self) -> None:
        has = (self.unit_id is not None, self.source_start is not None, self.source_end is not None)
        wanted = {"all": (False, False, False), "unit": (True, False, False), "occurrence": (True, True, True)}
        if self.kind not in wanted:
            raise ValueError(f"unknown scope {self.kind!r}")
        if has != wanted[self.kind]:
            raise ValueError(f"a scope of kind {self.kind!r} has other fields")
        if self.kind == "occurrence" and not 0 <= self.source_start < self.source_end:
            raise ValueError("an occurrence has 0 <= source_start < source_end")

    @property
    def priority(self) -> int:
        return {"all": 1, "unit": 2, "occurrence": 3}[self.kind]


@dataclass(frozen=True)
class SpeechOverride:
    """What is spoken for a surface. An empty `spoken` deletes it."""

    surface: str
    spoken: str
    match: str = "word"
    case_sensitive: bool = True
    scope: OverrideScope = OverrideScope()
    id: str | None = None
    provenance: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.surface:
            raise ValueError("an override's surface is not empty")
        if self.match not in ("literal", "word"):
            raise ValueError("match is 'literal' or 'word'")
        if self.id is None:
            from .functions.identity import override_id

            object.__setattr__(self, "id", override_id(self))

    @property
    def pattern(self) -> str:
        """A Java pattern of the surface; words are bounded by what is no word character, apostrophe or hyphen. Without
        regard to case it is one for texts in simple case folding."""
        from .functions.text import WORD_CLASS
        from .functions.unicode import simple_fold

        escaped = re.sub(r"([^\w\s])", r"\\\1", self.surface if self.case_sensitive else simple_fold(self.surface))
        return f"(?<![{WORD_CLASS}'\\-])(?:{escaped})(?![{WORD_CLASS}'\\-])" if self.match == "word" else f"(?:{escaped})"
