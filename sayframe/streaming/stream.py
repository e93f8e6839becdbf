"""What can be done unit by unit works on streams; the rest works on each micro-batch as a closed set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import PreparationProfile, SpeechOverride
from ..operators import qa
from ..operators.lexical import tokens
from ..plans.prepare import PreparationResult, prepare_units


@dataclass(frozen=True)
class ProgressEvent:
    kind: str
    completed: int
    total: int
    unit_id: str
    language: str
    role: str


def check_stream(units: DataFrame, profile: PreparationProfile | None = None) -> DataFrame:
    """Issues of a stream of units, in append mode without state."""
    return qa.check_units(units, profile)


def term_counts(units: DataFrame) -> DataFrame:
    """Running counts of (language, normalized) of a stream, for complete or update mode."""
    return tokens(units).groupBy("language", "normalized").agg(F.count("*").alias("count"))


def prepare_batches(units: DataFrame, sink: Callable[[PreparationResult, int], None], checkpoint: str, overrides: Sequence[SpeechOverride] = (), profile: PreparationProfile | None = None) -> StreamingQuery:
    """Prepares each micro-batch as one set of units and hands the result to `sink` with the batch's number, once."""
    return units.writeStream.foreachBatch(lambda df, n: sink(prepare_units(df, overrides, profile), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_events(units: DataFrame) -> DataFrame:
    """A started and a completed event for each unit, numbered in the order of units: kind, completed, total, unit_id,
    language, role. Ordinals that are dense from 0 are asked for."""
    total = units.agg(F.count("*").alias("total"))
    kinds = F.explode(F.array(F.struct(F.lit("unit.started").alias("kind"), F.lit(0).alias("add")), F.struct(F.lit("unit.completed").alias("kind"), F.lit(1).alias("add"))))
    rows = units.select("ordinal", "unit_id", "language", "role", kinds.alias("e")).crossJoin(F.broadcast(total))  # one row
    return rows.select(F.col("e.kind").alias("kind"), (F.col("ordinal") + F.col("e.add")).alias("completed"), "total", "unit_id", "language", "role")


def observed(prepared: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The frame, and totals of units that pass through it, for whatever action follows."""
    o = Observation(name)
    return prepared.observe(o, F.count("*").alias("units"), F.count_if(F.col("text") != F.col("spoken_text")).alias("changed")), o


def notify(units: DataFrame, callback: Callable[[ProgressEvent], None], changes: DataFrame | None = None) -> None:
    """Calls back on the driver, in the units' order, when a unit's first pass starts and when it has ended; an error of
    the callback reaches the caller and ends the walk.

    The driver holds one partition of units' names at a time. With `changes` (of the first pass) a unit's events come
    once its changes are there.
    """
    names = units.select("ordinal", "unit_id", "language", "role")
    if changes is not None:
        names = names.join(changes.groupBy("unit_id").agg(F.count("*").alias("changes")), "unit_id", "left")
    total = units.count()
    for done, row in enumerate(names.sort("ordinal").toLocalIterator()):
        for kind, completed in (("unit.started", done), ("unit.completed", done + 1)):
            callback(ProgressEvent(kind, completed, total, row["unit_id"], row["language"], row["role"]))
