"""Sentences, the sentences of a change, and chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ABBREVIATION, HOLD, MARK, OTHER_MARK, SENTENCE_BREAK, SENTENCE_END, cut, cutting, exploded, let, overlaps

_SENTENCES = "array<struct<index:int,text:string,start:int,end:int>>"


def marked_sentences(text: Column, abbreviations: bool = True, chains: bool = True) -> Column:
    """The text with MARK between its sentences. Without chains, of known abbreviations in a row ("Prof. Dr. x") only every
    other one, from the first on, ends no sentence."""
    body = F.translate(text, MARK + HOLD, OTHER_MARK * 2)
    if abbreviations and not chains:
        held = F.regexp_replace(body, ABBREVIATION, f"$1{HOLD}$2")
        marked = F.replace(F.regexp_replace(held, SENTENCE_END, f"$1{MARK}"), F.lit(HOLD), F.lit(""))
    else:
        marked = F.regexp_replace(body, SENTENCE_BREAK if abbreviations else SENTENCE_END, f"$1{MARK}")
    return F.regexp_replace(marked, r"(\r?\n[\t ]*\r?\n)", f"{MARK}$1")


def sentence_spans(text: Column, abbreviations: bool = True, chains: bool = True) -> Column:
    """array<struct<index,text,start,end>>: a sentence ends behind . ! ? or an ellipsis and closing marks before white space
    (not after a known abbreviation, unless abbreviations is false; chains as in marked_sentences), or at an empty line. White space around it is left out. A text without any other
    character is one span as a whole; an empty one has none."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    space = r"^[\s\x{85}\p{Z}]+"

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part)
        left = size - F.length(F.regexp_replace(part, space, ""))
        right = F.length(F.regexp_replace(part, r"[\s\x{85}\p{Z}]+$", ""))
        found = F.array(F.struct((acc["at"] + left).alias("start"), (acc["at"] + right).alias("end")))
        return F.struct((acc["at"] + size).alias("at"), F.when(right > left, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.split(marked_sentences(text, abbreviations, chains), MARK), start, step, lambda acc: acc["out"])
    found = let(found, lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))))
    numbered = F.transform(found, lambda s, i: F.struct(i.alias("index"), cut(text, s["start"], s["end"]).alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.length(text) > 0, numbered.cast(_SENTENCES)).otherwise(F.array().cast(_SENTENCES))


def sentences(units: DataFrame, text: str = "text", abbreviations: bool = True) -> DataFrame:
    """Rows unit_id, ordinal, index, text, start, end."""
    return units.select("unit_id", "ordinal", F.inline(sentence_spans(F.col(text), abbreviations)))


def with_context(prepared: DataFrame) -> DataFrame:
    """`prepared` with source_sentences and spoken_sentences."""
    return prepared.withColumns({"source_sentences": sentence_spans(F.col("text")), "spoken_sentences": sentence_spans(F.col("spoken_text"))})


def change_contexts(prepared: DataFrame) -> DataFrame:
    """Each change with the sentences that it overlaps on both sides; for a deletion the sentence at its output place."""

    def chosen(all_of: Column, start: Column, end: Column) -> Column:
        span = F.struct(start.alias("start"), end.alias("end"))
        at = F.filter(all_of, lambda s: (s["start"] <= start) & (start <= s["end"]))
        return F.when(start < end, F.filter(all_of, lambda s: overlaps(s, span))).otherwise(F.slice(at, 1, 1))

    rows = with_context(prepared).select("unit_id", "ordinal", "source_sentences", "spoken_sentences", exploded("changes", name="c"))
    return rows.select(
        "unit_id", "ordinal", F.col("c.id").alias("change_id"), F.col("c.source_start").alias("source_start"), F.col("c.source_end").alias("source_end"),
        chosen(F.col("source_sentences"), F.col("c.source_start"), F.col("c.source_end")).alias("source_sentences"), chosen(F.col("spoken_sentences"), F.col("c.output_start"), F.col("c.output_end")).alias("spoken_sentences"),
    )


def context_for_change(prepared: DataFrame, change_id: str) -> DataFrame:
    """The context of one change; KeyError if there is none."""
    found = change_contexts(prepared.where(F.exists("changes", lambda c: c["id"] == change_id))).where(F.col("change_id") == change_id)
    if found.isEmpty():
        raise KeyError(change_id)
    return found


def split_prepared_text(units: DataFrame, max_chars: int, text: str = "spoken_text") -> DataFrame:
    """Chunks of at most max_chars characters: unit_id, ordinal, part, text, start, end.

    A chunk holds whole sentences with the white space behind them; together the chunks are the text. A sentence that is too
    long is cut at its last white space that fits, or else after max_chars characters. Empty texts have no chunks.
    """
    if max_chars < 1:
        raise ValueError("max_chars is 1 at least")
    # Sentences with their white space, then words with theirs where a sentence is too long, then plain cuts.
    body = F.translate(F.col(text), MARK, OTHER_MARK)
    marked = F.regexp_replace(F.regexp_replace(body, SENTENCE_BREAK + r"([\s\x{85}\p{Z}]*)", f"$1$2{MARK}"), r"(\r?\n[\t ]*\r?\n\s*)", f"$1{MARK}")
    words = lambda s: F.when(F.length(s) <= max_chars, F.array(s)).otherwise(F.split(F.regexp_replace(s, r"([\s\x{85}\p{Z}]+)", f"$1{MARK}"), MARK))
    cuts = lambda w: F.when(F.length(w) <= max_chars, F.array(F.length(w))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / max_chars).cast("int")), lambda i: F.least(F.lit(max_chars), F.length(w) - i * max_chars)))
    # (length, starts a sentence) of each indivisible part
    parts = F.flatten(F.transform(F.split(marked, MARK), lambda s: F.flatten(F.transform(words(s), cuts))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        end = acc["at"] + size
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        joins = (F.size(acc["out"]) > 0) & (end - last["start"] <= max_chars)
        new = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))
        grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(size == 0, acc["out"]).when(F.coalesce(joins, F.lit(False)), grown).otherwise(new).alias("out"))

    chunks = F.aggregate(parts, first, step, lambda acc: acc["out"])
    whole = cutting(F.col(text), lambda piece: F.transform(chunks, lambda s: F.struct(piece(s["start"], s["end"]).alias("text"), s["start"].alias("start"), s["end"].alias("end"))))
    rows = units.where(F.length(text) > 0).select("unit_id", "ordinal", F.posexplode(whole).alias("part", "s"))
    return rows.select("unit_id", "ordinal", "part", "s.text", "s.start", "s.end")
