"""Pronunciation overrides: candidates by scope, and their greedy resolution within each unit.

A policy is a sequence of overrides or a frame with the columns of POLICY, one row each. A short sequence is matched by a
pattern each; any longer one and any frame by an index, so that plans do not grow with the policy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identity import canonical_json, json_column, override_fingerprint as _fingerprint
from ..functions.text import WORD_CLASS, cut, cutting, let, matches, running, running_sums, spans, unmarked
from ..functions.unicode import simple_fold_column
from ..model import ORIGIN, InvalidUnitError, OverrideConflictError, SpeechOverride

#: ord is the place in the policy, from 0. Where id or note (provenance as canonical JSON) are null they are derived.
POLICY = "ord int, id string, surface string, spoken string, match string, case_sensitive boolean, kind string, unit_id string, source_start int, source_end int, note string"
#: Overrides of a sequence from which on it is indexed.
INDEX_FROM = 24
#: Characters of a gram, by which surfaces are found in texts.
GRAM = 3
#: Rows up to which a policy is held by the driver and sent to all tasks; a larger one is joined by sorting.
HELD = 20_000
#: Characters of a piece of text whose grams are sought together, and of what they bring from both sides of it.
PIECE, MARGIN = 128, 32

_CANDIDATE = "array<struct<rank:int,size:int,ord:int,start:int,end:int,priority:int,id:string,spoken:string>>"
_FIELDS = ("rank", "size", "ord", "start", "end", "priority", "id", "spoken")
_ISSUE = "array<struct<code:string,start:int,end:int,id:string,blocking:array<string>>>"
_RANKED_ISSUE = f"array<struct<by:{_CANDIDATE[6:-1]},issue:{_ISSUE[6:-1]}>>"
_RANKED_ERROR = f"array<struct<by:{_CANDIDATE[6:-1]},message:string>>"
WORD_RUN = f"[{WORD_CLASS}'\\-]+"
_EDGES = f"(?<![{WORD_CLASS}'\\-])(?:", f")(?![{WORD_CLASS}'\\-])"

Policy = Sequence[SpeechOverride] | DataFrame


def policy_frame(spark: SparkSession, overrides: Policy) -> DataFrame:
    """The policy as rows of POLICY with ids and notes."""
    if isinstance(overrides, DataFrame):
        scope = F.struct("kind", "source_end", "source_start", "unit_id")
        derived = F.concat(F.lit("ovr:v1:"), F.substring(F.sha2(json_column(surface=F.col("surface"), spoken=F.col("spoken"), match=F.col("match"), case_sensitive=F.col("case_sensitive"), scope=scope), 256), 1, 20))
        named = overrides.withColumn("id", F.coalesce("id", derived))
        return named.withColumn("note", F.coalesce("note", json_column(origin=F.lit(f"{ORIGIN}.override"), override_id=F.col("id")))).select(*[c.split()[0] for c in POLICY.split(", ")])
    rows = [(i, o.id, o.surface, o.spoken, o.match, o.case_sensitive, o.scope.kind, o.scope.unit_id, o.scope.source_start, o.scope.source_end, canonical_json({"origin": f"{ORIGIN}.override", "override_id": o.id, **o.provenance})) for i, o in enumerate(overrides)]
    return spark.createDataFrame(rows, POLICY)


def policy_problems(policy: DataFrame) -> DataFrame:
    """(ord, problem) for each broken rule of a policy's rows, by the rules of SpeechOverride and OverrideScope."""
    has = lambda *names: [F.col(n).isNotNull() if on else F.col(n).isNull() for n, on in zip(("unit_id", "source_start", "source_end"), names)]
    every = lambda conditions: conditions[0] & conditions[1] & conditions[2]
    kind = F.col("kind")
    fields = F.when(kind == "all", every(has(0, 0, 0))).when(kind == "unit", every(has(1, 0, 0))).when(kind == "occurrence", every(has(1, 1, 1)))
    checks = [
        ("the place in the policy is null", F.col("ord").isNotNull()), ("a surface is empty", F.col("surface") != ""), ("spoken is null", F.col("spoken").isNotNull()), ("match is neither literal nor word", F.col("match").isin("literal", "word")),
        ("case_sensitive is null", F.col("case_sensitive").isNotNull()), ("a scope has other fields", fields), ("an occurrence has no 0 <= source_start < source_end", (kind != "occurrence") | ((F.col("source_start") >= 0) & (F.col("source_start") < F.col("source_end")))),
    ]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(said)) for said, good in checks]))
    twice = policy.groupBy("ord").agg(F.count("*").alias("n")).where("n > 1").select("ord", F.lit("two overrides have one place in the policy").alias("problem"))
    return policy.select("ord", F.explode(broken).alias("problem")).unionAll(twice)


def require_policy(policy: DataFrame) -> DataFrame:
    """The policy, or ValueError with its first problem."""
    if bad := policy_problems(policy).orderBy("ord", "problem").limit(1).collect():
        raise ValueError(f"override {bad[0]['ord']}: {bad[0]['problem']}")
    return policy


def policy_fingerprint(overrides: Policy) -> str:
    """Of a policy in its order, the same for a sequence and a frame; ids and notes do not count. The driver holds one
    partition of a frame at a time."""
    if not isinstance(overrides, DataFrame):
        return _fingerprint(overrides)
    scope = F.struct("kind", "source_end", "source_start", "unit_id")
    rows = overrides.select("ord", json_column(surface=F.col("surface"), spoken=F.col("spoken"), match=F.col("match"), case_sensitive=F.col("case_sensitive"), scope=scope).alias("j")).sort("ord").select("j")
    digest = hashlib.sha256(b"[")
    for i, row in enumerate(rows.toLocalIterator()):
        digest.update((b"," if i else b"") + row["j"].encode())
    digest.update(b"]")
    return digest.hexdigest()


def _struct(o: SpeechOverride, order: int, start: Column, end: Column) -> Column:
    p = o.scope.priority
    return F.struct(F.lit(-p).alias("rank"), (start - end).cast("int").alias("size"), F.lit(order).alias("ord"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(p).alias("priority"), F.lit(o.id).alias("id"), F.lit(o.spoken).alias("spoken"))


def _found(o: SpeechOverride, order: int, hay: Column) -> Column:
    """Candidates of an override in a text. The parts between a literal's places give these, so only its words' are marked."""
    if o.match == "word":
        return F.transform(spans(hay, o.pattern), lambda s: _struct(o, order, s["start"], s["end"]))
    size = len(o.surface)

    def behind(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda p: F.length(p) + size))
        return F.transform(F.slice(ends, F.lit(2), F.size(parts) - 1), lambda e: _struct(o, order, e - size, e))

    return let(F.split(unmarked(hay), o.pattern), behind)


def match_overrides(units: DataFrame, overrides: Policy) -> DataFrame:
    """`units` with `candidates`: all matches of the overrides in their scope, sorted by priority, length, order and place.

    Matches of an override do not overlap each other, from left to right. Words are bounded by what is neither a word character
    nor an apostrophe or hyphen. Without regard to case, characters are alike if simple case folding makes them so.
    Occurrences whose text is not the surface raise InvalidUnitError's message.
    """
    if isinstance(overrides, DataFrame) or len(overrides) >= INDEX_FROM:
        return _match_indexed(units, overrides)
    text, parts = F.col("text"), []
    hay = lambda o: text if o.case_sensitive else simple_fold_column(text)
    for i, o in enumerate(overrides):
        here = F.lit(True) if o.scope.kind == "all" else F.col("unit_id") == o.scope.unit_id
        if o.scope.kind == "occurrence":
            a, b = o.scope.source_start, o.scope.source_end
            exact = cut(text, F.lit(a), F.lit(b)) == o.surface
            if o.match == "word":
                exact = exact & F.array_contains(spans(hay(o), o.pattern), F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))
            fits = F.when(F.coalesce(exact, F.lit(False)), F.array(_struct(o, i, F.lit(a), F.lit(b)))).otherwise(F.raise_error(F.lit(f"{InvalidUnitError.__name__}: override {o.id} does not exactly match its occurrence")).cast(_CANDIDATE))
        else:
            fits = _found(o, i, hay(o))
        parts.append(F.when(here, fits.cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE)))
    # Those of one override are in their order as they are found.
    return units.withColumn("candidates", parts[0] if len(parts) == 1 else F.sort_array(F.concat(F.array().cast(_CANDIDATE), *parts)))


def _grams(text: Column) -> Column:
    """At each place of a text the up to GRAM characters from there on."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))."))


def _with_gram(policy: DataFrame) -> DataFrame:
    """Policy rows (ord, key) with the gram by which they are sought, and its place in the key: of a key's grams of full
    length (or the key, if that is shorter) the one that fewest keys of the policy have."""
    size = F.least(F.length("key"), F.lit(GRAM))
    grams = policy.select("ord", size.alias("size"), F.posexplode(_grams(F.col("key"))).alias("at", "gram")).where(F.length("gram") == F.col("size")).groupBy("ord", "gram").agg(F.min("at").alias("at"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return policy.join(grams.join(counts, "gram").groupBy("ord").agg(F.min_by(F.struct("gram", "at"), F.struct("n", "gram")).alias("g")), "ord").select("*", "g.*").drop("g")


def _held(rows: DataFrame) -> tuple[DataFrame, list | None]:
    """A policy's rows, and, if they are HELD or fewer, what they are; these are then computed once."""
    few = None if rows.isStreaming else rows.limit(HELD + 1).collect()
    if few is None or len(few) > HELD:
        return rows, None
    return rows.sparkSession.createDataFrame(few, rows.schema), few


def _windows(text: Column) -> Column:
    """array<struct<base,piece,lead,window>>: the text in pieces, the place of each, and it between up to MARGIN
    characters of the pieces beside it, of which `lead` lie before."""

    def sides(pieces: Column) -> Column:
        side = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))

        def window(x: Column, i: Column) -> Column:
            before, after = F.right(side(i - 1), F.lit(MARGIN)), F.left(side(i + 1), F.lit(MARGIN))
            return F.struct((i * PIECE).alias("base"), F.concat(x, F.left(after, F.lit(GRAM - 1))).alias("piece"), F.length(before).alias("lead"), F.concat(before, x, after).alias("window"))

        return F.transform(pieces, window)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), sides)


def match_rows(units: DataFrame, overrides: Policy) -> DataFrame:
    """All matches of match_overrides as rows in no order: unit_id and a candidate's fields.

    Words of the texts are joined with word surfaces, grams of the texts with each other surface's rarest gram, and units
    with the overrides for them. A gram brings the characters around it, which prove its surface in the same row, so a
    policy of up to HELD rows, which is sent to all tasks, moves neither texts nor matches. Only surfaces that can overlap
    themselves, whose matches depend on those before, meet by unit (their places), and so do those of over MARGIN - 2
    characters, which are sought by their patterns.
    """
    policy = policy_frame(units.sparkSession, overrides)
    fold = simple_fold_column(F.col("surface"))
    escaped = lambda c: F.regexp_replace(c, r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")
    key = F.when(F.col("case_sensitive"), F.col("surface")).otherwise(fold)
    pattern = F.when(F.col("match") == "word", F.concat(F.lit(_EDGES[0]), escaped(key), F.lit(_EDGES[1]))).otherwise(escaped(key))
    priority = F.when(F.col("kind") == "all", 1).when(F.col("kind") == "unit", 2).otherwise(3)
    rule = F.struct("ord", "id", "spoken", "surface", "match", "case_sensitive", priority.alias("priority"), pattern.alias("pattern"), "source_start", "source_end")
    border = F.exists(F.sequence(F.lit(0), F.length(fold) - 1), lambda k: (k > 0) & (F.left(fold, k) == F.right(fold, k)))
    rows, few = _held(policy.select("ord", "unit_id", "kind", "case_sensitive", "match", ((F.col("match") == "word") & F.col("surface").rlike(f"^{WORD_RUN}$")).alias("run"), border.alias("border"), fold.alias("key"), key.alias("exact"), F.length("surface").alias("length"), rule.alias("rule")))
    small = (lambda df: df) if few is None else F.broadcast
    some = lambda test: few is None or any(map(test, few))

    def struct(r: Column, start: Column, end: Column) -> Column:
        return F.struct((-r["priority"]).alias("rank"), (start - end).alias("size"), r["ord"].alias("ord"), start.alias("start"), end.alias("end"), r["priority"].alias("priority"), r["id"].alias("id"), r["spoken"].alias("spoken")).cast(_CANDIDATE[6:-1])

    found = units.select("unit_id", F.explode(F.array().cast(_CANDIDATE)).alias("c"))
    # Whole words: places are proven but for case.
    if some(lambda r: r["kind"] == "all" and r["run"]):
        words = units.select("unit_id", F.explode(matches("text", WORD_RUN)).alias("s")).select("unit_id", "s", F.col("s.surface").alias("said"), simple_fold_column(F.col("s.surface")).alias("key"))
        met = words.join(small(rows.where("kind = 'all' AND run").select("key", "exact", "case_sensitive", "rule")), "key").where("NOT case_sensitive OR said = exact")
        found = found.unionAll(met.select("unit_id", struct(F.col("rule"), F.col("s.start"), F.col("s.end")).alias("c")))
    # Anything else for all units, by its gram; a gram that is all of a surface without regard to case proves it.
    whole = []
    if some(lambda r: r["kind"] == "all" and not r["run"]):
        keyed = small(_with_gram(rows.where("kind = 'all' AND NOT run").select("ord", "key", "exact", "length", "border", "case_sensitive", "match", "rule")).drop("key"))
        sizes = range(1, GRAM + 1) if few is None else sorted({min(r["length"], GRAM) for r in few if r["kind"] == "all" and not r["run"]})
        grams = units.select("unit_id", F.inline(_windows(unmarked(F.col("text"))))).select("unit_id", "base", "lead", "window", F.posexplode(_grams(simple_fold_column(F.col("piece")))).alias("pos", "long")).where(F.col("pos") < PIECE)
        one = lambda k: F.substring("long", 1, k)
        gram = one(sizes[0]) if len(sizes) == 1 else F.explode(F.array_distinct(F.array(*map(one, sizes))))
        met = grams.select("unit_id", "base", "lead", "window", "pos", gram.alias("gram")).join(keyed, "gram")
        start, at = F.col("base") + F.col("pos") - F.col("at"), F.col("lead") + F.col("pos") - F.col("at")
        end = at + F.col("length")
        said = lambda a, b: let(cut(F.col("window"), a, b), lambda w: F.when(F.col("case_sensitive"), w).otherwise(simple_fold_column(w)))
        beside = lambda a: F.coalesce(said(a, a + 1).rlike(f"^{WORD_RUN}$"), F.lit(False))
        bounded = (F.col("match") == "literal") | ~(((at > 0) & beside(at - 1)) | beside(end))
        proven = (~F.col("case_sensitive") & (F.col("length") <= GRAM) & (F.col("match") == "literal")) | ((said(at, end) == F.col("exact")) & bounded)
        near = F.col("length") <= MARGIN - 2
        places = met.where(near & (start >= 0) & proven)
        free = places.where("NOT border").select("unit_id", struct(F.col("rule"), start, start + F.col("length")).alias("c"))
        found = found.unionAll(free)
        if some(lambda r: r["kind"] == "all" and not r["run"] and r["border"]):
            # Of proven places of a surface that can overlap itself, each from left to right that is free of the one before.
            own = places.where("border").select("unit_id", "ord", start.alias("start")).groupBy("unit_id", "ord").agg(F.sort_array(F.collect_list("start")).alias("starts")).join(small(rows.select("ord", "length", "rule")), "ord")
            ends = running(F.col("starts"), 0, lambda free_from, x: F.when(x >= free_from, x + F.col("length")).otherwise(free_from))
            kept = let(ends, lambda e: F.filter("starts", lambda x, i: x >= F.get(e, i)))
            place = F.col("place")
            found = found.unionAll(own.select("unit_id", "rule", "length", F.explode(kept).alias("place")).select("unit_id", struct(F.col("rule"), place, place + F.col("length")).alias("c")))
        if some(lambda r: r["kind"] == "all" and not r["run"] and r["length"] > MARGIN - 2):
            reach = F.least(F.col("length") - F.col("at"), F.lit(MARGIN - 2))
            begun = said(F.col("lead") + F.col("pos"), F.col("lead") + F.col("pos") + reach) == cut(F.col("exact"), F.col("at"), F.col("at") + reach)
            whole.append(met.where(~near & begun).select("unit_id", "rule").distinct().groupBy("unit_id").agg(F.collect_list("rule").alias("rules")))
    # For a unit or an occurrence.
    if some(lambda r: r["kind"] != "all"):
        whole.append(small(rows.where("kind <> 'all'").groupBy("unit_id").agg(F.collect_list("rule").alias("rules"))))
    text = F.col("text")

    def seek(hay: Column, r: Column) -> Column:
        places = spans(F.when(r["case_sensitive"], hay["text"]).otherwise(hay["folded"]), r["pattern"])
        here = F.struct(r["source_start"].alias("start"), r["source_end"].alias("end"))
        exact = (cut(text, here["start"], here["end"]) == r["surface"]) & ((r["match"] == "literal") | F.array_contains(places, here))
        wrong = F.raise_error(F.concat(F.lit(f"{InvalidUnitError.__name__}: override "), r["id"], F.lit(" does not exactly match its occurrence"))).cast(_CANDIDATE)
        placed = F.transform(places, lambda s: struct(r, s["start"], s["end"]))
        return F.when(r["priority"] < 3, placed).when(F.coalesce(exact, F.lit(False)), F.array(struct(r, here["start"], here["end"]))).otherwise(wrong)

    hay = let(unmarked(text), lambda t: F.struct(t.alias("text"), simple_fold_column(t).alias("folded")))
    for sought in whole:
        all_of = let(hay, lambda h: F.flatten(F.transform("rules", lambda r: seek(h, r))))
        found = found.unionAll(units.select("unit_id", "text").join(sought, "unit_id").select("unit_id", F.explode(all_of).alias("c")))
    return found.select("unit_id", "c.*")


def _match_indexed(units: DataFrame, policy: Policy) -> DataFrame:
    """The rows of match_rows, put together for each unit."""
    by_unit = match_rows(units, policy).groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct(*_FIELDS))).alias("candidates"))
    return units.join(by_unit, "unit_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(_CANDIDATE)))


def resolve_overrides(matched: DataFrame) -> DataFrame:
    """`matched` with `selected` (sorted by place), `override_issues` and `override_conflict` (a message, or null).

    Candidates fall into clusters of places that overlap in turn; each cluster takes its candidates in their order: a
    protected place is skipped first, then a place that a selected one holds. Equal priorities with different
    replacements there are a conflict; a skipped candidate blocks nothing.
    """
    nothing = (F.array().cast(_RANKED_ISSUE).alias("iss"), F.array().cast(_RANKED_ERROR).alias("err"))
    start = F.struct(F.array().cast(_CANDIDATE).alias("sel"), *nothing)
    blocked = F.col("protected_spans")

    def meets(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def guarded(c: Column) -> Column:
        return F.coalesce(F.exists(blocked, lambda p: meets(p, c)), F.lit(False))

    def issue(code: str, c: Column, blocking: Column) -> Column:
        found = F.struct(F.lit(code).alias("code"), c["start"].alias("start"), c["end"].alias("end"), c["id"].alias("id"), blocking.alias("blocking"))
        return F.array(F.struct(c.alias("by"), found.alias("issue"))).cast(_RANKED_ISSUE)

    def step(acc: Column, c: Column) -> Column:
        protected = guarded(c)
        holders = F.filter(acc["sel"], lambda s: meets(s, c))
        clash = F.get(F.filter(holders, lambda s: (s["priority"] == c["priority"]) & (s["spoken"] != c["spoken"])), F.lit(0))
        taken = F.size(holders) > 0
        message = F.concat(F.lit("overrides "), clash["id"], F.lit(" and "), c["id"], F.lit(" overlap at "), c["start"].cast("string"), F.lit(":"), c["end"].cast("string"), F.lit(" with different replacements"))
        return F.struct(
            F.when(protected | taken, acc["sel"]).otherwise(F.concat(acc["sel"], F.array(c))).alias("sel"),
            F.when(protected, F.concat(acc["iss"], issue("override.protected_overlap", c, F.lit(None).cast("array<string>"))))
            .when(taken & clash.isNull(), F.concat(acc["iss"], issue("override.lower_priority_overlap", c, F.transform(holders, lambda s: s["id"]))))
            .otherwise(acc["iss"]).alias("iss"),
            F.when(~protected & clash.isNotNull(), F.concat(acc["err"], F.array(F.struct(c.alias("by"), message.alias("message"))).cast(_RANKED_ERROR))).otherwise(acc["err"]).alias("err"),
        )

    def heads(placed: Column) -> Column:
        """Of candidates by place: whether each begins a run of those that overlap in turn."""
        reach = running(F.transform(placed, lambda x: x["end"]), 0, lambda a, e: F.greatest(a, e))
        return let(reach, lambda r: F.transform(placed, lambda x, i: x["start"] >= F.get(r, i)))

    def clusters(placed: Column) -> Column:
        """The runs, each in the candidates' own order."""
        firsts = let(heads(placed), lambda h: F.filter(F.transform(h, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
        run = lambda h: F.transform(h, lambda i, k: F.sort_array(F.transform(F.slice(placed, i + 1, F.coalesce(F.get(h, k + 1), F.size(placed)) - i), lambda x: x["c"])))
        return let(firsts, run)

    by_place = lambda c: F.sort_array(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("c"))))
    # Only runs of several and what is protected are folded; a candidate that overlaps no other is selected. The parts are
    # columns, as a value that passes through a function is copied whole.
    unguarded = F.coalesce(F.size(blocked), F.lit(0)) <= 0
    given, placed, alone, runs = map(F.col, ("candidates", "_placed", "_alone", "_runs"))
    meet = let(given, lambda c: F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i)["start"] < F.get(c, i - 1)["end"]))
    in_order = unguarded & F.when(F.size(given) > 1, ~meet).otherwise(True)
    lone = let(heads(placed), lambda h: F.transform(placed, lambda x, i: F.get(h, i) & F.coalesce(F.get(h, i + 1), F.lit(True)) & (unguarded | ~guarded(x))))
    # Flags are bound, as the plan may put a column's own expression where the column is read: here, for each candidate.
    fold = let(let(alone, lambda a: F.filter(placed, lambda x, i: ~F.get(a, i))), lambda rest: F.transform(clusters(rest), lambda c: F.aggregate(c, start, step)))
    all_of = lambda name: F.flatten(F.transform(runs, lambda f: f[name]))
    chosen = F.transform(F.sort_array(F.concat(let(alone, lambda a: F.filter(placed, lambda x, i: F.get(a, i))), by_place(all_of("sel")))), lambda s: s["c"])
    done = matched.withColumn("_placed", F.when(~in_order, by_place(given))).withColumn("_alone", lone)
    done = done.withColumn("_runs", F.when(placed.isNotNull(), fold).when(given.isNotNull(), F.array().cast(f"array<struct<sel:{_CANDIDATE},iss:{_RANKED_ISSUE},err:{_RANKED_ERROR}>>")))
    issues = F.transform(F.sort_array(all_of("iss")), lambda x: x["issue"])
    first_error = F.get(F.sort_array(all_of("err")), F.lit(0))["message"]
    return done.withColumns({"selected": F.when(placed.isNull(), given).otherwise(chosen), "override_issues": issues, "override_conflict": first_error}).drop("_placed", "_alone", "_runs", "candidates")


def selected_rows(resolved: DataFrame) -> DataFrame:
    """The selected overrides as rows: unit_id and a candidate's fields. As an outer generator it is given no filter of
    units without any, which would match and resolve all texts a second time."""
    return resolved.select("unit_id", F.inline_outer("selected")).where("ord IS NOT NULL")


def require_no_conflict(resolved: DataFrame) -> DataFrame:
    """Raises OverrideConflictError's message at the action where a unit has a conflict."""
    fail = F.raise_error(F.concat(F.lit(f"{OverrideConflictError.__name__}: "), F.col("override_conflict"))).cast(resolved.schema["selected"].dataType)
    return resolved.withColumn("selected", F.when(F.col("override_conflict").isNotNull(), fail).otherwise(F.col("selected")))


def override_issues(resolved: DataFrame) -> DataFrame:
    """Issues of the resolution as rows, in the order in which candidates were met."""
    said = cutting(F.col("text"), lambda piece: F.transform("override_issues", lambda i: i.withField("text", piece(i["start"], i["end"]))))
    rows = resolved.select("unit_id", "ordinal", F.posexplode(said).alias("pos", "i"))
    reason = F.when(F.col("i.code") == "override.protected_overlap", "the place is protected").otherwise("one of higher priority holds the place")
    provenance = F.when(F.col("i.blocking").isNull(), json_column(override_id=F.col("i.id"))).otherwise(json_column(override_id=F.col("i.id"), blocking_override_ids=F.col("i.blocking")))
    return rows.select(
        "unit_id", "ordinal", F.lit(-1).alias("pass"), "pos", F.lit(0).alias("code_rank"), F.col("i.code").alias("code"), F.lit("warning").alias("severity"), F.col("i.start").alias("source_start"), F.col("i.end").alias("source_end"),
        F.col("i.text").alias("text"), F.concat(F.lit("Override "), F.col("i.id"), F.lit(" was skipped, as "), reason, F.lit(".")).alias("message"), provenance.alias("provenance"),
    )


def override_changes(resolved: DataFrame, overrides: Policy) -> DataFrame:
    """The selected overrides as changes; an override's own provenance comes last, so it may replace our keys."""
    notes = policy_frame(resolved.sparkSession, overrides).select("ord", F.col("note").alias("provenance"))
    chosen = F.transform("selected", lambda c: c.withField("source", cut(F.col("text"), c["start"], c["end"])))
    rows = resolved.select("unit_id", F.explode(chosen).alias("c")).select("unit_id", "c.*").join(notes, "ord")
    return rows.select(
        "unit_id", F.col("start").alias("source_start"), F.col("end").alias("source_end"), "source", F.col("spoken").alias("replacement"),
        F.array(F.lit("override")).alias("stages"), F.lit("override").alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("recognition_domain"), "provenance", F.lit(None).cast("string").alias("language"),
    )
