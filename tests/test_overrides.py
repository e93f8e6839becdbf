"""Overrides: the index and single patterns against plain Python, frames as policies, and their checks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sayframe.functions.identity import override_fingerprint
from sayframe.model import OverrideScope, SpeechOverride
from sayframe.operators import overrides
from sayframe.plans.prepare import prepare_text
from sayframe.queries import QUERIES
from tests.test_prepare import make, spoken

TEXTS = ["The art of ART's C++ (a.b) a-b a_b x", "ſtop STOP stop Straße STRASSE İi ıI Kk K", "aaaa aa a a a ba a a", "", "ΣΑΣ σας Σασ x﷑", "𐐀𐐨 x 𐐨", "tion on nation a.b", "line\nbreak the THE The"]


def plain(texts, policy):
    """(unit, ord, start, end, priority) of all matches."""
    found = set()
    for i, t in enumerate(texts):
        for k, o in enumerate(policy):
            body = re.escape(o.surface)
            pattern = re.compile(rf"(?<![\w'-]){body}(?![\w'-])" if o.match == "word" else body, 0 if o.case_sensitive else re.I)
            if o.scope.kind == "occurrence" and o.scope.unit_id == f"u{i}":
                found.add((f"u{i}", k, o.scope.source_start, o.scope.source_end, 3))
            elif o.scope.kind == "all" or o.scope.kind == "unit" and o.scope.unit_id == f"u{i}":
                found |= {(f"u{i}", k, m.start(), m.end(), o.scope.priority) for m in pattern.finditer(t)}
    return found


def policies():
    r, out = random.Random(4), []
    for t in TEXTS:
        for _ in range(14):
            if t:
                a = r.randrange(len(t))
                b = min(len(t), a + r.choice([1, 1, 2, 3, 4, 5]))
                scope = r.choice([OverrideScope(), OverrideScope(), OverrideScope("unit", f"u{r.randrange(8)}"), OverrideScope("unit", "nobody")])
                out.append(SpeechOverride(r.choice([str, str.upper, str.lower])(t[a:b]), r.choice("xyz"), r.choice(["word", "literal"]), r.random() < 0.5, scope))
    out += [SpeechOverride(w, w.upper(), "word", cs) for w in ("the", "art", "straße", "σας", "k", "i", "a_b", "ART's", "a a") for cs in (True, False)]
    out += [SpeechOverride("nation", "n", scope=OverrideScope("occurrence", "u6", 8, 14)), SpeechOverride("tio", "t", "literal", scope=OverrideScope("occurrence", "u6", 0, 3)), SpeechOverride("x", "t", scope=OverrideScope("occurrence", "gone", 0, 3))]
    return out


@pytest.mark.parametrize("index_from", [0, 10_000])
def test_candidates_are_those_of_patterns(spark, index_from, monkeypatch):
    monkeypatch.setattr(overrides, "INDEX_FROM", index_from)
    policy = policies() if index_from == 0 else policies()[::6]
    rows = overrides.match_overrides(make(spark, *TEXTS), policy).select("unit_id", F.explode("candidates").alias("c")).select("unit_id", "c.*").collect()
    assert {(r["unit_id"], r["ord"], r["start"], r["end"], r["priority"]) for r in rows} == plain(TEXTS, policy)
    assert len(rows) == len(plain(TEXTS, policy)) and all((r["id"], r["spoken"], r["size"]) == (policy[r["ord"]].id, policy[r["ord"]].spoken, r["start"] - r["end"]) for r in rows)


def test_frames_are_policies(spark, monkeypatch):
    policy = [SpeechOverride("ART", "all"), SpeechOverride("a.b", "dot", "literal", False), SpeechOverride("x", "", scope=OverrideScope("unit", "u0"))]
    frame = overrides.policy_frame(spark, policy)
    bare = overrides.require_policy(frame.withColumns({"id": F.lit(None).cast("string"), "note": F.lit(None).cast("string")}))
    assert overrides.policy_frame(spark, bare).orderBy("ord").collect() == frame.orderBy("ord").collect()
    assert overrides.policy_fingerprint(bare) == override_fingerprint(policy)
    units = make(spark, "ART A.B x", "x art ART", "")
    by_frame, by_list = prepare_text(units, bare), prepare_text(units, policy)
    assert spoken(by_frame.units) == spoken(by_list.units) == ["all dot ", "x art all", ""]
    assert sorted(by_frame.changes.collect()) == sorted(by_list.changes.collect()) and by_frame.override_fingerprint == by_list.override_fingerprint
    monkeypatch.setattr(overrides, "INDEX_FROM", 0)
    wrong = [SpeechOverride("XYZ", "a", scope=OverrideScope("occurrence", "u0", 0, 3))]
    with pytest.raises(Exception, match="exactly match"):
        prepare_text(units, wrong).units.collect()
    broken = frame.withColumns({"surface": F.lit(""), "match": F.lit("part"), "ord": F.lit(1)})
    assert {(r["ord"], r["problem"]) for r in overrides.policy_problems(broken).collect()} == {(1, "a surface is empty"), (1, "match is neither literal nor word"), (1, "two overrides have one place in the policy")}
    with pytest.raises(ValueError, match="override 1"):
        overrides.require_policy(broken)


def test_plan_does_not_grow(spark):
    units = make(spark, "x")
    size = lambda n: len(overrides.match_overrides(units, overrides.policy_frame(spark, [SpeechOverride(f"w{i} q", "y") for i in range(n)]))._jdf.queryExecution().analyzed().treeString().splitlines())
    assert size(30) == size(300)


def test_rows_across_pieces(spark, monkeypatch):
    """Surfaces at the borders of the pieces in which grams are sought, held and joined by sorting."""
    r = random.Random(7)
    texts = ["".join(r.choice("aab AB'x") for _ in range(n)) for n in (1, 127, 128, 129, 300, 700)] + ["x" * 126 + "a b c " * 60, ("ab " * 20 + "\U00010400") * 9]
    cuts = [t[a:a + n] for t in texts[3:] for n in (1, 2, 3, 4, 9, 29, 30, 31, 32, 40) for a in (125, 60)]
    policy = [SpeechOverride(s, "y", r.choice(["word", "literal"]), r.random() < 0.5) for s in cuts if s]
    units, expected = make(spark, *texts), plain(texts, policy)
    for held in (20_000, 0):
        monkeypatch.setattr(overrides, "HELD", held)
        rows = overrides.match_rows(units, policy).select("unit_id", "ord", "start", "end", "priority").collect()
        assert {tuple(x) for x in rows} == expected and len(rows) == len(expected)


def test_matches_of_a_held_policy_are_not_moved(spark):
    plan = lambda *policy: overrides.match_rows(make(spark, "x the art"), policy)._jdf.queryExecution().executedPlan().toString()
    words = plan(SpeechOverride("the", "y"), SpeechOverride("Art", "y", case_sensitive=False))
    assert "BroadcastHashJoin" in words and "Exchange hashpartitioning" not in words
    assert "hashpartitioning(unit_id" not in plan(SpeechOverride("art", "y", "literal"), SpeechOverride("a b", "y", "literal", False))


def test_literals_lie_where_a_search_finds_them(spark):
    texts = ["ththe tH th", "", "a.b.a.b.\na.b", "\U0001f600th\U00010400th", "x" * 700 + "th" + "th y" * 300, "﷐th﷐", None]
    units = make(spark, *texts)
    for o in (SpeechOverride("th", "x", "literal"), SpeechOverride("a.b", "x", "literal"), SpeechOverride("TH", "x", "literal", case_sensitive=False)):
        found = {r["ordinal"]: [(c["start"], c["end"]) for c in r["candidates"] or []] for r in overrides.match_overrides(units, [o]).collect()}
        want = lambda t: [m.span() for m in re.finditer(re.escape(o.surface), t or "", 0 if o.case_sensitive else re.I)]
        assert found == {i: want(t) for i, t in enumerate(texts)}


def test_resolution_takes_candidates_one_by_one(spark):
    """Against a plain loop over all candidates in their order, with and without protected places."""
    rng, texts, guards = random.Random(5), [], {}
    for i in range(60):
        texts.append("".join(rng.choice("abc ") for _ in range(rng.choice((0, 3, 30, 200)))))
        if i % 3 == 0 and len(texts[-1]) > 4:
            guards[i] = [(2, 4, None)]
    policy = [SpeechOverride(s, w, "literal") for s, w in (("abc", "1"), ("ab", "1"), ("bca", "2"), ("c", "1"), ("a b", "3"))]
    matched = overrides.match_overrides(make(spark, *texts, spans=guards), policy)
    candidates = {r["ordinal"]: r["candidates"] for r in matched.collect()}
    for r in overrides.resolve_overrides(matched).collect():
        selected, issues, conflicts = [], [], 0
        for c in sorted(candidates[r["ordinal"]]):
            meets = lambda s: s[0] < c["end"] and c["start"] < s[1]
            held = [s for s in selected if meets((s["start"], s["end"]))]
            if any(map(meets, guards.get(r["ordinal"], []))):
                issues.append(("override.protected_overlap", c["start"], c["end"], None))
            elif held and all(s["priority"] != c["priority"] or s["spoken"] == c["spoken"] for s in held):
                issues.append(("override.lower_priority_overlap", c["start"], c["end"], sorted(s["id"] for s in held)))
            elif held:
                conflicts += 1
            else:
                selected.append(c)
        assert r["selected"] == sorted(selected, key=lambda c: c["start"])
        assert [(i["code"], i["start"], i["end"], i["blocking"] and sorted(i["blocking"])) for i in r["override_issues"]] == issues
        assert (r["override_conflict"] is not None) == (conflicts > 0)


def test_texts_are_matched_once(spark, tmp_path):
    """A filter of units without selected overrides would match and resolve each text a second time."""
    spark.createDataFrame([(1, "the other", "en", "web"), (2, "x", "en", "web"), (3, None, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("override_literal", "override_resolution", "override_word"):
        rows = QUERIES[name](spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "transform(" in x]
        assert {r["unit_id"] for r in rows.collect()} <= {"1"}
    assert [(r["source_start"], r["source_end"]) for r in QUERIES["override_literal"](spark, str(tmp_path)).orderBy("source_start").collect()] == [(0, 2), (5, 7)]
