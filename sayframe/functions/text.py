"""Spans, character classes and case folding, in code points and without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Characters of words. The literal letter beyond U+FFFF makes Java step back by whole characters in a lookbehind.
WORD_CLASS = r"\p{L}\p{N}_" + "\U00010400"
BEFORE, AFTER = f"(?<![{WORD_CLASS}])", f"(?![{WORD_CLASS}])"
SPACE_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
#: Noncharacters that mark the borders of matches; one in a text is read as the other.
MARK, OTHER_MARK = "\ufdd0", "\ufdd1"
#: Another noncharacter, for a place where no border may be.
HOLD = "\ufdd2"

TOKEN_PATTERN = r"[\p{L}\p{Nl}\p{No}]+(?:['\x{2019}\x{02BC}\x{2010}-\x{2014}][\p{L}\p{Nl}\p{No}]+)*\p{M}*"
LINK_PATTERN = (
    rf"(?i)(?:{BEFORE}(?:https?://|ftp://|www[.])[^<>{SPACE_CLASS}]+"
    rf"|{BEFORE}[{WORD_CLASS}.+-]+@[{WORD_CLASS}.-]+[.][a-z]{{2,}}{AFTER}"
    rf"|{BEFORE}(?:[a-z0-9-]+[.])+[a-z]{{2,}}{AFTER})"
)
SENTENCE_END = r"([.!?\x{2026}]+[\"'\x{201D}\x{2019})\]]*)(?=[\t-\r\x{1c}-\x{20}\x{85}\p{Z}])"
_ABBREVIATED = r"(?:^|[^\p{L}])(?:Dr|Mr|Mrs|Ms|St|Prof|No|vs|etc)"
#: The same, but not behind a known abbreviation.
SENTENCE_BREAK = rf"(?=[.!?\x{{2026}}])(?<!{_ABBREVIATED})" + SENTENCE_END
#: A known abbreviation before white space, which the match holds: of two in a row the second is none.
ABBREVIATION = rf"({_ABBREVIATED}[.!?\x{{2026}}])([\"'\x{{201D}}\x{{2019}})\]]*[{SPACE_CLASS}])"

_SPAN = "array<struct<start:int,end:int>>"
#: Values of which each is added up from the first on, and parts of which each is put behind those before it.
FEW = 17


def let(value: Column, body) -> Column:
    """body(value), where the value is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once for each row. Filters on a plain column, and those that Spark infers where it
    is exploded, are pushed down with a copy of its whole expression."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def exploded(values: str, at: str | None = None, name: str = "x") -> Column:
    """The elements of an array as rows (with their places as `at`), without the filter that Spark infers from a column's name."""
    some = F.when(F.size(values) > 0, F.col(values))
    return F.posexplode(some).alias(at, name) if at else F.explode(some).alias(name)


def running(values: Column, zero: int, add) -> Column:
    """What `add` has made of `zero` and all values before each one. Appending to an array copies it, so values are
    folded in stretches, and the work stays in proportion to their number."""
    size = 64
    start = F.array().cast("array<struct<at:int,out:array<int>>>")

    def stretch(whole: Column):
        def fold(done: Column, k: Column) -> Column:
            before = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(zero))
            first = F.struct(before.alias("at"), F.array().cast("array<int>").alias("out"))
            step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
            return F.concat(done, F.array(F.aggregate(F.slice(whole, k * size + 1, size), first, step)))

        return F.flatten(F.transform(F.aggregate(F.sequence(F.lit(0), F.floor((F.greatest(F.size(whole), F.lit(1)) - 1) / size).cast("int")), start, fold), lambda w: w["out"]))

    return let(values, stretch)


def running_sums(values: Column) -> Column:
    """The sum of all values before each one, in eights: no array of more than eight numbers is appended to, but for the
    one with a number for 64 values. A few values are added up for each."""
    add = lambda acc, x: acc + x
    places = lambda of: F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(of), F.lit(1)) - 1, 3))
    eights = lambda of: F.transform(places(of), lambda k: F.aggregate(F.slice(of, k * 8 + 1, 8), F.lit(0), add))
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    spread = lambda of, before: F.flatten(F.transform(places(of), lambda k: F.aggregate(F.slice(of, k * 8 + 1, 7), F.array(F.get(before, k)), append)))
    many = lambda z: let(eights(z), lambda b: let(let(running(eights(b), 0, add), lambda o: spread(b, o)), lambda p: F.slice(spread(z, p), F.lit(1), F.size(z))))
    return let(values, lambda z: F.when(F.size(z) <= FEW, F.transform(z, lambda _, i: F.aggregate(F.slice(z, F.lit(1), i), F.lit(0), add))).otherwise(many(z)))


def unmarked(text: Column) -> Column:
    """The text with the other noncharacter for the one that marks matches."""
    return F.when(text.contains(MARK), F.translate(text, MARK, OTHER_MARK)).otherwise(text)


def _found(text: Column, pattern: str | Column, kind: str, match) -> Column:
    """Of each match of the pattern, from left to right, match(parts, places, k): the text is split at the borders of the
    matches, so that each odd part k is one, and its place is the running sum of the lengths before."""
    marked = F.regexp_replace(unmarked(text), pattern, f"{MARK}$0{MARK}")

    def places(parts: Column) -> Column:
        odd = let(running_sums(F.transform(parts, F.length)), lambda at: F.transform(F.sequence(F.lit(1), F.size(at) - 1, F.lit(2)), lambda k: match(parts, at, k)))
        return F.when(F.size(parts) > 1, odd.cast(kind)).when(parts.isNotNull(), F.array().cast(kind))

    return let(F.split(marked, MARK), places)


def sql_string(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str, surfaces: bool = False) -> str:
    """The expression of spans or matches over a column's name. As one text it reaches Spark at once, where columns made
    one by one cost a call for each of their parts. A text without a match is neither marked nor split."""
    hay = f"(CASE WHEN contains({text}, '{MARK}') THEN translate({text}, '{MARK}', '{OTHER_MARK}') ELSE {text} END)"
    pattern = sql_string(pattern)
    # The sums before the parts, as in running_sums, and one more maybe.
    places = lambda of: f"sequence(0, shiftright(size({of}) - 1, 3))"
    eights = lambda of: f"transform({places(of)}, k -> aggregate(slice({of}, k * 8 + 1, 8), 0, (acc, x) -> acc + x))"
    spread = lambda of, before: f"flatten(transform({places(of)}, k -> aggregate(slice({of}, k * 8 + 1, 7), array(get({before}, k)), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))))"
    fold = "aggregate(q, struct(0 AS at, CAST(array() AS array<int>) AS out), (acc, x) -> struct(acc.at + x AS at, concat(acc.out, array(acc.at)) AS out), acc -> acc.out)"
    one = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    sums = one("transform(parts, x -> length(x))", "z", one(eights("z"), "b", one(one(eights("b"), "q", fold), "o", one(spread("b", "o"), "p", spread("z", "p")))))
    surface = ", get(parts, k) AS surface" if surfaces else ""
    place = lambda first, last: f"transform(sequence(1, size(parts) - 1, 2), k -> struct({first} AS start, {last} AS end{surface}))"
    before = lambda k: f"length(array_join(slice(parts, 1, {k}), ''))"
    found = f"CASE WHEN size(parts) <= {FEW} THEN {place(before('k'), before('k + 1'))} ELSE {one(sums, 'at', place('get(at, k)', 'get(at, k + 1)'))} END"
    kind = "array<struct<start:int,end:int,surface:string>>" if surfaces else _SPAN
    split = f"transform(array(split(regexp_replace({hay}, {pattern}, '{MARK}$0{MARK}'), '{MARK}')), parts -> CASE WHEN size(parts) > 1 THEN {found} ELSE array() END)[0]"
    return f"CASE WHEN {text} RLIKE {pattern} THEN CAST({split} AS {kind}) WHEN {text} IS NOT NULL THEN CAST(array() AS {kind}) END"


def chosen_sql(text: str, pattern: str, words: str) -> str:
    """The expression of those matches whose text is among `words` (SQL literals with commas between). Of a text with few
    matches only theirs are placed."""
    hay = f"(CASE WHEN contains({text}, '{MARK}') THEN translate({text}, '{MARK}', '{OTHER_MARK}') ELSE {text} END)"
    before = lambda k: f"length(array_join(slice(parts, 1, {k}), ''))"
    near = f"transform(filter(sequence(1, size(parts) - 1, 2), k -> get(parts, k) IN ({words})), k -> struct({before('k')} AS start, {before('k + 1')} AS end, get(parts, k) AS surface))"
    far = f"filter({spans_sql(text, pattern, surfaces=True)}, m -> m.surface IN ({words}))"
    kind = "array<struct<start:int,end:int,surface:string>>"
    split = f"split(regexp_replace({hay}, {sql_string(pattern)}, '{MARK}$0{MARK}'), '{MARK}')"
    return f"transform(array({split}), parts -> CASE WHEN size(parts) BETWEEN 2 AND 257 THEN CAST({near} AS {kind}) WHEN size(parts) > 257 THEN CAST({far} AS {kind}) ELSE CAST(array() AS {kind}) END)[0]"


def spans(text: Column | str, pattern: str | Column) -> Column:
    """array<struct<start,end>> of the pattern's matches from left to right, half open, in code points.

    A pattern must not match the empty string. Null gives null. A string is a column's name.
    """
    if isinstance(text, str):
        return F.expr(spans_sql(text, pattern))
    return _found(text, pattern, _SPAN, lambda parts, at, k: F.struct(F.get(at, k).alias("start"), F.get(at, k + 1).alias("end")))


def matches(text: Column | str, pattern: str) -> Column:
    """The same with the matched text: array<struct<start,end,surface>>, so that what explodes them can leave the text."""
    if isinstance(text, str):
        return F.expr(spans_sql(text, pattern, surfaces=True))
    kind = "array<struct<start:int,end:int,surface:string>>"
    return _found(text, pattern, kind, lambda parts, at, k: F.struct(F.get(at, k).alias("start"), F.get(at, k + 1).alias("end"), F.get(parts, k).alias("surface")))


def cut(text: Column, start: Column, end: Column) -> Column:
    """The characters from start to end."""
    return F.substring(text, start + F.lit(1), end - start)


#: The SQL of the column text in pieces of 256 characters.
PIECES = r"regexp_extract_all(text, '(?s).{1,256}', 0)"


def cutting(text: Column, body) -> Column:
    """body(cut), where cut(start, end) gives characters of the text from pieces of it. Each cut reads a piece or a few, where
    one from the whole text walks there from its beginning, so many cuts of a long text cost no more than many of short ones."""

    def of(pieces: Column):
        def piece_cut(start: Column, end: Column) -> Column:
            first = F.shiftright(start, 8)
            return F.when(F.size(pieces) == 1, F.substring(F.get(pieces, 0), start + 1, end - start)).otherwise(F.substring(F.array_join(F.slice(pieces, first + 1, F.shiftright(F.greatest(end - 1, start), 8) - first + 1), ""), start - first * 256 + 1, end - start))

        return body(piece_cut)

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,256}"), F.lit(0)), of)


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans that share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def free_of(found: Column, blocked: Column) -> Column:
    """Spans that overlap none of the blocked ones (null: none are blocked)."""
    return F.filter(found, lambda s: ~F.coalesce(F.exists(blocked, lambda p: overlaps(s, p)), F.lit(False)))


def is_titlecase(word: Column) -> Column:
    """Upper case exactly at the start of each run of cased letters."""
    upper, lower = r"[\p{IsUppercase}\p{Lt}]", r"\p{IsLowercase}"
    other = r"[^\p{IsUppercase}\p{Lt}\p{IsLowercase}]"
    return word.rlike(rf"^{other}*(?:{upper}{lower}*(?:{other}+|$))+$")
