"""Case folding and canonical composition (NFC) as columns, by tables that Python's own Unicode data give."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from .text import cutting, let, matches, running

_HANGUL_L, _HANGUL_V, _HANGUL_T, _HANGUL_S = 0x1100, 0x1161, 0x11A7, 0xAC00
_ASCII_ONLY = r"^[\x00-\x7F]*$"
EDITS = "array<struct<start:int,end:int,replacement:string>>"


def _characters() -> map:
    return map(chr, (*range(0xD800), *range(0xE000, 0x110000)))


@lru_cache(1)
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that full case folding changes: to one character, and to several."""
    one, several = {}, {}
    for c in _characters():
        if (f := c.casefold()) != c:
            (one if len(f) == 1 else several)[c] = f
    return one, several


@lru_cache(1)
def simple_foldings() -> dict[str, str]:
    """Foldings that keep a text's length, for matching without regard to case: characters of the same full folding
    are alike (of several characters, the least that has it stands for all), and so are i with and without a dot."""
    one, several = foldings()
    least: dict[str, str] = {}
    for c, f in several.items():
        least[f] = min(c, least.get(f, c))
    return one | {c: least[f] for c, f in several.items() if least[f] != c} | {"İ": "i", "ı": "i"}


def simple_fold(text: str) -> str:
    table = simple_foldings()
    return text.lower() if text.isascii() else "".join(table.get(c, c) for c in text)


def _translated(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def simple_fold_column(text: Column) -> Column:
    """The same for a column; places stay what they are."""
    return F.when(text.rlike(_ASCII_ONLY), F.lower(text)).otherwise(_translated(text, simple_foldings()))


def _listed(values) -> Column:
    """A constant array of strings."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def casefold(text: Column) -> Column:
    """Full case folding: the same for all cases of a text, for comparison. It may be longer than the text."""
    one, several = foldings()
    # A class of single characters is tried one by one; most characters lie below the first, which is seen at once.
    special = f"(?![\\x{{0}}-\\x{{{ord(min(several)) - 1:X}}}])[{''.join(several)}]"

    def spread(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(f"({special})")), lambda c: F.element_at(_listed(several.values()), F.position(c, F.lit("".join(several)))))
        return F.array_join(F.zip_with(F.split(t, special, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    folded = _translated(text, one)
    return F.when(text.rlike(_ASCII_ONLY), F.lower(text)).when(text.rlike(special), spread(folded)).otherwise(folded)


def language_key(language: Column) -> Column:
    """A language tag for comparison."""
    return casefold(F.replace(F.trim(language), F.lit("_"), F.lit("-")))


# --- canonical composition -------------------------------------------------------------------------------------------------


@lru_cache(1)
def _composition() -> tuple[dict[str, int], dict[str, str], dict[str, dict[str, str]], set[str]]:
    """Combining classes that are not 0, decompositions (but of Hangul syllables), composites by their second and first
    character, and all characters before which a text may not be cut for composing it."""
    classes = {c: k for c in _characters() if (k := unicodedata.combining(c))}
    parts: dict[str, str] = {}
    pairs: dict[str, dict[str, str]] = {}
    unsafe = {*classes, *map(chr, range(_HANGUL_V, _HANGUL_V + 21)), *map(chr, range(_HANGUL_T + 1, _HANGUL_T + 28))}
    for c in _characters():
        mapping = unicodedata.decomposition(c)
        if not mapping or mapping[0] == "<":
            continue
        parts[c] = unicodedata.normalize("NFD", c)
        pair = "".join(chr(int(x, 16)) for x in mapping.split())
        if len(pair) == 2 and unicodedata.normalize("NFC", pair) == c:
            pairs.setdefault(pair[1], {})[pair[0]] = c
        if unicodedata.normalize("NFC", c) != c:
            unsafe.add(c)
    return classes, parts, pairs, unsafe | set(pairs)


def _class_of(characters: set[str]) -> str:
    """A pattern's character class of these characters, by ranges."""
    codes, ranges = sorted(map(ord, characters)), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(1)
def cluster_pattern() -> str:
    """A character (if any, and none that marks matches) with all behind it before which a text may not be cut. What no such match covers, and a text's
    parts between matches, are composed already. No character below U+0300 makes a match, which is seen first."""
    unsafe = _class_of(_composition()[3])
    return f"[^\\x{{FDD0}}\\x{{FDD1}}]?(?:(?![\\x{{0}}-\\x{{2FF}}]){unsafe})+"


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _composite(first: Column, second: Column) -> Column:
    """The one character for two, or null."""
    pairs = _composition()[2]
    at = F.position(second, F.lit("".join(pairs)))
    firsts = F.get(_listed("".join(p) for p in pairs.values()), at - 1)
    whole = F.get(_listed("".join(p.values()) for p in pairs.values()), at - 1)
    place = F.position(first, firsts)
    a, b = F.ascii(first), F.ascii(second)
    leading = a.between(_HANGUL_L, _HANGUL_L + 18) & b.between(_HANGUL_V, _HANGUL_V + 20)
    open_ = a.between(_HANGUL_S, _HANGUL_S + 11171) & ((a - _HANGUL_S) % 28 == 0) & b.between(_HANGUL_T + 1, _HANGUL_T + 27)
    hangul = F.when(leading, _character(((a - _HANGUL_L) * 21 + b - _HANGUL_V) * 28 + _HANGUL_S)).when(open_, _character(a + b - _HANGUL_T))
    return F.when(first == "", F.lit(None).cast("string")).when((at > 0) & (place > 0), F.substring(whole, place, F.lit(1))).otherwise(hangul)


def _composed(cluster: Column) -> Column:
    """NFC of one cluster: decomposed, marks in the order of their classes, and composed again."""
    classes, parts, _, _ = _composition()
    whole = lambda c: F.coalesce(F.get(_listed(parts.values()), F.position(c, F.lit("".join(parts))) - 1), c)
    kind = lambda c: F.coalesce(F.get(_listed(map(str, classes.values())).cast("array<int>"), F.position(c, F.lit("".join(classes))) - 1), F.lit(0))
    chars = F.flatten(F.transform(F.split(cluster, ""), lambda c: F.split(whole(c), "")))

    def ordered(cs: Column) -> Column:
        def by_class(ks: Column) -> Column:
            starters = running(ks, 0, lambda n, k: n + (k == 0).cast("int"))
            blocks = let(starters, lambda s: F.transform(cs, lambda c, i: F.struct((F.get(s, i) + (F.get(ks, i) == 0).cast("int")).alias("block"), F.get(ks, i).alias("k"), i.alias("i"), c.alias("c"))))
            return F.sort_array(blocks)

        return let(F.transform(cs, kind), by_class)

    start = F.struct(*[F.lit("").alias(n) for n in ("done", "first", "tail")], F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        free = (acc["tail"] == "") | ((acc["last"] < x["k"]) & (acc["last"] > 0))
        one = F.when(free, _composite(acc["first"], x["c"]))
        keeps = lambda a, new, b: F.when(one.isNotNull(), a).when(x["k"] == 0, new).otherwise(b)
        return F.struct(
            keeps(acc["done"], F.concat(acc["done"], acc["first"], acc["tail"]), acc["done"]).alias("done"), F.coalesce(one, F.when(x["k"] == 0, x["c"]).otherwise(acc["first"])).alias("first"),
            keeps(acc["tail"], F.lit(""), F.concat(acc["tail"], x["c"])).alias("tail"), keeps(acc["last"], F.lit(0), x["k"]).alias("last"),
        )

    return F.aggregate(let(chars, ordered), start, step, lambda acc: F.concat(acc["done"], acc["first"], acc["tail"]))


def nfc_edits(text: Column) -> Column:
    """array<struct<start,end,replacement>> of the clusters that canonical composition changes, from left to right.

    Each different cluster of a text is composed once. A text without any gives an empty array, null gives null.
    """

    def changed(found: Column) -> Column:
        def replaced(own: Column) -> Column:
            new = lambda whole: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.nullif(F.get(whole, F.array_position(own, m["surface"]).cast("int") - 1), m["surface"]).alias("replacement")))
            return let(F.transform(own, _composed), lambda whole: F.filter(new(whole), lambda e: e["replacement"].isNotNull()))

        return let(F.array_distinct(F.transform(found, lambda m: m["surface"])), replaced)

    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), let(matches(text, cluster_pattern()), changed).cast(EDITS)).when(text.isNotNull(), F.array().cast(EDITS))


def nfc(text: Column) -> Column:
    """Canonical composition (NFC) of a text."""

    def rebuilt(edits: Column) -> Column:
        end = lambda i: F.coalesce(F.get(edits, i)["end"], F.lit(0))
        parts = cutting(text, lambda piece: F.transform(edits, lambda e, i: F.concat(piece(end(i - 1), e["start"]), e["replacement"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(edits) - 1) + 1, F.length(text)))

    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), let(nfc_edits(text), rebuilt)).otherwise(text)
