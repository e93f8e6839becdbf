"""Case folding and canonical composition against Python's own."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from sayframe.functions import unicode

EVERY = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(c)) != "Cn" or c % 97 == 0]


def folded(spark, column, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [r["x"] for r in frame.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_full_folding_of_every_character(spark):
    texts = [None, "", "Straße İSTANBUL ΣΑΣ ﬃ", *["".join(EVERY[i : i + 50]) for i in range(0, len(EVERY), 50)], *[f"a{c}B" for c in EVERY if c.casefold() != c]]
    assert folded(spark, unicode.casefold, texts) == [t and t.casefold() for t in texts]


def test_simple_folding_is_that_of_patterns(spark):
    texts = [f"x{c}" for c in EVERY if c.lower() != c or c.upper() != c or c.casefold() != c]
    got = folded(spark, unicode.simple_fold_column, texts)
    assert got == [unicode.simple_fold(t) for t in texts] and all(len(a) == len(b) for a, b in zip(got, texts))
    for t, f in zip(texts, got):  # the folding is a match without regard to case
        assert re.fullmatch(re.escape(f), t, re.I), (t, f)


def test_composition_of_every_character(spark):
    texts = [None, "", "plain", *["".join(EVERY[i : i + 40]) for i in range(0, len(EVERY), 40)]]
    changing = [c for c in EVERY if unicodedata.normalize("NFD", c) != c and not 0xAC00 <= ord(c) < 0xD7A4]
    texts += [f"a{c}" for c in changing] + [unicodedata.normalize("NFD", f"{c}b{c}") for c in changing] + [unicodedata.normalize("NFD", chr(c)) + x for c in range(0xAC00, 0xD7A4, 31) for x in ("", "ᆨ", "́")]
    assert folded(spark, unicode.nfc, texts) == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_composition_of_clusters(spark):
    r = random.Random(8)
    marks = [c for c in EVERY if unicodedata.combining(c)]
    alphabet = ["e", "o", "é", "ǭ", "﷐", "ᄀ", "ᅡ", "ᆨ", "가", "각", "ெ", "ா", "Å", "\U0001d15f", "क", "़", *r.sample(marks, 30), "́", "̄", "̣", "̨", "ͅ"]
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 12))) for _ in range(4000)] + ["o" + "̣́" * 3000]
    assert folded(spark, unicode.nfc, texts) == [unicodedata.normalize("NFC", t) for t in texts]
    edits = folded(spark, unicode.nfc_edits, ["aéx éq́"])[0]
    assert [tuple(e) for e in edits] == [(1, 3, "é"), (5, 7, "é")]


def test_special_foldings_are_sought_past_plain_characters(spark):
    """The pattern looks at the characters below the first special one once, not at each member of its class."""
    text = ("plain words, " * 40 + "Þé ") * 20 + "Straße ŉ ǰ ﬃ ẞ Ω"
    df = spark.createDataFrame([(text,), ("Þßß",), ("ß",)], "t string").select("t", unicode.casefold(F.col("t")).alias("f"))
    assert all(r["f"] == r["t"].casefold() for r in df.collect())
    assert "(?![" in df._jdf.queryExecution().analyzed().toString()
