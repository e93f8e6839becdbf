"""Preparation where each unit is read: no unit is moved or made twice, and the results are those of moved rows."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from sayframe.operators import serialize
from sayframe.plans import prepare
from sayframe.plans.prepare import prepare_text, prepare_units
from sayframe.sources.units import text_units

TEXTS = [
    ("en", "Dr. Lee (ART) agreed on 12 kg, 3 in. and 1 kg. ART’s and ART's module, ART-like START."), ("en", "Later ART checked 12/31/2024 at 12:30, 5€ and 50% of \U0001f600 ART."), ("en-GB", "ART stays."), ("fr", "ART et 2 kg (BD)."), ("de", "z. B. 7 km (ÄB) auf/zu BD"),
    ("en", ""), ("en", "x " * 400 + "ART 7 kg " * 40 + "(USA) and USA"), ("en", "a﷐ART (NO) \x0b\x1f 2+2 NO."), ("xx", "ART 3 kg (ART)."),
]


def make(spark):
    rows = [(i, f"u{i}", t, lang, [(0, min(3, len(t)), "head")] if i in (2, 6) else []) for i, (lang, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "n int, id string, t string, lang string, p array<struct<start:int,end:int,reason:string>>")
    return text_units(df, "id", "t", "lang", "prose", "n", protected_spans="p")


def plan(df) -> str:
    with redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def test_same_as_by_rows(spark, monkeypatch):
    units = make(spark)
    own = prepare_units(units)
    monkeypatch.setattr(prepare, "HELD", -1)
    rows = prepare_units(units)
    assert rows.kept is not None and own.kept is None
    for name in ("units", "changes", "issues", "stats"):
        a, b = (getattr(r, name) for r in (own, rows))
        assert sorted(a.columns) == sorted(b.columns)
        a, b = (df.select(*sorted(df.columns)) for df in (a, b))
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name
    tree = lambda r, f: sorted(map(repr, f(r).collect()))
    assert tree(own, serialize.result_json) == tree(rows, lambda r: serialize.unit_json(r.units, r.issues))
    assert own.units.where("unit_id = 'u1'").first()["spoken_text"].count("A R T") == 2
    rows.release()


def test_no_unit_is_moved(spark):
    units = make(spark)
    done, alone = prepare_units(units), prepare_text(units)
    for df in (done.units, done.changes, done.issues, alone.issues, serialize.result_json(alone), serialize.result_json(done)):
        assert "Join" not in plan(df) and "Exchange" not in plan(df)
    assert plan(done.stats).count("Scan") == 1
    assert done.units.where("text <> spoken_text").count() == done.changed.count() == 6


def test_few_and_many_places(spark):
    from sayframe.functions.text import running_sums, spans

    df = spark.createDataFrame([(n, "ab " * n) for n in (0, 1, 7, 8, 9, 40)], "n int, t string").withColumn("v", F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: i + 1))
    for n, at, sums in df.select("n", spans("t", "b"), running_sums(F.col("v"))).collect():
        assert [(s["start"], s["end"]) for s in at] == [(3 * i + 1, 3 * i + 2) for i in range(n)]
        assert sums == [i * (i + 1) // 2 for i in range(n + 1)]


def test_one_file_is_prepared_by_many_tasks(spark, tmp_path):
    from sayframe.sources.units import order_notes

    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, TIMESTAMP'2020-01-02' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(100)").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    used = order_notes(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))
    result = prepare_units(order_notes(spark, str(tmp_path)))
    rows = sorted((r["ordinal"], r["unit_id"], r["spoken_text"]) for r in result.units.collect())
    import hashlib
    import json

    expected = json.dumps([{"spoken_text": s, "unit_id": u} for _, u, s in rows], ensure_ascii=False, separators=(",", ":"))
    assert result.prepared_fingerprint() == hashlib.sha256(expected.encode()).hexdigest()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
