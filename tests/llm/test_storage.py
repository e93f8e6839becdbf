"""What steps leave on the disk, and the frequent hashes that keep their lists short."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from sayframe.llm.storage import Scratch
from sayframe.llm.words import frequent_hashes


def test_no_shuffle_outlives_its_table(spark):
    def files() -> set[str]:
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = files()
    scratch = Scratch(spark, "clean")
    t = scratch.table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "t")
    assert files() <= before
    assert t.agg(F.sum("n")).first()[0] == 1000
    scratch.drop()


def test_frequent_hashes_are_exact(spark):
    many, few = 0xFEDCBA9876543211, 0x7FFFFFFFFFFFFFFF
    docs = spark.createDataFrame([(str(uuid.uuid4()),) for _ in range(4)], "text string").coalesce(1)
    found = frequent_hashes(docs, lambda t: np.array([many] * 5 + [few] * 4 + [3], np.uint64), 1 << 19, Scratch(spark, "often"))
    assert found.tolist() == [few, many]
