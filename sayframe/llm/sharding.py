"""Range sharding by sampled splitters, so that shards are of nearly equal bytes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .storage import Scratch, free_name

#: Ranges a shard at least, rows a range at most (about), and sampled keys a range.
SHARD_RANGES, RANGE_ROWS, RANGE_SAMPLE = 64, 1 << 20, 16
#: A group of equal keys is heavy from this part of a shard's share on; there are at most HEAVY such groups a shard.
HEAVY = 200


def _sampled_keys(slim: DataFrame, total: int, size: int) -> list[int]:
    """About `size` keys drawn with chances in proportion to their row's size: those rows whose exponential clock (by a
    hash, hence repeatable) rings before size / total. How many ring is Poisson distributed, whatever the data."""
    u = (F.xxhash64("k1", "k2", "row_no", F.lit(17)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    return sorted(r["k1"] for r in slim.where(-F.log(u) / F.col("size") * total < size).select("k1").collect())


def _quantiles(keys: list[int], ranges: int) -> list[int]:
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _ranged(slim: DataFrame, splitters: list[int]) -> DataFrame:
    """Adds part: how many splitters are at most k1."""
    cuts = np.array(splitters, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(cuts, b.column("k1").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int64))], names=[*b.schema.names, "part"])

    return slim.mapInArrow(assign, "k1 long, k2 long, row_no long, size long, part long")


def _place_heavy(groups: list[tuple[int, int, int]], shards: int, share: float) -> tuple[dict[int, list[tuple[int, int]]], list[float]]:
    """For each group (key, bytes, rows) its pieces (rows before the piece's end, shard), and each shard's load.

    Largest first, a group goes whole to the shard with the least load if it fits there to a hundredth of a share;
    else it is cut, and fills the shards with the most room.
    """
    heap = [(0.0, s) for s in range(shards)]
    pieces: dict[int, list[tuple[int, int]]] = {}
    for key, size, rows in sorted(groups, key=lambda g: (-g[1], g[0])):
        done, each = 0, size / rows
        while done < rows:
            load, s = heapq.heappop(heap)
            left = rows - done
            take = left if load + left * each <= 1.01 * share or load >= share else max(1, min(left, int((share - load) / each)))
            heapq.heappush(heap, (load + take * each, s))
            done += take
            pieces.setdefault(key, []).append((done, s))
    return pieces, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def shard_by_bytes(df: DataFrame, key: list[str], size: str, shards: int, rounds: int = 4) -> DataFrame:
    """Adds `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard).

    Records are ordered by two long columns `key`; rows with the same first key are a group, which stays in one shard
    unless it alone overfills one. A group of over a HEAVY-th part of a shard's share goes to the shard with the least
    load, or is cut into runs of rows if none has room for it. All others are range-partitioned: a size-weighted sample
    gives the quantile boundaries of fine ranges, a range that is found overfull, with over twice its share of the
    bytes, is subdivided by a sample of its own (up to `rounds` times), and the running bytes over the ordered ranges
    decide each group's shard, by the room that the heavy ones have left. So sizes differ by about a hundredth of a
    share, or one record.

    The driver gets the sample, one row a range and at most HEAVY * shards heavy groups. Ranges are as many as rows need,
    so windows do not grow with the data, and rows of heavy groups are numbered within salted parts. Null keys count as
    the least; a null size as 0; rows that repeat are told apart by their place in the input; an empty input gives no
    rows. The frame's own columns may have any name; its `shard` and `slot` are replaced.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    row = free_name(df, "row_no")
    least = F.lit(-(1 << 63))
    base = scratch.table(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    slim = base.select(F.coalesce(F.col(key[0]), least).alias("k1"), F.coalesce(F.col(key[1]), least).alias("k2"), F.col(row).alias("row_no"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    all_bytes, all_rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(1.0, all_bytes / shards)
    groups = slim.groupBy("k1").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") * HEAVY > share)
    pieces, load = _place_heavy([tuple(g) for g in groups.collect()], shards, share)
    room = [max(0.0, share - x) for x in load]
    heavy = [(k, h, [(end, s) for end, s in pieces[k]], pieces[k][-1][0] // RANGE_ROWS + 1) for h, k in enumerate(sorted(pieces))]
    heavy = F.broadcast(spark.createDataFrame(heavy, "k1 long, heavy int, pieces array<struct<upto:long,shard:int>>, salts long"))
    light, light_bytes = slim.join(heavy, "k1", "left_anti"), max(0, all_bytes - round(sum(load)))
    ranges = max(SHARD_RANGES * shards, all_rows // RANGE_ROWS)
    cuts = _quantiles(_sampled_keys(light.where("size > 0"), max(1, light_bytes), RANGE_SAMPLE * ranges), ranges)
    for _ in range(rounds):
        ranged = _ranged(light, cuts)
        sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.min("k1").alias("lo"), F.max("k1").alias("hi"))
        over = {r["part"]: r["bytes"] for r in sums.where((F.col("bytes") * ranges > 2 * light_bytes) & (F.col("lo") != F.col("hi"))).collect()}
        if not over:
            break
        wanted = 2 * sum(over.values()) * ranges // max(1, light_bytes)
        more = _sampled_keys(ranged.where(F.col("part").isin(list(over))).where("size > 0"), sum(over.values()), RANGE_SAMPLE * wanted)
        finer = sorted({*cuts, *_quantiles(more, wanted)})
        if len(finer) == len(cuts):
            break
        cuts = finer
    ranged = scratch.table(_ranged(light, cuts), "ranged")
    sums, before = {r["part"]: r["bytes"] for r in ranged.groupBy("part").agg(F.sum("size").alias("bytes")).collect()}, 0
    starts = []
    for part in sorted(sums):
        starts.append((part, before))
        before += sums[part]
    starts = F.broadcast(spark.createDataFrame(starts, "part long, bytes_before long"))
    # A light group's shard: that of its middle, by the room of shards.
    ends = np.cumsum(room) * (before / max(1e-9, sum(room)))
    group = Window.partitionBy("part", "k1")
    order = Window.partitionBy("part").orderBy("k1", "k2", "row_no")
    running = ranged.withColumn("run", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    middle = F.col("bytes_before") + F.col("first") + F.col("bytes") / 2
    shard = F.least(F.lit(shards - 1), F.size(F.filter(F.lit(ends.tolist()), lambda e: e <= middle)))
    lights = running.select("*", F.min("run").over(group).alias("first"), F.sum("size").over(group).alias("bytes")).join(starts, "part")
    lights = lights.select("part", "k1", "k2", "row_no", shard.cast("int").alias("shard"))
    # A heavy group's shard: that of the piece that its row falls into.
    salted = slim.join(heavy, "k1").withColumn("salt", F.pmod(F.xxhash64("row_no"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("heavy", "salt").agg(F.count("*").alias("n"))
    sizes = sizes.select("heavy", "salt", (F.sum("n").over(Window.partitionBy("heavy").orderBy("salt")) - F.col("n")).alias("rows_before"))
    nth = salted.withColumn("nth", F.row_number().over(Window.partitionBy("heavy", "salt").orderBy("k2", "row_no"))).join(sizes, ["heavy", "salt"])
    piece = F.filter("pieces", lambda p: p["upto"] >= F.col("nth") + F.col("rows_before"))[0]
    heavies = nth.select((-1 - F.col("heavy").cast("long") * (1 << 32) - F.col("salt")).alias("part"), "k1", "k2", "row_no", piece["shard"].alias("shard"))
    placed = scratch.table(lights.unionAll(heavies).withColumn("nth", F.row_number().over(Window.partitionBy("part", "shard").orderBy("k1", "k2", "row_no"))).select("row_no", "part", "shard", "nth"), "placed")
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    offsets = counts.select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    slots = placed.join(offsets, ["part", "shard"]).select(F.col("row_no").alias(row), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
    return base.drop("shard", "slot").join(slots, row).drop(row)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of nearly equal bytes; equal texts lie together, as the key is the text's hash."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key_hash"))
    out = shard_by_bytes(docs, ["key_hash", "doc_id"], "size", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
