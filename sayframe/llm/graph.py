"""Connected components by contraction, and runs of equal keys in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import Scratch


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys (long columns without nulls), in a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, np.bool_)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = np.flatnonzero(change)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about `rows` rows unless one group has more."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            if count < rows:
                part = batch.slice(0, rows - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                continue
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            other = np.zeros(batch.num_rows, np.bool_)
            for k, v in zip(keys, last):
                other |= batch.column(k).to_numpy() != v
            cut = int(other.argmax()) if other.any() else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if other.any():
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def union_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' component, under these links."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task keeps a spanning star of each component that it sees."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places = np.unique(np.concatenate([b.column("a").to_numpy(), b.column("b").to_numpy()]), return_inverse=True)
            root = union_edges(len(ids), places[: b.num_rows], places[b.num_rows :])
            keep = root != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[keep]]), pa.array(ids[keep])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(reduce, "a long, b long")


#: Once a round has contracted the links to this many or fewer, one task joins what is left of them.
REST = 1 << 16


def _rest(edges: DataFrame) -> DataFrame:
    """(id, to) for each id in at most REST links (a, b): the least id of its component, found in one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if not ends:
            return
        a, b = (np.concatenate(x) for x in zip(*ends))
        ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = union_edges(len(ids), places[: len(a)], places[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(join, "id long, to long")


def components(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(id, component_id) for each id in the links (a, b); component_id is the least id that links reach.

    Each round maps every id to that neighbour (or itself) that comes first in a fixed random order, and links the
    images; ids that no neighbour maps to vanish, so rounds are about logarithmic in the longest path. The first round
    is always one over all tasks; a remainder of at most REST links is then joined at once. The maps are written to the
    shared folder and composed afterwards. Nothing is gathered on the driver but counts.
    """
    order = lambda c: F.struct(F.xxhash64(c, F.lit(7)).alias("o"), F.col(c).alias("id"))
    level, maps = scratch.table(_forest(edges.where("a <> b")), f"{name}-0", grows=True), []
    while left := level.count():
        if maps and left <= REST:
            maps.append(scratch.table(_rest(level), f"{name}-to-{len(maps)}", grows=True))
            break
        both = level.select("a", "b").unionAll(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(order("b")).alias("least")).select(F.col("a").alias("id"), F.least(order("a"), F.col("least"))["id"].alias("to"))
        maps.append(scratch.table(to, f"{name}-to-{len(maps)}", grows=True))
        low, high = (maps[-1].select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        images = level.join(low, "a").join(high, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct()
        level = scratch.table(_forest(images), f"{name}-{len(maps)}", grows=True)
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], "id long, component_id long")
    whole = maps[-1]
    for to in reversed(maps[:-1]):
        whole = to.join(whole.select(F.col("id").alias("to"), F.col("to").alias("root")), "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    whole = scratch.table(whole, f"{name}-roots", grows=True)
    least = whole.groupBy("to").agg(F.least(F.min("id"), F.col("to")).alias("component_id"))
    return whole.join(least, "to").select("id", "component_id")
