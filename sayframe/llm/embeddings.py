"""Near-duplicate vectors by E8 lattice hashing of random projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .graph import components, union_edges, whole_runs
from .storage import Scratch, shuffle_partitions
from .words import mix

TABLES, PROBES = 6, 8
#: Rows of a block of a group, and of groups that are compared pair by pair at once.
BLOCK, FEW = 2048, 32


def e8_shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for si in (1, -1):
                for sj in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = si, sj
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


def e8_nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of D8 and D8 + 1/2."""

    def d8(x: np.ndarray) -> np.ndarray:
        near = np.rint(x)
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] < 0, -1, 1)
        return near

    a, b = d8(y), d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def lattice_cells(unit: np.ndarray, seed: np.ndarray, threshold: float, tables: int, probes: int) -> Iterator[np.ndarray]:
    """For each table the cells of each row (with a seed each): its home cell, then the `probes` nearest neighbouring ones.

    A cell is a pair of E8 points, nearest to two projections to 8 dimensions. These are scaled so that two unit vectors at
    the threshold lie about 0.4 apart in each, while the nearest lattice points are sqrt(2) apart. A neighbour differs
    from home in one of the two points; home + v is the nearer, the larger the offset's part along v.
    """
    around = e8_shortest()
    scale = 0.4 / np.sqrt(8 * (2 - 2 * threshold))
    for t in range(tables):
        homes, along = [], []
        for half in range(2):
            projection = np.random.Generator(np.random.PCG64([20240301, t, half, unit.shape[1]])).standard_normal((unit.shape[1], 8)) * scale
            y = unit @ projection
            homes.append(e8_nearest(y))
            along.append((y - homes[half]) @ around.T - 0.5 * (around**2).sum(axis=1))
        best = np.argsort(-np.concatenate(along, axis=1), axis=1, kind="stable")[:, :probes]
        seeds = [mix(seed + np.uint64((2 * t + half + 1) * 0x632BE59BD9B4E019 % (1 << 64))) for half in range(2)]
        keys = [_point_key(homes[half], seeds[half]) for half in range(2)]
        cells = np.repeat((keys[0] + keys[1])[:, None], 1 + probes, axis=1)
        for half in range(2):
            row, place = np.nonzero(best // len(around) == half)
            points = homes[half][row] + around[best[row, place] % len(around)]
            cells[row, 1 + place] += _point_key(points, seeds[half][row]) - keys[half][row]
        yield mix(cells).astype(np.int64)


def _point_key(points: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed
    for k in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.rint(2 * points[:, k]).astype(np.int64).astype(np.uint64))
    return h


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_pairs(group: np.ndarray, unit: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i < j) of one group with a cosine of at least the threshold; rows lie together by group."""
    new = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    end = np.append(new[1:], len(group))
    few = end - new <= FEW
    stop = np.repeat(np.where(few, end, 0), end - new)
    rows = np.flatnonzero(stop)
    for d in range(1, FEW):
        rows = rows[rows + d < stop[rows]]
        if not len(rows):
            break
        near = np.einsum("ij,ij->i", unit[rows], unit[rows + d]) >= threshold
        yield rows[near], rows[near] + d
    for a, b in zip(new[~few].tolist(), end[~few].tolist()):
        i, j = np.nonzero(np.triu(unit[a:b] @ unit[a:b].T >= threshold, 1))
        yield a + i, a + j


def group_links(members: DataFrame, threshold: float, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of (group, size, cls, n, vec) the links within groups: stars (a, b) with the same components as all links, and
    counts (cls, linked), where a class counts as its n rows. A cls may be in several groups.

    A group falls into blocks of about BLOCK rows. In a block, all rows are compared, unless they all lie within half
    the threshold's angle of their mean, when all are linked. Two blocks are known by mean and radius: by the
    triangle inequality on angles all their rows are linked, or none is, and only where that does not decide their
    rows meet. So a large group of near copies costs no comparison of all its pairs, and no copies of its rows.
    """
    spark = members.sparkSession
    parts = shuffle_partitions(spark)
    limit, slack = float(np.arccos(threshold)), 1e-7
    blocked = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    blocked = blocked.select("group", "block", "blocks", "cls", "n", F.size("vec").alias("dim"), "vec")
    schema = "group long, block long, ball boolean, a long, b long, linked long, members long, radius double, mean array<double>"

    def rows_of(columns: dict, count: int) -> pa.RecordBatch:
        kinds = {f.split()[0]: k for f, k in zip(schema.split(", "), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))}
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(count, t) for k, t in kinds.items()], names=list(kinds))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["group", "block"], 4 * BLOCK):
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                some = t.filter(pa.array(dims == d))
                group, block, blocks, cls, n = (some.column(c).to_numpy() for c in ("group", "block", "blocks", "cls", "n"))
                v = _unit(_matrix(some.column("vec")))
                linked, edges = np.zeros(len(cls), np.int64), []
                of = np.cumsum(np.concatenate([[0], (np.diff(group) != 0) | (np.diff(block) != 0)]))
                cut = np.flatnonzero(np.diff(of, prepend=-1, append=of[-1] + 1))
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if blocks[x] == 1:
                        continue
                    mean = v[x:y].sum(axis=0)
                    mean /= max(np.sqrt(mean @ mean), 1e-300)
                    radius = float(np.arccos(np.clip(v[x:y] @ mean, -1, 1)).max()) + slack
                    yield rows_of({"group": [group[x]], "block": [block[x]], "ball": [True], "a": [cls[x]], "members": [n[x:y].sum()], "radius": [radius], "mean": [mean.tolist()]}, 1)
                    if 2 * radius <= limit:
                        linked[x:y] += n[x:y].sum() - n[x:y]
                        edges.append((np.full(y - x - 1, x), np.arange(x + 1, y)))
                        of[x:y] = -1 - np.arange(x, y)  # nothing is left to compare
                for i, j in near_pairs(of, v, threshold):
                    np.add.at(linked, i, n[j])
                    np.add.at(linked, j, n[i])
                    edges.append((i, j))
                root = union_edges(len(cls), *(np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1)))
                yield rows_of({"group": group, "block": block, "ball": np.zeros(len(cls), np.bool_), "a": cls, "b": cls[root], "linked": linked}, len(cls))

    done = scratch.table(blocked.repartition(parts, "group", "block").sortWithinPartitions("group", "block", "cls").mapInArrow(inside, schema), name)
    own = done.where("NOT ball")
    stars, counts = own.where("a <> b").select("a", "b"), own.select(F.col("a").alias("cls"), "linked")
    balls = done.where("ball")
    if balls.isEmpty():
        return stars, counts.groupBy("cls").agg(F.sum("linked").alias("linked"))
    x, y = balls.alias("x"), balls.alias("y")
    dot = F.aggregate(F.zip_with("x.mean", "y.mean", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    apart, reach = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))), F.col("x.radius") + F.col("y.radius")
    tight = (2 * F.col("x.radius") <= limit) & (2 * F.col("y.radius") <= limit)
    met = x.join(y, F.col("x.group") == F.col("y.group")).where("x.block < y.block").where(apart - reach <= limit + slack)
    met = met.select(F.col("x.group").alias("group"), F.col("x.block").alias("low"), F.col("y.block").alias("high"), F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.members").alias("low_n"), F.col("y.members").alias("high_n"), (tight & (apart + reach + slack <= limit)).alias("all"))
    met = scratch.table(met, f"{name}-blocks")
    sure = met.where("all")
    gains = sure.select("group", F.col("low").alias("block"), F.col("high_n").alias("gain")).unionAll(sure.select("group", F.col("high").alias("block"), F.col("low_n").alias("gain"))).groupBy("group", "block").agg(F.sum("gain").alias("linked"))
    both = met.where("NOT all").select("group", "low", "high", F.explode(F.array("low", "high")).alias("block"))
    copies = both.join(blocked.withColumn("block", F.col("block").cast("long")), ["group", "block"]).repartition(parts, "group", "low", "high").sortWithinPartitions("group", "low", "high", "block", "cls")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["group", "low", "high"], 1):
            cls, n, block = (t.column(c).to_numpy() for c in ("cls", "n", "block"))
            k = int((block == block[0]).sum())
            v = _unit(_matrix(t.column("vec")))
            near = v[:k] @ v[k:].T >= threshold
            i, j = np.nonzero(near)
            root = union_edges(len(cls), i, k + j)
            linked = np.concatenate([near @ n[k:], n[:k] @ near])
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(cls[root]), pa.array(linked)], names=["a", "b", "linked"])

    crossed = scratch.table(copies.select("group", "low", "high", "block", "cls", "n", "vec").mapInArrow(across, "a long, b long, linked long"), f"{name}-across")
    stars = stars.unionAll(sure.select("a", "b")).unionAll(crossed.where("a <> b").select("a", "b"))
    gained = own.select("group", "block", F.col("a").alias("cls")).join(gains, ["group", "block"]).select("cls", "linked")
    counts = counts.unionAll(gained).unionAll(crossed.select(F.col("a").alias("cls"), "linked"))
    return stars, counts.groupBy("cls").agg(F.sum("linked").alias("linked"))


def link_vectors(df: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row for each row of `df`: key, n_links, component_id and kept (see op8).

    Equal vectors of a label form one class, so copies are never compared. Each class falls into its home cell of every
    table and probes the nearest neighbouring cells; classes that share a cell are compared by cosine in double
    precision, and a cell hands on a spanning star of the links found. Within the components so found, links are
    counted (see group_links for both). Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different lengths do not link. Rows that repeat an id are rows of their own:
    each is linked by its own vector and label, and component_id is the least id of its component. A null id links with
    nothing. Only the three named columns are read; an empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lattice")
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("vec") > 0, F.lit(False)) & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    classes = rows.where("fine").groupBy("label", "vec").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("n"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    def hash_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                mine = batch.filter(pa.array(dims == d))
                for at in range(0, mine.num_rows, 2048):
                    b = mine.slice(at, 2048)
                    cls, seed = b.column("cls").to_numpy(), mix(b.column("label_hash").to_numpy().astype(np.uint64) + np.uint64(d))
                    for cells in lattice_cells(_unit(_matrix(b.column("vec"))), seed, threshold, tables, probes):
                        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(cls, cells.shape[1])), pa.array(np.tile(np.arange(cells.shape[1]) == 0, len(cls)))], names=["cell", "cls", "home"])

    cells = scratch.table(classes.select("cls", F.xxhash64("label").alias("label_hash"), F.size("vec").alias("dim"), "vec").mapInArrow(hash_cells, "cell long, cls long, home boolean"), "cells")
    live = cells.groupBy("cell").agg(F.count("*").alias("size"), F.max("home").alias("any_home")).where("size > 1 AND any_home").select("cell", "size")
    live = scratch.table(live, "live")
    met = cells.join(live, "cell").select(F.col("cell").alias("group"), "size", "cls").join(classes.select("cls", "n", "vec"), "cls")
    stars, _ = group_links(met, threshold, scratch, "met")
    groups = scratch.table(components(stars.distinct(), scratch), "groups")
    sizes = groups.groupBy("component_id").agg(F.count("*").alias("size"))
    inside = groups.join(sizes, "component_id").select(F.col("component_id").alias("group"), "size", F.col("id").alias("cls")).join(classes.select("cls", "n", "vec"), "cls")
    _, counts = group_links(inside, threshold, scratch, "inside")
    named = groups.select(F.col("id").alias("cls"), "component_id").join(classes.select("cls", "id"), "cls")
    least = named.groupBy("component_id").agg(F.min("id").alias("least"))
    reached = named.join(least, "component_id").select("cls", "least")
    known = classes.join(counts, "cls", "left").join(reached, "cls", "left").select("label", "vec", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    joined = rows.where("fine").join(known, ["label", "vec"], "left").select("id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return joined.unionAll(alone).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of one label with cosine 0.98 or more."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
