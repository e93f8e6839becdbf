"""A trie of conversation prefixes, by sorted paths, the lengths of their common beginnings, and range minima over these."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .storage import Scratch, shuffle_partitions
from .words import inside, mix

#: Turns of a block of sorted paths, about; the arrays of one block are what a task holds.
BLOCK_TURNS = 1 << 18
#: Ids of one piece of a node's list: those that agree but for this many low bits.
PIECE_BITS = 10
_WORDS = r"[^\x20\x09-\x0D]+"
NONE = hashlib.sha256(b"").hexdigest()


class RangeMinimum:
    """A sparse table: level k has the minimum of the 2**k values from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum of values[first..last], both included."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out

    def reach_right(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to which all values behind `place` are at least `bound`, by binary search."""
        at, n = place.copy(), len(self.levels[0])
        for k in reversed(range(len(self.levels))):
            fits = np.flatnonzero(at + (1 << k) < n)
            fits = fits[self.levels[k][at[fits] + 1] >= bound[fits]]
            at[fits] += 1 << k
        return at

    def reach_left(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from which on all values up to and with that of `place` are at least `bound`, less one."""
        at = place.copy()
        for k in reversed(range(len(self.levels))):
            fits = np.flatnonzero(at - (1 << k) >= 0)
            fits = fits[self.levels[k][at[fits] - (1 << k) + 1] >= bound[fits]]
            at[fits] -= 1 << k
        return at


def prefix_nodes(turns: np.ndarray, words: np.ndarray, firsts: np.ndarray, copies: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of a block of sorted, distinct paths.

    turns: two 64-bit numbers for each turn, path after path, in whose order the paths are sorted; words: of each turn;
    firsts: each path's first turn, and the end; copies and ids: of each path's members, their number and the least.
    A node is a path's prefix that the path before does not have. Both ends of its members' interval are searched in the
    common lengths of neighbours, each by itself, and so is the left end of its parent's; counts are then differences of
    running sums.
    """
    sizes, n = np.diff(firsts), len(firsts) - 1
    both = np.minimum(sizes[:-1], sizes[1:])
    owner, k = np.repeat(np.arange(n - 1), both), inside(both)
    differs = (turns[firsts[owner] + k] != turns[firsts[owner + 1] + k]).any(axis=1)
    common = both.copy()
    np.minimum.at(common, owner[differs], k[differs])
    common = np.append(-1, common)  # with the path before
    table, least_id = RangeMinimum(common), RangeMinimum(ids)
    new = sizes - common
    row = np.repeat(np.arange(n), new)
    depth = common[row] + 1 + inside(new)
    left, right = table.reach_left(row, depth), table.reach_right(row, depth)
    parent_left = table.reach_left(row, np.maximum(depth - 1, 0))
    parent = np.cumsum(new)[parent_left] - new[parent_left] + depth - 2 - common[parent_left]
    parent[depth == 0] = -1
    # Words up to each depth of a path, with those up to depth 0 (none) first.
    sums = np.append(0, np.cumsum(words))
    upto = lambda r, d: sums[firsts[r] + d] - sums[firsts[r]]
    before = upto(left, np.maximum(depth - 1, 0))
    running = lambda values: np.append(0, np.cumsum(values))
    over = lambda total: total[right + 1] - total[left]
    members = over(running(copies))
    every = np.arange(n)
    whole = upto(every, sizes)
    follows = np.append(common[1:], -1)
    leaves = over(running(follows < sizes))
    spoken = over(running(copies * whole)) - members * before
    behind = running(whole - upto(every, np.maximum(common, 0)))
    distinct = behind[right + 1] - behind[left + 1] + whole[left] - before
    hashes = np.empty((len(row), 2), np.uint64)
    place = inside(sizes).astype(np.uint64)
    for c in range(2):  # of the turns up to each depth, each with its place
        run = np.append(np.uint64(0), np.cumsum(mix(turns[:, c] ^ mix(place + np.uint64(1 + c)) if len(turns) else turns[:, c])))
        hashes[:, c] = run[firsts[row] + depth] - run[firsts[row]]
    return {
        "row": row, "depth": depth, "id": least_id.least(left, right), "parent": parent, "n_convs": members, "n_children": np.bincount(parent[depth > 0], minlength=len(row)), "n_leaves": leaves, "saved": spoken - distinct,
        "words": upto(row, depth) - before, "ends": depth == sizes[row], "edge": (left == 0) | (right == n - 1), "hashes": hashes,
    }


_NODES = "part long, hi long, lo long, up_hi long, up_lo long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, edge boolean"


def _block_nodes(paths: DataFrame) -> DataFrame:
    """Nodes of each block of paths (key, words, n_convs, first_id, ends_sha256), which are sorted in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            turns = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) + 1)
            start = 0
            while start < batch.num_rows:
                done = turns[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(turns, done + BLOCK_TURNS - size, "right")))
                held.append(batch.slice(start, stop - start))
                size += int(turns[min(stop, batch.num_rows) - 1] - done)
                start = stop
                if size >= BLOCK_TURNS:
                    yield block(part, held)
                    part, held, size = part + 1, [], 0
        if held:
            yield block(part, held)

    def block(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: t.column(name).combine_chunks() if t.num_rows else t.column(name)
        keys, words = column("key").cast(pa.large_binary()), column("words")
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
        raw = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if keys.buffers()[2] else np.zeros(0, np.uint8)
        turns = raw.view(">u8").astype(np.uint64).reshape(-1, 2)
        x = prefix_nodes(turns, words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), (offsets - offsets[0]) // 16, column("n_convs").to_numpy(), column("first_id").to_numpy())
        inner = x["parent"] >= 0
        up = np.where(inner, x["parent"], 0)
        ends = column("ends_sha256").take(pa.array(x["row"]))
        signed = lambda v: pa.array(v.view(np.int64))
        hi, lo = np.ascontiguousarray(x["hashes"][:, 0]), np.ascontiguousarray(x["hashes"][:, 1])
        known = inner & ~x["edge"][up]  # only then the parent's members are all here
        arrays = [
            pa.array(np.full(len(up), part)), signed(hi), signed(lo), signed(hi[up]), signed(lo[up]), pa.array(x["depth"]), pa.array(x["id"]), pa.array(x["id"][up], mask=~known), pa.array(x["n_convs"]),
            pa.array(x["n_children"].astype(np.int64)), pa.array(x["n_leaves"]), pa.array(x["saved"]), pa.array(x["words"]), pa.array(np.where(x["ends"], ends.to_numpy(zero_copy_only=False), None), pa.string()), pa.array(x["edge"]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _NODES.split(", ")])

    return paths.mapInArrow(run, _NODES)


def _joined_edges(edges: DataFrame) -> DataFrame:
    """Nodes that reach a border of their block, whole.

    All their counts are sums over the blocks, but for what neighbouring blocks share: at a border that is a chain of
    nodes from the root on, of which each block has counted the children, leaves and words.
    """
    node = ["depth", "hi", "lo"]
    total = edges.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"),
        F.array_sort(F.collect_list(F.struct("part", "n_children"))).alias("parts"), F.max("words").alias("words"),
    )
    borders = total.select(*node, "words", F.explode(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0)))).alias("border"))
    chain = Window.partitionBy("border.part").orderBy(F.desc("depth"))
    # The deepest shared node is a leaf of the first block if its path ends there, though the next block goes on.
    shared = borders.select(*node, F.sum("words").over(chain).alias("twice"), F.first("depth").over(chain).alias("deepest"), (F.first("border.n_children").over(chain) == 0).alias("goes_on"))
    extra = shared.groupBy(*node).agg(F.sum("twice").alias("twice"), F.sum((F.col("deepest") > F.col("depth")).cast("long")).alias("twins"), F.sum(F.col("goes_on").cast("long")).alias("no_leaves"))
    met = total.join(extra, node, "left")
    less = lambda a, b: (F.col(a) - F.coalesce(F.col(b), F.lit(0))).alias(a)
    return met.select(*node, "up_hi", "up_lo", "conv_id", "n_convs", less("n_children", "twins"), less("n_leaves", "no_leaves"), (F.col("saved_tokens") + F.coalesce("twice", F.lit(0))).alias("saved_tokens"), "ends_sha256")


def _ends(paths: DataFrame) -> DataFrame:
    """(path_id, n_convs, first_id, ends_sha256) of conversations (path_id, conv_id): the SHA-256 of their sorted ids.

    Ids are first joined in pieces that agree in all but PIECE_BITS bits, wherever they lie; then the pieces of a path
    pass through one task as a stream.
    """
    pieces = paths.groupBy("path_id", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("path_id", "piece", "n", F.element_at("ids", 1).alias("first_id"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    schema = "path_id binary, n_convs long, first_id long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for path, group in groupby((r for b in batches for r in b.to_pylist()), lambda r: r["path_id"]):
                digest, total, first = hashlib.sha256(), 0, None
                for r in group:
                    digest.update((b"," if total else b"") + r["ids"].encode())
                    first = r["first_id"] if first is None else first
                    total += r["n"]
                yield path, total, first, digest.hexdigest()

        held: list[tuple] = []
        kinds = pa.schema([("path_id", pa.binary()), ("n_convs", pa.int64()), ("first_id", pa.int64()), ("ends_sha256", pa.string())])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
        for row in digests():
            held.append(row)
            if len(held) == 4096:
                yield batch()
                held = []
        if held:
            yield batch()

    return pieces.repartition("path_id").sortWithinPartitions("path_id", "piece").mapInArrow(run, schema)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations. `turns`: conv_id long (not null, one row at least for each conversation),
    nth long (null for a row that only names its conversation), turn binary of 16 bytes (a hash of what must be equal),
    words long.

    A conversation is the sequence of its turns by nth. For each distinct prefix of d turns, the empty one included: depth, conv_id
    (least member), parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, the words
    of each node's last turn times its members but one) and ends_sha256 (of the comma-joined, ascending ids of members
    that end there). Without conversations there are no rows. Each conversation's row has 24 bytes a turn.

    Equal conversations are one path with a number of copies. Paths are range-partitioned, and sorted blocks of
    them give nodes; those at the borders of blocks are few, and are put together by hashes of 128 bits.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    rows = F.array_sort(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", F.hex("turn").alias("turn"), "words"))))
    held = turns.groupBy("conv_id").agg(rows.alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda x: x["turn"]), ""))
    convs = scratch.table(held.select("conv_id", key.alias("key"), F.transform("t", lambda x: x["words"]).alias("words")).withColumn("path_id", F.unhex(F.md5("key"))), "paths")
    # The number of ids on a path differs widely, and so do the turns; the ids meet without these.
    ends = _ends(convs.select("path_id", "conv_id"))
    paths = convs.join(ends.drop("path_id"), F.col("conv_id") == F.col("first_id"))
    parts = shuffle_partitions(spark)
    nodes = scratch.table(_block_nodes(paths.select("key", "words", "n_convs", "first_id", "ends_sha256").repartitionByRange(parts, "key").sortWithinPartitions("key")), "nodes")
    edges = scratch.table(_joined_edges(nodes.where("edge")), "edges")
    names = edges.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("of_edge"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")]
    inner = nodes.where("NOT edge")
    beside = inner.where("parent_conv_id IS NULL").drop("parent_conv_id")
    up = ["depth", "up_hi", "up_lo"]
    named = lambda df, how: df.join(names, up, how).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("of_edge"))).select(*out)
    return inner.where("parent_conv_id IS NOT NULL").select(*out).unionByName(named(beside, "inner")).unionByName(named(edges, "left"))


def ordered_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, nth, turn, words): turns numbered from 1 in each conversation, by turn (null first), then role and text.

    turn is a hash of role and text, null like empty; rows that repeat are turns of their own. Rows without an id are
    left out, as they belong to no conversation; so are all other columns, whatever their names.
    """
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    slim = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("place"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words"), role.alias("role"), F.substring(text, 1, 64).alias("head"), F.sha2(text, 256).alias("tie"),
    )
    # Ties are ordered by the text's first characters, then by its hash, so that whole texts are not moved.
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("place", "role", "head", "tie")).cast("long")
    return slim.select("conv_id", nth.alias("nth"), "turn", "words")


def rebuilt(turns: DataFrame, size: int = 20, most: int = 3) -> DataFrame:
    """Turns of conversations, each of which begins with the first h (0 to `most`) turns of the first conversation of
    its block of `size`, and goes on with its own behind its first h."""
    h: Column = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(size))
    own = turns.where(F.col("nth") > h)
    ids = turns.where("nth = 1").select("conv_id", base.alias("of"), h.alias("h"))
    heads = turns.where((F.col("nth") <= most) & (F.pmod("conv_id", F.lit(size)) == 0)).withColumnRenamed("conv_id", "of")
    heads = ids.join(heads, "of").where("nth <= h").select("conv_id", "nth", "turn", "words")
    alone = ids.select("conv_id", F.lit(None).cast("long").alias("nth"), F.lit(None).cast("binary").alias("turn"), F.lit(None).cast("long").alias("words"))
    return own.unionByName(heads).unionByName(alone)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that they share beginnings."""
    turns = Scratch(spark, "turns").table(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie(rebuilt(turns))


def _crc_step() -> str:
    """One byte of CRC-32 in SQL: c is the value so far, x the byte."""
    out = "xor(c, x)"
    for _ in range(8):
        out = f"list_transform([{out}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
    return out


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), sha256(coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM turns),
-- CRC-32 of the decimal id, bit by bit, modulo 4: its two low bits
bytes AS (SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)) AS b FROM ids),
crc AS (SELECT conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], b), lambda c, x: {_crc_step()}), CAST(4294967295 AS UBIGINT)) % 4 AS h FROM bytes),
built AS (
  SELECT conv_id, 1 AS own, nth, role, text FROM turns JOIN crc USING (conv_id) WHERE nth > h
  UNION ALL SELECT i.conv_id, 0, t.nth, t.role, t.text FROM ids i JOIN crc USING (conv_id) JOIN turns t ON t.conv_id = i.base WHERE t.nth <= h
),
paths AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, nth) AS p, list(len(regexp_extract_all(text, '{_WORDS}')) ORDER BY own, nth) AS w FROM built GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(p, []) AS p, coalesce(w, []) AS w FROM ids LEFT JOIN paths USING (conv_id)),
prefixes AS (SELECT conv_id, unnest(generate_series(0, len(p))) AS depth, p, w FROM whole),
named AS (SELECT conv_id, depth, array_to_string(p[1:depth], '') AS node, array_to_string(p[1:depth - 1], '') AS up, CASE WHEN depth > 0 THEN w[depth] ELSE 0 END AS words, depth = len(p) AS last FROM prefixes),
nodes AS (
  SELECT node, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM named GROUP BY node, depth
),
children AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
above AS (SELECT substr(node, 1, 32 * CAST(unnest(generate_series(0, depth)) AS INT)) AS node, saved, n_children FROM full_nodes),
sums AS (SELECT node, sum(saved) AS saved_tokens, count_if(n_children = 0) AS n_leaves FROM above GROUP BY node)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (node) LEFT JOIN nodes u ON u.node = n.up AND u.depth = n.depth - 1
"""
