"""Exact self-join of shingle sets by Jaccard similarity, with set-relation skipping.

Two kinds of work are skipped. Index level: lists of the prefix index are sorted by set size, and blocks of a list are
passed over whole when sizes and positions rule out a link. Answer level: within a group of related sets, a set's overlaps with
all others are derived from those of a very similar set by their differing elements alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .graph import components, runs, union_edges, whole_runs
from .storage import Scratch, shuffle_partitions
from .words import LOWER, frequent_hashes, ranked, shingle_hashes, slices, text_bytes, word_hashes, word_spans

#: A shingle is frequent, and comes last in the order of all shingles, from a 2^19th part of all entries of sets on, so there
#: are at most as many; any such list gives the same links.
FREQUENT = 1 << 19
LIST_BLOCK, SET_BLOCK = 1024, 512
_FEW = 32


def probe_prefix(n, percent: int):
    """Leading elements of which a set shares one with any linked set that is not larger."""
    return n + (-percent * n // 100) + 1


def index_prefix(n, percent: int):
    """Leading elements of which a set shares one with any linked set that is not smaller."""
    return n + (-2 * percent * n // (100 + percent)) + 1


def linked(common, n, m, percent: int):
    return (100 + percent) * common >= percent * (n + m)


def text_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: A-Z lower-cased, `width` words each (all of a shorter text)."""
    raw, offsets = text_bytes(texts)
    starts, ends, firsts = word_spans(raw, offsets)
    h, cuts = shingle_hashes(word_hashes(LOWER[raw], starts, ends), firsts, width)
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """A bitmap in which each element flips one bit, so two sets differ in at least as many elements as bits.

    It has a power of two of bits, about half the set's size to its size, so sets of like sizes have like bitmaps;
    a longer one is folded onto a shorter.
    """
    size = 64
    while 2 * size < len(elements):
        size *= 2
    bits = np.bincount((elements >> np.uint64(7)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8))


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    return bits if len(bits) == size else bits[:size] ^ bits[size:]


def _scan(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(id, text_key, size, set_key, prefix, bits) of each text; prefix is in the order of all shingles, rare ones first."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, text_key binary, size long, set_key binary, prefix array<long>, bits binary"
    held = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent).astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                keys, prefixes, bits, sizes = [], [], [], []
                for s in text_sets(b.column("text"), width):
                    n = len(s)
                    order = np.lexsort((s, ranked(s, held.value)))
                    prefixes.append(s[order[: probe_prefix(n, percent)]].astype(np.int64) if n else np.zeros(0, np.int64))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bits.append(parity_bits(s).tobytes())
                    sizes.append(n)
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(bits, pa.binary())], names=["id", "text_key", "size", "set_key", "prefix", "bits"])

    return docs.select("id", "text_key", "text").mapInArrow(run, schema)


def _blocked(df: DataFrame, member: str, many: str, block: int) -> DataFrame:
    """Adds mine, low and high: a group of many rows is cut into blocks, which meet in pairs; see embeddings._blocked."""
    blocks = F.ceil(F.col(many) / block).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(3)), blocks).cast("int")
    out = df.withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumn("low", F.least("mine", "other").cast("long")).withColumn("high", F.greatest("mine", "other").cast("long")).drop("other", many)


class ListJoin:
    """Finds pairs that may be linked in lists of the prefix index."""

    def __init__(self, t: pa.Table, percent: int):
        get = lambda c: t.column(c).to_numpy()
        self.percent, self.size, self.at, self.mine = percent, get("size"), get("at"), get("mine")
        self.cross = get("low") != get("high")
        self.index = self.at < index_prefix(self.size, percent)
        self.bits = [np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()]

    def likely(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs with size[i] <= size[j], those that sizes, places and bitmaps allow. A linked pair passes in the
        list of its first common element, where nothing before it is shared."""
        p, n, m = self.percent, self.size[i], self.size[j]
        need = -(-p * (n + m) // (100 + p))
        ok = self.index[i] & (100 * n >= p * m) & (np.minimum(n - self.at[i], m - self.at[j]) >= need)
        ok &= ~self.cross[i] | (self.mine[i] != self.mine[j])
        i, j, need = i[ok], j[ok], need[ok]
        keep = np.zeros(len(i), np.bool_)
        widths = np.array([len(self.bits[k]) for k in i], np.int64)
        for w in np.unique(widths):
            some = np.flatnonzero(widths == w)
            for part in np.array_split(some, len(some) * int(w) // (4 << 20) + 1):
                a = np.stack([self.bits[k] for k in i[part]])
                b = np.stack([fold(self.bits[k], int(w)) for k in j[part]])
                apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                keep[part] = 2 * need[part] <= self.size[i[part]] + self.size[j[part]] - apart
        return i[keep], j[keep]

    def pairs(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Over lists [first, end), each sorted by size."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        length = end - first
        few = np.flatnonzero((length > 1) & (length <= _FEW))
        if len(few):
            rows = np.concatenate([np.arange(first[k], end[k]) for k in few])
            stop = np.repeat(end[few], length[few])
            for d in range(1, _FEW):
                ok = rows + d < stop
                rows, stop = rows[ok], stop[ok]
                if not len(rows):
                    break
                found.append(self.likely(rows, rows + d))
        for k in np.flatnonzero(length > _FEW).tolist():
            for a in range(first[k], end[k], 128):
                block = np.arange(a, min(a + 128, end[k]))
                n, room = self.size[block], (self.size[block] - self.at[block])[self.index[block]]
                if not len(room):
                    continue  # no row of the block is an index entry
                for b in range(a, end[k], 128):
                    other = np.arange(b, min(b + 128, end[k]))
                    m = self.size[other]
                    if 100 * n[-1] < self.percent * m[0]:
                        break  # all sets from here on are too large for this block
                    if min(room.max(), (m - self.at[other]).max()) * (100 + self.percent) < self.percent * (n[0] + m[0]):
                        continue  # no two places of the blocks leave enough elements
                    i, j = (x.ravel() for x in np.meshgrid(block, other, indexing="ij"))
                    ok = i < j
                    found.append(self.likely(i[ok], j[ok]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Spanning links between classes that may be linked, from index rows sorted by list and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["token", "low", "high"], 8192):
            token, low, high, cls = (t.column(c).to_numpy() for c in ("token", "low", "high", "cls"))
            new = np.ones(len(token), np.bool_)
            new[1:] = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            first = np.flatnonzero(new)
            i, j = ListJoin(t, percent).pairs(first, np.concatenate([first[1:], [len(token)]]))
            ids, at = np.unique(cls, return_inverse=True)
            root = union_edges(len(ids), at[i], at[j])
            keep = root != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[keep]]), pa.array(ids[keep])], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Each set's row is derived from that of the most similar set done before: only lists
    of elements that one of the two lacks are visited. Without such a set, the lists of all its elements are."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(element, kind="stable")
    members, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(element))])
    mine = [element[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def visit(elements: np.ndarray) -> np.ndarray:
        n = begin[elements + 1] - begin[elements]
        at = np.repeat(begin[elements] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(members[at], minlength=m)

    out = np.zeros((m, m), np.int64)
    for x in range(m):
        y = -1
        if x:
            like = out[:x, x] / (sizes[:x] + sizes[x] - out[:x, x])
            y = int(like.argmax())
            if sizes[x] + sizes[y] - 2 * out[y, x] >= sizes[x]:
                y = -1
        if y < 0:
            out[x] = visit(mine[x])
        else:
            gained, lost = np.setdiff1d(mine[x], mine[y], True), np.setdiff1d(mine[y], mine[x], True)
            out[x] = out[y] + visit(gained) - visit(lost)
    return out


def _verify(df: DataFrame, percent: int) -> DataFrame:
    """(cls, linked, root): rows linked with each class within one pair of blocks, and the least class of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["group", "low", "high"]):
            cls, mine, n = (t.column(c).to_numpy() for c in ("cls", "mine", "n"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            common = overlaps(sets)
            link = linked(common, size[:, None], size[None, :], percent)
            np.fill_diagonal(link, False)
            if t.column("low")[0].as_py() != t.column("high")[0].as_py():
                link &= mine[:, None] != mine[None, :]
            order = np.argsort(cls)
            back = np.empty(len(cls), np.int64)
            back[order] = np.arange(len(cls))
            a, b = np.nonzero(np.triu(link, 1))
            root = cls[order][union_edges(len(cls), back[a], back[b])][back]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(link @ n), pa.array(root)], names=["cls", "linked", "root"])

    return df.select("group", "low", "high", "cls", "mine", "n", "elements").mapInArrow(run, "cls long, linked long, root long")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """The sets of texts as elements; other columns, all long, stay."""
    own = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array([s.tobytes() for s in text_sets(b.column("text"), width)], pa.binary())], names=[*own, "elements"])

    return df.select(*own, "text").mapInArrow(run, f"{', '.join(f'{c} long' for c in own)}, elements binary")


def jaccard_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, by_text: bool = False) -> DataFrame:
    """One row for each row of `df`: key, n_shingles, n_links (other rows linked directly) and component_id (least
    key that links reach, itself included).

    Rows with equal sets are one class throughout. Classes meet in lists of a prefix index, rarest shingles first;
    pairs that sizes, places and parity bitmaps allow make candidate groups, in which all overlaps are then counted
    exactly (in pairs of blocks where a group is large). Only spanning links leave a task. A text without words, or
    null, has an empty set and links with nothing. A row with a null key belongs to its component by its text; where
    all keys are null, component_id is null. `by_text` adds text_key (MD5 of the text) and group_no, a number of the
    component that repeated and null keys do not blur (null for a text without words).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    parts = shuffle_partitions(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("id"), F.unhex(F.md5(whole)).alias("text_key"), whole.alias("text"))
    rows = scratch.table(_scan(docs, width, percent, frequent_hashes(docs.select("text"), lambda t: np.concatenate(text_sets(t, width)), FREQUENT, scratch)), "rows", grows=True)
    classes = rows.where("size > 0").groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("least"), F.min("id").alias("id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes", grows=True)
    # Prefixes and bitmaps, which are about as large as the texts, are kept no longer than they are read.
    rows = scratch.table(rows.select("id", "text_key", "size", "set_key"), "names", grows=True)
    scratch.drop("rows")

    entries = classes.select("cls", "size", F.posexplode("prefix").alias("at", "token"))
    index_end = F.col("size") - F.ceil(2 * percent * F.col("size") / (100 + percent)) + 1
    # Entries are most of what this step moves, so they are dealt out by token once, and what a token's list is found there.
    token = Window.partitionBy("token")
    shared = entries.withColumns({"many": F.count("*").over(token), "any_index": F.max(F.col("at") <= index_end).over(token)}).where("many > 1 AND any_index").drop("any_index")
    lists = shared.join(classes.select("cls", "bits"), "cls")
    lists = _blocked(lists.withColumn("at", F.col("at").cast("long")), "cls", "many", LIST_BLOCK)
    lists = lists.repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high", "size", "cls")
    pairs = scratch.table(_candidates(lists, percent), "pairs")
    classes = scratch.table(classes.drop("prefix", "bits"), "members", grows=True)
    scratch.drop("classes")
    groups = scratch.table(components(pairs, scratch, "maybe"), "groups", grows=True)

    sizes = groups.groupBy("component_id").agg(F.count("*").alias("many"))
    members = groups.join(sizes, "component_id").select(F.col("component_id").alias("group"), "many", F.col("id").alias("cls"))
    # What a set needs beside its text goes with the text, as sets are larger than texts and so are shuffled only once.
    wanted = members.join(classes.select("cls", "n", "least"), "cls").select("cls", "group", "many", "n", F.col("least.id").alias("of"), F.col("least.text_key").alias("of_text"))
    texts = docs.join(wanted, (F.col("text_key") == F.col("of_text")) & F.col("id").eqNullSafe(F.col("of"))).select("cls", "group", "many", "n", "text").dropDuplicates(["cls"])
    met = _blocked(_sets(texts, width), "cls", "many", SET_BLOCK)
    met = met.repartition(parts, "group", "low", "high").sortWithinPartitions("group", "low", "high", "cls")
    links = scratch.table(_verify(met, percent), "links", grows=True)

    reached = components(links.where("root <> cls").select(F.col("root").alias("a"), F.col("cls").alias("b")), scratch, "sure")
    ends = reached.join(classes.select(F.col("cls").alias("id"), F.col("id").alias("least_id")), "id")
    least = ends.groupBy("component_id").agg(F.min("least_id").alias("reached"))
    named = ends.join(least, "component_id").select(F.col("id").alias("cls"), "reached", "component_id")
    counts = links.groupBy("cls").agg(F.sum("linked").alias("linked"))
    known = classes.join(counts, "cls", "left").join(named, "cls", "left").select("set_key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("reached", "id").alias("reached"), F.coalesce("component_id", "cls").alias("group_no"))
    known = scratch.table(known, "known", grows=True)
    return rows.join(known, "set_key", "left").select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("reached", "id").alias("component_id"), *(["text_key", "group_no"] if by_text else []))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by sets of four words and a similarity of 0.85."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4, percent=85)

