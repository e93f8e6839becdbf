"""Best-fit packing of token sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .storage import Scratch, extended, free_name
from .words import inside, slices, text_bytes, word_hashes, word_spans

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 1_000_000
_caches: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of words. Each distinct word is tokenized once a worker, as long as at most CACHE_WORDS are held;
    then the cache starts anew, which costs time but changes no id.

    The tokenizer's pre-tokenizer never joins characters across ASCII white space, which it drops, so a text's ids are
    its words' ids in turn. Words are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count, self.ids, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def lookup(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in self.ids, and number of ids, of each word."""
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            new = at[~known]
            data = raw.tobytes()
            coded = self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())], add_special_tokens=False)
            lists = [c.ids for c in coded]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            total = int(counts.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.uint32, total)
            keys = np.concatenate([self.keys, distinct[~known]])
            order = np.argsort(keys, kind="stable")
            self.first = np.concatenate([self.first, self.used + np.cumsum(counts) - counts])[order]
            self.count = np.concatenate([self.count, counts])[order]
            self.keys = keys[order]
            self.used += total
            place = np.searchsorted(self.keys, distinct)
        return self.first[place][back], self.count[place][back]


def text_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text closed by END_ID, and each text's first place (and the end)."""
    cache = _caches.setdefault(path, None) or _caches.__setitem__(path, WordIds(path)) or _caches[path]
    raw, offsets = text_bytes(texts)
    starts, ends, firsts = word_spans(raw, offsets)
    first, count = cache.lookup(raw, starts, ends, word_hashes(raw, starts, ends)) if len(starts) else (np.zeros(0, np.int64),) * 2
    before = np.concatenate([[0], np.cumsum(count)])
    edges = before[firsts] + np.arange(len(firsts))
    out = np.full(edges[-1], END_ID, np.uint32)
    body = np.ones(len(out), np.bool_)
    body[edges[1:] - 1] = False
    out[body] = cache.ids[np.repeat(first, count) + inside(count)] if len(count) else []
    return out, edges


def tokenize(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (key, piece, start, length, ids_crc32) of each row's ids; only rows over the capacity are cut."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                ids, edges = text_ids(b.column(text), path)
                pieces = -(-np.diff(edges) // capacity)
                owner, piece = np.repeat(np.arange(len(pieces)), pieces), inside(pieces)
                begin = edges[:-1][owner] + piece * capacity
                end = np.minimum(begin + capacity, edges[1:][owner])
                data = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(end - begin), pa.array(sums, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    return df.select(key, text).mapInArrow(run, schema)


def _price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value within each capacity, and the last item taken (-1:
    none, take one token of room less)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - lengths[:k]] + values[:k]
            j = int(gain.argmax())
            if gain[j] > best[c]:
                best[c], last[c] = gain[j], j
    return best, last


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 60, columns: int = 48) -> dict[tuple, float]:
    """Fractional numbers of configurations (sorted tuples of item numbers) that cover the histogram.

    Multiplicative weights: a length weighs the less, the more of it is covered already. Each round prices by the
    knapsack; the best configuration, and the best ones that hold one of the least covered lengths, are taken in such
    a number that no length gains more than a `rounds`th part of its count.
    """
    m = len(lengths)
    covered, taken = np.zeros(m), defaultdict(float)
    for r in range(rounds):
        weights = lengths / capacity * np.exp(-4.0 * (covered - covered.min()))
        best, last = _price(lengths, weights, capacity)
        with_item = weights + best[capacity - lengths]
        wanted = np.lexsort((-with_item, np.round(covered * rounds)))[:columns]
        used, drawn = np.zeros(m), []
        for j in wanted.tolist():
            config, room = [j], capacity - int(lengths[j])
            while room > 0:
                k = last[room]
                if k < 0:
                    room -= 1
                    continue
                config.append(int(k))
                room -= int(lengths[k])
            drawn.append(tuple(sorted(config)))
        for c in drawn:
            np.add.at(used, list(c), 1)
        step = 1.0 / (used / counts).max() * max(1, m / columns) / rounds
        step = min(step, 1.0 / (used / counts).max())
        for c in drawn:
            taken[c] += step
        covered += used * step / counts
    scale = float((lengths * counts).sum()) / max(1e-9, sum(x * sum(int(lengths[i]) for i in c) for c, x in taken.items()))
    return {c: x * scale for c, x in taken.items()}


def round_configurations(lengths: np.ndarray, counts: np.ndarray, fractional: dict[tuple, float], capacity: int) -> list[tuple[tuple, int]]:
    """Whole numbers of configurations that use each item exactly as often as it occurs.

    Fractions are carried over in turn, and no item is taken beyond its count; what is left is packed best-fit
    decreasing, where bins of equal content count as one, so the work depends on the number of lengths alone.
    """
    left, carry, packed = counts.astype(np.int64).copy(), 0.0, []
    for c, x in sorted(fractional.items(), key=lambda t: (-t[1], t[0])):
        items, times = np.unique(c, return_counts=True)
        carry += x
        k = min(int(carry), int((left[items] // times).min()))
        carry -= int(carry)
        if k > 0:
            left[items] -= k * times
            packed.append((c, k))
    # Bins with room may take more of what is left.
    rooms: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for c, k in packed:
        rooms[capacity - int(lengths[list(c)].sum())][c] += k
    open_rooms = sorted(rooms)
    import bisect

    def put(room: int, config: tuple, k: int) -> None:
        if room not in rooms or not rooms[room]:
            bisect.insort(open_rooms, room) if room not in open_rooms else None
        rooms[room][config] += k

    for j in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[j]), int(left[j])
        while n > 0:
            at = bisect.bisect_left(open_rooms, size)
            if at == len(open_rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, (j,) * each, n // each)
                    n %= each
                if n:
                    put(capacity - n * size, (j,) * n, 1)
                break
            room = open_rooms[at]
            config, k = next(iter(rooms[room].items()))
            k = min(k, n)
            rooms[room][config] -= k
            if not rooms[room][config]:
                del rooms[room][config]
            if not rooms[room]:
                open_rooms.pop(at)
            put(room - size, (*config, j), k)
            n -= k
    return sorted(((tuple(sorted(c)), k) for group in rooms.values() for c, k in group.items() if k), key=lambda t: (-t[1], t[0]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `capacity`; sequences are filled without gaps.

    Only the histogram of lengths reaches the driver (at most `capacity` rows), and the packing that comes back has a
    size that depends on the number of lengths, not of rows. Rows of one length are numbered within salted groups, so
    a length that many rows share does not meet in one task. Rows that repeat are packed each; the frame's own columns
    may have any name, but its sequence_id and offset are replaced. A length out of range raises ValueError. An empty
    input gives no rows.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = pieces.drop("sequence_id", "offset")
    row, salt, nth, before = (free_name(pieces, c) for c in ("row_no", "salt", "nth", "before"))
    rows = scratch.table(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    histogram = sorted((r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in histogram)
    if total and not 1 <= histogram[0][0] <= histogram[-1][0] <= capacity:
        raise ValueError(f"lengths are 1 to {capacity}")
    lengths, counts = (np.array([h[k] for h in histogram], np.int64) for k in (0, 1))
    groups = round_configurations(lengths, counts, solve_configurations(lengths, counts, capacity) if total else {}, capacity)
    slots, used, sequence = [], defaultdict(int), 0
    for config, k in groups:
        items, times = np.unique(config, return_counts=True)
        place = 0
        for j, each in zip(items.tolist(), times.tolist()):
            slots.append((int(lengths[j]), used[j], each, sequence, place))
            used[j] += k * each
            place += each * int(lengths[j])
        sequence += k
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        begin = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column(nth).to_numpy()
            slot = table[np.searchsorted(begin, (length << 48) + rank, "right") - 1]
            within = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(slot[:, 3] + within // slot[:, 2]), pa.array(slot[:, 4] + within % slot[:, 2] * length)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    salts = max(1, int(total**0.5))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)))
    sums = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    earlier = sums.select("length", salt, (F.sum("n").over(Window.partitionBy("length").orderBy(salt)) - F.col("n")).alias(before))
    numbered = salted.withColumn(nth, F.row_number().over(Window.partitionBy("length", salt).orderBy(row)).cast("long") - 1)
    ranked = numbered.join(earlier, ["length", salt]).withColumn(nth, F.col(nth) + F.col(before))
    out = rows.drop(row)
    return ranked.select(*out.columns, nth).mapInArrow(place, extended(out, "sequence_id long, offset long"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized, into sequences of at most 4096 tokens. Null text is an empty one: its end id only."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(tokenize(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")))
