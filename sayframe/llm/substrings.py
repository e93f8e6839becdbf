"""Removal of word runs that occur elsewhere, by sharded Aho-Corasick automata over confirmed passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import Scratch, shuffle_partitions
from .words import frequent_hashes, joined_words, mix, ranked, run_hashes, slices, text_bytes, word_hashes, word_spans

WIDTH = 35
GRAM = 8
#: A gram is frequent from a 2^18th part of all grams on, so there are at most as many; any such list gives the same result.
FREQUENT = 1 << 18
#: Bytes of passages in one automaton, of stretches that are confirmed at once, and of stretches that one task streams.
SHARD_BYTES, GROUP_BYTES, STREAM_BYTES = 1 << 20, 2 << 20, 32 << 20
_RUNS = "array<struct<anchor:long,first:int,last:int>>"
_SALT = np.uint64(0x51ED270B27F5A4C1)


def _grams(texts: pa.Array, gram: int) -> np.ndarray:
    raw, offsets = text_bytes(texts)
    starts, ends, firsts = word_spans(raw, offsets)
    h = run_hashes(word_hashes(raw, starts, ends), gram)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    return h[text[: len(h)] == text[gram - 1 :]] if len(h) else h


def anchor_runs(hashes: np.ndarray, firsts: np.ndarray, width: int, gram: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: owner (text number), anchor hash, first and last window of the text.

    A window's anchor is its first word gram in a fixed order of all grams (the leftmost of equal ones), so equal windows
    have equal anchors. Frequent grams come last in that order, hence a line that very many texts share anchors no
    window that holds anything else.
    """
    n = len(hashes) - width + 1
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    starts = np.flatnonzero(text[:n] == text[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    grams, span = run_hashes(hashes, gram), width - gram + 1
    rank = ranked(grams, frequent)
    order = np.where(rank > 0, rank | np.uint64(1 << 63), grams >> np.uint64(1))
    at = np.empty(n, np.int64)
    for a in range(0, n, 1 << 18):
        view = sliding_window_view(order[a : min(n, a + (1 << 18)) + span - 1], span)
        at[a : a + len(view)] = view.argmin(axis=1) + np.arange(a, a + len(view))
    at = at[starts]
    new = np.ones(len(starts), np.bool_)
    new[1:] = (at[1:] != at[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(starts)]]) - 1
    owner = text[starts[head]]
    return owner, grams[at[head]].astype(np.int64), starts[head] - firsts[owner], starts[tail] - firsts[owner]


def _scan(df: DataFrame, width: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """(key, id, n_words, words_sha256, runs) of each (key, id, text)."""
    schema = f"key binary, id {df.schema['id'].dataType.simpleString()}, n_words long, words_sha256 string, runs {_RUNS}"
    held = df.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent).astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, offsets = text_bytes(b.column("text"))
                starts, ends, firsts = word_spans(raw, offsets)
                owner, anchor, first, last = anchor_runs(word_hashes(raw, starts, ends), firsts, width, gram, held.value)
                data, begin = joined_words(raw, starts, ends)
                shas = [hashlib.sha256(data[x : max(x, y - 1)]).hexdigest() for x, y in zip(begin[firsts[:-1]].tolist(), begin[firsts[1:]].tolist())]
                each = np.searchsorted(owner, np.arange(len(offsets)))
                lists = pa.ListArray.from_arrays(
                    pa.array(each.astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(anchor), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["anchor", "first", "last"]),
                )
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(np.diff(firsts)), pa.array(shas, pa.string()), lists], names=["key", "id", "n_words", "words_sha256", "runs"])

    return df.select("key", "id", "text").mapInArrow(run, schema)


def _stretches(df: DataFrame, width: int) -> DataFrame:
    """Of each (key, n, text, runs): the words of each run of windows, joined by single spaces."""
    schema = "key binary, n long, anchor long, first int, words string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, offsets = text_bytes(b.column("text"))
                starts, ends, firsts = word_spans(raw, offsets)
                data, begin = joined_words(raw, starts, ends)
                lists = b.column("runs")
                flat = lists.flatten()
                owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                anchor, first, last = (flat.field(k).to_numpy() for k in range(3))
                at, end = firsts[owner] + first, firsts[owner] + last + width
                words = [data[x : y - 1] for x, y in zip(begin[at].tolist(), begin[end].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(owner)), pa.array(b.column("n").to_numpy()[owner]), pa.array(anchor), pa.array(first), pa.array(words, pa.binary()).cast(pa.string())], names=schema.replace(",", "").split()[::2])

    return df.select("key", "n", "text", "runs").mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, text: str, limit: int) -> Iterator[pa.Table]:
    """Tables of whole groups (runs of equal long keys), each of about `limit` bytes unless one group has more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for b in slices(batch, text, limit):
            k = b.column(key).to_numpy()
            if size >= limit and held:
                last = held[-1].column(key)[held[-1].num_rows - 1].as_py()
                cut = int(np.flatnonzero(k != last)[0]) if (k != last).any() else len(k)
                if cut:
                    held.append(b.slice(0, cut))
                if cut < len(k):
                    yield pa.Table.from_batches(held)
                    held, size, b = [], 0, b.slice(cut)
                else:
                    continue
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)


def recurring_runs(texts: pa.Array, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end): the longest word runs of each text all whose windows occur at least twice among the texts, a
    text counting as often as its weight. Windows are told apart by 128 bits."""
    raw, offsets = text_bytes(texts)
    starts, ends, firsts = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    one = run_hashes(h, width)
    valid = np.flatnonzero(text[: len(one)] == text[width - 1 :]) if len(one) else np.zeros(0, np.int64)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3
    two = run_hashes(mix(h + _SALT), width)[valid]
    _, first, which = np.unique(one[valid], return_index=True, return_inverse=True)
    if (two != two[first][which]).any():
        _, which = np.unique(np.stack([one[valid], two], axis=1), axis=0, return_inverse=True)
        which = which.ravel()
    good = valid[np.bincount(which, weights[text[valid]])[which] >= 2]
    new = np.ones(len(good), np.bool_)
    new[1:] = (np.diff(good) != 1) | (text[good[1:]] != text[good[:-1]])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(good)]]).astype(np.int64) - 1
    owner = text[good[head]]
    return owner, good[head] - firsts[owner], good[tail] + width - firsts[owner]


def confirmed_passages(stretches: DataFrame, width: int) -> DataFrame:
    """(anchor, words): distinct recurring passages of (anchor, words, total), which lie in whole groups by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "anchor", "words", GROUP_BYTES):
            t = t.combine_chunks()
            owner, begin, end = recurring_runs(t.column("words").chunk(0), t.column("total").to_numpy().astype(np.float64), width)
            anchors, words = t.column("anchor").to_numpy()[owner].tolist(), t.column("words").take(pa.array(owner)).to_pylist()
            found = dict.fromkeys((a, " ".join(w.split(" ")[x:y])) for a, w, x, y in zip(anchors, words, begin.tolist(), end.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], names=["anchor", "words"])

    return stretches.select("anchor", "words", "total").mapInArrow(run, "anchor long, words string")


class PassageAutomaton:
    """An Aho-Corasick automaton over the characters of passages, each with a space before and behind."""

    def __init__(self):
        import ahocorasick

        self.automaton, self.ready = ahocorasick.Automaton(), False

    def add(self, passage: str) -> None:
        self.automaton.add_word(f" {passage} ", (len(passage) + 2, passage.count(" ") + 1))

    def ranges(self, words: str) -> list[tuple[int, int]]:
        """Word ranges of the text (words joined by single spaces) that passages cover."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        out: list[tuple[int, int]] = []
        if not len(self.automaton):
            return out
        spaced = f" {words} "
        for end, (size, n) in self.automaton.iter(spaced):
            lo = spaced.count(" ", 0, end - size + 1)
            hi = lo + n
            while out and out[-1][1] >= lo:
                p = out.pop()
                lo, hi = min(lo, p[0]), max(hi, p[1])
            out.append((lo, hi))
        return out


def locate(passages: DataFrame, stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, begin, end): where passages occur in stretches (key, anchor, first, words), in words of the whole text.

    Passages are dealt by anchor to shards of about SHARD_BYTES, with one automaton each, and a text's stretches to the
    shards of their anchors. A shard whose stretches exceed STREAM_BYTES is served by several tasks, each with the
    shard's automaton, so what is copied is always small against what a task streams.
    """
    total = passages.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    shards = total // SHARD_BYTES + 1
    shard = F.pmod(F.xxhash64("anchor", F.lit(11)), F.lit(shards)).alias("shard")
    dealt = stretches.select(shard, "key", "first", "words")
    tasks = F.ceil(F.sum(F.octet_length("words")) / STREAM_BYTES).cast("int")
    wide = scratch.table(dealt.groupBy("shard").agg(tasks.alias("tasks")).where("tasks > 1"), "wide")
    one = F.coalesce("tasks", F.lit(1))
    kept = passages.select(shard, "words").join(wide, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("first"), "words")
    read = dealt.join(wide, "shard", "left").select("shard", F.pmod(F.hash("key", "first"), one).alias("salt"), "key", "first", "words")
    both = kept.unionAll(read).repartition(shuffle_partitions(passages.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", F.asc_nulls_first("key"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, automaton = None, None
        last, held = None, []

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["key", "begin", "end"])

        out: list = []
        for batch in batches:
            for b in slices(batch, "words"):
                for shard_no, salt, key, first, words in zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "key", "first", "words"))):
                    if place != (shard_no, salt):
                        place, automaton = (shard_no, salt), PassageAutomaton()
                    if key is None:
                        automaton.add(words)
                        continue
                    if key != last:
                        out += [(last, x, y) for x, y in held]
                        last, held = key, []
                    for x, y in automaton.ranges(words):
                        lo, hi = first + x, first + y
                        while held and held[-1][1] >= lo:
                            p = held.pop()
                            lo, hi = min(lo, p[0]), max(hi, p[1])
                        held.append((lo, hi))
                yield emit(out)
                out = []
        yield emit([(last, x, y) for x, y in held])

    return both.mapInArrow(run, "key binary, begin int, end int")


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.unhex(F.md5(whole)).alias("key"), F.col(key).alias("id"), whole.alias("text"))


def find_repeats(df: DataFrame, key: str, text: str, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts, and the repeated word ranges of those that hold some.

    Classes: key (MD5 of the text), id (least of the class), n (rows), n_words, words_sha256. Ranges: key, ranges
    (array of begin, end in words).

    Each window of `width` words is anchored at one of its grams of `gram` words (see anchor_runs); only windows with
    anchors that occur twice can recur. The words around such anchors, equal ones summed, are grouped by anchor; runs
    of windows that are met twice are the confirmed passages, and are written to a shared table. Automata compiled
    from its shards then search all texts (see locate). A text that occurs twice is treated like any other: all its
    windows recur. Null texts are empty ones.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = _keyed(df, key, text)
    frequent = frequent_hashes(docs.select("text"), lambda t: _grams(t, gram), FREQUENT, scratch)
    classes = _scan(docs, width, gram, frequent).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("words_sha256").alias("words_sha256"), F.first("runs").alias("runs"))
    classes = scratch.table(classes, "classes", grows=True)
    anchors = classes.select("key", "n", F.inline("runs"))
    often = scratch.table(anchors.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"), "often", grows=True)  # a table, so that the join's own exchange can split an anchor
    hits = anchors.join(often, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
    hits = scratch.table(hits.join(classes.select("key", "id", "n"), "key"), "hits", grows=True)
    met = docs.join(hits.select("key", "n", "runs", F.col("id").alias("least")), (docs["key"] == hits["key"]) & docs["id"].eqNullSafe(F.col("least"))).select(docs["key"], "n", "text", "runs")
    stretches = scratch.table(_stretches(met, width), "stretches")
    scratch.drop("hits")
    distinct = stretches.groupBy("anchor", "words").agg(F.sum("n").alias("total"))
    grouped = distinct.repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor")
    passages = scratch.table(confirmed_passages(grouped, width), "passages")
    covered = locate(passages, stretches, scratch)
    ranges = scratch.table(covered.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges")), "ranges", grows=True)
    scratch.drop("stretches")
    return classes.drop("runs"), ranges


def _kept_mask(n: int, ranges) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if len(ranges):
        np.add.at(edge, ranges[:, 0], 1)
        np.add.at(edge, ranges[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def without_ranges(df: DataFrame) -> DataFrame:
    """(key, n_removed, kept_sha256, kept_text) of each (key, text, ranges). kept_sha256 is that of the kept words
    joined by single spaces; kept_text keeps the white space that followed each kept word."""
    schema = "key binary, n_removed long, kept_sha256 string, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, offsets = text_bytes(b.column("text"))
                starts, ends, firsts = word_spans(raw, offsets)
                data, lists, rows = raw.tobytes(), b.column("ranges"), []
                flat = lists.flatten()
                pairs = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1)
                cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                for i, key in enumerate(b.column("key").to_pylist()):
                    f, g = int(firsts[i]), int(firsts[i + 1])
                    keep = np.flatnonzero(_kept_mask(g - f, pairs[cuts[i] : cuts[i + 1]])) + f
                    follow = np.concatenate([starts[f + 1 : g], offsets[i + 1 : i + 2]])
                    words = b" ".join([data[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())])
                    rest = b"".join([data[x:y] for x, y in zip(starts[keep].tolist(), follow[keep - f].tolist())])
                    rows.append((key, g - f - len(keep), hashlib.sha256(words).hexdigest(), rest.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string(), pa.string()))], names=["key", "n_removed", "kept_sha256", "kept_text"])

    return df.select("key", "text", "ranges").mapInArrow(run, schema)


def remove_repeats(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """One row for each class of equal texts: key (MD5 of the text), n_words, n_removed, kept_sha256, and kept_text
    (null where nothing is removed; then the text stays as it is). Rows of `df` belong to the class of their text's MD5.

    Rows with equal texts, repeated rows included, share a class; null and empty texts are one class without words. Only
    the two named columns are read, so others may have any name. An empty table gives no rows.
    """
    classes, ranges = find_repeats(df, key, text, width)
    docs = _keyed(df, key, text)
    cut = ranges.join(classes.select("key", F.col("id").alias("least")), "key")
    texts = docs.join(cut.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))).select("key", "text", "ranges")
    part = without_ranges(texts).dropDuplicates(["key"])  # a row may be there twice
    return classes.join(part, "key", "left").select("key", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"), "kept_text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without words in windows of 35 that also start elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    result = Scratch(spark, "kept").table(remove_repeats(docs, "doc_id", "text").drop("kept_text"), "classes", grows=True)
    return _keyed(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "key").join(result, "key").drop("key")
