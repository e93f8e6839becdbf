"""Periodic runs of words: stretches that go on repeating their own beginning, found by minimizers of many scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import extended
from .words import inside, mix, slices, text_bytes, word_hashes, word_spans

#: Words of a run at least, and the first period that minimizers seek (a power of two); shorter ones are compared directly.
LEAST, FIRST_SCALE = 12, 16
_BASE = np.uint64(0xD1342543DE82EF95)
RUN = "struct<start:long,length:long,period:long>"


class _Sums:
    """Running polynomial hashes of a row of words, by which two stretches are compared at once."""

    def __init__(self, words: np.ndarray):
        self.up = np.full(len(words) + 1, _BASE, np.uint64)
        self.up[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        self.run = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[:-1], out=self.run[1:])

    def grams(self, width: int) -> np.ndarray:
        """A hash of the `width` words from each place on."""
        n = len(self.run) - width
        return mix((self.run[width:] - self.run[:n]) * self.up[:n][::-1])

    def same(self, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        """Whether the words from a and from b on are alike (a before b)."""
        return (self.run[a + width] - self.run[a]) * self.up[b - a] == self.run[b + width] - self.run[b]


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each stretch of true values."""
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash in any `width` neighbouring ones, the leftmost of ties. They depend on the window's own
    content alone, so a window that recurs has its minimizer again at the same place in it."""
    bits = np.uint64(max(1, len(grams).bit_length()))
    least, size = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])]


def _seeds(sums: _Sums, owner: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of pairs of equal minimizers of one text whose distance is from scale to 2 * scale - 1.

    A window spans `scale` words at most, so the first period of any run of such a period holds one, and the second the
    same. Equal minimizers closer than half a gram lie in one run of a shorter period, at places that differ by
    multiples of it; they form a cluster, and of two clusters each distance counts once. So a cluster meets eight others
    at most, and short periods do not multiply the pairs.
    """
    gram = scale // 2
    hashes = sums.grams(gram)
    at = _minimizers(hashes, scale - gram + 1)
    key = hashes[at] ^ mix(owner[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    again = key[1:] == key[:-1]
    some = np.append(again, False) | np.append(False, again)
    at, key = at[some], key[some]
    if not len(at):
        return at, at
    gaps = np.diff(at)
    joined = (key[1:] == key[:-1]) & (gaps <= gram // 2)
    heads = np.flatnonzero(np.append(True, ~joined))
    first, last, key = at[heads], at[np.append(heads[1:], len(at)) - 1], key[heads]
    step = np.gcd.reduceat(np.append(0, np.where(joined, gaps, 0)), heads)
    places, periods = [], []
    left, k = np.arange(len(heads) - 1), 0
    while True:
        k += 1
        left = left[left + k < len(heads)]
        left = left[(key[left] == key[left + k]) & (first[np.minimum(left + k, len(heads) - 1)] - last[left] < 2 * scale)]
        if not len(left):
            break
        right = left + k
        by = np.maximum(np.gcd(step[left], step[right]), 1)
        least = first[right] - last[left]
        low = least + np.maximum(0, -((least - scale) // by)) * by
        counts = np.maximum(0, (np.minimum(last[right] - first[left], 2 * scale - 1) - low) // by + 1)
        period = np.repeat(low, counts) + inside(counts) * np.repeat(by, counts)
        periods.append(period)
        places.append(np.maximum(np.repeat(first[left], counts), np.repeat(first[right], counts) - period))
    return (np.concatenate(places), np.concatenate(periods)) if places else (at[:0], at[:0])


def _extended(sums: _Sums, at: np.ndarray, period: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretch around `at` in which each word is the one `period` before or behind."""
    n = len(sums.run) - 1
    right, left = at + period, at.copy()  # ends: of the later copy, and the first of the earlier one
    for bit in reversed(range(longest.bit_length())):
        size = 1 << bit
        fits = np.flatnonzero(right + size <= n)
        fits = fits[sums.same(right[fits] - period[fits], right[fits], size)]
        right[fits] += size
        fits = np.flatnonzero(left >= size)
        fits = fits[sums.same(left[fits] - size, left[fits] - size + period[fits], size)]
        left[fits] -= size
    return left, right


def _confirmed(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches, word by word; one that hashes made too long is sought again by direct comparison."""
    for part in np.array_split(np.arange(len(start)), max(1, int((end - start).sum()) >> 20)):
        sizes = end[part] - start[part] - period[part]
        a = np.repeat(start[part], sizes) + inside(sizes)
        wrong = words[a] != words[a + np.repeat(period[part], sizes)]
        for i in part[np.unique(np.repeat(np.arange(len(part)), sizes)[wrong])]:
            firsts, ends = _stretches(words[period[i] :] == words[: -period[i]])
            k = np.searchsorted(firsts, seed[i], "right") - 1
            start[i], end[i] = firsts[k], ends[k] + period[i]
    return start, end


def find_runs(words: np.ndarray, firsts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    words: hashes of the words of several texts, one text behind the other; firsts: each text's first word, and the
    end. A run is a stretch of at least `least` words and two periods that cannot be made longer with its period, which is
    its smallest. Of stretches with the same ends the smallest period counts: any other is a multiple of it.
    """
    sizes = np.diff(firsts)
    texts = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
    row = mix(texts.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F) << np.uint64(1))  # no two borders of texts are alike
    row[place] = words
    longest, found = int(sizes.max(initial=0)), []
    for period in range(1, min(FIRST_SCALE, longest // 2 + 1)):
        start, end = _stretches(row[period:] == row[:-period])
        keep = end - start >= max(least - period, period)
        found.append((start[keep], end[keep] + period, np.full(keep.sum(), period)))
    sums, scale = _Sums(row), FIRST_SCALE
    while 2 * scale <= longest:
        at, period = _seeds(sums, texts, scale)
        start, end = _extended(sums, at, period, longest)
        keep = end - start >= np.maximum(least, 2 * period)
        start, end, period, at = start[keep], end[keep], period[keep], at[keep]
        _, one = np.unique(start * (2 * scale) + period % scale, return_index=True)
        start, end = _confirmed(row, start[one], end[one], period[one], at[one])
        keep = end - start >= np.maximum(least, 2 * period[one])
        found.append((start[keep], end[keep], period[one][keep]))
        scale *= 2
    start, end, period = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    text = texts[start]
    return text, start - firsts[:-1][text] - text, end - start, period


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, pick: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of the picked words (indexes of spans, `counts` of them for each text), with one space between words."""
    sizes = (ends - starts)[pick]
    last = np.zeros(len(pick), np.int64)
    last[np.cumsum(counts)[counts > 0] - 1] = 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1 - last)])
    out = np.full(begin[-1], 0x20, np.uint8)
    for part in np.array_split(np.arange(len(pick)), max(1, len(pick) >> 17)):
        n, k = sizes[part], inside(sizes[part])
        out[np.repeat(begin[part], n) + k] = raw[np.repeat(starts[pick[part]], n) + k]
    offsets = begin[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, runs: str = "runs", collapsed: str = "collapsed_text") -> DataFrame:
    """Adds two columns: `runs`, an array of (start, length, period) in words from 0, by start and period, and
    `collapsed`, the words that lie in no run after its first period, with one space between.

    Words are compared by 64-bit hashes. No row is moved or compared with another. A null, empty or wordless text has no
    runs and an empty collapsed text; rows that repeat each get their own result; an empty table gives none. A long text
    is searched whole, in time of about n log n. Other columns stay as they are; one with an added name is replaced.
    """
    if text in (runs, collapsed):
        raise ValueError("the text's column would be replaced")
    df = df.drop(runs, collapsed)
    schema = extended(df, f"`{runs}` array<{RUN}>, `{collapsed}` string")
    kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                raw, offsets = text_bytes(b.column(text))
                starts, ends, firsts = word_spans(raw, offsets)
                owner, start, length, period = find_runs(word_hashes(raw, starts, ends), firsts, least)
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, firsts[owner] + start + period, 1)
                np.add.at(cover, firsts[owner] + start + length, -1)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                counts = np.diff(np.searchsorted(kept, firsts))
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([*b.columns, lists, joined(raw, starts, ends, kept, counts)], names=[*b.schema.names, runs, collapsed])

    return df.mapInArrow(search, schema)


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of each text; where h is divisible by 10, those from word a on repeat p of them."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, offsets = text_bytes(b.column("text"))
                starts, ends, firsts = word_spans(raw, offsets)
                pick = np.arange(len(starts))
                for i, h in enumerate(b.column("h").to_pylist()):
                    n, g = int(firsts[i + 1] - firsts[i]), (h or 0) // 10
                    if h is not None and h % 10 == 0 and n:
                        a = g % n
                        own = np.arange(n - a)
                        pick[firsts[i] + a : firsts[i + 1]] = firsts[i] + a + own % (1 + (n - a) // (3 + g % 8))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), joined(raw, starts, ends, pick, np.diff(firsts))], names=["doc_id", "text"])

    return docs.mapInArrow(plant, docs.select("doc_id", "text").schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, of which a tenth gets a planted one (by its id; none where the id is null)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    found = periodic_runs(_planted(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.n"), F.col("best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
