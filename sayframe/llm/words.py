"""Words of whole texts as numpy arrays: boundaries and 64-bit hashes without a Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import Scratch

#: Words are maximal runs of bytes other than the ASCII white space x20, x09-x0D.
SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text; a longer text stands alone and whole."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array, and each text's first place there (and the end); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word, and each text's first word (and the end)."""
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, np.bool_)  # a text starts or ends before this byte
    edge[offsets] = True
    before = np.empty(len(raw), np.bool_)
    after = np.empty(len(raw), np.bool_)
    if len(raw):
        before[0], before[1:] = True, ~solid[:-1]
        after[-1], after[:-1] = True, ~solid[1:]
        before |= edge[:-1]
        after |= edge[1:]
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of a running polynomial, then mixed with the length."""
    if not _powers or len(_powers[0]) < len(raw) + 1:
        n = max(len(raw) + 1, SLICE_BYTES + (SLICE_BYTES >> 3))
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n <= 4 * SLICE_BYTES:
            _powers[:] = both
    else:
        both = _powers
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * both[0][: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * both[1][starts] + (ends - starts).astype(np.uint64) * _BASE)


def give_back() -> None:
    """Returns freed memory to the system, which else keeps what the largest step took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def inside(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    firsts = np.cumsum(counts) - counts
    return np.arange(counts.sum(), dtype=np.int64) - np.repeat(firsts, counts)


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words of one text, and each text's first run (and the end).

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    n = np.diff(firsts)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), counts)
    at = firsts[:-1][owner] + inside(counts)
    last = firsts[1:][owner]
    out = np.full(len(at), width, np.uint64)
    for k in range(width):
        have = at + k < last
        out = np.where(have, mix(out * _BASE + hashes[np.minimum(at + k, max(0, len(hashes) - 1))]), out) if len(hashes) else out
    return mix(out), np.concatenate([[0], np.cumsum(counts)])


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive entries (of whatever text; the caller leaves out those that cross a border)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = np.full(len(h), _BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, _BASE_INVERSE, np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mix((run[width:] - run[:n]) * down)


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with a space behind each, and each word's first place there (and the end)."""
    sizes = ends - starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(begin[-1], 0x20, np.uint8)
    out[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = raw[~SPACE[raw]]
    return out.tobytes(), begin


def frequent_hashes(texts: DataFrame, hashes: Callable[[pa.Array], np.ndarray], bound: int, scratch: Scratch) -> np.ndarray:
    """The frequent values of `hashes` over all texts, the least frequent first: those that are a `bound`th part or
    more of all values, so at most `bound` of them reach the driver. A text slice hands on values that it has thrice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                all_of_slice = hashes(b.column("text"))
                values, n = np.unique(all_of_slice, return_counts=True)
                often = n >= 3
                arrays = [pa.array(np.append(values[often].astype(np.int64), 0)), pa.array(np.append(n[often], len(all_of_slice))), pa.array(np.append(np.ones(often.sum(), np.bool_), False))]
                yield pa.RecordBatch.from_arrays(arrays, names=["value", "n", "real"])

    counts = scratch.table(texts.mapInArrow(run, "value long, n long, real boolean").groupBy("value", "real").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("NOT real").agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("real") & (F.col("n") * bound >= total)).select("value", "n").toArrow()
    values, n = found["value"].to_numpy(), found["n"].to_numpy()
    return values[np.lexsort((values, n))].astype(np.uint64)


def ranked(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1, 2, ... for frequent values (sorted values, place of each in the order), 0 for others."""
    known, place = frequent
    if not len(known) or not len(values):
        return np.zeros(len(values), np.uint64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, place[at] + np.uint64(1), np.uint64(0))
