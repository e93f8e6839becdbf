"""SimHash fingerprints of whole texts, and a search for all fingerprints within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import extended, shuffle_partitions
from .words import mix, slices, text_bytes, word_hashes, word_spans

BITS = 128
#: Four 16-bit counters in a 64-bit number, one for each bit of a nibble.
_LANES = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)
_STRETCH = 60_000  # terms that one sum may hold, so that no counter overflows


def term_votes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes for each bit, and their number, of each text. Terms are pairs of neighbouring words, as often as they
    occur (the weight); a text of one word has that word as its term; a text without words has no votes."""
    starts, ends, firsts = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    n = np.diff(firsts)
    follows = np.ones(len(h), np.bool_)
    follows[firsts[1:][n > 0] - 1] = False  # the last word of a text starts no pair
    nxt = np.roll(h, -1)
    terms = np.where(follows, mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt), mix(h))
    keep = follows.copy()
    keep[firsts[:-1][n == 1]] = True
    counts = np.where(n == 1, 1, np.maximum(n - 1, 0))
    terms = terms[keep]
    # Stretches of at most _STRETCH terms of one text.
    pieces = -(-counts // _STRETCH)
    owner = np.repeat(np.arange(len(counts)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(counts) - counts)[owner] + within * _STRETCH
    votes = np.zeros((len(counts), BITS), np.int64)
    if len(begin):
        for word in range(BITS // 64):
            value = mix(terms + np.uint64(word) * np.uint64(0xD6E8FEB86659FD93))
            for nibble in range(16):
                sums = np.add.reduceat(_LANES[(value >> np.uint64(4 * nibble)) & np.uint64(15)], begin)
                for b in range(4):
                    np.add.at(votes, (owner, 64 * word + 4 * nibble + b), ((sums >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64))
    return votes, counts


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of BITS / 8 bytes for each text: a bit is set where more than half of the term hashes have it."""
    raw, offsets = text_bytes(texts)
    votes, counts = term_votes(raw, offsets)
    return np.packbits(2 * votes > counts[:, None], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of the term vectors, 0 to 1, from the share of bits that differ."""
    return np.maximum(0.0, np.cos(np.pi * np.bitwise_count(a ^ b).sum(axis=1) / BITS))


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the hexadecimal fingerprint of each text. Null counts as an empty text, whose fingerprint is all zeros;
    equal texts have equal fingerprints. A column of the same name is replaced."""
    df = df.drop(name) if name != text else df
    schema = extended(df, f"`{name}` string")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                prints = pa.array([x.tobytes().hex() for x in fingerprints(b.column(text))], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, name])

    return df.mapInArrow(add, schema)


def near_fingerprints(queries: DataFrame, table: DataFrame, key: str, radius: int = 3, fingerprint: str = "fingerprint") -> DataFrame:
    """Pairs (query_fingerprint, fingerprint, distance) of distinct fingerprints within the radius; equal ones are not
    pairs, their rows are found by an equality join.

    Permuted block tables: the bits are cut into radius + 1 + 3 blocks, and each table leads with four blocks of
    which two fingerprints within the radius must agree in at least one choice; here a table is keyed by one choice
    of four blocks' bits. Only distinct fingerprints enter, so copies cost nothing. Null fingerprints match nothing.
    """
    from itertools import combinations

    lead = 4
    blocks = radius + lead
    width = BITS // 4
    edges = [i * width // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), lead))
    col = F.col("fp")
    parts = [F.substring(col, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
    keys = F.posexplode(F.array(*[F.concat(*[parts[i] for i in c]) for c in choices])).alias("which", "lead")
    left = queries.select(F.col(fingerprint).alias("fp")).dropna().distinct().select(F.col("fp").alias("query_fingerprint"), keys)
    right = table.select(F.col(fingerprint).alias("fp")).dropna().distinct().select("fp", keys)
    pairs = left.join(right, ["which", "lead"]).where("query_fingerprint <> fp").select("query_fingerprint", F.col("fp").alias("fingerprint"))
    diff = lambda k: F.bit_count(F.conv(F.substring("query_fingerprint", k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("fingerprint", k, 8), 16, 10).cast("long")))
    distance = sum((diff(k) for k in range(9, width, 8)), diff(1))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= radius).distinct()


def _with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """Rows (range_no, is_edge, doc_id, text) in `ranges` partitions by descending doc_id; each range ends with a copy
    of the row that starts the next one (after the last: the first), marked is_edge."""
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")).first()["cuts"] if ranges > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    n = len(cuts) + 2  # the last range is for null ids
    number = F.when(F.col("doc_id").isNull(), n - 1).otherwise(F.expr(f"size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> doc_id < c))") if cuts else F.lit(0)).cast("int")
    ranged = docs.select(number.alias("range_no"), F.lit(False).alias("is_edge"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tops = sorted(ranged.groupBy("range_no").agg(F.max("doc_id").alias("doc_id")).collect())
    if not tops:
        return ranged, n
    heads = spark.createDataFrame([(r["doc_id"], r["range_no"], tops[i - 1]["range_no"]) for i, r in enumerate(tops)], "top long, of int, range_no int")
    edges = ranged.drop("range_no").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("of", "range_no").agg(F.max("text").alias("text"), F.first("top").alias("doc_id"))
    return ranged.unionByName(edges.select("range_no", F.lit(True).alias("is_edge"), "doc_id", "text")), n


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness to those and to the next document's.

    Rows are ordered by descending doc_id (null ids last; repeated ids by descending text), in range partitions with
    a copy of the neighbour's first row, so each text is shuffled once and no task sees all rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranged, n = _with_next(docs, 4 * shuffle_partitions(spark))
    ordered = ranged.repartitionById(n, "range_no").sortWithinPartitions("range_no", "is_edge", F.desc_nulls_last("doc_id"), F.desc("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def describe(held: pa.RecordBatch) -> pa.RecordBatch:
        """All rows but the last, each with the one after it."""
        texts = held.column("text").to_pylist()
        edited = [t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] for t, nxt in zip(texts, texts[1:])]
        whole, other = fingerprints(held.column("text")), fingerprints(pa.array(edited, pa.large_string()))
        size = len(edited)
        out = pa.RecordBatch.from_arrays(
            [
                held.column("doc_id").slice(0, size),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([x.tobytes().hex() for x in whole[:-1]], pa.string()),
                pa.array([x.tobytes().hex() for x in other], pa.string()),
                pa.array(likeness(whole[:-1], other)),
                pa.array(likeness(whole[:-1], whole[1:])),
            ],
            names=schema.replace(",", "").split()[::2],
        )
        return out.filter(pa.array(~held.column("is_edge").to_numpy(zero_copy_only=False)[:size]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch, "text"):
                held = part if last is None else pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0]
                last = held.slice(held.num_rows - 1)
                if held.num_rows > 1:
                    yield describe(held)

    return ordered.mapInArrow(run, schema)
