"""Toxicity by the nearest labelled examples: exact cosine of TF-IDF vectors through a block-max inverted index."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .storage import extended
from .words import _BASE, _BASE_INVERSE, _BYTE_VALUES, LOWER, SLICE_BYTES, give_back, mix, slices, text_bytes

#: Bound of the fitted part: examples of each label. Held-out quality is the same for 1,024, 2,048 and 4,096 (see the README); the time of a search grows with it.
EXAMPLES = 2048
#: Bounds of an id in the fitted part: different texts, those of least MD5 where it has more, and distinct terms of each,
#: those of least hash where a text has more.
TEXTS_OF_ID, EXAMPLE_TERMS = 8, 1 << 14
NEIGHBOURS, SMOOTH, SHRINK = 15, 1.0, 4.0
#: Examples of a block of the index, and of each half and label that calibrate.
EXAMPLE_BLOCK, CALIBRATION = 256, 256
#: Terms that are held as full rows at most, and texts that are multiplied with them at once.
DENSE, BLOCK = 1024, 128
THRESHOLD = 0.3
#: Words are runs of letters, digits and bytes over 127; a term is a word, or the first 4, 5 or 6 bytes of a longer one.
_WORD = np.zeros(256, np.bool_)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PREFIXES = (4, 5, 6)


def text_terms(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of each text's distinct terms, sorted by text and term; only those in `wanted` (sorted), if given."""
    solid = _WORD[raw]
    edge = np.zeros(len(raw) + 1, np.bool_)
    edge[offsets] = True
    before, after = np.ones(len(raw), np.bool_), np.ones(len(raw), np.bool_)
    if len(raw):
        before[1:], after[:-1] = ~solid[:-1] | edge[1:-1], ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    up, down = (np.full(len(raw) + 1, b, np.uint64) for b in (_BASE, _BASE_INVERSE))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[LOWER[raw]] * up[: len(raw)], out=run[1:])
    owner = np.searchsorted(offsets, starts, "right") - 1
    maybe = None
    if wanted is not None:
        maybe = np.zeros(1 << 20, np.bool_)
        maybe[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    texts, terms, places = [], [], []
    for size in (0, *_PREFIXES):
        pick = slice(None) if not size else ends - starts > size
        a, b, o = starts[pick], (ends[pick] if not size else starts[pick] + size), owner[pick]
        h = mix((run[b] - run[a]) * down[a] + np.uint64((size + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        if maybe is not None:
            keep = maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            h, o = h[keep], o[keep]
            place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            keep = wanted[place] == h if len(wanted) else np.zeros(0, np.bool_)
            o = o[keep]
            places.append(o * max(1, len(wanted)) + place[keep])
            continue
        texts.append(o)
        terms.append(h)
    if wanted is not None:
        both = np.concatenate(places)
        both.sort()
        first = np.flatnonzero(np.diff(both, prepend=-1))
        text, place = np.divmod(both[first], max(1, len(wanted)))
        return text, wanted[place], np.diff(np.concatenate([first, [len(both)]]))
    text, term = np.concatenate(texts), np.concatenate(terms)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.ones(len(text), np.bool_)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return text[first], term[first], np.diff(np.concatenate([first, [len(text)]]))


def unit_vectors(text: np.ndarray, col: np.ndarray, times: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Weights of terms in each of n texts, as unit vectors: (1 + log(times)) * value."""
    w = (1 + np.log(times)) * value[col]
    norm = np.sqrt(np.bincount(text, w * w, n))
    return w / np.where(norm > 0, norm, 1)[text]


def alike_order(common: np.ndarray, size: int) -> np.ndarray:
    """An order of the columns in which neighbours are alike: split at the median of the direction, out of the strongest
    ones, along which a part spreads most, until a part has at most `size` columns."""
    if not common.shape[0] or common.shape[1] <= size:
        return np.arange(common.shape[1])
    strongest = np.linalg.eigh((common @ common.T).astype(np.float64))[1][:, -8:]
    along, done, todo = common.T @ strongest, [], [np.arange(common.shape[1])]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        part = part[np.argsort(along[part, along[part].var(axis=0).argmax()], kind="stable")]
        middle = len(part) // 2 // size * size or size
        todo += [part[middle:], part[:middle]]
    return np.concatenate(done)


class ExampleIndex:
    """A block-max inverted index over all terms of labelled examples.

    Examples that are alike lie in one block of EXAMPLE_BLOCK, and each term has its largest weight in each block. The
    sum of these over a text's terms bounds its cosine to every example of a block. A text is compared with its most
    promising blocks first, and then with the blocks alone whose bound reaches the k-th best cosine so far, so the k
    nearest examples are exact. At most DENSE of the most common terms are rows of a matrix, the rest are postings.

    The matrix product is in single precision. For the k best, and those that rounding leaves in doubt, its part of the
    cosine is summed again term by term, so results do not depend on how texts are dealt. Ties go to the example that
    comes first in the index.
    """

    def __init__(self, terms: np.ndarray, value: np.ndarray, labels: np.ndarray, ids, weight: np.ndarray, text: np.ndarray, col: np.ndarray, times: np.ndarray):
        n = len(labels)
        self.terms, self.value, self.dense = terms, value, None
        w = unit_vectors(text, col, times, value, n).astype(np.float32)
        many = np.bincount(col, minlength=len(terms))
        common = np.argsort(-many, kind="stable")[:DENSE]
        common = common[many[common] * 32 >= n]
        self.slot = np.full(len(terms), -1, np.int32)
        self.slot[common] = np.arange(len(common))
        rows = np.flatnonzero(self.slot[col] >= 0)
        matrix = np.zeros((len(common), n), np.float32)
        matrix[self.slot[col[rows]], text[rows]] = w[rows]
        order = alike_order(matrix, EXAMPLE_BLOCK)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        text = place[text]
        self.labels, self.weight, self.ids = labels[order], weight[order], [ids[i] for i in order.tolist()]
        self.base = float((weight * labels).sum() / weight.sum()) if n else 0.0
        self.line: tuple[float, float] | None = None  # slope and shift of the calibration
        self.common, self.blocks = len(common), -(-n // EXAMPLE_BLOCK)
        self.by_slot, self.by_slot_text, self.by_slot_w = self.slot[col[rows]], text[rows].astype(np.int32), w[rows]
        rows = np.flatnonzero(self.slot[col] < 0)
        rows = rows[np.lexsort((text[rows], col[rows]))]
        self.postings = np.empty(len(rows), [("text", np.int32), ("w", np.float32)])  # side by side, to be read at once
        self.postings["text"], self.postings["w"] = text[rows], w[rows]
        # Block maxima: an entry for each term and block, with the block's postings.
        key = col[rows].astype(np.int64) * self.blocks + text[rows] // EXAMPLE_BLOCK
        self.first = np.flatnonzero(np.diff(key, prepend=-1)).astype(np.int32)
        self.tops = np.empty(len(self.first), [("block", np.int32), ("w", np.float32)])
        self.tops["block"] = key[self.first] % max(1, self.blocks)
        self.tops["w"] = np.maximum.reduceat(self.postings["w"], self.first) if len(self.first) else np.zeros(0, np.float32)
        self.size = np.diff(np.append(self.first, len(rows))).astype(np.int32)
        self.entry = np.searchsorted(key[self.first], np.arange(len(terms) + 1) * self.blocks).astype(np.int32)

    def _matrices(self) -> None:
        """The common terms' rows, and their block maxima; made in the worker, as they are sent more cheaply as lists."""
        self.dense = np.zeros((self.blocks, self.common, EXAMPLE_BLOCK), np.float32)
        self.dense[self.by_slot_text // EXAMPLE_BLOCK, self.by_slot, self.by_slot_text % EXAMPLE_BLOCK] = self.by_slot_w
        self.dense_top = np.ascontiguousarray(self.dense.max(axis=2).T)

    def _postings(self, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
        size = self.size[entries]
        place = np.repeat(self.first[entries] - (np.cumsum(size, dtype=np.int32) - size), size)
        place += np.arange(len(place), dtype=np.int32)
        found = self.postings.view(np.int64)[place].view(self.postings.dtype)
        return np.bincount(found["text"], np.repeat(weights, size) * found["w"], self.blocks * EXAMPLE_BLOCK)

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector (columns, weights) the k examples of the largest positive cosine, best first."""
        if not self.blocks:
            yield from [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
            return
        if self.dense is None:
            self._matrices()
        for at in range(0, len(queries), BLOCK):
            yield from self._batch(queries[at : at + BLOCK], k)

    def _batch(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, width = len(queries), EXAMPLE_BLOCK
        asked = np.zeros((m, self.common), np.float32)
        lists, bound = [], np.zeros((m, self.blocks), np.float64)
        for i, (cols, weights) in enumerate(queries):
            slot = self.slot[cols]
            asked[i, slot[slot >= 0]] = weights[slot >= 0]
            first, many = self.entry[cols], self.entry[cols + 1] - self.entry[cols]
            entries = np.repeat(first - (np.cumsum(many, dtype=np.int32) - many), many)
            entries += np.arange(len(entries), dtype=np.int32)
            each = np.repeat(weights.astype(np.float32), many)
            tops = self.tops.view(np.int64)[entries].view(self.tops.dtype)
            lists.append((entries, each, tops["block"]))
            bound[i] = np.bincount(tops["block"], each * tops["w"], self.blocks)
        bound += asked @ self.dense_top + 1e-5
        first = -(-self.blocks // 16)
        wanted = bound >= np.partition(bound, -first, axis=1)[:, -first:][:, :1]
        about = np.empty((m, self.blocks, width), np.float32)
        found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(m)]
        least = np.zeros(m)
        for step in range(2):
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                about[rows, b] = asked[rows] @ self.dense[b]
            for i in np.flatnonzero(wanted.any(axis=1)):
                entries, each, blocks = lists[i]
                mine, some = wanted[i][blocks], np.flatnonzero(wanted[i])
                rare = self._postings(entries[mine], each[mine]).reshape(-1, width)[some].ravel()
                names = (some[:, None] * width + np.arange(width)).ravel()
                found[i].append((names, about[i, some].ravel() + rare, rare))
                if step == 0 and len(names) >= k:
                    least[i] = max(0.0, np.partition(found[i][0][1], -k)[-k])
            wanted = (bound >= least[:, None] - 1e-5) & ~wanted
        for (cols, weights), parts in zip(queries, found):
            names, score, rare = (np.concatenate(x) for x in zip(*parts))
            kth = np.partition(score, -k)[-k] if len(score) > k else 0.0
            near = np.flatnonzero((score > 0) & (score >= kth - 1e-5))
            names, slot = names[near], self.slot[cols]
            mine = self.dense[names[:, None] // width, slot[slot >= 0], names[:, None] % width]
            cosine = rare[near] + (mine * weights[slot >= 0]).sum(axis=1)
            best = np.lexsort((names, -cosine))[:k]
            yield names[best], cosine[best]

    def nearest(self, cols: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return next(self.nearest_many([(cols, weights)], k))

    def vote(self, names: np.ndarray, cosine: np.ndarray) -> float:
        """The share of label 1 among these nearest examples, by the square of the cosine's share of the best one."""
        if not len(names):
            return self.base
        vote = (cosine / cosine[0]) ** 2 * self.weight[names]
        mean = self.weight[names].mean()
        return float(((vote * self.labels[names]).sum() + SMOOTH * mean * self.base) / (vote.sum() + SMOOTH * mean))

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; the votes themselves where the examples were too few to calibrate."""
        return votes if self.line is None else 1 / (1 + np.exp(-(self.line[0] * _logit(votes) + self.line[1])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def calibration(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic map of votes to probabilities, by Newton steps, held towards slope 1 and shift 0."""
    x, weight = np.stack([_logit(votes), np.ones(len(votes))], axis=1), weight * len(votes) / max(weight.sum(), 1e-9)
    start = np.array([1.0, 0.0])
    at = start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (weight * (labels - p)) - (at - start)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(bend, slope)
        at += np.clip(step, -1, 1)
    return float(max(at[0], 0.05)), float(at[1])


def term_values(found: np.ndarray, toxic: np.ndarray, rows: int, toxic_rows: float) -> np.ndarray:
    """idf of each term, times the square of its relevance to label 1.

    The relevance is log2(1 + odds ratio of label 1 among texts with the term), 1 where label 1 is not likelier with it;
    the share of label 1 is drawn to that of all texts, as if SHRINK more texts had the term.
    """
    share = toxic_rows / max(1, rows)
    if not 0 < share < 1:
        return np.log((rows + 1) / (found + 1)) + 1
    p = np.minimum((toxic + SHRINK * share) / (found + SHRINK), 1 - 1e-9)
    odds = p / (1 - p) * (1 - share) / share
    return (np.log((rows + 1) / (found + 1)) + 1) * np.log2(1 + np.maximum(odds, 1)) ** 2


def build_index(text: np.ndarray, term: np.ndarray, times: np.ndarray, labels: np.ndarray, ids, weight: np.ndarray, rows: np.ndarray | None = None) -> ExampleIndex:
    """The index over all examples, or over some `rows` of them; terms (text, term, times) are sorted by text."""
    if rows is not None:
        number = np.full(len(labels), -1)
        number[rows] = np.arange(len(rows))
        keep = number[text] >= 0
        text, term, times = number[text[keep]], term[keep], times[keep]
        labels, ids, weight = labels[rows], [ids[i] for i in rows.tolist()], weight[rows]
    terms, col = np.unique(term, return_inverse=True)
    value = term_values(np.bincount(col, minlength=len(terms)), np.bincount(col, labels[text], len(terms)), len(labels), labels.sum())
    return ExampleIndex(terms, value, labels, ids, weight, text, col.astype(np.int32), times)


def query_vectors(index: ExampleIndex, text: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, weights) of each of n texts; only terms of the index count."""
    place = np.minimum(np.searchsorted(index.terms, term), max(0, len(index.terms) - 1))
    known = index.terms[place] == term if len(index.terms) else np.zeros(len(term), np.bool_)
    text, col = text[known], place[known]
    w = unit_vectors(text, col, times[known], index.value, n)
    cuts = np.searchsorted(text, np.arange(n + 1))
    return [(col[a:b], w[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def fit_calibration(text: np.ndarray, term: np.ndarray, times: np.ndarray, labels: np.ndarray, ids, weight: np.ndarray) -> tuple[float, float] | None:
    """The calibration of votes for examples of each half by an index over the other half; of each half and label at
    most CALIBRATION examples are asked. None where a half lacks a label."""
    half = np.arange(len(labels)) % 2
    votes, truth, counts = [], [], []
    for h in (0, 1):
        rows = np.flatnonzero(half == h)
        if not 0 < labels[rows].sum() < len(rows):
            return None
        other = build_index(text, term, times, labels, ids, weight, rows)
        for y in (0, 1):
            asked = np.flatnonzero((half != h) & (labels == y))
            drawn = asked[np.unique(np.linspace(0, len(asked) - 1, CALIBRATION).astype(np.int64))] if len(asked) > CALIBRATION else asked
            spans = [slice(*np.searchsorted(text, [i, i + 1])) for i in drawn.tolist()]
            queries = [query_vectors(other, np.zeros(s.stop - s.start, np.int64), term[s], times[s], 1)[0] for s in spans]
            votes += [other.vote(*x) for x in other.nearest_many(queries, NEIGHBOURS)]
            truth += [y] * len(drawn)
            counts += [weight[asked].sum() / max(1, len(drawn))] * len(drawn)
    return calibration(np.array(votes), np.array(truth, float), np.array(counts))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ExampleIndex:
    """The index over a bounded sample of the labelled rows: at most EXAMPLES of each label, by the order of a hash of
    their id. The vote of an example counts for the rows of its label that were not drawn.

    All terms of the sample are indexed (see term_values for their weights), and the votes are calibrated within the
    sample. Labels that are null are left out; an id with several labels counts as toxic if one of them is 1, and an id
    with several different texts (null: empty) as one example for each of the TEXTS_OF_ID least by MD5. An example of more
    than EXAMPLE_TERMS distinct terms counts with those of least hash. So the task that fits holds at most 2 * EXAMPLES *
    TEXTS_OF_ID * EXAMPLE_TERMS terms, however long texts are and however often an id repeats. Without labels of both
    kinds every score is 0 or 1.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(toxic).cast("int").alias("toxic"))
    known = known.join(docs.select(F.col(key).alias("id")).dropna().distinct(), "id", "left_semi")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # Only ids under a hash bound that about EXAMPLES (and some more) of a label pass are sorted.
    place = F.xxhash64("id", F.lit(5)).bitwiseAND((1 << 52) - 1)
    share = F.when(F.col("toxic") == 1, min(1.0, 1.2 * EXAMPLES / max(1, totals.get(1, 0)))).otherwise(min(1.0, 1.2 * EXAMPLES / max(1, totals.get(0, 0))))
    some = known.where(F.col("toxic").isin(0, 1) & (place < share * float(1 << 52)))
    sample = sorted((r["toxic"], r["place"], r["id"]) for r in some.select("toxic", place.alias("place"), "id").collect())
    sample = [x for t in (0, 1) for x in [(i, y) for y, _, i in sample if y == t][:EXAMPLES]]
    spark = docs.sparkSession
    drawn = F.broadcast(spark.createDataFrame(sample, known.schema))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(drawn, "id").select("id", "toxic", "text")
    drawn_of = {t: sum(y == t for _, y in sample) for t in (0, 1)}
    share_of = {t: totals.get(t, 0) / max(1, drawn_of[t]) for t in (0, 1)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        model = pickle.dumps(_fitted(pa.Table.from_batches(found), share_of)) if found else b""
        give_back()
        for at in range(0, len(model), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([model[at : at + (1 << 20)]], pa.binary())], names=["at", "part"])

    # One task fits the bounded sample, so the driver holds the index and nothing of what it is made from.
    examples = _examples(rows)
    parts = examples.repartition(1).mapInArrow(build, "at long, part binary").toArrow().sort_by("at")["part"].to_pylist()
    return pickle.loads(b"".join(parts)) if parts else _fitted(examples.limit(0).toArrow(), share_of)


def _examples(rows: DataFrame) -> DataFrame:
    """One row (id, key, toxic, term array, times array) for each text of an id, TEXTS_OF_ID at most: texts become terms
    where they are read, equal ones are brought down to one on both sides of the shuffle, and so are those over the bound."""
    keyed = rows.select("id", "toxic", F.md5("text").alias("key"), "text")
    schema = StructType([*keyed.drop("text").schema.fields, StructField("term", ArrayType(LongType())), StructField("times", ArrayType(IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                own, term, times = text_terms(*text_bytes(b.column("text")))
                starts = np.searchsorted(own, np.arange(b.num_rows + 1))
                keep = np.arange(len(own)) - starts[own] < EXAMPLE_TERMS
                sizes = np.minimum(np.diff(starts), EXAMPLE_TERMS)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term[keep].view(np.int64), times[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), b.column("key"), *lists], names=schema.names)

    texts = keyed.mapInArrow(count, schema).groupBy("id", "toxic", "key").agg(F.min(F.struct("term", "times")).alias("x"))
    some = texts.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("key"))).where(F.col("nth") <= TEXTS_OF_ID)
    return some.select("id", "key", "toxic", F.col("x.term").alias("term"), F.col("x.times").alias("times"))


def _fitted(rows: pa.Table, share_of: dict[int, float]) -> ExampleIndex:
    """The calibrated index over rows (id, key, toxic, term, times); an example of a label counts for share_of[label] rows."""
    rows = rows.sort_by([("id", "ascending"), ("key", "ascending")]).combine_chunks()
    ids, label = rows["id"].to_pylist(), rows["toxic"].to_numpy().astype(np.float64)
    lists = rows["term"].combine_chunks()
    text_no = np.repeat(np.arange(rows.num_rows, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    term, times = lists.flatten().to_numpy().view(np.uint64), rows["times"].combine_chunks().flatten().to_numpy()
    weight = np.array([share_of[int(y)] for y in label])
    line = fit_calibration(text_no, term, times, label, ids, weight)
    index = build_index(text_no, term, times, label, ids, weight)
    index.line = line
    return index


def score_texts(df: DataFrame, index: ExampleIndex, text: str = "text", evidence: bool = True) -> DataFrame:
    """Adds score (0 to 1) and, if asked, evidence: the three nearest examples with their id, cosine and label.

    The score of a text is the vote of its NEIGHBOURS nearest examples, drawn a little towards the share of toxic rows,
    and calibrated; texts without a term of any example (null and empty ones too) get that of the share itself. Equal
    texts have equal scores. Columns named score or evidence are replaced, others are kept as they are; an empty table
    gives no rows. The index is sent to the executors once; its size is that of the terms of at most EXAMPLES texts of
    each label.
    """
    held = df.sparkSession.sparkContext.broadcast(index)
    out = df.drop("score", "evidence")
    whole = not index.ids or isinstance(index.ids[0], int)
    schema = extended(out, "score double" + f", evidence array<struct<doc_id:{'long' if whole else 'string'},cosine:double,toxic:int>>" * evidence)
    kind = pa.list_(pa.struct([("doc_id", pa.int64() if whole else pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for b in slices(batch, text, SLICE_BYTES // 2):
                raw, offsets = text_bytes(b.column(text))
                owner, term, times = text_terms(raw, offsets, model.terms)
                votes, why = np.full(b.num_rows, model.base), []
                for i, (names, cosine) in enumerate(model.nearest_many(query_vectors(model, owner, term, times, b.num_rows), NEIGHBOURS)):
                    votes[i] = model.vote(names, cosine)
                    why.append([{"doc_id": model.ids[j] if whole else str(model.ids[j]), "cosine": float(c), "toxic": int(model.labels[j])} for j, c in zip(names[:3].tolist(), cosine)])
                arrays = [*b.columns, pa.array(model.calibrated(votes))] + ([pa.array(why, kind)] if evidence else [])
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return out.mapInArrow(run, schema)


def _held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, evidence: bool = True) -> DataFrame:
    """`docs` with score, predicted and evidence, learnt from labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~_held_out("doc_id"))
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, fit(source, labels), evidence=evidence).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(spark, docs, sf_dir).select("doc_id", _held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")
