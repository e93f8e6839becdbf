"""N-best segmentation of texts into pieces, with forward Viterbi scores guiding a backward A-star search."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import extended
from .words import inside, mix, slices

NBEST = 3
BLANK = 0x2581
CACHE_UNITS = 2_000_000
#: Units up to these lengths are segmented many at once, in matrices of about so many places; longer ones one by one.
WIDTHS, PLACES = (8, 16, 32, 64), 1 << 16
_END = 0x1FFFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_models: dict[str, "PieceModel"] = {}


class PieceModel:
    """Pieces of a SentencePiece model with their scores, and best segmentations of units.

    A text becomes a blank, then the text with spaces as blanks. Its lattice has an edge for each piece at each place,
    and for a character that is no piece an edge of the least score (barred pieces aside) less 10 that stands for its UTF-8 bytes' ids. No
    piece has a blank behind another character, or a line feed, so the lattice falls into units (blanks and what
    follows up to the next blank or line feed) that are segmented once a worker; at most CACHE_UNITS are held.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {}
        self.byte = np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[sp.id_to_piece(i)] = (i, sp.get_score(i))
        assert not any("\n" in p or chr(BLANK) in p.lstrip(chr(BLANK)) for p in self.pieces)
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - 10.0  # pieces under that are barred
        self.longest = max(map(len, self.pieces))
        #: Every beginning of a piece, with the piece itself where it is one.
        self.begins = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.pieces
        self._trie()
        self.clear()

    def _trie(self) -> None:
        """Steps from a beginning of a piece by a character to a longer one, as sorted keys, and the piece of each."""
        number = {"": 0} | {p: k for k, p in enumerate(sorted(self.begins), 1)}
        steps = sorted((number[p[:-1]] << 21 | ord(p[-1]), k) for p, k in number.items() if p)
        self.step_keys = np.array([k for k, _ in steps] + [np.iinfo(np.int64).max])
        self.step_to = np.array([k for _, k in steps] + [0])
        found = [(-1, 0.0)] + [self.begins[p] or (-1, 0.0) for p in sorted(self.begins)]
        self.step_piece, self.step_score = np.array([i for i, _ in found], np.int32), np.array([s for _, s in found])

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count, self.score, self.gap = (np.zeros(0, d) for d in (np.int64, np.int64, np.float64, np.float64))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def edges_to(self, unit: str) -> list[list[tuple[int, float, int]]]:
        """For each place, edges that end there: (start, score, id); id -1 is an unknown character's bytes."""
        begins, n = self.begins, len(unit)
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                if (part := unit[i:j]) not in begins:
                    break
                if piece := begins[part]:
                    out[j].append((i, piece[1], piece[0]))
            if unit[i] not in self.pieces:
                out[i + 1].append((i, self.unknown, -1))
        return out

    @staticmethod
    def viterbi(edges: list[list[tuple[int, float, int]]]) -> tuple[list[float], list[int]]:
        """The best score from the start to each place, and the edge by which it is reached (ties: the first, longest one)."""
        forward, by = [0.0] + [-np.inf] * (len(edges) - 1), [-1] * len(edges)
        for j in range(1, len(edges)):
            for k, (i, s, _) in enumerate(edges[j]):
                if forward[i] + s > forward[j]:
                    forward[j], by[j] = forward[i] + s, k
        return forward, by

    def nbest(self, unit: str, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """The n best segmentations, best first: score and (start, id) of each edge.

        The search goes backward from the end; what a partial path scores plus the forward Viterbi score of the place
        that it has come to is exactly its best whole score, so paths end in order. Ties go to the path with the
        longer last pieces.
        """
        edges = self.edges_to(unit)
        forward, _ = self.viterbi(edges)
        heap = [(-forward[-1], 0, len(unit), 0.0, None)]
        out, ticket = [], 0
        while heap and len(out) < n:
            _, _, place, behind, path = heapq.heappop(heap)
            if place == 0:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                out.append((behind, steps))
                continue
            for i, s, piece in edges[place]:
                if forward[i] > -np.inf:
                    ticket += 1
                    heapq.heappush(heap, (-(forward[i] + s + behind), ticket, i, s + behind, ((i, piece), path)))
        return out

    def unit_ids(self, unit: str, steps: list[tuple[int, int]]) -> list[int]:
        out = []
        for i, piece in steps:
            out += [piece] if piece >= 0 else self.byte[list(unit[i].encode())].tolist()
        return out

    def solve(self, unit: str) -> tuple[float, float, list[int]]:
        """The best score, how much less the second best has (inf: there is none), and the best ids.

        A path other than the best one has an edge off it, so the second best score is that of the best path over
        such an edge: forward score, edge and backward score.
        """
        edges = self.edges_to(unit)
        forward, by = self.viterbi(edges)
        n = len(unit)
        backward = [-np.inf] * n + [0.0]
        for j in range(n, 0, -1):
            b = backward[j]
            for i, s, _ in edges[j]:
                if s + b > backward[i]:
                    backward[i] = s + b
        best, steps, j = set(), [], n
        while j > 0:
            i, _, piece = edges[j][by[j]]
            best.add((j, by[j]))
            steps.append((i, piece))
            j = i
        second = -np.inf
        for j in range(1, n + 1):
            for k, (i, s, _) in enumerate(edges[j]):
                if (j, k) not in best and forward[i] + s + backward[j] > second:
                    second = forward[i] + s + backward[j]
        return forward[n], forward[n] - second, self.unit_ids(unit, steps[::-1])

    def solve_many(self, points: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for units of at most `width` characters, place by place for all of them: best scores, gaps, numbers
        of ids, and all ids. score[k, i, u] is that of unit u's edge of k + 1 characters from place i."""
        m, units, places = len(starts), np.arange(len(starts)), np.arange(width)[:, None]
        chars = np.where(places < size, points[np.minimum(starts + places, len(points) - 1)], _END).astype(np.int64).ravel()
        longest = min(self.longest, width)
        score, piece = np.full((longest, width, m), -np.inf), np.full((longest, width, m), -1, np.int32)
        at = np.flatnonzero(chars != _END)
        state = np.zeros(len(at), np.int64)
        for k in range(longest):
            room = at < (width - k) * m
            at = at[room]
            key = state[room] << 21 | chars[at + k * m]
            to = np.searchsorted(self.step_keys, key)
            ok = self.step_keys[to] == key
            at, state = at[ok], self.step_to[to[ok]]
            whole = self.step_piece[state] >= 0
            score[k].ravel()[at[whole]] = self.step_score[state[whole]]
            piece[k].ravel()[at[whole]] = self.step_piece[state[whole]]
        score[0][(chars.reshape(width, m) != _END) & (piece[0] < 0)] = self.unknown
        forward, by = np.full((width + 1, m), -np.inf), np.zeros((width + 1, m), np.int64)
        backward = forward.copy()
        forward[0], backward[size, units] = 0.0, 0.0
        for j in range(1, width + 1):
            for k in range(min(j, longest), 0, -1):  # of ties the longest edge
                reach = forward[j - k] + score[k - 1, j - k]
                better = reach > forward[j]
                np.copyto(forward[j], reach, where=better)
                np.copyto(by[j], k, where=better)
        for i in range(width - 1, -1, -1):
            for k in range(1, min(longest, width - i) + 1):
                np.maximum(backward[i], score[k - 1, i] + backward[i + k], out=backward[i])
        steps, place, live = [], size.copy(), units
        while len(live):
            k = by[place[live], live]
            i = place[live] - k
            steps.append((live, i, piece[k - 1, i, live]))
            score[k - 1, i, live] = -np.inf  # what is left are the edges off the best path
            place[live] = i
            live = live[i > 0]
        second = np.full(m, -np.inf)
        for k in range(1, longest + 1):
            over = forward[: width - k + 1] + score[k - 1, : width - k + 1] + backward[k:]
            np.maximum(second, over.max(axis=0), out=second)
        unit, i, ids = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((i, unit))
        unit, char, ids = unit[order], points[starts[unit[order]] + i[order]], ids[order]
        many = np.where(ids >= 0, 1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))
        unknown = ids < 0
        ids, spelled = np.repeat(ids, many).astype(np.uint32), np.repeat(unknown, many)
        ids[spelled] = self.byte[np.frombuffer(char[unknown].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        best = forward[size, units]
        return best, best - second, np.bincount(unit, many, m).astype(np.int64), ids

    def _solved(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Scores and gaps of units, and where their best ids now are in the cache."""
        size = ends - starts
        out = {"first": np.zeros(len(size), np.int64), "count": np.zeros(len(size), np.int64), "score": np.zeros(len(size)), "gap": np.zeros(len(size))}

        def put(some: np.ndarray, score, gap, count: np.ndarray, ids: np.ndarray) -> None:
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            out["first"][some], out["count"][some], out["score"][some], out["gap"][some] = self.used + np.cumsum(count) - count, count, score, gap
            self.used += len(ids)

        for low, width in zip((0, *WIDTHS), WIDTHS):
            fit = np.flatnonzero((size > low) & (size <= width))
            for a in range(0, len(fit), PLACES // width):
                some = fit[a : a + PLACES // width]
                put(some, *self.solve_many(points, starts[some], size[some], width))
        for k in np.flatnonzero(size > WIDTHS[-1]).tolist():
            score, gap, ids = self.solve(text[starts[k] : ends[k]])
            put(np.array([k]), score, gap, np.array([len(ids)]), np.array(ids, np.uint32))
        return out

    def lookup(self, hashes: np.ndarray, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each unit's place in the cache, where all are put that are not there yet."""
        if len(self.keys) > CACHE_UNITS:
            self.clear()
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            new = at[~known]
            keys = np.concatenate([self.keys, distinct[~known]])
            order = np.argsort(keys, kind="stable")
            for name, more in self._solved(text, points, starts[new], ends[new]).items():
                setattr(self, name, np.concatenate([getattr(self, name), more])[order])
            self.keys = keys[order]
            place = np.searchsorted(self.keys, distinct)
        return place[back]

    def segment(self, texts: list[str], n: int) -> list[tuple[list[tuple[float, np.ndarray]], str]]:
        """For each text its n best segmentations, best first, as (score, ids), and the best one decoded.

        A text's n best differ from its best one only in the n - 1 units with the least gaps (ties: the first), as
        each of these alone gives a better or equal path than any change elsewhere. Those units are searched, and
        their ways combined in the order of their sums. An empty text has the one empty segmentation.
        """
        whole = "".join(chr(BLANK) + t.replace(" ", chr(BLANK)) if t else "" for t in texts)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        edge = np.cumsum(sizes) - sizes
        first = np.zeros(len(points), np.bool_)
        first[edge[sizes > 0]] = True
        blank, feed = points == BLANK, points == 10
        first[1:] |= (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(points))
        up, down = (np.full(len(points) + 1, b, np.uint64) for b in (_STEP, _BACK))
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        place = self.lookup(hashes, whole, points, starts, ends) if len(starts) else np.zeros(0, np.int64)
        count, gap, score = self.count[place], self.gap[place], self.score[place]
        flat = self.ids[np.repeat(self.first[place], count) + inside(count)] if len(place) else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(count)])
        units = np.searchsorted(starts, np.append(edge, len(points)))
        out = []
        for a, b in zip(units[:-1].tolist(), units[1:].tolist()):
            ids = flat[before[a] : before[b]]
            best = float(score[a:b].sum())
            ways = [(best, ids)]
            if b > a and n > 1:
                k = min(n - 1, b - a)
                near = np.argpartition(gap[a:b], k - 1)[:k] if k < b - a else np.arange(b - a)
                limit = gap[a:b][near].max()
                near = np.sort(np.lexsort((np.flatnonzero(gap[a:b] <= limit), gap[a:b][gap[a:b] <= limit]))[:k])
                chosen = a + np.flatnonzero(gap[a:b] <= limit)[near]
                chosen = chosen[np.isfinite(gap[chosen])]
                ways = [(best + x, y) for x, y in self._variants(whole, starts, ends, chosen, score, ids, before - before[a], n)] if len(chosen) else ways
            text = self.processor.decode(ids.tolist()) if len(ids) else ""
            out.append((ways, text))
        return out

    def _variants(self, whole, starts, ends, chosen, score, ids, before, n):
        """Up to n ways: what they score above the best one, and all ids."""
        parts = [whole[starts[c] : ends[c]] for c in chosen]
        base = float(score[chosen].sum())
        options = [self.nbest(p, n) for p in parts]
        heap, seen, out = [(-sum(o[0][0] for o in options), (0,) * len(options))], {(0,) * len(options)}, []
        while heap and len(out) < n:
            total, pick = heapq.heappop(heap)
            pieces, last = [], 0
            for c, o, k, p in zip(chosen, options, pick, parts):
                pieces += [ids[last : before[c]], np.array(self.unit_ids(p, o[k][1]), np.uint32)]
                last = before[c + 1]
            out.append((-total - base, np.concatenate([*pieces, ids[last:]])))
            for i, o in enumerate(options):
                if pick[i] + 1 < len(o):
                    more = (*pick[:i], pick[i] + 1, *pick[i + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(heap, (total + o[pick[i]][0] - o[pick[i] + 1][0], more))
        return out


def encode(df: DataFrame, text: str, path: str, n: int = NBEST, ids: bool = False) -> DataFrame:
    """Adds nbest (array of score, n_ids, ids_crc32 and, if asked, ids; best first) and round_trip (the best ids decode
    to the text). The CRC is of the ids as little-endian unsigned 32-bit numbers. Null and empty texts have one empty
    segmentation of score 0. A text with a blank character U+2581 decodes to a space there, so round_trip is false."""
    out = df.drop("nbest", "round_trip")
    schema = extended(out, f"nbest array<struct<score:double,n_ids:long,ids_crc32:long{',ids:array<long>' * ids}>>, round_trip boolean")
    kind = pa.list_(pa.struct([("score", pa.float64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int64()))] * ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = PieceModel(path)
        for batch in batches:
            for b in slices(batch, text, 1 << 20):
                texts = [t or "" for t in b.column(text).to_pylist()]
                found = _models[path].segment(texts, n)
                rows = [[{"score": s, "n_ids": len(x), "ids_crc32": zlib.crc32(x.astype("<u4").tobytes()), **({"ids": x.tolist()} if ids else {})} for s, x in ways] for ways, _ in found]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), pa.array([t == d for t, (_, d) in zip(texts, found)])], names=schema.names)

    return out.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, name: str = "text") -> DataFrame:
    """Adds the text of each array of ids: pieces joined, blanks as spaces, byte ids as UTF-8, without the first blank.
    Null ids give null, and an empty array an empty text."""
    out = df.drop(name)
    schema = extended(out, f"`{name}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = PieceModel(path)
        for b in batches:
            texts = [None if x is None else _models[path].processor.decode(x) if x else "" for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return out.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, "text", public_tokenizers.path("piece_bpe_32k.model"))
    best = out["nbest"][0]
    return out.select("doc_id", best["n_ids"].alias("n_ids"), best["ids_crc32"].alias("ids_crc32"), best["score"].alias("score"), "nbest", "round_trip")
