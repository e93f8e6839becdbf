"""The prefix trie against brute force, in blocks of one path and more."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sayframe.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(paths):
    """Rows of the nodes of {conv_id: [(turn, words), ...]}."""
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        kids = [below(k) for k in children[node]]
        own = (len(nodes[node]) - 1) * (node[-1][1] if node else 0)
        return own + sum(k[0] for k in kids), sum(k[1] for k in kids) or 1

    rows = []
    for node, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(node))))
        saved, leaves = below(node)
        rows.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def test_range_minima():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 33):
        v = r.integers(-1, 5, n)
        table = trie.RangeMinimum(v)
        for i in range(n):
            for d in range(-1, 6):
                right = max(k for k in range(i, n) if all(v[i + 1 : k + 1] >= d))
                left = min(k for k in range(i + 1) if all(v[k + 1 : i + 1] >= d))
                at, bound = np.array([i]), np.array([d])
                assert (table.reach_right(at, bound)[0], table.reach_left(at, bound)[0]) == (right, left)
            for j in range(i, n):
                assert table.least(np.array([i]), np.array([j]))[0] == v[i : j + 1].min()


@pytest.mark.parametrize("block, seed", [(1, 1), (1, 2), (5, 3), (9, 4), (1 << 18, 5)])
def test_trie_is_brute_force(spark, block, seed, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    r = random.Random(seed)
    turns = [(hashlib.md5(bytes([i])).digest(), i % 3) for i in range(4)]
    paths = {}
    for c in r.sample(range(-40, 400), 60):
        paths[c] = r.choices(turns, k=r.choice([0, 1, 2, 3, 3, 7])) if r.random() < 0.7 or not paths else list(r.choice(list(paths.values())))
    rows = [(c, n, *t) for c, p in paths.items() for n, t in enumerate(p, 1)] + [(c, None, None, None) for c in paths]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, nth long, turn binary, words long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        assert sorted(map(tuple, trie.prefix_trie(frame).collect()), key=repr) == brute(paths)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_query_is_brute_force(spark, tmp_path):
    r, rows = random.Random(6), []
    text = lambda: r.choice([None, "", "a", "b c", "é\x0bß", " d "])
    for c in [None, 0, 1, 2, 3, 5, 19, 21, 23, 40, 41, 59, 60, 7_000_000_001]:
        rows += [(c, r.choice([None, 1, 1, 2, 3]), r.choice([None, "", "user"]), text()) for _ in range(r.randint(1, 5))]
    rows += [rows[4], (60, 9, "user", "long " * 9000)]
    frame = spark.createDataFrame([(*x, 5, "w") for x in rows], "conv_id long, turn int, role string, text string, depth int, words string").repartition(3)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    own = defaultdict(list)
    for c, turn, role, t in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", (t or "")[:64], hashlib.sha256((t or "").encode()).hexdigest(), t or ""))
    plain = {c: [(x[2], x[5]) for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, p in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = [(t, len(WORD.findall(t[1]))) for t in plain.get(c - c % 20, [])[:h] + p[h:]]
    got = trie.op13_prefix_trie(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(paths)
    frame.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert trie.op13_prefix_trie(spark, f"{tmp_path}/none").count() == 0
