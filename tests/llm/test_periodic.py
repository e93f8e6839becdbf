"""Periodic runs against brute force: the search on strings full of repeats, and the query on a small table."""

import hashlib
import random
import re
import zlib

import numpy as np

from sayframe.llm import periodic
from sayframe.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def samples(r):
    some = lambda n, k: [r.randint(0, k) for _ in range(n)]
    fibonacci = [1], [1, 2]
    while len(fibonacci[1]) < 300:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    inner = [1, 2] * r.randint(5, 60)
    unit = some(r.randint(1, 70), 3)
    return [
        [], [1] * r.randint(0, 200), some(r.randint(0, 300), 1), fibonacci[1][: r.randint(1, 300)], [bin(i).count("1") % 2 for i in range(r.randint(1, 300))], unit * r.randint(1, 5) + unit[: r.randint(0, len(unit))],
        [1, 2] * r.randint(1, 60) + [9] + inner + [9] + [1, 2] * r.randint(1, 70) + [9] + inner, ([1, 2] * r.randint(1, 60) + [1]) * 2 + [3], (some(3, 2) * r.randint(1, 20) + [4] * r.randint(0, 9)) * r.randint(1, 4), some(150, 900),
    ]


def test_search_is_brute_force():
    r = random.Random(3)
    for _ in range(25):
        texts = samples(r)
        r.shuffle(texts)
        firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        owner, *found = periodic.find_runs(mix(np.array([x for t in texts for x in t], np.uint64)), firsts)
        for i, t in enumerate(texts):
            assert [tuple(map(int, x)) for x in zip(*(c[owner == i] for c in found))] == brute(t)


def test_hashes_that_agree_wrongly_are_seen(monkeypatch):
    monkeypatch.setattr(periodic._Sums, "same", lambda self, a, b, width: np.ones(len(a), np.bool_))
    unit = list(range(40))
    words = mix(np.array([99, *unit, *unit, *unit, 98, 97], np.uint64))
    assert [x.tolist() for x in periodic.find_runs(words, np.array([0, len(words)]))] == [[0], [1], [120], [40]]


def test_query_is_brute_force(spark, tmp_path):
    r = random.Random(4)
    planted = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    plain = lambda n: " ".join(f"w{r.randint(0, 60)}" for _ in range(n))
    rows = [(i, plain(r.choice([1, 5, 40, 400]))) for i in planted[:10]] + [(planted[10], None), (planted[11], "")]
    rows += [(5001, None), (5002, " \t\n"), (5003, "ab\x0bab " * 30), (5004, "é ß x " * 7 + "é"), (5005, plain(3000)), (5005, "q " * 11), (5005, "q " * 11), (None, "a b " * 9), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, runs int, h string, collapsed_text string").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        w = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs, dropped = brute(w), set()
        for s, length, q in runs:
            dropped.update(range(s + q, s + length))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in dropped))))
    got = [tuple(x) for x in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    order = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    assert sorted(got, key=order) == sorted(expected, key=order)
    both = periodic.periodic_runs(frame.where("doc_id = 5003")).first()
    assert (both["h"], both["collapsed_text"], [tuple(x) for x in both["runs"]]) == ("x", "ab", [(0, 60, 1)])
    assert periodic.periodic_runs(frame.limit(0)).count() == 0
