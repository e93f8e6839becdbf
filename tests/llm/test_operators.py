"""Operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sayframe.llm import embeddings, fingerprints, jaccard, licenses, packing, sharding, storage, substrings, toxicity, warc, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(300)]
    some = lambda n: r.choices(vocabulary, k=n)
    passage, base = some(60), some(200)
    rows = [None, "", " \n\t ", "one", "One  two\x0bthree", "x " * 40, " ".join(some(3000))]
    rows += [" ".join(some(20) + passage + some(30)) for _ in range(4)]
    for k in range(6):
        near = list(base)
        for i in r.sample(range(200), k):
            near[i] = "changed"
        rows.append(" ".join(near))
    rows += [rows[8], rows[8], rows[12].upper(), "é 😀 ß " * 5]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in texts], "doc_id long, text string, n_words string, size int, key string").repartition(3)


def test_jaccard_is_brute_force(frame, texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root, links = {i: i for i in sets}, Counter()
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard.jaccard_groups(frame, width=4, percent=85).collect()}
    assert got == {i: (len(s), links[i], find(i)) for i, s in sets.items()}


def test_overlaps_are_exact():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    assert (jaccard.overlaps(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


@pytest.mark.parametrize("shard, stream, least", [(1 << 20, 32 << 20, 1 << 18), (2000, 3000, 4)])
def test_substrings_are_brute_force(frame, texts, shard, stream, least, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    monkeypatch.setattr(substrings, "STREAM_BYTES", stream)
    monkeypatch.setattr(substrings, "FREQUENT", least)
    words = {i: WORD.findall(t or "") for i, t in texts}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    expected = {}
    for i, t in texts:
        w, keep = words[i], [True] * len(words[i])
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        kept = [x for x, y in zip(w, keep) if y]
        expected[hashlib.md5((t or "").encode()).digest()] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {bytes(r["key"]): (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(frame, "doc_id", "text").collect()}
    assert got == expected


def test_packing_is_gapless_and_whole(spark, frame, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(packing.tokenize(frame, "doc_id", "text", path)).collect()
    tokenizer = Tokenizer.from_file(path)
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in sizes.items():
        assert [x[2] for x in sorted(by_doc[i])] == [4096] * ((n - 1) // 4096) + [n - (n - 1) // 4096 * 4096]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= -(-sum(sizes.values()) // 4096) + 1


def test_packing_query(spark, tmp_path, texts):
    """Each piece's start, length and CRC are those of the tokenizer's own ids."""
    import zlib

    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.op6_packing(spark, str(tmp_path)).collect()
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == expected


def test_packing_keeps_any_column(spark):
    rows = [(i, 1 + i % 7, i, i, i, i) for i in range(50)] * 2
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, salt long, nth long, before long, row_no long"), 10).collect()
    assert Counter((x["doc_id"], x["length"], x["salt"], x["nth"], x["before"], x["row_no"]) for x in got) == Counter(rows)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 11)], "doc_id long, length long"), 10)


def test_fingerprints(spark, frame, texts):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.with_fingerprint(frame).collect()}
    assert got[0] == got[1] == got[2] == "0" * 32 and got[8] == got[17] == got[18]
    near = fingerprints.near_fingerprints(fingerprints.with_fingerprint(frame), fingerprints.with_fingerprint(frame), "doc_id", 3).collect()
    distinct = sorted(set(got.values()))
    apart = {(a, b): bin(int(a, 16) ^ int(b, 16)).count("1") for a in distinct for b in distinct if a != b}
    assert {(r["query_fingerprint"], r["fingerprint"]) for r in near} == {k for k, d in apart.items() if d <= 3}


def check_shards(rows, shards, slack=0.03):
    """Slots are gapless, sizes near equal (about one record apart, or `slack` of a share), and no small group is parted."""
    share = sum(r["bytes"] for r in rows) / shards
    largest = max((r["bytes"] for r in rows), default=0)
    for s in range(shards):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["bytes"] for r in mine) - share) <= 2 * largest + slack * share
    groups = defaultdict(list)
    for r in rows:
        groups[r["h"]].append(r)
    for g in groups.values():
        assert len({r["shard"] for r in g}) == 1 or sum(r["bytes"] for r in g) > share / 4


def test_sharding(frame, texts):
    rows = sharding.shard_by_bytes(frame.selectExpr("doc_id", "xxhash64(text) AS h", "cast(coalesce(octet_length(text), 0) + 8 AS long) AS bytes", "1 AS shard", "2 AS part", "3 AS row_no", "4 AS k1", "5 AS size"), ["h", "doc_id"], "bytes", 3).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in texts] and {(r["part"], r["row_no"], r["k1"], r["size"]) for r in rows} == {(2, 3, 4, 5)}
    check_shards(rows, 3)


@pytest.mark.parametrize("hot", [0, 900])
def test_sharding_of_many_rows(spark, hot, monkeypatch):
    """Groups of equal keys, one of a third of all rows, null keys, repeated rows, and overfull ranges."""
    r = random.Random(6)
    rows = [(i, r.choice([r.randrange(1 << 40), r.randrange(50)]) if i % 5 else None, r.randint(8, 80)) for i in range(1800)] + [(i, 77, 20) for i in range(hot)] + [(5, 123, 30)] * 3
    sizes = {}
    rows = [(i, h, sizes.setdefault(h, n) if h is not None else n) for i, h, n in rows]
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    df = spark.createDataFrame(rows, "doc_id long, h long, bytes long").repartition(5)
    got = sharding.shard_by_bytes(df, ["h", "doc_id"], "bytes", 6).collect()
    assert Counter((x["doc_id"], x["h"], x["bytes"]) for x in got) == Counter(rows)
    check_shards([x.asDict() | {"h": x["h"] if x["h"] is not None else -1} for x in got], 6)


def test_sharding_query(spark, tmp_path, texts):
    import zlib

    rows = [*texts, texts[8], (90, "one"), (91, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op9_sharding(spark, str(tmp_path)).collect()
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == expected
    assert all(x["law"] == "bytes" and 0 <= x["shard"] < 24 and x["grown_shard"] is None for x in got)
    assert len({x["shard"] for x in got if x["doc_id"] in (3, 90, 91)}) == 1


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\r\nx", "p" * 200), (2, None, "p" * 200), (3, "u", None), (4, "u", ""), (None, "u", "p" * 200), (5, "u", "é" * 99), (6, "u", "é" * 99), (7, "u", "short"), (8, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = storage.Scratch(spark, "test-warc")
    index = scratch.table(warc.write_warc(warc.with_revisits(df), f"{scratch.root}/a"), "index")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(index, f"{scratch.root}/a").collect()}
    assert got == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (0, "response", None), 4: (0, "response", None), None: (200, "response", None), 5: (198, "response", None), 6: (198, "revisit", 5), 7: (5, "response", None), 8: (5, "response", None)}
    assert [r["page_id"] for r in warc.read_warc(index.where("page_id = 5"), f"{scratch.root}/a").collect()] == [5]


def vector_truth(rows):
    """(n_links, component_id) of each row by all pairs."""
    fine = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in fine}
    links, root = Counter(), list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(fine, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    least = {}
    for i in fine:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return Counter((k, links[i], least.get(find(i), k)) for i, (k, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 8])
def test_vectors_are_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    r = np.random.default_rng(3)
    centres = r.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.05 * r.standard_normal(16)).tolist(), i % 2) for i in range(120)]
    rows += [(300 + i, (centres[0] + 0.001 * r.standard_normal(16)).tolist(), 0) for i in range(40)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [], 1), (206, [1.0, None], 1), (207, rows[0][1][:8], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "vec_id long, embedding array<double>, label int, cls int, n string")
    got = embeddings.link_vectors(df, "vec_id", "embedding", "label").collect()
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)
    assert Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == vector_truth(rows)
    assert embeddings.link_vectors(df.limit(0), "vec_id", "embedding", "label").count() == 0


@pytest.mark.parametrize("rows", [[(1, 0, 0), (1, 7, 1), (3, 13, 0)], [(1, 0, 0), (1, 90, 0), (3, 5, 0)]])
def test_vectors_with_one_id_stay_apart(spark, rows):
    rows = [(i, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))], label) for i, d, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.link_vectors(df, "vec_id", "embedding", "label").collect()
    assert Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == vector_truth(rows)


@pytest.mark.parametrize("block, dense", [(512, 512), (16, 8), (16, 0)])
def test_nearest_examples_are_exact(block, dense, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLE_BLOCK", block)
    monkeypatch.setattr(toxicity, "DENSE", dense)
    r = np.random.default_rng(2)
    n, terms = 300, 40
    picks = [np.sort(r.choice(terms, r.integers(1, 6), replace=False)) for _ in range(n)]
    text, col = np.repeat(np.arange(n), [len(p) for p in picks]), np.concatenate(picks)
    times, value = r.integers(1, 4, len(text)), r.uniform(1, 3, terms)
    index = toxicity.ExampleIndex(np.arange(terms, dtype=np.uint64), value, r.integers(0, 2, n).astype(float), list(range(n)), np.ones(n), text, col, times)
    full = np.zeros((n, terms))
    full[text, col] = toxicity.unit_vectors(text, col, times, value, n)
    assert sorted(index.ids) == list(range(n))
    found = list(index.nearest_many([(picks[q], full[q, picks[q]]) for q in range(n)], 10))
    for q, (names, best) in enumerate(found):
        cosine = full @ full[q]
        assert np.allclose(best, np.sort(cosine)[::-1][: len(best)], atol=1e-6) and len(best) == min(10, int((cosine > 0).sum()))
        assert np.allclose(cosine[[index.ids[i] for i in names]], best, atol=1e-6)


def test_calibration_follows_labels():
    r = np.random.default_rng(5)
    truth = r.uniform(0, 1, 4000)
    labels = (r.uniform(0, 1, 4000) < truth).astype(float)
    votes = 1 / (1 + np.exp(-0.5 * np.log(truth / (1 - truth))))  # too shy
    slope, shift = toxicity.calibration(votes, labels, np.ones(4000))
    assert abs(slope - 2) < 0.3 and abs(shift) < 0.2


def test_toxicity_learns_from_rows_that_are_not_held_out(spark, tmp_path):
    """The query's rows: nulls, empty and long texts, repeated rows, and labels that held-out rows would turn."""
    import zlib

    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijkl", k=6)) for _ in range(200)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    bad = {i for i in range(400) if i % 8 == 0}
    rows = [(i, " ".join(r.choices(words, k=30) + (["vilest", "slurring"] if i in bad else []))) for i in range(400)] + [(400, None), (401, ""), (402, " ".join(r.choices(words, k=20000))), (None, words[0]), (3, None)]
    rows[5] = (5, rows[4][1])
    labels = [(i, int(i in bad) if not held(i) else int(i not in bad)) for i in range(400)] + [(None, 1), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op2_toxicity(spark, str(tmp_path)).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(i for i, _ in rows)
    assert all(x["predicted"] == (x["score"] >= 0.3) and 0 <= x["score"] <= 1 and x["held_out"] == (x["doc_id"] is not None and held(x["doc_id"])) for x in got)
    scores = {x["doc_id"]: x["score"] for x in got if x["doc_id"] is not None and x["doc_id"] < 400}
    asked = [i for i in scores if held(i) and i != 3]
    assert all((scores[i] >= 0.3) == (i in bad) for i in asked) and np.mean([(scores[i] - (i in bad)) ** 2 for i in asked]) < 0.02
    assert scores[4] == scores[5] and len({round(s, 6) for s in scores.values()}) > 200


def test_toxicity_takes_any_id_and_column(spark):
    docs = spark.createDataFrame([("a", "vile words here", 1, "x"), ("b", "kind words there", 2, "y"), ("b", None, 3, "z")], "doc_id string, text string, score int, idf string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, toxic int")
    got = {(x["doc_id"], x["text"]): x for x in toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()}
    assert got["a", "vile words here"]["evidence"][0]["doc_id"] == "a" and got["b", None]["idf"] == "z" and got["b", None]["evidence"] == []


def test_fingerprint_query(spark, tmp_path, texts):
    """Edited texts, next documents and likeness, by plain Python."""
    rows = [*texts, (30, "one"), (31, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(rows, key=lambda r: -r[0])
    prints = lambda t: fingerprints.fingerprints(fingerprints.pa.array([t]))
    expected = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        near = [float(fingerprints.likeness(prints(t), prints(x))[0]) for x in (edited, nxt)]
        expected[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints(t).tobytes().hex(), prints(edited).tobytes().hex(), *near)
    got = {x["doc_id"]: tuple(x)[1:] for x in fingerprints.op7_fingerprints(spark, str(tmp_path)).collect()}
    assert got == expected


def test_licences_with_clashing_columns(spark):
    df = spark.createDataFrame([("a/LICENSE", "Released under the MIT License.", "t", "n", "w"), ("a/b", None, "t", "n", "w")], "path string, text string, top string, near string, own_score string")
    assert {(x["path"], x["license"], x["top"], x["near"]) for x in licenses.scan_licenses(df).collect()} == {("a/LICENSE", "MIT", "t", "n"), ("a/b", "MIT", "t", "n")}


def test_licences(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/c/d/y", ""), ("z/w", None), (None, "All rights reserved."), ("z/v", "text\nAll rights reserved.\nmore")]
    got = {r["path"]: (r["license"], r["how"], r["inherited_from"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", None), "a/b/x.py": ("MIT", "inherited", "a"), "a/c/LICENSE": ("Apache-2.0", "own", None), "a/c/d/y": ("Apache-2.0", "inherited", "a/c"), "z/w": (None, "none", None), None: ("proprietary", "own", None), "z/v": ("proprietary", "own", None)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_groups(docs).isEmpty() and substrings.remove_repeats(docs, "doc_id", "text").isEmpty() and packing.pack(spark.createDataFrame([], "doc_id long, length long")).isEmpty()
    assert embeddings.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label").isEmpty()
    assert sharding.shard_by_bytes(spark.createDataFrame([], "a long, b long, n long"), ["a", "b"], "n", 4).isEmpty() and licenses.scan_licenses(spark.createDataFrame([], "path string, text string")).isEmpty()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert [r["score"] for r in toxicity.score_texts(one, toxicity.fit(docs, labels)).collect()] == [0.0, 0.0]


def test_toxicity_searches_all_terms(spark):
    """Every labelled text is an example by all its terms, and every text with one of them has neighbours."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=3)) for _ in range(60)]
    rows = [(i, " ".join(r.choices(words[:40] if i % 3 else words[20:], k=12))) for i in range(30)] + [(30, None), (31, ""), (7, "a second text of seven"), (None, words[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(32)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    assert sorted(index.ids) == sorted(i for i, _ in rows if i is not None) and len(index.terms) == len({w for i, t in rows if i is not None for w in (t or "").split()} | {"seco", "secon", "seve"})
    assert {index.ids[e] for e in [*index.postings["text"], *index.by_slot_text]} == set(range(30)) | {7}
    by_word = {}
    for i, t in rows[:30]:
        for w in set(t.split()):
            by_word.setdefault(w, set()).add(i)
    got = {x["text"]: x for x in toxicity.score_texts(spark.createDataFrame([(w,) for w in by_word] + [("zzz",), (None,)], "text string"), index).collect()}
    assert all(x["evidence"] and {e["doc_id"] for e in x["evidence"]} <= by_word[w] for w, x in got.items() if w in by_word)
    assert got["zzz"]["evidence"] == [] == got[None]["evidence"] and got["zzz"]["score"] == got[None]["score"] == index.calibrated(np.array([index.base]))[0] > 0


def test_toxicity_fits_on_a_bounded_part_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TEXTS_OF_ID", 2)
    monkeypatch.setattr(toxicity, "EXAMPLE_TERMS", 5)
    texts = ["bad worst", "bad worst", "good words", None]
    long = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, t) for t in texts for _ in range(20)] + [(2, long), (3, ""), (None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    least = sorted({(hashlib.md5((t or "").encode()).hexdigest(), t or "") for t in texts})[:2]
    index = toxicity.fit(docs, labels)
    assert index.ids == [1, 1, 2, 3] and index.labels.tolist() == [1.0, 1.0, 0.0, 0.0]
    own = [sorted(toxicity.text_terms(*words.text_bytes(pa.array([t])))[1].tolist())[:5] for t in [*(t for _, t in least), long]]
    assert sorted(index.terms.tolist()) == sorted({h for hashes in own for h in hashes})
    assert toxicity.fit(docs.limit(0), labels).ids == [] == toxicity.fit(docs, labels.limit(0)).ids
