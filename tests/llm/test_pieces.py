import itertools
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sayframe.llm.pieces import PieceModel


@pytest.fixture(scope="module")
def model():
    return PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def all_ways(model, text):
    """Every segmentation by plain recursion: (score, ids)."""
    lattice = "▁" + text.replace(" ", "▁")

    def rest(i):
        if i == len(lattice):
            yield 0.0, []
        for j in range(i + 1, min(len(lattice), i + model.longest) + 1):
            piece = model.pieces.get(lattice[i:j])
            if piece:
                for s, ids in rest(j):
                    yield s + piece[1], [piece[0], *ids]
        if i < len(lattice) and lattice[i] not in model.pieces:
            for s, ids in rest(i + 1):
                yield s + model.unknown, [*model.byte[list(lattice[i].encode())].tolist(), *ids]

    return sorted(rest(0), key=lambda w: -w[0])


@pytest.mark.parametrize("text", ["hello", "a b", "\n", "a\nb", "the cat", "  x", "é😀", "xyz Ⅷ", "in in", "▁a"])
def test_nbest_is_that_of_all_ways(model, text):
    ways, _ = model.segment([text], 4)[0]
    expected = all_ways(model, text)
    assert [round(s, 6) for s, _ in ways] == [round(s, 6) for s, _ in expected[:4]]
    for s, ids in ways:
        assert any(abs(s - e) < 1e-6 and ids.tolist() == i for e, i in expected)
    assert len({tuple(ids.tolist()) for _, ids in ways}) == len(ways)


def test_round_trip_and_empty(model):
    texts = ["", "Hello  world\n\tfoo ", "naïve 😀 日本", "a" * 300, "x y\n" * 50]
    for text, (ways, back) in zip(texts, model.segment(texts, 3)):
        assert back == text
        for _, ids in ways:
            assert (model.processor.decode(ids.tolist()) if len(ids) else "") == text
    assert [(s, len(i)) for s, i in model.segment([""], 3)[0][0]] == [(0.0, 0)]


def test_cache_does_not_change_results(model):
    texts = [" ".join(p) for p in itertools.permutations(["alpha", "beta", "gamma"])]
    one = [[(s, i.tolist()) for s, i in model.segment([t], 3)[0][0]] for t in texts]
    model.clear()
    assert one == [[(s, i.tolist()) for s, i in w] for w, _ in model.segment(texts, 3)]
    assert np.isfinite(one[0][0][0])


def test_units_at_once_are_units_one_by_one(model):
    r = random.Random(3)
    units = ["▁" + "".join(r.choices("aeinrst the▁Ⅷé日😀\x00.,'-", k=r.randint(0, 70))).replace(" ", "") for _ in range(400)] + ["\n", "▁▁▁", "▁international", "Ⅷ", "a" * 64, "b" * 65]
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(u) for u in units])
    model.clear()
    got = model._solved("".join(units), points, ends - [len(u) for u in units], ends)
    for k, unit in enumerate(units):
        score, gap, ids = model.solve(unit)
        assert (score, gap, ids) == (got["score"][k], got["gap"][k], model.ids[got["first"][k] :][: got["count"][k]].tolist())
    model.clear()
