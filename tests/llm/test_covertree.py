"""Top-k against brute force, with ties, copies and vectors that take no part."""

import math
import random

import numpy as np

from wayfold.llm.covertree import CoverTree, search, top_k


def test_search_equals_brute_force():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-20, 20, (500, 6)), np.repeat(rng.integers(-20, 20, (1, 6)), 200, 0)]).astype(np.int8)
    ids = rng.permutation(len(v))
    d, q = CoverTree(ids, v), CoverTree(ids[::7], v[::7], 8)
    x, y, s = search(q, d, 10, np.full(len(q.ids), -np.inf))
    scores = v.astype(int) @ v.astype(int).T
    for k in range(0, len(v), 7):
        want = sorted((-scores[k, j], ids[j]) for j in range(len(v)) if ids[j] != ids[k])[:10]
        assert [(-int(b), int(a)) for a, b in zip(y[x == ids[k]], s[x == ids[k]], strict=True)] == [(int(a), int(b)) for a, b in want]


def test_edges(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)]
    odd = [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [math.nan, 0.0, 0.0, 0.0]), (260, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (280, []), (300, [1.0, 1.0]), (5, rows[5][1])]
    got = top_k(spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, score int"), k=5).collect()
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
