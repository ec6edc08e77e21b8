"""Base scores and counts against brute force, the model against the base, and the edge cases."""

import math
import platform
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfold.llm.common import words
from wayfold.llm.languagemodel import Network, score_texts


def test_scores(spark):
    rng = random.Random(6)
    names = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(400):  # each word is mostly followed by its neighbour
        at, text = rng.randrange(60), []
        for _ in range(rng.randint(1, 60)):
            text.append(names[at])
            at = (at + 1) % 60 if rng.random() < 0.9 else rng.randrange(60)
        docs.append((i, " ".join(text)))
    docs += [(1000, None), (1001, ""), (1002, "Unseen \t words\nHere W1"), (1003, "w2 w3"), (1003, "w2 w3"), (None, "w5")]
    rows = score_texts(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string")).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*words((t or "").encode()), b""]
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in docs)
    text = dict(docs)
    for r in rows:
        own = tokens(text[r.doc_id])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[w] > 0 for w in own), n, held(r.doc_id))
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
    some = [r for r in rows if r.held_out]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_network_is_a_distribution():
    net = Network(np.arange(1, 71, dtype=float))
    h = np.random.default_rng(0).standard_normal((3, 24)).astype(np.float32)
    for k in range(3):
        total = sum(np.exp(net.log_probability(h[k : k + 1], np.array([w]))[0]) for w in range(70))
        assert abs(total - 1) < 1e-4


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_model_does_not_depend_on_partitions_and_knows_long_texts(spark, monkeypatch):
    import wayfold.llm.languagemodel as L

    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d e", "f g h"]) for _ in range(rng.randint(0, 200)))) for i in range(300)]
    docs.append((999, "a b c d e f g h " * 8000))
    monkeypatch.setattr(L, "SHARD", 9000)
    monkeypatch.setattr(L, "LANES", 4)
    monkeypatch.setattr(L, "TOGETHER", 3)
    look = lambda parts: {r.doc_id: (r.n_tokens, r.score) for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()}
    one, many = look(1), look(7)
    assert one[999][0] == 64_001 and all(n == many[k][0] and abs(s - many[k][1]) <= 1e-5 * abs(s) for k, (n, s) in one.items())


def test_gradients_against_differences():
    """What one step of training changes weights by has the signs and proportions of the loss's differences."""
    import wayfold.llm.languagemodel as L

    rng = np.random.default_rng(4)
    stream = rng.integers(0, 70, L.LANES * 5 + 1)
    loss_of = lambda n: -n.loss(stream)
    net = Network(np.arange(1, 71, dtype=float))
    grad = net.gradients(*net.lanes(stream), np.zeros((L.LANES, L.HIDDEN), np.float32))[0]
    for name in net.NAMES:
        x, g = getattr(net, name), grad[name]
        k = int(np.abs(g).argmax())
        before, step = x.flat[k], 1e-2
        x.flat[k] = before + step
        up = loss_of(net)
        x.flat[k] = before - step
        down = loss_of(net)
        x.flat[k] = before
        assert abs((up - down) / (2 * step) - g.flat[k]) < 0.05 * abs(g.flat[k]) + 1e-4, name


def test_scores_against_a_plain_recurrence():
    """Texts of many lengths side by side, with small weights and with some whose exponentials overflow."""
    import wayfold.llm.languagemodel as L

    rng = np.random.default_rng(5)
    for large in (1, 400):
        net = Network(np.arange(1, 71, dtype=float))
        net.end, net.wc, net.ww = 1, net.wc * large, net.ww * large
        texts = [np.append(rng.integers(0, 70, n), 1).astype(np.int16) for n in [0, 1, 2, 60, *rng.integers(0, 40, 700)]]
        got, k = net.score(texts), L.HIDDEN
        for t in [*range(6), 700]:
            h, before, want = np.zeros(k), net.end, 0.0
            for w in texts[t]:
                x = net.emb[before].astype(float) @ net.wx + net.b
                z, r = (1 / (1 + np.exp(-(x[: 2 * k] + h @ net.wh[:, : 2 * k])))).reshape(2, k)
                h = (1 - z) * h + z * np.tanh(x[2 * k :] + (r * h) @ net.wh[:, 2 * k :])
                for out, at in ((h @ net.wc + net.bc, w // net.size), (h @ net.ww[w // net.size] + net.bw[w // net.size], w % net.size)):
                    want += out[at] - out.max() - np.log(np.exp(out - out.max()).sum())
                before = w
            assert abs(got[t] - want) < 1e-3 * max(1, -want), (large, t)


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="other C libraries are left as they are")
def test_training_does_not_map_its_arrays_anew():
    """Once warm, a pass over a stream clears few pages; it cleared some 1,100 for each window of tokens."""
    code = """
import resource, numpy as np, wayfold.llm.languagemodel as L
keep = getattr(L, "keep_freed", None)
if keep: keep()
net = L.Network(np.arange(1, 1025, dtype=float))
net.fresh_squares()
stream = np.random.default_rng(1).integers(0, 1024, L.LANES * L.STEPS * 12 + 1)
for _ in range(3):
    before = resource.getrusage(0).ru_minflt
    net.train(stream)
print(resource.getrusage(0).ru_minflt - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 12 * 200, done.stdout
