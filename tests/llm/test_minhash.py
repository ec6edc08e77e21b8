"""Components against brute force over planted copies, and the edge cases."""

import random

import numpy as np

from wayfold.llm import minhash
from wayfold.llm.minhash import near_duplicates, settled, shingle_sets, similar


def brute(rows):
    sets = {i: set(s.tolist()) for (i, _), s in zip(rows, shingle_sets([(t or "").encode() for _, t in rows]), strict=True)}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def planted(seed, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(copies):
            text = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = planted(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(spark):
    text = "one two three four five six seven eight"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, text), (7, text), (8, text.upper()), (None, text), (9, "q " * 60000)]
    got = sorted(near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (9, 1, 9, True), (None, 4, None, True),
    ]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_compare_as_sets_do():
    import numpy as np

    sets = shingle_sets([t.encode() for _, t in planted(2, groups=3, copies=6)])
    got = similar(sets, sets, 75, columns=64)
    want = [[100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert got.tolist() == want


def open_buckets(spark, size):
    """One bucket of `size` sets, each its own component; sets 4k and 4k + 1 are near."""
    rng = random.Random(size)
    sets = [set(rng.sample(range(10**9), 40)) for _ in range(size)]
    for k in range(0, size - 1, 4):
        sets[k + 1] = set(sorted(sets[k])[2:]) | {10**9 + k}
    rest = spark.createDataFrame([(7, k, len(s), k) for k, s in enumerate(sets)], "bucket long, doc_id long, n long, component long")
    packed = spark.createDataFrame([(k, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for k, s in enumerate(sets)], "doc_id long, n long, shingles binary")
    return rest, packed, {(k, k + 1) for k in range(0, size - 1, 4)}


def test_rows_of_an_open_group_do_not_grow_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    small, large = (minhash.dealt(open_buckets(spark, n)[0], 75).count() for n in (256, 4096))
    assert large <= 65 * small  # 16 times the members: 64 times the rows by blocks of a square root, 256 by fixed ones


def test_pairs_of_blocks_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "AT_ONCE", 8)
    rest, sets, links = open_buckets(spark, 150)
    assert {tuple(r) for r in settled(rest, sets, 75).collect()} == links
