"""Removed bytes against brute force over planted repeats, and the edge cases."""

import hashlib
import random

from wayfold.llm.suffixes import remove_repeats


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ijklé\n") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 180, 400)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 150)) for _ in range(3)]
        for s in shared:
            if rng.random() < 0.3:
                parts.insert(rng.randint(0, len(parts)), s[rng.randint(0, 3) :])
        rows.append((i, "".join(parts)))
    rows += [(70, "a" * 500), (71, "ab" * 300), (72, rows[5][1]), (73, rows[5][1]), (74, None), (75, ""), (76, "x" * 99), (77, "x" * 99), (78, text(130) * 3), (2000, rows[9][1] + "!")]
    rows += [(80 + n, text(40) + (text(9) * 30)[: 100 + n] + text(40)) for n in (5, 12, 40, 66, 72, 90)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int")).collect()}
    want = brute(rows)
    assert {k: v for k, v in got.items() if want[k] != v} == {}
    assert set(got) == set(want)


def test_edges(spark):
    t = "".join(chr(97 + k * 7 % 26) for k in range(40)) + "0123456789" * 9
    rows = [(1, t), (1, t), (None, t), (2, "z")]
    got = sorted((r.doc_id or 99, r.n_removed > 0) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[0] for g in got] == [1, 1, 2, 99] and got[3][1] and got[0][1] == got[1][1]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def corpus(seed):
    """Long texts with shared passages at all distances, periodic stretches, and near copies of one another."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ijklé\n") for _ in range(n))
    passage, line, base = text(700), text(130), text(6000)
    rows = []
    for i in range(30):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = "#"
        rows.append((i, "".join(own)))
    rows += [(40 + i, text(rng.randint(0, 300)) + line + text(rng.randint(0, 300)) + passage[rng.randint(0, 500) :] + text(50)) for i in range(60)]
    rows += [(200, "abcdefg" * 400), (201, "x" * 3000 + text(200) + "x" * 900), (202, text(4000) * 2)]
    return rows


def test_long_and_near_copied_texts(spark, monkeypatch):
    import wayfold.llm.suffixes as S

    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    look = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert look() == want
    monkeypatch.setattr(S, "MEETING", 2)  # nearly every rank is crowded
    assert look() == want


def test_texts_longer_than_a_piece(monkeypatch):
    import numpy as np

    import wayfold.llm.suffixes as S

    texts = [t.encode() for _, t in corpus(6)]
    def content():
        out = set()
        for b, ends, text, offset in S.pieces(texts):
            rank, c1, c2, first, count, _ = S.runs(b, ends)
            piece = np.searchsorted(ends, first, side="right")
            for r, p, f, n in zip(rank.tolist(), piece.tolist(), first.tolist(), count.tolist(), strict=True):
                at = f - (int(ends[p - 1]) if p else 0) + int(offset[p])
                out |= {(int(text[p]), at + k, r) for k in range(n)}
        return out
    whole = content()
    monkeypatch.setattr(S, "PIECE", 777)
    assert content() == whole and len(whole) == sum(max(len(t) - 99, 0) for t in texts)
