"""Token counts against the tokenizer library, sampled segmentations against enumeration."""

import math
from collections import Counter

import pytest
from pyspark.sql import types as T

from wayfold.llm.pieces import PIECE_MODEL, SPACE, count_tokens, counts_of, decode, encode, encode_texts, engines, mixed, mixed_one, row_seed, vocabulary

ODD = ["", " ", "  two  spaces ", f"{SPACE}mark a{SPACE}b {SPACE}{SPACE}", "é😀漢字 \n\t x", "a" * 200, "ab" * 3000, "The quick brown fox.", "Ñandú öüß ça\nva"]


def library():
    """The tokenizer library in unigram mode over the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECE_MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    v = vocabulary(PIECE_MODEL, "stored")
    scores = {v.surface[i]: s for i, s in v.scores.items()}
    for p in proto.pieces:
        if p.piece == SPACE:
            p.score = scores[SPACE]
        elif p.score <= -1e8:
            p.type = 5
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_counts_equal_the_library(spark):
    sp = library()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r.text) < 20000] + ODD
    bulk, single = engines(PIECE_MODEL, "stored", 1.0)
    assert counts_of(texts, bulk, single)[1].tolist() == [len(x) for x in sp.encode(texts)]


def test_count_tokens_edges(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
    rows = [(1, None, "x"), (2, "", None), (None, "hello world", "y"), (3, "hello world", "z"), (3, "hello world", "z")]
    got = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in count_tokens(spark.createDataFrame(rows, schema)).collect())
    assert [g[:2] for g in got[1:3]] == [(1, 0), (2, 0)] and got[0][1] == got[3][1] == got[4][1] > 0
    assert count_tokens(spark.createDataFrame([], schema)).collect() == []


def test_encode_is_lossless_and_reproducible(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (100, None)], "doc_id long, text string")
    first = {r.doc_id: r for r in encode(df).collect()}
    again = {r.doc_id: r for r in encode(df.repartition(3)).collect()}
    assert {k: r.ids for k, r in first.items()} == {k: r.ids for k, r in again.items()}
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in first.values())
    assert first[100].ids == [] and first[0].ids == []
    back = {r.doc_id: r.text for r in decode(encode(df)).collect()}
    assert {k: back[k] for k in range(len(ODD))} == dict(enumerate(ODD)) and back[None] == "null id"
    assert {r.doc_id: r.ids for r in encode(df, seed=1).collect()} != {k: r.ids for k, r in first.items()}


def test_samples_follow_the_lattice():
    v = vocabulary(PIECE_MODEL, "rank")
    ids = {v.surface[i]: i for i in v.scores}

    def segmentations(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                yield from ((ids[s[:k]], *rest) for rest in segmentations(s[k:]))

    bulk, single = engines(PIECE_MODEL, "rank", 1.0)
    n = 20000
    weights = {x: math.exp(sum(v.scores[i] for i in x)) for x in segmentations(SPACE + "there")}
    flat, at = encode_texts(["there"] * n, [row_seed(0, i) for i in range(n)], bulk, single)
    drawn = Counter(tuple(flat[a:b].tolist()) for a, b in zip(at, at[1:], strict=False))
    alone = Counter(tuple(single.sample(SPACE + "there", lambda e, i=i: mixed_one(row_seed(1, i), 0, e))) for i in range(n))
    total = sum(weights.values())
    for found in (drawn, alone):
        assert set(found) <= set(weights)
        assert all(abs(found[x] / n - w / total) < 0.02 for x, w in weights.items())


def test_draws_agree():
    import numpy as np

    seeds = np.array([row_seed(5, i) for i in range(50)], np.uint64)
    many = mixed(seeds, np.arange(50), np.arange(50) + 3)
    assert many.tolist() == [mixed_one(int(s), i, i + 3) for i, s in enumerate(seeds)]


def test_samples_of_long_segments_follow_the_lattice():
    import random

    single = engines(PIECE_MODEL, "rank", 1.0)[1]
    rng = random.Random(3)
    for segment in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)), "there" * 40, "ab" * 150):
        n = len(segment)
        ends = [[] for _ in range(n + 1)]
        for end, (length, score, i) in single.find(segment):
            ends[end + 1].append((length, score, i))
        log = [0.0] + [-math.inf] * n
        for e in range(1, n + 1):
            terms = [log[e - k] + s for k, s, _ in ends[e]]
            log[e] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
        for turn in range(200):
            u = [random.Random(turn * 1000 + e).random() for e in range(n + 1)]
            want, e = [], n
            while e:
                left = u[e]
                for k, s, i in ends[e]:
                    left -= math.exp(log[e - k] + s - log[e])
                    if left < 0:
                        break
                want.append(i)
                e -= k
            assert single.sample(segment, lambda e, u=u: u[e]) == want[::-1]
