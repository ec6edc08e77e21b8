"""Held-out accuracy on a planted corpus, and the edge cases."""

import random
import zlib

from wayfold.llm.toxicity import Settings, learn, score_toxicity

SMALL = Settings(buckets=4096, epochs=6)


def corpus(n=900):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = "zgrobl" + rng.choice(plain)[:2]
        docs.append((i, " ".join(words), "en" if i % 3 else "de"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(None, "null id zgroblab", None), (-1, None, "xx"), (-2, "", "en"), (-3, "one", "de"), (-3, "one", "de")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string")
    model = learn(df, spark.createDataFrame(labels + labels[:50], "doc_id long, toxic int"), SMALL)
    rows = score_toxicity(df, model).collect()
    assert len(rows) == len(docs) + len(extra)
    score = {r.doc_id: r for r in rows}
    held = [(score[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    again = {r.doc_id: r.score for r in score_toxicity(df.repartition(2), model).collect()}
    assert all(abs(again[k] - r.score) < 1e-6 for k, r in score.items())


def test_empty_tables_and_missing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = learn(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none, SMALL)
    assert score_toxicity(spark.createDataFrame([], "doc_id long, text string, score string"), model).collect() == []
    assert score_toxicity(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), model).collect()[0].predicted == 0
