"""Toxicity: a convolutional text classifier, trained in numpy, applied to whole texts.

A word's embedding is the sum of the hashed embeddings of the word, its first four, five and six
letters and its last four, so that inflected forms share most of theirs. Filters one, two and three
words wide run over the whole text, each is max-pooled, and a logistic layer gives the score, which is
then calibrated on held-back training rows, so that 0.5 separates the classes at their true shares.
Thresholds by language, for rejecting documents, are chosen on the same held-back rows.

Language, source, id and labels are never inputs of a score. Training takes a bounded sample of the
labelled rows (`Settings.most_rows`, `Settings.most_chars`); everything else sees whole tables and texts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import crc_mod, slices

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    width: int = 12  # of an embedding
    filters: int = 8  # of each filter width
    spans: tuple[int, ...] = (1, 2, 3)
    most_rows: int = 3000  # training rows of each class, the first by a hash of the id
    most_chars: int = 60_000  # the rows are chosen among those with texts of at most so many
    epochs: int = 4
    batch: int = 48
    rate: float = 0.05
    folds: int = 5  # rows of remainder 0 are never learned from
    seed: int = 7


def features(word: str, buckets: int) -> list[int]:
    """Buckets of a word's hashed embeddings."""
    parts = (word, "<" + word[:4], "<<" + word[:5], "<<<" + word[:6], word[-4:] + ">")
    return [zlib.crc32(p.encode()) % buckets for p in parts]


class Tokens:
    """A batch of texts as distinct words with their features, and word numbers by text."""

    def __init__(self, texts: list[str], buckets: int):
        found = [WORD.findall(t.lower()) for t in texts]
        index: dict[str, int] = {}
        self.words = np.fromiter([index.setdefault(w, len(index)) for ws in found for w in ws], np.int32)
        self.features = np.array([features(w, buckets) for w in index], np.int32).reshape(-1, 5)
        self.ends = np.cumsum([len(ws) for ws in found])
        self.starts = self.ends - [len(ws) for ws in found]


@dataclass
class Model:
    """Weights: embeddings, filters[s][j] (embedding width x filters) of word j of a span of s words,
    their biases, the logistic layer, the calibration, and thresholds by language."""

    settings: Settings
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    top: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, s: Settings) -> Model:
        rng = np.random.default_rng(s.seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        filters = [draw(k, s.width, s.filters, by=0.3 / k) for k in s.spans]
        return cls(s, draw(s.buckets, s.width, by=0.1), filters, [np.zeros(s.filters, np.float32) for _ in s.spans], draw(len(s.spans) * s.filters, by=0.2), -1.0)

    def convolve(self, t: Tokens, a: int, b: int) -> Iterator[np.ndarray]:
        """For each span, the filters' values at the starts in texts a..b, -inf where a span would leave its text."""
        lo, hi = (int(t.starts[a]), int(t.ends[b - 1])) if b > a else (0, 0)
        vectors = self.embedding[t.features].sum(1)
        words = t.words[lo:hi]
        left = np.repeat(t.ends[a:b], t.ends[a:b] - t.starts[a:b]) - np.arange(lo, hi)
        for k, (weights, bias) in enumerate(zip(self.filters, self.biases, strict=True)):
            span, n = self.settings.spans[k], len(words)
            out = np.repeat(bias[None], n, 0)
            for j in range(span):
                out[: n - j] += (vectors @ weights[j])[words[j:]]
            out[left < span] = -np.inf
            yield out

    def pooled(self, t: Tokens) -> np.ndarray:
        """Texts x all filters: rectified maxima. A text with fewer words than a span has 0 there."""
        n = len(t.ends)
        out = np.zeros((n, len(self.top)), np.float32)
        full = np.nonzero(t.ends > t.starts)[0]
        if len(full):
            for k, values in enumerate(self.convolve(t, 0, n)):
                out[full, k * self.settings.filters : (k + 1) * self.settings.filters] = np.maximum(np.maximum.reduceat(values, t.starts[full], 0), 0)
        return out

    def raw(self, texts: list[str]) -> np.ndarray:
        return self.pooled(Tokens(texts, self.settings.buckets)) @ self.top + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(texts).astype(np.float64) + b, -40, 40)))


def train(texts: list[str], labels: np.ndarray, s: Settings) -> Model:
    """Stochastic gradients with Adagrad over the texts, through the maxima of the filters."""
    m, rng = Model.fresh(s), np.random.default_rng(s.seed + 1)
    tokens = [Tokens(texts[k : k + 1], s.buckets) for k in range(len(texts))]
    seen = np.zeros((2, s.buckets))
    for t, y in zip(tokens, labels, strict=True):
        seen[int(y), np.unique(t.features)] += 1
    share = (seen + 0.5) / (np.bincount(labels.astype(int), minlength=2)[:, None] + 1)
    # One component and one filter begin from how much oftener toxic texts hold a feature.
    m.embedding[:, 0] = np.clip(np.log(share[1] / share[0]), -2, 2) * np.sqrt(np.minimum(seen.sum(0) / 20, 1)) * 0.5
    m.filters[0][0, :, 0] = 0
    m.filters[0][0, 0, 0] = 1
    m.top[0] = 1
    steps = {id(x): np.full(x.shape, 1e-3, np.float32) for x in (m.embedding, m.top, *m.filters, *m.biases)}
    step_bias = 1e-3

    def descend(x: np.ndarray, g: np.ndarray, rate: float) -> None:
        h = steps[id(x)]
        h += g * g
        x -= rate * g / np.sqrt(h)

    for epoch in range(s.epochs):
        order, rate = rng.permutation(len(texts)), s.rate / (1 + epoch)
        for at in range(0, len(order), s.batch):
            rows = order[at : at + s.batch]
            t = Tokens.__new__(Tokens)
            parts = [tokens[r] for r in rows]
            shift = np.cumsum([0, *[len(p.features) for p in parts]])
            t.features = np.concatenate([p.features for p in parts])
            t.words = np.concatenate([p.words + k for p, k in zip(parts, shift, strict=False)])
            t.ends = np.cumsum([len(p.words) for p in parts])
            t.starts = t.ends - [len(p.words) for p in parts]
            full = np.nonzero(t.ends > t.starts)[0]
            if not len(full):
                continue
            n, pooled, places = len(rows), np.zeros((len(rows), len(m.top)), np.float32), []
            for k, values in enumerate(m.convolve(t, 0, n)):
                best = np.maximum.reduceat(values, t.starts[full], 0)
                hit = values == np.repeat(best, (t.ends - t.starts)[full], 0)
                place = np.zeros((n, s.filters), np.int64)
                pos, f = np.nonzero(hit & (values > 0))
                doc = np.searchsorted(t.ends, pos, side="right")
                place[doc[::-1], f[::-1]] = pos[::-1]  # the first of equal maxima
                places.append(place)
                pooled[full, k * s.filters : (k + 1) * s.filters] = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ m.top + m.bias, -30, 30)))
            err = ((p - labels[rows]) / n).astype(np.float32)
            back = err[:, None] * m.top[None] * (pooled > 0)
            touched, grads = [], []
            for k, span in enumerate(s.spans):
                g = back[:, k * s.filters : (k + 1) * s.filters]
                doc, f = np.nonzero(g)
                pos, value = places[k][doc, f], g[doc, f]
                gw = np.zeros_like(m.filters[k])
                for j in range(span):
                    feats = t.features[t.words[pos + j]]
                    np.add.at(gw[j].T, f, m.embedding[feats].sum(1) * value[:, None])
                    grad = m.filters[k][j].T[f] * value[:, None]
                    touched.append(feats.ravel())
                    grads.append(np.repeat(grad, feats.shape[1], 0))
                descend(m.filters[k], gw, rate)
                descend(m.biases[k], g.sum(0), rate)
            descend(m.top, pooled.T @ err, rate)
            step_bias += float(err.sum()) ** 2
            m.bias -= rate * float(err.sum()) / np.sqrt(step_bias)
            if len(where := np.concatenate(touched)):
                rows_, inverse = np.unique(where, return_inverse=True)
                g = np.zeros((len(rows_), s.width), np.float32)
                np.add.at(g, inverse, np.concatenate(grads))
                h = steps[id(m.embedding)]
                h[rows_] += g * g
                m.embedding[rows_] -= rate * g / np.sqrt(h[rows_])
    return m


def calibrate(m: Model, texts: list[str], labels: np.ndarray, weights: np.ndarray, langs: list[str | None]) -> None:
    """Fits score = logistic(a * raw + b) on held-back rows, weighted to the classes' true shares, and
    for each language the threshold of the best F1 on them (0.5 where a language has few rows)."""
    x, y = m.raw(texts).astype(np.float64), labels.astype(np.float64)
    y_soft = np.where(y > 0, 1 - 1e-2, 1e-3)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, h = weights * (p - y_soft), weights * p * (1 - p) + 1e-6
        g = np.array([np.sum(d * x) + 1e-3 * (a - 1), np.sum(d)])
        hess = np.array([[np.sum(h * x * x) + 1e-3, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = max(a - step[0], 0.05), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    m.scale = (float(a), float(b))
    p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
    for lang in sorted({k for k in langs if k is not None}):
        own = np.array([k == lang for k in langs])
        if (y[own] > 0).sum() < 10 or (y[own] == 0).sum() < 10:
            continue
        order = np.argsort(-p[own], kind="stable")
        q, yy, ww = p[own][order], y[own][order], weights[own][order]
        hits, taken = np.cumsum(yy * ww), np.cumsum(ww)
        f1 = 2 * hits / (taken + (yy * ww).sum())
        k = int(np.argmax(f1))
        low = q[k + 1] if k + 1 < len(q) else 0.0
        m.thresholds[lang] = float(min(max((q[k] + low) / 2, 0.2), 0.8))


def fitted(rows: list[tuple], shares: dict[int, int], s: Settings) -> Model:
    """A model from rows of (doc_id, text, lang, toxic); shares: labelled rows of each class. With too few of either
    class it says 0 everywhere that nothing was learned."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    y = np.array([r[3] for r in rows], np.float32)
    if min((y > 0).sum(), (y == 0).sum()) < 5:
        blank = Model.fresh(s)
        blank.top[:], blank.scale = 0, (1.0, -3.0)
        return blank
    back = np.array([zlib.crc32(f"back{r[0]}".encode()) % 5 == 0 for r in rows])
    if min((y[back] > 0).sum(), (y[back] == 0).sum()) < 2:
        back[:] = True
        fit = np.arange(len(rows))
    else:
        fit = np.nonzero(~back)[0]
    m = train([rows[k][1] for k in fit], y[fit], s)
    held = np.nonzero(back)[0]
    weight = {v: shares[v] / max(1, (y == v).sum()) for v in (0, 1)}
    calibrate(m, [rows[k][1] for k in held], y[held], np.array([weight[int(v)] for v in y[held]]), [rows[k][2] for k in held])
    return m


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model from the labelled rows whose fold is not 0, of each class at most `most_rows` of those whose text
    has at most `most_chars`. Repeated labels of a document: toxic if one says so; of several texts under one id
    the first in order is learned from. It is trained in one task, which can be run again, and only the model
    comes to the driver."""
    folds = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    folds = folds.filter((crc_mod("doc_id", s.folds) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang")).filter(F.length("text") <= s.most_chars)
    known = folds.join(text.select("doc_id").distinct(), "doc_id")
    shares = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.most_rows) for y in (0, 1)]
    sample = F.broadcast(taken[0].union(taken[1]))  # at most 2 * most_rows rows of two numbers
    rows = text.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "t.text", "t.lang", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(found, shares, s))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else fitted([], shares, s)


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, score, predicted, flagged) for each row. predicted: score >= 0.5; flagged: score at least
    the threshold of the row's language, which is what a filter should use.

    Null and empty texts have the score of no words; rows with null ids and repeated rows are scored
    each; an unknown or null language has the threshold 0.5; very long texts are scored whole; an empty
    table gives an empty table; other columns are ignored. A score that ties with the threshold is flagged.
    """
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in df.columns else F.lit(None).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                score, flagged = judged(model, texts, rows.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(flagged)], ["doc_id", "score", "predicted", "flagged"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int, flagged boolean")


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of df that are not flagged, with all their columns; each row by its own text and language, as in
    `score_toxicity`. The rows are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                lang = batch.schema.get_field_index(lang_col) if lang_col else -1
                langs = rows.column(lang).to_pylist() if lang >= 0 else [None] * len(texts)
                yield rows.filter(pa.array(~judged(model, texts, langs)[1]))

    return df.mapInArrow(run, df.schema)


def judged(model: Model, texts: list[bytes], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and which of them reach their language's threshold."""
    score = model.scores([t.decode() for t in texts])
    return score, score >= np.array([model.thresholds.get(k, 0.5) for k in langs])
