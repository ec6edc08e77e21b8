"""Language-model scoring: a gated recurrent network over words, trained and run in numpy.

Counts of all training tokens give the vocabulary, the base score, the output's classes and its first
biases. The network knows the most frequent words (`SHORTLIST`, one of them standing for all others); its
output is factored: a class, then a word of the class. A word outside the shortlist has the network's
probability of that stand-in times the word's smoothed share among all outside words, so a text's
probability is complete. Scoring carries the state from window to window through the whole document.

Every training document is learned from, in one pass. The documents are dealt by a hash into shards of about
`SHARD` tokens, so that shards grow in number with the corpus and the model is the same however Spark
divides the rows. Backpropagation is truncated at `STEPS` tokens, with the state carried on. Shard 0 trains the
first weights; each shard goes on from them with a copy of its own, and the copies are averaged by the tokens that
they saw, in the order of the shards.

Words with a count of at least a `HEAVY`-th of all tokens are at most HEAVY, and go to every task. Other words
meet their counts in a join by word; only sums by document come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch, crc_mod, few_rows, keep_freed, slices, words

FOLDS, HELD = 7, 2
HEAVY = 1 << 19
SHORTLIST, CLASSES, HIDDEN = 1024, 32, 24
STEPS, LANES, RATE = 24, 256, 0.05
SHARD, TOGETHER = 2_000_000, 64  # tokens of a shard; copies added up at a time
FLUSH = 48 << 20  # bytes of words counted at a time
#: Tokens that are scored at a time, and windows of tokens that are trained on at a time.
SCORED, WINDOWS = 1 << 24, 40
BESIDE = 512  # texts scored side by side, few enough for the processor's cache
END = b""  # the token at a text's end; no word is empty


def share(x: np.ndarray, total: float, bounded: bool) -> np.ndarray:
    """In place: each column's softmax times total. bounded: no exponential of x can overflow, or all of a column vanish."""
    if not bounded:
        x -= x.max(0)
    np.exp(x, out=x)
    x *= np.float32(total) / x.sum(0)
    return x


def log_share(x: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """The logarithm of each column's softmax at one place. x is lost."""
    if not bounded:
        x -= x.max(0)
    chosen = x[at, np.arange(len(at))]
    return chosen - np.log(np.exp(x, out=x).sum(0))


def with_ones(states: list[np.ndarray]) -> np.ndarray:
    """States side by side, and a last row of ones."""
    out = np.ones((len(states[0]) + 1, sum(h.shape[1] for h in states)), np.float32)
    np.concatenate(states, 1, out=out[:-1])
    return out


class Network:
    """Shapes: emb V x H; wx, wh H x 3H, b 3H (update, reset, candidate); wc H x C, bc C; ww C x H x M, bw C x M
    where class c holds words c * M ... c * M + M - 1. While it runs, places are columns: what a layer computes for
    them side by side is then a few long rows."""

    NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "ww", "bw")

    def __init__(self, counts: np.ndarray, seed: int = 3):
        rng, h, v = np.random.default_rng(seed), HIDDEN, len(counts)
        self.size = -(-v // CLASSES)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.emb, self.wx, self.wh, self.b = draw(v, h), draw(h, 3 * h), draw(h, 3 * h), np.zeros(3 * h, np.float32)
        share = np.zeros(CLASSES * self.size)
        share[:v] = counts + 1
        share = share.reshape(CLASSES, self.size)
        total = share.sum(1)
        self.wc, self.bc = draw(h, CLASSES), np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32)
        self.ww = draw(CLASSES, h, self.size)
        self.bw = np.where(share > 0, np.log(np.maximum(share, 1e-9) / np.maximum(total, 1e-9)[:, None]), -60).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            x = getattr(self, n)
            setattr(self, n, flat[at : at + x.size].reshape(x.shape).astype(np.float32).copy())
            at += x.size

    def gates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the state for update and reset, and for the candidate, and what each word adds to all three. What
        goes to update and reset is halved, as a sigmoid is a hyperbolic tangent of half."""
        k = HIDDEN
        inputs = (self.emb @ self.wx + self.b).T
        inputs[: 2 * k] *= 0.5
        return np.ascontiguousarray(self.wh[:, : 2 * k].T * np.float32(0.5)), np.ascontiguousarray(self.wh[:, 2 * k :].T), np.ascontiguousarray(inputs, np.float32)

    def outputs(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """The weights of classes and of words with the biases as a last input, transposed, and whether they bound the
        outputs (states are within -1 and 1)."""
        kinds = np.concatenate([self.wc, self.bc[None]]).T
        words_ = np.concatenate([self.ww, self.bw[:, None]], 1).transpose(0, 2, 1)
        return kinds, words_, max(float(np.abs(kinds).sum(-1).max()), float(np.abs(words_).sum(-1).max())) < 80

    @staticmethod
    def step(gates: tuple[np.ndarray, ...], word: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One token: (new state, update and reset, candidate)."""
        k, (wzr, wc, inputs) = HIDDEN, gates
        x = np.take(inputs, word, axis=1, mode="clip")
        zr = wzr @ h
        zr += x[: 2 * k]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        new = zr[k:] * h
        c = wc @ new
        c += x[2 * k :]
        np.tanh(c, out=c)
        np.subtract(c, h, out=new)
        new *= zr[:k]
        new += h
        return new, zr, c

    def by_class(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An order of the places by the class of their word; in it, the classes, the words within them, and where the classes' places end."""
        kind = (word // self.size).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        return order, kind, word[order] - kind.astype(np.int64) * self.size, np.searchsorted(kind, np.arange(CLASSES + 1))

    def log_probability(self, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability after the states, which are rows."""
        return self.log_probabilities(np.concatenate([h.T, np.ones((1, len(h)), np.float32)]), word, self.outputs())

    def log_probabilities(self, hs: np.ndarray, word: np.ndarray, weights: tuple[np.ndarray, np.ndarray, bool]) -> np.ndarray:
        """The same of states that are columns, with a last row of ones."""
        kinds, words_, bounded = weights
        order, kind, place, ends = self.by_class(word)
        own = np.take(hs, order, axis=1, mode="clip")
        q = np.empty((self.size, len(word)), np.float32)
        for c in np.nonzero(np.diff(ends))[0].tolist():
            np.matmul(words_[c], own[:, ends[c] : ends[c + 1]], out=q[:, ends[c] : ends[c + 1]])
        out = np.empty(len(word))
        out[order] = log_share(kinds @ own, kind, bounded).astype(np.float64) + log_share(q, place, bounded)
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each text's probability; texts are word numbers that end with the end's. Texts of about one
        length go on side by side, each with its state, until it ends."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        out, gates, weights = np.zeros(len(texts)), self.gates(), self.outputs()
        for at in range(0, len(texts), BESIDE):
            part = order[at : at + BESIDE]
            out[part] = self.score_beside([texts[k] for k in part], gates, weights)
        return out

    def score_beside(self, texts: list[np.ndarray], gates: tuple[np.ndarray, ...], weights: tuple[np.ndarray, np.ndarray, bool]) -> np.ndarray:
        """`score` of texts that never get longer."""
        lengths = np.array([len(t) for t in texts])
        flat, starts, total = np.concatenate(texts), np.cumsum(lengths) - lengths, np.zeros(len(texts))
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()
        h, previous = np.zeros((HIDDEN, len(texts)), np.float32), np.full(len(texts), self.end)
        for at in range(0, len(alive), STEPS):
            states, targets, rows = [], [], np.arange(alive[at])
            for s, n in enumerate(alive[at : at + STEPS], at):
                h = self.step(gates, previous[:n], h[:, :n])[0]
                states.append(h)
                previous = flat[starts[:n] + s]
                targets.append(previous)
            found = self.log_probabilities(with_ones(states), np.concatenate(targets), weights)
            total[: len(rows)] += np.bincount(np.concatenate([rows[: len(t)] for t in targets]), found, minlength=len(rows))
        return total

    def lanes(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and targets, lanes x steps: the stream in `LANES` stretches of one length."""
        length = max(len(stream) - 1, 0) // LANES
        return stream[: length * LANES].reshape(LANES, length), stream[1 : length * LANES + 1].reshape(LANES, length)

    def states(self, x: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of inputs (lanes x steps): `step` of each; h: the state before, lanes as columns."""
        gates, out = self.gates(), []
        for now in x.T:
            out.append(self.step(gates, now, h))
            h = out[-1][0]
        return out

    def loss(self, stream: np.ndarray) -> float:
        """Mean natural logarithm of a token's probability over the lanes, each from a state of zeros."""
        x, y = self.lanes(stream)
        steps = self.states(x, np.zeros((HIDDEN, LANES), np.float32))
        return float(self.log_probabilities(with_ones([t[0] for t in steps]), y.T.ravel(), self.outputs()).mean())

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss of a window of tokens (lanes x steps), and the state after it; h: the state before."""
        k, (lanes, steps) = HIDDEN, x.shape
        trace = self.states(x, h.T)
        states = [t[0] for t in trace]
        # Back through the outputs, with the places in the order of their classes.
        grad = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        kinds, words_, bounded = self.outputs()
        n, (order, kind, place, ends) = x.size, self.by_class(y.T.ravel())
        all_ = np.arange(n)
        own = np.take(with_ones(states), order, axis=1, mode="clip")
        p = share(kinds @ own, 1 / n, bounded)
        p[kind, all_] -= np.float32(1 / n)
        g = own @ p.T
        grad["wc"], grad["bc"] = g[:k], g[k]
        back, q = self.wc @ p, np.empty((self.size, n), np.float32)
        there = [(i, slice(ends[i], ends[i + 1])) for i in np.nonzero(np.diff(ends))[0].tolist()]
        for i, at in there:
            np.matmul(words_[i], own[:, at], out=q[:, at])
        share(q, 1 / n, bounded)
        q[place, all_] -= np.float32(1 / n)
        more = np.empty_like(back)
        for i, at in there:
            g = own[:, at] @ q[:, at].T
            grad["ww"][i], grad["bw"][i] = g[:k], g[k]
            np.matmul(self.ww[i], q[:, at], out=more[:, at])
        back += more
        inverse = np.empty(n, np.int64)
        inverse[order] = all_
        dh_out = np.take(back, inverse, axis=1, mode="clip").reshape(k, steps, lanes)
        # Back through the steps. What a state's gradient is multiplied by is known for all of them beforehand.
        before, zr, c = np.stack([h.T, *states[:-1]]), np.stack([t[1] for t in trace]), np.stack([t[2] for t in trace])
        z, r = zr[:, :k], zr[:, k:]
        keep = 1 - z
        to_c = c * c
        np.subtract(1, to_c, out=to_c)
        to_c *= z
        to_z = c
        to_z -= before
        to_z *= z
        to_z *= keep
        old = r * before
        to_r = 1 - r
        to_r *= old
        wzr, wc = np.ascontiguousarray(self.wh[:, : 2 * k]), np.ascontiguousarray(self.wh[:, 2 * k :])
        gates, dh = np.empty((steps, 3 * k, lanes), np.float32), np.zeros((k, lanes), np.float32)
        for s in range(steps - 1, -1, -1):
            dh += dh_out[:, s]
            gate = gates[s]
            np.multiply(dh, to_c[s], out=gate[2 * k :])
            np.multiply(dh, to_z[s], out=gate[:k])
            back = wc @ gate[2 * k :]
            np.multiply(back, to_r[s], out=gate[k : 2 * k])
            dh *= keep[s]
            back *= r[s]
            dh += back
            dh += wzr @ gate[: 2 * k]
        grad["wh"][:, : 2 * k] = (before @ gates[:, : 2 * k].transpose(0, 2, 1)).sum(0)
        grad["wh"][:, 2 * k :] = (old @ gates[:, 2 * k :].transpose(0, 2, 1)).sum(0)
        grad["b"] = gates.sum((0, 2))
        fed = np.take(np.ascontiguousarray(self.emb.T), x.T.ravel(), axis=1, mode="clip").reshape(k, steps, lanes)
        grad["wx"] = (fed.transpose(1, 0, 2) @ gates.transpose(0, 2, 1)).sum(0)
        # By word: what goes back to it is added up over its places.
        seen = x.T.ravel().astype(np.int16)
        order = np.argsort(seen, kind="stable")
        seen = seen[order]
        first = np.nonzero(np.diff(seen, prepend=np.int16(-1)))[0]
        back = np.take((self.wx @ gates).transpose(1, 0, 2).reshape(k, n), order, axis=1, mode="clip")
        grad["emb"][seen[first]] = np.add.reduceat(back, first, axis=1).T
        return grad, states[-1].T

    def train(self, stream: np.ndarray, rate: float = RATE) -> int:
        """Adagrad over a stream of word numbers in `LANES` lanes, the state carried along each lane."""
        x, y = self.lanes(stream)
        if x.shape[1] < 2:
            return 0
        h = np.zeros((LANES, HIDDEN), np.float32)
        for at in range(0, x.shape[1], STEPS):
            grad, h = self.gradients(x[:, at : at + STEPS], y[:, at : at + STEPS], h)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            for name, g in grad.items():
                g *= scale
                s = self.squares[name]
                s += g * g
                getattr(self, name)[...] -= rate * g / np.sqrt(s)
        return x.size

    def fresh_squares(self) -> None:
        self.squares = {n: np.full_like(getattr(self, n), 1e-4) for n in self.NAMES}


@dataclass
class Vocabulary:
    """Counts of the heavy words; which number each has in the network (0: stands for all others)."""

    heavy: dict[bytes, int]
    number: dict[bytes, int]
    tokens: int  # N
    distinct: int  # V
    outside: float  # smoothed mass of the words that are not in the shortlist, the unseen one included


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(crc_mod(id_col, FOLDS) == HELD, F.lit(False)).alias("held_out"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of the training documents, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        ends, size, held = 0, 0, []

        def flush() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.binary()).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        for batch in batches:
            for _, texts in slices(batch):
                held.append(pa.array(words(b" ".join(texts)), pa.binary()))
                ends, size = ends + len(texts), size + held[-1].nbytes
                if size > FLUSH:
                    yield flush()
                    size = 0
        yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    return docs.filter("NOT held_out").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, Network]:
    """The words' counts and numbers, and a network that has learned nothing but their shares."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total.n or 0, total.v
    rows = counts.filter(F.col("n") * HEAVY >= F.lit(tokens)).select("word", "n").toArrow()  # at most HEAVY rows
    heavy = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
    listed = [END, *sorted((w for w in heavy if w != END), key=lambda w: (-heavy[w], w))[: SHORTLIST - 2]]
    number = {w: k + 1 for k, w in enumerate(listed)}
    outside = tokens + distinct + 1 - sum(heavy.get(w, 0) + 1 for w in listed)
    v = Vocabulary(heavy, number, tokens, distinct, float(outside))
    net = Network(np.array([outside, *[heavy.get(w, 0) for w in listed]], np.float64))
    net.end = number[END]
    return v, net


def numbered(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, hash, held_out, stream, known, base, extra, rare, times): a text's numbers in the network, its last
    one the end's; how many of its tokens are heavy, their part of the base score, and what the shares of words
    outside the shortlist add to the network's; and its other words, each once, with how often they are there."""
    whole = np.log10(v.tokens + v.distinct + 1)
    shift = whole - np.log10(v.outside) if v.outside > 0 else 0.0
    words_ = [END, *(w for w in v.heavy if w != END)]
    heavy = pa.array(words_, pa.binary())
    number = np.array([v.number.get(w, 0) for w in words_] + [0], np.int16)  # the last: any other word
    log = np.array([np.log10(v.heavy.get(w, 0) + 1) for w in words_] + [0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            for rows, texts in slices(batch):
                flat, ends = [], []
                for text in texts:
                    flat += words(text)
                    flat.append(END)
                    ends.append(len(flat))
                ws, ends = pa.array(flat, pa.binary()), np.array(ends)
                sizes = np.diff(ends, prepend=0)
                starts = ends - sizes
                at = pa.compute.index_in(ws, value_set=heavy).fill_null(-1).to_numpy()
                stream, logs = number[at], log[at]
                none = np.nonzero(at < 0)[0]
                other = ws.take(pa.array(none)).dictionary_encode()
                different = max(len(other.dictionary), 1)
                rare, times = np.unique(np.searchsorted(ends, none, side="right") * different + other.indices.to_numpy(), return_counts=True)
                lists = pa.array(np.searchsorted(rare, np.arange(len(texts) + 1) * different), pa.int32())
                added = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                out = {
                    "doc_id": rows.column(0),
                    "hash": pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64()),
                    "held_out": rows.column(2),
                    "stream": pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(stream)]),
                    "known": pa.array(sizes - added((at < 0).astype(np.int64)) if v.tokens else np.zeros(len(texts), np.int64)),
                    "base": pa.array(added(logs) - sizes * whole),
                    "extra": pa.array(added(np.where(stream == 0, logs, 0.0)) - added((stream == 0).astype(np.int64)) * (whole - shift)),
                    "rare": pa.ListArray.from_arrays(lists, other.dictionary.take(pa.array(rare % different))),
                    "times": pa.ListArray.from_arrays(lists, pa.array(times, pa.int64())),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.mapInArrow(run, "doc_id long, hash long, held_out boolean, stream binary, known long, base double, extra double, rare array<binary>, times array<long>")


def learn(texts: DataFrame, tokens: int, net: Network) -> None:
    """Trains the network on all streams that are not held out."""
    shards = max(1, round(tokens / SHARD))
    dealt = texts.filter("NOT held_out").select(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(shards)).alias("shard"), "doc_id", "hash", "stream")
    schema = "shard long, n long, w binary"

    def trained(rows: DataFrame, parts: int) -> DataFrame:
        first = net.flat()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_freed()
            now, seen, held, size = None, 0, [], 0

            def flush() -> None:
                nonlocal seen, held, size
                if held:
                    seen += net.train(np.concatenate(held).astype(np.int64))
                held, size = [], 0

            def done() -> pa.RecordBatch:
                flush()
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([seen], pa.int64()), pa.array([(net.flat().astype(np.float64) * seen).tobytes()], pa.binary())], ["shard", "n", "w"])

            for batch in batches:
                for shard, stream in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if shard != now:
                        if now is not None:
                            yield done()
                        now, seen = shard, 0
                        net.load(first)
                        net.fresh_squares()
                    held.append(np.frombuffer(stream.as_buffer(), np.int16))
                    size += len(held[-1])
                    if size >= LANES * STEPS * WINDOWS:
                        flush()
            if now is not None:
                yield done()

        return rows.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "hash").select("shard", "stream").mapInArrow(run, schema)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of consecutive rows of one shard, in order."""
        now, seen, sums = None, 0, 0.0
        for batch in batches:
            for group, n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if group != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([seen], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["shard", "n", "w"])
                    now, seen, sums = group, 0, 0.0
                seen, sums = seen + n, sums + np.frombuffer(w.as_buffer())
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([seen], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["shard", "n", "w"])

    def take(rows: list) -> None:
        seen = sum(r.n for r in rows)
        if seen:
            net.load(sum(np.frombuffer(r.w) for r in sorted(rows, key=lambda r: r.shard)) / seen)

    spark = texts.sparkSession
    with few_rows(spark, 256):
        take(trained(dealt.filter("shard = 0"), 1).collect())
        if shards > 1:
            copies, left = trained(dealt, min(shards, 1 << 16)), shards
            while left > TOGETHER:
                left = -(-left // TOGETHER)
                group = copies.select(F.floor(F.col("shard") / TOGETHER).alias("g"), "shard", "n", "w").repartition(left, "g").sortWithinPartitions("g", "shard")
                copies = group.select(F.col("g").alias("shard"), "n", "w").mapInArrow(added, schema)
            take(copies.collect())  # at most TOGETHER rows of the network's size


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row. Learns from all
    documents whose fold, crc32 of the id modulo 7, is not 2.

    A text's tokens are its words and one end. base_score: add-one unigram; score: the network; both log10 of
    the text's probability. Null and empty texts are an end alone. A row without an id is learned from.
    Repeated rows count and are scored each, and rows of equal texts have equal scores. Very long texts are
    learned from and scored whole. Words of equal counts are numbered in their own order. With no training
    documents every word is unseen; an empty table gives an empty table. Other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    docs = texts_of(df, id_col, text_col)
    counts = scratch.write(count_words(docs), "counts")
    v, net = vocabulary(counts)
    if v.tokens == 0:
        v.number = {END: 1}
    texts = scratch.write(numbered(docs, v), "texts")
    learn(texts, v.tokens, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            streams = [np.frombuffer(x.as_buffer(), np.int16) for x in batch.column(3)]
            ends = np.cumsum([len(x) for x in streams])
            start = 0
            while start < len(streams):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SCORED, side="right")))
                rows, own = batch.slice(start, stop - start), streams[start:stop]
                score = net.score(own) / np.log(10) + rows.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(3)), pa.array([len(x) for x in own], pa.int64()), rows.column(4), rows.column(5), pa.array(score)], ["doc_id", "hash", "held_out", "n_tokens", "known", "base", "score"])
                start = stop

    names = ("doc_id", "hash", "held_out")
    scored = texts.select(*names, "stream", "known", "base", "extra").mapInArrow(run, "doc_id long, hash long, held_out boolean, n_tokens long, known long, base double, score double")
    sums = scored.select(*names, F.lit(1).cast("long").alias("copies"), "n_tokens", "known", "base", "score")
    each_word = texts.select(*names, F.explode(F.arrays_zip("rare", "times")).alias("x")).select(*names, F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = counts.filter(F.col("n") * HEAVY < F.lit(v.tokens))
    part = F.col("times") * F.log10(F.col("n") + 1)
    zero = F.lit(0).cast("long")
    joined = each_word.join(rare, "word").select(*names, zero.alias("copies"), zero.alias("n_tokens"), F.col("times").alias("known"), part.alias("base"), part.alias("score"))
    total = sums.union(joined).groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "known", "base", "score")])
    each = lambda c: F.col(c) / F.col("copies")
    one = total.select(
        "doc_id", "held_out", each("n_tokens").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        each("base").alias("base_score"), each("score").alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    )
    return one.drop("_copy")
