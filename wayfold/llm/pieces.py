"""Piece vocabularies as unigram models, the token counter and the segmentation sampler over them.

A vocabulary is read from a public tokenizer file (its path is a parameter, nothing is copied). No
piece may hold the space mark anywhere but at its start, so no path crosses a space and a text falls
apart into segments, each a space mark and what follows it. Pieces that the file itself bars (scores
of -1e8 and less) are runs of space marks, which take no part, and the single mark, which scores below
all others; an unknown character scores below that.

Segments are worked on in bulk: a batch's distinct segments advance together through a dense
Aho-Corasick automaton over the vocabulary's most frequent characters, one numpy step for each
character position, and the dynamic programming follows the automaton's outputs. Segments with other
characters, and long ones, go through the same recurrences one by one.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import documents, slices

SPACE = "▁"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BARRED = -1e8
UNKNOWN_PENALTY = 10.0
#: Characters of the dense automaton, and the longest segment that goes through it.
ALPHABET, LONGEST = 192, 32


class Vocabulary:
    """Pieces with scores and ids, the ids of the byte pieces, and how unknown characters score.

    scores: "stored" takes the file's, "rank" the logarithm of a Zipf share, -log(rank + 1) - log(H),
    by the order of the pieces in the file.
    """

    def __init__(self, path: str = PIECE_MODEL, scores: str = "stored"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.surface = [sp.id_to_piece(i) for i in ids]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        usable = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) and sp.get_score(i) > BARRED]
        if any(SPACE in self.surface[i][1:] for i in usable):
            raise ValueError("pieces with a space mark inside are not supported")
        if any(not sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the vocabulary has no byte pieces: decoding would lose characters")
        if scores == "stored":
            self.scores = {i: sp.get_score(i) for i in usable}
        elif scores == "rank":
            total = math.log(sum(1 / (k + 1) for k in range(len(usable))))
            self.scores = {i: -math.log(k + 1) - total for k, i in enumerate(usable)}
        else:
            raise ValueError(f"scores: {scores!r}")
        lowest = min(self.scores.values()) - UNKNOWN_PENALTY
        self.scores |= {i: lowest for i in ids if self.surface[i] == SPACE and i not in self.scores}
        self.unknown_score = min(self.scores.values()) - UNKNOWN_PENALTY
        usable = list(self.scores)
        self.longest = max(len(self.surface[i]) for i in usable)

    def automaton(self, value) -> ahocorasick.Automaton:
        """Of all usable pieces, each with value(id); finds every occurrence in one pass."""
        a = ahocorasick.Automaton()
        for i in self.scores:
            a.add_word(self.surface[i], value(i))
        a.make_automaton()
        return a


@lru_cache(maxsize=4)
def vocabulary(path: str, scores: str) -> Vocabulary:
    return Vocabulary(path, scores)


class Single:
    """The recurrences for one segment of any length and any characters."""

    def __init__(self, v: Vocabulary, alpha: float = 1.0):
        self.find = v.automaton(lambda i: (len(v.surface[i]), v.scores[i], i)).iter
        self.singles = {v.surface[i] for i in v.scores if len(v.surface[i]) == 1}
        self.unknown, self.alpha, self.longest, self.byte_ids = v.unknown_score, alpha, v.longest, v.byte_ids

    def unknowns(self, segment: str, since: int, until: int, best: list, pieces: list) -> None:
        """Offers the ends in (since, until] their last character as an unknown one, if no piece is it."""
        for e in range(since + 1, until + 1):
            if segment[e - 1] not in self.singles and best[e - 1] + self.unknown > best[e]:
                best[e], pieces[e] = best[e - 1] + self.unknown, pieces[e - 1] + len(segment[e - 1].encode())

    def count(self, segment: str) -> tuple[float, int]:
        """Score and pieces of the best path. Ties as the tokenizer's: of equal scores at an end, the
        piece that starts earlier; an unknown character loses every tie and is as many pieces as bytes."""
        n = len(segment)
        best, pieces = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        known = self.singles.issuperset(segment)
        done = 0  # ends up to here have had their unknown character, if any
        for end, (length, score, _) in self.find(segment):  # ends rise; at one end the longest piece comes first
            if not known and end > done:
                self.unknowns(segment, done, end, best, pieces)
                done = end
            start = end + 1 - length
            total = best[start] + score
            end += 1
            if total > best[end]:
                best[end], pieces[end] = total, pieces[start] + 1
        if not known:
            self.unknowns(segment, done, n, best, pieces)
        return best[n], pieces[n]

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def sample(self, segment: str, draw) -> list[int]:
        """Piece ids of a segmentation drawn by exp(alpha * score); draw(end) is uniform in [0, 1)."""
        n = len(segment)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, (length, score, i) in self.find(segment):
            ends[end + 1].append((length, math.exp(self.alpha * (score - self.unknown * length)), [i]))
        forward = [0.0] * (n + 1)
        forward[0] = 1.0
        shares: list[list[float]] = [[]] * (n + 1)  # of an end's pieces, kept from when all were of one scale
        for e in range(1, n + 1):
            if segment[e - 1] not in self.singles:
                ends[e].append((1, 1.0, self.bytes_of(segment[e - 1])))
            shares[e] = [forward[e - m[0]] * m[1] for m in ends[e]]
            forward[e] = sum(shares[e])
            if not 1e-100 < forward[e] < 1e100:  # paths compare as before if all that can still count is scaled
                for k in range(max(0, e - self.longest), e):
                    forward[k] /= forward[e]
                forward[e] = 1.0
        drawn, e = [], n
        while e:
            left = draw(e) * sum(shares[e])
            for m, share in zip(ends[e], shares[e], strict=True):
                left -= share
                if left < 0:
                    break
            drawn.append(m[2])
            e -= m[0]
        return [i for ids in reversed(drawn) for i in ids]


class Bulk:
    """The recurrences for many segments at once, over a dense Aho-Corasick automaton."""

    def __init__(self, v: Vocabulary, alpha: float = 1.0):
        chars = Counter(c for i in v.scores for c in v.surface[i])
        chars[SPACE] = 1 << 30
        self.classes = np.zeros(0x110000, np.uint8)  # 0: not in the alphabet
        alphabet = sorted(chars, key=lambda c: (-chars[c], c))[:ALPHABET]
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        single = {v.surface[i] for i in v.scores}
        for c in alphabet:
            if c not in single:  # it may need an unknown piece
                self.classes[ord(c)] = 0
        self.space = int(self.classes[ord(SPACE)])
        self._build(v, alpha)

    def _build(self, v: Vocabulary, alpha: float) -> None:
        children: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for i in v.scores:
            path = self.classes[[ord(c) for c in v.surface[i]]].tolist()
            if 0 in path:
                continue
            at = 0
            for c in path:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    own.append(-1)
                at = nxt
            own[at] = i
        n = len(children)
        step = np.zeros((n, ALPHABET + 1), np.int32)
        fail, outputs = [0] * n, [[] for _ in range(n)]
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                outputs[at] = ([own[at]] if own[at] >= 0 else []) + outputs[fail[at]]
                step[at] = step[fail[at]]
            for c, child in children[at].items():
                fail[child] = int(step[at, c]) if at else 0
                step[at, c] = child
                queue.append(child)
        most = max(map(len, outputs))
        self.step, self.n_out = step, np.array([len(o) for o in outputs], np.int8)
        self.length, self.ids = np.zeros((n, most), np.int8), np.zeros((n, most), np.int32)
        self.score = np.zeros((n, most))
        for at, out in enumerate(outputs):  # the longest piece first
            for k, i in enumerate(out):
                self.length[at, k], self.ids[at, k], self.score[at, k] = len(v.surface[i]), i, v.scores[i]
        self.alpha, self.shift = alpha, -v.unknown_score / 2

    @cached_property
    def weight(self) -> np.ndarray:
        """exp(alpha * score), times a constant per character, which all paths share alike."""
        return np.exp(self.alpha * (self.score + self.shift * self.length))

    def matrix(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of each segment's characters after a space mark, their lengths with it, and which
        segments can go through the automaton."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        strange = np.concatenate(([0], np.cumsum((classes == 0) | (classes == self.space))))
        fits = (lengths < LONGEST) & (strange[starts + lengths] == strange[starts])
        width = int(lengths[fits].max(initial=0)) + 1
        out = np.zeros((len(segments), width), np.uint8)
        out[:, 0] = self.space
        inside = np.arange(width - 1) < np.where(fits, lengths, 0)[:, None]
        rows, columns = np.nonzero(inside)
        out[rows, columns + 1] = classes[starts[rows] + columns]
        return out, lengths + 1, fits

    def walk(self, classes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, states) for each character position; rows must be sorted by falling length."""
        state = np.zeros(len(lengths), np.int32)
        for end in range(1, int(lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(-lengths, -end, side="right"))
            state[:active] = self.step[state[:active], classes[:active, end - 1]]
            yield end, active, state[:active]

    def count(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and pieces of each row's best path; rows sorted by falling length."""
        best, pieces = np.full((len(lengths), classes.shape[1] + 1), -np.inf), np.zeros((len(lengths), classes.shape[1] + 1), np.int32)
        best[:, 0] = 0.0
        for end, active, state in self.walk(classes, lengths):
            n_out = self.n_out[state]
            for k in range(int(n_out.max(initial=0))):
                rows = np.nonzero(n_out > k)[0]
                s = state[rows]
                start = end - self.length[s, k]
                total = best[rows, start] + self.score[s, k]
                better = total > best[rows, end]
                rows, start = rows[better], start[better]
                best[rows, end], pieces[rows, end] = total[better], pieces[rows, start] + 1
        at = np.arange(len(lengths))
        return best[at, lengths], pieces[at, lengths]

    def forward(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights of all paths to each end, and the automaton's state there."""
        total, states = np.zeros((len(lengths), classes.shape[1] + 1)), np.zeros((len(lengths), classes.shape[1] + 1), np.int32)
        total[:, 0] = 1.0
        for end, active, state in self.walk(classes, lengths):
            states[:active, end] = state
            n_out = self.n_out[state]
            for k in range(int(n_out.max(initial=0))):
                rows = np.nonzero(n_out > k)[0]
                s = state[rows]
                total[rows, end] += total[rows, end - self.length[s, k]] * self.weight[s, k]
        return total, states

    def backward(self, total: np.ndarray, states: np.ndarray, row: np.ndarray, end: np.ndarray, draw) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Samples one path for each token (row of `total`, end): yields tokens and their pieces, the
        last piece first. draw(tokens, ends) is uniform in [0, 1)."""
        token, row, end = np.arange(len(row)), row, end.astype(np.int64)
        while len(token):
            state = states[row, end]
            left = draw(token, end) * total[row, end]
            chosen = np.zeros(len(token), np.int8)
            n_out = self.n_out[state]
            open_ = np.nonzero(n_out > 1)[0]
            k = 0
            while len(open_):
                s, r = state[open_], row[open_]
                left[open_] -= total[r, end[open_] - self.length[s, k]] * self.weight[s, k]
                k += 1
                open_ = open_[(left[open_] >= 0) & (n_out[open_] > k)]
                chosen[open_] = k
            yield token, self.ids[state, chosen]
            end = end - self.length[state, chosen]
            more = end > 0
            token, row, end = token[more], row[more], end[more]


def distinct(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    index: dict[str, int] = {}
    return_ = np.fromiter([index.setdefault(t, len(index)) for t in tokens], np.int64, len(tokens))
    return list(index), return_


def sorted_rows(bulk: Bulk, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The classes and lengths of the segments that fit, longest first; each segment's row (-1: none);
    the segments that do not fit."""
    classes, lengths, fits = bulk.matrix(segments)
    order = np.nonzero(fits)[0]
    order = order[np.argsort(-lengths[order], kind="stable")]
    row = np.full(len(segments), -1, np.int64)
    row[order] = np.arange(len(order))
    return classes[order], lengths[order], row, np.nonzero(~fits)[0].tolist()


@lru_cache(maxsize=2)
def engines(path: str, scores: str, alpha: float) -> tuple[Bulk, Single]:
    v = vocabulary(path, scores)
    return Bulk(v, alpha), Single(v, alpha)


def counts_of(texts: list[str], bulk: Bulk, single: Single) -> tuple[np.ndarray, np.ndarray]:
    """Score and pieces of the best path of each text."""
    parts = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
    segments, token = distinct([s for p in parts for s in p])
    classes, lengths, row, odd = sorted_rows(bulk, segments)
    score, pieces = np.zeros(len(segments)), np.zeros(len(segments), np.int64)
    best, n = bulk.count(classes, lengths)
    fit = row >= 0
    score[fit], pieces[fit] = best[row[fit]], n[row[fit]]
    for k in odd:
        score[k], pieces[k] = single.count(SPACE + segments[k])
    ends = np.cumsum([0, *map(len, parts)])
    sums = [np.concatenate(([0], np.cumsum(x[token]))) for x in (score, pieces)]
    return tuple(x[ends[1:]] - x[ends[:-1]] for x in sums)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = PIECE_MODEL, scores: str = "stored") -> DataFrame:
    """(doc_id, n_tokens, score) for each row: pieces and score of the best path through the text.

    As the tokenizer library run in unigram mode over the same pieces and scores, with exact sums.
    Null and empty texts have no tokens and score 0; null ids and repeated rows are counted each; a
    space mark in the text counts as a space, as in the library; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bulk, single = engines(path, scores, 1.0)
        for batch in batches:
            for rows, texts in slices(batch):
                score, pieces = counts_of([t.decode() for t in texts], bulk, single)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pieces, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, score double")


def mixed(seed: np.ndarray, token: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on a row's seed, a token's number in it and an end in that."""
    with np.errstate(over="ignore"):
        x = seed + token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + end.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0**-53


def mixed_one(seed: int, token: int, end: int) -> float:
    """`mixed` of one number each."""
    wide = 0xFFFFFFFFFFFFFFFF
    x = (seed + token * 0x9E3779B97F4A7C15 + end * 0xD1B54A32D192ED03) & wide
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & wide
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & wide
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53


def row_seed(seed: int, doc_id: int | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}")


def encode_texts(texts: list[str], seeds: list[int], bulk: Bulk, single: Single) -> tuple[np.ndarray, np.ndarray]:
    """(flat piece ids, offsets by text) of sampled segmentations. Characters that no piece has are
    bytes, and so are space marks in the text, so that decoding is lossless; an empty text has no pieces."""
    parts = [t.split(" ") if t else [] for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    seed = np.repeat(np.array(seeds, np.uint64), sizes)
    number = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    segments, token = distinct([s for p in parts for s in p])
    classes, lengths, row, odd = sorted_rows(bulk, segments)
    total, states = bulk.forward(classes, lengths)
    odd_tokens = np.nonzero(row[token] < 0)[0]
    fit_tokens = np.nonzero(row[token] >= 0)[0]
    fit_rows = row[token[fit_tokens]]
    pieces = np.zeros(len(token), np.int64)
    steps = []
    for k, (t, ids) in enumerate(bulk.backward(total, states, fit_rows, lengths[fit_rows], lambda t, e: mixed(seed[fit_tokens[t]], number[fit_tokens[t]], e))):
        at = fit_tokens[t]
        pieces[at] = k + 1
        steps.append((at, ids))
    singles = {}
    for t in odd_tokens.tolist():
        draw = lambda e, s=int(seed[t]), n=int(number[t]): mixed_one(s, n, e)
        first, *rest = segments[token[t]].split(SPACE)
        ids, base = single.sample(SPACE + first, draw), len(first) + 1
        for part in rest:
            ids += single.bytes_of(SPACE)
            ids += single.sample(part, lambda e, b=base + 1: draw(b + e))
            base += len(part) + 1
        singles[t] = ids
        pieces[t] = len(ids)
    offsets = np.concatenate(([0], np.cumsum(pieces)))
    flat = np.zeros(offsets[-1], np.int32)
    for k, (at, ids) in enumerate(steps):
        flat[offsets[at + 1] - 1 - k] = ids
    for t, ids in singles.items():
        flat[offsets[t] : offsets[t + 1]] = ids
    return flat, offsets[ends]


def piece_bytes(v: Vocabulary) -> list[bytes]:
    table = [s.replace(SPACE, " ").encode() for s in v.surface]
    for b, i in enumerate(v.byte_ids):
        table[i] = bytes([b])
    return table


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])[1:]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = PIECE_MODEL, alpha: float = 1.0, seed: int = 0, verify: bool = True) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) for each row: a segmentation drawn with probability
    proportional to exp(alpha * score), by forward filtering and backward sampling over the lattice.

    The draw depends on seed, id and text alone, so it is the same wherever and whenever the row is
    worked on; repeated rows get equal pieces, and a null id has a seed of its own. Null and empty
    texts give no pieces. Very long texts are segments like any other. lossless: whether the pieces,
    decoded, are the text again (with verify; else null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bulk, single), table = engines(path, "rank", alpha), piece_bytes(vocabulary(path, "rank"))
        for batch in batches:
            for rows, texts in slices(batch):
                seeds = [row_seed(seed, i) for i in rows.column(0).to_pylist()]
                flat, offsets = encode_texts([t.decode() for t in texts], seeds, bulk, single)
                good = [decode_ids(flat[a:b].tolist(), table) == t if verify else None for t, a, b in zip(texts, offsets, offsets[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.diff(offsets), pa.int64()), pa.array(good, pa.bool_())], ["doc_id", "ids", "n_pieces", "lossless"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, text) for each row of piece ids; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(vocabulary(path, "rank"))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts = [decode_ids(ids or [], table).decode(errors="replace") for ids in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
