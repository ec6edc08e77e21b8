"""Exact-substring deduplication: prefix doubling over the bytes of all documents, on sampled positions.

Doubling over every position moves a row of dozens of bytes for each byte of text in each round. Here rows are
runs of neighbouring positions instead, one for about 35 bytes, ranked in rounds at growing lengths:

1. 32 bytes. A position's window of 100 bytes has the rank of its least 32-byte string (by a hash, in 69
   places). Equal windows have equal ranks, so positions are taken in runs of one rank. Spark counts the ranks;
   unique ones drop out, as no window there can occur again.
2. All bytes of a run, 100 and more. Spark ranks the pairs of the first rank and the run's whole bytes. Of runs of one
   pair all but the first repeat it, and go whole. Runs whose first rank has no other pair drop out.
3. 100 bytes. What is left, one run for each pair, meets the runs of its first rank, and its windows are sorted by
   their own bytes. A window that is not the first of its kind starts a string that also starts earlier.

A first rank with very many runs is not brought together: its windows are ranked as rows of their own.
Whole documents that equal an earlier one are settled by their text alone and take no part in the rounds.
The first rank only groups; runs, windows and texts are equated by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch, parts_of, slices, small
from wayfold.llm.minhash import mix

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # strings of GRAM bytes in a window
LAST_ID = (1 << 63) - 1  # rows without an id come last
#: Windows of a run at most: longer stretches of one least string, in periodic text, are several runs.
RUN = 128
#: Runs of one first rank that may meet in one task.
MEETING = 4096
#: Bytes worked on at a time; longer texts in pieces that overlap by a window less a byte.
PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_K = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def rolled(b: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each position on, by doubling."""
    n = len(b) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size = b.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        while True:
            if length & size:
                part = power[done : done + n]
                out = part.copy() if out is None else out + part * np.uint64(pow(_P, done, 1 << 64))
                done += size
            if size * 2 > length:
                return mix(out)
            power = power[:-size] + power[size:] * np.uint64(pow(_P, size, 1 << 64))
            size *= 2


def least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of the `span` values from each position on."""
    size, out = 1, h
    while size * 2 <= span:
        out = np.minimum(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    n = len(h) - span + 1
    return np.minimum(out[:n], out[span - size : span - size + n]) if n > 0 else h[:0]


def words8(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((max(len(b) - 7, 0),), "<u8", b.tobytes(), strides=(1,))


def pair_of(words: np.ndarray, place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each row: its words, each with its place in the row; rows begin at `starts`."""
    with np.errstate(over="ignore"):
        at = place.astype(np.uint64)
        return tuple(mix(np.add.reduceat(mix(words * k + mix(at + k)), starts)) for k in _K)


def runs(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows in pieces of text that end at `ends`: first ranks, two hashes of a run's bytes, first
    positions, numbers of windows, and whether a rank's string is there at more than one place."""
    h = rolled(b, GRAM)
    m = least(h, SPAN)
    if not len(m):
        return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    sizes = np.diff(ends, prepend=0)
    left = np.repeat(ends, sizes)[: len(m)] - np.arange(len(m))
    at = np.nonzero(left >= LENGTH)[0]  # windows within a piece
    fresh = np.ones(len(at), bool)
    fresh[1:] = (m[at[1:]] != m[at[:-1]]) | (at[1:] != at[:-1] + 1)
    start = np.nonzero(fresh)[0]
    count = np.diff(start, append=len(at))
    parts = -(-count // RUN)
    if (parts > 1).any():
        inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(count, parts)
        start, count = np.repeat(start, parts) + inner * RUN, np.minimum(whole - inner * RUN, RUN)
    first = at[start]
    rank = m[first]
    several = np.zeros(len(first), bool)
    for a in range(0, len(first), 4096):
        v, lo, hi = rank[a : a + 4096, None], first[a : a + 4096], first[a : a + 4096] + count[a : a + 4096] - 1
        several[a : a + 4096] = lo + (h[lo[:, None] + np.arange(SPAN)] == v).argmax(1) != hi + SPAN - 1 - (h[hi[:, None] + np.arange(SPAN - 1, -1, -1)] == v).argmax(1)
    # A run's bytes as words of eight, the last of which may overlap the one before.
    size = count + LENGTH - 1
    n = -(-size // 8)
    row = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(row, n)
    where = np.minimum(place * 8, np.repeat(size - 8, n)) + np.repeat(first, n)
    c1, c2 = pair_of(words8(b)[where] if len(where) else np.zeros(0, np.uint64), place + np.repeat(size << 8, n), row) if len(where) else (np.zeros(0, np.uint64),) * 2
    return rank, c1, c2, first, count, several


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, hash, more, text, doc_id): doc and hash order documents, by id and, under one id, by text; hash and more
    are 128 bits of the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                h = [xxhash.xxh3_128_intdigest(t) for t in texts]
                low, high = ([(x >> k & (1 << 64) - 1) - (1 << 63) for x in h] for k in (0, 64))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(low, pa.int64()), pa.array(high, pa.int64()), rows.column(1), rows.column(2)], ["doc", "hash", "more", "text", "doc_id"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ids = F.col(id_col).cast("long")
    return df.select(F.coalesce(ids, F.lit(LAST_ID)).alias("doc"), text.alias("text"), ids.alias("doc_id")).mapInArrow(run, "doc long, hash long, more long, text string, doc_id long")


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts with a window as flat bytes, a limited number at a time: bytes, ends of the pieces, and each one's text and offset in it."""
    now: list[tuple[int, int, bytes]] = []
    held = 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            now.append((k, at, part))
            held += len(part)
            if held >= PIECE:
                yield _flat(now)
                now, held = [], 0
    if now:
        yield _flat(now)


def _flat(now: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(p for *_, p in now), np.uint8), np.cumsum([len(p) for *_, p in now]), np.array([k for k, *_ in now]), np.array([a for _, a, _ in now])


def marks(docs: DataFrame) -> DataFrame:
    """(rank, c1, c2, doc, hash, at) of each run of windows; `at` packs its first position, whether its rank's string
    recurs in it, and its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                for b, ends, text, offset in pieces(texts):
                    rank, c1, c2, first, count, several = runs(b, ends)
                    piece = np.searchsorted(ends, first, side="right")
                    at = (first - (ends - np.diff(ends, prepend=0))[piece] + offset[piece]) << 9 | several.astype(np.int64) << 8 | count
                    who = pa.array(text[piece])
                    yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (rank, c1, c2)], rows.column(0).take(who), rows.column(1).take(who), pa.array(at)], ["rank", "c1", "c2", "doc", "hash", "at"])

    return docs.select("doc", "hash", "text").mapInArrow(run, "rank long, c1 long, c2 long, doc long, hash long, at long")


def contexts(docs: DataFrame) -> DataFrame:
    """(rank, crowded, doc, hash, first, bytes) of the wanted runs of docs with `wanted`, array<struct<rank, crowded, at>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                of = rows.column(3)
                at = [x.values.field(2).to_numpy() for x in of]
                who = pa.array(np.repeat(np.arange(len(texts)), [len(x) for x in at]))
                first = [x >> 9 for x in at]
                size = [(x & 255) + LENGTH - 1 for x in at]
                found = [t[a : a + n] for t, fs, ns in zip(texts, first, size, strict=True) for a, n in zip(fs.tolist(), ns.tolist(), strict=True)]
                flat = pa.concat_arrays([x.values for x in of]) if len(of) else pa.array([])
                yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(1), rows.column(0).take(who), rows.column(1).take(who), pa.array(np.concatenate(first).astype(np.int64)), pa.array(found, pa.binary())], ["rank", "crowded", "doc", "hash", "first", "bytes"])

    return docs.select("doc", "hash", "text", "wanted").mapInArrow(run, "rank long, crowded boolean, doc long, hash long, first long, bytes binary")


def windows(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window of the byte strings, the string that it is in, and its place there."""
    sizes = np.array([len(x) for x in found])
    w = words8(np.frombuffer(b"".join(found), np.uint8))
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(found)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = place + np.repeat(np.cumsum(sizes) - sizes, n)
    out = [np.zeros(len(row), np.uint64) for _ in _K]
    with np.errstate(over="ignore"):
        for j, shift in enumerate((*range(0, LENGTH - 8, 8), LENGTH - 8)):
            part = w[start + shift]
            for k, salt in enumerate(_K):
                out[k] += mix(part * salt + mix(np.uint64(j + 1) * salt))
    return out[0], out[1], row, place


def spans_of(repeated: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of the stretches of repeated windows."""
    at = np.nonzero(repeated)[0]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (row[at[1:]] != row[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)
    begin = np.nonzero(fresh)[0]
    stop = np.append(begin[1:], len(at))[: len(begin)] - 1
    return row[at[begin]], place[at[begin]], place[at[stop]]


def met(found: DataFrame) -> DataFrame:
    """(doc, hash, start, end) of windows that are not the first of their bytes among the runs of their first rank."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        w1, w2, row, place = windows(rows.column("bytes").to_pylist())
        order = np.lexsort((w2, w1))  # stable: equal windows stay in the order of documents and positions
        repeated = np.zeros(len(row), bool)
        repeated[order[1:]] = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
        row, lo, hi = spans_of(repeated, row, place)
        first = rows.column("first").to_numpy()[row]
        take = pa.array(row)
        doc, hash_ = (rows.column(c).combine_chunks().take(take) for c in ("doc", "hash"))
        return pa.RecordBatch.from_arrays([doc, hash_, pa.array(first + lo), pa.array(first + hi + LENGTH)], ["doc", "hash", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            rank = held.column("rank").to_numpy()
            last = int(np.searchsorted(rank, rank[-1]))  # the last rank may go on in the next batch
            if last:
                yield settle(distinct(held.slice(0, last)))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield settle(distinct(held))

    def distinct(rows: pa.Table) -> pa.Table:
        """Without runs that are there again because their document's row is."""
        columns = [rows.column(c).to_numpy() for c in ("rank", "doc", "hash", "first")]
        other = np.ones(rows.num_rows, bool)
        other[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return rows.filter(pa.array(other))

    sorted_ = found.repartition(parts_of(found.sparkSession), "rank").sortWithinPartitions("rank", "doc", "hash", "first")
    return sorted_.select("rank", "doc", "hash", "first", "bytes").mapInArrow(run, "doc long, hash long, start long, end long")


def crowded(found: DataFrame) -> DataFrame:
    """The same of first ranks with very many runs, with a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                rows = batch.slice(a, 2048)
                w1, w2, row, place = windows(rows.column(3).to_pylist())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), rows.column(0).take(take), rows.column(1).take(take), pa.array(rows.column(2).to_numpy()[row] + place)], ["w1", "w2", "doc", "hash", "start"])

    rows = found.select("doc", "hash", "first", "bytes").mapInArrow(run, "w1 long, w2 long, doc long, hash long, start long")
    one = F.struct("doc", "hash", "start")
    lead = rows.groupBy("w1", "w2").agg(F.min(one).alias("lead"))
    return rows.join(lead, ["w1", "w2"]).filter(one != F.col("lead")).select("doc", "hash", "start", (F.col("start") + LENGTH).alias("end"))


def digest(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept, at, removed = hashlib.sha256(), 0, 0
    view = memoryview(text)
    for a, b in spans:
        kept.update(view[at:a])
        removed, at = removed + b - a, b
    kept.update(view[at:])
    return len(text), removed, len(spans), kept.hexdigest()


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and adjoining stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row: the text's UTF-8 bytes without
    those covered by a 100-byte string that also starts earlier (smaller id, or same document, earlier).

    spans: the removed stretches, array<struct<start, end>>. Null and empty texts have no bytes. Rows with
    equal id and text are one document and have equal results; under one id with several texts, and among
    rows without an id (which come last), the order is by a hash of the text. Very long texts take part
    whole; an empty table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    docs = keyed(df, id_col, text_col)
    known = docs.select("doc", "hash", "more", F.octet_length("text").alias("bytes")).filter(F.col("bytes") >= LENGTH).distinct()
    # Documents of one text have one hash and length; all but the first are copies.
    order = F.struct("doc", "hash")
    known = scratch.write(known, "known")
    lead = known.groupBy("hash", "more", "bytes").agg(F.min(order).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = small(scratch.write(known.join(lead, ["hash", "more", "bytes"]).filter(order != F.col("lead")).select("doc", "hash"), "copies"))
    own = docs.filter(F.octet_length("text") >= LENGTH).join(copies, ["doc", "hash"], "left_anti")

    rows = scratch.write(marks(own), "marks")
    several = F.col("at").bitwiseAND(256) > 0
    ranks = rows.groupBy("rank").agg(F.count("*").alias("n"), F.max(several).alias("several")).filter("n > 1 OR several").select("rank")
    rows = scratch.write(rows.join(ranks, "rank"), "again")
    scratch.drop("marks", "known")
    member = F.struct("doc", "hash", "at")
    kinds = scratch.write(rows.groupBy("rank", "c1", "c2").agg(F.min(member).alias("lead"), F.count("*").alias("n")), "kinds")
    following = rows.join(kinds.filter("n > 1").select("rank", "c1", "c2", "lead"), ["rank", "c1", "c2"]).filter(member != F.col("lead"))
    first, count = F.shiftright("at", 9), F.col("at").bitwiseAND(255)
    whole = scratch.write(following.select("doc", "hash", first.alias("start"), (first + count + LENGTH - 1).alias("end")), "whole")
    scratch.drop("again")
    number = kinds.groupBy("rank").agg(F.count("*").alias("kinds"), F.max(F.col("lead.at").bitwiseAND(256) > 0).alias("several")).filter("kinds > 1 OR several")
    left = kinds.join(number, "rank").select("lead.doc", "lead.hash", F.struct("rank", (F.col("kinds") > MEETING).alias("crowded"), "lead.at").alias("one"))
    wanted = left.groupBy("doc", "hash").agg(F.collect_list("one").alias("wanted"))  # no longer than the document
    found = scratch.write(contexts(own.join(wanted, ["doc", "hash"])), "found")
    scratch.drop("kinds")
    parts = whole.union(met(found.filter("NOT crowded"))).union(crowded(found.filter("crowded")))
    spans = scratch.write(parts.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop("found", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part, texts in slices(batch):
                found = [merged(x or []) for x in part.column(2).to_pylist()]
                found = [[(0, len(t))] if c else s for t, c, s in zip(texts, part.column(3).to_pylist(), found, strict=True)]
                n, removed, count, sha = zip(*[digest(t, s) for t, s in zip(texts, found, strict=True)], strict=True)
                listed = [[{"start": a, "end": b} for a, b in s] for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, count)], pa.array(sha, pa.string()), pa.array(listed, kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    all_ = docs.join(copies.withColumn("copy", F.lit(True)), ["doc", "hash"], "left").join(spans, ["doc", "hash"], "left")
    return all_.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
