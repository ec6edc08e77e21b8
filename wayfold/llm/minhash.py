"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of band keys are computed for each document, `TABLES` each of `BAND` minhashes.
A table of the index is one pair of bands, one from either collection, so that TABLES * TABLES tables
come from 2 * TABLES * BAND minhashes. Two documents of similarity 0.75 share no table with a
probability below 0.0006. Every candidate is confirmed on the full shingle sets.

Steps, each on what the one before leaves:
1. Documents with equal shingle sets are one vertex, represented by the smallest id.
2. In each bucket of each table, every member is compared with one leader (a star, not all pairs).
   Confirmed links give components. Pairs inside a component need no further comparison: they cannot
   change it.
3. In buckets that hold several components, further stars with other leaders, the first of their bucket in
   an order by a hash of the id, so that buckets share leaders.
4. Buckets that still hold several components are gathered by leader: whoever shares a bucket shares its
   leader's group. In a group, the members outside its largest component are compared with all members of a
   size that allows a link, whole sets, in pairs of blocks whose intersections are matrix products. No pair
   is a row, and none is passed over. A group of m has about sqrt(m / BLOCK) blocks, so that its sets are copied
   m ** 1.5 times in all, not m ** 2.
Sets of candidates only are moved; joins are on ids, which Spark may split where one is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch, documents, few_rows, parts_of, slices, words

SHINGLE_WORDS = 5
SIMILARITY = 75  # hundredths
BAND, TABLES = 2, 10
#: Stars before all that is left is compared.
STARS = 3
#: Blocks grow with the square root of their number: documents of a group of one block, and the most shingles of
#: any block, which is what a task holds.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Sets multiplied at a time, so that the matrices do not grow with the block.
AT_ONCE = 512
#: A set that at least this part of all documents have is one of at most HOT, which go to every task.
HOT = 4096
#: Pairs and rows with whole sets that are handed to Python at a time.
ROWS_WITH_SETS = 250

_rng = np.random.default_rng(20)
_POWERS = _rng.integers(1, 1 << 62, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 1 << 62, 2 * TABLES * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 2 * TABLES * BAND, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: its runs of `size` words; of a text with
    fewer words the whole sequence; of one without words nothing."""
    index: dict[bytes, int] = {}
    found = [words(t) for t in texts]
    number = [np.fromiter([index.setdefault(w, len(index)) for w in ws], np.int64, len(ws)) for ws in found]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    out = []
    with np.errstate(over="ignore"):
        for n in number:
            h, k = hashes[n], min(size, len(n))
            total = np.full(max(len(h) - k + 1, 0) if k else 0, k, np.uint64)
            for j in range(k):
                total += mix(h[j : j + len(total)] + np.uint64(j)) * _POWERS[j]
            out.append(np.unique(mix(total)))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * TABLES band keys for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), 2 * TABLES), np.uint64)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
            out[:, k // BAND] = mix(out[:, k // BAND] + np.minimum.reduceat(mix(flat * a + b), starts) + np.uint64(k))
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                sets = shingle_sets(texts)
                full = [k for k, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), 2 * TABLES), np.int64)
                if full:
                    bands[full] = band_keys([sets[k] for k in full])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), 2 * TABLES).cast(pa.list_(pa.int64()))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n, shingles) of the wanted documents, the hashes packed as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "shingles"])

    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    size = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity) & (F.least("n_a", "n_b") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").filter(size).select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, component) of every document with a link: the smallest id that it reaches. Labels move
    along links and then to their own labels' labels, until none changes."""
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    labels = scratch.write(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "doc_id").select("doc_id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        to = moved.select(F.col("doc_id").alias("now"), F.col("now").alias("beyond"))
        labels = scratch.write(moved.join(to, "now").select("doc_id", "was", F.col("beyond").alias("component")), "labels")
        if labels.filter(F.col("was") != F.col("component")).isEmpty():
            scratch.drop("both")
            return labels.select("doc_id", "component")
        scratch.drop_older("labels")
        labels = labels.select("doc_id", "component")


def star(rest: DataFrame, turn: int, similarity: int) -> DataFrame:
    """(a, b): each bucket's leader with the members of other components, if sizes allow a link."""
    order = F.struct(F.xxhash64(F.col("doc_id"), F.lit(turn)), F.col("doc_id"), F.col("n"), F.col("component")) if turn else F.struct(F.col("doc_id").alias("o"), F.col("doc_id"), F.col("n"), F.col("component"))
    lead = rest.groupBy("bucket").agg(F.min(order).alias("lead")).select("bucket", F.col("lead.doc_id").alias("leader"), F.col("lead.n").alias("n_l"), F.col("lead.component").alias("component_l"))
    sizes = F.least("n", "n_l") * 100 >= F.greatest("n", "n_l") * similarity
    return rest.join(lead, "bucket").filter((F.col("component") != F.col("component_l")) & sizes).select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()


def dealt(rest: DataFrame, similarity: int) -> DataFrame:
    """(g, c, i, j, side, component, doc_id): the members of open buckets as pairs of blocks. Buckets are gathered by
    their leader; a group's members outside its largest component (side 0, block i) meet all its members whose sizes
    allow a link (side 1, block j). Sizes are in classes of a factor 100 / similarity, so that a link joins equal
    or neighbouring classes."""
    lead = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(STARS)), "doc_id"))["doc_id"].alias("g"))
    grouped = rest.join(lead, "bucket").select("g", "doc_id", "component", F.col("n"), F.floor(F.log("n") / math.log(100 / similarity)).alias("c")).distinct()
    sizes = grouped.groupBy("g", "component").agg(F.count("*").alias("size"))
    major = sizes.groupBy("g").agg(F.max_by("component", "size").alias("major"))
    x = grouped.join(major, "g").filter("component <> major").drop("major")
    y = grouped.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    blocks = lambda df, name: df.groupBy("g", "c").agg(F.ceil(F.greatest(F.sqrt(F.count("*") / BLOCK), F.sum("n") / BLOCK_SHINGLES)).alias(name))
    plan = blocks(x, "x_blocks").join(blocks(y, "y_blocks"), ["g", "c"])
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("g", "c", "i", "j", "side", "component", "doc_id")
    left = x.join(plan, ["g", "c"]).withColumns({"i": own("x_blocks"), "side": F.lit(0)}).withColumn("j", every("y_blocks")).select(*columns)
    right = y.join(plan, ["g", "c"]).withColumns({"j": own("y_blocks"), "side": F.lit(1)}).withColumn("i", every("x_blocks")).select(*columns)
    return left.union(right)


def settled(rest: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links between the components of open buckets, one at least for each document and component
    of a block that it is linked with."""
    key = ("g", "c", "i", "j")

    def links(members: list[tuple[int, int, int, np.ndarray]]) -> np.ndarray:
        (kind_x, ids_x, sets_x), (kind_y, ids_y, sets_y) = ([np.array([m[1] for m in part]), np.array([m[2] for m in part]), [m[3] for m in part]] for part in ([m for m in members if m[0] == s] for s in (0, 1)))
        if not len(ids_x) or not len(ids_y):
            return np.zeros((0, 2), np.int64)
        order_x, order_y = (np.argsort([len(s) for s in part], kind="stable") for part in (sets_x, sets_y))
        out = [np.zeros((0, 2), np.int64)]
        for x in (order_x[k : k + AT_ONCE] for k in range(0, len(order_x), AT_ONCE)):
            for y in (order_y[k : k + AT_ONCE] for k in range(0, len(order_y), AT_ONCE)):
                if 100 * min(len(sets_x[x[-1]]), len(sets_y[y[-1]])) < similarity * max(len(sets_x[x[0]]), len(sets_y[y[0]])):
                    continue  # all of one side are too small for the other's
                row, column = np.nonzero(similar([sets_x[k] for k in x], [sets_y[k] for k in y], similarity) & (kind_x[x][:, None] != kind_y[y]))
                _, one = np.unique(np.stack([row, kind_y[y][column]]), axis=1, return_index=True)
                out.append(np.sort(np.stack([ids_x[x[row[one]]], ids_y[y[column[one]]]], 1), 1))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []

        def flush() -> pa.RecordBatch:
            found = links(members)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], ["a", "b"])

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)
            for k, (*at, side, kind, doc) in enumerate(rows):
                if at != now:
                    if members:
                        yield flush()
                    now, members = at, []
                members.append((side, kind, doc, np.frombuffer(batch.column(7)[k].as_buffer(), np.uint64)))
        if members:
            yield flush()

    both = dealt(rest, similarity).join(sets.select("doc_id", "shingles"), "doc_id").select(*key, "side", "component", "doc_id", "shingles")
    return both.repartition(parts_of(rest.sparkSession), *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: int, columns: int = 8192) -> np.ndarray:
    """Which of all pairs of two lists of sets are similar enough; by products of incidence matrices."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    both = np.zeros((len(left), len(right)))
    for at in range(0, len(shared), columns):
        part = shared[at : at + columns]
        sides = []
        for group in (left, right):
            m = np.zeros((len(group), len(part)), np.float32)
            for k, s in enumerate(group):
                place = np.searchsorted(part, s)
                place[place == len(part)] = 0
                m[k, place[part[place] == s]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    n, m = (np.array([len(s) for s in g], float) for g in (left, right))
    return (100 * both >= similarity * (n[:, None] + m[None] - both)) & (both > 0)


def attached(rows: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """rows left joined with values (set_key, copies, component_id) by set_key. Sets that many rows have are
    few, and go to every task; no other key has more than a HOT-th of the rows."""
    hot = F.broadcast(values.filter(F.col("copies") * HOT >= total).select("set_key", "component_id"))  # at most HOT rows
    cold = values.filter(F.col("copies") * HOT < total).select("set_key", "component_id")
    return rows.join(hot, "set_key").union(rows.join(hot, "set_key", "left_anti").join(cold, "set_key", "left"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    n_shingles: the size of the document's set. component_id: the smallest id that it reaches over links
    of at least `similarity` hundredths, its own included. kept: it is that document. Null and empty
    texts, and texts of white space, have an empty set and no links. Rows with equal ids and texts are one
    document (all of them kept or none); under one id with several texts, each row goes by its own text's
    links. A row without an id has no links, no component, and is kept. An empty table gives an empty
    table; other columns are ignored. Very long texts take part whole. Ties: the smallest id of a component stays.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = documents(df, id_col, text_col)
    signed = scratch.write(signatures(docs), "signed")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.write(some.groupBy("set_key").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "bands")).alias("first"), F.count("*").alias("copies")), "classes")
    firsts = classes.select("first.*").repartition(parts_of(spark), "doc_id")

    pair = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(TABLES)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(TABLES)), lambda j: F.xxhash64(i, j, F.element_at("bands", i), F.element_at("bands", j + TABLES)))))
    entries = firsts.select("doc_id", "n", F.explode(pair).alias("bucket"))
    full = entries.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("bucket")
    members = scratch.write(entries.join(full, "bucket"), "members")
    rest = members.withColumn("component", F.col("doc_id"))  # later: what buckets hold besides components
    with few_rows(spark, ROWS_WITH_SETS):
        sets = scratch.write(sets_of(docs.filter("doc_id IS NOT NULL"), members.select("doc_id").distinct()), "sets")
        seen = links = None
        for turn in range(STARS + 1):
            if turn < STARS:
                pairs = star(rest, turn, similarity)
                pairs = scratch.write(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
                seen = pairs if seen is None else seen.union(pairs)
                new = scratch.write(confirmed(pairs, sets, similarity), "links")
            else:
                new = scratch.write(settled(rest, sets, similarity), "links")
            links = new if links is None else links.union(new)
            if turn == 0 or not new.isEmpty():
                found = components(links, scratch)
            if turn < STARS:
                scratch.drop("rest")
                labelled = members.join(found, "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
                open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
                rest = scratch.write(labelled.join(open_, "bucket"), "rest")
                if rest.isEmpty():
                    break
    scratch.drop("members", "rest", "sets", "pairs", "links")
    of = classes.select("set_key", "copies", F.col("first.doc_id").alias("doc_id")).join(found, "doc_id", "left")
    of = of.select("set_key", "copies", F.coalesce("component", "doc_id").alias("component_id"), "doc_id").filter("copies > 1 OR component_id <> doc_id").drop("doc_id")
    joined = attached(some.select("set_key", "doc_id", "n_shingles"), of, signed.count()).drop("set_key")
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    each = joined.union(alone).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return each.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
