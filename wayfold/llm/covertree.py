"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Vectors are dealt to blocks: by the nearest of a few pivots, and within a pivot's cell by a hash of the
id, so that no block outgrows `BLOCK` on average, however many vectors lie together. Each block of the
data and each block of the queries becomes a cover tree. A pair of nodes is pruned if the bound
    <q, d> <= <cq, cd> + rq |cd| + rd |cq| + rq rd
(centres c, covering radii r) is below the worst kth score of the query node's queries. First every query
block meets the data of its own cell, which gives kth scores; with these, whole pairs of blocks are pruned
by their roots' bounds before any vector moves, and the rest are searched.

Pivots are a bounded sample (`PIVOTS` vectors): they decide only where a vector lies, never a result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch

PIVOTS = 16
BLOCK = 1024
#: Points of a leaf, of the data's trees and of the queries'.
LEAF, QUERY_LEAF = 64, 192
#: Each level's covering radius is at most the one above it divided by this.
BASE = 1.3
#: The summaries of query blocks are copied so often, those of data blocks dealt among the copies.
SALTS = 16


class CoverTree:
    """Nodes in breadth-first order: centre, covering radius, children (first, end) and points (first, end)
    in the tree's own order of the vectors. A leaf has at most `leaf` points, or equal ones."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        x = vectors.astype(np.float64)
        square = (x**2).sum(1)
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * (x @ x.T), 0)) if len(x) <= 4 * BLOCK else None

        def distances(k: int, rows: np.ndarray) -> np.ndarray:
            return apart[k, rows] if apart is not None else np.sqrt(((x[rows] - x[k]) ** 2).sum(1))

        todo = [(np.arange(len(ids)), distances(0, np.arange(len(ids))))]
        kept, centre, radius, first, end, points = [], [], [], [], [], []
        at = 0
        while at < len(todo):  # todo grows as nodes are split; its order is the nodes' order
            rows, distance = todo[at]
            at += 1
            centre.append(rows[0])
            radius.append(float(distance.max()))
            first.append(len(todo))
            if len(rows) > leaf and radius[-1] > 0:
                todo.extend(self.split(distances, rows, distance, radius[-1] / BASE))
            end.append(len(todo))
            points.append(rows if first[-1] == end[-1] else None)
        n = len(centre)
        self.first, self.end = np.array(first), np.array(end)
        self.start, self.stop = np.zeros(n, np.int64), np.zeros(n, np.int64)
        filled = 0
        for k in range(n):
            if points[k] is not None:
                kept.append(points[k])
                self.start[k], self.stop[k] = filled, filled + len(points[k])
                filled += len(points[k])
        place = np.concatenate(kept)
        self.ids, self.vectors = ids[place], vectors[place]
        self.centre, self.radius = x[centre].astype(vectors.dtype), np.array(radius)

    @staticmethod
    def split(distances, rows: np.ndarray, distance: np.ndarray, reach: float) -> list:
        """Children: centres farther than `reach` apart, each with the points that no earlier one covers."""
        out = []
        while len(rows):
            near = distance <= reach
            out.append((rows[near], distance[near]))
            rows = rows[~near]
            if len(rows):
                distance = distances(rows[0], rows)
        return out


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.score, self.id, self.k = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max), k
        self.least = least  # kth scores known from elsewhere

    def worst(self, rows: slice) -> float:
        return float(np.maximum(self.score[rows, -1], self.least[rows]).min())

    def add(self, rows: slice, own: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.where(ids[None] == own[:, None], -np.inf, score)
        if score.shape[1] > 4 * self.k:  # only what can be among the k best, with all ties
            kth = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            some = (score >= kth).any(0)
            score, ids = score[:, some], ids[some]
        score, ids = np.concatenate([self.score[rows], score], 1), np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], 1)
        order = np.lexsort((ids, -score))[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def search(q: CoverTree, d: CoverTree, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores): each query's k best of d that reach its `least`."""
    best = Best(len(q.ids), k, least)
    qc, dc = q.centre.astype(np.float64), d.centre.astype(np.float64)
    q_norm, d_norm = np.sqrt((qc**2).sum(1)), np.sqrt((dc**2).sum(1))
    qv, dv = q.vectors.astype(np.float64), d.vectors.astype(np.float64)

    def span(node: int) -> slice:
        """The queries below a node: the leaves' ranges below it are not contiguous, so leaves only."""
        return slice(q.start[node], q.stop[node])

    worst: dict[int, float] = {}

    def worst_of(node: int) -> float:
        if q.first[node] == q.end[node]:
            return best.worst(span(node))
        return min(worst.get(c, -np.inf) for c in range(q.first[node], q.end[node]))

    def prune(node: int, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = dc[frontier] @ qc[node] + q.radius[node] * d_norm[frontier] + d.radius[frontier] * (q_norm[node] + q.radius[node])
        bound += 1e-9 * (1 + np.abs(bound))
        keep = bound >= worst.get(node, -np.inf)
        frontier, bound = frontier[keep], bound[keep]
        order = np.argsort(-bound, kind="stable")
        return frontier[order], bound[order]

    def opened(nodes: np.ndarray) -> np.ndarray:
        """The children of inner nodes, and leaves as they are."""
        inner = d.first[nodes] < d.end[nodes]
        return np.concatenate([nodes[~inner], *[np.arange(d.first[n], d.end[n]) for n in nodes[inner]]]) if inner.any() else nodes

    def visit(node: int, frontier: np.ndarray) -> None:
        frontier, _ = prune(node, frontier)
        if not len(frontier):
            return
        if q.first[node] < q.end[node]:
            wide = frontier[d.radius[frontier] >= q.radius[node] / 2]
            rest = np.concatenate([opened(wide), frontier[d.radius[frontier] < q.radius[node] / 2]])
            for child in range(q.first[node], q.end[node]):
                visit(child, rest)
            worst[node] = worst_of(node)
            return
        rows = span(node)
        while len(frontier):
            leaf = d.first[frontier] == d.end[frontier]
            leaves, inner = frontier[leaf], frontier[~leaf]
            while len(leaves):
                taken = int(np.searchsorted(np.cumsum(d.stop[leaves] - d.start[leaves]), 512)) + 1
                at = np.concatenate([np.arange(d.start[n], d.stop[n]) for n in leaves[:taken]])
                best.add(rows, q.ids[rows], qv[rows] @ dv[at].T, d.ids[at])
                worst[node] = best.worst(rows)
                leaves, _ = prune(node, leaves[taken:])
            if len(inner):
                inner, _ = prune(node, inner)
            frontier, _ = prune(node, opened(inner)) if len(inner) else (inner, None)

    for node in range(len(q.first)):
        if q.first[node] == q.end[node]:
            worst[node] = best.worst(span(node))
    for node in range(len(q.first) - 1, -1, -1):
        if q.first[node] < q.end[node]:
            worst[node] = worst_of(node)
    visit(0, np.array([0]))
    x, y = np.nonzero((best.score > -np.inf) & (best.score >= least[:, None]))
    return q.ids[x], best.id[x, y], best.score[x, y]


def packed(entries: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids = entries.field("vec_id").to_numpy(zero_copy_only=False)
    v = entries.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    top = np.abs(v).max(initial=0)
    return ids, v.astype(np.int8 if top < 128 else np.int16 if top < 32768 else np.int64)


def trees(blocks: DataFrame, leaf: int) -> DataFrame:
    """(dim, cell, block, tree, centre, radius) of each block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = CoverTree(*packed(batch.column(3)[k].values), leaf)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(3)], pa.array([pickle.dumps(t)], pa.binary()), pa.array([t.centre[0].astype(float).tolist()]), pa.array([float(t.radius[0])])], ["dim", "cell", "block", "tree", "centre", "radius"])

    return blocks.mapInArrow(run, "dim int, cell int, block long, tree binary, centre array<double>, radius double")


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): what each pair of blocks contributes. pairs: q_tree, least, d_tree; least
    maps query ids to the kth scores known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q, d = (pickle.loads(batch.column(c)[r].as_buffer()) for c in (0, 2))
                known = {x["i"]: x["s"] for x in batch.column(1)[r].as_py() or []}
                found = search(q, d, k, np.array([known.get(i, -np.inf) for i in q.ids.tolist()], float))
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2].astype(np.int64))], ["query_id", "vec_id", "score"])

    return pairs.select("q_tree", "least", "d_tree").mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k vectors of
    the highest inner product with it, itself excluded, equal scores by smaller id. Components are
    floor(scale * x).

    Vectors that are null or empty or hold a null or non-finite component take no part, nor do rows
    without an id. Rows with the same id are one vector, the smallest of them. Vectors of different
    lengths are not compared. An empty table gives an empty table; other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = raw.filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    vectors = scratch.write(fine.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    pivots = [np.array(r.v, float) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, dims = [], []
            for v in batch.column(1):
                x = v.values.to_numpy()
                near = [((x - p) ** 2).sum() if len(p) == len(x) else np.inf for p in pivots]
                cells.append(int(np.argmin(near)))
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(cells, pa.int32())], ["vec_id", "v", "dim", "cell"])

    dealt = scratch.write(vectors.mapInArrow(celled, "vec_id long, v array<long>, dim int, cell int"), "dealt")

    def blocks(rows: DataFrame, leaf: int) -> DataFrame:
        of = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        return trees(rows.join(of, ["dim", "cell"]).groupBy("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("entries")), leaf)

    name = lambda t, p: t.select(*[F.col(c).alias(f"{p}_{c}") for c in t.columns])
    d = name(scratch.write(blocks(dealt, LEAF), "data"), "d")
    q = name(scratch.write(blocks(dealt.filter(F.col("vec_id") % every == 0), QUERY_LEAF), "queries"), "q")
    own = q.join(d, (F.col("q_dim") == F.col("d_dim")) & (F.col("q_cell") == F.col("d_cell"))).withColumn("least", F.lit(None).cast("array<struct<i:bigint,s:bigint>>"))
    near = scratch.write(searched(own, k), "near")
    kth = ranked(near, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    of = dealt.filter(F.col("vec_id") % every == 0).groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    least = dealt.select("vec_id", "dim", "cell").filter(F.col("vec_id") % every == 0).join(of, ["dim", "cell"]).join(kth, "vec_id", "left").groupBy(
        F.col("dim").alias("q_dim"), F.col("cell").alias("q_cell"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("q_block")
    ).agg(F.collect_list(F.when(F.col("score").isNotNull(), F.struct(F.col("vec_id").alias("i"), F.col("score").alias("s")))).alias("least"), F.when(F.count("*") == F.count("score"), F.min("score")).alias("worst"))
    q_keys, d_keys = ["q_dim", "q_cell", "q_block"], ["d_dim", "d_cell", "d_block"]
    least = scratch.write(least, "least")
    q_roots = q.drop("q_tree").join(least.drop("least"), q_keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d_roots = d.drop("d_tree").withColumn("salt", F.pmod(F.xxhash64(*d_keys), F.lit(SALTS)).cast("int"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    bound = dot("q_centre", "d_centre") + F.col("q_radius") * norm("d_centre") + F.col("d_radius") * (norm("q_centre") + F.col("q_radius"))
    met = (F.col("q_dim") == F.col("d_dim")) & (q_roots["salt"] == d_roots["salt"])
    pairs = q_roots.join(d_roots, met).filter(F.col("q_cell") != F.col("d_cell")).filter(F.col("worst").isNull() | (bound + F.abs(bound) * 1e-9 + 1e-6 >= F.col("worst"))).select(*q_keys, *d_keys)
    payload = pairs.join(q.select(*q_keys, "q_tree"), q_keys).join(least.select(*q_keys, "least"), q_keys).join(d.select(*d_keys, "d_tree"), d_keys)
    far = scratch.write(searched(payload, k), "far")
    return ranked(near.union(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
