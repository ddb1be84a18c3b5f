"""Problem 2: the k most similar vectors of every vector, within its run.

Method: vantage-point trees per shard. A small tree fitted on a bounded sample of each run (FIT vectors) routes every
vector to a shard, so a shard is a cell of that tree; inside a shard a further tree is built over all its vectors. A query
searches its own shard first, which bounds the distance of its k-th neighbour, then those shards and branches that the
triangle inequality cannot rule out. `factor` scales that bound: 1 keeps the search exact, less prunes more.
Distances are Euclidean between unit vectors, which order as cosines do. Queries go through a tree in blocks.

Skew: equal vectors are one class, searched once; of a class only its k + 1 smallest ids can be anyone's neighbours, so a
class may hold any share of the rows. Cells larger than SHARD are split further by the hash of the id, and the queries of a
shard are cut into blocks.

Defined results: null ids, null vectors, wrong lengths, null, NaN or infinite components and all-zero vectors take no part;
a repeated row counts once; ties (to ten decimals) go to the smaller row_id; runs without dimension have no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.keys import measured_broadcast, one_per_key
from corpusloom.session import cut

K = 5
FACTOR = 0.8
NO_PRUNING = 1e9
FIT, SHARD, LEAF, QUERIES = 2048, 4096, 256, 16384
SLACK = 1e-5


# --- trees over unit vectors ---------------------------------------------------------------------------------------


def build(x: np.ndarray, leaf: int) -> list:
    """Nodes [vantage point, radius, inside, outside] or [None, row indices]; children are node numbers, the root is 0."""
    nodes: list = []

    def grow(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(None)
        if len(rows) > leaf:
            vp = x[rows[len(rows) // 2]]
            d = distance(x[rows] @ vp)
            mu = float(np.median(d))
            inner, outer = rows[d <= mu], rows[d > mu]
            if len(inner) and len(outer):
                nodes[me] = [vp, mu, grow(inner), grow(outer)]
                return me
        nodes[me] = [None, rows]
        return me

    grow(np.arange(len(x)))
    return nodes


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


class Search:
    """k-nearest search of a block of queries in one tree, by branch and bound."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, factor: float, tau: np.ndarray | None = None) -> None:
        self.x, self.ids, self.q, self.k, self.factor = x, ids, q, k, factor
        self.x32, self.q32 = x.astype(np.float32), q.astype(np.float32)
        self.sim = np.full((len(q), k), -9.0)
        self.nb = np.full((len(q), k), np.iinfo(np.int64).max)
        self.most = np.full(len(q), 3.0) if tau is None else tau.copy()  # distance that a neighbour may have at most
        self.nodes = build(x, LEAF)
        self.visit(0, np.arange(len(q)))

    def visit(self, at: int, qi: np.ndarray) -> None:
        if not len(qi):
            return
        node = self.nodes[at]
        if node[0] is None:
            self.scan(node[1], qi)
            return
        vp, mu, inner, outer = node
        d = distance(self.q[qi] @ vp)
        inside = d <= mu
        self.visit(inner, qi[inside])
        self.visit(outer, qi[~inside])
        reach = np.abs(d - mu) <= self.factor * self.most[qi] + SLACK
        self.visit(outer, qi[inside & reach])
        self.visit(inner, qi[~inside & reach])

    def scan(self, rows: np.ndarray, qi: np.ndarray) -> None:
        s = self.q32[qi] @ self.x32[rows].T
        least = 1.0 - self.most[qi] ** 2 / 2
        fresh = np.flatnonzero(self.most[qi] >= 3.0)
        if len(fresh) and len(rows) > self.k:
            least[fresh] = np.partition(s[fresh], len(rows) - self.k, axis=1)[:, len(rows) - self.k]
        a, b = np.nonzero(s >= (least - SLACK)[:, None])
        if not len(a):
            return
        qa, rb = qi[a], rows[b]
        exact = np.round(np.einsum("ij,ij->i", self.q[qa], self.x[rb]), 10)
        touched = np.unique(qa)
        old = np.repeat(touched, self.k)
        qs = np.concatenate([qa, old])
        sims = np.concatenate([exact, self.sim[touched].ravel()])
        ids = np.concatenate([self.ids[rb], self.nb[touched].ravel()])
        o = np.lexsort((ids, -sims, qs))
        qs, sims, ids = qs[o], sims[o], ids[o]
        first = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
        rank = np.arange(len(qs)) - np.repeat(first, np.diff(np.r_[first, len(qs)]))
        ok = rank < self.k
        self.sim[qs[ok], rank[ok]] = sims[ok]
        self.nb[qs[ok], rank[ok]] = ids[ok]
        kth = self.sim[touched, self.k - 1]
        full = kth > -5
        self.most[touched[full]] = np.minimum(self.most[touched[full]], distance(kth[full]) + SLACK)


def unit(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- the distributed search ----------------------------------------------------------------------------------------


def valid(vectors: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, row_id, embedding) of the vectors that take part, one row for each run and row."""
    dims = runs.filter("run_id is not null").groupBy("run_id").agg(F.max("embedding_dimension").alias("dim"))
    v = vectors.filter("run_id is not null and row_id is not null and embedding is not null").select("run_id", "row_id", "embedding")
    v = v.join(measured_broadcast(cut(dims)), "run_id").filter(F.size("embedding") == F.col("dim"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    v = v.filter(~bad & F.exists("embedding", lambda e: e != 0)).select("run_id", "row_id", "embedding")
    return one_per_key(v, ["run_id", "row_id"])


def _cells(sample: DataFrame, shards: dict[int, int]) -> dict[int, list]:
    """The routing tree of each run with more than one shard, fitted on its bounded sample."""

    def fit(t: pa.Table) -> pa.Table:
        run = t.column(0)[0].as_py()
        o = np.argsort(t.column(1).to_numpy(), kind="stable")
        nodes = build(unit(t.column(2))[o], max(8, math.ceil(len(o) / shards[run])))
        leaf = iter(range(len(nodes)))
        rows = [(run, i, None if n[0] is None else n[0].tolist(), n[1] if n[0] is not None else float(next(leaf)), n[2] if n[0] is not None else -1, n[3] if n[0] is not None else -1) for i, n in enumerate(nodes)]
        return pa.Table.from_arrays([pa.array(list(c), ty) for c, ty in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int32()))], ["run_id", "node", "vp", "mu", "a", "b"])

    out: dict[int, list] = {}
    for r in sample.groupBy("run_id").applyInArrow(fit, "run_id bigint, node int, vp array<double>, mu double, a int, b int").orderBy("run_id", "node").toLocalIterator():
        out.setdefault(r.run_id, []).append([np.array(r.vp), r.mu, r.a, r.b] if r.vp else [None, int(r.mu)])
    return out


def route(nodes: list, x: np.ndarray) -> np.ndarray:
    """The cell of every vector."""
    cell = np.zeros(len(x), np.int64)

    def go(at: int, rows: np.ndarray) -> None:
        n = nodes[at]
        if n[0] is None:
            cell[rows] = n[1]
        elif len(rows):
            near = distance(x[rows] @ n[0]) <= n[1]
            go(n[2], rows[near])
            go(n[3], rows[~near])

    go(0, np.arange(len(x)))
    return cell


def reachable(nodes: list, x: np.ndarray, tau: np.ndarray, factor: float) -> list[tuple[int, np.ndarray]]:
    """(cell, indices of the queries that must visit it)."""
    out: list[tuple[int, np.ndarray]] = []

    def go(at: int, rows: np.ndarray) -> None:
        n = nodes[at]
        if not len(rows):
            return
        if n[0] is None:
            out.append((n[1], rows))
            return
        d, r = distance(x[rows] @ n[0]), factor * tau[rows] + SLACK
        go(n[2], rows[d - n[1] <= r])
        go(n[3], rows[n[1] - d <= r])

    go(0, np.arange(len(x)))
    return out


def neighbours(vectors: DataFrame, runs: DataFrame, k: int = K, factor: float = FACTOR, queries: Callable | None = None) -> DataFrame:
    """(run_id, row_id, other, cos, rank): the k most similar vectors of every vector (of those where queries(row_id) holds)."""
    spark = vectors.sparkSession
    v = cut(valid(vectors, runs).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding")))
    w = Window.partitionBy("run_id", "h1", "h2").orderBy("row_id")
    ids = v.select("run_id", "row_id", "h1", "h2")
    firsts = cut(ids.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1))
    reps = firsts.filter("n = 1").select("run_id", F.col("row_id").alias("rep"), "h1", "h2")
    member = cut(ids.join(reps, ["run_id", "h1", "h2"]).select("run_id", "row_id", "rep"))
    copies = cut(member.filter("row_id <> rep").select("run_id", "row_id"))
    x = v.select("run_id", "row_id", "embedding").join(measured_broadcast(copies), ["run_id", "row_id"], "left_anti")
    asked = x
    if queries is not None:  # representatives of the vectors asked for
        wanted = cut(member.filter(queries(F.col("row_id"))).select("run_id", F.col("rep").alias("row_id")).distinct())
        asked = x.join(measured_broadcast(wanted), ["run_id", "row_id"], "left_semi")

    # one row per run: a table of the size of run_reports
    sizes = {r.run_id: r.n for r in x.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    shards = {r: math.ceil(n / SHARD) for r, n in sizes.items()}
    large = [r for r, s in shards.items() if s > 1]
    cells: dict[int, list] = {}
    if large:
        share = spark.createDataFrame([(r, min(1.0, FIT / sizes[r])) for r in large], "run_id bigint, share double")
        picked = x.join(F.broadcast(share), "run_id").filter(F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(1_000_003)) < F.col("share") * 1_000_003)
        cells = _cells(picked.select("run_id", "row_id", "embedding"), shards)
    trees = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run = b.column(0).to_numpy()
            cell = np.zeros(b.num_rows, np.int64)
            for r in np.unique(run):
                if int(r) in trees.value:
                    at = np.flatnonzero(run == r)
                    cell[at] = route(trees.value[int(r)], unit(b.column(2).take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["run_id", "row_id", "embedding", "cell"])

    placed = x.mapInArrow(place, "run_id bigint, row_id bigint, embedding array<float>, cell bigint")
    if large:
        placed = cut(placed)
    load = cut(placed.groupBy("run_id", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD)).cast("int").alias("parts")))
    placed = placed.join(measured_broadcast(load), ["run_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))

    # 1. every vector in its own shard
    def home(t: pa.Table) -> pa.Table:
        x_, ids_ = unit(t.column(2)), t.column(1).to_numpy()
        o = np.argsort(ids_, kind="stable")
        x_, ids_ = x_[o], ids_[o]
        s = Search(x_, ids_, x_, k + 1, factor)
        ok = s.sim > -5
        return pa.Table.from_arrays([t.column(0), pa.array(ids_), pa.array(np.minimum(s.most, 2.1)), pa.array([n[m].tolist() for n, m in zip(s.nb, ok)], pa.list_(pa.int64())), pa.array([n[m].tolist() for n, m in zip(s.sim, ok)], pa.list_(pa.float64()))], ["run_id", "row_id", "tau", "nb", "sim"])

    own = placed.select("run_id", "row_id", "embedding", "cell", "part").groupBy("run_id", "cell", "part").applyInArrow(home, "run_id bigint, row_id bigint, tau double, nb array<bigint>, sim array<double>")
    own = cut(own)
    hits = own.select("run_id", "row_id", F.explode(F.arrays_zip("nb", "sim")).alias("z")).select("run_id", "row_id", "z.nb", "z.sim")
    if queries is not None:
        hits = hits.join(asked.select("run_id", "row_id"), ["run_id", "row_id"], "left_semi")

    # 2. the shards that the bound leaves
    if load.filter("parts > 1").count() or large:
        known = asked.join(own.select("run_id", "row_id", "tau"), ["run_id", "row_id"]).select("run_id", "row_id", "embedding", "tau")

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                run, tau = b.column(0).to_numpy(), b.column(3).to_numpy()
                out: list[list[int]] = [[0]] * b.num_rows
                for r in np.unique(run):
                    if int(r) in trees.value:
                        at = np.flatnonzero(run == r)
                        lists: list[list[int]] = [[] for _ in at]
                        for c, rows in reachable(trees.value[int(r)], unit(b.column(2).take(pa.array(at))), tau[at], factor):
                            for i in rows:
                                lists[i].append(c)
                        for i, ls in zip(at, lists):
                            out[i] = ls
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(out, pa.list_(pa.int64()))], ["run_id", "row_id", "tau", "cells"])

        # what goes where, without the vectors: queries of a cell are cut into blocks by their number
        sent = known.mapInArrow(visits, "run_id bigint, row_id bigint, tau double, cells array<bigint>")
        sent = cut(sent.withColumn("cell", F.explode("cells")).select("run_id", "row_id", "tau", "cell"))
        blocks = cut(sent.groupBy("run_id", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")))
        blocks_b, load_b = measured_broadcast(blocks), measured_broadcast(load)
        there = placed.select("run_id", "row_id", F.col("embedding").alias("vector"), F.col("cell").alias("at"), F.col("part").alias("at_part"))
        going = sent.join(load_b, ["run_id", "cell"]).join(blocks_b, ["run_id", "cell"])
        going = going.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        going = going.join(there, ["run_id", "row_id"]).filter("cell <> at or part <> at_part")
        going = going.withColumn("block", F.pmod(F.xxhash64("row_id", F.lit(3)), F.col("blocks")).cast("int"))
        stock = placed.join(blocks_b, ["run_id", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def away(q: pa.Table, s: pa.Table) -> pa.Table:
            names = ["run_id", "row_id", "nb", "sim"]
            if not q.num_rows or not s.num_rows:
                return pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names)
            ids_ = s.column("row_id").to_numpy()
            o = np.argsort(ids_, kind="stable")
            f = Search(unit(s.column("embedding"))[o], ids_[o], unit(q.column("embedding")), k + 1, factor, q.column("tau").to_numpy())
            i, j = np.nonzero(f.sim > -5)
            return pa.Table.from_arrays([q.column("run_id").take(pa.array(i)), q.column("row_id").take(pa.array(i)), pa.array(f.nb[i, j]), pa.array(f.sim[i, j])], names)

        keys = ["run_id", "cell", "part", "block"]
        found_ = going.select(*keys, "row_id", F.col("vector").alias("embedding"), "tau").groupBy(*keys).cogroup(stock.select(*keys, "row_id", "embedding").groupBy(*keys)).applyInArrow(away, "run_id bigint, row_id bigint, nb bigint, sim double")
        hits = hits.unionByName(found_)

    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "row_id").orderBy(F.desc("sim"), "nb"))).filter(F.col("n") <= k + 1)
    # 3. classes back to rows
    ask = member if queries is None else member.filter(queries(F.col("row_id")))
    per = ask.join(best.select("run_id", F.col("row_id").alias("rep"), F.col("nb").alias("near"), "sim"), ["run_id", "rep"])
    near = firsts.join(member, ["run_id", "row_id"]).select("run_id", F.col("rep").alias("near"), F.col("row_id").alias("other"))
    rows = per.join(near, ["run_id", "near"]).filter("other <> row_id")
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "row_id").orderBy(F.desc("sim"), "other"))).filter(F.col("rank") <= k)
    return top.select("run_id", "row_id", "other", F.col("sim").alias("cos"), "rank")


def found(vectors: DataFrame, runs: DataFrame) -> DataFrame:
    return neighbours(vectors, runs).select("run_id", F.least("row_id", "other").alias("id_a"), F.greatest("row_id", "other").alias("id_b")).distinct()


def recall(vectors: DataFrame, runs: DataFrame, k: int = K, factor: float = FACTOR, every: int = 50) -> DataFrame:
    """(run_id, queries, recall): the share of the exact k neighbours that the search finds, for the queries whose row_id is divisible by `every`.

    The exact ones come from comparing the queries with all vectors, in blocks and without any pruning.
    """
    asks = lambda c: c % every == 0
    some = neighbours(vectors, runs, k, factor, asks).select("run_id", "row_id", "other")
    all_ = neighbours(vectors, runs, k, NO_PRUNING, asks).select("run_id", "row_id", "other")
    both = all_.join(some.withColumn("hit", F.lit(1)), ["run_id", "row_id", "other"], "left")
    return both.groupBy("run_id").agg(F.count_distinct("row_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
