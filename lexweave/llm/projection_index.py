"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Largest inner product is turned into smallest Euclidean distance: a vector x gets one
more coordinate sqrt(M^2 - |x|^2), M being the largest norm, and a query gets 0. Vectors
are projected to a few dimensions with a Gaussian (2-stable) matrix, so the squared
projected distance of two vectors over their squared distance is chi-square distributed
with that many degrees of freedom.

The top of the kd-tree is cut from a bounded sample and deals every vector to a cell;
cells of many vectors (a vector that is a third of all rows can't be cut) are dealt
further into shards of bounded size. Each shard holds its own kd-tree. A query takes its
leaves in growing distance, and their vectors in growing projected distance, verifying
them exactly, until a vector nearer than its k-th so far would be projected as far as the
next one only with a small probability: the chi-square stopping test. Across cells the
same test decides which cells a query still visits after its own.

How much the test saves depends on the vectors: the more the nearest stand out from the
others, the fewer are verified. Each result says how many were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.shared import Scratch

DIMS, LEAF, SHARD, BLOCK, SAMPLE = 32, 32, 4096, 1024, 20_000
#: Queries whose projected distances are held together; leaves that a query looks at before the others.
PART, FIRST = 64, 16
#: Chance with which the test keeps a vector as near as the k-th; nearer ones are kept with more.
PROBABILITY = 0.88


def chi_square_cdf(x: np.ndarray, k: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    h = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, k // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def chi_square_point(p: float, k: int) -> float:
    """The value that a chi-square variable stays under with probability p."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return high


def projection(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


class KdTree:
    """An implicit balanced kd-tree over projected points, with the bounding box of every node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        boxes = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            part = points[self.order[a:b]]
            low, high = part.min(0), part.max(0)
            axis = int((high - low).argmax())
            if b - a <= leaf or high[axis] == low[axis]:
                for s in range(a, b, leaf):  # equal points can't be cut; they share leaves
                    e = min(b, s + leaf)
                    self.leaves.append((s, e))
                    sub = points[self.order[s:e]]
                    boxes.append((sub.min(0), sub.max(0)))
                continue
            mid = (a + b) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid - a)]
            stack += [(mid, b), (a, mid)]
        self.low, self.high = (np.array([x[i] for x in boxes]) for i in (0, 1))
        self.rows = np.full((len(self.leaves), leaf), -1)  # of each leaf, in tree order
        for k, (a, b) in enumerate(self.leaves):
            self.rows[k, : b - a] = np.arange(a, b)

    def leaf_distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances from each query to each leaf's box."""
        gap = np.maximum(0, np.maximum(self.low[None] - queries[:, None], queries[:, None] - self.high[None]))
        return np.einsum("qld,qld->ql", gap, gap)


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order whatever the shape."""
    return (vectors * query).sum(1)


def search_shard(q_vec: np.ndarray, q_id: np.ndarray, q_proj: np.ndarray, q_best: np.ndarray, v_vec: np.ndarray, v_id: np.ndarray, v_proj: np.ndarray, top: float, k: int, stop: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query (index, vec_ids, scores, verified) of its k nearest in the shard, by incremental search.

    q_best: the k-th score that each query already has (-inf if none); top: the largest squared norm.
    Leaves are taken in growing distance of their boxes, the nearest few before the others, and the
    vectors of what was taken in growing projected distance.
    """
    tree = KdTree(v_proj)
    vectors, ids, points = v_vec[tree.order], v_id[tree.order], v_proj[tree.order]
    size = np.einsum("nd,nd->n", points, points)
    leaf = np.repeat(np.arange(len(tree.leaves)), [b - a for a, b in tree.leaves])
    for i in range(len(q_id)):
        if i % PART == 0:
            some = q_proj[i : i + PART]
            far = tree.leaf_distances(some)
            first = np.partition(far, min(FIRST, far.shape[1]) - 1, axis=1)[:, min(FIRST, far.shape[1]) - 1]
            every = np.maximum(0, np.einsum("qd,qd->q", some, some)[:, None] + size - 2 * some @ points.T)
        box, away = far[i % PART], every[i % PART]
        norm = float(q_vec[i] @ q_vec[i])
        got_s, got_i, bound, verified = np.zeros(0), np.zeros(0, np.int64), float(q_best[i]), 0
        limit = lambda: stop * max(0.0, norm + top - 2 * bound) * (1 + 1e-9) + 1e-9 if math.isfinite(bound) else math.inf  # noqa: B023, E731
        begin = box <= first[i % PART]
        for leaves in (begin, ~begin):
            rows = np.flatnonzero((leaves & (box <= limit()))[leaf] & (away <= limit()))
            rows = rows[ids[rows] != q_id[i]]
            rows = rows[np.argsort(away[rows], kind="stable")]
            ahead = away[rows]
            done, take = 0, 4 * k
            while done < (end := min(done + take, int(np.searchsorted(ahead, limit(), "right")))):
                part = rows[done:end]
                found = vectors[part]
                verified += len(part)
                done, take = end, take * 4
                if len(part) > 4 * k:  # a quick product finds the few whose exact scores can count
                    rough = found @ q_vec[i]
                    floor = np.partition(rough, len(rough) - k)[len(rough) - k]
                    keep = rough >= max(floor, bound) - 1e-9 * max(1.0, math.sqrt(norm * top))
                    part, found = part[keep], found[keep]
                got_s = np.concatenate([got_s, exact_scores(q_vec[i], found)])
                got_i = np.concatenate([got_i, ids[part]])
                if len(got_s) > k:
                    keep = np.lexsort((got_i, -got_s))[:k]
                    got_s, got_i = got_s[keep], got_i[keep]
                if len(got_s) == k:
                    bound = max(bound, float(got_s.min()))
        keep = np.lexsort((got_i, -got_s))
        yield i, got_i[keep], got_s[keep], verified


def cut_cells(points: np.ndarray, cell: int) -> list[tuple]:
    """Nodes (axis, value, left, right), children being node numbers or ~cell, from sampled points."""
    nodes: list[list] = []
    cells = 0

    def build(part: np.ndarray, depth: int) -> int:
        nonlocal cells
        spread = part.max(0) - part.min(0) if len(part) else np.zeros(1)
        axis = int(spread.argmax())
        if len(part) <= cell or spread[axis] <= 0 or depth > 40:
            cells += 1
            return ~(cells - 1)
        value = float(np.median(part[:, axis]))
        left = part[:, axis] <= value
        if left.all():
            left = part[:, axis] < value
            value = float(np.nextafter(value, -np.inf))
        me = len(nodes)
        nodes.append([axis, value, 0, 0])
        nodes[me][2] = build(part[left], depth + 1)
        nodes[me][3] = build(part[~left], depth + 1)
        return me

    build(points, 0)
    return [tuple(n) for n in nodes]


def cell_of(points: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if not nodes:
        return at
    table = np.array([n[:2] for n in nodes])
    child = np.array([n[2:] for n in nodes], np.int64)
    live = np.arange(len(points))
    while len(live):
        n = at[live]
        right = points[live, table[n, 0].astype(int)] > table[n, 1]
        at[live] = child[n, right.astype(int)]
        live = live[at[live] >= 0]
    return ~at


def valid(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and holds only finite numbers."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Rows of equal width, without nulls, as a matrix."""
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.concatenate(column.to_numpy()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 20, dims: int = DIMS, probability: float = PROBABILITY, seed: int = 11, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, verified): for each query its k nearest rows of vectors, its own id left out.

    Nearest first, ties to the smaller id; all candidates if there are fewer. verified: how many
    vectors the query was compared with exactly. Rows without an id, or whose vector ``valid`` leaves
    out, take no part; vectors of another width than the most frequent take none either. Rows of
    vectors that repeat an id are candidates each. Rows of queries that repeat id and vector are one
    query; those that repeat an id with another vector are answered each. Every vector is indexed;
    only the cells' cuts come from a sample of about SAMPLE rows.
    """
    double = lambda df: valid(df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL"), "v")
    base = double(vectors)
    facts = base.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "w").first()
    out_schema = "query_id bigint, key bigint, vec_id bigint, score double, verified bigint"
    if facts is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified bigint")
    width, n, top = facts["w"], facts["n"], facts["top"]
    lines, stop = projection(width + 1, dims, seed), chi_square_point(probability, dims)
    lift = lambda m: np.concatenate([m, np.sqrt(np.maximum(0, top - (m * m).sum(1)))[:, None]], 1) @ lines
    edge = min(2**63 - 1, int(SAMPLE / n * 2**64) - 2**63)
    sample = base.where((F.size("v") == width) & (F.xxhash64("id") <= edge)).select("v").limit(2 * SAMPLE).toPandas()
    points = lift(_matrix(sample.v)) if len(sample) else np.zeros((0, dims))
    nodes = cut_cells(points, max(1, int(SHARD * len(points) / n)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = lift(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell_of(p, nodes)), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "v", "cell", "p"])

    dealt = scratch.store(base.where(F.size("v") == width).mapInArrow(deal, "id bigint, v array<double>, cell bigint, p array<double>"), "dealt")
    edges = [f"p[{d}]" for d in range(dims)]
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.array(*(F.min(F.expr(e)) for e in edges)).alias("low"), F.array(*(F.max(F.expr(e)) for e in edges)).alias("high"))
    sizes = scratch.store(sizes.withColumn("shards", F.ceil(F.col("n") / SHARD)), "cells")
    shards = dealt.join(sizes.select("cell", "shards"), "cell").select("cell", F.pmod(F.xxhash64("id", "v"), F.col("shards")).alias("shard"), "id", "v", "p")
    shards = scratch.store(shards, "shards")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"))
            p = np.concatenate([m, np.zeros((len(m), 1))], 1) @ lines
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell_of(p, nodes)), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "v", "cell", "p"])

    asked = double(queries).where(F.size("v") == width).dropDuplicates(["id", "v"])
    asked = scratch.store(asked.mapInArrow(project, "id bigint, v array<double>, cell bigint, p array<double>").withColumn("key", F.xxhash64("v")), "asked")

    def search(visits: DataFrame) -> DataFrame:
        """visits: (id, key, v, p, cell, best). Queries meet the shards of their cell in blocks of a bounded number."""
        many = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(sizes.select("cell", "shards"), "cell")
        many = scratch.store(many, f"visits-{visits_no[0]}")
        visits_no[0] += 1
        left = visits.join(many, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "key", "v", "p", "best")
        right = shards.join(many.select("cell", "blocks"), "cell").select("cell", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "id", "v", "p")

        def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "verified": np.zeros(0, np.int64)})
            if not len(q) or not len(s):
                return none
            q, s = q.sort_values(["id", "key"], kind="stable"), s.sort_values("id", kind="stable")
            at, ids, scores, counts = [], [], [], []
            for i, own_ids, own_scores, verified in search_shard(_matrix(q.v), q.id.to_numpy(), _matrix(q.p), q.best.to_numpy(), _matrix(s.v), s.id.to_numpy(), _matrix(s.p), top, k, stop):
                # a row without a vector carries the count
                at.append(np.full(len(own_ids) + 1, i))
                ids += [own_ids, [-1]]
                scores += [own_scores, [np.nan]]
                counts += [np.zeros(len(own_ids), np.int64), [verified]]
            at = np.concatenate(at)
            return pd.DataFrame({"query_id": q.id.to_numpy()[at], "key": q.key.to_numpy()[at], "vec_id": np.concatenate(ids).astype(np.int64), "score": np.concatenate(scores), "verified": np.concatenate(counts).astype(np.int64)})

        keys = ["cell", "shard", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, out_schema)

    visits_no = [0]
    asker = ["query_id", "key"]
    nearest_first = Window.partitionBy(*asker).orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.where("score IS NOT NULL AND NOT isnan(score)").withColumn("rank", F.row_number().over(nearest_first)).where(f"rank <= {k}")
    home = scratch.store(search(asked.withColumn("best", F.lit(float("-inf")))), "found-home")
    kth = best(home).groupBy(*asker).agg(F.count("*").alias("c"), F.min("score").alias("s")).select(F.col("query_id").alias("id"), "key", F.when(F.col("c") == k, F.col("s")).otherwise(float("-inf")).alias("best"))
    # the cells whose boxes the stopping test does not rule out; there are no more of them than sampled rows
    boxes = sizes.select("cell", "low", "high").collect()
    c_id, c_low, c_high = np.array([r["cell"] for r in boxes], np.int64), np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p, v = _matrix(b.column("p")), _matrix(b.column("v"))
            own, bound = b.column("cell").to_numpy(), b.column("best").to_numpy()
            limit = np.where(np.isfinite(bound), stop * np.maximum(0, (v * v).sum(1) + top - 2 * np.where(np.isfinite(bound), bound, 0)), math.inf)
            some = max(1, 200_000 // len(c_id))
            for k in range(0, len(p), some):
                part = slice(k, k + some)
                gap = np.maximum(0, np.maximum(c_low[None] - p[part, None], p[part, None] - c_high[None]))
                row, col = np.nonzero(((gap**2).sum(2) <= limit[part, None] * (1 + 1e-9)) & (c_id[None] != own[part, None]))
                take = pa.array(row + k)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("key").take(take), b.column("v").take(take), b.column("p").take(take), pa.array(c_id[col]), b.column("best").take(take)], names=["id", "key", "v", "p", "cell", "best"])

    state = asked.join(kth, ["id", "key"], "left").withColumn("best", F.coalesce("best", F.lit(float("-inf"))))
    visits = scratch.store(state.mapInArrow(route, "id bigint, key bigint, v array<double>, p array<double>, cell bigint, best double"), "routes")
    found = scratch.store(home.unionByName(search(visits)), "found")
    scratch.drop(dealt, shards, asked, home, visits, sizes)
    work = found.groupBy(*asker).agg(F.sum("verified").alias("verified"))
    return best(found).drop("verified").join(work, asker).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
