"""Operator 2: approximate nearest neighbours by vantage-point trees, one per shard.

Vectors go to the shard of their nearest pivot. Each shard builds a vantage-point tree,
in which its own vectors find their neighbours first; the distance of the k-th bounds
the search elsewhere. A vector visits those shards, and within them those subtrees, that
the triangle inequality does not rule out: a lower bound on the distance to anything in
there, times the relaxation factor, must not exceed the k-th distance so far. A factor
of one rules out only what cannot matter, so the search is exact; a larger one is faster.

Trees are searched by whole matrices: all queries at a node move together, once each has
a bound from the leaf it falls in. Products of single precision, with a bound on their
error, choose the entries whose distances are then computed from differences in double
precision; only these decide.

Vectors and the queries that visit them stream through a task sorted, the shard's vectors
first, so a task holds one tree and one batch of queries however many visit. Only a shard
of many queries is searched by several tasks, each with its own copy of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, maybe_broadcast
from ._frames import MAX_SAFE_ROWS, batched, table, tidy

K_NEAREST = 10
FACTOR = 1.0
"""Exact. How much a larger factor loses depends on the vectors: the fewer dimensions they really have, the more."""
SHARD_ROWS = 20_000
QUERY_ROWS = 20_000
"""Queries that one task searches a shard with, on average."""
LEAF = 256
REFINE = 1 << 20
"""Components of candidate pairs whose exact distances are computed at once."""
SCHEMA = "vec_id bigint, rank int, neighbor_id bigint, distance double"


class Best:
    """The k nearest found so far for each query, ordered by (distance, id)."""

    def __init__(self, n: int, k: int, bound: np.ndarray | None = None):
        self.dist = np.full((n, k), np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.bound = np.full(n, np.inf) if bound is None else bound.copy()

    def add(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Single entries: for each, the query's row, the distance and the neighbour's id."""
        near = dist <= self.bound[rows]
        rows, dist, ids = rows[near], dist[near], ids[near]
        if not len(rows):
            return
        k = self.dist.shape[1]
        some, at = np.unique(rows, return_inverse=True)
        place = np.concatenate((np.repeat(np.arange(len(some)), k), at))
        d = np.concatenate((self.dist[some].ravel(), dist))
        i = np.concatenate((self.ids[some].ravel(), ids))
        order = np.lexsort((i, d, place))
        first = np.searchsorted(place[order], np.arange(len(some)))
        pick = order[first[:, None] + np.arange(k)]
        self.dist[some], self.ids[some] = d[pick], i[pick]
        self.bound[some] = np.minimum(self.bound[some], d[pick[:, -1]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices, from differences: equal vectors have distance 0."""
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        out[:, j] = exact(a, b[j])
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row; the same for a pair in either order."""
    out = a - b
    out *= out
    return np.sqrt(out.sum(axis=1))


class VpTree:
    """A vantage-point tree over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.x, self.ids = vectors, ids
        # products lose least around the middle; the error bound of single precision needs lengths within its range
        self.middle = vectors.mean(axis=0) if len(ids) else np.zeros(vectors.shape[1])
        centred = vectors - self.middle
        self.square = (centred * centred).sum(axis=1)
        self.longest = float(self.square.max()) if len(ids) else 0.0
        self.low = centred.astype(np.float32) if self._narrow(self.longest) else centred
        self.centred = centred if self.low is not centred else self.low
        self.root = self._build(np.arange(len(ids)))

    @staticmethod
    def _narrow(square: float) -> bool:
        return 1e-20 < square < 1e30

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = int(rows[len(rows) // 2])
        rest = rows[rows != vantage]
        d = exact(self.x[rest], self.x[vantage])
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        near, far = order[:half], order[half:]
        return vantage, (self._build(rest[near]), float(d[near[0]]), float(d[near[-1]])), (self._build(rest[far]), float(d[far[0]]), float(d[far[-1]]))

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best, factor: float) -> None:
        """Add the neighbours of each query to ``best``, leaving out rows with the query's own id."""
        q = queries - self.middle
        square = (q * q).sum(axis=1)
        narrow = self.low.dtype == np.float32 and len(q) > 0 and float(square.max()) < 1e30
        q = q.astype(np.float32) if narrow else q
        base = self.low if narrow else self.centred
        unit = (np.finfo(np.float32 if narrow else np.float64).eps) * (base.shape[1] + 8)
        leaf = lambda node, rows: len(node) and len(rows) and self._leaf(node, rows, q, square, base, unit, queries, own, best)
        every = np.arange(len(queries))
        # first each query without a bound goes down to one leaf, which gives it one; then all go through the tree together
        home = np.zeros(len(queries), np.int64)
        down = [(self.root, every[np.isinf(best.bound)])]
        while down:
            node, rows = down.pop()
            if isinstance(node, np.ndarray):
                home[rows] = id(node)
                leaf(node, rows)
            elif len(rows):
                vantage, (near, _, near_high), (far, far_low, _) = node
                first = exact(queries[rows], self.x[vantage]) * 2 <= near_high + far_low
                down += [(near, rows[first]), (far, rows[~first])]
        stack = [(self.root, every, None)]
        while stack:
            node, rows, low = stack.pop()
            if low is not None:
                rows = rows[low * factor <= best.bound[rows]]
            if isinstance(node, np.ndarray):
                leaf(node, rows[home[rows] != id(node)])
                continue
            if not len(rows):
                continue
            vantage, (near, near_low, near_high), (far, far_low, far_high) = node
            d = exact(queries[rows], self.x[vantage])
            other = own[rows] != self.ids[vantage]
            best.add(rows[other], d[other], np.full(int(other.sum()), self.ids[vantage]))
            slack = 1e-12 * (d + far_high)
            stack.append((far, rows, np.maximum(0.0, np.maximum(far_low - d, d - far_high) - slack)))
            stack.append((near, rows, np.maximum(0.0, np.maximum(d - near_high, near_low - d) - slack)))

    def _leaf(self, node, rows, q, square, base, unit, queries, own, best: Best) -> None:
        k = best.dist.shape[1]
        approx = q[rows] @ base[node].T
        approx *= -2
        approx += square[rows].astype(approx.dtype)[:, None]
        approx += self.square[node].astype(approx.dtype)[None, :]
        # the most that an approximate square can be off, for any entry of the row
        off = unit * 4 * (square[rows] + self.square[node].max()) + 1e-30
        order = np.argsort(self.ids[node], kind="stable")
        sorted_ids = self.ids[node][order]
        at, to = np.searchsorted(sorted_ids, own[rows], "left"), np.searchsorted(sorted_ids, own[rows], "right")
        for r in np.flatnonzero(to > at).tolist():
            approx[r, order[at[r] : to[r]]] = np.inf
        reach = best.bound[rows] ** 2 * (1 + 1e-12) + off
        loose = np.flatnonzero(np.isinf(reach))
        if len(loose) and approx.shape[1] > k:
            reach[loose] = np.partition(approx[loose], k - 1, axis=1)[:, k - 1] + 2 * off[loose]
        with np.errstate(over="ignore"):
            limit = np.nextafter(reach.astype(approx.dtype), approx.dtype.type(np.inf))
        r, c = np.nonzero((approx <= limit[:, None]) & np.isfinite(approx))
        step = max(1, REFINE // base.shape[1])
        dist = np.concatenate([exact(queries[rows[r[a : a + step]]], self.x[node[c[a : a + step]]]) for a in range(0, len(r), step)] or [np.zeros(0)])
        best.add(rows[r], dist, self.ids[node[c]])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    raw = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(raw, "<f8").reshape(-1, dim)


def _answers(ids: np.ndarray, best: Best) -> pa.RecordBatch:
    found = np.isfinite(best.dist)
    rows = np.repeat(np.arange(len(ids)), found.sum(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(best.ids[found]), pa.array(best.dist[found])], ["id", "neighbor", "distance"])


ASKED = "shard int, id bigint, x binary, bound double"


def _ask(asked: DataFrame, placed: DataFrame, dim: int, k: int, factor: float) -> DataFrame:
    """(id, neighbor, distance): what the queries (shard, id, x, bound) find in the shards they visit.

    A shard's vectors go once to every ``QUERY_ROWS`` of its queries, so no more of them
    are moved than there are queries, but for shards with fewer queries than vectors.
    """
    counts = materialize(asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("turns")), "ann-turns")
    n_shards = counts.count()
    turns = maybe_broadcast(counts, n_shards, MAX_SAFE_ROWS)
    queries = asked.join(turns, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int").alias("turn"), F.lit(1).alias("kind"), "id", "x", "bound")
    hosts = placed.select("shard", "id", "x").join(turns, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("kind"), "id", "x", F.lit(None).cast("double").alias("bound"))
    tasks = counts.agg(F.sum("turns").alias("n")).first()["n"] or 1
    rows = hosts.union(queries).repartition(tasks, "shard", "turn").sortWithinPartitions("shard", "turn", "kind", "id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree, held = None, None, []
        for batch in batches:
            names = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            kinds = batch.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                ids, x = part.column(3).to_numpy(), _matrix(part.column(4), dim)
                if names[a] != here:
                    here, tree, held = names[a], None, []
                if kinds[a] == 0:
                    held.append((x, ids))
                    continue
                if tree is None:
                    tree = VpTree(np.concatenate([np.zeros((0, dim)), *(v for v, _ in held)]), np.concatenate([np.zeros(0, np.int64), *(i for _, i in held)]))
                    held = []
                best = Best(len(ids), k, part.column(5).fill_null(np.inf).to_numpy(zero_copy_only=False))
                tree.search(x, ids, best, factor)
                yield _answers(ids, best)

    return rows.mapInArrow(tidy(run), "id bigint, neighbor bigint, distance double")


def neighbors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K_NEAREST, factor: float = FACTOR) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest other vectors of every vector.

    Every row is a query. Ties in distance are ranked by id, also where they decide who is
    among the k. Rows with a null id, a null or empty vector, a null or non-finite
    component, or another dimension than most rows have (the larger of two as common) take
    no part. Of rows with equal id and vector one counts; rows with one id are never each
    other's neighbours. Equal vectors of other ids are, at distance 0. With fewer than k
    others all of them are returned. The order of rows does not matter. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    clean = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))").distinct()
    clean = materialize(clean, "ann-vectors")
    dims = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    dim, n = dims[0]["d"], dims[0]["count"]
    clean = clean.where(F.size("v") == dim)
    shards = max(1, -(-n // SHARD_ROWS))
    pivots = np.array([r["v"] for r in clean.orderBy(F.xxhash64("id"), "id", "v").limit(shards).collect()], float).reshape(-1, dim)

    def place(batch: pa.RecordBatch):
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = batch.column(0).to_numpy()
        d = distances(x, pivots)
        least = d.min(axis=1)
        # among equally near pivots the id chooses, so that copies of one vector spread
        tied = d <= least[:, None]
        turn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tied.sum(axis=1)
        shard = (np.cumsum(tied, axis=1) > turn[:, None]).argmax(axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(least)], ["shard", "id", "x", "d"])

    placed = materialize(clean.mapInArrow(batched(place), "shard int, id bigint, x binary, d double"), "ann-placed")
    radius = np.zeros(len(pivots))
    for r in placed.groupBy("shard").agg(F.max("d").alias("r")).collect():
        radius[r["shard"]] = r["r"]
    own = materialize(_ask(placed.select("shard", "id", "x", F.lit(None).cast("double").alias("bound")), placed, dim, k, factor), "ann-own")
    every = own
    if len(pivots) > 1:
        # rows of one id and different vectors share the larger bound
        bound = own.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))

        def route(batch: pa.RecordBatch):
            x = _matrix(batch.column(2), dim)
            home, d_home = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            limit = batch.column(4).fill_null(np.inf).to_numpy(zero_copy_only=False)
            d = distances(x, pivots)
            low = np.maximum(d - radius[None, :], (d - d_home[:, None]) / 2) - 1e-12 * (d + radius[None, :])
            go = low * factor <= limit[:, None]
            go[np.arange(len(home)), home] = False
            q, s = np.nonzero(go)
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), batch.column(1).take(take), batch.column(2).take(take), pa.array(limit[q])], ["shard", "id", "x", "bound"])

        sent = materialize(placed.join(bound, "id", "left").select("shard", "id", "x", "d", "bound").mapInArrow(batched(route), ASKED), "ann-sent")
        every = own.union(_ask(sent, placed, dim, k, factor))
    # of rows with one id and different vectors, the nearer pairing counts
    pairs = every.groupBy("id", "neighbor").agg(F.min("distance").alias("distance"))
    nearest = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))), 1, k).alias("best"))
    return nearest.select("id", F.posexplode("best").alias("pos", "b")).select(F.col("id").alias("vec_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.neighbor").alias("neighbor_id"), F.round("b.distance", 6).alias("distance"))


def op2_vantage_point_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors(table(spark, sf_dir, "embeddings"))
