"""The k most similar vectors for every vector (problem 2), by low-dimensional stable projections.

Unit vectors are projected on ``M`` Gaussian directions. For two vectors at distance d the squared projected
distance over d^2 follows a chi-square law with ``M`` degrees of freedom. A query takes its neighbours in the
projected space in rising distance (rings around it, found through a kd-tree) and verifies them on the full vectors.
It stops at projected radius r when ``chi2_cdf(r^2 / d_k^2) >= P`` for the current k-th distance d_k: a missed
neighbour is then less likely than 1 - P.

Equal vectors are searched for once, under the smallest job_index of their group; the result is carried over to all members.

Layout for a cluster: directions fitted on a bounded sample (``SAMPLE`` rows) cut the unit sphere into cells of about
``CELL`` rows, each vector in the cell of its most similar direction; a cell that would be larger (many close vectors) is
cut further by hash. The packed vectors of *all* rows are written once, by cell, to the shared folder (spark.checkpoint.dir).
A task holds queries of one cell against one cell. Round 1 is each slice in its own cell; round 2 takes the queries to
the other cells that they reach. Tasks only read files and can be repeated anywhere.

A neighbour within d of a query lies beyond the plane between their cells only if the plane is within d of the query. In many
dimensions a small part of d is enough, as a difference lies nearly level with a plane. How large a part is measured: the true
neighbours of ``PROBES`` queries among all rows are found by comparing them with every row, and the largest ratio of a plane's distance to
the k-th neighbour's holds for all queries. Where vectors don't form groups the ratio rises, to 1 at most, and more cells are visited.

Defined results: null vectors, other lengths, zero and non-finite ones take no part; a job_index counts once, also
where its rows hold different vectors (the usable one with the least hash counts); ties go to the smaller job_index; with fewer
than k others all others come out; empty input gives no rows.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.runtime import drop_folder, ensure_checkpoint_dir, materialize

M, TREE_DIMS, P = 96, 8, 0.97
CELL, SLICE, LEAF, BATCH, SAMPLE = 16_384, 4_096, 512, 512, 20_000
CENTRES, PROBES, ROUNDS = 2_048, 512, 8
SLACK = 1e-3  # of distances from single-precision similarities
TWINS_LIMIT = 200_000
RANGE_BLOCK = 1 << 16
#: More than single-precision products of unit vectors may be off: whatever lies this near to the k-th place is kept until it is scored exactly.
NEAR = np.float32(1e-5)
SPILL = 64  # kept rows besides the k best, for each query of a batch, before they are scored exactly
ROUNDING = np.float32(1e-3)  # squared projected distances are about 100 and exact to 1e-4
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


@lru_cache(maxsize=4)
def directions(dim: int) -> np.ndarray:
    return np.random.RandomState(7).standard_normal((dim, M)).astype(np.float32)


def chi2_quantile(p: float, m: int) -> float:
    """Wilson-Hilferty; the normal quantile by bisection on erf."""
    lo, hi = -8.0, 8.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return m * (1 - 2 / (9 * m) + lo * math.sqrt(2 / (9 * m))) ** 3


def kd_splits(points: np.ndarray, leaves: int) -> list[tuple]:
    """A kd-tree as a list of ``(dim, cut, left, right)``; a negative child -c - 1 is leaf c. Cuts at the median of the widest dimension."""
    nodes: list = []
    count = [0]

    def build(idx: np.ndarray, want: int) -> int:
        if want > 1 and len(idx) >= 2:
            sub = points[idx]
            dim = int(np.argmax(sub.max(0) - sub.min(0)))
            left_want = want // 2
            cut = float(np.quantile(sub[:, dim], left_want / want))
            low = sub[:, dim] < cut
            if 0 < low.sum() < len(idx):
                at = len(nodes)
                nodes.append(None)
                left = build(idx[low], left_want)
                nodes[at] = (dim, cut, left, build(idx[~low], want - left_want))
                return at
        count[0] += 1
        return -count[0]

    root = build(np.arange(len(points)), leaves)
    return nodes if root >= 0 else []


def assign(splits: list[tuple], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int32)
    if not splits:
        return out
    stack = [(0, np.arange(len(points)))]
    while stack:
        node, idx = stack.pop()
        if node < 0:
            out[idx] = -node - 1
            continue
        dim, cut, left, right = splits[node]
        low = points[idx, dim] < cut
        stack += [(left, idx[low]), (right, idx[~low])]
    return out


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of the queries to the boxes."""
    out = np.zeros((len(q), len(lo)), np.float32)
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, d] - q[:, None, d], q[:, None, d] - hi[None, :, d]), 0)
        out += gap * gap
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float32)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)).astype(np.float32)[:, None]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The most similar direction of each unit vector."""
    return np.concatenate([np.zeros(0, np.int64), *[(x[a : a + 2048] @ centres.T).argmax(1) for a in range(0, len(x), 2048)]])


def fit_centres(x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """``want`` directions of unit vectors by k-means on the sphere, and how many of the vectors each has."""
    centres = x[np.random.RandomState(11).choice(len(x), min(want, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        of = nearest_centre(x, centres)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(centres) + 1))
        for c in range(len(centres)):
            total = x[order[ends[c] : ends[c + 1]]].sum(0)
            length = float(np.sqrt((total * total).sum()))
            if length > 0:
                centres[c] = total / length
    return centres, np.bincount(nearest_centre(x, centres), minlength=len(centres))


def plane_distance(x: np.ndarray, own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of unit vectors in the cells ``own`` to the planes that part these from each cell; 0 for the own one."""
    likeness = x @ centres.T
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-9))[own]
    return np.maximum(likeness[np.arange(len(x)), own][:, None] - likeness, 0) / apart


class Best:
    """The k best verified neighbours of each query of a batch, as positions in a cell.

    Single-precision similarities select: the k best and all others within ``NEAR`` of the k-th are kept. ``settle`` scores what is kept again in double
    precision from the vectors as given and leaves the k first in exact order, ties by id; it runs at the end, and earlier where many are that near.
    """

    def __init__(self, ids: np.ndarray, raw: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.raw, self.k = ids, raw, k
        self.q = queries.astype(np.float64)
        self.q /= np.sqrt((self.q * self.q).sum(1))[:, None]
        n = len(queries)
        self.sim = np.full((n, k), -np.inf, np.float32)
        self.pos = np.full((n, k), -1, np.int64)
        self.exact = np.full((n, k), -np.inf)
        self.spill: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.spilled = 0

    def least(self) -> np.ndarray:
        """What a similarity has to reach for each query."""
        return self.sim[:, self.k - 1] - NEAR

    def _spill(self, rows: np.ndarray, pos: np.ndarray, sim: np.ndarray) -> None:
        near = (pos >= 0) & (sim >= self.least()[rows])
        if near.any():
            self.spill.append((rows[near], pos[near], sim[near]))
            self.spilled += int(near.sum())

    def add(self, rows: np.ndarray, pos: np.ndarray, sim: np.ndarray) -> None:
        """rows: query positions."""
        order = np.lexsort((-sim, rows))
        rows, pos, sim = rows[order], pos[order], sim[order]
        first = np.r_[True, rows[1:] != rows[:-1]]
        start = np.flatnonzero(first)
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        ok = place < self.k
        touched = rows[start]
        new_sim = np.full((len(touched), self.k), -np.inf, np.float32)
        new_pos = np.full((len(touched), self.k), -1, np.int64)
        at = np.cumsum(first) - 1
        new_sim[at[ok], place[ok]] = sim[ok]
        new_pos[at[ok], place[ok]] = pos[ok]
        s = np.concatenate([self.sim[touched], new_sim], 1)
        i = np.concatenate([self.pos[touched], new_pos], 1)
        o = np.argsort(-s, axis=1, kind="stable")
        s, i = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
        self.sim[touched], self.pos[touched] = s[:, : self.k], i[:, : self.k]
        self._spill(rows[~ok], pos[~ok], sim[~ok])
        self._spill(np.repeat(touched, self.k), i[:, self.k :].ravel(), s[:, self.k :].ravel())
        if self.spilled > SPILL * len(self.sim):
            self.settle()

    def settle(self) -> None:
        held = np.nonzero(self.pos >= 0)
        rows, pos, sim = [held[0]], [self.pos[held]], [self.sim[held]]
        for r, p, v in self.spill:
            near = v >= self.least()[r]
            rows.append(r[near])
            pos.append(p[near])
            sim.append(v[near])
        rows, pos, sim = np.concatenate(rows), np.concatenate(pos), np.concatenate(sim)
        exact = np.empty(len(rows))
        for a in range(0, len(rows), 2048):
            v = self.raw[pos[a : a + 2048]].astype(np.float64)
            exact[a : a + 2048] = np.round((v * self.q[rows[a : a + 2048]]).sum(1) / np.sqrt((v * v).sum(1)), 12)
        order = np.lexsort((self.ids[pos], -exact, rows))
        rows, pos, sim, exact = rows[order], pos[order], sim[order], exact[order]
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        ok = place < self.k
        self.pos[:], self.exact[:] = -1, -np.inf
        # the k-th single-precision value stays the bar: what was dropped here is exactly worse, what comes later is compared with it
        values = np.full(self.sim.shape, -np.inf, np.float32)
        values[rows[ok], place[ok]] = sim[ok]
        self.sim = -np.sort(-values, axis=1)
        self.pos[rows[ok], place[ok]], self.exact[rows[ok], place[ok]] = pos[ok], exact[ok]
        self.spill, self.spilled = [], 0

    def kth(self) -> np.ndarray:
        return 2 - 2 * np.clip(self.sim[:, self.k - 1], -1, 1)  # squared distance; 4 as long as there are fewer than k


class CellIndex:
    """One cell: its unit vectors and a kd-tree over their projections, points in leaf order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        r = directions(vectors.shape[1])
        p = np.concatenate([unit(vectors[i : i + 2048]) @ r for i in range(0, len(vectors), 2048)])
        self.tree = kd_splits(p[:, :TREE_DIMS], max(1, len(ids) // LEAF))
        leaf = assign(self.tree, p[:, :TREE_DIMS])
        order = np.argsort(leaf, kind="stable")
        n = len(self.tree) + 1
        self.starts = np.searchsorted(leaf[order], np.arange(n + 1))
        self.ids, self.raw, p = ids[order], vectors[order], p[order]
        self.x = np.empty(vectors.shape, np.float32)
        for i in range(0, len(ids), 2048):
            self.x[i : i + 2048] = unit(self.raw[i : i + 2048])
        self.lo, self.hi = np.full((n, TREE_DIMS), np.inf, np.float32), np.full((n, TREE_DIMS), -np.inf, np.float32)
        for c in range(n):  # tight boxes
            own = p[self.starts[c] : self.starts[c + 1], :TREE_DIMS]
            if len(own):
                self.lo[c], self.hi[c] = own.min(0), own.max(0)
        # one product gives squared projected distances: |q|^2 - 2 q.p + |p|^2
        self.points = np.ascontiguousarray(np.concatenate([-2 * p, np.einsum("ij,ij->i", p, p)[:, None], np.ones((len(p), 1), np.float32)], 1).T)

    def search(self, ids: np.ndarray, raw: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids of neighbours, similarities, squared k-th distance)``, best first, -1 where there are fewer; bound: what is known of the k-th distance."""
        x = unit(raw)
        q = x @ directions(x.shape[1])
        out_i, out_s, out_d = [], [], []
        at_leaf = np.argsort(assign(self.tree, q[:, :TREE_DIMS]), kind="stable")
        for s in range(0, len(q), BATCH):
            rows = at_leaf[s : s + BATCH]
            best = self._batch(ids[rows], raw[rows], x[rows], q[rows], bound[rows], k)
            best.settle()
            out_i.append(np.where(best.pos >= 0, self.ids[best.pos], -1))
            out_s.append(best.exact)
            out_d.append(np.minimum(best.kth(), bound[rows]))
        back = np.argsort(at_leaf, kind="stable")
        return np.concatenate(out_i)[back], np.concatenate(out_s)[back], np.concatenate(out_d)[back]

    def _verify(self, best: Best, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Similarities of the pairs; as one product where they lie close together, pair by pair otherwise."""
        own, at = np.unique(rows, return_inverse=True)
        them, to = np.unique(columns, return_inverse=True)
        if len(rows) > 0.03 * len(own) * len(them):
            sims = (x[own] @ self.x[them].T)[at, to]
            ok = sims >= best.least()[rows]
            if ok.any():
                best.add(rows[ok], columns[ok], sims[ok])
            return
        for a in range(0, len(rows), 2048):
            rr, cc = rows[a : a + 2048], columns[a : a + 2048]
            sims = np.einsum("ij,ij->i", x[rr], self.x[cc])
            ok = sims >= best.least()[rr]
            if ok.any():
                best.add(rr[ok], cc[ok], sims[ok])

    def _batch(self, ids: np.ndarray, raw: np.ndarray, x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Best:
        """Rings of rising projected distance; each ring's points are verified before the stopping test is asked again."""
        best = Best(self.ids, self.raw, raw, k)
        stop = np.float32(chi2_quantile(P, M))
        near = box_distance(q[:, :TREE_DIMS], self.lo, self.hi)
        ends = np.concatenate([q, np.ones((len(q), 1), np.float32), np.einsum("ij,ij->i", q, q)[:, None]], 1)
        done = np.full(len(q), -1, np.float32)  # squared projected radius that is verified
        reach_radius = np.float32(0.75) * stop  # pairs are drawn from the distances up to here at once, further out later
        while True:
            limit = np.minimum(bound, best.kth()) * stop + ROUNDING
            rows = np.flatnonzero(done < limit)
            if not len(rows):
                return best
            upto = np.minimum(limit[rows], reach_radius)
            leaves = np.flatnonzero((near[rows] <= upto[:, None]).any(0) & (self.starts[1:] > self.starts[:-1]))
            if len(leaves) == len(self.lo):
                columns, points = None, self.points
            else:
                columns = np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in leaves]) if len(leaves) else np.zeros(0, np.int64)
                points = self.points[:, columns]
            dist = ends[rows] @ points
            flat = np.flatnonzero(dist <= upto[:, None])
            r, c = np.divmod(flat, max(1, dist.shape[1]))
            d = dist.ravel()[flat]
            c = c if columns is None else columns[c]
            new = (d > done[rows][r]) & (self.ids[c] != ids[rows][r])
            r, c, d = r[new], c[new], d[new]
            ring = np.float32(0.02) * stop
            inner = done[rows]
            while True:
                live = np.minimum(np.minimum(bound[rows], best.kth()[rows]) * stop + ROUNDING, reach_radius)
                outer = np.minimum(live, ring)
                pick = np.flatnonzero((d > inner[r]) & (d <= outer[r]))
                if len(pick):
                    self._verify(best, x, rows[r[pick]], c[pick])
                inner = np.maximum(inner, outer)
                if ring >= reach_radius:
                    break
                ring *= np.float32(1.5)
            done[rows] = np.maximum(inner, reach_radius if len(leaves) == len(self.lo) else inner)
            reach_radius *= 2


def one_each(vectors: DataFrame, dim: int) -> DataFrame:
    """``job_index, embedding, h, g``: vectors of the given length with two hashes, a job_index with one vector only."""
    ok = vectors.select("job_index", "embedding").filter(F.col("job_index").isNotNull() & (F.size("embedding") == dim)).withColumn("h", F.xxhash64("embedding")).withColumn("g", F.hash("embedding"))
    many = ok.groupBy("job_index").agg(F.min("h").alias("keep"), F.max("h").alias("last")).filter("keep <> last").select("job_index", "keep")
    if many.isEmpty():
        return ok
    v = F.col("embedding").cast("array<float>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    keep = ok.join(many.select("job_index"), "job_index", "left_semi").filter(usable).groupBy("job_index").agg(F.min("h").alias("keep"))
    return ok.join(keep, "job_index", "left").filter("keep is null or keep = h").drop("keep")  # without a usable vector none is chosen, and all are dropped later


def within(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows whose job_index lies in a shard's range: an equi-join on blocks of numbers, each range cut into the blocks it touches; Spark measures the ranges
    and broadcasts few of them."""
    ranges = shards.select(F.col("row_start").cast("bigint").alias("row_start"), F.col("row_end").cast("bigint").alias("row_end")).filter("row_end > row_start").distinct()
    cut = ranges.select("row_start", "row_end", F.explode(F.sequence(F.floor(F.col("row_start") / RANGE_BLOCK), F.floor((F.col("row_end") - 1) / RANGE_BLOCK))).alias("_of"))
    inside = (F.col("_block") == F.col("_of")) & (F.col("job_index") >= F.col("row_start")) & (F.col("job_index") < F.col("row_end"))
    return rows.withColumn("_block", F.floor(F.col("job_index") / RANGE_BLOCK)).join(cut, inside, "left_semi").drop("_block")


def carried_over(top: DataFrame, searched: DataFrame, ids: DataFrame, twins: DataFrame, k: int) -> DataFrame:
    """``job_index, best`` for every member of a group of equal vectors, from ``top`` of the representatives (``best``: structs of
    negative similarity and representative). ``searched``: the representatives whose vectors are usable."""
    members = materialize(ids.join(twins, ["h", "g"]).select("job_index", "rep").distinct().join(searched.select(F.col("job_index").alias("rep")), "rep", "left_semi"))
    # a member may be one of the k + 1 smallest itself
    least = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("job_index"))).filter(F.col("n") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("job_index")).alias("ids"))
    others = top.select(F.col("job_index").alias("of"), F.explode("best").alias("b")).select("of", "b.s", F.col("b.other").alias("rep")).join(least, "rep", "left")
    others = others.select("of", "s", F.explode(F.coalesce("ids", F.array("rep"))).alias("other"))
    own = least.select(F.col("rep").alias("of"), F.lit(-1.0).alias("s"), F.explode("ids").alias("other"))
    lists = others.unionByName(own).groupBy("of").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "other"))), 1, k + 1).alias("best"))
    each = lists.join(members, F.col("of") == F.col("rep"), "left").select(F.coalesce("job_index", "of").alias("job_index"), "best")
    return each.select("job_index", F.slice(F.filter("best", lambda b: b["other"] != F.col("job_index")), 1, k).alias("best"))


def packed(vectors: DataFrame, dim: int, finish: Callable[[np.ndarray, np.ndarray, list[bytes]], pa.RecordBatch], schema: str) -> DataFrame:
    """Usable ones of vectors of one length. ``finish`` gets ids, vectors and their bytes (half floats where these hold them
    exactly) and makes the output within the same Python task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):  # keeps the arrays small
                b = whole.slice(at, 1_000)
                ids = b.column("job_index").to_numpy(zero_copy_only=False).astype(np.int64)
                v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), dim)
                with np.errstate(all="ignore"):
                    keep = np.isfinite(v).all(1) & (v != 0).any(1)
                    half = v.astype(np.float16)
                    exact = (half == v).all(1)
                rows = np.flatnonzero(keep)
                if len(rows):
                    yield finish(ids[rows], v[rows], [half[r].tobytes() if exact[r] else v[r].tobytes() for r in rows])

    return vectors.select("job_index", "embedding").mapInArrow(run, schema)


def unpack(values: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of a binary column; without copying where all are half floats."""
    array = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    if not len(array):
        return np.zeros((0, dim), np.float16)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    if (np.diff(offsets) == 2 * dim).all():
        return np.frombuffer(array.buffers()[2], np.float16, len(array) * dim, int(offsets[0])).reshape(len(array), dim)
    return np.stack([np.frombuffer(v, np.float16 if len(v) == 2 * dim else np.float32).astype(np.float32) for v in array.to_pylist()])


def free() -> None:
    """Give buffers that are no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def read_cell(folder: str, block: int, only: np.ndarray | None = None, dim: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block's files by rising id, each id once; ``only`` these ids (all of them in the block, in rising order)."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/block={block}")) if f.path.endswith(".parquet"))
    t = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(["job_index", "v"]) for f in files])
    ids = t.column("job_index").to_numpy()
    _, first = np.unique(ids, return_index=True)
    if only is not None:
        first = first[np.searchsorted(ids[first], only)]
    return ids[first], unpack(t.column("v").take(pa.array(first)), dim)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of its file system, as executors have to know it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


_index: dict[tuple, CellIndex] = {}


def cell_index(folder: str, block: int, dim: int) -> CellIndex:
    """The index of a cell; a worker process keeps the last one."""
    if (folder, block) not in _index:
        _index.clear()
        free()
        _index[folder, block] = CellIndex(*read_cell(folder, block, dim=dim))
        free()
    return _index[folder, block]


def needed_part(spark: SparkSession, folder: str, ids: np.ndarray, x: np.ndarray, centres: np.ndarray, cell_of: np.ndarray, k: int, dim: int) -> float:
    """The largest ratio of the distance to a neighbour's cell to that of the k-th neighbour, over the k nearest of the given unit vectors among all rows of ``folder``."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sim, other, of = np.full((len(ids), k), -np.inf, np.float32), np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                them = b.column("job_index").to_numpy(zero_copy_only=False)
                s = x @ unit(unpack(b.column("v"), dim)).T
                s[ids[:, None] == them[None, :]] = -np.inf
                s = np.concatenate([sim, s], 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                sim = np.take_along_axis(s, best, 1)
                cells = cell_of[b.column("block").to_numpy(zero_copy_only=False)]
                other, of = (np.take_along_axis(np.concatenate([old, np.broadcast_to(new, (len(ids), len(new)))], 1), best, 1) for old, new in ((other, them), (of, cells)))
        q, at = np.nonzero(np.isfinite(sim))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(other[q, at]), pa.array(of[q, at]), pa.array(-sim[q, at].astype(np.float64))], names=["q", "other", "cell", "s"])

    found = spark.read.schema("job_index bigint, v binary, block bigint").parquet(folder).mapInArrow(nearest, "q bigint, other bigint, cell bigint, s double").groupBy("q")
    # a row that a repeated write left twice counts once
    top = found.agg(F.slice(F.array_distinct(F.array_sort(F.collect_list(F.struct("s", "other", "cell")))), 1, k).alias("b")).select("q", F.explode("b").alias("b")).select("q", "b.cell", "b.s").toPandas()
    q, cell = top.q.to_numpy(np.int64), top.cell.to_numpy(np.int64)
    furthest = np.full(len(ids), -1.0)
    np.maximum.at(furthest, q, top.s.to_numpy(float))
    away = plane_distance(x, nearest_centre(x, centres), centres)[q, cell] / (np.sqrt(np.maximum(2 + 2 * furthest[q], 0)) + SLACK)
    return min(1.0, float(away.max(initial=0)))


def neighbours(vectors: DataFrame, shards: DataFrame, k: int = 5, dim: int = 1024, cell: int = CELL) -> DataFrame:
    """``job_index, other, similarity, place``: the k most similar other vectors of every usable vector."""
    spark = vectors.sparkSession
    vectors = within(one_each(vectors, dim), shards)
    ids = materialize(vectors.select(F.col("job_index").cast("bigint").alias("job_index"), "h", "g"))
    groups = materialize(ids.groupBy("h", "g").agg(F.min("job_index").alias("rep"), F.max("job_index").alias("last")))
    n = groups.count()
    twins = groups.filter("rep <> last").select("h", "g", "rep")
    repeated = twins.limit(TWINS_LIMIT + 1).count()
    if repeated:  # one row for a group of equal vectors, however large it is
        vectors = vectors.join(F.broadcast(twins) if repeated <= TWINS_LIMIT else twins, ["h", "g"], "left").filter("rep is null or rep = job_index").drop("rep")
    every = -(-n // SAMPLE)
    centres, sizes, probes = np.zeros((1, dim), np.float32), np.array([n]), None

    def sampled(ids: np.ndarray, v: np.ndarray, _: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in unit(v)], pa.binary())], names=["job_index", "v"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("job_index").to_numpy(), np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, dim)) for b in batches if b.num_rows]
        if held:
            ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            held.clear()
            _, order = np.unique(ids, return_index=True)
            ids, x = ids[order], x[order]
            found, counts = fit_centres(x, min(CENTRES, -(-n // cell)))
            pick = np.sort(np.random.RandomState(12).permutation(len(ids))[:PROBES])
            for kind, numbers, rows in (("centre", counts, found), ("probe", ids[pick], x[pick])):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows)), pa.array(numbers.astype(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["kind", "number", "v"])

    if n > cell:
        rows = packed(vectors.filter(F.pmod(F.xxhash64("job_index"), F.lit(every)) == 0), dim, sampled, "job_index bigint, v binary").repartition(1).mapInArrow(fitted, "kind string, number bigint, v binary").toArrow().to_pylist()
        held = {kind: (np.array([r["number"] for r in rows if r["kind"] == kind]), np.frombuffer(b"".join(r["v"] for r in rows if r["kind"] == kind), np.float32).reshape(-1, dim)) for kind in ("centre", "probe")}
        if rows:
            centres, sizes, probes = held["centre"][1], held["centre"][0] * (n / held["centre"][0].sum()), held["probe"]
    pieces = np.maximum(1, np.ceil(sizes / (1.5 * cell))).astype(np.int64)
    base = np.r_[0, np.cumsum(pieces)]
    cell_of = np.repeat(np.arange(len(pieces)), pieces)

    def place(ids: np.ndarray, v: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        c = nearest_centre(unit(v), centres)
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(data, pa.binary()), pa.array(base[c] + h % pieces[c])], names=["job_index", "v", "block"])

    folder = qualified(spark, f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    blocks = int(base[-1])
    batches = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, 1_000)  # a row is 4 KB
    try:
        packed(vectors, dim, place, "job_index bigint, v binary, block bigint").repartition(max(1, blocks), "block").write.option("compression", "none").partitionBy("block").parquet(folder)
    finally:
        spark.conf.set(BATCHES, batches)
    part = needed_part(spark, folder, *probes, centres, cell_of, k, dim) if probes and blocks > 1 else 0.0
    # a row for each slice of each block, as a table
    counts = spark.read.schema("job_index bigint, block bigint").parquet(folder).groupBy("block").agg(F.countDistinct("job_index").alias("n"))
    plan = counts.select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(SLICE))).alias("start"), "n").select("block", "start", F.least(F.col("start") + SLICE, "n").alias("stop"))
    out = "job_index bigint, other array<bigint>, similarity array<double>, home bigint, start bigint, cells array<bigint>, bound double"

    def listed(found: np.ndarray, sims: np.ndarray) -> tuple[list, list]:
        size = (found >= 0).sum(1)
        return [f[:m].tolist() for f, m in zip(found, size, strict=True)], [v[:m].tolist() for v, m in zip(sims, size, strict=True)]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, start, end in zip(*[b.column(c).to_pylist() for c in ("block", "start", "stop")], strict=True):
                index = cell_index(folder, block, dim)
                rows = np.argsort(index.ids, kind="stable")[start:end]
                ids, x = index.ids[rows], index.x[rows]
                idx, exact, d = index.search(ids, index.raw[rows], np.full(len(ids), 4, np.float32), k)
                near = plane_distance(x, np.full(len(x), cell_of[block]), centres) <= part * (np.sqrt(np.maximum(d, 0)) + SLACK)[:, None]
                reach = near[:, cell_of]
                reach[:, block] = False
                others, sims = listed(idx, exact)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64())), *[pa.array(np.full(len(ids), c, np.int64)) for c in (block, start)], pa.array([np.flatnonzero(r).tolist() for r in reach], pa.list_(pa.int64())), pa.array(d.astype(np.float64))], names=["job_index", "other", "similarity", "home", "start", "cells", "bound"])

    # with enough cells for all cores a task takes a whole cell, so that its index is built once
    many = blocks >= 4 * spark.sparkContext.defaultParallelism
    plan = plan.repartition(2 * blocks, "block").sortWithinPartitions("block", "start") if many else plan.repartition(max(1, n // SLICE + blocks), "block", "start")
    first = materialize(plan.mapInArrow(home, out))
    # visits to one cell stay together in a few lanes, so that a worker builds its index once
    lanes = max(1, 2 * spark.sparkContext.defaultParallelism // blocks)
    visits = first.select(F.explode("cells").alias("cell"), "home", (F.col("start") if lanes > 1 else F.lit(0)).alias("part"), "job_index", "bound").withColumn("lane", F.pmod(F.xxhash64("home", "part"), F.lit(lanes)))

    def visit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell_, _, block, _ = (int(v) for v in key)
        rows = rows.sort_values("job_index")
        ids, v = read_cell(folder, block, rows.job_index.to_numpy(), dim)
        idx, exact, _ = cell_index(folder, cell_, dim).search(ids, v, rows.bound.to_numpy(np.float32), k)
        others, sims = listed(idx, exact)
        return pd.DataFrame({"job_index": ids, "other": others, "similarity": sims})

    results = first.select("job_index", "other", "similarity")
    if blocks > 1:
        results = results.unionByName(visits.repartition(2 * blocks * lanes, "cell", "lane").groupBy("cell", "lane", "home", "part").applyInPandas(visit, "job_index bigint, other array<bigint>, similarity array<double>"))
    pairs = results.select("job_index", F.explode(F.arrays_zip("other", "similarity")).alias("z")).select("job_index", (-F.col("z.similarity")).alias("s"), F.col("z.other").alias("other"))
    top = pairs.groupBy("job_index").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "other"))), 1, k).alias("best"))
    if repeated:
        top = carried_over(top, first, ids, twins, k)
    placed = top.select("job_index", F.posexplode("best").alias("place", "b")).select("job_index", F.col("b.other").alias("other"), (-F.col("b.s")).alias("similarity"), (F.col("place") + 1).alias("place"))
    result = materialize(placed)
    drop_folder(spark, folder)
    return result


def found_pairs(vectors: DataFrame, shards: DataFrame, k: int = 5) -> DataFrame:
    n = neighbours(vectors, shards, k)
    return n.select(F.least("job_index", "other").alias("job_index_a"), F.greatest("job_index", "other").alias("job_index_b")).distinct()
