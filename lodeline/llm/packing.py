"""Filling fixed-capacity containers with documents (problem 7): cost-balanced packing.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n^2`` (feed-forward plus attention). Documents in descending
size are assigned to the sequence of lowest cost that still has room; when none has, another one is opened. Only
documents above the capacity are divided: into full containers and one rest, which is packed like a document.

Documents are dealt by hash into shards of about ``SHARD`` rows; every shard is packed by itself in one task, so tasks are bounded
and the loss is at most the few open containers of each shard. Defined results: documents of no tokens (null, empty) take
a place in the first container of their shard; repeated doc_ids are separate rows told apart by ``part``
order; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.prefix_bpe import token_counts

CAPACITY, SHARD, LINEAR, QUADRATIC = 2_048, 20_000, 1.0, 1.0 / 4_096


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Sequences:
    """Open sequences by free tokens; the cheapest with enough room is found in one pass over the free sizes."""

    def __init__(self, capacity: int, opened: int) -> None:
        self.capacity = capacity
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.cheapest = np.full(capacity + 1, np.inf)
        self.count = 0
        for _ in range(opened):
            self.open()

    def open(self) -> None:
        self._put(self.capacity, 0.0, self.count)
        self.count += 1

    def _put(self, free: int, c: float, seq: int) -> None:
        heapq.heappush(self.heaps[free], (c, seq))
        self.cheapest[free] = self.heaps[free][0][0]

    def assign(self, size: int) -> int:
        at = size + int(np.argmin(self.cheapest[size:]))
        if not np.isfinite(self.cheapest[at]):
            self.open()
            at = self.capacity
        c, seq = heapq.heappop(self.heaps[at])
        self.cheapest[at] = self.heaps[at][0][0] if self.heaps[at] else np.inf
        self._put(at - size, c + cost(size), seq)
        return seq


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The sequence of each size (all at most the capacity, any order)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    seqs = Sequences(capacity, -(-sum(sizes) // capacity))
    out = [0] * len(sizes)
    for i in order:
        out[i] = seqs.assign(sizes[i])
    return out


def packed(counts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, key: str = "doc_id") -> DataFrame:
    """``key, part, container, place, start_token, n_tokens`` from ``key, n_tokens``."""
    n = counts.count()
    shards = max(1, -(-n // shard))
    kind = counts.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), (key, "ascending")])
        keys, sizes, s = t.column(key).to_pylist(), t.column("n_tokens").to_pylist(), t.column("shard")[0].as_py()
        rows = []
        for k, size in zip(keys, sizes, strict=True):
            for part, start in enumerate(range(0, max(size, 1), capacity)):
                rows.append((k, part, start, min(capacity, size - start)))
        seq = pack([r[3] for r in rows], capacity)
        place: dict[int, int] = {}
        out: list[tuple] = []
        for r, c in sorted(zip(rows, seq, strict=True), key=lambda x: (x[1], -x[0][3])):
            place[c] = place.get(c, 0) + 1
            out.append((r[0], r[1], (s << 32) + c, place[c], r[2], r[3]))
        cols = list(zip(*out, strict=True))
        return pa.table({key: pa.array(cols[0], t.schema.field(key).type), "part": pa.array(cols[1], pa.int32()), "container": pa.array(cols[2], pa.int64()), "place": pa.array(cols[3], pa.int32()), "start_token": pa.array(cols[4], pa.int64()), "n_tokens": pa.array(cols[5], pa.int64())})

    dealt = counts.select(key, "n_tokens", F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, f"`{key}` {kind}, part int, container bigint, place int, start_token bigint, n_tokens bigint")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    from lodeline.runtime import materialize

    return packed(materialize(token_counts(docs)), capacity)


def usage(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, share of unused space and how many documents were divided."""
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("unused"))


