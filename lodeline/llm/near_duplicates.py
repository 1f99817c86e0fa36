"""Near-duplicate records with small edits (problem 1): T-occurrence search with DivideSkip.

Records are sets of distinct runs of five characters. Each set is described by ``BANDS`` signature keys (a key is a hash of ``ROWS`` of the ``POOL``
min-wise values of the set), and every key has an inverted list of the records that carry it. A record looks for all others, after it in the order of
(size, id), that occur in at least ``T`` of its lists:

* *lists*: postings are sorted by key once; a list is read as a stream, so its length doesn't matter for memory. Records within a list meet those
  after them whose size fits the threshold, which are a range of the list;
* *divide*: lists longer than ``BLOCK`` are long, and of a record's long lists the longest is set aside (all records order their lists alike, so of
  the lists two records share at most one is lost). Other long lists meet block by block, each pair of blocks in a task of its own, so that a key
  that a third of all records carry isn't one task;
* *merge*: a record's short lists and what it met in blocks are heap-merged, and records with ``T`` occurrences stay;
* *probe*: records with ``T - 1`` occurrences stay if a key that either has set aside is found among the other's sorted keys by binary search;
* the exact share of common runs then decides.

Lists of raw five-character runs would grow with the corpus (phrases recur in a tenth of all records), which makes any merge quadratic; signature keys
keep list lengths near the true group sizes. Nothing is capped; ``missed`` gives the probability that a pair stays below ``T``.

Records with equal text are one class before the search, so a group of copies is one record in it.
Defined results: null titles count as empty; records whose description has fewer than ``least`` characters take no
part; empty input gives no rows; repeated job_ids count once.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.looks import comparable
from lodeline.runtime import enough_tasks, materialize, spread

RUN, POOL, BANDS, ROWS, T, BLOCK = 5, 128, 64, 4, 3, 256
_rng = np.random.RandomState(20240229)
_MUL = _rng.randint(0, 2**31, POOL, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.randint(0, 2**32, POOL, dtype=np.int64).astype(np.uint32)
#: The min-wise values of each key: every value serves in two keys.
_DRAWN = np.concatenate([_rng.permutation(POOL).reshape(-1, ROWS) for _ in range(BANDS * ROWS // POOL)])
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five characters of the whole text; a shorter text is one run."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < RUN:
        c = np.concatenate([c, np.zeros(RUN - len(c), np.uint64)])
    h = np.zeros(len(c) - RUN + 1, np.uint64)
    for i in range(RUN):
        h = h * _PRIME + c[i : len(c) - RUN + 1 + i] + np.uint64(1)
    return np.unique(_mix(h))


def signature_keys(hashes: np.ndarray) -> np.ndarray:
    """Sorted keys, one for each band, of a set of hashes; sets of any size are read in slices."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(POOL, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 512):
        part = short[at : at + 512, None] * _MUL  # the hashes are mixed already: a linear map orders them anew
        part += _ADD
        np.minimum(low, part.min(axis=0), out=low)
    m = low[_DRAWN].astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _PRIME + m[:, i])
    return np.sort(key.view(np.int64))


def missed(share: float, trials: int = 200_000, seed: int = 1) -> float:
    """The probability that a pair with this share of its union in common has fewer than ``T`` keys in common, by trial."""
    rng = np.random.default_rng(seed)
    below = 0
    for at in range(0, trials, 10_000):
        equal = rng.random((min(10_000, trials - at), POOL)) < share
        below += int((equal[:, _DRAWN].all(2).sum(1) < T).sum())
    return below / trials


def runs(text: str) -> set[str]:
    return {text[i : i + RUN] for i in range(len(text) - RUN + 1)} or {text}


def class_table(jobs: DataFrame, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """``members(job_id, rep)`` and ``classes(rep, text)``: equal texts form one class, named by its least job_id."""
    docs = comparable(enough_tasks(jobs), least).select("job_id", F.regexp_replace(F.concat(F.coalesce("title_form", F.lit("")), "description_form"), " ", "").alias("text"))
    docs = materialize(docs.withColumn("digest", F.sha2("text", 256)))
    classes = docs.groupBy("digest").agg(F.min(F.struct("job_id", "text")).alias("m")).select("digest", F.col("m.job_id").alias("rep"), F.col("m.text").alias("text"))
    members = docs.select("job_id", "digest").distinct().join(classes.select("digest", "rep"), "digest").select("job_id", "rep")
    return members, classes.select("rep", "text")


def signed(classes: DataFrame) -> DataFrame:
    """``x, rep, text, n, keys``: a number for each class, its distinct runs and sorted signature keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashed = [run_hashes(t) for t in b.column("text").to_pylist()]
            keys = [signature_keys(h) for h in hashed]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("text"), pa.array([len(h) for h in hashed], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["rep", "text", "n", "keys"])

    made = classes.select("rep", "text").mapInArrow(run, "rep string, text string, n int, keys array<bigint>")
    return made.select(F.monotonically_increasing_id().alias("x"), "rep", "text", "n", "keys")


def lists(postings: DataFrame, threshold: float) -> DataFrame:
    """``key, part, x, n, ys`` from ``key, x, n``.

    Of a list of at most ``BLOCK`` members: part -1 and, for every member, those after it that fit its size (members that meet nobody are left out).
    Of a longer one: one row for each member with its block as ``part`` and no ``ys``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the members of the last key so far
        long_key, place = None, 0  # of the key whose members are given out as they come

        def rows(key, part, x, n, ys, sizes):  # noqa: ANN001, ANN202
            offsets = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(x), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ys))], names=["key", "part", "x", "n", "ys"])

        def given(key, x, n, last):  # noqa: ANN001, ANN202
            """The finished lists of sorted postings, and what is held of the last key."""
            nonlocal long_key, place, held
            starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(key))
            if long_key is not None and len(key) and key[0] == long_key:  # goes on
                stop = int(ends[0])
                yield rows(key[:stop], (place + np.arange(stop)) // BLOCK, x[:stop], n[:stop], np.zeros(0, np.int64), np.zeros(stop, np.int64))
                place += stop
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                long_key = None
            keep = not last and len(starts)
            if keep and ends[-1] - starts[-1] <= BLOCK:
                held = [c[starts[-1] :] for c in (key, x, n)]
                starts, ends = starts[:-1], ends[:-1]
            size = ends - starts
            for s, e in zip(starts[size > BLOCK], ends[size > BLOCK], strict=True):
                yield rows(key[s:e], np.arange(e - s) // BLOCK, x[s:e], n[s:e], np.zeros(0, np.int64), np.zeros(e - s, np.int64))
                long_key, place = key[s], int(e - s)
            two = starts[size == 2]
            two = two[n[two + 1] * threshold <= n[two] + 1e-9]
            yield rows(key[two], np.full(len(two), -1, np.int64), x[two], n[two], x[two + 1], np.ones(len(two), np.int64))
            ok = (size > 2) & (size <= BLOCK)
            own, to, ys = [], [], []
            for s, e in zip(starts[ok].tolist(), ends[ok].tolist(), strict=True):
                # sizes rise within a list: whom a member fits is the range after it up to its size over the threshold
                upto = s + np.searchsorted(n[s:e], np.floor(n[s:e] / threshold + 1e-9), side="right")
                for i in range(s, e - 1):
                    if upto[i - s] > i + 1:
                        own.append(i)
                        to.append(int(upto[i - s]) - i - 1)
                        ys.append(np.sort(x[i + 1 : upto[i - s]]))
            at = np.array(own, np.int64)
            yield rows(key[at], np.full(len(at), -1, np.int64), x[at], n[at], np.concatenate(ys) if ys else np.zeros(0, np.int64), np.array(to, np.int64))

        for b in batches:
            cols = [np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, ("key", "x", "n"), strict=True)]
            held = [np.zeros(0, np.int64)] * 3
            yield from given(*cols, False)
        yield from given(*held, True)

    ordered = postings.repartition("key").sortWithinPartitions("key", "n", "x")
    return ordered.mapInArrow(run, "key bigint, part bigint, x bigint, n int, ys array<bigint>")


def block_meetings(members: DataFrame, threshold: float) -> DataFrame:
    """``x, ys`` of the members ``key, part, x, n`` of long lists: each pair of blocks of a list is a row of its own until it is met."""
    blocks = members.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("own"))
    count = blocks.groupBy("key").agg(F.max("part").alias("last"))
    # a block goes to all blocks from its own on; the pair is the key of the join
    left = blocks.join(count, "key").select("key", F.col("own").alias("mine"), F.explode(F.sequence("part", "last")).alias("part"))
    met = left.join(blocks, ["key", "part"]).filter(F.expr(f"own[0].n * {threshold} <= mine[size(mine) - 1].n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mine, own in zip(b.column("mine").to_pylist(), b.column("own").to_pylist(), strict=True):
                n, x = (np.array([e[c] for e in own], np.int64) for c in ("n", "x"))
                xs, ys = [], []
                for e in mine:
                    later = (n > e["n"]) | ((n == e["n"]) & (x > e["x"]))
                    fit = np.sort(x[later & (n * threshold <= e["n"])])
                    if len(fit):
                        xs.append(e["x"])
                        ys.append(fit)
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.list_(pa.int64()))], names=["x", "ys"])

    return met.select("mine", "own").mapInArrow(run, "x bigint, ys array<bigint>")


def heap_merge(sorted_lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Members of sorted lists with the number of lists each occurs in."""
    if len(sorted_lists) == 1:
        yield from ((y, 1) for y in sorted_lists[0])
        return
    for y, same in groupby(heapq.merge(*sorted_lists)):
        yield y, sum(1 for _ in same)


def merged(meetings: DataFrame, least: int) -> DataFrame:
    """``x, y, shared``: the records that occur in at least ``least`` lists of a record, from ``x, ys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for x, ys in zip(b.column("x").to_pylist(), b.column("ys").to_pylist(), strict=True):
                if x != last:
                    out += [(last, y, c) for y, c in heap_merge(own) if c >= least] if len(own) >= least else []
                    last, own = x, []
                own.append(ys)
            yield _columns(out)
        yield _columns([(last, y, c) for y, c in heap_merge(own) if c >= least] if len(own) >= least else [])

    return meetings.repartition("x").sortWithinPartitions("x").mapInArrow(run, "x bigint, y bigint, shared int")


def _columns(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["x", "y", "shared"])


def holds(keys: list[int], key: int | None) -> bool:
    """Whether sorted keys hold a key, by binary search."""
    if key is None:
        return False
    i = bisect_left(keys, key)
    return i < len(keys) and keys[i] == key


def candidates(sig: DataFrame, threshold: float) -> DataFrame:
    """``x, y``: pairs with at least ``T`` keys in common whose sizes fit."""
    found = materialize(lists(sig.select(F.explode("keys").alias("key"), "x", "n"), threshold))
    short = found.filter("part < 0").select("x", "ys")
    members = found.filter("part >= 0").select("key", "part", "x", "n")
    if members.isEmpty():
        return merged(short, T).select("x", "y")
    length = members.groupBy("key").agg(F.count("*").alias("len"))
    aside = materialize(members.join(length, "key").groupBy("x").agg(F.max(F.struct("len", "key")).alias("m")).select("x", F.col("m.key").alias("key")))
    rest = members.join(aside, ["key", "x"], "left_anti")
    met = materialize(merged(short.unionByName(block_meetings(rest, threshold)), T - 1))
    # the set-aside keys of pairs that need one more
    need = met.filter(F.col("shared") == T - 1).select("x", "y")
    keys = sig.select("x", "keys").join(aside, "x", "left")
    left, right = keys.select("x", F.col("keys").alias("kx"), F.col("key").alias("ax")), keys.select(F.col("x").alias("y"), F.col("keys").alias("ky"), F.col("key").alias("ay"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["x", "y"]).filter(pa.array([holds(ky, ax) or holds(kx, ay) for kx, ax, ky, ay in zip(*[b.column(c).to_pylist() for c in ("kx", "ax", "ky", "ay")], strict=True)], pa.bool_()))

    probed = need.join(left, "x").join(right, "y").select("x", "y", "kx", "ax", "ky", "ay").filter("ax is not null or ay is not null").mapInArrow(probe, "x bigint, y bigint")
    return met.filter(F.col("shared") >= T).select("x", "y").unionByName(probed)


def similar_pairs(classes: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``a, b, similarity``: pairs of classes with at least ``threshold`` of the union of their runs in common."""
    sig = materialize(signed(spread(classes)))
    texts = sig.select("x", "rep", "text")
    pairs = candidates(sig, threshold).join(texts.select(F.col("x").alias("y"), F.col("rep").alias("b"), F.col("text").alias("tb")), "y").select("x", "b", "tb")
    both = pairs.join(texts.withColumnRenamed("rep", "a").withColumnRenamed("text", "ta"), "x").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            a, c, s = [], [], []
            for x, y, tx, ty in zip(*[batch.column(k).to_pylist() for k in ("a", "b", "ta", "tb")], strict=True):
                if x != last:
                    last, mine = x, runs(tx)
                other = runs(ty)
                common = len(mine & other)
                share = common / (len(mine) + len(other) - common)
                if share >= threshold:
                    a.append(x)
                    c.append(y)
                    s.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.string()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(verify, "a string, b string, similarity double")


def found_pairs(jobs: DataFrame, threshold: float = 0.65, least: int = 40) -> DataFrame:
    """All pairs of postings that are the same advertisement: linked classes and members of one class."""
    members, classes = class_table(jobs, least)
    members = materialize(members)
    links = materialize(similar_pairs(classes, threshold))
    ma = members.select(F.col("rep").alias("a"), F.col("job_id").alias("ja"))
    mb = members.select(F.col("rep").alias("b"), F.col("job_id").alias("jb"))
    across = links.join(ma, "a").join(mb, "b").select("ja", "jb")
    inside = ma.join(mb, F.col("a") == F.col("b")).filter(F.col("ja") < F.col("jb")).select("ja", "jb")
    return across.unionByName(inside).select(F.least("ja", "jb").alias("job_id_a"), F.greatest("ja", "jb").alias("job_id_b"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, component``: connected components named by their least member, by alternating star contraction.

    Each round replaces edges by stars towards the least neighbour, first among larger and then among smaller
    ones; rounds end when no edge changes. Every round is checkpointed.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small_min.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(small)
        same = nxt.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0 and edges.join(nxt, ["u", "v"], "left_anti").limit(1).count() == 0
        edges = nxt
        if same:
            break
    return nodes.select("id").join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def advertisement_classes(jobs: DataFrame, threshold: float = 0.65, least: int = 40) -> DataFrame:
    """One row for each posting that takes part: ``job_id, class_id, n_links``; links between classes of equal
    text aren't expanded into pairs of copies."""
    members, classes = class_table(jobs, least)
    members = materialize(members)
    links = materialize(similar_pairs(classes, threshold))
    comp = components(links, members.select(F.col("rep").alias("id")).distinct())
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    return members.join(comp, members.rep == comp.id).join(degree, members.rep == degree.a, "left").select("job_id", F.col("component").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
