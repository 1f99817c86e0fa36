"""Exact dense retrieval on eligible rows, multi-view scoring and vector audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import vectors as V
from lodeline.runtime import bounded


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, eligible: DataFrame | None = None) -> DataFrame:
    """``qid, doc, score, rank`` for ``qid, qvec`` and ``doc, vec``: the query set against all rows, in built-in expressions."""
    rows = vectors if eligible is None or "qid" in eligible.columns else vectors.join(eligible, "doc", "left_semi")
    met = rows.join(bounded(queries, 1_000, "queries"), F.size("vec") == F.size("qvec"))
    if eligible is not None and "qid" in eligible.columns:
        met = met.join(eligible, ["qid", "doc"], "left_semi")
    scored = met.select("qid", "doc", V.dot(F.col("vec"), F.col("qvec")).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("doc").cast("string"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def batched_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """As ``exact_top_k`` for larger sets of queries: a matrix product by batch keeps the rows that may be among the k best in exact scores, the rest is a window."""
    q = queries.limit(10_001).toPandas()
    if len(q) > 10_000:
        raise ValueError("more than 10,000 queries: run them in several calls")
    qids = q.qid.tolist()
    exact = np.stack(q.qvec).astype(np.float64) if len(q) else np.zeros((0, 0))
    matrix = exact.astype(np.float32)
    size = np.sqrt((exact * exact).sum(1))
    kind = queries.schema["qid"].dataType.simpleString()
    doc_kind = vectors.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [i for i, v in enumerate(b.column("vec").to_pylist()) if v is not None and len(v) == matrix.shape[1]]
            if not rows or not len(matrix):
                continue
            sub = b.take(pa.array(rows))
            x = sub.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(rows), -1)
            s = matrix @ x.T
            keep = min(k, s.shape[1])
            # float32 scores only select: whatever may reach the k-th within their rounding is scored again in double precision
            s[np.isnan(s)] = -np.inf
            lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            slack = size * lengths[np.isfinite(lengths)].max(initial=0) * (x.shape[1] + 4) * 2.0**-23 + 1e-8
            edge = np.partition(-s, keep - 1, axis=1)[:, keep - 1].astype(np.float64)
            names = np.array([str(v) for v in sub.column("doc").to_pylist()])
            given = sub.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
            of, at, kept = [], [], []
            for i, qid in enumerate(qids):
                near = np.flatnonzero(-s[i] <= edge[i] + 2 * slack[i])
                scores = given[near] @ exact[i]
                best = np.lexsort((names[near], -np.round(scores, 9)))[:keep]
                of += [qid] * len(best)
                at.append(near[best])
                kept.append(scores[best])
            yield pa.RecordBatch.from_arrays([pa.array(of), sub.column("doc").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(kept))], names=["qid", "doc", "score"])

    part = vectors.select("doc", "vec").mapInArrow(run, f"qid {kind}, doc {doc_kind}, score double")
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("doc").cast("string"))
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def max_sim(queries: DataFrame, views: DataFrame) -> DataFrame:
    """``qid, doc, score``: the best similarity over the views ``doc, vec`` of a document."""
    met = views.join(bounded(queries, 1_000, "queries"), F.size("vec") == F.size("qvec"))
    return met.groupBy("qid", "doc").agg(F.max(V.dot(F.col("vec"), F.col("qvec"))).alias("score"))


def serving_vectors(vectors: DataFrame, dims: int, half: bool = True) -> DataFrame:
    """Prefix at length one, optionally rounded to half precision."""
    out = vectors.withColumn("vec", V.prefix_unit(F.col("vec"), dims))
    if not half:
        return out
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "vec" else "vec array<float>" for f in out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [None if v is None else np.asarray(v, np.float16).astype(np.float32).tolist() for v in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(vec, pa.list_(pa.float32())) if n == "vec" else b.column(n) for n in b.schema.names], names=b.schema.names)

    return out.mapInArrow(run, kinds)


def norm_audit(vectors: DataFrame, tolerance: float = 2e-3) -> DataFrame:
    """Counts of rows, of unusable rows and of rows whose length isn't one."""
    ok = V.is_usable(F.col("vec"))
    return vectors.select(ok.alias("usable"), F.when(ok, V.norm(F.col("vec"))).alias("norm")).agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("usable")).alias("n_unusable"), F.count_if(F.abs(F.col("norm") - 1) > tolerance).alias("n_off_norm"), F.round(F.max(F.abs(F.col("norm") - 1)), 6).alias("max_deviation")
    )


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], key: str = "doc", text: str = "text") -> DataFrame:
    """``key, vec`` by an injected batch encoder."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = np.asarray(encoder([t or "" for t in b.column(text).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(got.tolist(), pa.list_(pa.float32()))], names=[key, "vec"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, vec array<float>")
