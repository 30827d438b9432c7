"""Exact top-k inner products: vectors in length buckets, pruned per bucket by local cosine thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodgemetrics.llm.shared import staged

#: Vectors in one bucket block, and queries in one block.
BLOCK, QUERIES = 1024, 512
#: Coordinate lists looked at per query.
COORDINATES = 6


def quantized(df: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Integer vectors floor(scale * x) with their squared length; vectors null or holding null or non-finite
    components, and null ids, take no part. A component must stay under 2**53 after scaling."""
    x = F.transform(df[embedding].cast("array<double>"), lambda v: F.when(F.abs(v) < float("inf"), v))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return df.select(df[vec_id].alias("vec_id"), v.alias("v")) \
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull())) \
        .withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, np.int64) for r in rows])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: floating point where every sum fits in its 53 bits, else 64-bit integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if bound < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 2 ** 63:
        raise ValueError("scores do not fit in 64 bits")
    return a @ b.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= cut
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _candidates(q: np.ndarray, qlen: float, low: float, lens: np.ndarray, unit: np.ndarray, order: np.ndarray,
                sorted_unit: np.ndarray) -> np.ndarray | slice:
    """Rows of a bucket that can still reach ``low``: by length, or by the narrower of a few coordinate lists.

    cos(q, v) >= t confines v's coordinate f to [t q_f - s, t q_f + s], s = sqrt((1 - t^2)(1 - q_f^2)), q and v unit;
    where q_f > t the upper end is 1, where q_f < -t the lower end is -1, since the angle to the axis is within reach.
    """
    # rows are sorted by falling length: the least cosine any row needs, less what rounding may add to it
    t = low / (qlen * lens[0]) * (1 - 1e-9)
    by_length = int(np.searchsorted(-lens, -low / qlen * (1 - 1e-9), "right")) if low > 0 else len(lens)
    if t <= 0.3 or by_length < 64:
        return slice(0, by_length)  # the local threshold is too weak for coordinates: length pruning
    unit_q = q / qlen
    best: tuple[int, int, int, int] = (by_length, -1, 0, 0)
    for f in np.argsort(-np.abs(unit_q))[:COORDINATES]:
        s = np.sqrt(max(0.0, (1 - t * t) * (1 - unit_q[f] ** 2))) + 1e-9
        lo = 0 if unit_q[f] <= -t else int(np.searchsorted(sorted_unit[f], t * unit_q[f] - s))
        hi = len(lens) if unit_q[f] >= t else int(np.searchsorted(sorted_unit[f], t * unit_q[f] + s, "right"))
        if hi - lo < best[0]:
            best = (hi - lo, int(f), lo, hi)
    return slice(0, by_length) if best[1] < 0 else order[best[1], best[2]:best[3]]


def _search(bucket: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    bucket = bucket.sort_values("len2", ascending=False)
    v, ids = _matrix(bucket["v"]), bucket["vec_id"].to_numpy()
    lens = np.sqrt(bucket["len2"].to_numpy())
    unit = v / np.maximum(lens, 1e-300)[:, None]
    order = np.argsort(unit, axis=0, kind="stable").T
    sorted_unit = np.take_along_axis(unit, order.T, axis=0).T
    q, qids = _matrix(queries["v"]), queries["vec_id"].to_numpy()
    qlens, low = np.sqrt(queries["len2"].to_numpy()), queries["low"].to_numpy()
    found = []
    for i in range(len(q)):
        limit = low[i]
        if np.isnan(limit) or qlens[i] == 0:
            rows: np.ndarray | slice = slice(None)
        elif limit > qlens[i] * lens[0] * (1 + 1e-9):
            continue  # even the longest vector cannot reach the limit
        elif lens[0] == 0:
            rows = slice(None)
        else:
            rows = _candidates(q[i], qlens[i], limit, lens, unit, order, sorted_unit)
        sid = ids[rows]
        if not len(sid):
            continue
        score = _products(q[i:i + 1], v[rows])[0]
        keep = sid != qids[i]
        if not np.isnan(limit):
            keep &= score >= limit
        if keep.any():
            s, d = _best(score[keep], sid[keep], k)
            found.append(pd.DataFrame({"query_id": qids[i], "vec_id": d, "score": s}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def _searched(pairs: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Search each (bucket, query block) pair in a task of its own."""
    def run(key, queries: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or bucket.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return _search(bucket, queries, k)

    apart = buckets.select(F.col("bucket").alias("in_bucket"), F.col("qblock").alias("for_qblock"), "vec_id", "v", "len2")
    return pairs.groupBy("bucket", "qblock").cogroup(apart.groupBy("in_bucket", "for_qblock")).applyInPandas(
        run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; found rows number at most k per (query, bucket)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products among the other vectors.

    ``vectors`` and ``queries`` come from ``quantized``; ids are unique. Vectors are ranked by (dimension, falling
    length) into blocks of about BLOCK rows; queries meet only vectors of their own dimension. Each query first
    searches the bucket of the longest vectors, whose k-th score bounds what any other bucket must reach; there the
    local cosine threshold decides between length and coordinate pruning. Ties go to the smaller id; fewer than k
    candidates give fewer rows; empty tables give none. Zero vectors score 0.
    """
    sized = vectors.withColumn("dim", F.size("v"))
    n = sized.groupBy("dim").agg(F.count("*").alias("n"), F.min("len2").alias("lo"), F.max("len2").alias("hi"))
    buckets = sized.join(n, "dim") \
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK)) \
        .withColumn("step", F.when(F.col("hi") > F.col("lo"), F.floor(
            (F.col("hi") - F.col("len2")) / (F.col("hi") - F.col("lo")) * 999)).otherwise(0))
    counts = buckets.groupBy("dim", "blocks", "step").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("dim").orderBy("step").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    spread = counts.select("dim", "step", F.floor(before / BLOCK).alias("first"), F.ceil(F.col("m") / BLOCK).alias("parts"))
    placed = buckets.join(spread, ["dim", "step"]).select(
        "vec_id", "v", "len2", "dim", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("part")) \
        .withColumn("bucket", F.concat_ws(":", "dim", "part"))
    placed = staged(placed, "vectors")
    qn = queries.count()
    blocks = max(1, -(-qn // QUERIES))
    q = queries.withColumn("dim", F.size("v")).withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    names = placed.select("dim", "part", "bucket").distinct()
    top = names.groupBy("dim").agg(F.min_by("bucket", "part").alias("bucket"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = placed.select("bucket", "vec_id", "v", "len2", every_block.alias("qblock"))
    first = _searched(q.join(top, "dim").select("bucket", "qblock", "vec_id", "v", "len2",
                                                F.lit(None).cast("double").alias("low")),
                      copies.join(top.select("bucket"), "bucket", "left_semi"), k)
    first = staged(first, "first")
    low = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("low"))
    rest = names.join(top.select("bucket"), "bucket", "left_anti")
    limited = q.join(low, q["vec_id"] == low["query_id"], "left").select("dim", "qblock", "vec_id", "v", "len2", "low")
    others = _searched(limited.join(rest, "dim").select("bucket", "qblock", "vec_id", "v", "len2", "low"),
                       copies.join(rest.select("bucket"), "bucket", "left_semi"), k)
    return _ranked(first.unionByName(others), k).select("query_id", "rank", "vec_id", "score")
