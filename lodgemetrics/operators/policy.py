"""Scores into decisions: thresholds, calibration, model comparison, tiers, buffers, walk order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.distribution import equi_depth, ranked_counts, ranked_rows, value_counts
from lodgemetrics.functions.exprs import bookings, cancel_rate, count_if, literal_rows, ratio
from lodgemetrics.functions.special import mcnemar_exact, normal_two_sided
from lodgemetrics.session import cut_lineage

LABEL = "is_canceled"


def score_bookings(df: DataFrame, score: str = "p", threshold: float = 0.35) -> DataFrame:
    """Add predicted flag, risk bucket and tier to a cancellation probability."""
    return df.withColumns({
        "predicted_cancel": (F.col(score) >= threshold).cast("int"), "risk_bucket": bands.risk_bucket(score),
        "risk_tier": bands.risk_tier(score)})


def metrics(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    zero = F.lit(0.0)
    return [F.coalesce(precision, zero).alias("precision"), F.coalesce(recall, zero).alias("recall"),
            F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy")]


def _cells(positive: Column, label: Column, weight: Column) -> list[Column]:
    def total(p: int, y: int) -> Column:
        return F.sum(F.when((positive == p) & (label == y), weight).otherwise(0)).cast("long")
    return [total(0, 0).alias("tn"), total(1, 0).alias("fp"), total(0, 1).alias("fn"), total(1, 1).alias("tp")]


CONFUSION = ["tn", "fp", "fn", "tp"]


def confusion_at(df: DataFrame, threshold: float, score: str = "p", label: str = LABEL, by: list[str] = (),
                 weight: str | None = None) -> DataFrame:
    """With ``weight``, a row stands for so many, and ``label`` says how many of them are of class 1."""
    positive = (F.col(score) >= threshold).cast("int")
    if weight:
        ones, zeros = F.col(label), F.col(weight) - F.col(label)
        cells = [F.sum(F.when(positive == p, n).otherwise(0)).cast("long").alias(c)
                 for c, p, n in (("tn", 0, zeros), ("fp", 1, zeros), ("fn", 0, ones), ("tp", 1, ones))]
    else:
        cells = _cells(positive, F.col(label), F.lit(1))
    out = df.groupBy(*by).agg(*cells) if by else df.agg(*cells)
    return out.select(*by, *CONFUSION, *metrics(*[F.col(c) for c in CONFUSION]))


def roc_auc(df: DataFrame, score: str = "p", label: str = LABEL, by: list[str] = (), share: float | None = None,
            weight: str | None = None) -> DataFrame:
    """Exact rank-based AUC; ties count half. Buckets are 1e-5 wide, as fits probabilities; ``share`` bounds them for
    scores on another scale. With ``weight``, a row stands for so many, and ``label`` says how many are of class 1."""
    by = list(by)
    ones = F.sum(F.col(label)).alias("_ones")
    r = ranked_counts(value_counts(df, by, score, equi_depth(df, score, share) if share else 1e-5, [ones], weight), by)
    aggs = [F.sum("_ones").cast("double").alias("n1"), F.sum("_cnt").cast("double").alias("_all"),
            F.sum(F.col("_midrank") * F.col("_ones")).alias("_r1")]
    g = r.groupBy(*by).agg(*aggs) if by else r.agg(*aggs)
    n1 = F.col("n1")
    auc = ratio(F.col("_r1") - n1 * (n1 + 1) / 2, n1 * (F.col("_all") - n1))
    return g.select(*by, n1.cast("long").alias("positives"), (F.col("_all") - n1).cast("long").alias("negatives"),
                    auc.alias("roc_auc"))


def _level(score: str, grid: list[float]) -> Column:
    """How many thresholds of an ascending grid a score reaches."""
    return sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid), F.lit(0))


# Threshold grids of the sweep and the recall a policy must keep.
FINE = [i / 100 for i in range(28, 56)]
COARSE = [i / 100 for i in range(28, 56, 2)]
MIN_RECALL = 0.85


def threshold_sweep(df: DataFrame, rule: str = "global", score: str = "p", second: str = "p2", label: str = LABEL
                    ) -> DataFrame:
    """Confusion metrics of every threshold (pair) of a rule.

    global: score >= t1. dual_and: score >= t1 and second >= t2. segment: t1 for Online TA, t2
    for the rest. Bookings are first reduced to a table of threshold levels, at most a few
    hundred rows; the grid meets only that table.
    """
    if rule == "global":
        grid = literal_rows([{"i": i + 1, "j": 0, "t1": t, "t2": t} for i, t in enumerate(FINE)])
        a, b, positive = _level(score, FINE), F.lit(0), F.col("a") >= F.col("g.i")
    else:
        grid = literal_rows([{"i": i + 1, "j": j + 1, "t1": t, "t2": u}
                             for i, t in enumerate(COARSE) for j, u in enumerate(COARSE)])
        a = _level(score, COARSE)
        if rule == "dual_and":
            b, positive = _level(second, COARSE), (F.col("a") >= F.col("g.i")) & (F.col("b") >= F.col("g.j"))
        elif rule == "segment":
            b = (F.col("market_segment") == "Online TA").cast("int")
            positive = F.col("a") >= F.when(F.col("b") == 1, F.col("g.i")).otherwise(F.col("g.j"))
        else:
            raise ValueError(f"unknown rule: {rule}")
    levels = df.groupBy(a.alias("a"), b.alias("b"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    crossed = levels.withColumn("g", F.explode(grid))
    out = crossed.groupBy(F.lit(rule).alias("rule"), F.col("g.t1").alias("t1"), F.col("g.t2").alias("t2")).agg(
        *_cells(positive.cast("int"), F.col("y"), F.col("n")))
    return out.select("rule", "t1", "t2", *CONFUSION, *metrics(*[F.col(c) for c in CONFUSION]))


def pick_policy(sweep: DataFrame, min_recall: float = MIN_RECALL, by: list[str] = ("rule",)) -> DataFrame:
    """Fewest false positives among policies that keep the recall, then precision, then recall; without ``by``, the
    winner over all rule families."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy("fp", F.desc("precision"), F.desc("recall"), "t1", "t2", "rule")
    return (sweep.where(F.col("recall") >= min_recall).withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn"))


def score_by_variable(df: DataFrame, cols: list[str], score: str = "p", threshold: float = 0.35) -> DataFrame:
    """Mean score, actual and predicted cancel rate per category of each column, ranked."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category"))
                                for c in cols])).alias("s")
    rows = df.select(score, LABEL, pairs).select(score, LABEL, "s.variable", "s.category")
    g = rows.groupBy("variable", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_p"),
        (100.0 * F.avg(F.col(LABEL).cast("double"))).alias("actual_cancel_pct"),
        (100.0 * F.avg((F.col(score) >= threshold).cast("double"))).alias("predicted_cancel_pct"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("variable").orderBy(F.desc("mean_p"), "category")))


def calibration_table(df: DataFrame, score: str = "p", bins: int = 10, weight: str | None = None) -> DataFrame:
    """Mean score against actual rate per equal-width bin. With ``weight``, a row stands for so many bookings, and the label
    says how many of them were canceled."""
    slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    n = F.sum(F.col(weight)) if weight else None
    aggs = [n.alias("bookings"), (F.sum(F.col(score) * F.col(weight)) / n).alias("mean_p"),
            (F.sum(LABEL) / n).alias("cancel_rate")] if weight else [bookings(), F.avg(score).alias("mean_p"), cancel_rate()]
    return df.groupBy(slot.alias("bin")).agg(*aggs).withColumn("gap", F.col("mean_p") - F.col("cancel_rate"))


def risk_summary(df: DataFrame, label: Column, name: str, score: str = "p") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(bookings(), F.avg(score).alias("mean_p"), cancel_rate())


def model_compare(df: DataFrame, score_a: str, t_a: float, score_b: str, t_b: float, p_value: bool = True) -> DataFrame:
    """McNemar and two-proportion false-positive-rate test of policy B against policy A."""
    y = F.col(LABEL)
    a, b = (F.col(score_a) >= t_a).cast("int"), (F.col(score_b) >= t_b).cast("int")
    g = df.agg(count_if((a != y) & (b == y)).cast("double").alias("n01"),
               count_if((a == y) & (b != y)).cast("double").alias("n10"),
               count_if(y == 0).cast("double").alias("n_negatives"),
               count_if((y == 0) & (a == 1)).cast("double").alias("_fa"),
               count_if((y == 0) & (b == 1)).cast("double").alias("_fb"))
    n, fa, fb = F.col("n_negatives"), ratio("_fa", "n_negatives"), ratio("_fb", "n_negatives")
    pool = ratio(F.col("_fa") + F.col("_fb"), 2 * n)
    gap = F.greatest(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(0.0))
    out = g.select(
        "n01", "n10", ratio(gap * gap, F.col("n01") + F.col("n10")).alias("mcnemar_chi2"), "n_negatives",
        fa.alias("fpr_a"), fb.alias("fpr_b"), ratio(fb - fa, F.sqrt(ratio(pool * (1 - pool) * 2, n))).alias("fpr_z"))
    if not p_value:
        return out
    return out.withColumns({"mcnemar_p": mcnemar_exact("n01", "n10"), "fpr_p": normal_two_sided("fpr_z")})


#: Cells of one range of scores, and cells drawn at once for all replicates (their draws stay in a core's cache).
_RANGE, _CHUNK = 50_000, 256


@lru_cache(maxsize=64)
def _poisson_table(mean: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of a Poisson distribution, and the draw of every number by its leading 16 bits, -1 where a step cuts them."""
    k = np.arange(1, int(mean + 12 * np.sqrt(mean) + 25))
    steps = np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean))
    drawn = np.searchsorted(steps, np.arange(2 ** 16 + 1) / 2.0 ** 16, "right")
    return steps, np.where(drawn[:-1] == drawn[1:], drawn[:-1], -1).astype(float)


def _poisson_weights(cell: np.ndarray, n: np.ndarray, n_boot: int) -> np.ndarray:
    """Poisson draw of mean n for each cell and replicate, a function of the cell's hash and the replicate alone."""
    x = cell.view(np.uint64)[:, None] + np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    out = np.empty(x.shape)
    for mean in np.unique(n).tolist():
        rows = slice(None) if n[0] == mean == n[-1] and (n == mean).all() else n == mean
        own = x[rows]
        steps, table = _poisson_table(mean)
        drawn = table.take((own >> np.uint64(48)).view(np.int64))
        cut = drawn < 0
        if cut.any():
            drawn[cut] = np.searchsorted(steps, (own[cut] >> np.uint64(11)).astype(float) * 2.0 ** -53, "right")
        out[rows] = drawn
    return out


def _won(w: np.ndarray, s: np.ndarray, y: np.ndarray, below_q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positives, negatives and won pairs of each replicate over whole scores, with ``below_q`` negatives below them."""
    zero = y == 0
    under = np.vstack([np.zeros(w.shape[1]), np.cumsum(w[zero], axis=0)])
    before = np.concatenate([[0], np.cumsum(zero)])
    starts = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.flatnonzero(starts)
    place = (np.cumsum(starts) - 1)[y == 1]
    low, high = before[first][place], before[np.append(first[1:], len(s))][place]
    ones = w[y == 1]
    less = under[low] if (low == high).all() else (under[low] + under[high]) / 2
    p = ones.sum(axis=0)
    return p, under[-1], p * below_q + np.einsum("ij,ij->j", ones, less)


def _auc_parts(batches: Iterator[pd.DataFrame], n_boot: int) -> Iterator[pd.DataFrame]:
    """For each score of a range (rows sorted by m, s): its least value, drawn positives and negatives and won pairs of
    each replicate inside the range. Memory does not follow the range."""
    def told(m, low, p, q, won):
        return pd.DataFrame({"m": [m], "low": [low], "p": [p.tolist()], "q": [q.tolist()], "won": [won.tolist()]})

    m = low = last = below_p = below_q = won = p = q = None
    for batch in batches:
        for at in range(0, len(batch), _CHUNK):
            for name, part in batch.iloc[at:at + _CHUNK].groupby("m", sort=False):
                s, y = part["s"].to_numpy(), part["y"].to_numpy()
                if name != m:
                    if m is not None:
                        yield told(m, low, below_p + p, below_q + q, won + p * (below_q + q / 2))
                    m, low, last = name, s[0], s[0]
                    below_p, below_q, won, p, q = (np.zeros(n_boot) for _ in range(5))
                w = _poisson_weights(part["cell"].to_numpy(), part["n"].to_numpy(), n_boot)
                a, b = np.searchsorted(s, last, "right"), np.searchsorted(s, s[-1], "left")  # scores a:b are complete
                p, q = p + w[:a][y[:a] == 1].sum(axis=0), q + w[:a][y[:a] == 0].sum(axis=0)
                if a == len(s):
                    continue
                won, below_p, below_q = won + p * (below_q + q / 2), below_p + p, below_q + q
                if a < b:
                    more = _won(w[a:b], s[a:b], y[a:b], below_q)
                    below_p, below_q, won = below_p + more[0], below_q + more[1], won + more[2]
                p, q = w[b:][y[b:] == 1].sum(axis=0), w[b:][y[b:] == 0].sum(axis=0)
                last = s[-1]
    if m is not None:
        yield told(m, low, below_p + p, below_q + q, won + p * (below_q + q / 2))


def bootstrap_delta_auc(df: DataFrame, score_a: str, score_b: str, n_boot: int = 500, bins: int | None = None,
                        seed: int = 42) -> DataFrame:
    """Interval of AUC(b) - AUC(a) from a paired Poisson bootstrap.

    Bookings collapse to (a, b, label) counts; a replicate redraws each cell count, which keeps the pairing. Scores are
    exact; with ``bins``, scores inside a bin count as ties. Each score is cut into ranges, a task counts the pairs
    inside its range for all replicates, and ranges are joined by their sums. Rows without a score take no part.
    """
    def slot(c: str) -> Column:
        return F.col(c).cast("double") if bins is None else F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("double")

    cells = cut_lineage(df.groupBy(slot(score_a).alias("a"), slot(score_b).alias("b"), F.col(LABEL).alias("y")).agg(
        F.count(F.lit(1)).alias("n")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("y").isin(0, 1)))
    side = F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col("a").alias("s")),
                             F.struct(F.lit("b").alias("m"), F.col("b").alias("s")))).alias("e")
    sides = cells.select(F.xxhash64(F.lit(seed), "a", "b", "y").alias("cell"), F.col("y").cast("int").alias("y"), "n", side) \
        .select("e.m", "e.s", "cell", "y", "n")
    ranges = int(max(8, cells.count() * 2 // _RANGE))
    parts = sides.repartitionByRange(ranges, "m", "s").sortWithinPartitions("m", "s").mapInPandas(
        lambda batches: _auc_parts(batches, n_boot),
        "m string, low double, p array<double>, q array<double>, won array<double>")
    by_rep = parts.select("m", "low", F.posexplode(F.arrays_zip("p", "q", "won")).alias("rep", "x")).select("m", "low", "rep", "x.*")
    w = W.partitionBy("rep", "m").orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    pairs = by_rep.withColumn("won", F.col("won") + F.col("p") * F.coalesce(F.sum("q").over(w), F.lit(0.0)))
    auc = pairs.groupBy("rep", "m").agg(ratio(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))
    deltas = auc.groupBy("rep").agg((F.max(F.when(F.col("m") == "b", F.col("auc")))
                                     - F.max(F.when(F.col("m") == "a", F.col("auc")))).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return deltas.agg(F.avg("d").alias("delta_auc_mean"), q[0].alias("ci95_low"), q[1].alias("ci95_high"),
                      F.count(F.lit(1)).alias("n_boot"))


def overbooking_buffer(df: DataFrame, by: str = "market_segment", safety: float = 0.6, cap: float = 0.20,
                       group_cap: float = 0.15) -> DataFrame:
    """Buffer = cancel rate x safety, capped; Groups have their own lower cap."""
    out = df.groupBy(by, bands.season("arrival_month_number").alias("season")).agg(bookings(), cancel_rate())
    limit = F.when(F.col(by) == "Groups", group_cap).otherwise(cap)
    raw = F.col("cancel_rate") * safety
    return out.withColumn("buffer", F.least(raw, limit)).withColumn("is_capped", (raw > limit).cast("int"))


def walk_order(df: DataFrame, ties: list[str] = ("booking_key",)) -> DataFrame:
    """Who is walked first per hotel and day: low rate, then low loyalty, then booked late."""
    return ranked_rows(df, ["hotel", "arrival_date"], "adr",
                       [F.col("is_repeated_guest"), F.col("previous_bookings_not_canceled"), F.col("lead_time"),
                        *[F.col(t) for t in ties]], "walk_rank")
