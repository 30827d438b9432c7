"""Correlation, association and hypothesis tests from distributed counts."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgemetrics.functions.distribution import bucket_of, describe_by, equi_depth, ranked_counts, value_counts
from lodgemetrics.functions.exprs import ratio
from lodgemetrics.functions.medians import difference_quantiles, resampled_median
from lodgemetrics.functions.special import (
    chi2_sf, fisher_two_sided, normal_two_sided, poisson_draw, t_two_sided,
)
from lodgemetrics.operators.logit import factor_logits, logit_terms
from lodgemetrics.schema import LEAKAGE_COLUMNS
from lodgemetrics.session import cut_lineage


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def leakage_flags(columns: list[str]) -> dict[str, bool]:
    """Which columns are only known after the outcome."""
    return {c: c in LEAKAGE_COLUMNS for c in columns}


def pearson_vs(df: DataFrame, target: str, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Correlation of each column with the target, from one aggregate, ranked by size."""
    aggs = [F.corr(_num(c), _num(target)).alias(c) for c in cols]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    long = wide.unpivot(list(by), cols, "variable", "pearson")
    flags = F.create_map(*[F.lit(x) for c, f in leakage_flags(cols).items() for x in (c, int(f))])
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy(F.abs("pearson").desc_nulls_last(), "variable")
    return long.withColumn("rank", F.row_number().over(w)).withColumn("is_leakage", flags[F.col("variable")])


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Upper triangle of the correlation matrix in long form, from one aggregate."""
    pairs = list(combinations(cols, 2))
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(_num(a), _num(b)).alias("pearson"))
            for a, b in pairs]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def spearman_vs(df: DataFrame, target: str, cols: list[str], share: float | None = None) -> DataFrame:
    """Mean-rank correlation of each column with the target; pairs with a NULL are left out.

    Works on joint value counts, so ranks are computed over distinct values. ``share`` bounds the buckets (see
    ``functions.distribution``).
    """
    long = df.select(_num(target).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), _num(c).alias("_x")) for c in cols])).alias("s"))
    long = long.select("s.variable", "s._x", "_y").where("_x IS NOT NULL AND _y IS NOT NULL")
    joint = long.groupBy("variable", "_x", "_y").agg(F.count(F.lit(1)).alias("_cnt"))

    def ranks(side: str) -> DataFrame:
        v = F.col(side)
        edges = equi_depth(joint, side, share) if share else None
        counts = joint.groupBy("variable", bucket_of(v, edges).alias("_bucket"), v.alias("_value")).agg(
            F.sum("_cnt").alias("_cnt"))
        return ranked_counts(counts, ["variable"]).select(
            "variable", F.col("_value").alias(side), F.col("_midrank").alias(f"{side}r"), F.col("_n").alias(f"{side}n"))

    scored = joint.join(ranks("_x"), ["variable", "_x"]).join(ranks("_y"), ["variable", "_y"])
    mean = (F.col("_xn") + 1) / 2.0
    a, b, c = F.col("_xr") - mean, F.col("_yr") - mean, F.col("_cnt")
    sums = scored.groupBy("variable").agg(F.sum(a * b * c).alias("ab"), F.sum(a * a * c).alias("aa"),
                                          F.sum(b * b * c).alias("bb"))
    return sums.select("variable", ratio("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"))


def partial_corr(df: DataFrame, x: str, y: str, controls: list[str], by: list[str] = ()) -> DataFrame:
    """Correlation of x and y after removing the linear effect of the controls.

    Uses the recursion on pairwise correlations, all taken in one aggregate; equals the
    correlation of regression residuals.
    """
    names = [x, y, *controls]
    complete = df.na.drop(subset=names)
    pairs = {frozenset(p): f"_r{i}" for i, p in enumerate(combinations(names, 2))}
    aggs = [F.corr(_num(a), _num(b)).alias(pairs[frozenset((a, b))]) for a, b in combinations(names, 2)]
    wide = complete.groupBy(*by).agg(*aggs) if by else complete.agg(*aggs)

    @lru_cache(maxsize=None)
    def given(a: str, b: str, rest: tuple[str, ...]) -> Column:
        if not rest:
            return F.col(pairs[frozenset((a, b))])
        z, left = rest[0], rest[1:]
        ab, az, bz = given(a, b, left), given(a, z, left), given(b, z, left)
        return ratio(ab - az * bz, F.sqrt((1 - az * az) * (1 - bz * bz)))

    return wide.select(*by, F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(",".join(controls)).alias("controls"),
                       given(x, y, ()).alias("pearson"), given(x, y, tuple(controls)).alias("partial_corr"))


# --- contingency

def contingency(df: DataFrame, cols: list[str], target: str, by: list[str] = ()) -> DataFrame:
    """Cell counts (by, variable, x, y, o) of every column against the target, in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("x")) for c in cols])).alias("s")
    return (df.select(*by, F.col(target).cast("string").alias("y"), pairs).select(*by, "s.variable", "s.x", "y")
            .where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "variable", "x", "y")
            .agg(F.count(F.lit(1)).alias("o")))


def association(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Chi-square, dof, Cramer's V and the smallest expected count per variable.

    A 2 x 2 table gets Yates' correction. Zero cells need no row: they follow from the margins.
    """
    key = [*by, "variable"]
    row, column = W.partitionBy(*key, "x"), W.partitionBy(*key, "y")
    c = cells.withColumns({"_r": F.sum("o").over(row).cast("double"), "_c": F.sum("o").over(column).cast("double"),
                           "_n": F.sum("o").over(W.partitionBy(*key)).cast("double"),
                           "_rk": F.count("o").over(row), "_ck": F.count("o").over(column)})
    expected = F.col("_r") * F.col("_c") / F.col("_n")
    g = c.groupBy(*key).agg(
        F.max("_n").alias("n"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("k"),
        F.sum(F.col("o") * F.col("o") / (F.col("_r") * F.col("_c"))).alias("_s"),
        F.max(F.abs(F.col("o") - expected)).alias("_d"),
        F.sum(1 / (F.col("_r") * F.col("_rk"))).alias("_ir"), F.sum(1 / (F.col("_c") * F.col("_ck"))).alias("_ic"),
        (F.min("_r") * F.min("_c") / F.max("_n")).alias("min_expected"))
    plain = F.greatest(F.col("n") * (F.col("_s") - 1), F.lit(0.0))
    short = F.greatest(F.col("_d") - 0.5, F.lit(0.0))
    yates = short * short * F.col("n") * F.col("_ir") * F.col("_ic")
    g = g.withColumn("chi2", F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(plain))
    least = F.least(F.col("r") - 1, F.col("k") - 1)
    return g.select(*key, "n", "r", "k", "chi2", ((F.col("r") - 1) * (F.col("k") - 1)).alias("dof"),
                    F.sqrt(ratio("chi2", F.col("n") * least)).alias("cramers_v"), "min_expected")


def cramers_v(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    return association(contingency(df, [x], y, by), by).select(*by, "variable", "cramers_v")


def cramers_v_all(df: DataFrame, cols: list[str], target: str = "is_canceled") -> DataFrame:
    """Cramer's V, cancel-rate spread in points and category count per column."""
    cells = contingency(df, cols, target)
    rates = cells.groupBy("variable", "x").agg(
        (100.0 * ratio(F.sum(F.when(F.col("y") == "1", F.col("o")).otherwise(0)), F.sum("o"))).alias("rate"))
    spread = rates.groupBy("variable").agg((F.max("rate") - F.min("rate")).alias("cancel_spread_pp"))
    return (association(cells).join(spread, "variable")
            .select("variable", "cramers_v", "cancel_spread_pp", F.col("r").alias("n_categories")))


def chi_square_test(df: DataFrame, cols: list[str], target: str, by: list[str] = (), p_value: bool = True
                    ) -> DataFrame:
    """Independence test per column with the number of expected counts below 5."""
    return _independence(contingency(df, cols, target, by), by, p_value)


def _independence(cells: DataFrame, by: list[str], p_value: bool) -> DataFrame:
    key = [*by, "variable"]
    rows = cells.groupBy(*key, "x").agg(F.sum("o").alias("_r"))
    columns = cells.groupBy(*key, "y").agg(F.sum("o").alias("_c"))
    totals = cells.groupBy(*key).agg(F.sum("o").alias("_t"))
    full = rows.join(columns, key).join(totals, key)
    small = full.groupBy(*key).agg(
        F.count(F.when(F.col("_r") * F.col("_c") / F.col("_t") < 5, 1)).alias("cells_expected_lt_5"))
    out = association(cells, by).join(small, key)
    return out.withColumn("p_value", chi2_sf("chi2", F.col("dof").cast("double"))) if p_value else out


def two_prop_ztest_pairwise(df: DataFrame, var: str, target: str = "is_canceled", p_value: bool = True) -> DataFrame:
    """Cancel-rate z-test for each pair of categories with pooled error and Bonferroni.

    Pairs are formed between categories, after the bookings are reduced to two counts each.
    """
    counts = df.where(F.col(var).isNotNull()).groupBy(F.col(var).cast("string").alias("g")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(target)).cast("double").alias("c"))
    groups = counts.agg(F.array_sort(F.collect_list(F.struct("g", "n", "c"))).alias("all"))
    first = groups.select("all", F.posexplode("all").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b")).select(
        F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), F.col("a.n").alias("na"), F.col("a.c").alias("ca"),
        F.col("b.n").alias("nb"), F.col("b.c").alias("cb"))
    p1, p2 = F.col("ca") / F.col("na"), F.col("cb") / F.col("nb")
    pool = (F.col("ca") + F.col("cb")) / (F.col("na") + F.col("nb"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("na") + 1 / F.col("nb")))
    odds = ratio((F.col("na") - F.col("ca")) * F.col("cb"), F.col("ca") * (F.col("nb") - F.col("cb")))
    out = pairs.select("group_a", "group_b", "na", "ca", "nb", "cb", (p1 * 100).alias("rate_a_pct"),
                       (p2 * 100).alias("rate_b_pct"), F.coalesce(ratio(p1 - p2, se), F.lit(0.0)).alias("z_stat"),
                       odds.alias("odds_ratio"))
    if p_value:
        total = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
        out = out.withColumn("p_value", normal_two_sided("z_stat")).withColumn(
            "p_bonferroni", F.least(F.col("p_value") * total, F.lit(1.0))).withColumn(
            "fisher_p", fisher_two_sided(F.col("na") - F.col("ca"), "ca", F.col("nb") - F.col("cb"), "cb"))
    return out.drop("na", "ca", "nb", "cb")


def fisher_2x2(df: DataFrame, x: str, y: str, by: list[str] = (), p_value: bool = True) -> DataFrame:
    """Odds ratio and exact p of two 0/1 columns."""
    def cell(i: int, j: int) -> Column:
        return F.count(F.when((F.col(x) == i) & (F.col(y) == j), 1)).cast("double").alias(f"n{i}{j}")
    cells = [cell(i, j) for i in (0, 1) for j in (0, 1)]
    out = df.groupBy(*by).agg(*cells) if by else df.agg(*cells)
    out = out.withColumn("odds_ratio", ratio(F.col("n00") * F.col("n11"), F.col("n01") * F.col("n10")))
    return out.withColumn("p_value", fisher_two_sided("n00", "n01", "n10", "n11")) if p_value else out


# --- two samples

def mann_whitney(df: DataFrame, x: str, group: str, by: list[str] = (), share: float | None = None,
                 p_value: bool = True) -> DataFrame:
    """U of group 0 against group 1 with tie-corrected z and rank-biserial effect size; ``share`` bounds the buckets."""
    by = list(by)
    ones = F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("_ones")
    counts = value_counts(df.where(F.col(group).isin(0, 1)), by, x, equi_depth(df, x, share) if share else None, [ones])
    r = ranked_counts(counts, by)
    zeros = F.col("_cnt") - F.col("_ones")
    t = F.col("_cnt").cast("double")
    aggs = [F.sum(zeros).cast("double").alias("n0"), F.sum("_ones").cast("double").alias("n1"),
            F.sum(F.col("_midrank") * zeros).alias("_r0"), F.sum(t * t * t - t).alias("_ties")]
    g = r.groupBy(*by).agg(*aggs) if by else r.agg(*aggs)
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    u = F.col("_r0") - n0 * (n0 + 1) / 2
    sigma = F.sqrt(n0 * n1 / 12 * ((n + 1) - ratio("_ties", n * (n - 1))))
    g = g.withColumn("u_stat", u)
    z = ratio(F.greatest(F.col("u_stat"), n0 * n1 - F.col("u_stat")) - n0 * n1 / 2 - 0.5, sigma)
    g = g.withColumn("z_stat", z).withColumn("rank_biserial", 1 - ratio(2 * F.col("u_stat"), n0 * n1))
    g = g.drop("_r0", "_ties")
    return g.withColumn("p_value", F.least(normal_two_sided("z_stat"), F.lit(1.0))) if p_value else g


def welch_t(df: DataFrame, x: str, group: str, by: list[str] = (), p_value: bool = True) -> DataFrame:
    """Mean of group 1 minus group 0 with unequal variances."""
    def part(flag: int) -> list[Column]:
        v = F.when(F.col(group) == flag, _num(x))
        return [F.count(v).cast("double").alias(f"n{flag}"), F.avg(v).alias(f"mean{flag}"),
                F.var_samp(v).alias(f"_v{flag}")]
    g = df.groupBy(*by).agg(*part(0), *part(1)) if by else df.agg(*part(0), *part(1))
    a, b = ratio("_v0", "n0"), ratio("_v1", "n1")
    g = g.withColumn("t_stat", ratio(F.col("mean1") - F.col("mean0"), F.sqrt(a + b)))
    g = g.withColumn("dof", ratio((a + b) * (a + b), ratio(a * a, F.col("n0") - 1) + ratio(b * b, F.col("n1") - 1)))
    g = g.drop("_v0", "_v1")
    return g.withColumn("p_value", t_two_sided("t_stat", "dof")) if p_value else g


def bootstrap_median_diff(df: DataFrame, x: str, group: str, n_boot: int | None = None, seed: int = 42,
                          by: list[str] = ()) -> DataFrame:
    """Percentile interval of median(group 1) - median(group 0) under resampling.

    Exact by default: the median of a resample follows from the ranks of the distinct values and binomial
    probabilities, so no replicate is drawn (see ``median_diff_interval``). With ``n_boot`` replicates, a Poisson
    bootstrap on value counts redraws how often each distinct value occurs, from a hash of (replicate, value).
    """
    by = list(by)
    if n_boot is None:
        return median_diff_interval(df, x, group, by)
    counts = value_counts(df, [*by, group], x)
    reps = counts.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))

    def uniform(tag: int) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(tag), F.col("rep"), F.col("_value"), F.col(group).cast("string"),
                       *[F.col(c).cast("string") for c in by])
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2 ** 53)

    drawn = reps.withColumn("_cnt", poisson_draw(F.col("_cnt").cast("double"), uniform(1), uniform(2)))
    medians = describe_by(df, [*by, "rep", group], x, {"median": 0.5}, counts=drawn.where("_cnt > 0"))
    diff = F.max(F.when(F.col(group) == 1, F.col("median"))) - F.max(F.when(F.col(group) == 0, F.col("median")))
    diffs = medians.groupBy(*by, "rep").agg(diff.alias("diff"))
    out = describe_by(diffs, by, "diff", {"median_diff": 0.5, "ci_low": 0.025, "ci_high": 0.975})
    return out.select(*by, F.col("n").alias("replicates"), "median_diff", "ci_low", "ci_high")


def median_diff_interval(df: DataFrame, x: str, group: str, by: list[str] = ()) -> DataFrame:
    """``by, n0, n1, median_diff, ci_low, ci_high``: quantiles .5, .025 and .975 of the difference of resampled medians.

    A resample's median is a value of rank about n / 2, so only distinct values whose rank lies within sqrt(19 n) of
    the middle matter (all others together have a chance below 1e-15); they alone are brought together, one task for
    each group of ``by``. Groups without values on both sides have NULLs.
    """
    by = list(by)
    key = by or ["_one"]
    rows = df.where(F.col(group).isin(0, 1)).withColumn("_side", F.col(group).cast("int"))
    rows = rows if by else rows.withColumn("_one", F.lit(1))
    ranked = ranked_counts(value_counts(rows, [*key, "_side"], x), [*key, "_side"])
    reach = F.sqrt(19.0 * F.col("_n"))
    central = ranked.where((F.col("_start") + F.col("_cnt") >= F.col("_n") / 2 - reach)
                           & (F.col("_start") <= F.col("_n") / 2 + reach))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in central.select(*key).schema.fields]

    def solve(name: tuple, table: pa.Table) -> pa.Table:
        side = table["_side"].to_numpy()
        value, start, cnt, n = (table[c].to_numpy().astype(float) for c in ("_value", "_start", "_cnt", "_n"))
        sides, sizes = [], []
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            own = own[np.argsort(value[own])]
            sizes.append(int(n[own[0]]) if len(own) else 0)
            if len(own):
                sides.append(resampled_median(value[own], start[own], start[own] + cnt[own], sizes[s]))
        answer = difference_quantiles(sides[1], sides[0], [0.5, 0.025, 0.975]) if len(sides) == 2 else [None] * 3
        data = {k: pa.array([v.as_py()], v.type) for k, v in zip(key, name)}
        data |= {"n0": pa.array([sizes[0]], pa.int64()), "n1": pa.array([sizes[1]], pa.int64())}
        data |= {c: pa.array([v], pa.float64()) for c, v in zip(("median_diff", "ci_low", "ci_high"), answer)}
        return pa.table(data)

    out = central.select(*key, "_side", "_value", "_start", "_cnt", "_n").groupBy(*key).applyInArrow(
        solve, ", ".join([*types, "n0 long, n1 long, median_diff double, ci_low double, ci_high double"]))
    return out.select(*by, "n0", "n1", "median_diff", "ci_low", "ci_high")


def tests_by_hotel(df: DataFrame, p_value: bool = True, logits: bool = True) -> DataFrame:
    """Lead-time U test, and chi-square and logit of lead bin, deposit and segment, per hotel.

    ``df`` needs lead_time_bin and deposit_type. A logit's statistic is its likelihood ratio, its effect the pseudo R2.
    """
    factors = ["lead_time_bin", "deposit_type", "market_segment"]
    df = cut_lineage(df.select("hotel", "lead_time", "is_canceled", *factors))  # several passes, over narrow rows
    cells = cut_lineage(contingency(df, factors, "is_canceled", ["hotel"]))
    mw = mann_whitney(df, "lead_time", "is_canceled", ["hotel"], p_value=p_value).select(
        "hotel", F.lit("lead_time").alias("variable"), F.lit("mann_whitney").alias("test"),
        F.col("u_stat").alias("statistic"), F.col("rank_biserial").alias("effect"), *(["p_value"] if p_value else []))
    chi = _independence(cells, ["hotel"], p_value)
    out = mw.unionByName(chi.select(
        "hotel", "variable", F.lit("chi_square").alias("test"), F.col("chi2").alias("statistic"),
        F.col("cramers_v").alias("effect"), *(["p_value"] if p_value else [])))
    if not logits:
        return out
    return out.unionByName(factor_logits(cells, ["hotel"], p_value))


def odds_ratio_logit(df: DataFrame, numeric: list[str], categorical: dict[str, list[str]],
                     target: str = "is_canceled", by: list[str] = ()) -> DataFrame:
    """Logistic regression, per group if wanted, with odds ratios, Wald intervals, LR chi-square and pseudo R2.

    ``categorical`` gives each factor's levels with the baseline first (see ``logit_terms``).
    """
    return logit_terms(df, numeric, categorical, target, by)
