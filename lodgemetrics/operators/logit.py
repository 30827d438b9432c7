"""Logistic regressions of many groups at once: Newton steps as one aggregate over weighted covariate rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgemetrics.functions.distribution import join_groups
from lodgemetrics.functions.exprs import ratio
from lodgemetrics.functions.special import chi2_sf, normal_two_sided
from lodgemetrics.session import cut_lineage

_LIST = T.ArrayType(T.DoubleType())
_STEP = T.StructType([T.StructField("beta", _LIST), T.StructField("dev", T.DoubleType()),
                      T.StructField("change", T.DoubleType()), T.StructField("variance", _LIST)])


@F.pandas_udf(_STEP)
def _newton(score: pd.Series, info: pd.Series, beta: pd.Series, dev: pd.Series, before: pd.Series, before_dev: pd.Series
            ) -> pd.DataFrame:
    """The next coefficients of each group, solved inside its row. A step that made the deviance worse is halved; terms
    without information (constant 0 in the group, or told by others) keep 0 and get no variance."""
    out = []
    for s, i, b, d, b0, d0 in zip(score, info, beta, dev, before, before_dev):
        k = len(b)
        b, s = np.array(b, float), np.array(s, float)[:k]
        if not np.isnan(d0) and d > d0 + 1e-9 * (abs(d0) + 1):
            out.append((((b + np.array(b0, float)) / 2).tolist(), float(d0), np.inf, [None] * k))
            continue
        full = len(i)
        size = int((np.sqrt(8 * full + 1) - 1) / 2)
        m = np.zeros((size, size))
        m[np.triu_indices(size)] = i
        m = np.where(np.arange(size)[:, None] > np.arange(size), m.T, m)[:k, :k]
        used: list[int] = []
        for j in range(k):  # terms that add information to those before them
            if m[j, j] > 0:
                rest = m[j, j]
                if used:
                    rest -= m[j, used] @ np.linalg.solve(m[np.ix_(used, used)], m[used, j])
                if rest > 1e-9 * m[j, j]:
                    used.append(j)
        step, variance = np.zeros(k), [None] * k
        if used:
            inverse = np.linalg.inv(m[np.ix_(used, used)])
            step[used] = inverse @ s[used]
            for j, v in zip(used, np.diag(inverse)):
                variance[j] = float(v)
        out.append(((b + step).tolist(), float(d), float(np.max(np.abs(step), initial=0.0)), variance))
    return pd.DataFrame(out, columns=["beta", "dev", "change", "variance"])


def fit_logits(rows: DataFrame, by: list[str], steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """``by, coef, variance, deviance, null_deviance, n``: a logit for each group of ``rows`` (by, x, y, w).

    x is an array of terms with the constant first, of one length in a group; y is 0 or 1; w counts rows. Groups may be
    of any number and size: a step sums each group's score and information in one aggregate, combined before the
    shuffle. A term that the group's rows do not identify has coefficient 0 and variance null. NULL is a group.
    """
    by = list(by)
    key = by or ["_one"]
    rows = cut_lineage(rows.select(*([F.col(c) for c in by] or [F.lit(1).alias("_one")]), "x", "y", "w"))
    widest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    y, w = F.col("y").cast("double"), F.col("w").cast("double")

    def likelihood(p: Column) -> Column:
        return -2.0 * F.sum(w * F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))

    start = rows.groupBy(*key).agg(F.max(F.size("x")).alias("k"), F.sum(w).alias("n"), F.sum(w * y).alias("n1"))
    share = F.col("n1") / F.col("n")
    part = -2.0 * (F.when(F.col("n1") > 0, F.col("n1") * F.log(share)).otherwise(0.0)
                   + F.when(F.col("n1") < F.col("n"), (F.col("n") - F.col("n1")) * F.log(1 - share)).otherwise(0.0))
    zeros = F.array_repeat(F.lit(0.0), F.col("k"))
    state = cut_lineage(start.select(
        *key, "n", part.alias("null_deviance"), zeros.alias("beta"), F.lit(float("nan")).alias("dev"),
        zeros.alias("before"), F.lit(float("nan")).alias("before_dev"), F.transform(zeros, lambda _: F.lit(None).cast("double"))
        .alias("variance"), F.lit(float("inf")).alias("change")))
    for _ in range(steps):
        with_beta = join_groups(rows, state.select(*key, "beta"), key, [])
        eta = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta))))
        with_beta = with_beta.withColumn("p", p)
        at = [F.get(F.col("x"), F.lit(i)) for i in range(widest)]
        score = [F.coalesce(F.sum(w * (y - F.col("p")) * a), F.lit(0.0)) for a in at]
        info = [F.coalesce(F.sum(w * F.col("p") * (1 - F.col("p")) * at[i] * at[j]), F.lit(0.0))
                for i in range(widest) for j in range(i, widest)]
        sums = with_beta.groupBy(*key).agg(F.array(*score).alias("score"), F.array(*info).alias("info"),
                                           likelihood(F.col("p")).alias("now"))
        known = state.withColumnsRenamed({"dev": "_dev", "before": "_before", "before_dev": "_before_dev"})
        joined = join_groups(known, sums, key, [])
        moved = joined.withColumn("s", _newton("score", "info", "beta", "now", "_before", "_before_dev"))
        worse = F.col("s.change") == float("inf")
        state = cut_lineage(moved.select(
            *key, "n", "null_deviance", F.col("s.beta").alias("beta"), F.col("now").alias("dev"),
            F.when(worse, F.col("_before")).otherwise(F.col("beta")).alias("before"), F.col("s.dev").alias("before_dev"),
            F.col("s.variance").alias("variance"), F.col("s.change").alias("change")))
        if not (state.agg(F.max("change")).first()[0] or 0.0) > tolerance:
            break
    return state.select(*by, F.col("beta").alias("coef"), "variance", F.col("dev").alias("deviance"), "null_deviance", "n")


def logit_terms(df: DataFrame, numeric: list[str], categorical: dict[str, list[str]], target: str, by: list[str] = ()) -> DataFrame:
    """Odds ratios of a logit per group: one row for each term, the constant last.

    ``categorical`` gives each factor's levels, the baseline first; other levels and NULL count as the baseline. Rows
    with a NULL in a numeric covariate or the target are left out. Rows collapse to distinct covariates with a weight,
    which leaves the likelihood unchanged. A term its group does not identify is NULL.
    """
    by = list(by)
    dummies = {f"{c}={level}": F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0))
               for c, levels in categorical.items() for level in levels[1:]}
    names = ["(intercept)", *numeric, *dummies]
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in numeric], *dummies.values())
    rows = df.na.drop(subset=[*numeric, target]).select(*by, x.alias("x"), F.col(target).cast("int").alias("y"))
    fitted = fit_logits(rows.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w")), by)
    used = F.size(F.filter("variance", lambda v: v.isNotNull())) - 1
    fitted = fitted.withColumns({"lr_chi2": F.col("null_deviance") - F.col("deviance"), "lr_df": used,
                                 "pseudo_r2": 1 - ratio("deviance", "null_deviance")})
    order = [*range(1, len(names)), 0]
    terms = F.explode(F.array(*[F.struct(F.lit(names[i]).alias("term"), F.col("coef")[i].alias("coef"),
                                         F.sqrt(F.col("variance")[i]).alias("std_err")) for i in order])).alias("t")
    long = fitted.select(*by, terms, "lr_chi2", "lr_df", "pseudo_r2").select(*by, "t.*", "lr_chi2", "lr_df", "pseudo_r2")
    known = F.col("std_err").isNotNull()
    long = long.withColumn("coef", F.when(known, F.col("coef"))).withColumn("z", ratio("coef", "std_err"))
    return long.select(
        *by, "term", "coef", "std_err", "z", normal_two_sided("z").alias("p_value"), "lr_chi2", "lr_df", "pseudo_r2",
        F.exp("coef").alias("odds_ratio"), F.exp(F.col("coef") - 1.96 * F.col("std_err")).alias("or_ci_low"),
        F.exp(F.col("coef") + 1.96 * F.col("std_err")).alias("or_ci_high"))


def factor_logits(cells: DataFrame, by: list[str], p_value: bool = True) -> DataFrame:
    """``by, variable, test, statistic, effect``: a logit of each factor of ``cells`` (by, variable, x, y, o) in each group.

    The statistic is the likelihood ratio against the constant alone, the effect McFadden's pseudo R2.
    """
    key = [*by, "variable"]
    levels = cells.groupBy(*key).agg(F.array_sort(F.collect_set("x")).alias("levels"))  # as many as the factor has
    rows = join_groups(cells, levels, key, [])
    x = F.transform("levels", lambda v, i: F.when((i == 0) | (v == F.col("x")), 1.0).otherwise(0.0))
    fitted = fit_logits(rows.select(*key, x.alias("x"), F.col("y").cast("int").alias("y"), F.col("o").alias("w")), key)
    df = F.size(F.filter("variance", lambda v: v.isNotNull())) - 1
    fitted = fitted.withColumn("statistic", F.greatest(F.col("null_deviance") - F.col("deviance"), F.lit(0.0)))
    return fitted.select(*key, F.lit("logit").alias("test"), "statistic",
                         ratio("statistic", "null_deviance").alias("effect"),
                         *([chi2_sf("statistic", df.cast("double")).alias("p_value")] if p_value else []))
