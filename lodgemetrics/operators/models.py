"""Cancellation and rate models: histogram forests and boosted trees, and the rate model and isotonic steps of Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.distribution import percentiles_by
from lodgemetrics.functions.exprs import ratio
from lodgemetrics.operators.boosting import BoostedModel, fit_boosted
from lodgemetrics.operators.policy import roc_auc
from lodgemetrics.operators.trees import ForestModel, fit_forest
from lodgemetrics.schema import LEAKAGE_COLUMNS, SCORE_CATEGORICAL, SCORE_NUMERIC
from lodgemetrics.session import cut_lineage

LABEL = "is_canceled"


def booking_features(df: DataFrame, keep: list[str] = ("booking_key",)) -> DataFrame:
    """Features known when the booking is made; columns known only afterwards are not passed on."""
    leaked = [c for c in keep if c in LEAKAGE_COLUMNS]
    if leaked:
        raise ValueError(f"columns known only after the outcome: {leaked}")
    children = F.coalesce(F.col("children").cast("int"), F.lit(0))
    prior = F.col("previous_cancellations") + F.col("previous_bookings_not_canceled")
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    month = F.coalesce("arrival_month_number", F.lit(0))
    guests = F.greatest(F.col("adults") + children + F.col("babies"), F.lit(1))
    made = {
        "total_guests": guests, "price_per_person": F.col("adr") / guests,
        "is_family": ((children > 0) | (F.col("babies") > 0)).cast("int"), "total_nights": nights,
        "lead_time_per_night": F.col("lead_time") / F.greatest(nights, F.lit(1)),
        "history_cancel_rate": F.coalesce(ratio("previous_cancellations", prior), F.lit(0.0)),
        "is_weekend_only": ((F.col("stays_in_weekend_nights") > 0) & (F.col("stays_in_week_nights") == 0)).cast("int"),
        "arrival_month_mapped": month, "arrival_season": bands.season(month, "calendar"),
        "country": F.coalesce("country", F.lit("Unknown")),
    }
    full = df.withColumns(made)
    return full.select(*keep, *SCORE_CATEGORICAL, *[F.col(c).cast("double").alias(c) for c in SCORE_NUMERIC], LABEL)


def stratified_split(df: DataFrame, seed: int = 42, test: float = 0.2, label: str = LABEL,
                     key: list[str] = ("booking_key",)) -> DataFrame:
    """Add is_test: in each class, the rows with the smallest key hashes up to the test share.

    The cut is an exact percentile of the hash per class, so no class is sorted in one task. It is found in two narrow
    readings of ``df`` and kept, so that later readings of the split only compare with it.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / float(2 ** 53)
    hashed = df.withColumn("_h", h)
    cut = cut_lineage(percentiles_by(hashed, [label], "_h", {"_cut": test}, width=1e-4))
    return (hashed.join(F.broadcast(cut), label)
            .withColumn("is_test", (F.col("_h") <= F.col("_cut")).cast("int")).drop("_h", "_cut"))


def fit_rf(train: DataFrame, trees: int = 200, depth: int = 12, least: int = 20, seed: int = 42,
           like: ForestModel | None = None) -> ForestModel:
    """Histogram forest with balanced classes, grown level by level (see ``trees``); ``like``: a model of the same rows."""
    return fit_forest(train, SCORE_CATEGORICAL, SCORE_NUMERIC, LABEL, trees, depth, least, seed, like=like)


def fit_gbt(train: DataFrame, rounds: int = 100, depth: int = 6, step: float = 0.06, seed: int = 42) -> BoostedModel:
    """Boosted histogram trees with balanced classes, each on 0.8 of the rows, grown level by level (see ``boosting``)."""
    return fit_boosted(train, SCORE_CATEGORICAL, SCORE_NUMERIC, LABEL, rounds, depth, step, 0.8, seed)


def tune_cv(train: DataFrame, trees: list[int] = (50, 100), depths: list[int] = (6, 10), folds: int = 5, seed: int = 42,
            key: list[str] | None = None) -> tuple[ForestModel, DataFrame]:
    """Grid search on ROC AUC over hash folds; returns the best model and the mean score of every setting.

    The forests of all folds grow in shared passes, and a setting with fewer trees or levels is read off the largest
    forest of its fold: what it would grow on its own is the same. ``key`` tells rows apart (all columns by default).
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), *(key or train.columns)), F.lit(folds)).cast("int")
    grid = [(t, d) for t in trees for d in depths]
    cv = fit_forest(train, SCORE_CATEGORICAL, SCORE_NUMERIC, LABEL, max(trees), max(depths), seed=seed, folds=folds, fold=fold)
    names = [f"_s{i}" for i in range(len(grid))]
    scored = cv.counted(train, LABEL, names, grid, "n")
    long = scored.select(LABEL, "n", "fold", F.explode(F.array(*[
        F.struct(F.lit(t).alias("trees"), F.lit(d).alias("depth"), F.col(n).alias("p")) for n, (t, d) in zip(names, grid)]))
        .alias("s")).select(LABEL, "n", "fold", "s.*")
    table = cut_lineage(roc_auc(long, by=["trees", "depth", "fold"], weight="n").groupBy("trees", "depth").agg(
        F.avg("roc_auc").alias("roc_auc")))
    best = table.orderBy(F.desc("roc_auc"), "trees", "depth").first()
    return fit_rf(train, best["trees"], best["depth"], seed=seed, like=cv), table


def predict(model: ForestModel | BoostedModel, df: DataFrame, name: str = "p", weight: str | None = None) -> DataFrame:
    """Add the cancellation probability. With ``weight``, rows that the model cannot tell apart are scored once: a row says
    how many there are (``weight``), how many of them were canceled (the label) and their probability; rows with a null
    label are left out."""
    if not weight:
        return model.transform(df, name)
    if isinstance(model, BoostedModel):
        return model.counted(df, LABEL, name, weight)
    return model.counted(df, LABEL, [name], [(model.forest.trees, model.settings.depth)], weight).drop("fold")


def calibrate_isotonic(train: DataFrame, df: DataFrame, score: str = "p", name: str = "p_cal", digits: int = 3,
                       weight: str | None = None) -> DataFrame:
    """Fit isotonic calibration on ``train`` and apply it to ``df``.

    Training scores collapse to weighted bins of 10^-digits, so the monotone fit sees a bounded
    number of points at any data size. With ``weight``, a training row stands for so many, and its label says how many were
    canceled.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    rate = F.sum(LABEL) / n if weight else F.avg(F.col(LABEL).cast("double"))
    bins = train.groupBy(F.round(score, digits).alias("feature")).agg(rate.alias("label"), n.cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight",
                               predictionCol=name).fit(cut_lineage(bins))
    return model.transform(df.withColumn("feature", F.col(score))).drop("feature")


def feature_importance(model: ForestModel | BoostedModel, spark) -> DataFrame:
    """Share of each source column in the splits' gain."""
    return spark.createDataFrame(list(model.importance().items()), "variable string, importance double").orderBy(F.desc("importance"))


# --- rate model on the monthly panel

# The covariates of the rate model, and how a rolling mean is blended towards the forecast.
ROLL_WEIGHT, FORECAST_WEIGHT = 0.4, 0.6
RATE_FEATURES = [
    "hotel_code", "month_number", "demand_lag1", "adr_lag1", "revpar_lag1", "occ_lag1", "lead_mean_lag1",
    "demand_lag12", "adr_lag12", "revpar_lag12", "adr_roll3", "demand_roll3", "share_online_ta", "share_groups",
    "share_transient", "special_req", "los_mean",
]


def _vector() -> VectorAssembler:
    return VectorAssembler(inputCols=RATE_FEATURES, outputCol="features")


def _stance_code() -> Column:
    return (F.when(F.col("stance_hist") == "NEUTRAL", 0.0).when(F.col("stance_hist") == "PROTECT", 1.0)
            .otherwise(2.0).alias("stance_code"))


STANCES = ["NEUTRAL", "PROTECT", "STIMULATE"]


def rate_training_rows(features: DataFrame) -> DataFrame:
    rows = features.na.drop(subset=[*RATE_FEATURES, "adr_next", "stance_hist"])
    lift = (F.col("adr") / F.col("adr_lag12") - 1.0) * 100
    return rows.withColumn("stance_code", _stance_code()).withColumn("pct_vs_lag12", lift)


def _learners(seed: int = 42):
    def regressor(label: str) -> GBTRegressor:
        return GBTRegressor(labelCol=label, featuresCol="features", maxDepth=3, maxIter=40, stepSize=0.08, seed=seed)
    classifier = RandomForestClassifier(labelCol="stance_code", featuresCol="features", maxDepth=3, numTrees=60, seed=seed)
    return regressor, classifier


def rate_model_cv(features: DataFrame, folds: int = 3) -> DataFrame:
    """Expanding-window validation by month: MAPE and R2 of next ADR, accuracy of the stance."""
    rows = cut_lineage(_vector().transform(rate_training_rows(features)))
    months = F.dense_rank().over(_month_window())
    total = F.max("_m").over(_all_rows())
    cut = F.floor((F.col("_m") - 1) * (folds + 1) / F.col("_t"))
    marked = cut_lineage(rows.withColumn("_m", months).withColumn("_t", total).withColumn("_fold", cut))
    regressor, classifier = _learners()
    out = []
    for fold in range(1, folds + 1):
        train, test = marked.where(F.col("_fold") < fold), marked.where(F.col("_fold") == fold)
        scored = regressor("adr_next").fit(train).transform(test).withColumnRenamed("prediction", "adr_hat")
        scored = scored.drop("probability", "rawPrediction")
        scored = classifier.fit(train).transform(scored)
        err = F.col("adr_next") - F.col("adr_hat")
        out.append(scored.agg(
            F.lit(fold).alias("fold"), F.avg(F.abs(err / F.col("adr_next"))).alias("mape"),
            (1 - ratio(F.sum(err * err), F.var_pop("adr_next") * F.count(F.lit(1)))).alias("r2"),
            F.avg((F.col("prediction") == F.col("stance_code")).cast("double")).alias("stance_accuracy")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _month_window():
    from pyspark.sql import Window as W
    return W.partitionBy(F.lit(1)).orderBy("year_month")


def _all_rows():
    from pyspark.sql import Window as W
    return W.partitionBy(F.lit(1))


def rate_model(features: DataFrame, bundle: DataFrame) -> DataFrame:
    """Model rate for each forecast month: median of next-ADR model, lift model and forecast.

    The state of a future month is the latest history row of the same month of year, else the
    latest row, with rolling means blended towards the forecast.
    """
    train = cut_lineage(_vector().transform(rate_training_rows(features)))
    regressor, classifier = _learners()
    next_adr, lift = regressor("adr_next").fit(train), regressor("pct_vs_lag12").fit(train)
    stance = classifier.fit(train)
    state_cols = [c for c in RATE_FEATURES if c != "month_number"]
    state = F.struct(*state_cols)
    same = features.groupBy("hotel", "month_number").agg(F.max_by(state, "year_month").alias("_same"))
    last = features.groupBy("hotel").agg(F.max_by(state, "year_month").alias("_last"))
    rows = bundle.join(same, ["hotel", "month_number"], "left").join(last, "hotel", "left")
    rows = rows.withColumn("_s", F.coalesce("_same", "_last")).drop("_same", "_last")
    rows = rows.select("*", *[F.col(f"_s.{c}").alias(c) for c in state_cols]).drop("_s")
    for c, fc in (("demand_roll3", "fc_demand"), ("adr_roll3", "fc_adr")):
        rows = rows.withColumn(c, F.coalesce(ROLL_WEIGHT * F.col(c) + FORECAST_WEIGHT * F.col(fc), F.col(fc)))
    rows = rows.na.fill(0.0, subset=state_cols)
    scored = _vector().transform(rows)
    scored = next_adr.transform(scored).withColumnRenamed("prediction", "ml_adr_raw")
    scored = lift.transform(scored).withColumnRenamed("prediction", "ml_pct_vs_season")
    scored = stance.transform(scored)
    names = F.array(*[F.lit(s) for s in STANCES])
    scored = scored.withColumn("ml_adr_adj", F.col("fc_adr") * (1 + F.col("ml_pct_vs_season") / 100))
    middle = F.array_sort(F.array("ml_adr_raw", "ml_adr_adj", "fc_adr"))[1]
    return scored.select(
        *bundle.columns, "ml_adr_raw", "ml_adr_adj", "ml_pct_vs_season", middle.alias("ml_adr"),
        names[F.col("prediction").cast("int")].alias("ml_stance"))
