"""Paired bootstrap of AUC differences on exact scores, and the settings of the registered model queries."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodgemetrics.operators import models, policy
from lodgemetrics.plans import policy_queries


def auc(s, y, w):
    p, q = (y == 1), (y == 0)
    won = (s[p][:, None] > s[q]) + 0.5 * (s[p][:, None] == s[q])
    return (w[p] @ won @ w[q]) / (w[p].sum() * w[q].sum())


def test_bootstrap_uses_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(policy, "_CHUNK", 37)
    rng = random.Random(6)
    rows = [(rng.choice([0.5, 0.5 + rng.random() / 1000]), 0.5 + (y * 0.3 + rng.random()) / 1000, y)
            for y in (rng.randint(0, 1) for _ in range(300))]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "a double, b double, is_canceled int")
    got = policy.bootstrap_delta_auc(df, "a", "b", n_boot=60).first()
    cells = df.groupBy("a", "b", "is_canceled").count().withColumn("cell", F.xxhash64(F.lit(42), "a", "b", "is_canceled")).toPandas()
    w = policy._poisson_weights(cells["cell"].to_numpy(), cells["count"].to_numpy(), 60)
    assert abs(w.sum() / (60 * len(rows)) - 1) < 0.03 and abs(w[cells["count"] == 1].var() - 1) < 0.05
    a, b, y = (cells[c].to_numpy() for c in ("a", "b", "is_canceled"))
    want = [auc(b, y, w[:, k]) - auc(a, y, w[:, k]) for k in range(60)]
    assert got["n_boot"] == 60 and abs(got["delta_auc_mean"] - np.mean(want)) < 1e-9
    assert abs(got["ci95_low"] - np.percentile(want, 2.5)) < 1e-9 and abs(got["ci95_high"] - np.percentile(want, 97.5)) < 1e-9


def test_registered_fits_take_the_operators_defaults(monkeypatch):
    asked = []
    monkeypatch.setattr(policy_queries, "_train_test", lambda x: (None, None))
    monkeypatch.setattr(policy_queries, "_evaluated", lambda x, fit: fit(None))
    monkeypatch.setattr(policy_queries, "_scored", lambda x: None)
    for module, name in ((models, "fit_rf"), (models, "fit_gbt"), (models, "tune_cv"), (policy, "bootstrap_delta_auc"),
                         (models, "predict"), (models, "calibrate_isotonic"), (policy, "calibration_table"), (models, "feature_importance")):
        monkeypatch.setattr(module, name, lambda *a, _n=name, **k: asked.append((_n, len(a), k)) or [None, None])

    class Names:
        plans = {}

        def add(self, name, plan, *a, **k):
            self.plans[name] = plan

    class X:
        spark = None

    policy_queries.register(Names())
    for name in ("fit_rf", "fit_gbt", "tune_cv", "calibrate_isotonic", "feature_importance", "bootstrap_delta_auc"):
        Names.plans[name](X)
    fits = [x for x in asked if x[0] in ("fit_rf", "fit_gbt", "tune_cv", "bootstrap_delta_auc")]
    assert len(fits) == 6 and all(not k and n == (3 if name == "bootstrap_delta_auc" else 1) for name, n, k in fits)
