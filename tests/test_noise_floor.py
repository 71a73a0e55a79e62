from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from riskframe.operators import learning


def test_seeds_are_ranked_in_one_job_as_each_alone(spark, monkeypatch):
    value = F.when(F.col("id") % 17 != 0, (F.xxhash64("id") % 100).cast("int"))
    label = (F.coalesce(value, F.lit(0)) + F.xxhash64("id", F.lit(1)) % 40 > 10).cast("int")
    rows = spark.range(600).select("id", value.alias("x"), label.alias("is_fraud"))
    train, held = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")
    config = learning.ProbeConfig(["x"], max_iter=20)
    alone = {}
    for seed in (3, 8):
        (one, names), (two, _) = (learning.with_noise(df, 2, seed) for df in (train, held))
        wider = replace(config, numeric=["x", *names])
        alone[seed] = learning.probe_metric(one, two, wider).first()["pr_auc"]
    base = learning.probe_metric(train, held, config).first()["pr_auc"]

    ranked, ranking = [], learning.ranking_metrics
    monkeypatch.setattr(learning, "ranking_metrics", lambda *args: ranked.append(1) or ranking(*args))
    got = {r["seed"]: r for r in learning.noise_floor(train, held, config, (3, 8), 2).collect()}
    assert len(ranked) == 1 and set(got) == {3, 8}
    for seed, pr_auc in alone.items():
        assert got[seed]["pr_auc"] == pytest.approx(pr_auc, abs=1e-6) and got[seed]["width"] == 2
        assert got[seed]["delta"] == pytest.approx(pr_auc - base, abs=1e-6)
