import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.catalog import QUERIES
from riskframe.operators import learning, ranking
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(8)
    n = 1200
    signal = rng.normal(size=n)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n), "split": np.where(np.arange(n) < 800, "train", "val_fit"), "signal": signal,
            "noise": rng.normal(size=n), "brand": rng.choice(["visa", "amex"], n),
            "is_fraud": (signal + 0.3 * rng.normal(size=n) > 1).astype(int),
        }
    )
    pdf["delta"] = np.where(rng.random(n) < 0.2, None, signal)
    return spark.createDataFrame(pdf.astype({"delta": "float64"})).withColumn("delta", F.nanvl("delta", F.lit(None).cast("double")))


def test_class_weight_is_negatives_per_positive(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "is_fraud int")
    assert learning.class_weight(df) == 3.0
    with pytest.raises(ValueError, match="both"):
        learning.class_weight(df.where("is_fraud = 0"))


@pytest.mark.parametrize("balanced", [False, True])
def test_probe_finds_planted_signal_and_decomposes(matrix, balanced):
    config = learning.ProbeConfig(["signal", "noise"], ["delta"], ["brand"], balanced=balanced)
    probe = learning.fit_probe(matrix.where("split = 'train'"), config)
    held = matrix.where("split = 'val_fit'")
    row = ranking.ranking_metrics(learning.score_probe(held, probe, ["is_fraud"])).first()
    assert row["roc_auc"] > 0.95
    parts = learning.probe_contributions(held, probe, ["id"])
    total = F.aggregate("contributions", F.col("base"), lambda s, x: s + x)
    assert parts.agg(F.max(F.abs(total - F.col("margin")))).first()[0] < 1e-9


def test_arms_show_what_a_family_is_worth(matrix):
    arms = learning.leave_family_out(["signal", "noise"], {"s": ["signal"], "n": ["noise"]})
    got = {r["arm"]: r["roc_auc"] for r in learning.run_arms(matrix, arms, max_iter=3).collect()}
    assert got["full"] > 0.9 and got["n"] > 0.9 and got["s"] < 0.7
    widths = learning.random_width_arms(["a", "b", "c"], 1, 4, 0)
    assert [len(a.features) for a in widths] == [2] * 4


def test_noise_columns_repeat_for_a_seed(matrix):
    one, names = learning.with_noise(matrix, 2, 5)
    two, _ = learning.with_noise(matrix.repartition(9), 2, 5)
    a = one.select("id", *names).toPandas().set_index("id").sort_index()
    b = two.select("id", *names).toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(a, b)
    assert abs(a.to_numpy().mean()) < 0.1 and abs(a.to_numpy().std() - 1) < 0.1


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    from riskframe.operators import calibration, features
    from riskframe.operators.horizon import Fitted, transform
    from riskframe.sources.artifacts import Served

    rng = np.random.default_rng(21)
    rows = [(i, 86_400 * (1 + i // 40) + 60 * i, float(np.round(rng.lognormal(3, 1), 2)), "ab"[i % 2]) for i in range(1200)]
    raw = spark.createDataFrame(rows, "id long, dt long, amount double, product string")
    fitted = Fitted(
        features.fit_frequencies(raw, ["product"]), features.fit_amount_stats(raw, ["product"], 5.0),
        features.fit_categories(raw, ["product"], 5), ["product"], ["product"], ["product"],
    )
    matrix = transform(raw, fitted).withColumn("is_fraud", (F.col("amount") > 30).cast("int"))
    probe = learning.fit_probe(matrix, learning.ProbeConfig(["amount", "freq_product"], categorical=["product"], max_iter=20))
    scored = learning.score_probe(matrix, probe, ["id", "is_fraud"])
    return raw, matrix.drop("is_fraud"), Served(fitted, probe, calibration.Isotonic.fit(scored)), calibration.Platt.fit(scored)


COLUMNS = ["id", "amount", "freq_product", "product"]


@pytest.mark.parametrize("kind", ["isotonic", "platt"])
def test_served_models_read_back_score_alike(spark, tmp_path, served, kind):
    from dataclasses import replace

    from riskframe.operators.horizon import build_horizon
    from riskframe.sources import artifacts

    raw, matrix, model, platt = served
    model = model if kind == "isotonic" else replace(model, calibrator=platt)
    path = str(tmp_path / "model")
    artifacts.save_served(model, path)
    loaded = artifacts.load_served(spark, path)
    record = model.score(matrix, ["id"])
    score = lambda m: loaded.score(m, ["id"])
    later = raw.withColumn("id", F.col("id") + 5000)
    out = build_horizon(later, raw, matrix, loaded.fitted, COLUMNS, score, record, artifacts.check_scores)
    assert out.count() == 1200
    moved = record.withColumn("calibrated", F.when(F.col("id") == 7, F.col("calibrated") + 1e-12).otherwise(F.col("calibrated")))
    for wrong in (moved, record.where("id <> 9")):
        with pytest.raises(ValueError, match="differ from those on record"):
            build_horizon(later, raw, matrix, loaded.fitted, COLUMNS, score, wrong, artifacts.check_scores)


def test_damaged_models_are_refused(spark, tmp_path, served):
    from riskframe.sources import artifacts

    path = str(tmp_path / "model")
    artifacts.save_served(served[2], path)
    spark.read.parquet(f"{path}/frequencies").limit(1).write.mode("append").parquet(f"{path}/frequencies")
    with pytest.raises(ValueError, match="stamp"):
        artifacts.load_served(spark, path)


def test_arms_overlap_and_release_their_matrix(spark):
    import threading
    import time as clock

    seen, lock = [], threading.Lock()

    def job(i):
        def run():
            began = clock.time()
            spark.range(4).repartition(4).foreachPartition(lambda _: clock.sleep(0.5))
            with lock:
                seen.append((began, clock.time()))
            return i

        return run

    assert learning.concurrently([job(i) for i in range(4)], spark, 4) == [0, 1, 2, 3]
    assert max(a for a, _ in seen) < min(b for _, b in seen)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.random(400), "z": rng.random(400), "split": ["train"] * 300 + ["val_fit"] * 100})
    pdf["is_fraud"] = (pdf.x > 0.6).astype(int)
    df = spark.createDataFrame(pdf)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    arms = [learning.Arm("both", ("x", "z")), learning.Arm("noise", ("z",))]
    got = {r["arm"]: r["roc_auc"] for r in learning.run_arms(df, arms, max_iter=2).collect()}
    assert got["both"] > 0.95 > got["noise"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_arms_of_other_rows_are_not_compared(spark):
    rows = [(i, 1 + i % 4, int(i % 5 == 0), 10.0, 0.1 + 0.2 * (i % 5 == 0) + i % 7 / 50 + (i % 11 == 0) / 4) for i in range(80)]
    one = spark.createDataFrame(rows, "id long, day int, is_fraud int, amount double, score double")
    from riskframe.config import Costs

    with pytest.raises(Exception, match="values to resample are missing"):
        learning.compare_arms({"a": one, "b": one.where("id <> 3")}, "a", Costs(), 0.1, resamples=20, folds=4).collect()
    got = {r["arm"]: r for r in learning.compare_arms({"a": one, "b": one}, "a", Costs(), 0.1, resamples=20, folds=4).collect()}
    assert got["b"]["delta_usd"] == 0 and got["b"]["low"] == got["b"]["high"] == 0 and got["a"]["low"] is None


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["linear_probe", "neutralised_arm", "noise_floor", "horizon_scores"])
def test_fits_read_rows_that_are_derived_once(spark, monkeypatch, name):
    """A fit reads its rows many times: they come from files, not from the raw events."""
    read = []

    def fit(train, config):
        read.extend(train.inputFiles())
        raise Stop

    monkeypatch.setattr(learning, "fit_probe", fit)
    monkeypatch.setattr(learning, "noise_floor", lambda train, held, *rest: fit(train, None))
    with pytest.raises(Stop):
        QUERIES[name](spark, SMALL).collect()
    assert read and not any("events.parquet" in f for f in read)
