import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import bootstrap, calibration
from riskframe.operators.splits import assign_folds
from riskframe.plans import monotone
from tests.test_decisions import ap_auc


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    n = 4000
    z = rng.normal(-2, 1.5, n)
    s = 1 / (1 + np.exp(-z))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.7 * z + 0.4)))).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "day": np.arange(n) % 8 + 141, "is_fraud": y, "score": s, "amount": 50.0})
    return pdf, spark.createDataFrame(pdf)


def newton(z, y):
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p)
        g = np.array([((p - y) * z).sum(), (p - y).sum()])
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return a, b


def test_platt_reaches_the_maximum_likelihood_fit(sample):
    pdf, df = sample
    s = pdf.score.to_numpy()
    assert calibration.fit_platt(df) == pytest.approx(newton(np.log(s / (1 - s)), pdf.is_fraud.to_numpy()), rel=1e-8)


def test_platt_refuses_a_reversed_ranking(sample):
    _, df = sample
    with pytest.raises(ValueError, match="reverse"):
        calibration.fit_platt(df.withColumn("is_fraud", 1 - F.col("is_fraud")))


def pav(x, y):
    ux = np.unique(x)
    blocks = [[y[x == v].mean(), (x == v).sum(), [v]] for v in ux]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0]:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            i = max(i - 1, 0)
        else:
            i += 1
    return {v: m for m, _, vs in blocks for v in vs}


def test_isotonic_matches_pool_adjacent_violators(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random(300), 2)
    y = (rng.random(300) < x).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": x, "is_fraud": y}))
    table = calibration.fit_isotonic(df)
    got = calibration.apply_isotonic(df, "score", table, "p").toPandas()
    want = pav(x, y)
    np.testing.assert_allclose(got.p, [want[v] for v in got.score], atol=1e-9)


def test_isotonic_is_flat_outside(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,)], "score double")
    got = [r["p"] for r in calibration.apply_isotonic(df, "score", ([0.2, 0.6], [0.1, 0.5]), "p").collect()]
    assert got == [0.1, 0.5]


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_own_fold_labels_are_never_used(sample, method):
    _, df = sample
    folded = assign_folds(df, 4)
    before = calibration.cross_fit(folded, method).where("fold = 2").select("id", method).toPandas().set_index("id")
    flipped = folded.withColumn("is_fraud", F.when((F.col("fold") == 2) & (F.col("id") % 5 == 0), 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    after = calibration.cross_fit(flipped, method).where("fold = 2").select("id", method).toPandas().set_index("id")
    np.testing.assert_allclose(before[method], after.loc[before.index, method], rtol=1e-9)


def test_folds_are_blocks_of_days(sample, spark):
    _, df = sample
    got = {r["day"]: r["fold"] for r in assign_folds(df, 4).select("day", "fold").distinct().collect()}
    assert got == {141 + i: i // 2 for i in range(8)}
    with pytest.raises(ValueError, match="divide"):
        assign_folds(df, 3)
    with pytest.raises(ValueError, match="contiguous"):
        assign_folds(df.where("day <> 144"), 7)
    with pytest.raises(ValueError, match="two"):
        assign_folds(df, 1)


def test_selection_needs_every_fold(spark):
    platt = spark.createDataFrame([(0, 0.2), (1, 0.2)], "fold int, brier double")
    better = spark.createDataFrame([(0, 0.1), (1, 0.1)], "fold int, brier double")
    mixed = spark.createDataFrame([(0, 0.1), (1, 0.3)], "fold int, brier double")
    assert calibration.select_method(platt, better).first()[0] == "isotonic"
    assert calibration.select_method(platt, mixed).first()[0] == "platt"
    with pytest.raises(Exception, match="different folds"):
        calibration.select_method(platt, better.where("fold = 0")).collect()


def test_clip_must_not_reach_a_score(sample):
    calibration.check_clip(sample[1])
    with pytest.raises(ValueError, match="clip"):
        calibration.check_clip(sample[1], clip=0.4)


# ---- bootstraps ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def costed(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"day": rng.integers(161, 170, n), "a": rng.random(n) * 10, "b": rng.random(n) * 12})
    return pdf, spark.createDataFrame(pdf)


def test_paired_bootstrap_uses_the_generator_of_record(costed):
    pdf, df = costed
    days, index = np.unique(pdf.day, return_inverse=True)
    delta, rows = np.bincount(index, weights=pdf.a - pdf.b), np.bincount(index)
    draws = np.random.default_rng(0).integers(0, len(days), size=(300, len(days)))
    want = np.quantile(delta[draws].sum(1) / rows[draws].sum(1) * 1000, [0.025, 0.975])
    got = bootstrap.paired_day_bootstrap(df, "a", "b", 300).first()
    np.testing.assert_allclose([got["low"], got["high"]], want, rtol=1e-9)


def test_reduction_interval(costed):
    pdf, df = costed
    days, index = np.unique(pdf.day, return_inverse=True)
    p, r = np.bincount(index, weights=pdf.a), np.bincount(index, weights=pdf.b)
    draws = np.random.default_rng(1).integers(0, len(days), size=(300, len(days)))
    want = np.quantile(1 - p[draws].sum(1) / r[draws].sum(1), [0.025, 0.975])
    got = bootstrap.reduction_interval(df, "a", "b", 300, seed=1).first()
    np.testing.assert_allclose([got["low"], got["high"]], want, rtol=1e-9)


def test_metric_bootstrap_equals_resampled_rows(spark, bucket_rows):
    rng = np.random.default_rng(9)
    n = 500
    pdf = pd.DataFrame({"day": rng.integers(0, 10, n), "is_fraud": (rng.random(n) < 0.3).astype(int)})
    pdf["score"] = np.round(rng.random(n) + 0.4 * pdf.is_fraud, 1)
    pdf["window"] = pdf.day // 5
    got = bootstrap.metric_bootstrap(spark.createDataFrame(pdf), 40).toPandas().set_index("window")
    for w, part in pdf.groupby("window"):
        days, index = np.unique(part.day, return_inverse=True)
        rows = [np.flatnonzero(index == i) for i in range(len(days))]
        draws = np.random.default_rng(0).integers(0, len(days), size=(40, len(days)))
        values = []
        for draw in draws:
            taken = np.concatenate([rows[i] for i in draw])
            values.append(ap_auc(part.is_fraud.to_numpy()[taken], part.score.to_numpy()[taken]))
        want = np.quantile(np.array(values), [0.025, 0.975], axis=0)
        np.testing.assert_allclose(
            got.loc[w, ["pr_auc_low", "roc_auc_low", "pr_auc_high", "roc_auc_high"]].to_numpy(dtype=float), want.ravel(), rtol=1e-9
        )


def pooled(x, p, w):
    """Pool adjacent violators, one by one."""
    blocks = []
    for a, s, t in sorted(zip(x, p, w)):
        blocks.append([a, a, s, t])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [tuple(map(float, b)) for b in blocks]


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "late", "one"])
@pytest.mark.parametrize("rows", [100_000, 40])
def test_monotone_blocks_equal_pooling_one_by_one(spark, monkeypatch, shape, rows):
    monkeypatch.setattr(monotone, "ROWS_PER_RANGE", rows)
    rng = np.random.default_rng(9)
    n = 1 if shape == "one" else 700
    x = rng.permutation(n) / 7.0
    w = rng.integers(1, 5, n).astype(float)
    rate = {"noise": 0.3 + 0.4 * x / x.max() if n > 1 else x, "rising": x / 101, "falling": 1 - x / 101, "one": x + 0.5,
            "late": np.where(x > np.quantile(x, 0.9), 0.0, x / 101)}[shape]
    p = np.minimum(w, np.round(rate * w * (3 if shape == "noise" else 1) * rng.random(n), 3)) if shape == "noise" else rate * w
    steps = [(g, float(a), float(b), float(c)) for g in (1, 2) for a, b, c in zip(x, p, w)]
    got = monotone.monotone_blocks(spark.createDataFrame(steps, "fold int, x double, p double, w double"), ["fold"]).collect()
    for g in (1, 2):
        own = sorted((r["lo"], r["hi"], r["p"], r["w"]) for r in got if r["fold"] == g)
        np.testing.assert_allclose(own, pooled(x, p, w), rtol=1e-9)


@pytest.mark.parametrize("rows", [100_000, 30])
def test_blocks_are_looked_up_like_interpolation(spark, monkeypatch, rows):
    monkeypatch.setattr(monotone, "ROWS_PER_RANGE", rows)
    blocks = [(1, float(10 * i), float(10 * i + i % 3), i / 50, 1.0) for i in range(60)] + [(2, 5.0, 6.0, 0.25, 1.0)]
    table = spark.createDataFrame(blocks, "fold int, lo double, hi double, p double, w double")
    scores = [(i, 1 + i % 3, None if i % 50 == 3 else float("nan") if i % 50 == 4 else (i * 37 % 1500) - 400.5 if i % 7 else float(i)) for i in range(600)]
    df = spark.createDataFrame(scores, "id long, fold int, s double")
    got = {r["id"]: r["out"] for r in monotone.apply_blocks(df, "s", table, "out", ["fold"]).collect()}
    assert len(got) == 600
    knots = sorted({(x, b[3]) for b in blocks if b[0] == 1 for x in b[1:3]})
    for i, fold, s in scores:
        if s is None:
            assert got[i] is None
        elif s != s:
            assert got[i] != got[i]
        elif fold == 1:
            assert got[i] == pytest.approx(np.interp(s, [k for k, _ in knots], [v for _, v in knots]), abs=1e-12)
        elif fold == 2:
            assert got[i] == 0.25
        else:
            assert got[i] is None or got[i] != got[i]


def test_fits_of_many_scores_leave_the_plan_small(spark, monkeypatch):
    monkeypatch.setattr(monotone, "ROWS_PER_RANGE", 20_000)
    rows = spark.range(60_000).selectExpr("id", "id / 60000 AS score", "CAST(xxhash64(id) % 1000 < id / 60 AS INT) AS is_fraud")
    fit = calibration.fit_isotonic(rows)
    done = calibration.apply_isotonic(rows, "score", fit, "p")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    curve = done.orderBy("score").select("p").toPandas()["p"].to_numpy()
    assert len(curve) == 60_000 and (np.diff(curve) >= -1e-12).all() and curve[-1] - curve[0] > 0.5
