import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.config import BASE_VALUE, MISSING, OTHER, Costs, MonitoringConfig, RulesConfig, SplitBounds
from riskframe.operators import decay, drift, explain, profile, rules

CONFIG = MonitoringConfig()
PUBLISHED = SplitBounds(1, 30, 121, 141, 161, 182)


def test_windows_cover_the_layout(spark):
    df = spark.range(121, 183).withColumnRenamed("id", "day")
    got = drift.describe_windows(df, 5, 121).orderBy("window").collect()
    assert len(got) == 13 and got[-1]["partial"] and got[-1]["days"] == 2
    assert not any(r["partial"] for r in got[:-1])


def test_empty_windows_are_listed(spark):
    df = spark.createDataFrame([(1,), (20,)], "day int")
    got = {r["window"]: r["rows"] for r in drift.describe_windows(df, 5, 1).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 1}


@pytest.mark.parametrize("rows, width", [([(1,)], 0), ([(0,)], 5), ([(None,)], 5)])
def test_window_refusals(spark, rows, width):
    df = spark.createDataFrame(rows, "day int")
    with pytest.raises(Exception, match="wide|anchor|no day"):
        drift.window_index(df, width, 1).collect()


@pytest.mark.parametrize("seed", range(5))
def test_stability_index_matches_numpy(spark, seed, bucket_rows):
    rng = np.random.default_rng(seed)
    ref = np.where(rng.random(600) < 0.3, 0.0, np.round(rng.lognormal(2, 1, 600), 1))
    new = np.round(rng.lognormal(2.3, 1, 400), 1)
    new_missing = rng.random(400) < 0.1
    edges = np.unique(np.sort(ref)[-(-np.arange(1, 10) * len(ref) // 10) - 1])

    def counts(v, missing):
        at = np.searchsorted(edges, v[~missing], side="left")
        return np.append(np.bincount(at, minlength=len(edges) + 1), missing.sum())

    e, a = counts(ref, np.zeros(600, bool)), counts(new, new_missing)
    e, a = e / e.sum() + 1e-6, a / a.sum() + 1e-6
    want = ((a - e) * np.log(a / e)).sum()
    ref_df = spark.createDataFrame(pd.DataFrame({"x": ref}))
    new_df = spark.createDataFrame([(None if m else float(v), 0) for v, m in zip(new, new_missing)], "x double, window int")
    bins = drift.reference_bins(ref_df, ["x"], {}, 10)
    np.testing.assert_array_equal(bins.edges["x"], edges)
    row = drift.column_psi(ref_df, new_df, bins, 1e-6).first()
    assert row["psi"] == pytest.approx(want, rel=1e-9)
    assert row["missing_share"] == pytest.approx(new_missing.mean())


def test_identical_distributions_score_zero(spark):
    df = spark.createDataFrame([("a",), (OTHER,), (MISSING,)], "k string")
    bins = drift.ReferenceBins({}, {"k": ("a", OTHER, MISSING)})
    row = drift.column_psi(df, df.withColumn("window", F.lit(0)), bins, 1e-6).first()
    assert row["psi"] == 0 and row["value_bins"] == 3


def test_unrouted_values_fail(spark):
    bins = drift.ReferenceBins({}, {"k": ("a", OTHER, MISSING)})
    for value in ("b", None):
        df = spark.createDataFrame([(value,)], "k string")
        with pytest.raises(Exception, match="routed"):
            drift.bin_counts(df, bins).collect()


def test_infinite_references_are_refused(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,)], "x double")
    with pytest.raises(ValueError, match="infinite"):
        drift.quantile_edges(df, ["x"], 10)


def test_readings(spark):
    rows = [(0, 0.6, 0.9, 0.5, 0.3), (1, 0.4, 0.95, 0.4, 0.3), (2, 0.4, 0.7, 0.2, 0.1), (3, 0.4, 0.7, 0.45, 0.1)]
    df = spark.createDataFrame(rows, "window int, pr_auc_high double, roc_auc_high double, pr_auc double, stratum_share double")
    got = {r["window"]: (r["reading"], r["beyond_mix"]) for r in decay.read_windows(df, 0.5, 0.8, 0.01, 0.2).collect()}
    assert got == {0: ("no decline", False), 1: ("prevalence", False), 2: ("decline", True), 3: ("decline", False)}


WINDOWS = "horizon string, first_day int, last_day int, partial boolean, weighted_psi double, score_psi double"


def test_trigger_reads_and_fires(spark):
    rows = [
        ("labelled", 156, 160, False, 9.0, None),  # before deployment
        ("labelled", 161, 165, False, 0.05, None),
        ("labelled", 166, 170, True, 0.5, None),  # partial windows never fire
        ("labelled", 171, 175, False, 0.10, None),  # a value on the limit reaches it
        ("horizon", 213, 240, False, 0.3, 0.25),
    ]
    read = decay.trigger_windows(spark.createDataFrame(rows, WINDOWS), PUBLISHED, CONFIG)
    assert read.count() == 4
    fired = {r["name"]: r["fires_on"] for r in decay.firings(read, PUBLISHED, CONFIG).collect()}
    assert fired == {"feature_psi": 175, "score_psi": 240, "pr_auc": None, "cadence": 251}
    first = decay.first_firing(decay.firings(read, PUBLISHED, CONFIG))
    assert first.first()["name"] == "feature_psi"
    layout = decay.retrain_layout(first, PUBLISHED).first().asDict()
    assert layout == {
        "trigger_day": 175, "labelled_through": 145, "training_ends": 75, "val_fit_start": 106, "val_fit_end": 125,
        "val_cal_start": 126, "val_cal_end": 145, "days_stale": 100,
    }
    assert decay.firing_window(first, read).first()["first_day"] == 171


def test_nothing_fires_but_the_cadence(spark):
    rows = [("labelled", 161, 165, False, 0.01, None)]
    read = decay.trigger_windows(spark.createDataFrame(rows, WINDOWS), PUBLISHED, CONFIG)
    row = decay.first_firing(decay.firings(read, PUBLISHED, CONFIG)).first()
    assert (row["condition"], row["fires_on"]) == (4, 251)


def test_straddling_windows_are_refused(spark):
    df = spark.createDataFrame([("labelled", 159, 163, False, 0.0, None)], WINDOWS)
    with pytest.raises(Exception, match="straddles"):
        decay.trigger_windows(df, PUBLISHED, CONFIG).collect()


def test_band_names_must_exist():
    with pytest.raises(ValueError, match="band"):
        MonitoringConfig(feature_band="huge")


# ---- explanations ------------------------------------------------------------------------------

PHRASES = {"TransactionAmt": "the amount is unusual", "freq_card1": "this card has been seen rarely"}
COLUMNS = ["TransactionAmt", "C13", "freq_card1", "C1"]


def coded(spark, values, p=0.9, amount=100.0):
    df = spark.createDataFrame([(*values, p, amount)], ", ".join(f"{c} double" for c in COLUMNS) + ", p double, amount double")
    return explain.reason_codes(df, COLUMNS, PHRASES, Costs()).first()


def test_reasons_are_the_largest_positive_contributors(spark):
    row = coded(spark, (0.2, 1.5, -3.0, 0.7))
    assert [r["feature"] for r in row["reasons"]] == ["C13", "C1", "TransactionAmt"]
    assert row["decision"] == "block" and row["adverse"]
    # two unnamed reasons collapse to one plural line, where the first of them stood
    assert row["statements"] == [explain.GENERIC_MANY, "the amount is unusual"]


def test_one_unnamed_reason_is_singular_and_none_is_empty(spark):
    assert coded(spark, (0.2, 1.5, -3.0, -1.0))["statements"] == [explain.GENERIC_ONE, "the amount is unusual"]
    assert coded(spark, (-1.0, -1.0, -1.0, -1.0))["statements"] == []
    assert coded(spark, (1.0, 0.0, 0.0, 0.0), p=0.01)["decision"] == "allow"


def test_additivity_is_checked(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -1.0)], "a double, b double")
    parts = explain.linear_contributions(df, {"a": 0.5, "b": -1.0}, {"a": 1.0}, 0.25)
    margin = parts.withColumn("m", 0.25 + 0.5 * F.col("a") - F.col("b"))
    assert explain.check_additive(margin, ["c_a", "c_b"], "m") < 1e-12
    with pytest.raises(ValueError, match="miss"):
        explain.check_additive(margin.withColumn("m", F.col("m") + 5), ["c_a", "c_b"], "m")
    moving = margin.withColumn(BASE_VALUE, F.col("a"))
    with pytest.raises(ValueError, match="not constant"):
        explain.check_additive(moving, ["c_a", "c_b"], "m")


def test_samples_repeat_and_have_their_size(spark, bucket_rows):
    df = spark.range(1000)
    first = {r[0] for r in explain.take_sample(df, 100, 3).collect()}
    again = {r[0] for r in explain.take_sample(df.repartition(13), 100, 3).collect()}
    assert first == again and len(first) == 100
    assert explain.take_sample(df, 5000, 3).count() == 1000
    assert first != {r[0] for r in explain.take_sample(df, 100, 4).collect()}


# ---- rules ---------------------------------------------------------------------------------------

CFG = RulesConfig(ecdf_points=11)
BASE = {"amount": 77.0, "product": "W", "d1": 400.0, "m4": "M0"}


def fired(spark, **change):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row.values())], "amount double, product string, d1 double, m4 string")
    constants = rules.RuleConstants({"W": 500.0, "C": 500.0, "H": 500.0}, tuple(50.0 * i for i in range(11)), CFG)
    got = rules.contributions(df, rules.default_rules(CFG), constants).first()
    return {r.name: got[r.name] for r in rules.default_rules(CFG) if got[r.name]}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, {}),
        ({"amount": 150.0}, {"round_amount": 2}),
        ({"amount": 500.0}, {"round_amount": 2}),
        ({"amount": 550.0}, {"amount_percentile": 1}),
        ({"product": "C"}, {"product_tier": 3}),
        ({"product": "unseen", "amount": 9999.0}, {}),
        ({"d1": 0.0}, {}),
        ({"d1": 3.0}, {"new_card": 3}),
        ({"d1": None}, {}),
        ({"m4": "M2"}, {"product_match": 1}),
        ({"m4": "M2", "product": "C"}, {"product_tier": 3}),
        ({"m4": None}, {}),
    ],
)
def test_each_rule_alone(spark, change, want):
    assert fired(spark, **change) == want


def test_rule_score_breaks_ties_by_amount_below_one_point(spark):
    constants = rules.RuleConstants({"W": 500.0}, tuple(50.0 * i for i in range(11)), CFG)
    df = spark.createDataFrame([(77.0, "W", 400.0, "M0"), (9999.0, "X", 400.0, "M0")], "amount double, product string, d1 double, m4 string")
    low, high = [r["rules_score"] for r in rules.score(df, rules.default_rules(CFG), constants).collect()]
    assert low == pytest.approx(0.5 * 2 / 11) and high == pytest.approx(0.5)


def test_rule_constants_survive_json_and_refuse_damage(spark):
    constants = rules.RuleConstants({"W": 1.25}, tuple(float(i) for i in range(11)), CFG)
    assert rules.RuleConstants.from_scalars(constants.to_scalars(), CFG) == constants
    for cuts, grid in (({}, constants.grid), (constants.cuts, constants.grid[::-1]), (constants.cuts, constants.grid[:-1])):
        with pytest.raises(ValueError):
            rules.RuleConstants(cuts, grid, CFG)
    with pytest.raises(KeyError):
        rules.RuleConstants.from_scalars({"cuts": {}}, CFG)


def test_a_log_histogram_keeps_zeros_apart(spark):
    rows = spark.createDataFrame([(0, 0.0), (0, 0.5), (0, 90.0), (1, 7.0), (1, None)], "is_fraud int, v double")
    got = {(r["is_fraud"], r["bin"]): r for r in profile.log_histogram(rows, "v", 10).collect()}
    assert {k: r["rows"] for k, r in got.items()} == {(0, 0): 1, (0, 9): 2, (1, 9): 1}
    assert got[0, 0]["low"] == 0 and got[0, 9]["high"] == 90 and got[1, 9]["share"] == 1
    assert np.isnan(got[0, 0]["high"]) and np.isnan(got[0, 9]["low"])
    with pytest.raises(ValueError, match="negative"):
        profile.log_histogram(rows.selectExpr("is_fraud", "-v as v"), "v", 10)
