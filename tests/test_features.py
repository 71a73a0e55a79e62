import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.config import GLOBAL, MISSING, OTHER
from riskframe.functions import scalar as S
from riskframe.operators import features, reduction
from riskframe.operators.horizon import Fitted, build_horizon, transform
from riskframe.operators.splits import add_time_columns


def brute_velocity(pdf, windows, gap_days=30.0):
    pdf = pdf.sort_values(["dt", "id"], kind="stable")
    out = {}
    for _, g in pdf.groupby("card", dropna=False):
        t = g.dt.to_numpy()
        cols = {}
        for name, s in windows.items():
            cols[name] = np.arange(len(t)) - np.searchsorted(t, t - s, side="right") + 1
        rec = np.log1p(pd.Series(t).diff().fillna(gap_days * 86400)).astype("float32").to_numpy()
        for i, rid in enumerate(g.id):
            out[rid] = (*(cols[n][i] for n in windows), rec[i])
    return out


def check_velocity(spark, pdf):
    df = spark.createDataFrame(pdf, "id bigint, dt bigint, card string")
    got = features.velocity(df.repartition(5)).toPandas()
    want = brute_velocity(pdf, features.WINDOWS)
    assert len(got) == len(pdf)
    for r in got.itertuples():
        assert (r.vel_n1h_card, r.vel_n24h_card, r.vel_n7d_card) == tuple(want[r.id][:3])
        assert r.vel_recency_card == pytest.approx(want[r.id][3], rel=1e-6)


def test_velocity_half_open_edge_and_ties(spark):
    rows = [(0, 0, "a"), (1, 3600, "a"), (2, 3600, "a"), (3, 3601, "a"), (4, 86_400, "a"), (5, 604_800, "a"), (6, 604_801, "a")]
    check_velocity(spark, pd.DataFrame(rows, columns=["id", "dt", "card"]))


def test_velocity_null_entity_is_an_entity(spark):
    rows = [(0, 10, None), (1, 20, None), (2, 20, "b")]
    check_velocity(spark, pd.DataFrame(rows, columns=["id", "dt", "card"]))


@pytest.mark.parametrize("seed", range(4))
def test_velocity_with_a_hot_entity_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 1500
    card = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 30, n).astype(str))
    dt = rng.integers(0, 12 * 86_400, n) // 600 * 600
    check_velocity(spark, pd.DataFrame({"id": rng.permutation(n), "dt": dt, "card": card}))


def test_velocity_never_sees_the_future(spark):
    early = [(0, 100, "a"), (1, 200, "a")]
    late = [(2, 250, "a"), (3, 90_000, "a")]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, dt bigint, card string")
    alone = {r["id"]: r for r in features.velocity(frame(early)).collect()}
    joined = {r["id"]: r for r in features.velocity(frame(early + late)).collect()}
    assert alone[0] == joined[0] and alone[1] == joined[1]


def test_velocity_groups_are_bounded_by_slot(spark):
    df = spark.range(100).select("id", (F.col("id") * 60).alias("dt"), F.lit("a").alias("card"))
    plan = features.velocity(df)._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window [" in line and "_pos" in line]
    assert ordered and all("_slot" in line for line in ordered)


def test_ragged_windows_are_refused(spark):
    df = spark.createDataFrame([(0, 0, "a")], "id bigint, dt bigint, card string")
    with pytest.raises(ValueError, match="multiples"):
        features.velocity(df, windows={"a": 3600, "b": 5000})


@pytest.fixture(scope="module")
def freq(spark):
    rows = [(s, c) for s, cs in (("train", "aaabbc"), ("val_fit", "az")) for c in cs] + [("val_fit", None)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, split string, card1 string")


def test_frequencies_come_from_train_only(freq):
    table = features.fit_frequencies(freq.where("split = 'train'"), ["card1"])
    got = {r["level"]: r["frequency"] for r in table.collect()}
    assert got == pytest.approx({"a": 0.5, "b": 1 / 3, "c": 1 / 6}, rel=1e-6)
    applied = {r["id"]: r["freq_card1"] for r in features.apply_frequencies(freq, table, ["card1"]).collect()}
    assert applied[6] == 0.5 and applied[7] == 0.0 and applied[8] == 0.0


def test_frequency_null_is_a_level(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("b",)], "k string")
    table = features.fit_frequencies(df, ["k"])
    assert {r["level"]: r["frequency"] for r in table.collect()}[MISSING] == 0.5


def test_amount_stats_shrink_and_keep_a_global_row(spark):
    pdf = pd.DataFrame({"card": list("aaab"), "amount": [10.0, 20.0, 60.0, 100.0]})
    table = features.fit_amount_stats(spark.createDataFrame(pdf), ["card"], 10.0)
    got = {r["level"]: r for r in table.collect()}
    m, s = pdf.amount.mean(), pdf.amount.std()
    assert got[GLOBAL]["mean"] == pytest.approx(m) and got[GLOBAL]["std"] == pytest.approx(s)
    assert got["a"]["mean"] == pytest.approx((3 * 30 + 10 * m) / 13)
    # a level seen once has no deviation: zero before shrinking
    assert got["b"]["std"] == pytest.approx(10 * s / 11)


def test_amount_stats_refuse_no_spread(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "card string, amount double")
    with pytest.raises(Exception, match="no spread"):
        features.fit_amount_stats(df, ["card"], 10.0).collect()


def test_thousandths_round_half_to_even(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (0.0025,), (59.95,)], "a double")
    assert [r[0] for r in df.select(S.thousandths("a")).collect()] == [0, 2, 2, 59950]


def test_amount_flags(spark):
    df = spark.createDataFrame([(300.0, "H"), (300.0, "W"), (100.0, "H"), (49.99, "H")], "amount double, product string")
    got = [tuple(r)[2:] for r in features.add_amount_features(df).collect()]
    assert got == [(1, 1, 1), (1, 1, 0), (1, 0, 0), (0, 0, 0)]


def test_vocabulary_codes_are_dense_and_sorted(spark):
    df = spark.createDataFrame([(c,) for c in ["b"] * 3 + ["a"] * 3 + ["rare"] + [None]], "k string")
    table = features.fit_categories(df, ["k"], 3)
    assert {r["level"]: r["code"] for r in table.collect()} == {"a": 0, "b": 1, OTHER: 2, MISSING: 3}
    routed = [r["k"] for r in features.apply_categories(df, table, ["k"]).collect()]
    assert sorted(routed) == sorted(["a"] * 3 + ["b"] * 3 + [OTHER, MISSING])


def test_vocabulary_codes_run_across_prefix_slices(spark):
    levels = [f"{p}{i}" for p in ("aaa", "aab", "b", "zz9") for i in range(5)]
    df = spark.createDataFrame([(v,) for v in levels], "k string")
    got = {r["level"]: r["code"] for r in features.fit_categories(df, ["k"], 1).collect()}
    assert [got[v] for v in sorted(levels)] == list(range(20)) and got[OTHER] == 20


def test_medians_fill_and_refuse_unfitted(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    fitted = features.fit_medians(df, ["x"])
    assert sorted(r["x"] for r in features.apply_medians(df, fitted, ["x"]).collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError, match="no median"):
        features.apply_medians(df.withColumn("y", F.col("x")), fitted, ["x", "y"])


def test_null_share_selection(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 1.0), (3.0, None)], "a double, b double")
    assert features.select_by_null_share(df, ["a", "b"], 0.5) == ["a"]


def test_history_defaults_and_neutralisation(spark):
    df = spark.createDataFrame([(1, 4.0)], "id int, vel_n7d_card double")
    row = features.fill_history(df).first()
    assert row["vel_n7d_card"] == 4.0 and row["vel_n1h_card"] == 1.0
    assert row["vel_recency_card"] == pytest.approx(np.log1p(30 * 86400), rel=1e-6)
    assert features.neutralise(df).first()["vel_n7d_card"] == 1.0


# ---- reduction ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def block(spark):
    rng = np.random.default_rng(0)
    n = 400
    base = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": base, "b": base * 2 + rng.normal(size=n) * 0.01, "c": rng.normal(size=n), "d": rng.normal(size=n)})
    gone = rng.random(n) < 0.3
    pdf.loc[gone, ["a", "b", "c"]] = None
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id bigint, a double, b double, c double, d double")


def test_null_patterns_group_columns(block):
    assert reduction.null_pattern_groups(block, ["a", "b", "c", "d"], "id") == [["a", "b", "c"], ["d"]]


def test_greedy_clusters(block):
    assert reduction.correlation_clusters(block, ["a", "b", "c"], 0.9) == [["a", "b"], ["c"]]


def test_reduction_keeps_heads_and_varying_flags(block):
    fitted = reduction.fit_reduction(block, ["a", "b", "c", "d"], "id")
    assert fitted.representatives == ("a", "c", "d") and fitted.presence == ("a",)
    built = reduction.apply_reduction(block, fitted)
    assert set(built.columns) == {"id", "vb_a", "vb_c", "vb_d", "vb_present_a"}
    assert built.where("vb_a is null").count() == 0


def test_rarely_observed_columns_are_left_out(spark):
    rows = [(i, float(i) if i < 10 else None, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, few double, all_rows double")
    fitted = reduction.fit_reduction(df, ["few", "all_rows"], "id")
    assert fitted.representatives == ("all_rows",) and fitted.presence == ()


# ---- serving transform ----------------------------------------------------------------------------


def test_horizon_is_proved_on_labelled_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(200), "dt": 86_400 + 900 * np.arange(200), "amount": np.round(rng.lognormal(3, 1, 200), 2), "product": rng.choice(["W", "C", "H"], 200)})
    df = spark.createDataFrame(pdf)
    train = df.where("id < 130")
    fitted = Fitted(
        features.fit_frequencies(train, ["product"]), features.fit_amount_stats(train, ["product"], 10.0),
        features.fit_categories(train, ["product"], 5), ["product"], ["product"], ["product"],
    )
    columns = ["id", "day", "freq_product", "amt_z_product", "vel_n1h_card", "product"]
    reference = transform(df.where("id < 130"), fitted, columns)
    built = build_horizon(df.where("id >= 130"), df.where("id < 130"), reference, fitted, columns)
    assert built.count() == 70
    wrong = reference.withColumn("freq_product", F.col("freq_product") + 1)
    with pytest.raises(ValueError, match="differ"):
        build_horizon(df.where("id >= 130"), df.where("id < 130"), wrong, fitted, columns)


def test_time_columns(spark):
    cases = {86_400: (1, 0, 1), 90_000: (1, 1, 1), 176_400: (2, 1, 2), 777_600: (9, 0, 2), 691_200: (8, 0, 1)}
    df = spark.createDataFrame([(s,) for s in cases], "dt int")
    got = {r["dt"]: (r["day"], r["hour"], r["weekday"]) for r in add_time_columns(df).collect()}
    assert got == cases
