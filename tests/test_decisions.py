import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.config import Costs, sweep_scenarios
from riskframe.operators import bootstrap, cost, ranking

COSTS = Costs()


def ap_auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    ap, tp, fp, auc = 0.0, 0.0, 0.0, 0.0
    P, N = (w * y).sum(), (w * (1 - y)).sum()
    for v in np.unique(s)[::-1]:
        m = s == v
        dp, dn = (w * y)[m].sum(), (w * (1 - y))[m].sum()
        auc += dn * (tp + dp / 2)
        tp, fp = tp + dp, fp + dn
        ap += dp / P * tp / (tp + fp)
    return ap, auc / (P * N)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 2000
    # one day holds a third of all rows, and scores are coarse
    pdf = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "day": np.where(rng.random(n) < 0.33, 1, rng.integers(2, 8, n)),
            "is_fraud": (rng.random(n) < 0.1).astype(int),
            "amount": np.round(rng.lognormal(4, 1.2, n), 2),
            "w": rng.integers(1, 4, n),
        }
    )
    pdf["score"] = np.round(np.clip(rng.random(n) * 0.7 + 0.3 * pdf.is_fraud * rng.random(n), 0, 1), 2)
    return pdf, spark.createDataFrame(pdf)


def test_average_precision_and_roc(scored, bucket_rows):
    pdf, df = scored
    row = ranking.ranking_metrics(df).first()
    ap, auc = ap_auc(pdf.is_fraud.to_numpy(), pdf.score.to_numpy())
    assert row["pr_auc"] == pytest.approx(ap, rel=1e-12) and row["roc_auc"] == pytest.approx(auc, rel=1e-12)


def test_weighted_average_precision(scored, bucket_rows):
    pdf, df = scored
    row = ranking.ranking_metrics(df, weight="w").first()
    ap, _ = ap_auc(pdf.is_fraud.to_numpy(), pdf.score.to_numpy(), pdf.w.to_numpy().astype(float))
    assert row["pr_auc"] == pytest.approx(ap, rel=1e-12)


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "is_fraud int, score double")
    with pytest.raises(ValueError, match="both classes"):
        ranking.check_two_classes(ranking.ranking_metrics(df))


def brute_capacity(pdf, capacity):
    caught = reviewed = ambiguous = 0
    for _, g in pdf.groupby("day"):
        g = g.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        q = math.floor(len(g) * capacity)
        caught += int(g.is_fraud.iloc[:q].sum())
        reviewed += q
        if 0 < q < len(g) and g.score.iloc[q - 1] == g.score.iloc[q]:
            ambiguous += 1
    return caught, reviewed, ambiguous


def test_recall_at_capacity(scored, bucket_rows):
    pdf, df = scored
    caps = [0.001, 0.01, 0.05, 0.29, 1.0]
    got = {r["capacity"]: r for r in ranking.recall_at_capacity(df, caps).collect()}
    for c in caps:
        caught, reviewed, ambiguous = brute_capacity(pdf, c)
        assert (got[c]["caught"], got[c]["reviewed"], got[c]["ambiguous_days"]) == (caught, reviewed, ambiguous)
        best = sum(min(math.floor(len(g) * c), g.is_fraud.sum()) for _, g in pdf.groupby("day"))
        assert got[c]["recall_ceiling"] == pytest.approx(best / pdf.is_fraud.sum())


def test_capacity_must_be_a_fraction(scored):
    with pytest.raises(ValueError, match="capacities"):
        ranking.recall_at_capacity(scored[1], [1.5])


def brute_shares(priority, day, fraction, eligible):
    share = np.zeros(len(priority))
    for d in np.unique(day):
        cap = math.floor(fraction * (day == d).sum() + 1e-9)
        rows = np.flatnonzero((day == d) & eligible)
        if cap == 0 or not len(rows):
            continue
        order = np.sort(priority[rows])[::-1]
        if len(rows) <= cap:
            share[rows] = 1
            continue
        cut = order[cap - 1]
        above, tied = rows[priority[rows] > cut], rows[priority[rows] == cut]
        share[above], share[tied] = 1, (cap - len(above)) / len(tied)
    return share


@pytest.mark.parametrize("fraction", [0.0005, 0.01, 0.29, 0.9])
def test_review_shares(scored, bucket_rows, fraction):
    pdf, df = scored
    got = cost.review_shares(df, "score", fraction, F.col("amount") > 40, day_bound=7).toPandas().set_index("id")
    want = brute_shares(pdf.score.to_numpy(), pdf.day.to_numpy(), fraction, (pdf.amount > 40).to_numpy())
    np.testing.assert_allclose(got.loc[pdf.id, "review_share"].to_numpy(), want, atol=1e-12)


def test_ineligible_rows_are_never_reviewed(spark, bucket_rows):
    df = spark.createDataFrame([(i, 1, float(i), i < 5) for i in range(100)], "id int, day int, priority double, ok boolean")
    got = cost.review_shares(df, "priority", 0.1, "ok")
    assert got.where("not ok and review_share > 0").count() == 0
    assert got.agg(F.sum("review_share")).first()[0] == 5


def brute_ev(pdf, p, costs, capacity):
    allow, block = p * (pdf.amount + costs.chargeback_fee), (1 - p) * costs.false_positive
    gain = np.minimum(allow, block) - (costs.review + (1 - p) * costs.review_friction)
    share = brute_shares(gain.to_numpy(), pdf.day.to_numpy(), capacity, (gain > 0).to_numpy())
    blocked = (block < allow).to_numpy()
    y = pdf.is_fraud.to_numpy()
    fallback = np.where(blocked, (1 - y) * costs.false_positive, y * (pdf.amount + costs.chargeback_fee))
    per_row = share * (costs.review + (1 - y) * costs.review_friction) + (1 - share) * fallback
    return per_row, share, blocked


def test_expected_value_policy(scored, bucket_rows):
    pdf, df = scored
    row = cost.policy_summary(cost.ev_policy(df, COSTS, 0.02, p="score", day_bound=7), COSTS).first()
    per_row, share, blocked = brute_ev(pdf, pdf.score, COSTS, 0.02)
    assert row["usd_per_1000"] == pytest.approx(per_row.sum() / len(pdf) * 1000, rel=1e-12)
    assert row["reviews_per_day"] == pytest.approx(share.sum() / pdf.day.nunique(), rel=1e-12)
    assert row["block_rate"] == pytest.approx(((1 - share) * blocked).mean(), rel=1e-12)


def test_policies_do_not_depend_on_row_order(scored):
    _, df = scored
    rows = {
        tuple(round(v, 9) for v in cost.policy_summary(cost.ev_policy(df.repartition(n), COSTS, 0.01, p="score"), COSTS).first())
        for n in (1, 7, 64)
    }
    assert len(rows) == 1


def test_sweep_equals_one_costing_at_a_time(scored, bucket_rows):
    pdf, df = scored
    frame = df.withColumns({"calibrated": F.col("score"), "rules_score": F.floor("amount").cast("double") % 5})
    scenarios = sweep_scenarios(COSTS, 0.02, {"false_positive": [5.0, 60.0], "review_capacity": [0.1]})
    got = cost.sweep(frame, scenarios, day_bound=7).where("policy = 'ev'").collect()
    assert len(got) == len(scenarios)
    for s in scenarios:
        row = next(r for r in got if r["assumption"] == s.assumption and r["value"] == s.value)
        per_row, *_ = brute_ev(pdf, pdf.score, s.costs, s.capacity)
        assert row["usd_per_1000"] == pytest.approx(per_row.sum() / len(pdf) * 1000, rel=1e-9)


def test_best_global_cut_is_the_largest_cheapest(scored, bucket_rows):
    pdf, df = scored
    p, y, a = pdf.score.to_numpy() ** 3, pdf.is_fraud.to_numpy(), pdf.amount.to_numpy()
    got = cost.best_global_cut(df.withColumn("p", F.pow("score", 3.0)), COSTS).first()
    costs = {v: (y * (a + 25) * (p < v)).sum() + ((1 - y) * 15.0 * (p >= v)).sum() for v in np.unique(p)}
    low = min(costs.values())
    if low < (y * (a + 25)).sum():
        assert got["cost"] == pytest.approx(low, rel=1e-9)
        assert got["cut"] == pytest.approx(max(v for v, c in costs.items() if abs(c - low) < 1e-6), rel=1e-9)


def test_no_useful_cut_is_refused(spark):
    df = spark.createDataFrame([(0.5, 0, 1.0), (0.9, 0, 1.0)], "p double, is_fraud int, amount double")
    with pytest.raises(ValueError, match="no cut"):
        cost.require_cut(cost.best_global_cut(df, COSTS))


def test_break_even_flips_the_action(spark):
    amount = 60.0
    bar = 15 / (amount + 40)
    df = spark.createDataFrame([(bar - 1e-9, amount), (bar + 1e-9, amount)], "p double, amount double")
    assert [r[0] for r in df.select(cost.allow_or_block("p", "amount", COSTS)).collect()] == ["allow", "block"]


@pytest.mark.parametrize("action, label", [("hold", 0), ("allow", 2), (None, 0), ("allow", None)])
def test_unknown_actions_and_labels_fail(spark, action, label):
    df = spark.createDataFrame([(1, action, label, 1.0, 0.0)], "day int, fallback string, y int, amount double, review_share double")
    assert df.select(cost.realised_cost("fallback", "y", "amount", COSTS)).first()[0] is None
    with pytest.raises(Exception, match="labels must be 0 or 1 and actions known: 1 rows"):
        cost.policy_summary(df, COSTS, "y").collect()


def undecidable(spark, rows=400):
    """Every fourth row has a null probability; those are outside the fold `b`."""
    data = [(i, i % 5, "a" if i % 4 == 0 else "b", None if i % 4 == 0 else (i % 97) / 97, float(i % 50), int(i % 11 == 0)) for i in range(rows)]
    return spark.createDataFrame(data, "id long, day int, fold string, p double, amount double, is_fraud int")


POLICIES = {
    "ev": lambda df: cost.ev_policy(df, COSTS, 0.1),
    "naive": lambda df: cost.naive_policy(df),
    "break_even": lambda df: cost.break_even_policy(df, COSTS),
    "decide": lambda df: cost.decide(df.withColumn("p", F.coalesce("p", F.lit(0.5))).withColumn("amount", F.when(F.col("fold") == "b", F.col("amount"))), COSTS, "p"),
}


@pytest.mark.parametrize("name", sorted(POLICIES))
def test_refusals_meet_the_rows_in_question_only(spark, tmp_path, name):
    path = str(tmp_path / "rows")
    undecidable(spark).write.parquet(path)
    every, policy = spark.read.parquet(path), POLICIES[name]
    inside = policy(every.where("fold = 'b'"))
    # filters over the decided rows are merged with the one below them, and must not reach other folds
    later = {"ev": "gain > 0", "decide": "review_priority > 0"}.get(name, "fallback = 'allow'")
    assert inside.where(later).count() > 0
    assert inside.count() == every.where("fold = 'b'").count()
    with pytest.raises(Exception, match="no decision can be made"):
        policy(every).where(later).where("fold = 'b'").count()


def test_missing_costs_are_not_resampled(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0)], "day int, a double, r double")
    with pytest.raises(Exception, match="values to resample are missing: 1 rows"):
        bootstrap.paired_day_bootstrap(df, "a", "r", 10).collect()


@pytest.mark.parametrize("p, amount", [(None, 1.0), (float("nan"), 1.0), (1.5, 1.0), (0.5, -1.0), (0.5, float("inf"))])
def test_undecidable_inputs_are_refused(spark, p, amount):
    df = spark.createDataFrame([(p, amount)], "p double, amount double")
    with pytest.raises(ValueError, match="cannot be decided"):
        cost.check_inputs(df)


def test_rows_without_a_score_fall_back_to_rules(spark):
    df = spark.createDataFrame([(0.9, 100.0, 4.5), (None, 100.0, 4.5)], "probability double, amount double, pts double")
    model, rules = cost.decide(df, COSTS, points="pts").collect()
    assert (model["decision"], model["mode"]) == ("block", "model")
    assert (rules["decision"], rules["mode"], rules["review_priority"], rules["review_eligible"]) == ("allow", "rules", 4.5, True)


def test_recorded_rows_are_compared_exactly(spark):
    rows = spark.createDataFrame([("ev", 1.0), ("rules", 2.0)], "policy string, v double")
    cost.check_rows(rows, rows, ["v"])
    with pytest.raises(ValueError, match="not reproduced"):
        cost.check_rows(rows, rows.withColumn("v", F.col("v") + 1e-12), ["v"])


def test_reliability_bins(spark, bucket_rows):
    rng = np.random.default_rng(5)
    p = np.where(rng.random(800) < 0.35, 0.2, rng.random(800))
    y = (rng.random(800) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y, "fold": 0}))
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11)))
    at = np.clip(np.searchsorted(edges, p, side="right") - 1, 0, len(edges) - 2)
    want = pd.DataFrame({"b": at, "p": p, "y": y}).groupby("b").agg(rows=("p", "size"), mp=("p", "mean"), r=("y", "mean"))
    for groups in ([], ["fold"]):
        got = ranking.reliability_bins(df, "y", "p", 10, groups).toPandas().sort_values("bin")
        np.testing.assert_array_equal(got["rows"], want["rows"])
        np.testing.assert_allclose(got["mean_probability"], want["mp"])
    ece = ranking.calibration_metrics(df, "y", "p").first()
    assert ece["ece"] == pytest.approx(((want.mp - want.r).abs() * want["rows"]).sum() / 800)
    assert ece["brier"] == pytest.approx(((p - y) ** 2).mean())


def test_negative_costs_are_refused():
    with pytest.raises(ValueError, match="negative"):
        Costs(review=-1)



def test_rows_without_priority_share_what_the_others_leave(spark, bucket_rows):
    rows = [(i, 1, float(i) if i < 3 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, day int, gain double")
    got = cost.review_shares(df, "gain", 0.5).collect()
    assert sum(r["review_share"] for r in got) == pytest.approx(10)
    assert all(r["review_share"] == 1 for r in got if r["gain"] is not None)
    assert {r["review_share"] for r in got if r["gain"] is None} == {7 / 17}


def test_recall_at_capacity_takes_text_ids_and_missing_scores(spark, bucket_rows):
    rows = [(f"id-{i:04d}", i % 2, int(i % 10 == 0), None if i % 7 == 0 else 0.5 if i % 3 == 0 else i / 400) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, day int, is_fraud int, score double")
    caught = 0
    for day in (0, 1):
        ranked = sorted((r for r in rows if r[1] == day), key=lambda r: (-(r[3] if r[3] is not None else float("-inf")), r[0]))
        caught += sum(r[2] for r in ranked[: int(len(ranked) * 0.3)])
    assert ranking.recall_at_capacity(df, [0.3]).first()["caught"] == caught


@pytest.mark.parametrize("p, amount", [(float("nan"), 5.0), (None, 5.0), (1.5, 5.0), (-0.1, 5.0), (0.2, -5.0), (0.2, float("nan")), (0.2, None)])
def test_rows_that_cannot_be_decided_are_refused(spark, p, amount):
    df = spark.createDataFrame([(1, 1, p, amount, 0)], "id long, day int, p double, amount double, is_fraud int")
    with pytest.raises(Exception, match="no decision can be made"):
        cost.ev_policy(df, Costs(), 0.5).collect()


def test_decide_sends_unusable_probabilities_to_the_rules(spark):
    df = spark.createDataFrame([(None, 5.0), (float("nan"), 5.0), (1.5, 5.0), (0.9, 5.0)], "probability double, amount double")
    assert [(r["mode"], r["decision"]) for r in cost.decide(df, Costs()).collect()][:3] == [("rules", "allow")] * 3
    assert cost.decide(df, Costs()).collect()[3]["mode"] == "model"
    with pytest.raises(Exception, match="no decision can be made"):
        cost.decide(spark.createDataFrame([(0.9, -5.0)], "probability double, amount double"), Costs()).collect()


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_missing_probabilities_are_in_no_bin(spark, groups):
    rows = [(i % 2, i / 100, i % 3 == 0) for i in range(100)] + [(0, None, False), (1, float("nan"), True)]
    df = spark.createDataFrame([(g, p, int(y)) for g, p, y in rows], "g int, p double, y int")
    bins = ranking.reliability_bins(df, "y", "p", 5, groups).collect()
    assert sum(r["rows"] for r in bins) == 100
    metrics = ranking.calibration_metrics(df, "y", "p", 5, groups).collect()
    assert sum(r["rows"] for r in metrics) == 100 and all(r["log_loss"] < 5 for r in metrics)
