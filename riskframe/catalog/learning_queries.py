"""Queries over calibration, bootstraps and learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.inputs import split_txn
from riskframe.catalog.metric_queries import CAPACITY, COSTS, POLICIES, ROW_COST, decision_rows, ev_sql, summary_sql
from riskframe.catalog.registry import TXN, query
from riskframe.operators import bootstrap, calibration, cost, features, learning, ranking
from riskframe.operators.horizon import Fitted, build_horizon, transform
from riskframe.operators.splits import assign_folds
from riskframe.session import materialise, scratch_path
from riskframe.sources.artifacts import Served, check_scores, load_served, save_served

NUMERIC = ["amount", "hour", "weekday"]


def scored(spark, d):
    """Scores that carry signal, on the calibration split: label-dependent and away from 0 and 1."""
    s = 0.05 + 0.6 * F.col("score") + 0.3 * F.col("is_fraud")
    return split_txn(spark, d).where("split = 'val_cal'").withColumn("score", s)


SCORED_SQL = "SELECT *, 0.05 + 0.6 * score + 0.3 * is_fraud AS s FROM st WHERE split = 'val_cal'"


@query(
    "score_clip_check",
    "clipped:i",
    f"SELECT count(*) FILTER (s < 0.1 OR s > 0.9) AS clipped FROM ({SCORED_SQL})",
)
def score_clip_check(spark, d):
    return calibration.clipped_scores(scored(spark, d), clip=0.1)


# Newton's method on the logistic likelihood, one fit per held-out fold (0 holds nothing out).
NEWTON = TXN + """,
sc AS (SELECT id, is_fraud AS y, day - 20 AS fold, ln((0.05 + 0.6 * score + 0.3 * is_fraud) / (0.95 - 0.6 * score - 0.3 * is_fraud)) AS z
       FROM st WHERE split = 'val_cal'),
nt AS (
  WITH RECURSIVE step(i, held, a, b) AS (
    SELECT 0, held, 0.0::DOUBLE, (SELECT ln(avg(y) / (1 - avg(y))) FROM sc WHERE fold <> held) FROM range(0, 6) r(held)
    UNION ALL
    SELECT i + 1, held, a - (gz * h - g * hz) / (h * hzz - hz * hz), b - (g * hzz - gz * hz) / (h * hzz - hz * hz) FROM (
      SELECT i, held, a, b, sum(p - y) AS g, sum((p - y) * z) AS gz, sum(p * (1 - p)) AS h, sum(p * (1 - p) * z) AS hz,
             sum(p * (1 - p) * z * z) AS hzz
      FROM (SELECT step.*, y, z, 1 / (1 + exp(-(a * z + b))) AS p FROM step JOIN sc ON fold <> held WHERE i < 12)
      GROUP BY i, held, a, b))
  SELECT held, a, b FROM step WHERE i = 12)
"""


@query("platt_fit", "a:f b:f", "SELECT a, b FROM nt WHERE held = 0", NEWTON)
def platt_fit(spark, d):
    a, b = calibration.fit_platt(scored(spark, d))
    return spark.createDataFrame([(a, b)], "a double, b double")


@query(
    "platt_cross_fit",
    "id:i fold:i platt:f",
    "SELECT id, fold - 1 AS fold, 1 / (1 + exp(-(a * z + b))) AS platt FROM sc JOIN nt ON held = fold",
    NEWTON,
)
def platt_cross_fit(spark, d):
    return calibration.cross_fit(assign_folds(scored(spark, d), 5), "platt")


@query(
    "isotonic_scores",
    "id:i probability:f",
    f"""WITH s AS ({SCORED_SQL}), k AS (SELECT s, sum(is_fraud) AS p, count(*) AS n FROM s GROUP BY 1),
             u AS (SELECT s, sum(p) OVER (ORDER BY s) AS cp, sum(n) OVER (ORDER BY s) AS cn, p, n FROM k),
             m AS (SELECT a.s AS lo, b.s AS hi, (b.cp - a.cp + a.p) / (b.cn - a.cn + a.n) AS mean FROM u a JOIN u b ON b.s >= a.s),
             f AS (SELECT k.s, max(worst) AS probability FROM k JOIN (
                     SELECT k.s, m.lo, min(m.mean) AS worst FROM k JOIN m ON m.lo <= k.s AND m.hi >= k.s GROUP BY 1, 2) w ON w.s = k.s GROUP BY 1)
        SELECT id, probability FROM s JOIN f USING (s)""",
)
def isotonic_scores(spark, d):
    # the largest lower bound over starts of the smallest mean over ends: the monotone fit
    rows = scored(spark, d)
    return calibration.apply_isotonic(rows, "score", calibration.fit_isotonic(rows), "probability")


# Monotone fits, one per held-out fold (0 holds nothing out): the largest lower bound over starts of
# the smallest mean over ends.
MONOTONE = NEWTON + f""",
fs AS (SELECT id, is_fraud, s, day - 20 AS fold FROM ({SCORED_SQL})),
fk AS (SELECT held, s, sum(is_fraud) AS p, count(*) AS n FROM fs JOIN range(0, 6) r(held) ON fold <> held GROUP BY 1, 2),
fu AS (SELECT held, s, sum(p) OVER w AS cp, sum(n) OVER w AS cn, p, n FROM fk WINDOW w AS (PARTITION BY held ORDER BY s)),
fm AS (SELECT a.held, a.s AS lo, b.s AS hi, (b.cp - a.cp + a.p) / (b.cn - a.cn + a.n) AS mean FROM fu a JOIN fu b ON a.held = b.held AND b.s >= a.s),
fw AS (SELECT fk.held, fk.s, fm.lo, min(fm.mean) AS worst FROM fk JOIN fm ON fm.held = fk.held AND fm.lo <= fk.s AND fm.hi >= fk.s GROUP BY ALL),
fit AS (SELECT held, s, max(worst) AS value FROM fw GROUP BY 1, 2),
around AS (
  SELECT id, held, fs.s, max(f.s) FILTER (f.s <= fs.s) AS below, min(f.s) FILTER (f.s >= fs.s) AS above
  FROM fs JOIN fit f ON held = fold GROUP BY ALL),
out_of_fold AS (
  SELECT a.id, a.held, CASE WHEN l.s IS NULL THEN h.value WHEN h.s IS NULL OR h.s = l.s THEN l.value
                            ELSE l.value + (a.s - l.s) / (h.s - l.s) * (h.value - l.value) END AS isotonic
  FROM around a LEFT JOIN fit l ON l.held = a.held AND l.s = below LEFT JOIN fit h ON h.held = a.held AND h.s = above)
"""


@query(
    "isotonic_fit",
    "score:f probability:f",
    """SELECT s AS score, value AS probability FROM (
         SELECT *, lag(value) OVER (ORDER BY s) AS a, lead(value) OVER (ORDER BY s) AS b FROM fit WHERE held = 0)
       WHERE a IS DISTINCT FROM value OR b IS DISTINCT FROM value""",
    MONOTONE,
)
def isotonic_fit(spark, d):
    return calibration.isotonic_table(calibration.fit_isotonic(scored(spark, d)))


@query(
    "calibrator_apply",
    "id:i platt:f isotonic:f",
    f"""SELECT id, 1 / (1 + exp(-(1.5 * ln(s / (1 - s)) - 0.25))) AS platt,
               CASE WHEN s <= 0.2 THEN 0.01 WHEN s >= 0.8 THEN 0.9 WHEN s < 0.5 THEN 0.01 + (s - 0.2) / 0.3 * 0.09
                    ELSE 0.1 + (s - 0.5) / 0.3 * 0.8 END AS isotonic FROM ({SCORED_SQL})""",
)
def calibrator_apply(spark, d):
    platt = calibration.Platt(1.5, -0.25)
    isotonic = calibration.Isotonic(((0.2, 0.5, 0.8), (0.01, 0.1, 0.9)))
    return isotonic.apply(platt.apply(scored(spark, d), "score", "platt"), "score", "isotonic")


@query(
    "calibration_cross_fit",
    "id:i fold:i platt:f isotonic:f",
    """SELECT id, fold - 1 AS fold, 1 / (1 + exp(-(a * z + b))) AS platt, isotonic
       FROM sc JOIN nt ON nt.held = fold JOIN out_of_fold USING (id)""",
    MONOTONE,
)
def calibration_cross_fit(spark, d):
    folded = assign_folds(scored(spark, d), 5)
    both = calibration.cross_fit(calibration.cross_fit(folded, "platt"), "isotonic")
    return both.select("id", "fold", "platt", "isotonic")


@query("calibration_report", "method:s fold:i rows:i positives:i brier:f log_loss:f ece:f")
def calibration_report(spark, d):
    return calibration.cross_fit_report(scored(spark, d), 5)


@query("calibration_selected", "selected:s")
def calibration_selected(spark, d):
    report = calibration.cross_fit_report(scored(spark, d), 5)
    return calibration.select_method(report.where("method = 'platt'"), report.where("method = 'isotonic'"))


ARM = "arm AS (SELECT st.*, 1 / (1 + exp(-(a * z + b))) AS p FROM st JOIN sc USING (id) JOIN nt ON held = fold)"


@query(
    "arm_costing",
    "rows:i usd_per_1000:f reviews_per_day:f block_rate:f",
    summary_sql("ev", "arm"),
    NEWTON + "," + ARM + "," + ev_sql(p="p", src="arm"),
)
def arm_costing(spark, d):
    return calibration.cost_arm(scored(spark, d), COSTS, CAPACITY, folds=5, day_bound=5)[1]


# ---- bootstraps ---------------------------------------------------------------------------------


RESAMPLES = 2000
# The draws of record for windows of five days, so that SQL can repeat the resampling.
TIMES = ", ".join(
    f"({r}, [{', '.join(map(str, row))}])" for r, row in enumerate(bootstrap.draw_multiplicities(5, RESAMPLES, 0).tolist())
)
DRAWS = f"draws(r, times) AS (VALUES {TIMES})"
ROW = ROW_COST.format(fee=25.0, fp=15.0)
DAILY = POLICIES + f""",
dc AS (SELECT 'rules' AS policy, day - 25 AS k, sum({ROW}) AS c, count(*) AS n FROM rules_p GROUP BY day
       UNION ALL SELECT 'naive', day - 25, sum({ROW}), count(*) FROM naive_p GROUP BY day
       UNION ALL SELECT 'break_even', day - 25, sum({ROW}), count(*) FROM even_p GROUP BY day
       UNION ALL SELECT 'ev', day - 25, sum({ROW}), count(*) FROM ev GROUP BY day),
{DRAWS},
rs AS (SELECT r, policy, sum(c * times[k]) AS c, sum(n * times[k]) AS n FROM draws CROSS JOIN dc GROUP BY 1, 2)
"""
ENDS = "quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high"


def _costed(spark, d):
    rows = decision_rows(spark, d).where("split = 'test'")
    decided = cost.decided_policies(rows, COSTS, CAPACITY, ("rules", "naive", "break_even", "ev"), day_bound=5)
    return decided.withColumn("cost", cost.policy_cost(COSTS)).select("id", "day", "policy", "cost")


def _paired(spark, d):
    return _costed(spark, d).groupBy("id", "day").pivot("policy", ["rules", "ev"]).agg(F.first("cost"))


@query(
    "bootstrap_paired",
    "low:f high:f excludes_zero:b",
    f"""SELECT *, high < 0 OR low > 0 AS excludes_zero FROM (SELECT {ENDS} FROM (
          SELECT (a.c - b.c) / a.n * 1000 AS v FROM rs a JOIN rs b USING (r) WHERE a.policy = 'ev' AND b.policy = 'rules'))""",
    DAILY,
)
def bootstrap_paired(spark, d):
    return bootstrap.paired_day_bootstrap(_paired(spark, d), "ev", "rules", RESAMPLES)


@query(
    "bootstrap_reduction",
    "low:f high:f",
    f"SELECT {ENDS} FROM (SELECT 1 - a.c / b.c AS v FROM rs a JOIN rs b USING (r) WHERE a.policy = 'ev' AND b.policy = 'rules')",
    DAILY,
)
def bootstrap_reduction(spark, d):
    return bootstrap.reduction_interval(_paired(spark, d), "ev", "rules", RESAMPLES)


@query(
    "bootstrap_ladder",
    "from_policy:s to_policy:s low:f high:f excludes_zero:b",
    f"""SELECT *, high < 0 OR low > 0 AS excludes_zero FROM (SELECT b.policy AS from_policy, a.policy AS to_policy,
          quantile_cont((a.c - b.c) / a.n * 1000, 0.025) AS low, quantile_cont((a.c - b.c) / a.n * 1000, 0.975) AS high
          FROM rs a JOIN rs b USING (r) WHERE (b.policy, a.policy) IN (('naive', 'break_even'), ('break_even', 'ev')) GROUP BY 1, 2)""",
    DAILY,
)
def bootstrap_ladder(spark, d):
    return bootstrap.ladder_intervals(_costed(spark, d), [("naive", "break_even"), ("break_even", "ev")], RESAMPLES)


WINDOW_METRICS = """
g AS (SELECT (day - 16) // 5 AS w, r, score, sum(times[(day - 16) % 5 + 1]) AS n, sum(times[(day - 16) % 5 + 1] * is_fraud) AS tp
      FROM (SELECT day, score, is_fraud FROM txn WHERE day >= 16) CROSS JOIN draws GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER o AS cn, sum(tp) OVER o AS ctp, sum(tp) OVER (PARTITION BY w, r) AS p, sum(n) OVER (PARTITION BY w, r) AS t
      FROM g WHERE n > 0 WINDOW o AS (PARTITION BY w, r ORDER BY score DESC)),
m AS (SELECT w, r, sum(tp / p * ctp / cn) AS ap, sum((n - tp) * (ctp - tp / 2.0)) / max(p * (t - p)) AS auc FROM c GROUP BY 1, 2)
"""


@query(
    "bootstrap_metrics",
    "window:i pr_auc_low:f pr_auc_high:f roc_auc_low:f roc_auc_high:f",
    """SELECT w AS "window", quantile_cont(ap, 0.025) AS pr_auc_low, quantile_cont(ap, 0.975) AS pr_auc_high,
              quantile_cont(auc, 0.025) AS roc_auc_low, quantile_cont(auc, 0.975) AS roc_auc_high FROM m GROUP BY 1""",
    TXN + "," + DRAWS + "," + WINDOW_METRICS,
)
def bootstrap_metrics(spark, d):
    rows = split_txn(spark, d).where("day >= 16").withColumn("window", F.floor((F.col("day") - 16) / 5).cast("int"))
    return bootstrap.metric_bootstrap(rows, RESAMPLES)


# ---- learners -------------------------------------------------------------------------------------


@query(
    "class_weight",
    "weight:f rows:i",
    """SELECT CASE is_fraud WHEN 1 THEN (SELECT sum(1 - is_fraud) / sum(is_fraud) FROM st WHERE split = 'train') ELSE 1 END AS weight,
              count(*) AS rows FROM st WHERE split = 'train' GROUP BY is_fraud""",
)
def class_weight(spark, d):
    train = split_txn(spark, d).where("split = 'train'")
    weighted = learning.with_class_weight(train, learning.class_weight(train))
    return weighted.groupBy("weight").agg(F.count(F.lit(1)).alias("rows"))


def _learnable(spark, d):
    """A label that the features can predict, so that fits are not noise.

    Written once: a fit reads its rows a dozen times, and times and splits cost more to derive than to read.
    """
    y = ((F.col("amount") > 60) & (F.col("hour") < 12)).cast("int")
    rows = split_txn(spark, d).withColumns({"is_fraud": y, "d1": F.when(F.col("addr") > 30, F.col("addr"))})
    return materialise(rows.drop("addr", "score"), "learnable")


PROBE = learning.ProbeConfig(["amount", "hour"], ["d1"], ["product"])


@query("linear_probe", "split:s n:i pr_auc:f roc_auc:f")
def linear_probe(spark, d):
    rows = _learnable(spark, d).where("split is not null")
    probe = learning.fit_probe(rows.where("split = 'train'"), PROBE)
    scores = materialise(learning.score_probe(rows, probe, ["split", "is_fraud"]), "scores")
    return ranking.ranking_metrics(scores, groups=["split"])


@query("probe_contributions", "id:i margin:f total:f")
def probe_contributions(spark, d):
    rows = _learnable(spark, d)
    probe = learning.fit_probe(rows.where("split = 'train'"), PROBE)
    parts = learning.probe_contributions(rows.where("split = 'test'"), probe, ["id"])
    total = F.aggregate("contributions", F.col("base"), lambda s, x: s + x)
    return parts.withColumn("total", total)


@query("tree_challenger", "split:s n:i pr_auc:f roc_auc:f")
def tree_challenger(spark, d):
    rows = _learnable(spark, d).where("split is not null")
    model = learning.fit_tree(rows, NUMERIC)
    return ranking.ranking_metrics(learning.score_tree(rows, model, NUMERIC, ["split", "is_fraud"]), groups=["split"])


@query("experiment_arms", "arm:s features:i pr_auc:f")
def experiment_arms(spark, d):
    rows = _learnable(spark, d).where("split is not null")
    arms = learning.leave_family_out(NUMERIC, {"time": ["hour", "weekday"], "amount": ["amount"]})
    return learning.run_arms(rows, arms)


@query("noise_floor", "seed:i width:i pr_auc:f delta:f")
def noise_floor(spark, d):
    rows = _learnable(spark, d)
    small = learning.ProbeConfig(["amount", "hour"])
    return learning.noise_floor(rows.where("split = 'train'"), rows.where("split = 'val_fit'"), small, range(20), 1)


@query("family_probe", "family:s pr_auc:f roc_auc:f")
def family_probe(spark, d):
    rows = _learnable(spark, d)
    base = learning.ProbeConfig(["amount"])
    return learning.family_probe(
        rows.where("split = 'train'"), rows.where("split = 'val_fit'"), base, {"time": ["hour", "weekday"]}
    )


@query(
    "neutralised_arm",
    "arm:s rows:i pr_auc:f usd_per_1000:f reviews_per_day:f block_rate:f delta_pr_auc:f delta_usd:f low:f high:f",
)
def neutralised_arm(spark, d):
    columns = ["amount", "hour", *features.velocity_columns()]
    # history is swept over every row, once; the fit and the arms read what they need of it
    swept = features.velocity(_learnable(spark, d)).where("split in ('train', 'val_cal')")
    rows = materialise(swept.select("id", "day", "split", "is_fraud", *columns), "history")
    probe = learning.fit_probe(rows.where("split = 'train'"), learning.ProbeConfig(columns))

    def scorer(df):
        return learning.score_probe(df, probe, ["id", "day", "is_fraud", "amount"])

    held = rows.where("split = 'val_cal'")
    intact, neutral = (materialise(df, "arm") for df in learning.neutralised_scores(held, scorer))
    arms = {"with_history": intact, "neutralised": neutral}
    return learning.compare_arms(arms, "with_history", COSTS, CAPACITY, folds=5, resamples=RESAMPLES, day_bound=5)


# Two scorings that SQL can repeat: the score, and the score without its smallest amounts.
ARM_ROWS = {"intact": "score", "flattened": "CASE WHEN amount < 20 THEN 0.3 ELSE score END"}


def _arm_sql() -> str:
    ctes = []
    for name, score in ARM_ROWS.items():
        ctes.append(f"""{name}_s AS (SELECT id, is_fraud AS y, day - 20 AS fold, 0.05 + 0.6 * ({score}) + 0.3 * is_fraud AS s FROM st WHERE split = 'val_cal'),
{name}_z AS (SELECT *, ln(s / (1 - s)) AS z FROM {name}_s),
{name}_n AS (
  WITH RECURSIVE step(i, held, a, b) AS (
    SELECT 0, held, 0.0::DOUBLE, (SELECT ln(avg(y) / (1 - avg(y))) FROM {name}_z WHERE fold <> held) FROM range(1, 6) r(held)
    UNION ALL
    SELECT i + 1, held, a - (gz * h - g * hz) / (h * hzz - hz * hz), b - (g * hzz - gz * hz) / (h * hzz - hz * hz) FROM (
      SELECT i, held, a, b, sum(p - y) AS g, sum((p - y) * z) AS gz, sum(p * (1 - p)) AS h, sum(p * (1 - p) * z) AS hz,
             sum(p * (1 - p) * z * z) AS hzz
      FROM (SELECT step.*, y, z, 1 / (1 + exp(-(a * z + b))) AS p FROM step JOIN {name}_z ON fold <> held WHERE i < 12)
      GROUP BY i, held, a, b))
  SELECT held, a, b FROM step WHERE i = 12),
{name}_p AS (SELECT st.*, 1 / (1 + exp(-(a * z + b))) AS p, s FROM st JOIN {name}_z USING (id) JOIN {name}_n ON held = fold),
{ev_sql("_" + name, "p", name + "_p").strip()},
{name}_k AS (SELECT *, sum(is_fraud) OVER w AS tp, count(*) OVER w AS n FROM {name}_p WINDOW w AS (ORDER BY s DESC)),
{name}_m AS (SELECT '{name}' AS arm, sum(is_fraud * tp / n) / sum(is_fraud) AS pr_auc FROM {name}_k),
{name}_d AS (SELECT day - 20 AS k, count(*) AS n, sum({ROW}) AS c FROM ev_{name} GROUP BY day)""")
    return TXN + "," + ",\n".join(ctes) + f""",
{DRAWS},
paired AS (SELECT r, sum((a.c - b.c) * times[a.k]) / sum(a.n * times[a.k]) * 1000 AS v FROM draws CROSS JOIN flattened_d a JOIN intact_d b USING (k) GROUP BY r),
told AS (SELECT * FROM ({summary_sql("ev_intact", "intact")} UNION ALL {summary_sql("ev_flattened", "flattened")}) JOIN
         (SELECT * FROM intact_m UNION ALL SELECT * FROM flattened_m) ON arm = policy)"""


@query(
    "arm_comparison",
    "arm:s rows:i pr_auc:f usd_per_1000:f reviews_per_day:f block_rate:f delta_pr_auc:f delta_usd:f low:f high:f",
    f"""SELECT arm, rows, pr_auc, usd_per_1000, reviews_per_day, block_rate,
               pr_auc - (SELECT pr_auc FROM told WHERE arm = 'intact') AS delta_pr_auc,
               usd_per_1000 - (SELECT usd_per_1000 FROM told WHERE arm = 'intact') AS delta_usd, low, high
        FROM told LEFT JOIN (SELECT 'flattened' AS arm, {ENDS} FROM paired) USING (arm)""",
    _arm_sql(),
)
def arm_comparison(spark, d):
    rows = split_txn(spark, d).where("split = 'val_cal'")
    flat = F.when(F.col("amount") < 20, 0.3).otherwise(F.col("score"))
    arms = {
        name: rows.withColumn("score", 0.05 + 0.6 * s + 0.3 * F.col("is_fraud")).select("id", "day", "is_fraud", "amount", "score")
        for name, s in (("intact", F.col("score")), ("flattened", flat))
    }
    return learning.compare_arms(arms, "intact", COSTS, CAPACITY, folds=5, resamples=RESAMPLES, day_bound=5)


@query("horizon_scores", "id:i uncalibrated:f calibrated:f")
def horizon_scores(spark, d):
    """A model fitted on train, saved, read back, proved on three test days, and used on those after them."""
    rows = _learnable(spark, d)
    train = rows.where("split = 'train'")
    tables = (
        features.fit_frequencies(train, ["product"]), features.fit_amount_stats(train, ["product"], 10.0),
        features.fit_categories(train, ["product"], 50),
    )
    fitted = Fitted(*[materialise(t, "fitted") for t in tables], ["product"], ["product"], ["product"])
    columns = ["id", "amount", "hour", "amt_whole_dollar", "freq_product", "amt_z_product", "product"]
    raw = ["id", "dt", "amount", "product"]
    numeric = ["amount", "hour", "amt_whole_dollar", "freq_product", "amt_z_product"]
    config = learning.ProbeConfig(numeric, categorical=["product"])
    matrix = transform(train.select(*raw), fitted).join(train.select("id", "is_fraud"), "id")
    matrix = materialise(matrix.select(*columns, "is_fraud"), "matrix")
    probe = learning.fit_probe(matrix, config)
    scored_train = materialise(learning.score_probe(matrix, probe, ["id", "is_fraud"]), "scores")
    served = Served(fitted, probe, calibration.Isotonic.fit(scored_train))
    path = scratch_path(spark, "served")
    save_served(served, path)
    test = rows.where("day between 26 and 28").select(*raw)
    reference = materialise(transform(test, fitted, columns), "reference")
    on_record = materialise(served.score(reference, ["id"]), "on-record")
    loaded = load_served(spark, path)
    later = rows.where("day > 28").select(*raw)
    return build_horizon(
        later, test, reference, loaded.fitted, columns, lambda m: loaded.score(m, ["id"]), on_record, check_scores
    )
