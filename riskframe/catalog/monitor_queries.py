"""Queries over drift, decay, the trigger and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.inputs import BOUNDS, split_txn, txn
from riskframe.catalog.learning_queries import DRAWS, RESAMPLES, WINDOW_METRICS
from riskframe.catalog.metric_queries import COSTS, ev_sql
from riskframe.catalog.registry import TXN, query
from riskframe.config import BASE_VALUE, MISSING, OTHER, MonitoringConfig
from riskframe.operators import decay, drift, explain

CONFIG = MonitoringConfig()
LEVELS = ("click", "purchase", "view", OTHER, MISSING)


def drift_rows(spark, d):
    """Transactions with a numeric column that has nulls and a routed categorical one."""
    known = F.col("product").isin("click", "purchase", "view")
    return split_txn(spark, d).select(
        "id",
        "day",
        "split",
        "is_fraud",
        "score",
        F.when(F.col("addr") >= 10, F.col("amount")).alias("amount"),
        F.when(F.col("addr") == 0, F.lit(MISSING)).when(known, F.col("product")).otherwise(F.lit(OTHER)).alias("product"),
        (F.col("addr") < 40).alias("has_identity"),
    )


DRIFT = TXN + """,
dr AS (
  SELECT id, day, split, is_fraud, score, CASE WHEN addr >= 10 THEN amount END AS amount,
         CASE WHEN addr = 0 THEN '__missing__' WHEN product IN ('click', 'purchase', 'view') THEN product ELSE '__other__' END AS product
  FROM st),
ord AS (SELECT amount, row_number() OVER (ORDER BY amount) AS rn, count(*) OVER () AS n FROM dr WHERE split = 'train' AND amount IS NOT NULL),
edges AS (SELECT DISTINCT amount AS e FROM ord, range(1, 10) r(k) WHERE rn = (k * n + 9) // 10),
lv(product, code) AS (VALUES ('click', 0), ('purchase', 1), ('view', 2), ('__other__', 3), ('__missing__', 4)),
cells AS (
  SELECT split, day, 'amount' AS c, CASE WHEN amount IS NULL THEN (SELECT count(*) + 1 FROM edges) ELSE (SELECT count(*) FROM edges WHERE e < amount) END AS bin FROM dr
  UNION ALL SELECT split, day, 'product', code FROM dr JOIN lv USING (product)),
bins AS (SELECT 'amount' AS c, b AS bin FROM range(0, 20) r(b) WHERE b <= (SELECT count(*) + 1 FROM edges) UNION ALL SELECT 'product', code FROM lv),
refc AS (SELECT c, bin, count(*) AS e FROM cells WHERE split = 'train' GROUP BY 1, 2),
winc AS (SELECT (day - 16) // 5 AS w, c, bin, count(*) AS n FROM cells WHERE day >= 16 GROUP BY 1, 2, 3),
grid AS (SELECT w, c, bin, coalesce(n, 0) AS n, coalesce(e, 0) AS e,
                sum(coalesce(n, 0)) OVER (PARTITION BY w, c) AS nt, sum(coalesce(e, 0)) OVER (PARTITION BY w, c) AS et,
                max(bin) OVER (PARTITION BY w, c) AS last
         FROM bins CROSS JOIN (SELECT DISTINCT w FROM winc) LEFT JOIN winc USING (w, c, bin) LEFT JOIN refc USING (c, bin)),
pt AS (
  SELECT w AS "window", c AS "column", CASE c WHEN 'amount' THEN 'numeric' ELSE 'categorical' END AS kind,
         sum((n / nt + 1e-6 - e / et - 1e-6) * ln((n / nt + 1e-6) / (e / et + 1e-6))) AS psi,
         sum(CASE WHEN e > 0 AND (c = 'product' OR bin < last) THEN 1 ELSE 0 END) AS value_bins,
         max(CASE WHEN bin = last THEN e / et END) AS missing_share_reference,
         max(CASE WHEN bin = last THEN n / nt END) AS missing_share,
         max(CASE WHEN c = 'product' AND bin = 3 THEN e / et END) AS unseen_share_reference,
         max(CASE WHEN c = 'product' AND bin = 3 THEN n / nt END) AS unseen_share
  FROM grid GROUP BY 1, 2)
"""


@query(
    "window_layout",
    "window:i first_day:i last_day:i days:i rows:i partial:b",
    """SELECT (day - 4) // 7 AS "window", 4 + 7 * ((day - 4) // 7) AS first_day, least(10 + 7 * ((day - 4) // 7), 30) AS last_day,
              least(7, 30 - (4 + 7 * ((day - 4) // 7)) + 1) AS days, count(*) AS rows, least(7, 30 - (4 + 7 * ((day - 4) // 7)) + 1) < 7 AS partial
       FROM txn WHERE day >= 4 GROUP BY 1""",
)
def window_layout(spark, d):
    return drift.describe_windows(txn(spark, d).where("day >= 4"), 7, 4)


@query(
    "quantile_edges",
    "column:s edge:f",
    "SELECT 'amount' AS \"column\", e AS edge FROM edges",
    DRIFT,
)
def quantile_edges(spark, d):
    edges = drift.quantile_edges(drift_rows(spark, d).where("split = 'train'"), ["amount"], 10)
    return spark.createDataFrame([(c, e) for c, es in edges.items() for e in es], "column string, edge double")


def _bins(spark, d):
    return drift.reference_bins(drift_rows(spark, d).where("split = 'train'"), ["amount"], {"product": LEVELS}, 10)


@query(
    "bin_counts",
    "window:i column:s bin:i n:i",
    'SELECT w AS "window", c AS "column", bin, n FROM grid',
    DRIFT,
)
def bin_counts(spark, d):
    rows = drift.window_index(drift_rows(spark, d).where("day >= 16"), 5, 16)
    return drift.bin_counts(rows, _bins(spark, d), ["window"])


@query(
    "numeric_counts",
    "bin:i n:i",
    "SELECT bin, coalesce(e, 0) AS n FROM bins LEFT JOIN refc USING (c, bin) WHERE c = 'amount'",
    DRIFT,
)
def numeric_counts(spark, d):
    train = drift_rows(spark, d).where("split = 'train'")
    edges = drift.quantile_edges(train, ["amount"], 10)["amount"]
    return drift.numeric_counts(train, "amount", edges)


@query(
    "categorical_counts",
    "bin:i n:i",
    "SELECT bin, coalesce(e, 0) AS n FROM bins LEFT JOIN refc USING (c, bin) WHERE c = 'product'",
    DRIFT,
)
def categorical_counts(spark, d):
    return drift.categorical_counts(drift_rows(spark, d).where("split = 'train'"), "product", LEVELS)


@query("stability_index", "window:i column:s psi:f", 'SELECT "window", "column", psi FROM pt', DRIFT)
def stability_index(spark, d):
    rows, bins = drift_rows(spark, d), _bins(spark, d)
    reference = drift.bin_counts(rows.where("split = 'train'"), bins)
    later = drift.bin_counts(drift.window_index(rows.where("day >= 16"), 5, 16), bins, ["window"])
    return drift.psi(reference, later, CONFIG.epsilon, ["window"])


def _column_psi(spark, d):
    rows = drift_rows(spark, d)
    later = drift.window_index(rows.where("day >= 16"), 5, 16)
    return drift.column_psi(rows.where("split = 'train'"), later, _bins(spark, d), CONFIG.epsilon)


@query(
    "column_drift",
    "window:i column:s kind:s psi:f value_bins:i missing_share_reference:f missing_share:f unseen_share_reference:f unseen_share:f",
    "SELECT * FROM pt",
    DRIFT,
)
def column_drift(spark, d):
    return _column_psi(spark, d)


@query(
    "weighted_drift",
    "window:i weighted_psi:f columns_stable:i columns_moderate:i weighted_band:s",
    """SELECT "window", sum(psi * CASE "column" WHEN 'amount' THEN 0.75 ELSE 0.25 END) AS weighted_psi,
              sum(CASE WHEN psi < 0.1 THEN 1 ELSE 0 END) AS columns_stable, sum(CASE WHEN psi >= 0.1 AND psi < 0.25 THEN 1 ELSE 0 END) AS columns_moderate,
              CASE WHEN sum(psi * CASE "column" WHEN 'amount' THEN 0.75 ELSE 0.25 END) < 0.1 THEN 'stable' ELSE 'moderate' END AS weighted_band
       FROM pt GROUP BY 1""",
    DRIFT,
)
def weighted_drift(spark, d):
    ranked = spark.createDataFrame([("amount", 0.3), ("product", 0.1), ("velocity", 0.9)], "feature string, mean_abs double")
    weights = drift.contribution_weights(ranked, ["amount", "product"], 10)
    return drift.weighted_psi(_column_psi(spark, d), weights, CONFIG)


@query(
    "leading_drift",
    "window:i place:i column:s psi:f band:s",
    """SELECT "window", CASE "column" WHEN 'amount' THEN 0 ELSE 1 END AS place, "column", psi,
              CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS band FROM pt""",
    DRIFT,
)
def leading_drift(spark, d):
    ranked = spark.createDataFrame([("amount", 0.3), ("product", 0.1)], "feature string, mean_abs double")
    return drift.leading_columns(_column_psi(spark, d), ranked, CONFIG)


@query(
    "score_views",
    "window:i score_psi:f p50:f p90:f p99:f mean_score:f stratum_share:f block_rate:f reviews_per_day:f review_eligible_rate:f",
    """WITH o AS (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM st WHERE split = 'val_cal'),
            e AS (SELECT DISTINCT score AS e FROM o, range(1, 10) r(k) WHERE rn = (k * n + 9) // 10),
            x AS (SELECT split, (day - 16) // 5 AS w, (SELECT count(*) FROM e WHERE e < score) AS bin FROM st WHERE day >= 16),
            b AS (SELECT b AS bin FROM range(0, 20) r(b) WHERE b <= (SELECT count(*) + 1 FROM e)),
            g AS (SELECT w, b.bin, (SELECT count(*) FROM x WHERE x.w = ww.w AND x.bin = b.bin) AS n, (SELECT count(*) FROM x WHERE x.split = 'val_cal' AND x.bin = b.bin) AS e
                  FROM b CROSS JOIN (SELECT DISTINCT w FROM x) ww),
            t AS (SELECT *, sum(n) OVER (PARTITION BY w) AS nt, sum(e) OVER (PARTITION BY w) AS et FROM g),
            p AS (SELECT w, sum((n / nt - e / et) * ln((n / nt + 1e-6) / (e / et + 1e-6))) AS score_psi FROM t GROUP BY 1),
            m AS (SELECT (day - 16) // 5 AS w, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90, quantile_cont(score, 0.99) AS p99,
                         avg(score) AS mean_score, avg(CASE WHEN addr < 40 THEN 1.0 ELSE 0 END) AS stratum_share,
                         avg((1 - share) * CASE WHEN fallback = 'block' THEN 1 ELSE 0 END) AS block_rate, sum(share) / count(DISTINCT day) AS reviews_per_day,
                         avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) AS review_eligible_rate FROM ev GROUP BY 1)
       SELECT w AS "window", * EXCLUDE (w) FROM p JOIN m USING (w)""",
    TXN + ", late AS (SELECT * FROM st WHERE day >= 16)," + ev_sql(src="late"),
)
def score_views(spark, d):
    rows = split_txn(spark, d).withColumn("has_identity", F.col("addr") < 40)
    later = drift.window_index(rows.where("day >= 16"), 5, 16)
    return drift.score_views(later, rows.where("split = 'val_cal'"), COSTS, 0.01, CONFIG, day_bound=15)


@query(
    "decay_windows",
    "window:i first_day:i last_day:i partial:b slice:s rows:i positives:i stratum_share:f pr_auc:f pr_auc_low:f pr_auc_high:f roc_auc:f roc_auc_low:f roc_auc_high:f optimistic:b days_since_training:f",
    """WITH x AS (SELECT (day - 16) // 5 AS w, score, count(*) AS n, sum(is_fraud) AS tp FROM txn WHERE day >= 16 GROUP BY 1, 2),
            y AS (SELECT *, sum(n) OVER o AS cn, sum(tp) OVER o AS ctp, sum(tp) OVER (PARTITION BY w) AS p, sum(n) OVER (PARTITION BY w) AS t
                  FROM x WINDOW o AS (PARTITION BY w ORDER BY score DESC)),
            z AS (SELECT w, max(t) AS rows, max(p) AS positives, sum(tp / p * ctp / cn) AS pr_auc,
                         sum((n - tp) * (ctp - tp / 2.0)) / max(p * (t - p)) AS roc_auc FROM y GROUP BY 1),
            s AS (SELECT (day - 16) // 5 AS w, any_value(split) AS slice, avg(CASE WHEN addr < 40 THEN 1.0 ELSE 0 END) AS stratum_share FROM st WHERE day >= 16 GROUP BY 1),
            e AS (SELECT w, quantile_cont(ap, 0.025) AS pr_auc_low, quantile_cont(ap, 0.975) AS pr_auc_high,
                         quantile_cont(auc, 0.025) AS roc_auc_low, quantile_cont(auc, 0.975) AS roc_auc_high FROM m GROUP BY 1)
       SELECT w AS "window", 16 + 5 * w AS first_day, 20 + 5 * w AS last_day, false AS partial, slice = 'val_fit' AS optimistic,
              18.0 + 5 * w - 10 AS days_since_training, * EXCLUDE (w) FROM z JOIN s USING (w) JOIN e USING (w)""",
    TXN + "," + DRAWS + "," + WINDOW_METRICS,
)
def decay_windows(spark, d):
    rows = drift_rows(spark, d).where("day >= 16")
    return decay.window_table(rows, 5, BOUNDS, resamples=RESAMPLES)


WINDOW_STATS = TXN + """,
ws AS (SELECT (day - 16) // 5 AS w, avg(is_fraud) AS rate, avg(CASE WHEN addr < 40 THEN 1.0 ELSE 0 END) AS mix, avg(amount) AS m
       FROM txn WHERE day >= 16 GROUP BY 1)
"""


@query(
    "decay_reading",
    "window:i reading:s mix_bound:f beyond_mix:b",
    """WITH x AS (SELECT *, rate + 0.0005 < (SELECT avg(rate) FROM ws) AS pb, m < (SELECT avg(m) FROM ws) AS rb,
                         100 * greatest(0.42 - mix, 0) * 0.001 AS mb FROM ws)
       SELECT w AS "window", CASE WHEN NOT pb THEN 'no decline' WHEN NOT rb THEN 'prevalence' ELSE 'decline' END AS reading, mb AS mix_bound,
              pb AND rb AND (SELECT avg(rate) FROM ws) - rate > mb AS beyond_mix FROM x""",
    WINDOW_STATS,
)
def decay_reading(spark, d):
    rows = drift.window_index(drift_rows(spark, d).where("day >= 16").drop("amount"), 5, 16)
    amounts = txn(spark, d).select("id", "amount")
    table = rows.join(amounts, "id").groupBy("window").agg(
        F.avg("is_fraud").alias("pr_auc"),
        (F.avg("is_fraud") + 0.0005).alias("pr_auc_high"),
        F.avg("amount").alias("roc_auc_high"),
        F.avg(F.col("has_identity").cast("double")).alias("stratum_share"),
    )
    base = table.agg(F.avg("pr_auc").alias("p"), F.avg("roc_auc_high").alias("r")).first()
    return decay.read_windows(table, base["p"], base["r"], 0.001, 0.42)


@query(
    "drift_leads_decay",
    "window:i psi_rank:i flagged:b spearman:f",
    """WITH x AS (SELECT w, m, rate, rank() OVER (ORDER BY m DESC) AS rx, rank() OVER (ORDER BY rate ASC) AS ry FROM ws)
       SELECT w AS "window", rx AS psi_rank, w = 1 AS flagged, (SELECT corr(rx, ry) FROM x) AS spearman FROM x""",
    WINDOW_STATS,
)
def drift_leads_decay(spark, d):
    rows = drift.window_index(txn(spark, d).where("day >= 16"), 5, 16)
    stats = rows.groupBy("window").agg(F.avg("amount").alias("weighted_psi"), F.avg("is_fraud").alias("pr_auc"))
    readings = stats.select(
        "window", "pr_auc", F.lit(False).alias("partial"),
        F.when(F.col("window") == 1, "decline").otherwise("no decline").alias("reading"),
    )
    return drift.leads_decay(stats.select("window", "weighted_psi"), readings, 0.5)


# ---- trigger -------------------------------------------------------------------------------------

TRIGGER = TXN + """,
tw AS (SELECT CASE WHEN day < 29 THEN 'labelled' ELSE 'horizon' END AS horizon, min(day) AS first_day, max(day) AS last_day,
              false AS partial, avg(amount) / 500 AS weighted_psi, avg(score) - 0.2 AS score_psi
       FROM txn WHERE day >= 17 GROUP BY 1, (day - 17) // 3)
"""


def trigger_input(spark, d):
    """Monitoring windows of three days with stand-in indices derived from the data."""
    rows = txn(spark, d).where("day >= 17").withColumn("w", F.floor((F.col("day") - 17) / 3))
    return rows.groupBy(F.when(F.col("day") < 29, "labelled").otherwise("horizon").alias("horizon"), "w").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.lit(False).alias("partial"),
        (F.avg("amount") / 500).alias("weighted_psi"),
        (F.avg("score") - 0.2).alias("score_psi"),
    )


def _read(spark, d):
    return decay.trigger_windows(trigger_input(spark, d), BOUNDS, CONFIG)


@query(
    "trigger_windows",
    "horizon:s first_day:i last_day:i feature_reaches:b feature_fires:b score_fires:b labels_mature_on:i pr_auc_why_not:s",
    """SELECT horizon, first_day, last_day, weighted_psi >= 0.1 AS feature_reaches, weighted_psi >= 0.1 AS feature_fires,
              horizon = 'horizon' AND score_psi >= 0.25 AS score_fires, last_day + 5 AS labels_mature_on,
              CASE horizon WHEN 'labelled' THEN 'inside the baseline' ELSE 'no labels' END AS pr_auc_why_not
       FROM tw WHERE first_day >= 26""",
    TRIGGER,
)
def trigger_windows(spark, d):
    return _read(spark, d)


FIRED = """
WITH f AS (SELECT 1 AS condition, 'feature_psi' AS name, (SELECT min(last_day) FROM tw WHERE first_day >= 26 AND weighted_psi >= 0.1) AS fires_on
           UNION ALL SELECT 2, 'score_psi', (SELECT min(last_day) FROM tw WHERE horizon = 'horizon' AND first_day >= 26 AND score_psi >= 0.25)
           UNION ALL SELECT 3, 'pr_auc', NULL UNION ALL SELECT 4, 'cadence', 116)
"""


@query("trigger_firings", "condition:i name:s fires_on:f", FIRED + "SELECT * FROM f", TRIGGER)
def trigger_firings(spark, d):
    return decay.firings(_read(spark, d), BOUNDS, CONFIG)


@query(
    "trigger_retrain",
    "trigger_day:i labelled_through:i training_ends:i val_fit_start:i val_cal_start:i days_stale:i",
    FIRED + """SELECT min(fires_on) AS trigger_day, min(fires_on) - 5 AS labelled_through, min(fires_on) - 5 - 4 - 5 - 6 AS training_ends,
                      min(fires_on) - 5 - 4 - 5 AS val_fit_start, min(fires_on) - 5 - 4 AS val_cal_start, 20 AS days_stale FROM f""",
    TRIGGER,
)
def trigger_retrain(spark, d):
    first = decay.first_firing(decay.firings(_read(spark, d), BOUNDS, CONFIG))
    return decay.retrain_layout(first, BOUNDS)


@query(
    "trigger_firing_window",
    "horizon:s first_day:i last_day:i",
    FIRED + "SELECT horizon, first_day, last_day FROM tw WHERE first_day >= 26 AND (SELECT min(fires_on) FROM f) BETWEEN first_day AND last_day",
    TRIGGER,
)
def trigger_firing_window(spark, d):
    read = _read(spark, d)
    return decay.firing_window(decay.first_firing(decay.firings(read, BOUNDS, CONFIG)), read)


# ---- explanations ----------------------------------------------------------------------------------

FEATURES = ["amount", "hour", "addr", "card"]
WEIGHTS = {"amount": 0.0101, "hour": -0.0513, "addr": 0.0203, "card": 0.0031}
MEANS = {"amount": 50.0, "hour": 12.0, "addr": 50.0, "card": 70.0}
TIERS = {"amount": "tier_1", "hour": "tier_1", "addr": "tier_2", "card": "tier_0"}
PHRASES = {"amount": "the amount is unusual", "hour": "the time of day is unusual"}

CONTRIB = TXN + """,
cb AS (SELECT *, 0.0101 * (amount - 50) AS c_amount, -0.0513 * (hour - 12) AS c_hour, 0.0203 * (addr - 50) AS c_addr, 0.0031 * (card - 70) AS c_card FROM st),
lg AS (SELECT id, f, c FROM cb UNPIVOT (c FOR f IN (c_amount, c_hour, c_addr, c_card))),
rk AS (SELECT id, f, c, row_number() OVER (PARTITION BY id ORDER BY c DESC) AS r FROM lg WHERE c > 0)
"""


def contribution_rows(spark, d):
    return explain.linear_contributions(split_txn(spark, d), WEIGHTS, MEANS, -1.0)


@query(
    "linear_contributions",
    "id:i c_amount:f c_hour:f c_addr:f c_card:f base:f",
    "SELECT id, c_amount, c_hour, c_addr, c_card, -1 + 0.0101 * 50 - 0.0513 * 12 + 0.0203 * 50 + 0.0031 * 70 AS base FROM cb",
    CONTRIB,
)
def linear_contributions(spark, d):
    return contribution_rows(spark, d).withColumn("base", F.col(BASE_VALUE))


@query(
    "contribution_additivity",
    "deviation:f base_low:f base_high:f",
    "SELECT 0.0 AS deviation, -1 + 0.0101 * 50 - 0.0513 * 12 + 0.0203 * 50 + 0.0031 * 70 AS base_low, -1 + 0.0101 * 50 - 0.0513 * 12 + 0.0203 * 50 + 0.0031 * 70 AS base_high",
    CONTRIB,
)
def contribution_additivity(spark, d):
    margin = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(-1.0))
    rows = contribution_rows(spark, d).withColumn("margin", margin)
    return explain.additivity(rows, [f"c_{c}" for c in FEATURES], "margin")


@query(
    "contribution_ranking",
    "feature:s tier:s mean_abs:f mean_signed:f",
    """SELECT substr(f, 3) AS feature, CASE substr(f, 3) WHEN 'addr' THEN 'tier_2' WHEN 'card' THEN 'tier_0' ELSE 'tier_1' END AS tier,
              avg(abs(c)) AS mean_abs, avg(c) AS mean_signed FROM lg GROUP BY f""",
    CONTRIB,
)
def contribution_ranking(spark, d):
    return explain.ranking(contribution_rows(spark, d), FEATURES, TIERS, "c_")


@query(
    "contribution_tiers",
    "tier:s share:f",
    """WITH m AS (SELECT CASE substr(f, 3) WHEN 'addr' THEN 'tier_2' WHEN 'card' THEN 'tier_0' ELSE 'tier_1' END AS tier, avg(abs(c)) AS a FROM lg GROUP BY f)
       SELECT tier, sum(a) / (SELECT sum(a) FROM m) AS share FROM m GROUP BY 1""",
    CONTRIB,
)
def contribution_tiers(spark, d):
    return explain.tier_shares(explain.ranking(contribution_rows(spark, d), FEATURES, TIERS, "c_"))


def coded_rows(spark, d):
    rows = contribution_rows(spark, d).withColumn("p", F.col("score"))
    return explain.reason_codes(rows, FEATURES, PHRASES, COSTS, 3, prefix="c_")


@query(
    "top_reasons",
    "id:i place:i feature:s contribution:f",
    "SELECT id, r - 1 AS place, substr(f, 3) AS feature, c AS contribution FROM rk WHERE r <= 3",
    CONTRIB,
)
def top_reasons(spark, d):
    rows = contribution_rows(spark, d).select("id", explain.top_reasons(FEATURES, 3, PHRASES, "c_").alias("r"))
    return rows.select("id", F.posexplode("r").alias("place", "r")).select("id", "place", "r.feature", "r.contribution")


@query(
    "reason_codes",
    "id:i decision:s review_eligible:b break_even:f n_reasons:i n_statements:i",
    """SELECT id, CASE WHEN (1 - score) * 15 < score * (amount + 25) THEN 'block' ELSE 'allow' END AS decision,
              least(score * (amount + 25), (1 - score) * 15) - (1.5 + (1 - score) * 3) > 0 AS review_eligible, 15 / (amount + 40) AS break_even,
              (SELECT count(*) FROM rk WHERE rk.id = cb.id AND r <= 3) AS n_reasons,
              (SELECT count(*) FILTER (f IN ('c_amount', 'c_hour')) + CAST(count(*) FILTER (f IN ('c_addr', 'c_card')) > 0 AS INT) FROM rk WHERE rk.id = cb.id AND r <= 3) AS n_statements
       FROM cb""",
    CONTRIB,
)
def reason_codes(spark, d):
    return coded_rows(spark, d).withColumns({"n_reasons": F.size("reasons"), "n_statements": F.size("statements")})


@query(
    "reason_summary",
    "declines:i leading_reason_unnameable:f fully_generic:f at_least_one_named:f",
    """WITH b AS (SELECT id FROM cb WHERE (1 - score) * 15 < score * (amount + 25)),
            x AS (SELECT b.id, min(r) AS any_r, max(CASE WHEN f IN ('c_amount', 'c_hour') THEN 1 ELSE 0 END) AS named,
                         max(CASE WHEN r = 1 AND f IN ('c_addr', 'c_card') THEN 1 ELSE 0 END) AS lead
                  FROM b LEFT JOIN rk ON rk.id = b.id AND r <= 3 GROUP BY 1)
       SELECT count(*) AS declines, avg(lead) FILTER (any_r IS NOT NULL) AS leading_reason_unnameable,
              avg(CASE WHEN any_r IS NOT NULL AND named = 0 THEN 1.0 ELSE 0 END) AS fully_generic, avg(coalesce(named, 0)) AS at_least_one_named FROM x""",
    CONTRIB,
)
def reason_summary(spark, d):
    return explain.summarise_reasons(coded_rows(spark, d))


@query(
    "reason_tiers",
    "tier:s share:f",
    """WITH b AS (SELECT id FROM cb WHERE (1 - score) * 15 < score * (amount + 25)), x AS (SELECT f FROM rk JOIN b USING (id) WHERE r <= 3)
       SELECT CASE substr(f, 3) WHEN 'addr' THEN 'tier_2' WHEN 'card' THEN 'tier_0' ELSE 'tier_1' END AS tier,
              count(*) / (SELECT count(*) FROM x) AS share FROM x GROUP BY 1""",
    CONTRIB,
)
def reason_tiers(spark, d):
    return explain.reason_tiers(coded_rows(spark, d), TIERS)


@query(
    "case_selection",
    "case_name:s id:i",
    """WITH b AS (SELECT id, amount, is_fraud FROM st WHERE score >= 0.5), m AS (SELECT is_fraud, quantile_cont(amount, 0.5) AS med FROM b GROUP BY 1),
            k AS (SELECT b.*, row_number() OVER (PARTITION BY is_fraud ORDER BY abs(amount - med), id) AS rn FROM b JOIN m USING (is_fraud))
       SELECT CASE is_fraud WHEN 1 THEN 'true_positive' ELSE 'false_positive' END AS case_name, id FROM k WHERE rn = 1
       UNION ALL SELECT 'high_value_catch', (SELECT id FROM b WHERE is_fraud = 1 ORDER BY amount DESC, id LIMIT 1)""",
)
def case_selection(spark, d):
    rows = split_txn(spark, d).withColumn("fallback", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return explain.select_cases(rows)


@query(
    "binned_median",
    "product:s bin:i centre:f median:f",
    f"""WITH e AS (SELECT product, list_sort(list_distinct(quantile_cont(amount, {[i / 5 for i in range(6)]}))) AS es FROM st GROUP BY 1),
             b AS (SELECT product, amount, score, greatest(0, least(len(es) - 2, (SELECT count(*) FROM unnest(es) u(x) WHERE x <= amount) - 1)) AS bin FROM st JOIN e USING (product))
        SELECT product, bin, quantile_cont(amount, 0.5) AS centre, quantile_cont(score, 0.5) AS median FROM b GROUP BY 1, 2""",
)
def binned_median(spark, d):
    return explain.binned_median(split_txn(spark, d), "amount", "score", 5, "product")


@query("hash_sample", "id:i", "SELECT id FROM txn ORDER BY md5(concat('0/', id)) LIMIT 500")
def hash_sample(spark, d):
    return explain.take_sample(txn(spark, d).select("id", "amount"), 500, 0)
