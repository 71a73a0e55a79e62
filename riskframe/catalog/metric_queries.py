"""Queries over ranking metrics, probability quality, costs and policies."""

from __future__ import annotations


from pyspark.sql import functions as F

from riskframe.catalog.inputs import BOUNDS, split_txn, txn
from riskframe.catalog.registry import TXN, query
from riskframe.config import Costs, default_grids, sweep_scenarios
from riskframe.functions import scalar as S
from riskframe.operators import cost, ranking
from riskframe.plans.ordering import prefix_sums

COSTS = Costs()
CAPACITY = 0.01
SPLIT_ROWS = "split is not null"


def decision_rows(spark, d):
    """Transactions with two probabilities and a coarse points score."""
    return split_txn(spark, d).withColumns(
        {
            "calibrated": F.col("score"),
            "uncalibrated": F.col("score") * F.col("score"),
            "rules_score": F.pmod(F.col("id") * 31, F.lit(7)).cast("double"),
        }
    )


# Realised and expected costs of the published matrix, as the oracles need them.
DEC = TXN + """,
dec AS (
  SELECT *, score AS calibrated, score * score AS uncalibrated, CAST((id * 31) % 7 AS DOUBLE) AS rules_score FROM st),
rng AS (
  SELECT split, score, count(*) AS n, sum(is_fraud) AS tp FROM st WHERE split IS NOT NULL GROUP BY 1, 2),
cum AS (
  SELECT a.split, a.score, any_value(a.n) AS n, any_value(a.tp) AS tp, sum(b.n) AS cn, sum(b.tp) AS ctp
  FROM rng a JOIN rng b ON a.split = b.split AND b.score >= a.score GROUP BY 1, 2)
"""

# ---- ranking ---------------------------------------------------------------------------------


@query(
    "ranking_metrics",
    "split:s n:i positives:i base_rate:f pr_auc:f roc_auc:f",
    """WITH t AS (SELECT split, sum(n) AS nn, sum(tp) AS pp FROM rng GROUP BY 1)
       SELECT split, max(nn) AS n, max(pp) AS positives, max(pp) / max(nn) AS base_rate,
              sum(tp / pp * ctp / cn) AS pr_auc,
              sum((n - tp) * (ctp - tp / 2.0)) / (max(pp) * (max(nn) - max(pp))) AS roc_auc
       FROM cum JOIN t USING (split) GROUP BY 1""",
    DEC,
)
def ranking_metrics(spark, d):
    rows = split_txn(spark, d).where(SPLIT_ROWS)
    return ranking.check_two_classes(ranking.ranking_metrics(rows, groups=["split"]))


@query(
    "pr_curve",
    "split:s score:f precision:f recall:f",
    """SELECT split, score, CAST(ctp AS DOUBLE) / cn AS "precision",
              CAST(ctp AS DOUBLE) / (SELECT sum(tp) FROM rng r WHERE r.split = c.split) AS recall FROM cum c""",
    DEC,
)
def pr_curve(spark, d):
    return ranking.pr_curve(split_txn(spark, d).where(SPLIT_ROWS), groups=["split"])


@query(
    "weighted_pr_auc",
    "split:s pr_auc:f",
    """WITH w AS (SELECT split, score, sum(1 + addr % 3) AS n, sum((1 + addr % 3) * is_fraud) AS tp FROM st
                  WHERE split IS NOT NULL GROUP BY 1, 2)
       SELECT split, sum(tp / (SELECT sum(tp) FROM w x WHERE x.split = a.split) * ctp / cn) AS pr_auc FROM (
         SELECT a.split, a.score, any_value(a.tp) AS tp, sum(b.n) AS cn, sum(b.tp) AS ctp
         FROM w a JOIN w b ON a.split = b.split AND b.score >= a.score GROUP BY 1, 2) a GROUP BY 1""",
)
def weighted_pr_auc(spark, d):
    rows = split_txn(spark, d).where(SPLIT_ROWS).withColumn("w", 1 + F.col("addr") % 3)
    return ranking.ranking_metrics(rows, groups=["split"], weight="w")


CAPS = [0.01, 0.05, 0.2]
CURVE = [min(1.0, 0.001 * ((0.1 / 0.001) ** (1 / 24)) ** i) for i in range(25)]


def _values(caps) -> str:
    return ", ".join(f"({c!r}::DOUBLE)" for c in caps)


CAPACITY_SQL = """
  WITH r AS (SELECT {keys} day, is_fraud, score, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, id) AS rn,
                    lead(score) OVER (PARTITION BY {part} ORDER BY score DESC, id) AS nxt,
                    count(*) OVER (PARTITION BY {part}) AS n FROM st WHERE split IS NOT NULL),
       c AS (SELECT r.*, cap, CAST(floor(n * cap) AS BIGINT) AS q FROM r, (VALUES {caps}) v(cap)),
       g AS (SELECT {keys} cap, day, max(q) AS q, sum(is_fraud) AS p, sum(CASE WHEN rn <= q THEN is_fraud ELSE 0 END) AS hit,
                    sum(CASE WHEN rn = q AND nxt = score THEN 1 ELSE 0 END) AS amb FROM c GROUP BY {keys} cap, day)
  SELECT {keys} cap AS capacity, sum(q) AS reviewed, sum(hit) AS caught, sum(p) AS positives, sum(amb) AS ambiguous_days,
         CAST(sum(hit) AS DOUBLE) / sum(p) AS recall, CAST(sum(least(q, p)) AS DOUBLE) / sum(p) AS recall_ceiling,
         CAST(sum(hit) AS DOUBLE) / nullif(sum(least(q, p)), 0) AS share_of_ceiling
  FROM g GROUP BY {keys} cap
"""


@query(
    "recall_at_capacity",
    "split:s capacity:f reviewed:i caught:i positives:i ambiguous_days:i recall:f recall_ceiling:f share_of_ceiling:f",
    CAPACITY_SQL.format(keys="split,", part="split, day", caps=_values(CAPS)),
)
def recall_at_capacity(spark, d):
    return ranking.recall_at_capacity(split_txn(spark, d).where(SPLIT_ROWS), [0.01, 0.05, 0.2], groups=["split"])


@query(
    "recall_ceiling",
    "capacity:f recall_ceiling:f",
    f"SELECT capacity, recall_ceiling FROM ({CAPACITY_SQL.format(keys='', part='day', caps=_values(CAPS))})",
)
def recall_ceiling(spark, d):
    return ranking.recall_ceiling(split_txn(spark, d).where(SPLIT_ROWS), [0.01, 0.05, 0.2])


@query(
    "recall_curve",
    "capacity:f recall:f recall_ceiling:f",
    f"""SELECT capacity, recall, recall_ceiling FROM ({CAPACITY_SQL.format(keys='split,', part='split, day', caps=_values(CURVE))})
        WHERE split = 'test'""",
)
def recall_curve(spark, d):
    return ranking.recall_curve(split_txn(spark, d).where("split = 'test'"))


@query(
    "metric_record",
    "split:s n:i pr_auc:f roc_auc:f capacity:f caught:i",
    f"""WITH t AS (SELECT split, sum(n) AS nn, sum(tp) AS pp FROM rng GROUP BY 1),
            m AS (SELECT split, max(nn) AS n, sum(tp / pp * ctp / cn) AS pr_auc,
                         sum((n - tp) * (ctp - tp / 2.0)) / (max(pp) * (max(nn) - max(pp))) AS roc_auc
                  FROM cum JOIN t USING (split) GROUP BY 1)
       SELECT split, n, pr_auc, roc_auc, capacity, caught FROM m JOIN ({CAPACITY_SQL.format(keys='split,', part='split, day', caps=_values(CAPS))}) USING (split)
       WHERE capacity < 0.1""",
    DEC,
)
def metric_record(spark, d):
    record = ranking.evaluate(split_txn(spark, d).where(SPLIT_ROWS), [0.01, 0.05])
    return record.select("split", "n", "pr_auc", "roc_auc", F.inline("recall_at_capacity"))


@query(
    "prefix_sum",
    "score:f cum_n:i total_n:i cum_amount:m",
    """WITH g AS (SELECT score, count(*) AS n, sum(amount) AS amount FROM txn GROUP BY 1)
       SELECT a.score, sum(b.n) AS cum_n, (SELECT sum(n) FROM g) AS total_n, sum(b.amount) AS cum_amount
       FROM g a JOIN g b ON b.score <= a.score GROUP BY a.score""",
)
def prefix_sum(spark, d):
    steps = txn(spark, d).groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return prefix_sums(steps, "score", ["n", "amount"])


# ---- probability quality -----------------------------------------------------------------------

RELIABILITY = TXN + f""",
e AS (SELECT split, list_sort(list_distinct(quantile_cont(score, {[i / 10 for i in range(11)]}))) AS edges
      FROM st WHERE split IS NOT NULL GROUP BY 1),
b AS (SELECT st.split, greatest(0, least(len(edges) - 2, (SELECT count(*) FROM unnest(edges) u(x) WHERE x <= score + 1e-12) - 1)) AS bin, score, is_fraud
      FROM st JOIN e USING (split))
"""


@query(
    "reliability_bins",
    "split:s bin:i rows:i mean_probability:f rate:f",
    "SELECT split, bin, count(*) AS rows, avg(score) AS mean_probability, avg(is_fraud) AS rate FROM b GROUP BY 1, 2",
    RELIABILITY,
)
def reliability_bins(spark, d):
    return ranking.reliability_bins(split_txn(spark, d).where(SPLIT_ROWS), "is_fraud", "score", 10, ["split"])


@query(
    "calibration_error",
    "split:s ece:f",
    """SELECT split, sum(abs(m - r) * n) / sum(n) AS ece FROM (
         SELECT split, bin, count(*) AS n, avg(score) AS m, avg(is_fraud) AS r FROM b GROUP BY 1, 2) GROUP BY 1""",
    RELIABILITY,
)
def calibration_error(spark, d):
    rows = split_txn(spark, d).where(SPLIT_ROWS)
    return ranking.expected_calibration_error(
        ranking.reliability_bins(rows, "is_fraud", "score", 10, ["split"]), ["split"]
    )


@query(
    "calibration_metrics",
    "fold:i rows:i positives:i brier:f log_loss:f",
    """SELECT (day - 21) // 1 AS fold, count(*) AS rows, sum(is_fraud) AS positives, avg((score - is_fraud) ** 2) AS brier,
              avg(CASE WHEN is_fraud = 1 THEN -ln(greatest(score, 2.220446049250313e-16)) ELSE -ln(1 - least(score, 1 - 2.220446049250313e-16)) END) AS log_loss
       FROM st WHERE split = 'val_cal' GROUP BY 1""",
)
def calibration_metrics(spark, d):
    rows = split_txn(spark, d).where("split = 'val_cal'").withColumn("fold", F.col("day") - 21)
    return ranking.fold_metrics(rows, "is_fraud", "score", 10)


# ---- mix and spread ------------------------------------------------------------------------------


@query(
    "metric_cells",
    "side:s stratum:s n:i positives:i base_rate:f",
    """WITH x AS (SELECT split AS side, addr < 40 AS ident, is_fraud FROM st WHERE split IN ('train', 'val_fit', 'val_cal')
                  UNION ALL SELECT 'validation', addr < 40, is_fraud FROM st WHERE split IN ('val_fit', 'val_cal')),
            y AS (SELECT side, 'all' AS stratum, is_fraud FROM x
                  UNION ALL SELECT side, CASE WHEN ident THEN 'identity' ELSE 'no_identity' END, is_fraud FROM x)
       SELECT side, stratum, count(*) AS n, sum(is_fraud) AS positives, avg(is_fraud) AS base_rate FROM y GROUP BY 1, 2""",
)
def metric_cells(spark, d):
    return ranking.cells(split_txn(spark, d).withColumn("has_identity", F.col("addr") < 40), "has_identity")


@query(
    "metric_cells_recall",
    "side:s stratum:s capacity:f reviewed:i caught:i positives:i recall:f recall_ceiling:f",
    """WITH x AS (SELECT split AS side, addr < 40 AS ident, id, day, score, is_fraud FROM st WHERE split IN ('train', 'val_fit', 'val_cal')
                  UNION ALL SELECT 'validation', addr < 40, id, day, score, is_fraud FROM st WHERE split IN ('val_fit', 'val_cal')),
            y AS (SELECT side, 'all' AS stratum, id, day, score, is_fraud FROM x
                  UNION ALL SELECT side, CASE WHEN ident THEN 'identity' ELSE 'no_identity' END, id, day, score, is_fraud FROM x),
            r AS (SELECT *, row_number() OVER (PARTITION BY side, stratum, day ORDER BY score DESC, id) AS place,
                         count(*) OVER (PARTITION BY side, stratum, day) AS n FROM y),
            q AS (SELECT side, stratum, capacity, day, any_value(floor(n * capacity)) AS quota, sum(is_fraud) AS p,
                         sum(is_fraud) FILTER (place <= floor(n * capacity)) AS got
                  FROM r CROSS JOIN (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE)) c(capacity) GROUP BY ALL)
       SELECT side, stratum, capacity, sum(quota) AS reviewed, coalesce(sum(got), 0) AS caught, sum(p) AS positives,
              coalesce(sum(got), 0) / sum(p) AS recall, sum(least(quota, p)) / sum(p) AS recall_ceiling FROM q GROUP BY 1, 2, 3""",
)
def metric_cells_recall(spark, d):
    rows = split_txn(spark, d).withColumn("has_identity", F.col("addr") < 40)
    found = ranking.cells(rows, "has_identity", capacities=[0.01, 0.05, 0.2])
    return found.select("side", "stratum", F.inline("recall_at_capacity"))


@query(
    "mix_decomposition",
    "train_pr_auc:f validation_pr_auc:f reweighted_pr_auc:f compositional:f remainder:f",
    """WITH s AS (SELECT avg(CASE WHEN addr < 40 THEN 1.0 ELSE 0 END) FILTER (split = 'train') AS tr,
                         avg(CASE WHEN addr < 40 THEN 1.0 ELSE 0 END) FILTER (split IN ('val_fit', 'val_cal')) AS va FROM st),
            x AS (SELECT 'train' AS side, score, is_fraud, 1.0::DOUBLE AS w FROM st WHERE split = 'train'
                  UNION ALL SELECT 'raw', score, is_fraud, 1.0 FROM st WHERE split IN ('val_fit', 'val_cal')
                  UNION ALL SELECT 'rew', score, is_fraud, CASE WHEN addr < 40 THEN tr / va ELSE (1 - tr) / (1 - va) END
                  FROM st, s WHERE split IN ('val_fit', 'val_cal')),
            g AS (SELECT side, score, sum(w) AS n, sum(w * is_fraud) AS tp FROM x GROUP BY 1, 2),
            c AS (SELECT a.side, a.score, any_value(a.tp) AS tp, sum(b.n) AS cn, sum(b.tp) AS ctp
                  FROM g a JOIN g b ON a.side = b.side AND b.score >= a.score GROUP BY 1, 2),
            m AS (SELECT side, sum(tp / (SELECT sum(tp) FROM g WHERE g.side = c.side) * ctp / cn) AS ap FROM c GROUP BY 1),
            v AS (SELECT max(ap) FILTER (side = 'train') AS t, max(ap) FILTER (side = 'raw') AS r, max(ap) FILTER (side = 'rew') AS w FROM m)
       SELECT t AS train_pr_auc, r AS validation_pr_auc, w AS reweighted_pr_auc, w - r AS compositional, (t - r) - (w - r) AS remainder FROM v""",
)
def mix_decomposition(spark, d):
    rows = split_txn(spark, d).withColumn("has_identity", F.col("addr") < 40)
    return ranking.decompose(
        rows.where("split = 'train'"), rows.where("split in ('val_fit', 'val_cal')"), "has_identity"
    )


RUNS = TXN + """,
runs AS (SELECT product AS arm, weekday AS seed, avg(amount) AS metric FROM txn GROUP BY 1, 2)
"""


def _runs(spark, d):
    return txn(spark, d).groupBy(F.col("product").alias("arm"), F.col("weekday").alias("seed")).agg(
        F.avg("amount").alias("metric")
    )


@query(
    "spread_summary",
    "arm:s runs:i mean:f std:f lowest:f highest:f",
    """SELECT arm, count(*) AS runs, avg(metric) AS mean, stddev_samp(metric) AS std, min(metric) AS lowest,
              max(metric) AS highest FROM runs GROUP BY 1""",
    RUNS,
)
def spread_summary(spark, d):
    return ranking.spread_summary(_runs(spark, d), "metric", ["arm"])


@query(
    "spread_acceptance",
    "gap:f noise:f accepted:b",
    """WITH s AS (SELECT arm, avg(metric) AS m, stddev_samp(metric) AS s FROM runs GROUP BY 1),
            v AS (SELECT max(m) FILTER (arm = 'click') - max(m) FILTER (arm = 'view') AS gap,
                         sum(s) FILTER (arm IN ('click', 'view')) AS noise FROM s)
       SELECT gap, noise, gap > noise AS accepted FROM v""",
    RUNS,
)
def spread_acceptance(spark, d):
    return ranking.acceptance(ranking.spread_summary(_runs(spark, d), "metric", ["arm"]), "click", "view", "arm")


@query(
    "delta_vs_reference",
    "arm:s seed:i delta:f",
    "SELECT arm, seed, metric - (SELECT avg(metric) FROM runs WHERE arm = 'error') AS delta FROM runs",
    RUNS,
)
def delta_vs_reference(spark, d):
    return ranking.delta_vs_reference(_runs(spark, d), "metric", "arm", "error")


@query(
    "floor_summary",
    "width:i max_abs_delta:f std:f",
    """SELECT seed % 3 AS width, max(abs(delta)) AS max_abs_delta, stddev_samp(delta) AS std FROM (
         SELECT seed, metric - (SELECT avg(metric) FROM runs WHERE arm = 'error') AS delta FROM runs) GROUP BY 1""",
    RUNS,
)
def floor_summary(spark, d):
    deltas = ranking.delta_vs_reference(_runs(spark, d), "metric", "arm", "error")
    return ranking.floor_summary(deltas.withColumn("width", F.col("seed") % 3))


@query(
    "rank_descending",
    "day:i place:f",
    """WITH c AS (SELECT day, sum(is_fraud) AS p FROM txn GROUP BY 1)
       SELECT day, (SELECT count(*) FROM c b WHERE b.p > a.p) + ((SELECT count(*) FROM c b WHERE b.p = a.p) + 1) / 2.0 AS place FROM c a""",
)
def rank_descending(spark, d):
    days = txn(spark, d).groupBy("day").agg(F.sum("is_fraud").alias("p"))
    return ranking.rank_desc(days, "p", "place")


# ---- decisions -------------------------------------------------------------------------------------


@query(
    "input_violations",
    "not_finite:i p_outside:i amount_negative:i",
    """SELECT sum(CASE WHEN addr = 1 THEN 1 ELSE 0 END) AS not_finite, sum(CASE WHEN addr <> 1 AND score * 1.2 > 1 THEN 1 ELSE 0 END) AS p_outside,
              sum(CASE WHEN amount < 1 THEN 1 ELSE 0 END) AS amount_negative FROM txn""",
)
def input_violations(spark, d):
    rows = txn(spark, d).select(
        F.when(F.col("addr") != 1, F.col("score") * 1.2).alias("p"), (F.col("amount") - 1).alias("amount")
    )
    return cost.input_violations(rows)


@query(
    "expected_costs",
    "id:i break_even:f allow:f block:f review:f action:s",
    """SELECT id, 15 / (amount + 40) AS break_even, score * (amount + 25) AS allow, (1 - score) * 15 AS block,
              1.5 + (1 - score) * 3 AS review,
              CASE WHEN (1 - score) * 15 < score * (amount + 25) THEN 'block' ELSE 'allow' END AS action FROM txn""",
)
def expected_costs(spark, d):
    expected = cost.expected_costs("score", "amount", COSTS)
    return txn(spark, d).select(
        "id",
        cost.break_even("amount", COSTS).alias("break_even"),
        *[c.alias(name) for name, c in expected.items()],
        cost.allow_or_block("score", "amount", COSTS).alias("action"),
    )


@query(
    "realised_cost",
    "action:s rows:i cost:m",
    """SELECT a AS action, count(*) AS rows,
              sum(CASE a WHEN 'allow' THEN is_fraud * (amount + 25) WHEN 'block' THEN (1 - is_fraud) * 15
                         ELSE 1.5 + (1 - is_fraud) * 3 END) AS cost
       FROM (SELECT *, CASE addr % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' ELSE 'review' END AS a FROM txn) GROUP BY 1""",
)
def realised_cost(spark, d):
    action = F.element_at(F.array(F.lit("allow"), F.lit("block"), F.lit("review")), F.col("addr") % 3 + 1)
    rows = txn(spark, d).withColumn("action", action)
    return rows.groupBy("action").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(cost.realised_cost("action", "is_fraud", "amount", COSTS)).alias("cost")
    )


@query(
    "review_shares",
    "id:i review_share:f",
    """WITH e AS (SELECT id, day, rules_score, amount > 20 AS ok FROM dec),
            n AS (SELECT day, floor(0.02 * count(*) + 1e-9) AS cap FROM e GROUP BY 1),
            k AS (SELECT day, rules_score, count(*) AS m FROM e WHERE ok GROUP BY 1, 2),
            a AS (SELECT k.day, k.rules_score, any_value(k.m) AS m, coalesce(sum(b.m), 0) AS above
                  FROM k LEFT JOIN k b ON b.day = k.day AND b.rules_score > k.rules_score GROUP BY 1, 2)
       SELECT id, CASE WHEN NOT ok THEN 0.0 WHEN above >= cap THEN 0.0 WHEN above + m <= cap THEN 1.0 ELSE (cap - above) / m END AS review_share
       FROM e JOIN n USING (day) LEFT JOIN a USING (day, rules_score)""",
    DEC,
)
def review_shares(spark, d):
    return cost.review_shares(decision_rows(spark, d), "rules_score", 0.02, F.col("amount") > 20)


# Expected-value and rules policies written out row by row, for one costing.
EV = """
base{s} AS (SELECT *, {p} * (amount + {fee}) AS c_allow, (1 - {p}) * {fp} AS c_block, 1.5 + (1 - {p}) * 3.0 AS c_review FROM {src}),
gain{s} AS (SELECT *, least(c_allow, c_block) - c_review AS gain, CASE WHEN c_block < c_allow THEN 'block' ELSE 'allow' END AS fallback FROM base{s}),
rank{s} AS (SELECT *, floor({cap} * count(*) OVER (PARTITION BY day) + 1e-9) AS capacity_left,
                   sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY gain DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                   count(*) OVER (PARTITION BY day, gain) AS tied FROM gain{s}),
ev{s} AS (SELECT *, CASE WHEN gain <= 0 THEN 0.0 WHEN upto <= capacity_left THEN 1.0 WHEN upto - tied >= capacity_left THEN 0.0
                         ELSE (capacity_left - (upto - tied)) / tied END AS share FROM rank{s})"""

ROW_COST = """share * (1.5 + (1 - is_fraud) * 3.0) + (1 - share) *
  CASE fallback WHEN 'block' THEN (1 - is_fraud) * {fp} ELSE is_fraud * (amount + {fee}) END"""


def ev_sql(s: str = "", p: str = "score", src: str = "test", cap: float = 0.01, fee: float = 25.0, fp: float = 15.0) -> str:
    return EV.format(s=s, p=p, src=src, cap=cap, fee=fee, fp=fp)


def summary_sql(src: str, name: str, fee: float = 25.0, fp: float = 15.0) -> str:
    c = ROW_COST.format(fee=fee, fp=fp)
    return f"""SELECT '{name}' AS policy, count(*) AS rows, sum({c}) / count(*) * 1000 AS usd_per_1000,
      sum(share) / count(DISTINCT day) AS reviews_per_day,
      avg((1 - share) * CASE WHEN fallback = 'block' THEN 1 ELSE 0 END) AS block_rate FROM {src}"""


TEST = DEC + ",\ntest AS (SELECT * FROM dec WHERE split = 'test')"


@query(
    "ev_policy_summary",
    "rows:i usd_per_1000:f reviews_per_day:f block_rate:f",
    summary_sql("ev", "ev"),
    TEST + "," + ev_sql(),
)
def ev_policy_summary(spark, d):
    rows = split_txn(spark, d).where("split = 'test'").withColumn("p", F.col("score"))
    first, last = BOUNDS.ranges["test"]
    decided = cost.ev_policy(rows, COSTS, CAPACITY, day_bound=last - first + 1)
    return cost.policy_summary(decided, COSTS)


@query(
    "ev_policy_rows",
    "id:i fallback:s review_share:f cost:f",
    f"SELECT id, fallback, share AS review_share, {ROW_COST.format(fee=25.0, fp=15.0)} AS cost FROM ev",
    DEC + "," + ev_sql(src="dec", cap=0.02),
)
def ev_policy_rows(spark, d):
    rows = split_txn(spark, d).withColumn("p", F.col("score"))
    decided = cost.ev_policy(rows, COSTS, 0.02, day_bound=BOUNDS.days)
    return decided.withColumn("cost", cost.policy_cost(COSTS))


RULES_POLICY = """
ruled AS (SELECT *, 'allow' AS fallback, floor(0.01 * count(*) OVER (PARTITION BY day) + 1e-9) AS k,
                 count(*) OVER (PARTITION BY day ORDER BY rules_score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                 count(*) OVER (PARTITION BY day, rules_score) AS tied FROM test),
rules_p AS (SELECT *, CASE WHEN upto <= k THEN 1.0 WHEN upto - tied >= k THEN 0.0 ELSE (k - (upto - tied)) / tied END AS share FROM ruled),
naive_p AS (SELECT *, CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END AS fallback, 0.0 AS share FROM test),
even_p AS (SELECT *, CASE WHEN (1 - score) * 15.0 < score * (amount + 25.0) THEN 'block' ELSE 'allow' END AS fallback, 0.0 AS share FROM test),
allow_p AS (SELECT *, 'allow' AS fallback, 0.0 AS share FROM test)"""

POLICIES = TEST + "," + RULES_POLICY + "," + ev_sql() + "," + ev_sql("_u", "uncalibrated")


@query(
    "policy_rehearsal",
    "policy:s usd_per_1000:f reviews_per_day:f block_rate:f reduction_vs_rules:f",
    f"""WITH x AS ({summary_sql('rules_p', 'rules')} UNION ALL {summary_sql('naive_p', 'naive')}
                  UNION ALL {summary_sql('ev_u', 'ev_uncalibrated')} UNION ALL {summary_sql('ev', 'ev')}
                  UNION ALL {summary_sql('even_p', 'break_even')} UNION ALL {summary_sql('allow_p', 'allow')})
       SELECT *, 1 - usd_per_1000 / (SELECT usd_per_1000 FROM x WHERE policy = 'rules') AS reduction_vs_rules FROM x""",
    POLICIES,
)
def policy_rehearsal(spark, d):
    rows = decision_rows(spark, d).where("split = 'test'")
    return cost.rehearse(rows, COSTS, CAPACITY, (*cost.REHEARSED, "break_even", "allow"), day_bound=5)


@query(
    "policy_rates",
    "block_rate:f reviews_per_day:f review_eligible_rate:f",
    """SELECT avg((1 - share) * CASE WHEN fallback = 'block' THEN 1 ELSE 0 END) AS block_rate,
              sum(share) / count(DISTINCT day) AS reviews_per_day,
              avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) AS review_eligible_rate FROM ev""",
    TEST + "," + ev_sql(),
)
def policy_rates(spark, d):
    rows = split_txn(spark, d).where("split = 'test'").withColumn("p", F.col("score"))
    return cost.policy_rates(rows, COSTS, CAPACITY, day_bound=5)


# Low probabilities, so that some cut beats allowing everything.
LOW = TXN + """,
low AS (SELECT *, CASE WHEN is_fraud = 1 THEN 0.02 + score * 0.9 ELSE score * 0.3 END AS p FROM st WHERE split = 'val_cal'),
lc AS (SELECT p, sum(is_fraud * (amount + 25)) AS a, sum((1 - is_fraud) * 15.0) AS b FROM low GROUP BY 1),
cuts AS (SELECT x.p, (SELECT coalesce(sum(a), 0) FROM lc y WHERE y.p < x.p) + (SELECT sum(b) FROM lc y WHERE y.p >= x.p) AS cost,
                (SELECT sum(a) FROM lc) AS allow_all FROM lc x)
"""


def _low(spark, d):
    p = F.when(F.col("is_fraud") == 1, 0.02 + F.col("score") * 0.9).otherwise(F.col("score") * 0.3)
    return split_txn(spark, d).where("split = 'val_cal'").withColumn("p", p)


@query("global_cut_costs", "p:f cost:f allow_all:f", "SELECT p, cost, allow_all FROM cuts", LOW)
def global_cut_costs(spark, d):
    return cost.cut_costs(_low(spark, d), COSTS)


@query(
    "global_cut_best",
    "cut:f cost:f allow_all:f",
    """SELECT max(p) AS cut, min(cost) AS cost, min(allow_all) AS allow_all FROM cuts
       WHERE round(cost, 6) = (SELECT min(round(cost, 6)) FROM cuts)""",
    LOW,
)
def global_cut_best(spark, d):
    return cost.best_global_cut(_low(spark, d), COSTS)


# ---- sensitivity and ladder ------------------------------------------------------------------------


def _scenarios():
    return sweep_scenarios(COSTS, CAPACITY, default_grids())


def _sweep_sql() -> str:
    """All scenarios as one table: ranks of the rules queue per capacity, of expected value per scenario."""
    values = ", ".join(
        f"('{s.assumption}', {float(s.value)}::DOUBLE, {str(s.is_base).lower()}, {float(s.costs.chargeback_fee)}::DOUBLE, "
        f"{float(s.costs.false_positive)}::DOUBLE, {float(s.costs.review)}::DOUBLE, {float(s.costs.review_friction)}::DOUBLE, "
        f"{float(s.capacity)}::DOUBLE)"
        for s in _scenarios()
    )
    row = """share * (review + (1 - is_fraud) * friction) + (1 - share) *
      CASE fallback WHEN 'block' THEN (1 - is_fraud) * fp ELSE is_fraud * (amount + fee) END"""
    window = "PARTITION BY assumption, value, day"
    return TEST + f""",
scen(assumption, value, is_base, fee, fp, review, friction, cap) AS (VALUES {values}),
queued AS (
  SELECT id, cap, CASE WHEN upto <= k THEN 1.0 WHEN upto - tied >= k THEN 0.0 ELSE (k - (upto - tied)) / tied END AS share FROM (
    SELECT id, cap, floor(cap * count(*) OVER (PARTITION BY cap, day) + 1e-9) AS k, count(*) OVER (PARTITION BY cap, day, rules_score) AS tied,
           count(*) OVER (PARTITION BY cap, day ORDER BY rules_score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM test CROSS JOIN (SELECT DISTINCT cap FROM scen))),
met AS (SELECT * FROM test CROSS JOIN scen),
gained AS (
  SELECT *, least(score * (amount + fee), (1 - score) * fp) - (review + (1 - score) * friction) AS gain,
         CASE WHEN (1 - score) * fp < score * (amount + fee) THEN 'block' ELSE 'allow' END AS fallback FROM met),
ranked AS (
  SELECT *, floor(cap * count(*) OVER ({window}) + 1e-9) AS k, count(*) OVER ({window}, gain) AS tied,
         sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER ({window} ORDER BY gain DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM gained),
decided AS (
  SELECT 'rules' AS policy, met.* EXCLUDE (cap), 'allow' AS fallback, share FROM met JOIN queued USING (id, cap)
  UNION ALL BY NAME
  SELECT 'naive' AS policy, met.* EXCLUDE (cap), CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END AS fallback, 0.0 AS share FROM met
  UNION ALL BY NAME
  SELECT 'ev' AS policy, ranked.* EXCLUDE (cap, gain, k, tied, upto),
         CASE WHEN gain <= 0 THEN 0.0 WHEN upto <= k THEN 1.0 WHEN upto - tied >= k THEN 0.0 ELSE (k - (upto - tied)) / tied END AS share FROM ranked),
swept AS (
  SELECT assumption, value, is_base, policy, count(*) AS rows, sum({row}) / count(*) * 1000 AS usd_per_1000,
         sum(share) / count(DISTINCT day) AS reviews_per_day, avg((1 - share) * CASE WHEN fallback = 'block' THEN 1 ELSE 0 END) AS block_rate
  FROM decided GROUP BY ALL)
"""


SWEEP_CTES, SWEEP_ROWS = _sweep_sql(), "SELECT * FROM swept"


def _swept(spark, d):
    return cost.sweep(decision_rows(spark, d).where("split = 'test'"), _scenarios(), day_bound=5)


@query(
    "cost_sweep",
    "assumption:s value:f is_base:b policy:s usd_per_1000:f reviews_per_day:f block_rate:f reduction_vs_rules:f",
    f"""WITH x AS ({SWEEP_ROWS})
       SELECT x.*, 1 - x.usd_per_1000 / r.usd_per_1000 AS reduction_vs_rules
       FROM x JOIN x r ON r.policy = 'rules' AND r.assumption = x.assumption AND r.value = x.value""",
    SWEEP_CTES,
)
def cost_sweep(spark, d):
    return _swept(spark, d)


@query(
    "cost_sweep_verdict",
    "assumption:s min_reduction:f at_value:f max_reduction:f above_win_everywhere:b positive_everywhere:b",
    f"""WITH x AS ({SWEEP_ROWS}), y AS (SELECT x.*, 1 - x.usd_per_1000 / r.usd_per_1000 AS red
                 FROM x JOIN x r ON r.policy = 'rules' AND r.assumption = x.assumption AND r.value = x.value WHERE x.policy = 'ev')
       SELECT assumption, min(red) AS min_reduction, arg_min(value, red) AS at_value, max(red) AS max_reduction,
              bool_and(red >= 0.15) AS above_win_everywhere, bool_and(red > 0) AS positive_everywhere FROM y GROUP BY 1""",
    SWEEP_CTES,
)
def cost_sweep_verdict(spark, d):
    return cost.sweep_verdict(_swept(spark, d))


@query(
    "cost_sweep_pivot",
    "value:f rules_usd:f ev_usd:f reduction:f",
    f"""WITH x AS ({SWEEP_ROWS})
       SELECT value, max(usd_per_1000) FILTER (policy = 'rules') AS rules_usd, max(usd_per_1000) FILTER (policy = 'ev') AS ev_usd,
              1 - max(usd_per_1000) FILTER (policy = 'ev') / max(usd_per_1000) FILTER (policy = 'rules') AS reduction
       FROM x WHERE assumption = 'false_positive' GROUP BY 1""",
    SWEEP_CTES,
)
def cost_sweep_pivot(spark, d):
    return cost.pivot_policies(_swept(spark, d))


CUT_P = ", cut_p AS (SELECT *, CASE WHEN score >= 0.25 THEN 'block' ELSE 'allow' END AS fallback, 0.0 AS share FROM test)"


@query(
    "ladder_steps",
    "from_policy:s to_policy:s usd_per_1000:f points:f",
    f"""WITH x AS ({summary_sql('rules_p', 'rules')} UNION ALL {summary_sql('naive_p', 'naive')} UNION ALL {summary_sql('cut_p', 'global_cut')}
                  UNION ALL {summary_sql('even_p', 'break_even')} UNION ALL {summary_sql('ev', 'ev')}),
            s(a, b) AS (VALUES ('naive', 'global_cut'), ('global_cut', 'break_even'), ('break_even', 'ev'))
       SELECT a AS from_policy, b AS to_policy, y.usd_per_1000 - x.usd_per_1000 AS usd_per_1000,
              100 * (x.usd_per_1000 - y.usd_per_1000) / (SELECT usd_per_1000 FROM x WHERE policy = 'rules') AS points
       FROM s JOIN x ON x.policy = a JOIN x y ON y.policy = b""",
    POLICIES + CUT_P,
)
def ladder_steps(spark, d):
    rows = decision_rows(spark, d).where("split = 'test'")
    summary = cost.rehearse(rows, COSTS, CAPACITY, ("rules", *cost.LADDER), cut=0.25, day_bound=5)
    return cost.ladder_steps(summary)


@query(
    "recorded_differences",
    "policy:s field:s",
    "SELECT 'naive' AS policy, 'block_rate' AS field",
    "",
)
def recorded_differences(spark, d):
    rows = decision_rows(spark, d).where("split = 'test'")
    computed = cost.rehearse(rows, COSTS, CAPACITY, ("rules", "naive"), day_bound=5)
    record = computed.withColumn(
        "block_rate", F.when(F.col("policy") == "naive", F.col("block_rate") + 0.5).otherwise(F.col("block_rate"))
    )
    return cost.recorded_differences(computed, record, ["usd_per_1000", "reviews_per_day", "block_rate"])


@query(
    "row_decisions",
    "id:i decision:s break_even:f review_eligible:b review_priority:f mode:s inputs_present:i",
    """SELECT id, CASE WHEN addr % 10 = 0 THEN 'allow' WHEN (1 - score) * 15 < score * (amount + 25) THEN 'block' ELSE 'allow' END AS decision,
              15 / (amount + 40) AS break_even,
              addr % 10 = 0 OR least(score * (amount + 25), (1 - score) * 15) - (1.5 + (1 - score) * 3) > 0 AS review_eligible,
              CASE WHEN addr % 10 = 0 THEN rules_score ELSE least(score * (amount + 25), (1 - score) * 15) - (1.5 + (1 - score) * 3) END AS review_priority,
              CASE WHEN addr % 10 = 0 THEN 'rules' ELSE 'model' END AS mode,
              CASE WHEN addr % 10 = 0 THEN 2 ELSE 3 END AS inputs_present FROM dec""",
    DEC,
)
def row_decisions(spark, d):
    rows = decision_rows(spark, d).withColumn("probability", F.when(F.col("addr") % 10 != 0, F.col("score")))
    return cost.decide(rows, COSTS, coverage_of=["amount", "product", "probability"], points="rules_score")


@query(
    "band_names",
    "day:i band:s",
    """SELECT day, CASE WHEN avg(score) < 0.49 THEN 'stable' WHEN avg(score) < 0.51 THEN 'moderate' ELSE 'significant' END AS band
       FROM txn GROUP BY 1""",
)
def band_names(spark, d):
    days = txn(spark, d).groupBy("day").agg(F.avg("score").alias("v"))
    return days.select("day", S.band("v", 0.49, 0.51).alias("band"))
