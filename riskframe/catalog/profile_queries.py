"""Queries over exploration profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.inputs import split_txn, table, txn, wide_nulls
from riskframe.catalog.feature_queries import WIDE
from riskframe.catalog.registry import TXN, query
from riskframe.operators import profile

DAILY = TXN + """,
d0 AS (SELECT day, sum(is_fraud) AS positives, count(*) AS rows FROM txn GROUP BY 1),
d1 AS (SELECT *, rows - positives AS negatives, positives / rows AS rate FROM d0),
daily AS (SELECT a.*, (SELECT CASE WHEN count(*) = 7 THEN avg(rate) END FROM d1 b WHERE b.day BETWEEN a.day - 3 AND a.day + 3) AS rate_smooth,
                 (SELECT CASE WHEN count(*) = 7 THEN avg(rows) END FROM d1 b WHERE b.day BETWEEN a.day - 3 AND a.day + 3) AS rows_smooth,
                 (SELECT CASE WHEN count(*) = 7 THEN avg(positives) END FROM d1 b WHERE b.day BETWEEN a.day - 3 AND a.day + 3) AS positives_smooth,
                 (SELECT CASE WHEN count(*) = 7 THEN avg(negatives) END FROM d1 b WHERE b.day BETWEEN a.day - 3 AND a.day + 3) AS negatives_smooth
          FROM d1 a)
"""


@query(
    "daily_profile",
    "day:i positives:i rows:i negatives:i rate:f rate_smooth:f rows_smooth:f",
    "SELECT day, positives, rows, negatives, rate, rate_smooth, rows_smooth FROM daily",
    DAILY,
)
def daily_profile(spark, d):
    return profile.daily_profile(txn(spark, d))


@query(
    "daily_extremes",
    "trough_day:i peak_volume_day:i rate_volume_corr:f",
    """SELECT (SELECT day FROM daily WHERE rate_smooth IS NOT NULL ORDER BY round(rate_smooth, 12), day LIMIT 1) AS trough_day,
              (SELECT day FROM daily WHERE rate_smooth IS NOT NULL ORDER BY round(rows_smooth, 9) DESC, day LIMIT 1) AS peak_volume_day,
              (SELECT corr(rate_smooth, rows_smooth) FROM daily WHERE day BETWEEN 1 AND 30 AND rate_smooth IS NOT NULL) AS rate_volume_corr""",
    DAILY,
)
def daily_extremes(spark, d):
    return profile.daily_extremes(profile.daily_profile(txn(spark, d)), 1, 30)


@query(
    "daily_dilution",
    "negative_change:f positive_change:f",
    """SELECT b.negatives_smooth / a.negatives_smooth - 1 AS negative_change, b.positives_smooth / a.positives_smooth - 1 AS positive_change
       FROM daily a, daily b WHERE a.day = 8 AND b.day = 22""",
    DAILY,
)
def daily_dilution(spark, d):
    return profile.dilution(profile.daily_profile(txn(spark, d)), 8, 22)


@query(
    "pooled_rates",
    "first_day:i last_day:i rows:i positives:i rate:f",
    """SELECT a AS first_day, b AS last_day, count(*) AS rows, sum(is_fraud) AS positives, avg(is_fraud) AS rate
       FROM txn JOIN (VALUES (1, 10), (11, 20), (5, 25)) v(a, b) ON day BETWEEN a AND b GROUP BY 1, 2""",
)
def pooled_rates(spark, d):
    return profile.pooled_rates(txn(spark, d), [(1, 10), (11, 20), (5, 25)])


@query(
    "hourly_profile",
    "hour:i positives:i rows:i rate:f",
    "SELECT hour, sum(is_fraud) AS positives, count(*) AS rows, avg(is_fraud) AS rate FROM txn GROUP BY 1",
)
def hourly_profile(spark, d):
    return profile.hourly_profile(txn(spark, d))


HOURLY = TXN + ", hr AS (SELECT hour, sum(is_fraud) AS p, count(*) AS n FROM txn GROUP BY 1)"


@query(
    "hourly_extremes",
    "trough_hour:i peak_hour:i swing:f rate_peak_hour:i",
    """SELECT (SELECT hour FROM hr ORDER BY n, hour LIMIT 1) AS trough_hour, (SELECT hour FROM hr ORDER BY n DESC, hour LIMIT 1) AS peak_hour,
              (SELECT max(n) / min(n) FROM hr) AS swing, (SELECT hour FROM hr ORDER BY p / n DESC, hour LIMIT 1) AS rate_peak_hour""",
    HOURLY,
)
def hourly_extremes(spark, d):
    return profile.hourly_extremes(profile.hourly_profile(txn(spark, d)))


@query(
    "midnight_offsets",
    "midnight:i trough_local:i peak_local:i plausible:b",
    """SELECT m AS midnight, (t - m + 24) % 24 AS trough_local, (p - m + 24) % 24 AS peak_local, (t - m + 24) % 24 BETWEEN 2 AND 6 AS plausible
       FROM (SELECT (SELECT hour FROM hr ORDER BY n, hour LIMIT 1) AS t, (SELECT hour FROM hr ORDER BY n DESC, hour LIMIT 1) AS p),
            (VALUES (4), (5), (6), (8), (10), (12)) v(m)""",
    HOURLY,
)
def midnight_offsets(spark, d):
    extremes = profile.hourly_extremes(profile.hourly_profile(txn(spark, d)))
    return profile.midnight_offsets(extremes, (4, 5, 6, 8, 10, 12))


@query(
    "describe_by_class",
    "is_fraud:i n:i mean:f std:f lowest:f highest:f q25:f q50:f q97_5:f",
    """SELECT is_fraud, count(*) AS n, avg(amount) AS mean, stddev_samp(amount) AS std, min(amount) AS lowest, max(amount) AS highest,
              quantile_cont(amount, 0.25) AS q25, quantile_cont(amount, 0.5) AS q50, quantile_cont(amount, 0.975) AS q97_5 FROM txn GROUP BY 1""",
)
def describe_by_class(spark, d):
    return profile.describe_by(txn(spark, d), "is_fraud", "amount", [0.25, 0.5, 0.975])


TOP = """
  WITH r AS (SELECT is_fraud, amount, row_number() OVER (PARTITION BY is_fraud ORDER BY amount DESC) AS rn,
                    count(*) OVER (PARTITION BY is_fraud) AS n, sum(amount) OVER (PARTITION BY is_fraud) AS t FROM txn)
  SELECT is_fraud, f AS fraction, max(CAST(floor(f * n) AS BIGINT)) AS rows, sum(CASE WHEN rn <= floor(f * n) THEN amount ELSE 0 END) / max(t) AS share
  FROM r, (VALUES {fs}) v(f) GROUP BY 1, 2
"""


@query("top_share", "is_fraud:i fraction:f rows:i share:f", TOP.format(fs="(0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)"))
def top_share(spark, d):
    return profile.top_shares(txn(spark, d), "amount", [0.01, 0.05, 0.1], ["is_fraud"])


@query(
    "recovery_curve",
    "recall:f ranked_by_amount:f gain:f",
    f"SELECT fraction AS recall, share AS ranked_by_amount, share / fraction AS gain FROM ({TOP.format(fs='(0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)')}) WHERE is_fraud = 1",
)
def recovery_curve(spark, d):
    return profile.recovery_curve(txn(spark, d).where("is_fraud = 1"), "amount", [0.05, 0.1, 0.2, 0.3, 0.5])


@query(
    "top_values_ratio",
    "addr:i positives:i positive_share:f negative_share:f ratio:f",
    """WITH c AS (SELECT addr, sum(is_fraud) AS p, sum(1 - is_fraud) AS q FROM txn GROUP BY 1),
            t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM c)
       SELECT addr, p AS positives, p / tp AS positive_share, q / tq AS negative_share, (p / tp) / (q / tq) AS ratio
       FROM c, t WHERE p > 0 ORDER BY p DESC, addr LIMIT 15""",
)
def top_values_ratio(spark, d):
    return profile.top_values_ratio(txn(spark, d), "addr", 15)


@query(
    "exact_ratio",
    "addr:f positives:i ratio:f",
    """WITH t AS (SELECT sum(is_fraud) AS tp, sum(1 - is_fraud) AS tq FROM txn)
       SELECT v AS addr, coalesce(sum(is_fraud), 0) AS positives, (sum(is_fraud) / max(tp)) / nullif(sum(1 - is_fraud) / max(tq), 0) AS ratio
       FROM (VALUES (0), (10), (50), (500)) x(v) LEFT JOIN txn ON addr = v CROSS JOIN t GROUP BY v""",
)
def exact_ratio(spark, d):
    rows = txn(spark, d).withColumn("addr", F.col("addr").cast("double"))
    return profile.exact_ratio(rows, "addr", [0, 10, 50, 500])


@query(
    "ratio_by_segment",
    "exact_value:f segment:s positives:i ratio:f",
    """WITH x AS (SELECT addr % 10 AS v, product AS s, is_fraud FROM txn UNION ALL SELECT addr % 10, 'all', is_fraud FROM txn),
            t AS (SELECT s, sum(is_fraud) AS tp, sum(1 - is_fraud) AS tq FROM x GROUP BY 1)
       SELECT v AS exact_value, s AS segment, sum(is_fraud) AS positives,
              CASE WHEN s = 'all' OR sum(is_fraud) >= 5 THEN (sum(is_fraud) / max(tp)) / nullif(sum(1 - is_fraud) / max(tq), 0) END AS ratio
       FROM x JOIN t USING (s) WHERE v IN (3, 5) GROUP BY 1, 2""",
)
def ratio_by_segment(spark, d):
    rows = txn(spark, d).withColumn("digit", (F.col("addr") % 10).cast("double"))
    return profile.ratio_by(rows, "digit", [3, 5], "product", min_count=5)


@query(
    "log_histogram",
    "is_fraud:i bin:i low:f high:f rows:i share:f",
    """WITH r AS (SELECT log10(min(amount)) AS a, log10(max(amount)) AS b, min(amount) AS lo, max(amount) AS hi FROM txn),
            x AS (SELECT is_fraud, CAST(CASE WHEN amount = lo THEN 0 ELSE least(59, floor((log10(amount) - a) / (b - a) * 60)) END AS INT) AS bin FROM txn, r)
       SELECT is_fraud, bin, CASE bin WHEN 0 THEN max(lo) ELSE 10 ** (max(a) + (max(b) - max(a)) * bin / 60) END AS low,
              CASE bin WHEN 59 THEN max(hi) ELSE 10 ** (max(a) + (max(b) - max(a)) * (bin + 1) / 60) END AS high, count(*) AS rows,
              count(*) / sum(count(*)) OVER (PARTITION BY is_fraud) AS share FROM x, r GROUP BY is_fraud, bin""",
)
def log_histogram(spark, d):
    return profile.log_histogram(txn(spark, d), "amount", 60)


@query(
    "null_profile",
    "family:s columns:i mean:f lowest:f highest:f spread:f matched_mean:f join_artifact:f",
    """WITH j AS (SELECT d.doc_id, quality, toxic, l.doc_id IS NOT NULL AS m FROM documents d LEFT JOIN labels l USING (doc_id)),
            a AS (SELECT avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) AS q, avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END) AS t,
                         avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) FILTER (m) AS qm, avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END) FILTER (m) AS tm FROM j)
       SELECT 'labels' AS family, 2 AS columns, (q + t) / 2 AS mean, least(q, t) AS lowest, greatest(q, t) AS highest, abs(q - t) AS spread,
              (qm + tm) / 2 AS matched_mean, (q + t) / 2 - (qm + tm) / 2 AS join_artifact FROM a
       UNION ALL SELECT 'keys', 1, 0, 0, 0, 0, 0, 0""",
    "",
)
def null_profile(spark, d):
    from riskframe.operators.joins import left_join_flag

    rows = left_join_flag(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "has_label")
    return profile.null_profile(rows, {"labels": ["quality", "toxic"], "keys": ["doc_id"]}, "has_label")


@query(
    "all_null_signal",
    "family:s share_of_rows:f rate_when_null:f rate_otherwise:f lift:f",
    """WITH x AS (SELECT 'first' AS family, v1 IS NULL AND v2 IS NULL AS gone, is_fraud FROM wide
                  UNION ALL SELECT 'second', v4 IS NULL, is_fraud FROM wide UNION ALL SELECT 'both', v1 IS NULL AND v4 IS NULL, is_fraud FROM wide)
       SELECT family, avg(CASE WHEN gone THEN 1.0 ELSE 0 END) AS share_of_rows, avg(is_fraud) FILTER (gone) AS rate_when_null,
              avg(is_fraud) FILTER (NOT gone) AS rate_otherwise, avg(is_fraud) FILTER (gone) / avg(is_fraud) FILTER (NOT gone) AS lift FROM x GROUP BY 1""",
    WIDE,
)
def all_null_signal(spark, d):
    families = {"first": ["v1", "v2"], "second": ["v4"], "both": ["v1", "v4"], "never": ["v6"]}
    return profile.all_null_signal(wide_nulls(spark, d), families)


@query(
    "segment_profile",
    "product:s rows:i share_of_rows:f null_rate:f match_rate:f rate:f share_of_positives:f share_of_positive_amount:f median_amount:f",
    """SELECT product, count(*) AS rows, count(*) / (SELECT count(*) FROM txn) AS share_of_rows, avg(CASE WHEN addr < 10 THEN 1.0 ELSE 0 END) AS null_rate,
              avg(CASE WHEN addr > 50 THEN 1.0 ELSE 0 END) AS match_rate, avg(is_fraud) AS rate, sum(is_fraud) / (SELECT sum(is_fraud) FROM txn) AS share_of_positives,
              sum(amount * is_fraud) / (SELECT sum(amount * is_fraud) FROM txn) AS share_of_positive_amount, quantile_cont(amount, 0.5) AS median_amount
       FROM txn GROUP BY 1""",
)
def segment_profile(spark, d):
    rows = txn(spark, d).withColumns({"gone": F.col("addr") < 10, "matched": F.col("addr") > 50})
    return profile.segment_profile(rows, "product", "gone", "matched")


@query(
    "within_segment_lift",
    "segment:s n_flagged:i rate_when_flagged:f rate_otherwise:f lift:f",
    """WITH x AS (SELECT product AS s, addr < 30 AS f, is_fraud FROM txn UNION ALL SELECT 'all', addr < 30, is_fraud FROM txn)
       SELECT s AS segment, count(*) FILTER (f) AS n_flagged, avg(is_fraud) FILTER (f) AS rate_when_flagged, avg(is_fraud) FILTER (NOT f) AS rate_otherwise,
              avg(is_fraud) FILTER (f) / avg(is_fraud) FILTER (NOT f) AS lift FROM x GROUP BY 1""",
)
def within_segment_lift(spark, d):
    return profile.within_lift(txn(spark, d).withColumn("f", F.col("addr") < 30), "product", "f")


@query(
    "quantile_gap",
    "product:s prob:f gap:f",
    """WITH g AS (SELECT product, p, quantile_cont(amount, 0.1) FILTER (is_fraud = 1) - quantile_cont(amount, 0.1) FILTER (is_fraud = 0) AS a,
                         quantile_cont(amount, 0.9) FILTER (is_fraud = 1) - quantile_cont(amount, 0.9) FILTER (is_fraud = 0) AS b, sum(is_fraud) AS n
                  FROM txn, (VALUES (0.1), (0.9)) v(p) GROUP BY 1, 2)
       SELECT product, p AS prob, CASE p WHEN 0.1 THEN a ELSE b END AS gap FROM g WHERE n >= 68""",
)
def quantile_gap(spark, d):
    return profile.quantile_gap(txn(spark, d), "product", "amount", [0.1, 0.9], 68)


LEVELS = TXN + """,
lc AS (SELECT 'card' AS c, CAST(card AS VARCHAR) AS level, count(*) AS n, sum(is_fraud) AS p FROM txn GROUP BY card
       UNION ALL SELECT 'product', product, count(*), sum(is_fraud) FROM txn GROUP BY product
       UNION ALL SELECT 'area', CAST(CASE WHEN addr >= 20 THEN addr % 10 END AS VARCHAR), count(*), sum(is_fraud) FROM txn GROUP BY CASE WHEN addr >= 20 THEN addr % 10 END)
"""


def level_rows(spark, d):
    return txn(spark, d).withColumn("area", F.when(F.col("addr") >= 20, F.col("addr") % 10))


@query(
    "entity_profile",
    "column:s levels:i null_rate:f top_share:f",
    """SELECT c AS "column", count(level) AS levels, coalesce(sum(n) FILTER (level IS NULL), 0) / sum(n) AS null_rate,
              (SELECT sum(n) FROM (SELECT n FROM lc b WHERE b.c = a.c AND level IS NOT NULL ORDER BY n DESC LIMIT 10)) / sum(n) FILTER (level IS NOT NULL) AS top_share
       FROM lc a GROUP BY c""",
    LEVELS,
)
def entity_profile(spark, d):
    return profile.entity_profile(level_rows(spark, d), ["card", "product", "area"])


@query(
    "level_stats",
    "column:s level:s rows:i positives:i rate:f",
    """SELECT c AS "column", coalesce(level, 'null') AS level, n AS rows, p AS positives, p / n AS rate FROM lc WHERE n >= 70""",
    LEVELS,
)
def level_stats(spark, d):
    stats = profile.level_stats(level_rows(spark, d), ["card", "product", "area"], 70)
    return stats.withColumn("level", F.coalesce("level", F.lit("null")))


@query(
    "level_separation",
    "column:s levels_kept:i rows_covered:f min_rate:f max_rate:f spread:f",
    """SELECT c AS "column", count(*) FILTER (n >= 500) AS levels_kept, sum(n) FILTER (n >= 500) / sum(n) AS rows_covered, min(p / n) FILTER (n >= 500) AS min_rate,
              max(p / n) FILTER (n >= 500) AS max_rate, max(p / n) FILTER (n >= 500) / min(p / n) FILTER (n >= 500) AS spread
       FROM lc GROUP BY c HAVING count(*) FILTER (n >= 500) >= 2""",
    LEVELS,
)
def level_separation(spark, d):
    return profile.separation(level_rows(spark, d), ["card", "product", "area"], 500)


@query(
    "level_capture",
    "column:s levels_used:i volume_covered:f captured:f lift:f",
    """WITH t AS (SELECT c, sum(n) AS tn, sum(p) AS tp FROM lc GROUP BY c),
            k AS (SELECT lc.*, p / n AS r FROM lc WHERE n >= 60),
            b AS (SELECT a.c, a.level, any_value(a.n) AS n, any_value(a.p) AS p,
                         coalesce(sum(x.n), 0) AS ahead FROM k a LEFT JOIN k x ON x.c = a.c AND (x.r > a.r OR (x.r = a.r AND (x.n > a.n OR (x.n = a.n AND x.level < a.level))))
                  GROUP BY a.c, a.level)
       SELECT c AS "column", count(*) AS levels_used, sum(n) / max(tn) AS volume_covered, sum(p) / max(tp) AS captured, (sum(p) / max(tp)) / (sum(n) / max(tn)) AS lift
       FROM b JOIN t USING (c) WHERE ahead / tn < 0.1 GROUP BY c""",
    LEVELS,
)
def level_capture(spark, d):
    return profile.capture_at(level_rows(spark, d), ["card", "product", "area"], 0.10, 60)


@query(
    "flag_agreement",
    "agreement:f same_null_mask:b",
    """SELECT avg(CASE WHEN (product = 'click') = (addr < 50) THEN 1.0 ELSE 0 END) AS agreement, true AS same_null_mask FROM txn""",
)
def flag_agreement(spark, d):
    rows = split_txn(spark, d).withColumns(
        {"a": F.when(F.col("addr") > 5, F.col("addr")), "b": F.when(F.col("addr") > 5, F.col("card"))}
    )
    return profile.agreement(rows, F.col("product") == "click", F.col("addr") < 50, "a", "b")


@query(
    "smoothed_volume",
    "day:i rows_smooth:f",
    "SELECT day, rows_smooth FROM daily",
    DAILY,
)
def smoothed_volume(spark, d):
    return profile.daily_profile(txn(spark, d)).select("day", "rows_smooth")
