"""Queries over fitted features, reduction, velocity and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.inputs import split_txn, tied_orders, txn, wide_nulls
from riskframe.catalog.registry import TXN, query
from riskframe.config import RulesConfig
from riskframe.functions.lookup import ecdf_position
from riskframe.operators import bootstrap, features, reduction, rules
from riskframe.operators.horizon import Fitted, transform
from riskframe.plans.ordering import discrete_quantiles, quantiles

TRAIN = "split = 'train'"

WIDE = """
wide AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 3 <> 0 THEN l_quantity END AS v1,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 3 <> 0 THEN l_quantity * 2 + l_tax END AS v2,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 3 <> 0 THEN l_discount END AS v3,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 <> 0 THEN l_extendedprice END AS v4,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 <> 0 THEN l_tax END AS v5,
         l_quantity AS v6,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 = 0 THEN 1 ELSE 0 END AS is_fraud
  FROM lineitem)
"""

# ---- frequency, entity statistics, vocabulary ---------------------------------------------------


@query(
    "frequency_encoding",
    "id:i freq_card:f freq_product:f",
    """WITH tr AS (SELECT * FROM st WHERE split = 'train'), n AS (SELECT count(*) AS n FROM tr),
            c AS (SELECT card, CAST(count(*) AS DOUBLE) / (SELECT n FROM n) AS f FROM tr GROUP BY 1),
            p AS (SELECT product, CAST(count(*) AS DOUBLE) / (SELECT n FROM n) AS f FROM tr GROUP BY 1)
       SELECT id, CAST(coalesce(c.f, 0) AS FLOAT) AS freq_card, CAST(coalesce(p.f, 0) AS FLOAT) AS freq_product
       FROM st LEFT JOIN c USING (card) LEFT JOIN p USING (product)""",
)
def frequency_encoding(spark, d):
    rows = split_txn(spark, d)
    fitted = features.fit_frequencies(rows.where(TRAIN), ["card", "product"])
    return features.apply_frequencies(rows.select("id", "card", "product"), fitted, ["card", "product"])


@query(
    "entity_stats_fit",
    "entity:s level:s count:i mean:f std:f",
    """WITH tr AS (SELECT * FROM st WHERE split = 'train'),
            g AS (SELECT count(*) AS n, avg(amount) AS m, stddev_samp(amount) AS s FROM tr),
            o AS (SELECT 'card' AS entity, CAST(card AS VARCHAR) AS level, count(*) AS n, avg(amount) AS m,
                         coalesce(stddev_samp(amount), 0) AS s FROM tr GROUP BY card
                  UNION ALL SELECT 'product', product, count(*), avg(amount), coalesce(stddev_samp(amount), 0)
                  FROM tr GROUP BY product)
       SELECT entity, level, o.n AS count, (o.n * o.m + 10 * g.m) / (o.n + 10) AS mean,
              (o.n * o.s + 10 * g.s) / (o.n + 10) AS std FROM o, g
       UNION ALL SELECT e, '__global__', n, m, s FROM g, (VALUES ('card'), ('product')) v(e)""",
)
def entity_stats_fit(spark, d):
    return features.fit_amount_stats(split_txn(spark, d).where(TRAIN), ["card", "product"], 10.0)


@query(
    "entity_stats_apply",
    "id:i amt_mean_card:f z4:f absz4:f",
    """WITH tr AS (SELECT * FROM st WHERE split = 'train' AND card <> 5),
            g AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM tr),
            o AS (SELECT card, (count(*) * avg(amount) + 10 * (SELECT m FROM g)) / (count(*) + 10) AS m,
                         (count(*) * coalesce(stddev_samp(amount), 0) + 10 * (SELECT s FROM g)) / (count(*) + 10) AS s
                  FROM tr GROUP BY card)
       SELECT id, round(CAST(CAST(coalesce(o.m, g.m) AS FLOAT) AS DOUBLE), 3) AS amt_mean_card,
              round((amount - coalesce(o.m, g.m)) / coalesce(o.s, g.s), 4) AS z4,
              round(abs(amount - coalesce(o.m, g.m)) / coalesce(o.s, g.s), 4) AS absz4
       FROM st LEFT JOIN o USING (card) CROSS JOIN g""",
)
def entity_stats_apply(spark, d):
    rows = split_txn(spark, d)
    fitted = features.fit_amount_stats(rows.where(TRAIN).where("card <> 5"), ["card"], 10.0)
    built = features.apply_amount_stats(rows.select("id", "card", "amount"), fitted, ["card"])
    return built.select(
        "id",
        F.round(F.col("amt_mean_card").cast("double"), 3).alias("amt_mean_card"),
        F.round(F.col("amt_z_card").cast("double"), 4).alias("z4"),
        F.round(F.col("amt_absz_card").cast("double"), 4).alias("absz4"),
    )


@query(
    "vocabulary_fit",
    "column:s level:s code:i",
    """WITH tr AS (SELECT * FROM st WHERE split = 'train'),
            k AS (SELECT 'card' AS "column", CAST(card AS VARCHAR) AS level, count(*) AS n FROM tr GROUP BY card
                  UNION ALL SELECT 'product', product, count(*) FROM tr GROUP BY product),
            f AS (SELECT "column", level, row_number() OVER (PARTITION BY "column" ORDER BY level) - 1 AS code FROM k WHERE n >= 25)
       SELECT * FROM f
       UNION ALL SELECT c, '__other__', (SELECT count(*) FROM f WHERE "column" = c) FROM (VALUES ('card'), ('product')) v(c)
       UNION ALL SELECT c, '__missing__', 1 + (SELECT count(*) FROM f WHERE "column" = c) FROM (VALUES ('card'), ('product')) v(c)""",
)
def vocabulary_fit(spark, d):
    return features.fit_categories(split_txn(spark, d).where(TRAIN), ["card", "product"], 25)


@query(
    "vocabulary_apply",
    "level:s rows:i",
    """WITH k AS (SELECT card FROM st WHERE split = 'train' GROUP BY card HAVING count(*) >= 25)
       SELECT CASE WHEN addr = 7 THEN '__missing__' WHEN card IN (SELECT card FROM k) THEN CAST(card AS VARCHAR)
                   ELSE '__other__' END AS level, count(*) AS rows FROM st GROUP BY 1""",
)
def vocabulary_apply(spark, d):
    rows = split_txn(spark, d)
    fitted = features.fit_categories(rows.where(TRAIN), ["card"], 25)
    holed = rows.select("id", F.when(F.col("addr") != 7, F.col("card")).alias("card"))
    routed = features.apply_categories(holed, fitted, ["card"], codes=True)
    return routed.groupBy(F.col("card").alias("level")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "medians_fit",
    "column:s median:f",
    " UNION ALL ".join(f'''SELECT '{c}' AS "column", quantile_cont({c}, 0.5) AS median FROM wide''' for c in ("v1", "v3", "v4", "v6")),
    WIDE,
)
def medians_fit(spark, d):
    return features.fit_medians(wide_nulls(spark, d), ["v1", "v3", "v4", "v6"])


@query(
    "medians_apply",
    "l_linenumber:i v1_sum:m v4_sum:m",
    """SELECT l_linenumber, sum(coalesce(v1, (SELECT quantile_cont(v1, 0.5) FROM wide))) AS v1_sum,
              sum(coalesce(v4, (SELECT quantile_cont(v4, 0.5) FROM wide))) AS v4_sum FROM wide GROUP BY 1""",
    WIDE,
)
def medians_apply(spark, d):
    rows = wide_nulls(spark, d).select("l_linenumber", "v1", "v4")
    fitted = features.fit_medians(rows, ["v1", "v4"])
    return features.apply_medians(rows, fitted, ["v1", "v4"]).groupBy("l_linenumber").agg(
        F.sum("v1").alias("v1_sum"), F.sum("v4").alias("v4_sum")
    )


@query(
    "null_shares",
    "column:s share:f",
    " UNION ALL ".join(
        f'''SELECT '{c}' AS "column", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM wide'''
        for c in ("v1", "v2", "v3", "v4", "v5", "v6")
    ),
    WIDE,
)
def null_shares(spark, d):
    return features.null_shares(wide_nulls(spark, d), ["v1", "v2", "v3", "v4", "v5", "v6"])


@query(
    "null_pattern_groups",
    "column:s head:s nulls:i",
    """WITH m AS (SELECT count(*) FILTER (v1 IS NULL) AS a, count(*) FILTER (v4 IS NULL) AS b, count(*) FILTER (v6 IS NULL) AS c FROM wide)
       SELECT "column", head, CASE head WHEN 'v1' THEN a WHEN 'v4' THEN b ELSE c END AS nulls
       FROM m, (VALUES ('v1', 'v1'), ('v2', 'v1'), ('v3', 'v1'), ('v4', 'v4'), ('v5', 'v4'), ('v6', 'v6')) t("column", head)""",
    WIDE,
)
def null_pattern_groups(spark, d):
    prints = reduction.null_fingerprints(wide_nulls(spark, d), ["v1", "v2", "v3", "v4", "v5", "v6"], "row_key")
    heads = prints.groupBy("nulls", "fingerprint").agg(F.min("column").alias("head"))
    return prints.join(heads, ["nulls", "fingerprint"]).select("column", "head", "nulls")


@query(
    "correlation_matrix",
    "a:s b:s r:f",
    """WITH c AS (SELECT * FROM wide WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL)
       SELECT 'v1' AS a, 'v2' AS b, corr(v1, v2) AS r FROM c UNION ALL SELECT 'v1', 'v3', corr(v1, v3) FROM c
       UNION ALL SELECT 'v2', 'v3', corr(v2, v3) FROM c""",
    WIDE,
)
def correlation_matrix(spark, d):
    names = ["v1", "v2", "v3"]
    r = reduction.group_correlations(wide_nulls(spark, d), [names])[0]
    pairs = [(names[i], names[j], float(r[i, j])) for i in range(3) for j in range(i + 1, 3)]
    return spark.createDataFrame(pairs, "a string, b string, r double")


@query(
    "column_reduction",
    "column:s role:s median:f",
    """SELECT 'vb_' || c AS "column", 'representative' AS role, m AS median FROM (
         SELECT 'v1' AS c, quantile_cont(v1, 0.5) AS m FROM wide UNION ALL SELECT 'v3', quantile_cont(v3, 0.5) FROM wide
         UNION ALL SELECT 'v4', quantile_cont(v4, 0.5) FROM wide UNION ALL SELECT 'v5', quantile_cont(v5, 0.5) FROM wide
         UNION ALL SELECT 'v6', quantile_cont(v6, 0.5) FROM wide)
       UNION ALL SELECT 'vb_present_' || c, 'presence', NULL FROM (VALUES ('v1'), ('v4')) t(c)""",
    WIDE,
)
def column_reduction(spark, d):
    fitted = reduction.fit_reduction(wide_nulls(spark, d), ["v1", "v2", "v3", "v4", "v5", "v6"], "row_key")
    return reduction.reduction_table(spark, fitted)


@query(
    "column_reduction_apply",
    "l_linenumber:i vb_v1:f vb_v4:f vb_present_v1:i vb_present_v4:i",
    """SELECT l_linenumber, sum(coalesce(v1, (SELECT quantile_cont(v1, 0.5) FROM wide))) AS vb_v1,
              round(sum(CAST(CAST(coalesce(v4, (SELECT quantile_cont(v4, 0.5) FROM wide)) AS FLOAT) AS DOUBLE)), 2) AS vb_v4,
              count(v1) AS vb_present_v1, count(v4) AS vb_present_v4 FROM wide GROUP BY 1""",
    WIDE,
)
def column_reduction_apply(spark, d):
    rows = wide_nulls(spark, d)
    fitted = reduction.fit_reduction(rows, ["v1", "v2", "v3", "v4", "v5", "v6"], "row_key")
    return reduction.apply_reduction(rows, fitted).groupBy("l_linenumber").agg(
        F.sum("vb_v1").alias("vb_v1"),
        F.round(F.sum(F.col("vb_v4").cast("double")), 2).alias("vb_v4"),
        F.sum("vb_present_v1").alias("vb_present_v1"),
        F.sum("vb_present_v4").alias("vb_present_v4"),
    )


# ---- quantiles ---------------------------------------------------------------------------------


@query(
    "product_quantile_cut",
    "product:s value:f",
    "SELECT product, quantile_cont(amount, 0.99) AS value FROM st WHERE split = 'train' GROUP BY 1",
)
def product_quantile_cut(spark, d):
    return quantiles(split_txn(spark, d).where(TRAIN), "amount", [0.99], ["product"])


@query(
    "quantile_grid",
    "prob:f value:f",
    f"""SELECT unnest({[i / 200 for i in range(201)]}) AS prob,
              unnest((SELECT quantile_cont(amount, {[i / 200 for i in range(201)]}) FROM txn)) AS value""",
)
def quantile_grid(spark, d):
    return quantiles(txn(spark, d), "amount", [i / 200 for i in range(201)])


@query(
    "percentiles",
    "split:s p50:f p90:f p99:f",
    """SELECT split, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90, quantile_cont(score, 0.99) AS p99
       FROM st WHERE split IS NOT NULL GROUP BY 1""",
)
def percentiles(spark, d):
    found = quantiles(split_txn(spark, d).where("split is not null"), "score", [0.5, 0.9, 0.99], ["split"])
    return found.groupBy("split").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)]
    )


@query(
    "discrete_quantile_edges",
    "k:i value:f",
    """WITH o AS (SELECT amount, row_number() OVER (ORDER BY amount) AS rn, count(*) OVER () AS n FROM st WHERE split = 'train')
       SELECT k, max(amount) FILTER (rn = (k * n + 9) // 10) AS value FROM o, range(1, 10) r(k) GROUP BY k""",
)
def discrete_quantile_edges(spark, d):
    return discrete_quantiles(split_txn(spark, d).where(TRAIN), "amount", 10)


@query(
    "ecdf_position",
    "id:i position:f",
    f"""WITH g AS (SELECT unnest(quantile_cont(amount, {[i / 1000 for i in range(1001)]})) AS e FROM st WHERE split = 'train')
       SELECT id, (SELECT count(*) FROM g WHERE e <= amount + 1e-9) / 1001.0 AS position FROM st""",
)
def ecdf_position_query(spark, d):
    rows = split_txn(spark, d)
    grid = [v + -1e-9 for v in rules.quantile_grid(rows.where(TRAIN), "amount", 1001)]
    return ecdf_position(rows.select("id", "amount"), "amount", grid, "position")


@query(
    "daily_sums",
    "day:i rows:i amount:f positives:i",
    "SELECT day, count(*) AS rows, sum(amount) AS amount, sum(is_fraud) AS positives FROM txn GROUP BY 1",
)
def daily_sums(spark, d):
    return bootstrap.by_day(txn(spark, d), {"amount": "amount", "positives": "is_fraud"})


# ---- velocity -------------------------------------------------------------------------------------

VELOCITY_SQL = """
  WITH v AS (SELECT id, card, dt FROM {source})
  SELECT a.id, a.card,
         count(*) FILTER (b.dt > a.dt - 3600) AS n1h, count(*) FILTER (b.dt > a.dt - 86400) AS n24h,
         count(*) FILTER (b.dt > a.dt - 604800) AS n7d,
         CAST(ln(1 + coalesce(a.dt - max(CASE WHEN b.id <> a.id THEN b.dt END), 30 * 86400.0)) AS FLOAT) AS recency
  FROM v a JOIN v b ON a.card = b.card AND (b.dt < a.dt OR (b.dt = a.dt AND b.id <= a.id))
  GROUP BY a.id, a.card, a.dt
"""


def _velocity(df):
    return features.velocity(df).select(
        "id",
        "card",
        F.col("vel_n1h_card").alias("n1h"),
        F.col("vel_n24h_card").alias("n24h"),
        F.col("vel_n7d_card").alias("n7d"),
        F.round(F.col("vel_recency_card").cast("double"), 4).alias("recency"),
    )


@query("velocity", "id:i card:i n1h:i n24h:i n7d:i recency:f", f"SELECT id, card, n1h, n24h, n7d, round(CAST(recency AS DOUBLE), 4) AS recency FROM ({VELOCITY_SQL.format(source='txn')})")
def velocity(spark, d):
    return _velocity(txn(spark, d).select("id", "dt", "card"))


ORDERS = """
o AS (SELECT o_orderkey AS id, o_custkey AS card, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 86400 AS dt FROM orders)
"""


@query(
    "velocity_tied",
    "id:i card:i n1h:i n24h:i n7d:i recency:f",
    f"SELECT id, card, n1h, n24h, n7d, round(CAST(recency AS DOUBLE), 4) AS recency FROM ({VELOCITY_SQL.format(source='o')})",
    ORDERS,
)
def velocity_tied(spark, d):
    return _velocity(tied_orders(spark, d))


@query(
    "first_sighting_share",
    "first_sighting_share:f",
    """SELECT avg(CASE WHEN NOT EXISTS (SELECT 1 FROM o p WHERE p.card = o.card AND (p.dt < o.dt OR (p.dt = o.dt AND p.id < o.id)))
                       THEN 1.0 ELSE 0.0 END) AS first_sighting_share FROM o""",
    ORDERS,
)
def first_sighting_share(spark, d):
    # a gap of exactly thirty days is no first sighting: no such gap may reach the default
    rows = features.velocity(tied_orders(spark, d), first_seen_gap_days=30.5)
    return features.first_sighting_share(rows, first_seen_gap_days=30.5)


@query(
    "serving_transform",
    "id:i amt_whole_dollar:i freq_product:f z4:f product:s",
    """WITH tr AS (SELECT * FROM st WHERE split = 'train'), n AS (SELECT count(*) AS n, avg(amount) AS m, stddev_samp(amount) AS s FROM tr),
            p AS (SELECT product, count(*) AS c, avg(amount) AS m, stddev_samp(amount) AS s FROM tr GROUP BY 1)
       SELECT id, CAST(CAST(round_even(amount * 1000, 0) AS BIGINT) % 1000 = 0 AS INTEGER) AS amt_whole_dollar,
              CAST(CAST(p.c AS DOUBLE) / n.n AS FLOAT) AS freq_product,
              round((amount - (p.c * p.m + 10 * n.m) / (p.c + 10)) / ((p.c * p.s + 10 * n.s) / (p.c + 10)), 4) AS z4, product
       FROM st JOIN p USING (product) CROSS JOIN n WHERE day >= 26""",
)
def serving_transform(spark, d):
    rows = split_txn(spark, d)
    train = rows.where(TRAIN)
    fitted = Fitted(
        features.fit_frequencies(train, ["product"]),
        features.fit_amount_stats(train, ["product"], 10.0),
        features.fit_categories(train, ["product"], 50),
        ["product"],
        ["product"],
        ["product"],
    )
    built = transform(rows.where("day >= 26").select("id", "dt", "amount", "product"), fitted)
    return built.withColumn("z4", F.round(F.col("amt_z_product").cast("double"), 4))


# ---- rules ---------------------------------------------------------------------------------------------

RULES = RulesConfig(
    round_step=0.5, round_min=10.0, round_max=100.0, tiers={"purchase": 3, "error": 2, "signup": 1},
    match_product="click", match_level="M2", ecdf_points=1001,
)


def rules_txn(spark, d):
    return split_txn(spark, d).withColumns(
        {"d1": F.col("addr").cast("double"), "m4": F.concat(F.lit("M"), (F.col("addr") % 3).cast("string"))}
    )


RULES_SQL = TXN + """,
cuts AS (SELECT product, quantile_cont(amount, 0.99) AS cut FROM st WHERE split = 'train' GROUP BY 1),
ru AS (
  SELECT st.*, CASE WHEN abs(amount * 2 - round(amount * 2)) = 0 AND amount BETWEEN 10 AND 100 THEN 2 ELSE 0 END AS round_amount,
         CASE product WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS product_tier,
         CASE WHEN amount > cut THEN 1 ELSE 0 END AS amount_percentile,
         CASE WHEN addr > 0 AND addr <= 3 THEN 3 ELSE 0 END AS new_card,
         CASE WHEN product = 'click' AND addr % 3 = 2 THEN 1 ELSE 0 END AS product_match
  FROM st LEFT JOIN cuts USING (product))
"""


@query(
    "rule_contributions",
    "id:i round_amount:i product_tier:i amount_percentile:i new_card:i product_match:i",
    "SELECT id, round_amount, product_tier, amount_percentile, new_card, product_match FROM ru",
    RULES_SQL,
)
def rule_contributions(spark, d):
    rows = rules_txn(spark, d)
    constants = rules.fit_rules(rows.where(TRAIN), RULES)
    return rules.contributions(rows, rules.default_rules(RULES), constants)


@query(
    "rule_score",
    "id:i rules_score:f",
    """SELECT id, round_amount + product_tier + amount_percentile + new_card + product_match
              + 0.5 * (SELECT count(*) FROM g WHERE e <= amount) / 1001.0 AS rules_score FROM ru""",
    RULES_SQL + f""",
g AS (SELECT unnest(quantile_cont(amount, {[i / 1000 for i in range(1001)]})) AS e FROM st WHERE split = 'train')""",
)
def rule_score(spark, d):
    rows = rules_txn(spark, d)
    constants = rules.fit_rules(rows.where(TRAIN), RULES)
    return rules.score(rows, rules.default_rules(RULES), constants)


@query(
    "rule_lift",
    "rule:s rows:i rows_per_day:f rate:f lift:f positive_amount:f",
    """WITH b AS (SELECT avg(is_fraud) AS r, count(DISTINCT day) AS days FROM st WHERE split = 'train'),
            f AS (SELECT 'big' AS rule, * FROM st WHERE split = 'train' AND amount > 100
                  UNION ALL SELECT 'purchase', * FROM st WHERE split = 'train' AND product = 'purchase')
       SELECT rule, count(*) AS rows, count(*) / max(days) AS rows_per_day, avg(is_fraud) AS rate, avg(is_fraud) / max(r) AS lift,
              sum(CASE WHEN is_fraud = 1 THEN amount ELSE 0 END) AS positive_amount FROM f, b GROUP BY 1""",
)
def rule_lift(spark, d):
    predicates = {"big": F.col("amount") > 100, "purchase": F.col("product") == "purchase"}
    return rules.lift(split_txn(spark, d).where(TRAIN), predicates)


@query(
    "rule_stability",
    "rule:s lift_a:f lift_b:f lift_full:f weakest_half:f implied_weight:i",
    """WITH t AS (SELECT *, day < 6 AS early, amount > 50 AS fires FROM st WHERE split = 'train'),
            l AS (SELECT avg(is_fraud) FILTER (early AND fires) / avg(is_fraud) FILTER (early) AS a,
                         avg(is_fraud) FILTER (NOT early AND fires) / avg(is_fraud) FILTER (NOT early) AS b,
                         avg(is_fraud) FILTER (fires) / avg(is_fraud) AS f FROM t)
       SELECT 'above_50' AS rule, a AS lift_a, b AS lift_b, f AS lift_full, least(a, b) AS weakest_half,
              round_even(least(a, b), 0) AS implied_weight FROM l""",
)
def rule_stability(spark, d):
    return rules.stability(split_txn(spark, d).where(TRAIN), {"above_50": F.col("amount") > 50}, 6)


@query(
    "rule_lift_bands",
    "product:s band_low:f band_high:f rows:i positives:i rate:f lift:f",
    """WITH b(lo, hi) AS (VALUES (0, 10), (11, 50), (40, 99)), base AS (SELECT product, avg(is_fraud) AS r FROM txn GROUP BY 1)
       SELECT product, lo AS band_low, hi AS band_high, count(*) AS rows, sum(is_fraud) AS positives, avg(is_fraud) AS rate,
              avg(is_fraud) / max(r) AS lift
       FROM txn JOIN base USING (product) JOIN b ON addr BETWEEN lo AND hi GROUP BY product, lo, hi""",
)
def rule_lift_bands(spark, d):
    return rules.lift_bands(txn(spark, d), "addr", [(0, 10), (11, 50), (40, 99)], within="product")


@query(
    "rule_lift_bands_pooled",
    "band_low:f band_high:f rows:i positives:i rate:f lift:f",
    """WITH b(lo, hi) AS (VALUES (0, 10), (11, 50), (40, 99)), base AS (SELECT avg(is_fraud) AS r FROM txn)
       SELECT lo AS band_low, hi AS band_high, count(*) AS rows, sum(is_fraud) AS positives, avg(is_fraud) AS rate,
              avg(is_fraud) / max(r) AS lift
       FROM txn CROSS JOIN base JOIN b ON addr BETWEEN lo AND hi GROUP BY lo, hi""",
)
def rule_lift_bands_pooled(spark, d):
    return rules.lift_bands(txn(spark, d), "addr", [(0, 10), (11, 50), (40, 99)])
