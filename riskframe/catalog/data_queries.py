"""Queries over sources, contracts, time, splits, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.catalog.inputs import BOUNDS, split_txn, table, txn
from riskframe.catalog.registry import query
from riskframe.functions import lookup as L
from riskframe.functions import scalar as S
from riskframe.operators import features, joins, splits
from riskframe.session import scratch_path
from riskframe.sources import contract, io

# ---- sources and sinks -----------------------------------------------------------------------


@query(
    "io_typed_csv",
    "o_orderstatus:s rows:i keys:i total:m",
    """SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_custkey) AS keys, sum(o_totalprice) AS total
       FROM orders GROUP BY 1""",
    "",
)
def io_typed_csv(spark, d):
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.write.option("header", True).csv(path)
    schema = T.StructType.fromDDL(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    )
    back = io.read_typed(spark, path, schema)
    per_key = back.groupBy("o_orderstatus", "o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t")
    )
    return per_key.groupBy("o_orderstatus").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.sum("t").alias("total")
    )


@query(
    "io_cardinality",
    "column:s levels:i rows:i",
    """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS levels, count(*) AS rows FROM orders
       UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders""",
    "",
)
def io_cardinality(spark, d):
    return io.measure_cardinality(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("io_row_count", "rows:i", "SELECT count(*) AS rows FROM lineitem", "")
def io_row_count(spark, d):
    return io.count_rows(table(spark, d, "lineitem"))


@query(
    "io_scan_pruned",
    "l_orderkey:i l_linenumber:i l_quantity:f",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 3 AND l_returnflag = 'R'",
    "",
)
def io_scan_pruned(spark, d):
    return io.scan(
        spark,
        f"{d}/lineitem.parquet",
        ["l_orderkey", "l_linenumber", "l_quantity"],
        "l_quantity <= 3 and l_returnflag = 'R'",
    )


@query(
    "io_matrices_roundtrip",
    "split:s rows:i amount:f",
    "SELECT split, count(*) AS rows, sum(amount) AS amount FROM st WHERE split IS NOT NULL GROUP BY 1",
)
def io_matrices_roundtrip(spark, d):
    path = scratch_path(spark, "matrices")
    io.write_matrices(split_txn(spark, d).select("id", "day", "amount", "split"), path)
    back = io.load_matrices(spark, path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"))


@query(
    "io_predictions_roundtrip",
    "split:s rows:i positives:i score_sum:f",
    """SELECT split, count(*) AS rows, sum(is_fraud) AS positives, sum(score) AS score_sum
       FROM st WHERE split IN ('val_fit', 'val_cal') GROUP BY 1""",
)
def io_predictions_roundtrip(spark, d):
    path = scratch_path(spark, "predictions")
    io.write_predictions(split_txn(spark, d), path, ["val_fit", "val_cal"])
    return io.scan(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("positives"), F.sum("score").alias("score_sum")
    )


@query(
    "io_report_roundtrip",
    "section:s rows:i rate:f",
    """SELECT coalesce(split, 'gap') AS section, count(*) AS rows, avg(is_fraud) AS rate FROM st GROUP BY 1""",
)
def io_report_roundtrip(spark, d):
    path = scratch_path(spark, "report")
    io.write_report(splits.summarize(split_txn(spark, d)), path)
    return spark.read.schema("section string, rows bigint, rate double").json(path)


@query(
    "io_fitted_roundtrip",
    "column:s level:s frequency:f",
    """SELECT 'product' AS "column", product AS level, CAST(count(*) / sum(count(*)) OVER () AS FLOAT) AS frequency
       FROM st WHERE split = 'train' GROUP BY product""",
)
def io_fitted_roundtrip(spark, d):
    path = scratch_path(spark, "fitted")
    train = split_txn(spark, d).where("split = 'train'")
    io.save_fitted(features.fit_frequencies(train, ["product"]), path)
    return io.load_fitted(spark, path, "column", "level", non_null=["frequency"])


@query(
    "io_rename_prefix",
    "id_key:i id_name:s",
    "SELECT n_nationkey AS id_key, n_name AS id_name FROM nation",
    "",
)
def io_rename_prefix(spark, d):
    raw = table(spark, d, "nation").select(F.col("n_nationkey").alias("id-key"), F.col("n_name").alias("id-name"))
    return io.rename_prefix(raw, "id-", "id_")


@query(
    "contract_violations",
    "column_name:s check_name:s n:i",
    """SELECT 'l_orderkey,l_linenumber' AS column_name, 'unique' AS check_name,
              (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n
       UNION ALL SELECT 'l_quantity', 'above', (SELECT count(*) FROM lineitem WHERE l_quantity > 45)
       UNION ALL SELECT 'l_returnflag', 'domain', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
       UNION ALL SELECT 'l_missing', 'missing', 1
       UNION ALL SELECT 'l_linestatus', 'type', 1""",
    "",
)
def contract_violations(spark, d):
    rules = (
        contract.Rule("l_quantity", nullable=False, low=0, high=45),
        contract.Rule("l_returnflag", isin=("A", "N")),
        contract.Rule("l_linestatus", dtype=T.IntegerType()),
        contract.Rule("l_.*key", nullable=False, low=0, pattern=True),
        contract.Rule("l_missing"),
    )
    found = contract.Contract(rules, unique=(("l_orderkey", "l_linenumber"),))
    return contract.validate(table(spark, d, "lineitem"), found)


@query(
    "contract_duplicate_keys",
    "l_orderkey:i l_linenumber:i copies:i",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "",
)
def contract_duplicate_keys(spark, d):
    return contract.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "io_conform_optional",
    "c_custkey:i c_acctbal:f extra:f note:s",
    "SELECT c_custkey, c_acctbal, CAST(NULL AS DOUBLE) AS extra, CAST(NULL AS VARCHAR) AS note FROM customer",
    "",
)
def io_conform_optional(spark, d):
    optional = T.StructType.fromDDL("extra double, note string, c_acctbal double")
    return io.conform(table(spark, d, "customer"), ["c_custkey", "c_acctbal"], ["c_custkey"], optional)


@query(
    "io_typed_columns",
    "p_partkey:i p_size:f p_brand:s",
    "SELECT p_partkey, CAST(p_size AS FLOAT) AS p_size, p_brand FROM part",
    "",
)
def io_typed_columns(spark, d):
    schema = T.StructType.fromDDL("p_partkey int, p_size float, p_brand string")
    return io.typed(table(spark, d, "part"), schema)


@query(
    "io_content_stamp",
    "stamp:s",
    """WITH r AS (SELECT md5(concat_ws(chr(31), s_suppkey, s_name, s_acctbal, count(*))) AS h FROM supplier GROUP BY s_suppkey, s_name, s_acctbal)
       SELECT substr(sha256(concat_ws('/', bit_xor(('0x' || substr(h, 1, 15))::BIGINT), bit_xor(('0x' || substr(h, 17, 15))::BIGINT), count(*))), 1, 12) AS stamp
       FROM r""",
    "",
)
def io_content_stamp(spark, d):
    return io.content_stamp(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"))


@query(
    "io_json_body",
    "id:i amount:f product:s missing:s",
    "SELECT id, amount, product, CAST(NULL AS VARCHAR) AS missing FROM txn",
)
def io_json_body(spark, d):
    rows = txn(spark, d).select("id", "amount", "product", F.lit(None).cast("string").alias("missing"))
    body = rows.select(S.to_body(["id", "amount", "product", "missing"]).alias("body"))
    schema = "id bigint, amount double, product string, missing string"
    return body.select(F.from_json("body", schema).alias("r")).select("r.*")


# ---- projection and time -----------------------------------------------------------------------


@query(
    "time_columns",
    "id:i dt:i day:i hour:i weekday:i",
    "SELECT id, dt, day, hour, weekday FROM txn",
)
def time_columns(spark, d):
    return txn(spark, d).select("id", "dt", "day", "hour", "weekday")


@query(
    "amount_features",
    "id:i amt_whole_dollar:i amt_round_band:i amt_round_band_product:i",
    """SELECT id, CAST(m % 1000 = 0 AS INTEGER) AS amt_whole_dollar,
              CAST(m % 500 = 0 AND m BETWEEN 10000 AND 100000 AS INTEGER) AS amt_round_band,
              CAST(m % 500 = 0 AND m BETWEEN 10000 AND 100000 AND product = 'click' AS INTEGER) AS amt_round_band_product
       FROM (SELECT id, product, CAST(round_even(amount * 1000, 0) AS BIGINT) AS m FROM txn)""",
)
def amount_features(spark, d):
    config = {"step": 0.5, "low": 10.0, "high": 100.0, "product": "click"}
    return features.add_amount_features(txn(spark, d), config=config)


@query(
    "amount_log_hour_cycle",
    "id:i log_amount:f hour_sin:f hour_cos:f",
    """SELECT id, ln(1 + amount) AS log_amount, sin(2 * pi() * hour / 24) AS hour_sin,
              cos(2 * pi() * hour / 24) AS hour_cos FROM txn""",
)
def amount_log_hour_cycle(spark, d):
    sine, cosine = S.hour_cycle("hour")
    return txn(spark, d).select("id", S.log_amount("amount").alias("log_amount"), sine.alias("hour_sin"), cosine.alias("hour_cos"))


@query(
    "presence_coverage",
    "doc_id:i has_quality:i carried:i",
    """SELECT d.doc_id, CAST(l.quality IS NOT NULL AS INTEGER) AS has_quality,
              1 + CAST(l.quality IS NOT NULL AS INTEGER) + CAST(l.toxic IS NOT NULL AS INTEGER) AS carried
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "",
)
def presence_coverage(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", S.presence("quality").alias("has_quality"), S.coverage(["lang", "quality", "toxic"]).alias("carried")
    )


@query("horizon_cut", "day:i rows:i", "SELECT day, count(*) AS rows FROM txn WHERE day >= 6 GROUP BY 1")
def horizon_cut(spark, d):
    return splits.cut_from_day(txn(spark, d), 6).groupBy("day").agg(F.count(F.lit(1)).alias("rows"))


@query("causal_order", "id:i dt:i", "SELECT id, dt FROM txn")
def causal_order(spark, d):
    return splits.order_by_time(txn(spark, d)).select("id", "dt")


@query(
    "fill_history",
    "id:i vel_n1h_card:f vel_n7d_card:f vel_recency_card:f",
    """SELECT id, 1.0 AS vel_n1h_card, CAST(card % 5 AS DOUBLE) AS vel_n7d_card,
              CAST(ln(1 + 30 * 86400.0) AS FLOAT) AS vel_recency_card FROM txn""",
)
def fill_history(spark, d):
    supplied = txn(spark, d).withColumn("vel_n7d_card", (F.col("card") % 5).cast("double"))
    return features.fill_history(supplied)


# ---- splits -----------------------------------------------------------------------------------


@query(
    "split_assignment",
    "id:i day:i split:s",
    "SELECT id, day, split FROM st",
)
def split_assignment(spark, d):
    return split_txn(spark, d).select("id", "day", "split")


@query(
    "split_violations",
    "section:s problem:s",
    """SELECT 'test' AS section, 'span ends early' AS problem WHERE (SELECT max(day) FROM st WHERE split = 'test') < 31""",
)
def split_violations(spark, d):
    from dataclasses import replace

    longer = replace(BOUNDS, test_end=31)
    return splits.split_violations(split_txn(spark, d), longer)


@query(
    "split_summary",
    "section:s first_day:i last_day:i n_days:i rows:i positives:i rate:f",
    """SELECT coalesce(split, 'gap') AS section, min(day) AS first_day, max(day) AS last_day,
              count(DISTINCT day) AS n_days, count(*) AS rows, sum(is_fraud) AS positives, avg(is_fraud) AS rate
       FROM st GROUP BY 1""",
)
def split_summary(spark, d):
    return splits.check_summary(splits.summarize(split_txn(spark, d)))


@query(
    "split_attach",
    "split:s rows:i amount:f",
    "SELECT split, count(*) AS rows, sum(amount) AS amount FROM st GROUP BY 1",
)
def split_attach(spark, d):
    rows = txn(spark, d).select("id", "amount")
    assigned = split_txn(spark, d).select("id", "split")
    return splits.attach_splits(rows, assigned).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount")
    )


@query(
    "split_partition_counts",
    "section:s rows:i",
    "SELECT coalesce(split, 'gap') AS section, count(*) AS rows FROM st GROUP BY 1",
)
def split_partition_counts(spark, d):
    return splits.partition_counts(split_txn(spark, d))


@query(
    "day_folds",
    "fold:i first_day:i last_day:i rows:i",
    """SELECT (day - 1) // 10 AS fold, min(day) AS first_day, max(day) AS last_day, count(*) AS rows
       FROM txn GROUP BY 1""",
)
def day_folds(spark, d):
    return splits.assign_folds(txn(spark, d), 3).groupBy("fold").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("rows")
    )


# ---- joins ------------------------------------------------------------------------------------


@query(
    "join_left_flag",
    "doc_id:i has_label:b quality:f",
    """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_label,
              (SELECT quality FROM labels l WHERE l.doc_id = d.doc_id) AS quality FROM documents d""",
    "",
)
def join_left_flag(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return joins.checked_left_join_flag(docs, table(spark, d, "labels"), "doc_id", "has_label")


@query(
    "join_one_to_one",
    "doc_id:i n_chars:i toxic:i",
    "SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)",
    "",
)
def join_one_to_one(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return joins.join_one_to_one(docs, table(spark, d, "labels"), "doc_id")


@query(
    "join_enrich_required",
    "o_custkey:i rows:i balance:f",
    """SELECT o_custkey, count(*) AS rows, sum(c_acctbal) AS balance
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "",
)
def join_enrich_required(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    known = joins.semi(orders, customers, ["o_custkey"])
    return joins.enrich_required(known, customers, "o_custkey", ["c_acctbal"]).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("c_acctbal").alias("balance")
    )


@query(
    "join_alignment",
    "only_left:i only_right:i label_differs:i both_sides:i",
    """SELECT sum(CASE WHEN day > 20 THEN 1 ELSE 0 END) AS only_left, 0 AS only_right,
              sum(CASE WHEN day <= 20 AND card = 7 THEN 1 ELSE 0 END) AS label_differs,
              sum(CASE WHEN day <= 20 THEN 1 ELSE 0 END) AS both_sides FROM txn""",
)
def join_alignment(spark, d):
    a = txn(spark, d)
    b = a.where("day <= 20").withColumn("is_fraud", F.when(F.col("card") == 7, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    return joins.alignment(a, b, "id", "is_fraud")


@query(
    "join_reproduction",
    "keys:i unmatched:i unequal:i",
    """SELECT count(*) AS keys, sum(CASE WHEN day = 30 THEN 1 ELSE 0 END) AS unmatched,
              sum(CASE WHEN day < 30 AND card = 3 THEN 1 ELSE 0 END) AS unequal FROM txn""",
)
def join_reproduction(spark, d):
    a = txn(spark, d).select("id", "day", "card", "score")
    b = a.where("day < 30").withColumn("score", F.when(F.col("card") == 3, F.col("score") + 1e-12).otherwise(F.col("score")))
    return joins.reproduction(a, b)


@query(
    "join_matrix_difference",
    "only_left:i only_right:i",
    """SELECT sum(CASE WHEN day = 30 THEN 1 ELSE 0 END) AS only_left, 0 AS only_right FROM txn""",
)
def join_matrix_difference(spark, d):
    a = txn(spark, d).select("id", "amount", "product", "day")
    return joins.matrix_difference(a, a.where("day < 30"))


@query(
    "join_lookup_default",
    "id:i seen:f",
    """WITH f AS (SELECT card, count(*) AS n FROM st WHERE split = 'train' AND product = 'click' GROUP BY 1)
       SELECT t.id, coalesce(f.n, 0) AS seen FROM st t LEFT JOIN f USING (card)""",
)
def join_lookup_default(spark, d):
    rows = split_txn(spark, d)
    fitted = rows.where("split = 'train' and product = 'click'").groupBy(F.col("card").alias("level")).agg(
        F.count(F.lit(1)).alias("seen")
    )
    return L.lookup(rows.select("id", "card"), fitted, "card", {"seen": F.lit(0)})


@query(
    "join_semi",
    "doc_id:i",
    "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "",
)
def join_semi(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1")
    return joins.semi(table(spark, d, "documents").select("doc_id"), toxic, ["doc_id"])


@query(
    "bin_lookup",
    "id:i left_bin:i right_bin:i",
    """SELECT id, CAST(amount > 10 AS INT) + CAST(amount > 34.59 AS INT) + CAST(amount > 100 AS INT) AS left_bin,
              CAST(amount >= 10 AS INT) + CAST(amount >= 34.59 AS INT) + CAST(amount >= 100 AS INT) AS right_bin FROM txn""",
)
def bin_lookup(spark, d):
    edges = [10.0, 34.59, 100.0]
    rows = L.bin_by_edges(txn(spark, d).select("id", "amount"), "amount", edges, "left", "left_bin")
    return L.bin_by_edges(rows, "amount", edges, "right", "right_bin")


@query(
    "bin_lookup_many_edges",
    "id:i left_bin:i right_bin:i",
    """SELECT id, least(ceil(amount / 2) - 0, 200) AS left_bin, least(floor(amount / 2) + 1, 200) AS right_bin
       FROM txn""",
)
def bin_lookup_many_edges(spark, d):
    edges = [2.0 * i for i in range(200)]
    rows = L.bin_by_edges(txn(spark, d).select("id", "amount"), "amount", edges, "left", "left_bin")
    return L.bin_by_edges(rows, "amount", edges, "right", "right_bin")


@query(
    "interpolation",
    "id:i y:f",
    """SELECT id, CASE WHEN amount <= 10 THEN 0.1 WHEN amount >= 200 THEN 0.9
                       WHEN amount < 50 THEN 0.1 + (amount - 10) / 40 * 0.3
                       ELSE 0.4 + (amount - 50) / 150 * 0.5 END AS y FROM txn""",
)
def interpolation(spark, d):
    return L.interpolate(txn(spark, d).select("id", "amount"), "amount", [10.0, 50.0, 200.0], [0.1, 0.4, 0.9], "y")


# ---- sets ---------------------------------------------------------------------------------------


@query(
    "union_scores",
    "split:s rows:i",
    "SELECT split, count(*) AS rows FROM st WHERE split IN ('val_fit', 'val_cal', 'test') GROUP BY 1",
)
def union_scores(spark, d):
    rows = split_txn(spark, d).select("id", "split", "day", "is_fraud", "score")
    parts = [rows.where(F.col("split") == s) for s in ("val_fit", "val_cal", "test")]
    return joins.union_scores(*parts).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "diff_keys",
    "card:i side:s",
    """WITH a AS (SELECT DISTINCT card FROM txn WHERE day <= 2), b AS (SELECT DISTINCT card FROM txn WHERE day >= 29)
       SELECT card, 'left' AS side FROM a WHERE card NOT IN (SELECT card FROM b)
       UNION ALL SELECT card, 'right' FROM b WHERE card NOT IN (SELECT card FROM a)""",
)
def diff_keys(spark, d):
    rows = txn(spark, d)
    return joins.diff_keys(rows.where("day <= 2"), rows.where("day >= 29"), "card")
