"""Streaming jobs run over everything available; each equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.feature_queries import VELOCITY_SQL
from riskframe.catalog.inputs import table, txn_columns
from riskframe.catalog.metric_queries import COSTS, ev_sql
from riskframe.catalog.registry import TXN, query
from riskframe.operators import features
from riskframe.operators.calibration import Platt
from riskframe.operators.horizon import Fitted
from riskframe.operators.splits import add_time_columns
from riskframe.session import scratch_path
from riskframe.streaming import rates, scoring, sources
from riskframe.streaming.velocity import velocity_stream


# Days from the last event to the heartbeat: beyond every delay, window and label wait used here.
QUIET_DAYS = 400


def event_stream(spark, d):
    """The events as a stream, and one heartbeat event long after the last.

    The heartbeat stands for the traffic that goes on after any row: it moves the watermark past
    all rows, so every window, session and held row comes out. It has id -1 and never closes.
    """
    events = table(spark, d, "events")
    landed = scratch_path(spark, "heartbeat")
    last = events.agg(F.max("ts").alias("ts"))
    beat = last.select(
        F.lit(-1).cast("long").alias("event_id"),
        (F.col("ts") + F.expr(f"INTERVAL {QUIET_DAYS} DAYS")).alias("ts"),
        F.lit(-1).alias("user_id"),
        F.lit(1.0).alias("value"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name in ("event_type", "props")],
    )
    beat.select(*[F.col(f.name).cast(f.dataType) for f in events.schema]).write.parquet(landed)
    beats = sources.file_stream(spark, landed, events.schema)
    return sources.file_stream(spark, d, events.schema, "events.parquet").unionByName(beats)


def txn_stream(spark, d):
    return scoring.event_time(add_time_columns(txn_columns(event_stream(spark, d))))


@query(
    "stream_scoring",
    "id:i probability:f decision:s review_eligible:b mode:s",
    """SELECT id, p AS probability, CASE WHEN (1 - p) * 15 < p * (amount + 25) THEN 'block' ELSE 'allow' END AS decision,
              least(p * (amount + 25), (1 - p) * 15) - (1.5 + (1 - p) * 3) > 0 AS review_eligible, 'model' AS mode
       FROM (SELECT *, 1 / (1 + exp(-(0.8 * ln((0.01 + 0.9 * score) / (0.99 - 0.9 * score)) - 1.0))) AS p FROM txn)""",
)
def stream_scoring(spark, d):
    train = add_time_columns(txn_columns(table(spark, d, "events"))).where("day <= 10")
    fitted = Fitted(
        features.fit_frequencies(train, ["product"]),
        features.fit_amount_stats(train, ["product"], 10.0),
        features.fit_categories(train, ["product"], 50),
        ["product"],
        ["product"],
        ["product"],
    )
    calibrator = Platt(0.8, -1.0)

    def scorer(df):
        return df.withColumn("score", 0.01 + 0.9 * F.col("score"))

    decided = scoring.score_stream(txn_stream(spark, d), fitted, scorer, calibrator, COSTS, ["amount", "product"])
    return sources.drain(decided, "scoring").where("id >= 0")


@query(
    "stream_velocity",
    "id:i card:i n1h:i n24h:i n7d:i recency:f",
    f"SELECT id, card, n1h, n24h, n7d, round(CAST(recency AS DOUBLE), 4) AS recency FROM ({VELOCITY_SQL.format(source='txn')})",
)
def stream_velocity(spark, d):
    with sources.rocksdb(spark):
        out = sources.drain(velocity_stream(txn_stream(spark, d), "1 hour"), "velocity")
    return out.where("id >= 0").select(
        "id",
        "card",
        F.col("vel_n1h_card").alias("n1h"),
        F.col("vel_n24h_card").alias("n24h"),
        F.col("vel_n7d_card").alias("n7d"),
        F.round(F.col("vel_recency_card").cast("double"), 4).alias("recency"),
    )


@query("stream_dedup", "id:i", "SELECT id FROM txn")
def stream_dedup(spark, d):
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    doubled = txn_stream(spark, d).select("*", twice.alias("copy"))
    return sources.drain(scoring.dedup(doubled, "id", "event_time", "60 days"), "dedup").select("id").where("id >= 0")


@query(
    "stream_late_rows",
    "dropped:i",
    """SELECT count(*) AS dropped FROM txn WHERE day <= 10 AND dt < (SELECT max(dt) FROM txn WHERE day > 10) - 3600""",
)
def stream_late_rows(spark, d):
    """The first ten days arrive after all others; what is older than the watermark is counted."""
    rows = txn_columns(table(spark, d, "events"))
    folder, out, checkpoint = (scratch_path(spark, f"late-{x}") for x in ("in", "out", "ckpt"))
    days = F.floor(F.col("dt") / 86_400)
    dropped = 0
    with scoring.LateRows(spark) as late:
        for arriving in (days > 10, days <= 10):
            rows.where(arriving).write.mode("append").parquet(folder)
            sdf = scoring.event_time(sources.file_stream(spark, folder, rows.schema))
            with sources.state_partitions(spark):
                started = sources.start_files(scoring.dedup(sdf, "id", "event_time", "1 hour").select("id"), out, checkpoint)
            started.awaitTermination()
            dropped += late.total(started)
    return spark.createDataFrame([(dropped,)], "dropped long")


STREAM = TXN + """,
sd AS (SELECT *, CASE WHEN (1 - score) * 15 < score * (amount + 25) THEN 1 ELSE 0 END AS blocked FROM txn)
"""


def decided_stream(spark, d):
    from riskframe.operators.cost import decide

    rows = decide(txn_stream(spark, d).withColumn("probability", F.col("score")), COSTS)
    return scoring.watermarked(rows, "event_time", "1 hour")


@query(
    "stream_tumbling_rates",
    "day:i rows:i blocked:i mean_probability:f",
    "SELECT day, count(*) AS rows, sum(blocked) AS blocked, avg(score) AS mean_probability FROM sd GROUP BY 1",
    STREAM,
)
def stream_tumbling_rates(spark, d):
    out = sources.drain(rates.windowed_rates(decided_stream(spark, d), "1 day"), "tumbling")
    return out.withColumn("day", F.floor(F.unix_seconds("window_start") / 86_400))


@query(
    "stream_sliding_rates",
    "start_hour:i rows:i blocked:i",
    """SELECT h AS start_hour, count(*) AS rows, sum(blocked) AS blocked FROM (
         SELECT *, unnest([dt // 21600 * 6 - 18, dt // 21600 * 6 - 12, dt // 21600 * 6 - 6, dt // 21600 * 6]) AS h FROM sd)
       GROUP BY 1""",
    STREAM,
)
def stream_sliding_rates(spark, d):
    out = sources.drain(rates.windowed_rates(decided_stream(spark, d), "24 hours", "6 hours"), "sliding")
    return out.withColumn("start_hour", F.floor(F.unix_seconds("window_start") / 3600))


@query(
    "stream_sessions",
    "card:i rows:i amount:f start:i",
    """WITH x AS (SELECT card, dt, amount, CASE WHEN dt - lag(dt) OVER (PARTITION BY card ORDER BY dt, id) < 21600 THEN 0 ELSE 1 END AS s,
                         row_number() OVER (PARTITION BY card ORDER BY dt, id) AS rn FROM txn),
            y AS (SELECT *, sum(s) OVER (PARTITION BY card ORDER BY rn) AS k FROM x)
       SELECT card, count(*) AS rows, sum(amount) AS amount, min(dt) AS start FROM y GROUP BY card, k""",
)
def stream_sessions(spark, d):
    rows = scoring.watermarked(txn_stream(spark, d), "event_time", "1 hour")
    out = sources.drain(rates.session_counts(rows, "6 hours"), "sessions")
    return out.withColumn("start", F.unix_seconds("session_start"))


@query(
    "stream_bins",
    "day:i column:s bin:i n:i",
    """SELECT day, 'amount' AS "column", CAST(amount > 20 AS INT) + CAST(amount > 60 AS INT) AS bin, count(*) AS n FROM txn
       GROUP BY 1, 3""",
)
def stream_bins(spark, d):
    from riskframe.operators.drift import ReferenceBins

    rows = scoring.watermarked(txn_stream(spark, d), "event_time", "1 hour")
    out = sources.drain(rates.windowed_bins(rows, ReferenceBins({"amount": (20.0, 60.0)}, {}), "1 day"), "bins")
    return out.withColumn("day", F.floor(F.unix_seconds("window_start") / 86_400))


@query(
    "stream_review_queue",
    "id:i day:i gain:f review_share:f",
    "SELECT id, day, gain, share AS review_share FROM ev WHERE share > 0",
    TXN + "," + ev_sql(src="txn", cap=0.02),
)
def stream_review_queue(spark, d):
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "queue")
    checkpoint = scratch_path(spark, "queue-ckpt")
    rows = txn_stream(spark, d).withColumn("p", F.col("score")).where("id >= 0")
    landing = (
        rows.writeStream.format("parquet")
        .partitionBy("day")
        .option("path", landed)
        .option("checkpointLocation", scratch_path(spark, "landed-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    landing.awaitTermination()
    days = rates.closed_days(scoring.watermarked(txn_stream(spark, d), "event_time", "1 hour"))
    writer = rates.review_queue_writer(landed, out, COSTS, 0.02)
    with sources.state_partitions(spark):
        started = (
            days.writeStream.foreachBatch(writer)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    started.awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_label_maturity",
    "id:i label:f delay_days:f",
    """SELECT id, CASE WHEN id % 3 = 0 THEN is_fraud END AS label, CASE WHEN id % 3 = 0 THEN id % 4 + 1 END AS delay_days FROM txn""",
)
def stream_label_maturity(spark, d):
    predictions = txn_stream(spark, d).select("id", "event_time", "score")
    delay = F.pmod(F.col("id"), F.lit(4)) + 1
    labels = txn_stream(spark, d).where("id % 3 = 0 or id = -1").select(
        "id", F.timestamp_seconds(F.col("dt") + delay * 86_400).alias("label_time"), "is_fraud"
    )
    out = sources.drain(rates.mature_labels(predictions, labels), "maturity").where("id >= 0")
    return out.select("id", "label", F.date_diff("label_time", "event_time").alias("delay_days"))

