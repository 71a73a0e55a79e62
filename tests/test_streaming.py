"""Streams equal the batch operators, whatever the arrival order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.config import Costs
from riskframe.operators import features
from riskframe.operators.cost import decide, ev_policy
from riskframe.session import scratch_path
from riskframe.streaming import rates, scoring, sources
from riskframe.streaming.velocity import velocity_stream

CLOSING = 4_000_000_000


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(6)
    n = 400
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "dt": np.sort(rng.integers(86_400, 6 * 86_400, n) // 1800 * 1800),
            "card": np.where(rng.random(n) < 0.4, 1, rng.integers(2, 20, n)),
            "amount": np.round(rng.lognormal(3, 1, n), 2),
            "is_fraud": (rng.random(n) < 0.1).astype(int),
            "p": rng.random(n),
        }
    )


def land(spark, parts):
    """Each part as one file, so that each becomes a batch of its own."""
    path = scratch_path(spark, "landing")
    for part in parts:
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, per_trigger=1):
    schema = spark.read.parquet(path).schema
    return sources.file_stream(spark, path, schema, files_per_trigger=per_trigger)


def test_velocity_stream_equals_batch_out_of_order(spark, events):
    rng = np.random.default_rng(1)
    closing = events.tail(1).assign(id=-1, dt=CLOSING, card=-1)
    order = np.argsort(events.dt + rng.integers(0, 5 * 3600, len(events)), kind="stable")
    late_parts = np.array_split(events.iloc[order], 3)
    path = land(spark, [*late_parts, closing])
    with sources.rocksdb(spark):
        got = sources.drain(velocity_stream(stream(spark, path), "12 hours"), "velocity").where("id >= 0").toPandas()
    want = features.velocity(spark.createDataFrame(events)).toPandas()
    columns = features.velocity_columns()
    got, want = got.sort_values("id"), want.sort_values("id")
    assert list(got.id) == list(want.id)
    np.testing.assert_allclose(got[columns].to_numpy(), want[columns].to_numpy(), rtol=1e-6)


def test_restart_from_a_checkpoint_repeats_nothing(spark, events):
    path = land(spark, [events.iloc[:200]])
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    run = lambda: sources.start_files(
        decide(stream(spark, path).withColumn("probability", F.col("p")), Costs()).select("id", "decision"), out, checkpoint
    ).awaitTermination()
    run()
    spark.createDataFrame(events.iloc[200:]).coalesce(1).write.mode("append").parquet(path)
    run()
    run()
    back = spark.read.parquet(out)
    assert back.count() == len(events) == back.select("id").distinct().count()


def test_late_rows_are_dropped_and_counted(spark, events):
    closing = events.tail(1).assign(id=-1, dt=int(events.dt.max()) + 30 * 86_400)
    straggler = events.head(3).assign(id=[900, 901, 902])
    path = land(spark, [events, closing, straggler])
    rows = scoring.watermarked(scoring.event_time(stream(spark, path)), "event_time", "1 hour")
    daily = rows.groupBy(F.window("event_time", "1 day")).agg(F.count(F.lit(1)).alias("n")).select("window.start", "n")
    out = scratch_path(spark, "late")
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    # the query itself remembers one batch only
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        with scoring.LateRows(spark) as late:
            query = sources.start_files(daily, out, scratch_path(spark, "late-ckpt"))
            query.awaitTermination()
            # an aggregate combines rows of a window before it drops them
            assert late.total(query) == 1
            single = scoring.dedup(scoring.event_time(stream(spark, path)), "id", "event_time", "1 hour").select("id")
            query = sources.start_files(single, scratch_path(spark, "late-id"), scratch_path(spark, "late-id-ckpt"))
            query.awaitTermination()
            assert late.total(query) == 3
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == len(events)


def test_duplicates_are_removed_across_batches(spark, events):
    path = land(spark, [events, events.sample(50, random_state=0)])
    rows = scoring.event_time(stream(spark, path))
    got = sources.drain(scoring.dedup(rows, "id", "event_time", "30 days"), "dedup")
    assert got.count() == len(events)


def test_review_queue_equals_the_batch_policy_and_replays_safely(spark, events):
    pdf = events.assign(day=(events.dt // 86_400).astype(int))
    closing = pdf.tail(1).assign(id=-1, dt=CLOSING, day=999)
    path = land(spark, [pdf, closing])
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "queue")
    spark.createDataFrame(pdf).write.partitionBy("day").parquet(landed)
    writer = rates.review_queue_writer(landed, out, Costs(), 0.05)
    days = rates.closed_days(scoring.watermarked(scoring.event_time(stream(spark, path)), "event_time", "1 hour"))
    days.writeStream.foreachBatch(writer).option("checkpointLocation", scratch_path(spark, "q")).trigger(availableNow=True).start().awaitTermination()
    want = ev_policy(spark.createDataFrame(pdf), Costs(), 0.05).where("review_share > 0")
    expected = {r["id"]: r["review_share"] for r in want.collect()}
    got = {r["id"]: r["review_share"] for r in spark.read.parquet(out).collect()}
    assert got == pytest.approx(expected)
    # the same closed days written again leave one copy
    again = spark.createDataFrame(pdf).select(F.timestamp_seconds(F.col("day") * 86_400).alias("day_start")).distinct()
    writer(again, 99)
    assert spark.read.parquet(out).count() == len(expected)


def test_labels_mature_or_come_out_empty(spark, events):
    labels = events[events.id % 2 == 0][["id", "dt", "is_fraud"]].copy()
    labels["dt"] = labels.dt + np.where(labels.id % 4 == 0, 5, 40) * 86_400
    closing = events.tail(1).assign(id=-1, dt=CLOSING)
    path = land(spark, [events, closing])
    label_path = land(spark, [labels, closing[["id", "dt", "is_fraud"]].assign(id=-2)])
    predictions = scoring.event_time(stream(spark, path)).select("id", "event_time", "p")
    late = stream(spark, label_path).select("id", F.timestamp_seconds("dt").alias("label_time"), "is_fraud")
    got = sources.drain(rates.mature_labels(predictions, late), "mature").where("id >= 0").toPandas()
    assert len(got) == len(events)
    # labels later than the window never attach
    assert set(got.id[got.label.notna()]) == set(events.id[events.id % 4 == 0])


def test_a_gap_of_the_full_length_starts_a_new_session(spark):
    rows = pd.DataFrame({"dt": [0, 21_599, 43_199, 50_000, CLOSING], "card": [1, 1, 1, 1, -1], "amount": [1.0, 2.0, 4.0, 8.0, 0.0]})
    sdf = scoring.event_time(stream(spark, land(spark, [rows])))
    out = sources.drain(rates.session_counts(scoring.watermarked(sdf, "event_time", "1 hour"), "6 hours"), "full-gap")
    got = out.select(F.unix_seconds("session_start"), F.unix_seconds("session_end"), "rows", "amount").collect()
    assert sorted(map(tuple, got)) == [(0, 43_199, 2, 3.0), (43_199, 71_600, 2, 12.0)]
