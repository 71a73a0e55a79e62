import zlib

import pytest
from pyspark.sql import functions as F

from riskframe.llm import quality
from tests.llm.data import documents, frame

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 8)
    got = quality.op4_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    good, bad = held[held["quality"] == 1], held[held["quality"] == 0]
    better = (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()[None, :]).mean()
    assert better > 0.9
    assert (good["predicted"] == 1).mean() > 0.95
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()


def test_held_out_labels_are_never_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, x) for x in (labels, turned))
    assert (one[0] == two[0]).all() and one[1] == two[1]


def test_odd_rows_and_labels(spark):
    rows = documents()
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, None), (None, 1, 1), (4, 0, 0), (4, 0, 0), (777, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    picked = {(r["doc_id"], r["label"]) for r in quality.labelled(frame(spark), labels, "quality").collect()}
    assert picked <= {(2, 1), (4, 0)}
    model = quality.train(frame(spark), labels)
    got = quality.classify(frame(spark), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if not (r["text"] or "").split()}
    assert len(empty) == 1
    assert quality.classify(frame(spark, []), quality.train(frame(spark, []), labels.limit(0))).collect() == []


def test_score_of_a_text_is_that_of_its_bag():
    import numpy as np

    parts = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    known = quality.WordScores(parts.tolist())
    for text in ("a b b b long-word", "same same same three word three word three word", "é x"):
        words = quality.split(text)
        same, again = quality.repeats(words)
        total = sum(map(known.__getitem__, words), same * known[quality.SAME] + again * known[quality.AGAIN])
        at, n = map(np.array, quality.bag(text))
        assert total.imag == n.sum() and total.real == pytest.approx(float((parts[at] * n).sum()), rel=1e-5)
