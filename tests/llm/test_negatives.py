import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import negatives
from tests.conftest import SMALL

SCHEMA = "vec_id long, label int, embedding array<float>, score int, anchor boolean, slot string"


def fixture(seed=3, rows=160, size=5):
    rng = random.Random(seed)
    out = [
        (i, rng.choice([0, 0, 0, 1, 2]), [float(np.float32(rng.choice([rng.gauss(0.1, 0.2), 0.25]))) for _ in range(size)], 1, True, "s")
        for i in range(rows)
    ]
    out += [(rows + k, 1, out[5][2], None, None, None) for k in range(6)]
    odd = [None, [], [float("nan")] * size, [1.0, None], [float("inf")], [0.0] * size, [0.5, 0.5], [0.3] * (size + 2)]
    out += [(300 + k, 0, v, 1, True, "s") for k, v in enumerate(odd)]
    return [*out, (400, None, [0.1] * size, 1, True, "s"), (None, 0, [0.9] * size, 1, True, "s"), out[20], out[20], out[21]]


def brute(rows, is_anchor, k=5, n=3, low=50, high=95):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    clean = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v, *_ in rows if i is not None and label is not None and good(v)}
    found = []
    for i, label, v in clean:
        if not is_anchor(i):
            continue
        every = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in clean if j != i or m != label]
        best = sorted({(s, j) for s, j, m in every if m == label and j != i})[:k]
        for s, j in best:
            fits = sorted({(t, q) for t, q, m in every if m != label and low * -s <= 100 * -t <= high * -s})[:n]
            found += [(i, j, rank, q, -s, -t) for rank, (t, q) in enumerate(fits, 1)]
    return sorted(found)


def run(spark, rows, every=4, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def test_equals_brute_force_with_odd_rows_ties_and_repeats(spark):
    rows = fixture()
    expected = brute(rows, lambda i: i % 4 == 0)
    assert len(expected) > 100
    assert run(spark, rows) == expected


@pytest.mark.parametrize("options", [{"positives": 1, "negatives": 1}, {"positives": 9, "negatives": 4, "low": 20, "high": 100}])
def test_other_settings(spark, options):
    rows = fixture(seed=8)
    wanted = brute(rows, lambda i: i % 4 == 0, options["positives"], options["negatives"], options.get("low", 50), options.get("high", 95))
    assert run(spark, rows, **options) == wanted


def test_many_waves_and_small_blocks_give_the_same(spark, monkeypatch):
    rows = fixture(seed=5)
    for name, value in (("WAVE_BYTES", 700), ("ROWS", 7), ("ANCHORS", 3), ("MERGED", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert run(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_a_hot_label_of_equal_vectors(spark):
    rows = [(i, 0 if i % 3 else 1, [0.5, 0.25], 1, True, "s") for i in range(300)]
    rows += [(300 + i, 2, [0.4, 0.2], 1, True, "s") for i in range(50)]
    assert run(spark, rows, every=50) == brute(rows, lambda i: i % 50 == 0)


def test_large_components_are_exact_and_tables_may_be_empty(spark):
    rows = [(i, i % 2, [float(2**22 + 1000 * i), 3.5], 1, True, "s") for i in range(40)]
    wanted = brute(rows, lambda i: i % 4 == 0, low=0, high=100)
    assert run(spark, rows, low=0, high=100) == wanted
    assert run(spark, []) == []
    assert run(spark, [(1, 0, [1.0], 1, True, "s")]) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    wanted = sorted(con.sql(negatives.ORACLE).fetchall())
    got = sorted(map(tuple, negatives.op11_hard_negatives(spark, SMALL).collect()))
    assert got == wanted and got
