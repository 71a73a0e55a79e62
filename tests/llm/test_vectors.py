import math
import random

import duckdb
import numpy as np
import pytest

from riskframe.llm import vectors
from tests.conftest import SMALL
from tests.llm.test_simhash import roots

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int, kept boolean"


def fixture(seed=4, groups=25, size=6):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(size)]
        for k in range(rng.randrange(1, 9)):
            v = [c + rng.gauss(0, 0.07) for c in centre] if k else centre
            rows.append((len(rows), [float(np.float32(x)) for x in v], rng.choice([0, 0, 1, None]), "k", 1, True))
    rows += [(len(rows) + i, rows[0][1], 0, None, None, None) for i in range(4)]
    rows += [(len(rows) + i, v, 0, None, None, None) for i, v in enumerate(
        [None, [0.0] * size, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * size, [float("inf")] + [0.0] * 5, [], [1.0, 2.0], [2.0, 4.0]]
    )]
    return rows


def valid(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def check(rows, got, cosine=0.98):
    by_id = {r[0]: r for r in rows}

    def linked(a, b):
        (_, u, k, *_), (_, v, m, *_) = by_id[a], by_id[b]
        if k is None or k != m or not valid(u) or not valid(v) or len(u) != len(v):
            return False
        u, v = np.array(u, dtype=np.float64), np.array(v, dtype=np.float64)
        return float(u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v))) >= cosine

    nodes = sorted(by_id)
    root = roots(nodes, linked)
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        expected = (sum(linked(i, j) for j in nodes if j != i), root[i], root[i] == i)
        assert (r["n_links"], r["component_id"], r["kept"]) == expected, i


def test_links_and_components_equal_brute_force(spark):
    rows = fixture()
    check(rows, vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("interval, leaf", [(5, 2), (16, 3)])
def test_small_intervals_and_leaves_give_the_same(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(vectors, "INTERVAL", interval)
    monkeypatch.setattr(vectors, "LEAF", leaf)
    rows = fixture(7, 15, 3)
    check(rows, vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())


def test_recursion_skips_no_pair():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(300, 5))
    raw[150:] = raw[:150] + rng.normal(scale=0.08, size=(150, 5))
    basis = vectors.principal(list(raw))[5]
    lead = (raw @ basis) / np.linalg.norm(raw, axis=1, keepdims=True)
    order = np.lexsort(np.floor(lead / 0.2).T[::-1])
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    expected = {(min(a, b), max(a, b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True) if a != b}
    for leaf in (3, 64):
        vectors.LEAF, before = leaf, vectors.LEAF
        own = [(min(a, b), max(a, b)) for x, y in vectors.join_intervals(raw, lead, order, order, 0.98) for a, b in zip(x, y, strict=True)]
        half = [(min(a, b), max(a, b)) for x, y in vectors.join_intervals(raw, lead, order[:100], order[100:], 0.98) for a, b in zip(x, y, strict=True)]
        vectors.LEAF = before
        assert len(own) == len(set(own)) and set(own) == expected
        assert set(half) == {p for p in expected if (p[0] in set(order[:100].tolist())) != (p[1] in set(order[:100].tolist()))}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    columns = ["vec_id", "n_links", "component_id", "kept"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({vectors.ORACLE}) ORDER BY 1").fetchall()
    got = vectors.op8_embeddings(spark, SMALL).select(*columns).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == expected


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
