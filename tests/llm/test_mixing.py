import random
from collections import defaultdict

import numpy as np
import pytest

from riskframe.llm import mixing
from tests.llm.data import documents, frame


def best_sum(lengths, counts, budget):
    sums = {0}
    for length, count in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(count + 1)}
    return min(abs(s - budget) for s in sums)


def test_targets_share_everything_under_the_limit():
    assert mixing.water_fill([10, 10, 10], [1, 1, 1], 3) == [10, 10, 10]
    got = mixing.water_fill([100, 1, 50], [1, 5, 2], 3)
    assert got[1] == 3 and sum(got) == pytest.approx(151) and got[2] == pytest.approx(2 * got[0])
    assert mixing.water_fill([], [], 3) == [] and mixing.water_fill([0, 0], [5, 2], 3) == [0, 0]


def test_fit_is_as_near_as_any_choice():
    rng = random.Random(2)
    for _ in range(80):
        lengths = sorted(rng.sample(range(0, 60), rng.randrange(1, 6)))
        counts = [rng.randrange(1, 4) for _ in lengths]
        whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget = rng.randrange(0, whole + 1)
        take = mixing.fit_counts(np.array(lengths), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        off = abs(int((take * np.array(lengths)).sum()) - budget)
        # the proportional share comes first, so the fit may miss by a length or two
        assert off <= best_sum(lengths, counts, budget) + 2 * max(lengths)


def test_fit_of_many_documents_is_exact():
    lengths, counts = np.array([3, 50, 70_001, 200_000]), np.array([5000, 9000, 40, 9])
    budget = 2_222_222
    assert int((mixing.fit_counts(lengths, counts, budget) * lengths).sum()) == budget


def test_mix(spark):
    rows = documents()
    got = [r.asDict() for r in mixing.mix(frame(spark)).collect()]
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert order[-1] is None and order[0] == ""
    expected = mixing.water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    for s, t in zip(order, expected, strict=True):
        assert target[s] == pytest.approx(t)
        longest = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - t) <= longest
    again = sorted(map(repr, mixing.mix(frame(spark).repartition(3)).collect()))
    assert again == sorted(map(repr, [r for r in mixing.mix(frame(spark)).collect()]))


def test_hot_source_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RUN", 20)
    rows = [(i, "a b c", None, "s", 0, "", 0, "", "") for i in range(700)]
    rows += [(1000 + i, "w " * (i % 11), None, None, 0, "", 0, "", "") for i in range(100)]
    got = mixing.mix(frame(spark, rows)).collect()
    for source in ("s", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3


def test_repeated_rows_of_the_mix(spark):
    counts = {r["doc_id"]: r["copies"] for r in mixing.mix(frame(spark)).collect()}
    out = mixing.repeated(frame(spark))
    assert out.columns == frame(spark).columns
    seen = defaultdict(int)
    for r in out.select("doc_id").collect():
        seen[r[0]] += 1
    for doc_id, copies in counts.items():
        if doc_id != 2:
            assert seen[doc_id] == copies


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert mixing.repeated(frame(spark, [])).collect() == []
