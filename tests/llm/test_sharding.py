import zlib
from collections import defaultdict

import pytest

from riskframe.llm import sharding
from tests.llm.data import documents, frame


def dealt(spark, rows, shards):
    return [r.asDict() for r in sharding.shard(frame(spark, rows), shards).collect()]


def test_every_row_gets_one_slot_and_equal_texts_stay_together(spark):
    rows = documents()
    got = dealt(spark, rows, 5)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    together = defaultdict(set)
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 16
        assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        together[t].add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    for shard in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shards_are_level_but_for_a_group_larger_than_one(spark):
    rows = [(i, "x" * (i % 97), None, None, 0, "", 0, "", "") for i in range(1500)]
    rows += [(2000 + i, "hot text", None, None, 0, "", 0, "", "") for i in range(900)]
    got = dealt(spark, rows, 8)
    weight = defaultdict(int)
    for r in got:
        weight[r["shard"]] += r["size"]
    hot = {r["shard"] for r in got if r["doc_id"] >= 2000}
    assert len(hot) == 1
    rest = [w for s, w in weight.items() if s not in hot]
    assert len(rest) == 7 and max(rest) - min(rest) <= 0.1 * max(rest)
    assert weight[hot.pop()] == 900 * 24


def test_empty_table(spark):
    assert dealt(spark, [], 4) == []


@pytest.mark.parametrize("ways", [2, 3, 7])
def test_differencing_places_every_item(ways):
    sizes = sorted([5, 5, 5, 9, 1, 0, 30, 2, 2, 8], reverse=True)
    subsets = sharding.difference(([(s, i)] for i, s in enumerate(sizes)), ways)
    sums = [sum(s for s, w in zip(sizes, subsets, strict=True) if w == k) for k in range(ways)]
    assert sum(sums) == sum(sizes) and max(sums) <= max(30, sum(sizes) / ways + max(s for s in sizes if s < 30))
    assert sharding.difference([], ways) == []
    assert sorted(set(sharding.pack(sizes, ways))) == list(range(ways))
