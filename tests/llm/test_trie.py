import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from riskframe.llm import trie
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, depth int, shard string, c long, h1 string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(own)] for c, own in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def conversations(seed, convs=60, most=12, spread=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.choice([rng.randrange(spread), rng.randrange(spread), 100 * rng.randrange(spread // 100 + 1), -rng.randrange(150)])
        if any(r[0] == c for r in rows):
            continue
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "éé x"]), 7, "s", 1, "h"))
    rows += [(5, None, "user", "first", 1, None, None, None), (None, 1, "user", "lost", 1, None, None, None)]
    rows += [rows[0], rows[0], (rows[1][0], 0, "user", "tie", 1, "s", 1, "h")]
    rng.shuffle(rows)
    return rows


def result(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, trie.prefix_trie(df).select(*COLUMNS).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = conversations(seed)
    assert result(spark, rows) == brute(rows)


def test_long_conversations_and_groups_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_NODES", 25)
    monkeypatch.setattr(trie, "QUEUED", 8)
    monkeypatch.setattr(trie, "JOINED", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversations(4, convs=40)
        rows += [(700, t, "user", f"x{t % 3}", 1, "s", 1, "h") for t in range(300)]
        rows += [(c, t, "user", f"x{t % 3}", 1, "s", 1, "h") for c in range(701, 740) for t in range(9)]
        assert result(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_conversations_and_empty_tables(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, t, "user", "gone", 1, "s", 1, "h") for t in range(3)]
    assert result(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert result(spark, []) == []
    assert result(spark, [(None, 1, "user", "x", 1, "s", 1, "h")]) == []


def random_tree(seed, n):
    rng = random.Random(seed)
    nodes = [(0, 0, 0, -1, 1, 10)]
    for a in range(1, n):
        pa, pd_ = nodes[rng.choice([-1, rng.randrange(len(nodes)), 0])][:2]
        nodes.append((a, pd_ + 1, pa, pd_, rng.randrange(3), rng.randrange(50)))
    return nodes


@pytest.mark.parametrize("seed, size, queued", [(1, 300, 5), (2, 300, 1000), (3, 120, 2)])
def test_totals_of_trees_over_shards(spark, monkeypatch, seed, size, queued):
    monkeypatch.setattr(trie, "SHARD_NODES", 12)
    monkeypatch.setattr(trie, "QUEUED", queued)
    nodes = random_tree(seed, size)
    leaves, saved = {n[:2]: n[4] for n in nodes}, {n[:2]: n[5] for n in nodes}
    for a, d, pa, pd_, *_ in sorted(nodes, key=lambda n: -n[1]):
        if pd_ >= 0:
            leaves[pa, pd_] += leaves[a, d]
            saved[pa, pd_] += saved[a, d]
    got = trie.subtree_totals(spark.createDataFrame(nodes, trie.NODE)).collect()
    assert len(got) == len(nodes)
    assert {(r["a"], r["d"]): (r["leaves"], r["saved"]) for r in got} == {k: (leaves[k], saved[k]) for k in leaves}


def test_queue_spills_and_pops_in_order():
    rng = random.Random(6)
    queue, model = trie.MessageQueue(limit=16), []
    for step in range(3000):
        if rng.random() < 0.6 or not model:
            item = ((step // 10 + rng.randrange(50), rng.randrange(4)), (step,))
            queue.push(*item)
            model.append(item)
        else:
            assert queue.peek() == min(model)
            assert queue.pop() == min(model)
            model.remove(min(model))
    assert queue.spilled > 10


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    wanted = con.sql(trie.ORACLE)
    got = trie.op12_conversation_trie(spark, SMALL)
    assert got.columns == list(wanted.columns)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(wanted.fetchall(), key=lambda r: r[:2])
