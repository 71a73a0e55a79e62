"""Conversation prefix trie, its subtree totals by time-forward processing (operator 12)."""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import attach, cut, table

# A prefix is named by polynomial sums of its turns' digests modulo four primes below 2^31, so that
# products fit a long: sums of a part are shifted and added without reading its turns again.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525081, 1220703125, 1583458089)
LOW = (1 << 31) - 1
# Conversations of a hundred share turns of its first one, at most this many.
GROUP, SHARED = 100, 5
# Nodes of a shard, messages of a queue held in memory, ids joined to one row.
SHARD_NODES, QUEUED, JOINED = 50_000, 500_000, 1_000


# ---- turns and their prefixes -----------------------------------------------------------


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 31).bitwiseOR(b)


def _parts(one: Column, two: Column) -> list[Column]:
    return [F.shiftright(one, 31), one.bitwiseAND(F.lit(LOW)), F.shiftright(two, 31), two.bitwiseAND(F.lit(LOW))]


def _packed(parts: list[Column]) -> tuple[Column, Column]:
    return _pair(parts[0], parts[1]), _pair(parts[2], parts[3])


def _shifted(start: list[Column], factor: list[Column], part: list[Column]) -> tuple[Column, Column]:
    """start + factor * part, modulo the primes."""
    return _packed([(s + f * x % p) % p for s, f, x, p in zip(start, factor, part, PRIMES, strict=True)])


def powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out


def _local_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted turns (c, x0..x3, chars): number and prefix sums within this part, `h` with the turn
    and `g` without it; `edge` marks the last turn here of the part's first and last conversation."""
    from pyspark import TaskContext

    pid, first, held = TaskContext.get().partitionId(), None, None
    last, count, sums = None, 0, [0] * 4
    table_of = [powers(b, p, 1024) for b, p in zip(BASES, PRIMES, strict=True)]
    for batch in batches:
        if not len(batch):
            continue
        c = batch["c"].to_numpy()
        if len(c) >= len(table_of[0]):
            table_of = [powers(b, p, len(c)) for b, p in zip(BASES, PRIMES, strict=True)]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        lengths = np.diff(starts, append=len(c))
        number = np.arange(1, len(c) + 1) - np.repeat(starts, lengths)
        more = slice(0, lengths[0] if c[0] == last else 0)
        out = {"pid": pid, "c": c, "rn": number.copy(), "chars": batch["chars"]}
        out["rn"][more] += count
        h, g = [], []
        for k, (base, p) in enumerate(zip(BASES, PRIMES, strict=True)):
            weight = table_of[k][number]
            weight[more] = weight[more] * pow(base, count, p) % p
            term = batch[f"x{k}"].to_numpy() * weight % p
            total = np.cumsum(term)
            total -= np.repeat(total[starts] - term[starts], lengths)
            total[more] += sums[k]
            h.append(total % p)
            g.append((total - term) % p)
        for name, s in (("h", h), ("g", g)):
            out |= {f"{name}1": (s[0] << 31) | s[1], f"{name}2": (s[2] << 31) | s[3]}
        first = c[0] if first is None else first
        frame = pd.DataFrame(out)
        tails = np.zeros(len(c), dtype=bool)
        tails[starts[1:] - 1] = True
        frame["edge"] = tails & (c == first)
        if held is not None:
            held["edge"] = held["c"].iloc[0] == first and c[0] != last
            yield held
        yield frame.iloc[:-1]
        held, last, count, sums = frame.iloc[-1:].copy(), c[-1], int(frame["rn"].iloc[-1]), [int(x[-1]) for x in h]
    if held is not None:
        held["edge"] = True
        yield held


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(c, rn, h1, h2, g1, g2, chars) of turns (c, turn, role, text): number and prefix names.

    The turns are laid out in ranges of (conversation, turn), which splits long conversations.
    What precedes a range is a sum over the ranges before it: at most two rows of each are looked at.
    """
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    hashed = [
        (F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") % p).alias(f"x{k}") for k, p in enumerate(PRIMES)
    ]
    turns = rows.select(
        "c", "turn", digest.alias("digest"), F.length("text").cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["c", "turn", "digest", "salt"]
    local = cut(
        turns.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("c", *hashed, "chars")
        .mapInPandas(
            _local_prefixes, "pid int, c long, rn long, chars long, h1 long, h2 long, g1 long, g2 long, edge boolean"
        )
    )
    before, offsets = {}, []
    for r in sorted(local.where("edge").select("c", "pid", "rn", "h1", "h2").collect()):
        n, sums = before.get(r["c"], (0, [0] * 4))
        factor = [pow(b, n, p) for b, p in zip(BASES, PRIMES, strict=True)]
        if n:
            pairs = [(s[0] << 31 | s[1], s[2] << 31 | s[3]) for s in (sums, factor)]
            offsets.append((r["pid"], r["c"], n, *pairs[0], *pairs[1]))
        own = [r["h1"] >> 31, r["h1"] & LOW, r["h2"] >> 31, r["h2"] & LOW]
        sums = [(s + f * x) % p for s, f, x, p in zip(sums, factor, own, PRIMES, strict=True)]
        before[r["c"]] = (n + r["rn"], sums)
    schema = "pid int, c long, n long, s1 long, s2 long, f1 long, f2 long"
    there = F.broadcast(rows.sparkSession.createDataFrame(offsets, schema))
    start, factor = _parts(F.col("s1"), F.col("s2")), _parts(F.col("f1"), F.col("f2"))
    moved = {x: _shifted(start, factor, _parts(F.col(f"{x}1"), F.col(f"{x}2"))) for x in "hg"}
    fixed = [
        F.when(F.col("n").isNull(), F.col(f"{x}{k + 1}")).otherwise(moved[x][k]).alias(f"{x}{k + 1}")
        for x in "hg"
        for k in (0, 1)
    ]
    rn = (F.col("rn") + F.coalesce("n", F.lit(0))).alias("rn")
    return local.join(there, ["pid", "c"], "left").select("c", rn, *fixed, "chars")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (c, depth, k1, k2, p1, p2, chars, last), and conversations (c, turnless).

    A conversation takes its first `h` turns from the first one of its hundred. The prefixes of what
    follows are those of its own turns, less its own first `h`, shifted behind the taken ones.
    """
    turns = numbered_turns(rows)
    taken = F.crc32(F.col("c").cast("string")) % (SHARED + 1)
    turns = turns.withColumn("h", taken)
    head = F.when((F.col("c") % GROUP == 0) & (F.col("rn") <= SHARED), F.struct("rn", "h1", "h2", "g1", "g2", "chars"))
    at_h = F.when(F.col("rn") == F.col("h"), F.struct("h1", "h2"))
    own = turns.groupBy("c", "h").agg(
        F.count("*").alias("n"), F.max(at_h).alias("skipped"), F.sort_array(F.collect_list(head)).alias("head")
    )
    own = cut(own.withColumn("first", F.col("c") - F.col("c") % GROUP))
    heads = own.where("c = first").select("first", F.col("head").alias("shared"))
    m = F.least("h", F.coalesce(F.size("shared"), F.lit(0)).cast("long"))
    conversations = cut(
        own.drop("head")
        .join(heads, "first", "left")
        .withColumn("m", F.when(F.col("shared").isNull(), F.lit(0).cast("long")).otherwise(m))
        .withColumn("end", F.when(F.col("m") > 0, F.element_at("shared", F.greatest("m", F.lit(1)).cast("int"))))
        .withColumn("shared", F.slice("shared", F.lit(1), F.col("m").cast("int")))
    )
    begun = conversations.select("c", "n", "h", "m", F.explode("shared").alias("t")).select(
        "c",
        F.col("t.rn").alias("depth"),
        F.col("t.h1").alias("k1"),
        F.col("t.h2").alias("k2"),
        F.col("t.g1").alias("p1"),
        F.col("t.g2").alias("p2"),
        F.col("t.chars").alias("chars"),
        ((F.col("t.rn") == F.col("m")) & (F.col("n") <= F.col("h"))).alias("last"),
    )
    zero = F.lit(0).cast("long")
    told = conversations.where("n > h").select(
        "c", "n", "m", (F.col("n") - F.col("h")).alias("count"),
        *[F.coalesce(F.col(f"end.h{k}"), zero).alias(f"b{k}") for k in (1, 2)],
        *[F.coalesce(F.col(f"skipped.h{k}"), zero).alias(f"o{k}") for k in (1, 2)],
    )
    rest = attach(turns.where("rn > h"), told, "c", "count")
    back = (F.col("h") - F.col("m") + 1).cast("int")
    inverse = [
        F.element_at(F.array(*[F.lit(pow(b, -s, p)).cast("long") for s in range(SHARED + 1)]), back)
        for b, p in zip(BASES, PRIMES, strict=True)
    ]
    start, skipped = _parts(F.col("b1"), F.col("b2")), _parts(F.col("o1"), F.col("o2"))

    def key(x: str) -> tuple[Column, Column]:
        own = [(a - b + p) % p for a, b, p in zip(_parts(F.col(f"{x}1"), F.col(f"{x}2")), skipped, PRIMES, strict=True)]
        return _shifted(start, inverse, own)

    (k1, k2), (p1, p2) = key("h"), key("g")
    followed = rest.select(
        "c", (F.col("m") + F.col("rn") - F.col("h")).alias("depth"), k1.alias("k1"), k2.alias("k2"),
        p1.alias("p1"), p2.alias("p2"), "chars", (F.col("rn") == F.col("n")).alias("last"),
    )
    return begun.unionByName(followed), conversations.select("c", ((F.col("m") == 0) & (F.col("n") <= F.col("h"))).alias("turnless"))


# ---- lists of members, hashed as they stream --------------------------------------------


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (depth, k1, k2, c) to rows of up to a thousand ids of one node, joined by commas."""
    key, ids = None, []

    def row() -> pd.DataFrame:
        return pd.DataFrame([(*key, ids[0], ",".join(map(str, ids)))], columns=["depth", "k1", "k2", "c", "ids"])

    for batch in batches:
        done = []
        for d, k1, k2, c in zip(*(batch[x].tolist() for x in ("depth", "k1", "k2", "c")), strict=True):
            if (d, k1, k2) != key or len(ids) == JOINED:
                if ids:
                    done.append(row())
                key, ids = (d, k1, k2), []
            ids.append(c)
        if done:
            yield pd.concat(done)
    if ids:
        yield row()


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted blocks to one digest for each node, without holding its list."""
    key, digest, columns = None, None, ["depth", "k1", "k2", "ends_sha256"]
    for batch in batches:
        done = []
        for d, k1, k2, ids in zip(*(batch[x].tolist() for x in ("depth", "k1", "k2", "ids")), strict=True):
            if (d, k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = (d, k1, k2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=columns)
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=columns)


def hashed_lists(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of (depth, k1, k2, c): SHA-256 of the ids in ascending order.

    SHA-256 reads its text in order, so the blocks of a node meet in one task; sorting and joining
    ids to blocks is spread over ranges, and the task streams one row for a thousand ids.
    """
    key = ["depth", "k1", "k2"]
    blocks = ends.select(*key, "c").repartitionByRange(*key, "c").sortWithinPartitions(*key, "c")
    blocks = blocks.mapInPandas(_blocks, "depth long, k1 long, k2 long, c long, ids string")
    streamed = blocks.repartition(*key).sortWithinPartitions(*key, "c")
    return streamed.mapInPandas(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


# ---- time-forward processing ------------------------------------------------------------


class MessageQueue:
    """A priority queue of (key, value) that keeps `limit` messages in memory.

    When full, it writes them as a sorted run to an unnamed file in Spark's own scratch folder of
    this task, which goes with the task, and merges the runs when it is read.
    """

    def __init__(self, limit: int | None = None) -> None:
        self.limit = QUEUED if limit is None else limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.spilled = 0

    def push(self, key: tuple, value: tuple) -> None:
        heapq.heappush(self.heap, (key, value))
        if len(self.heap) >= self.limit:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            run = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            self.heap.sort()
            for at in range(0, len(self.heap), 4096):
                pickle.dump(self.heap[at : at + 4096], run)
            run.seek(0)
            self.heap, self.spilled = [], self.spilled + 1
            self._advance(self._read(run))

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _advance(self, run: Iterator[tuple]) -> None:
        if (head := next(run, None)) is not None:
            self.order = getattr(self, "order", 0) + 1
            heapq.heappush(self.runs, (*head, self.order, run))

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][:2] < self.heap[0]):
            return self.runs[0][:2]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][:2] < self.heap[0]):
            key, value, _, run = heapq.heappop(self.runs)
            self._advance(run)
            return key, value
        return heapq.heappop(self.heap)

    def drop_before(self, key: tuple) -> None:
        while (head := self.peek()) is not None and head[0] < key:
            self.pop()


NODE = "a long, d long, pa long, pd long, leaves long, saved long"


def _downward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of a shard in the order of their parents, each with the top of its fragment (ra, rd).

    A node sends the top on to its children, which read it without taking it away; one that finds
    no message of its parent is a top itself.
    """
    queue = MessageQueue()
    for batch in batches:
        tops = []
        for a, d, pa, pd_ in zip(*(batch[x].tolist() for x in ("a", "d", "pa", "pd")), strict=True):
            queue.drop_before((pd_, pa))
            head = queue.peek()
            top = head[1] if head is not None and head[0] == (pd_, pa) else (a, d)
            tops.append(top)
            queue.push((d, a), top)
        yield batch.assign(ra=[t[0] for t in tops], rd=[t[1] for t in tops])


def _upward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of shards, deepest first, to their totals; a node's messages from outside precede it.

    Every node adds what its children sent to its own and sends the sum to its parent. What is
    addressed outside the shard is passed over when its place in the order is reached.
    """
    queue, shard, extra = MessageQueue(), None, [0, 0]
    columns = ("shard", "a", "d", "pa", "pd", "leaves", "saved", "node")
    for batch in batches:
        out = []
        for s, a, d, pa, pd_, leaves, saved, node in zip(*(batch[x].tolist() for x in columns), strict=True):
            if s != shard:
                queue, shard, extra = MessageQueue(), s, [0, 0]
            if not node:
                extra = [extra[0] + leaves, extra[1] + saved]
                continue
            queue.drop_before((-d, a))
            leaves, saved, extra = leaves + extra[0], saved + extra[1], [0, 0]
            while (head := queue.peek()) is not None and head[0] == (-d, a):
                _, (more_leaves, more_saved) = queue.pop()
                leaves, saved = leaves + more_leaves, saved + more_saved
            out.append((a, d, leaves, saved))
            if pd_ >= 0:
                queue.push((-pd_, pa), (leaves, saved))
        yield pd.DataFrame(out, columns=["a", "d", "leaves", "saved"])


def _summed(laid: DataFrame, messages: DataFrame | None) -> DataFrame:
    rows = laid.select("shard", "a", "d", "pa", "pd", "leaves", "saved", F.lit(True).alias("node"))
    if messages is not None:
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(
            messages.select("shard", "a", "d", zero.alias("pa"), zero.alias("pd"), "leaves", "saved", F.lit(False).alias("node"))
        )
    order = ["shard", F.desc("d"), "a", "node"]
    return rows.repartition("shard").sortWithinPartitions(*order).mapInPandas(_upward, "a long, d long, leaves long, saved long")


def subtree_totals(nodes: DataFrame, shards: int | None = None) -> DataFrame:
    """(a, d, leaves, saved): sums over the subtree of every node of a tree.

    `nodes` holds one row for each node (a, d) with its parent (pa, pd), pd < d, or pd = -1 at the
    top, and its own `leaves` and `saved`. Shards are ranges of (a, d), so even a path of many nodes
    is spread. In a shard, first in the order of parents, nodes learn the top of their fragment; the
    fragments' sums make a smaller tree. Fragments without others below them are done; the others
    are a tree of the same kind, whose totals come by the same steps over fewer shards. They then
    enter the shards as messages, and nodes in reverse level order pass totals to their parents.
    """
    count = nodes.count()
    wanted = math.ceil(count / SHARD_NODES)
    shards = max(1, wanted if shards is None else min(wanted, shards))
    if shards == 1:
        return _summed(nodes.withColumn("shard", F.lit(0)), None)
    laid = cut(
        nodes.repartitionByRange(shards, "a", "d")
        .withColumn("shard", F.spark_partition_id())
        .sortWithinPartitions("pd", "pa", "d", "a")
        .mapInPandas(_downward, f"{NODE}, shard int, ra long, rd long")
    )
    top = (F.col("a") == F.col("ra")) & (F.col("d") == F.col("rd"))
    fragments = cut(
        laid.groupBy("ra", "rd").agg(
            F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"),
            F.max(F.when(top, F.struct(F.col("pa").alias("a"), F.col("pd").alias("d")))).alias("at"),
        )
    )
    hanging = fragments.where("at.d >= 0")
    holders = hanging.groupBy("at").agg(F.count("*").alias("held"))
    holders = laid.select(F.struct("a", "d").alias("at"), "shard", F.col("ra").alias("na"), F.col("rd").alias("nd")).join(
        holders, "at"
    )
    linked = cut(attach(hanging, cut(holders), "at", "held"))
    inner = linked.groupBy(F.col("na").alias("ra"), F.col("nd").alias("rd")).agg(F.count("*").alias("below"))
    linked = cut(linked.join(inner, ["ra", "rd"], "left"))
    done = linked.where("below IS NULL").groupBy(F.col("na").alias("ra"), F.col("nd").alias("rd"))
    done = done.agg(F.sum("leaves").alias("done_leaves"), F.sum("saved").alias("done_saved"))
    up = linked.select("ra", "rd", "na", "nd")
    smaller = (
        fragments.join(inner, ["ra", "rd"])
        .join(done, ["ra", "rd"], "left")
        .join(up, ["ra", "rd"], "left")
        .select(
            F.col("ra").alias("a"),
            F.col("rd").alias("d"),
            F.coalesce("na", F.lit(0)).cast("long").alias("pa"),
            F.coalesce("nd", F.lit(-1)).cast("long").alias("pd"),
            (F.col("leaves") + F.coalesce("done_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("done_saved", F.lit(0))).alias("saved"),
        )
    )
    totals = subtree_totals(cut(smaller), shards // 2).select(
        F.col("a").alias("ra"), F.col("d").alias("rd"), F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved")
    )
    messages = (
        linked.join(totals, ["ra", "rd"], "left")
        .groupBy("shard", F.col("at.a").alias("a"), F.col("at.d").alias("d"))
        .agg(
            F.sum(F.coalesce("all_leaves", "leaves")).alias("leaves"), F.sum(F.coalesce("all_saved", "saved")).alias("saved")
        )
    )
    return _summed(laid, messages)


# ---- the trie ---------------------------------------------------------------------------


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the columns at the end.

    Turns stand in the order of `turn`, null first, those of one number in that of a digest of role
    and text. A null role or text is empty; rows without id take no part, other columns are not
    read. Each conversation c starts with the first h turns of c - c % 100 (h = crc32 of its digits
    modulo 6; fewer if there are fewer), followed by its own turns after its first h. A node is a
    distinct sequence of first turns, named by its smallest member and its depth. An empty table
    gives no row, not even a root. Equal sequences are told by 124 bits of sums over MD5 digests.

    Columns: conv_id, depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes
    of the subtree), saved_tokens ((n_convs - 1) times the code points of the last text, over the
    subtree), ends_sha256 (of the ascending ids of members that end here).
    """
    columns = {"c": F.col(conv_id).cast("long"), "turn": F.col(turn).cast("long")}
    columns |= {name: F.coalesce(F.col(c).cast("string"), F.lit("")) for name, c in (("role", role), ("text", text))}
    rows = conversations.select(*[x.alias(name) for name, x in columns.items()]).where(F.col("c").isNotNull())
    members, every = rebuilt(rows)
    members = cut(members)
    zero, key = F.lit(0).cast("long"), ["depth", "k1", "k2"]
    root = every.agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("turnless").alias("n_ends")
    ).where("n_convs > 0")
    nodes = cut(
        members.groupBy(*key)
        .agg(
            F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"),
            F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        )
        .unionByName(root.withColumns({c: zero for c in (*key, "chars", "p1", "p2")}))
    )
    above = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    nodes = nodes.join(above.agg(F.count("*").alias("n_children")), key, "left")
    nodes = cut(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    parents = nodes.where("n_children > 0").select(
        F.struct(*key).alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held")
    )
    upward = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    below = attach(nodes.where("depth > 0").withColumn("up", upward), parents, "up", "held").drop("up")
    none = F.lit(None).cast("long")
    nodes = cut(below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", none)))
    tree = nodes.select(
        F.col("conv_id").alias("a"),
        F.col("depth").alias("d"),
        F.coalesce("parent_conv_id", zero).alias("pa"),
        (F.col("depth") - 1).alias("pd"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    totals = subtree_totals(tree).select(
        F.col("a").alias("conv_id"), F.col("d").alias("depth"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )
    turnless = every.where("turnless").select(*[zero.alias(k) for k in key], "c")
    ends = hashed_lists(members.where("last").select(*key, "c").unionByName(turnless))
    return (
        nodes.join(totals, ["conv_id", "depth"])
        .join(ends, key, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "n_ends",
        )
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH turns AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS xs
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT c, xs, xor(list_reduce(
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda v, b: list_reduce(range(8), lambda w, i: CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END, xor(v, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
  FROM turns),
whole AS (
  SELECT a.c, list_concat(CASE WHEN a.h > 0 THEN coalesce(b.xs[1:a.h], []) ELSE [] END, a.xs[a.h + 1:]) AS ys
  FROM crc a LEFT JOIN turns b ON b.c = a.c - a.c % 100),
member AS (
  SELECT c, d, CASE WHEN d > 0 THEN ys[1:d] ELSE [] END AS p, len(ys) = d AS ends
  FROM (SELECT c, ys, unnest(range(len(ys) + 1)) AS d FROM whole)),
node AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, count(*) FILTER (ends) AS n_ends,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY d, p),
child AS (SELECT d - 1 AS d, CASE WHEN d > 1 THEN p[1:d - 1] ELSE [] END AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].t) ELSE 0 END AS saved
  FROM node n LEFT JOIN child c USING (d, p)),
total AS (
  SELECT e, CASE WHEN e > 0 THEN p[1:e] ELSE [] END AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT p, saved, n_children, unnest(range(d + 1)) AS e FROM full_node) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256, n.n_ends
FROM full_node n JOIN total t ON t.e = n.d AND t.p = n.p
LEFT JOIN node u ON u.d = n.d - 1 AND u.p = CASE WHEN n.d > 1 THEN n.p[1:n.d - 1] ELSE [] END
"""
