"""Shards of nearly equal bytes by differencing (operator 2)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import attach, cut, table

# Bins the last differencing gets for each shard, and groups one task differences at most.
BINS_PER_SHARD = 64
GROUPS_PER_CELL = 200_000
# Rows numbered by one task.
ROWS_PER_RUN = 50_000


def difference(partials: Iterable[list], ways: int) -> list[int]:
    """Subset of every item, by largest differencing.

    A partial partition is a list of (sum, tree of items), one of each subset that is not empty.
    The two of largest spread are combined, the largest sum of one with the smallest of the other,
    until one is left. Equal spreads combine in the order given.
    """
    heap = []
    for order, partial in enumerate(partials):
        subsets = sorted(partial, key=lambda x: -x[0])
        subsets += [(0, None)] * (ways - len(subsets))
        heap.append((subsets[-1][0] - subsets[0][0], order, subsets))
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        joined = [
            (a + b, x if y is None else y if x is None else (x, y))
            for (a, x), (b, y) in zip(one, reversed(two), strict=True)
        ]
        joined.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], fresh, joined))
        fresh += 1
    placed: dict[int, int] = {}
    for subset, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                placed[node] = subset
    return [placed[i] for i in range(len(placed))]


def pack(sizes: list[int], bins: int) -> list[int]:
    """Bin of every item (sizes descending): differencing that starts from tuples of `bins`
    neighbours in size, so that the bins' counts stay level too and N / bins steps suffice."""
    tuples = ([(sizes[j], j) for j in range(i, min(i + bins, len(sizes)))] for i in range(0, len(sizes), bins))
    return difference(tuples, bins)


def shard(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows of `docs` in `shards` shards whose bytes are as equal as differencing makes them.

    Rows of equal text are one group that is never divided; a null text is a group of its own,
    apart from the empty text. A row weighs its text's UTF-8 bytes plus 16.

    Groups are packed in cells, each by one task: the large ones alone, the others in bins of
    nearly equal bytes. Only the bins (at most about max(64 a shard, one for 200,000 groups), and
    the fewer than 64 a shard groups that are larger than a bin) meet on the driver, where the
    second differencing deals them to shards. Slots number a shard's rows without a gap by runs of
    doc_id hashes, so no task numbers a whole shard. Repeated rows each get a slot of their own.
    """
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("")).alias("key"),
        )
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    cells = max(16, math.ceil(count / GROUPS_PER_CELL))
    bins = max(1, shards * BINS_PER_SHARD // cells)
    large = max(1, total // (shards * BINS_PER_SHARD))

    def binned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        alone = int((frame["bytes"] > large).sum())
        rest = frame["bytes"].iloc[alone:].tolist()
        frame["bin"] = [*range(bins, bins + alone), *pack(rest, bins)]
        return frame[["key", "cell", "bin", "bytes", "n"]]

    packed = cut(
        groups.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int"))
        .groupBy("cell")
        .applyInPandas(binned, "key string, cell int, bin int, bytes long, n long")
    )
    weights = packed.groupBy("cell", "bin").agg(F.sum("bytes").alias("bytes")).toPandas()
    weights = weights.sort_values(["bytes", "cell", "bin"], ascending=[False, True, True], ignore_index=True)
    weights["shard"] = difference(([(b, i)] for i, b in enumerate(weights["bytes"].tolist())), shards)
    dealt = docs.sparkSession.createDataFrame(
        weights[["cell", "bin", "shard"]].astype("int32"), "cell int, bin int, shard int"
    )
    placed = attach(rows, packed.join(dealt, ["cell", "bin"]).select("key", "shard", "n"), "key", "n")

    parts = max(4, math.ceil((rows.count()) / shards / ROWS_PER_RUN))
    placed = cut(placed.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("c")).withColumn(
        "start", F.coalesce(F.sum("c").over(before), F.lit(0))
    )
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(starts.drop("c"), ["shard", "run"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("at") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40)
