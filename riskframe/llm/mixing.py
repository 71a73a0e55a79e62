"""Mixing sources to target weights by fitting subset sums (operator 3)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import attach, cut, table, words_in

# Words that the exact fit has to fill at most, besides the longest document.
FIT_WORDS = 65_536
# Documents of one source and length that one task ranks at most, about.
ROWS_PER_RUN = 10_000


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets that share the sum of `sizes` by weight, none above `most` times its size."""
    targets, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        for i in full or open_:
            targets[i] = float(most * sizes[i]) if full else weights[i] * unit
        left -= sum(targets[i] for i in full)
        open_ = open_ - full if full else set()
    return targets


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to `budget`.

    A proportional share of every length comes first, rounded down, so the choice keeps the
    source's shape. Long documents fill what is left down to a window, and a bounded knapsack over
    the lengths still at hand fits the window.
    """
    whole = int((lengths * counts).sum())
    if budget <= 0 or whole == 0:
        return np.zeros_like(counts)
    take = np.array([int(c) * budget // whole for c in counts], dtype=np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= FIT_WORDS:
            break
        if lengths[i] > 0:
            k = min(int(counts[i] - take[i]), (left - FIT_WORDS) // int(lengths[i]))
            take[i] += k
            left -= k * int(lengths[i])
    fitted, off = fill(lengths, counts - take, left)
    if off:
        # not exact: copies of long documents are given back, so that others can take their place
        room = 2 * int(lengths.max()) + FIT_WORDS
        back = np.zeros_like(take)
        for i in np.argsort(-lengths, kind="stable"):
            back[i] = min(int(take[i]), max(0, (room - left) // max(1, int(lengths[i]))), 2)
            left += int(back[i] * lengths[i])
        again, nearer = fill(lengths, counts - take + back, left)
        if nearer < off:
            return take - back + again
    return take + fitted


def fill(lengths: np.ndarray, spare: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Bounded knapsack: copies of each length whose sum is nearest to `left`, and how far it is.

    `step[s]` is the item (some copies of one length) that first reached sum s, so walking back
    from the nearest reachable sum uses no item twice.
    """
    take = np.zeros_like(spare)
    usable = [i for i in np.argsort(lengths, kind="stable") if lengths[i] > 0 and spare[i] > 0]
    if left <= 0 or not usable:
        return take, abs(left)
    top = left + int(lengths[usable[0]])
    reach = np.zeros(top + 1, dtype=bool)
    reach[0] = True
    step = np.full(top + 1, -1, dtype=np.int32)
    items: list[tuple[int, int]] = []
    for i in usable:
        length = int(lengths[i])
        if reach[left] or length > top:
            break
        free, k = min(int(spare[i]), top // length), 1
        while free > 0 and not reach[left]:
            k = min(k, free)
            new = reach[: top + 1 - k * length] & ~reach[k * length :]
            step[k * length :][new] = len(items)
            reach[k * length :] |= new
            items.append((i, k))
            free, k = free - k, 2 * k
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - left))])
    off = abs(at - left)
    while at > 0:
        i, k = items[step[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take, off


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3,
    seed: int = 17,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Every row of `docs` with its source's target and how often the mix takes it.

    Sources in order of code points, null last, get `weights` in turn and share all words; no
    target exceeds `most` times its source's size. Every document of a source is taken as often as
    the target holds the whole source, and what remains is fitted from counts by exact length, so
    no source meets in one task: the fit sees one row for each length. Documents of a length are
    then chosen by the hash of (seed, doc_id), lowest first: whole hash buckets below the
    cut, and ranks only in the buckets, of about 10,000 rows. Returns doc_id, source, size, source_size,
    target, taken, copies. The list of sources, on which the weights are given, goes through the
    driver. Empty or null texts have size 0: they are taken with their source's whole rounds and
    add no words. Repeated rows count as documents of their own.
    """
    spark = docs.sparkSession
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            words_in(F.col(text)).alias("size"),
        )
    )
    lengths = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    found = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    plan = []
    for no, (r, target) in enumerate(zip(found, targets, strict=True)):
        rounds = min(math.floor(most), int(target // r.words)) if r.words else 0
        budget = round(target) - rounds * r.words if rounds < most else 0
        plan.append((no, r.source, r.words, target, rounds, budget))
    plans = F.broadcast(
        spark.createDataFrame(
            plan, "no int, source string, source_size long, target double, rounds int, budget long"
        ).withColumnRenamed("source", "of")
    )

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        budget = int(frame["budget"].iloc[0])
        frame["extra"] = fit_counts(frame["size"].to_numpy(), frame["n"].to_numpy(), budget)
        return frame[["no", "size", "n", "extra"]]

    # one key for a source and a length: lengths stay far below 2^40
    cell = F.shiftleft(F.col("no").cast("long"), 40) + F.col("size")
    chosen = cut(
        lengths.join(plans, F.col("source").eqNullSafe(F.col("of")))
        .select("no", "size", "n", "budget")
        .groupBy("no")
        .applyInPandas(fitted, "no int, size long, n long, extra long")
        .select(cell.alias("cell"), "n", "extra", F.ceil(F.col("n") / ROWS_PER_RUN).alias("runs"))
    )
    keyed = rows.join(plans, F.col("source").eqNullSafe(F.col("of"))).drop("of", "budget").withColumn("cell", cell)
    order = F.xxhash64(F.lit(seed), "doc_id")
    spread = (F.shiftrightunsigned(order, 33) / F.lit(float(1 << 31))) * F.col("runs")
    placed = cut(attach(keyed, chosen, "cell", "n").withColumn("run", F.floor(spread)))
    before = Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("cell", "run").agg(F.count("*").alias("c")).withColumn(
        "start", F.coalesce(F.sum("c").over(before), F.lit(0))
    )
    within = Window.partitionBy("cell", "run").orderBy(F.shiftrightunsigned(order, 1), "doc_id")
    picked = (F.col("start") + F.col("at") <= F.col("extra")).cast("int")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(starts.drop("c"), ["cell", "run"])
        .withColumn("copies", F.col("rounds") + picked)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("copies")).cast("long").alias("taken"),
            "copies",
        )
    )


def repeated(docs: DataFrame, **settings: object) -> DataFrame:
    """The mix itself: every row of `docs` as often as `mix` takes it, rows taken 0 times gone.

    Takes the settings of `mix`. Rows meet their counts by doc_id; rows that repeat an id all take
    the largest count of theirs.
    """
    doc_id = settings.get("doc_id", "doc_id")
    counts = mix(docs, **settings).groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    counts = counts.where("__copies > 0").withColumnRenamed("doc_id", "__id")
    return (
        docs.join(counts, F.col(doc_id).eqNullSafe(F.col("__id")))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
        .drop("__copy", "__copies", "__id")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: sources weigh 5, 2, 1, no target above three times its source."""
    return mix(table(spark, sf_dir, "documents"))
