"""Monotone fits over data of any size: pooling adjacent violators in range partitions.

Pooling neighbours that violate the order, in any sequence, ends in the same blocks. So each range
of the scores is pooled by itself, and what is left is pooled again over ranges cut elsewhere, until
no border between two ranges holds a violation. Blocks stay a table: they are never collected, and
scores are looked up by a sweep over ranges that hold blocks and scores together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.lookup import null_safe_join
from riskframe.session import materialise

# Blocks, or scores, of one range.
ROWS_PER_RANGE = 100_000

BLOCK = ("lo", "hi", "p", "w")


def _pooled(lo: np.ndarray, hi: np.ndarray, p: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Blocks of rising mean from blocks in order; equal means are pooled too."""
    out = [np.empty_like(a) for a in (lo, hi, p, w)]
    los, his, ps, ws = out
    n = 0
    for a, b, s, t in zip(lo.tolist(), hi.tolist(), p.tolist(), w.tolist(), strict=True):
        while n and ps[n - 1] * t >= s * ws[n - 1]:
            n -= 1
            a, s, t = los[n], s + ps[n], t + ws[n]
        los[n], his[n], ps[n], ws[n] = a, b, s, t
        n += 1
    return [a[:n] for a in out]


def _pooling(keys: Sequence[str]):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        whole = [batch for batch in batches if len(batch)]
        if not whole:
            return
        rows = pd.concat(whole, ignore_index=True)
        starts = (rows[list(keys)] != rows[list(keys)].shift()).any(axis=1).to_numpy() if keys else np.zeros(len(rows), dtype=bool)
        starts[0] = True
        for a, b in zip(np.flatnonzero(starts), np.append(np.flatnonzero(starts)[1:], len(rows)), strict=True):
            part = rows.iloc[a:b]
            blocks = dict(zip(BLOCK, _pooled(*(part[c].to_numpy() for c in BLOCK)), strict=True))
            yield pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, **blocks, "at": TaskContext.get().partitionId()})

    return of


def monotone_blocks(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys…, lo, hi, p, w)`: the blocks of the monotone fit of `p / w` along `x`.

    `steps` holds one row `(keys…, x, p, w)` for each distinct x of a key, w above 0; keys are not
    null. A block's value is `p / w`, and values rise strictly from block to block of a key.
    """
    keys = list(keys)
    kinds = dict(steps.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{c} double" for c in BLOCK], "at int"])
    x = F.col("x").cast("double")
    blocks = steps.select(*keys, x.alias("lo"), x.alias("hi"), F.col("p").cast("double").alias("p"), F.col("w").cast("double").alias("w"))
    blocks = materialise(blocks, "steps")
    turn = 0
    while True:
        # another number of ranges has other borders
        ranges = max(1, math.ceil(blocks.count() / ROWS_PER_RANGE))
        ranges += turn % 2 if ranges > 1 else 0
        order = [*keys, "lo"]
        pooled = blocks.select(*keys, *BLOCK).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        blocks = materialise(pooled.mapInPandas(_pooling(keys), schema), "blocks")
        turn += 1
        if ranges == 1 or not _violations(blocks, keys):
            return blocks.drop("at")


def _violations(blocks: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the last block of a range and the first of the next are out of order: two rows a range."""
    place, own = F.struct(*keys, "lo"), F.struct(*keys, "p", "w")
    ends = blocks.groupBy("at").agg(F.min_by(own, place).alias("first"), F.max_by(own, place).alias("last"))
    rows = sorted(ends.collect(), key=lambda r: r["at"])
    for one, two in zip(rows, rows[1:], strict=False):
        a, b = one["last"], two["first"]
        if all(a[k] == b[k] for k in keys) and a["p"] * b["w"] >= b["p"] * a["w"]:
            return True
    return False


def breakpoints(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys…, x, value)`: both ends of every block, one row where they are the same."""
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select(*keys, F.explode(ends).alias("x"), (F.col("p") / F.col("w")).alias("value"))


def _looked_up(keys: Sequence[str], edges: dict):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [batch for batch in batches if len(batch)]
        if not whole:
            return
        rows = pd.concat(whole, ignore_index=True)
        groups = rows.groupby(list(keys), sort=False) if keys else [((), rows)]
        for key, part in groups:
            held = part[part["block"]]
            lo, hi, value = (held[c].to_numpy() for c in ("x", "hi", "value"))
            asked = part.loc[~part["block"], "x"].to_numpy()
            around = edges.get((int(part["at"].iloc[0]), *key), (None, None))
            for side, found in enumerate(around):
                if found is not None:
                    lo, hi, value = (
                        np.concatenate([[e], a] if side == 0 else [a, [e]]) for e, a in zip(found, (lo, hi, value), strict=True)
                    )
            if len(asked):
                yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "x": asked, "probability": interpolated(asked, lo, hi, value)})

    return of


def interpolated(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Constant on blocks, linear between them, flat outside; NaN where there is no block."""
    if not len(lo):
        return np.full(len(x), np.nan)
    at = np.clip(np.searchsorted(lo, x, side="right") - 1, 0, len(lo) - 1)
    after = np.minimum(at + 1, len(lo) - 1)
    gap = lo[after] - hi[at]
    share = np.where((x > hi[at]) & (after > at), (x - hi[at]) / np.where(gap > 0, gap, 1.0), 0.0)
    return value[at] + share * (value[after] - value[at])


def look_up(scores: DataFrame, blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys…, x, probability)` for every row `(keys…, x)` of `scores`, which are distinct numbers.

    Blocks and scores are laid out in the same ranges. A range also needs the last block before it and
    the first one after it; of each range and key the first and last block are looked at for that.
    """
    keys = list(keys)
    kinds = dict(scores.dtypes)
    value = (F.col("p") / F.col("w")).alias("value")
    held = blocks.select(*keys, F.col("lo").alias("x"), "hi", value, F.lit(True).alias("block"))
    nothing = F.lit(None).cast("double")
    asked = scores.select(*keys, F.col("x").cast("double").alias("x"), nothing.alias("hi"), nothing.alias("value"), F.lit(False).alias("block"))
    both = materialise(held.unionByName(asked), "scores")
    order = [*keys, "x"]
    ranges = max(1, math.ceil(both.count() / ROWS_PER_RANGE))
    laid = both.repartitionByRange(ranges, *order).withColumn("at", F.spark_partition_id())
    laid = materialise(laid, "ranges")
    place, own = F.struct("x"), F.struct("x", "hi", "value")
    ends = laid.where("block").groupBy("at", *keys).agg(F.min_by(own, place).alias("first"), F.max_by(own, place).alias("last"))
    by_key: dict[tuple, list] = {}
    for r in sorted(ends.collect(), key=lambda r: r["at"]):
        by_key.setdefault(tuple(r[k] for k in keys), []).append(r)
    edges = {}
    for key, rows in by_key.items():
        for at in range(ranges):
            before = [r["last"] for r in rows if r["at"] < at][-1:]
            after = [r["first"] for r in rows if r["at"] > at][:1]
            edges[(at, *key)] = tuple(tuple(e[0]) if e else None for e in (before, after))
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "x double", "probability double"])
    laid = laid.repartition(ranges, "at") if ranges > 1 else laid.coalesce(1)
    return laid.sortWithinPartitions("at", *order, F.desc("block")).mapInPandas(_by_range(keys, edges), schema)


def _by_range(keys: Sequence[str], edges: dict):
    one = _looked_up(keys, edges)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for at, part in batch.groupby("at", sort=False):
                if held and held[0]["at"].iloc[0] != at:
                    yield from one(iter(held))
                    held = []
                held.append(part)
        yield from one(iter(held))

    return of


def apply_blocks(df: DataFrame, score: str, blocks: DataFrame, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` with the fit of its score; null stays null and NaN stays NaN.

    Distinct scores are looked up and joined back by their value: the table grows with them, so its
    measured size decides how it is joined.
    """
    x = F.col(score).cast("double")
    usable = x.isNotNull() & ~F.isnan(x)
    # -0.0 and 0.0 are one score
    plain: Column = F.when(x == 0, F.lit(0.0)).otherwise(x)
    asked = df.where(usable).select(*keys, plain.alias("x")).distinct()
    found = look_up(asked, blocks, keys).withColumnRenamed("probability", "_fit")
    joined = null_safe_join(df.withColumn("x_", F.when(usable, plain)), found.withColumnRenamed("x", "x_"), [*keys, "x_"], "left")
    return joined.withColumn(out, F.when(F.isnan(x), F.lit(float("nan"))).otherwise(F.col("_fit"))).drop("x_", "_fit")
