"""Hard negatives by slot-decomposed selection (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut, table

# Bytes of anchors that one wave holds on the driver and in each task.
WAVE_BYTES = 16 << 20
# Rows and anchors whose scores are computed at once, and anchors merged by one task at a time.
ROWS, ANCHORS, MERGED = 2048, 1024, 512
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
# Sums of products below this are exact in double precision.
EXACT = 2.0**53


def whole(lists: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row for each list; short lists are filled with 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers; a score beyond 64 bits raises OverflowError."""
    width = min(rows.shape[1], anchors.shape[1])
    a, b = rows[:, :width], anchors[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(len(m), width) for m in (a, b)]
    return (ints[0] @ ints[1].T).astype(np.int64)


class Best:
    """The k best distinct (score, id) of every cell: higher scores first, ties by smaller id."""

    def __init__(self, cells: int, k: int) -> None:
        self.k, self.least = k, np.full(cells, np.iinfo(np.int64).min)
        self.cell = self.score = self.id = np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((cell, score, ids))
        if sum(len(x[0]) for x in self.waiting) > len(self.cell) + ROWS:
            self.settle()

    def settle(self) -> None:
        cell, score, ids = (np.concatenate(x) for x in zip((self.cell, self.score, self.id), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((ids, ~score, cell))
        cell, score, ids = cell[order], score[order], ids[order]
        new = np.ones(len(cell), dtype=bool)
        new[1:] = (np.diff(cell) != 0) | (np.diff(score) != 0) | (np.diff(ids) != 0)
        cell, score, ids = cell[new], score[new], ids[new]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        rank = np.arange(len(cell)) - np.repeat(starts, np.diff(starts, append=len(cell)))
        top = rank < self.k
        self.cell, self.score, self.id = cell[top], score[top], ids[top]
        full = rank == self.k - 1
        self.least[cell[full]] = score[full]


class Wave:
    """Anchors of one pass over all rows, and the score windows of their positives."""

    def __init__(self, frame: pa.Table, scale: int) -> None:
        self.ids, self.labels = (frame.column(c).to_numpy() for c in ("id", "label"))
        self.vectors = whole(frame.column("e"), scale)
        self.positives: list[list[tuple[int, int]]] = [[] for _ in self.ids]

    def windows(self, low: int, high: int) -> None:
        """Per positive its limits; per anchor the disjoint slots that the upper limits cut.

        A window reaches from its upper limit, where its slot begins, down through the slots
        after it. Positives whose window holds no whole number have no slot.
        """
        self.limits, uppers = [], []
        for found in self.positives:
            bounds = [(-(-low * s // 100), high * s // 100) for s, _ in found]
            ends = sorted({b for a, b in bounds if a <= b}, reverse=True)
            self.limits.append([(a, b, ends.index(b)) if a <= b else None for a, b in bounds])
            uppers.append((ends, min((a for a, b in bounds if a <= b), default=0)))
        self.slots = max((len(e) for e, _ in uppers), default=0)
        nothing = np.iinfo(np.int64).min
        self.upper = np.full((self.slots, len(self.ids)), nothing)
        self.lower = np.full((self.slots, len(self.ids)), np.iinfo(np.int64).max)
        for i, (ends, least) in enumerate(uppers):
            self.upper[: len(ends), i] = ends
            self.lower[: len(ends), i] = [max(e + 1, least) for e in ends[1:]] + [least] * bool(ends)

    def chosen(self, anchor: int, slots: dict[int, list[tuple[int, int]]], k: int) -> Iterator[tuple]:
        """The k best of every window: suffix merges of the slots, from the lowest scores up."""
        merged: dict[int, list[tuple[int, int]]] = {self.slots: []}
        for slot in reversed(range(self.slots)):
            merged[slot] = (slots.get(slot, []) + merged[slot + 1])[:k]
        for (score, positive), limit in zip(self.positives[anchor], self.limits[anchor], strict=True):
            kept = [x for x in merged[limit[2]] if x[0] >= limit[0]] if limit else []
            for rank, (s, negative) in enumerate(kept, 1):
                yield int(self.ids[anchor]), positive, rank, negative, score, s


def _scan(rows: DataFrame, wave, scale: int, k: int, negatives: bool) -> DataFrame:
    """(anchor, slot, score, id): for each cell the k best rows of every task, then of all."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = wave.value
        slots = w.slots if negatives else 1
        best = Best(len(w.ids) * slots, k)
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in (0, 1))
            vectors = whole(batch.column(2), scale)
            for at in range(0, len(ids), ROWS):
                part = slice(at, at + ROWS)
                for first in range(0, len(w.ids), ANCHORS):
                    some = slice(first, first + ANCHORS)
                    found = scores(vectors[part], w.vectors[some])
                    same = labels[part, None] == w.labels[None, some]
                    fits = ~same if negatives else same & (ids[part, None] != w.ids[None, some])
                    for slot in range(slots):
                        cells = np.arange(first, first + found.shape[1]) * slots + slot
                        here = fits & (found >= best.least[cells])
                        if negatives:
                            here &= (found <= w.upper[slot, some]) & (found >= w.lower[slot, some])
                        i, j = np.nonzero(here)
                        if len(i):
                            best.add(cells[j], found[i, j], ids[part][i])
        best.settle()
        if len(best.cell):
            columns = [best.cell // slots, (best.cell % slots).astype(np.int32), best.score, best.id]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "score", "id"])

    every = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    found = rows.mapInArrow(partial, "anchor long, slot int, score long, id long")
    return found.withColumn("at", F.dense_rank().over(every)).where(F.col("at") <= k).drop("at").distinct()


def _merging(wave, k: int):
    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        frame = frame.sort_values(["anchor", "slot", "score", "id"], ascending=[True, True, False, True])
        for anchor, own in frame.groupby("anchor"):
            slots = {slot: list(zip(x["score"], x["id"], strict=True)) for slot, x in own.groupby("slot")}
            found += wave.value.chosen(int(anchor), slots, k)
        return pd.DataFrame(found, columns=list(COLUMNS))

    return merged


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a row's score is its inner product with the anchor, and
    missing components of a shorter vector count as 0. An anchor's positives are its best other
    rows of its label; for each, the best rows of other labels whose score is `low` to `high`
    percent of the positive's, both included, are its negatives. Higher scores come first, ties by
    smaller id. `is_anchor` is a condition over the columns of `rows`; others are ignored.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Rows of
    one id are never each other's positive; those with the same score for an anchor count once, so
    repeated rows change nothing. Anchors without positives, and positives whose window is empty
    (as with negative scores), give no row. A score beyond 64 bits raises OverflowError.

    All rows are scored against all anchors, in waves of anchors of bounded bytes: a wave is
    broadcast and the rows are scanned where they lie, first for positives, then for negatives.
    The upper limits of the positives' windows cut the scores into disjoint slots. A task keeps the
    best few of each slot only, tasks are combined slot by slot, and suffix merges from the lowest
    slot up answer every window. No row is shuffled, and no label is a group.
    """
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = rows.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(embedding).cast("array<double>").alias("e"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    pool = some.select("id", "label", "e")
    anchors = some.where("is_anchor").select("id", "label", "e").distinct()
    size = anchors.agg(F.sum(24 + 8 * F.size("e"))).first()[0] or 0
    waves = math.ceil(size / WAVE_BYTES)
    context = rows.sparkSession.sparkContext
    schema = ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in COLUMNS)
    out = rows.sparkSession.createDataFrame([], schema)
    for n in range(waves):
        mine = anchors.where(F.pmod(F.xxhash64("id", "label", "e"), F.lit(waves)) == n)
        wave = Wave(mine.toArrow().sort_by([("id", "ascending"), ("label", "ascending")]), scale)
        if not len(wave.ids):
            continue
        best = _scan(pool, context.broadcast(wave), scale, positives, False).orderBy("anchor", F.desc("score"), "id")
        for r in best.toLocalIterator():
            wave.positives[r["anchor"]].append((r["score"], r["id"]))
        wave.windows(low, high)
        if not wave.slots:
            continue
        limited = context.broadcast(wave)

        chosen = (
            _scan(pool, limited, scale, negatives, True)
            .groupBy(F.floor(F.col("anchor") / MERGED).alias("block"))
            .applyInPandas(_merging(limited, negatives), schema)
        )
        out = chosen if waves == 1 else out.unionByName(cut(chosen))
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all; every seventh has a shifted label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n
  ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
