"""Embedding near-duplicates by an epsilon grid order join (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import attach, components, cut, table

# Leading principal dimensions that order the grid and bound the blocks.
LEADING = 8
# Vectors of the sample the principal dimensions are taken from; they only steer the pruning.
BASIS_ROWS = 10_000
# Vectors in one interval of the sequence, which is what a task joins with another, and in the
# smallest interval of the recursion.
INTERVAL, LEAF = 4096, 256
# Cosines this near the threshold are computed again by the plain formula.
NEAR = 1e-9


def principal(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vectors, its leading principal directions as columns."""
    basis = {}
    for size in {len(v) for v in sample}:
        rows = np.array([v for v in sample if len(v) == size])
        rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        _, directions = np.linalg.eigh(np.cov(rows.T).reshape(size, size) if len(rows) > 1 else np.eye(size))
        basis[size] = directions[:, ::-1][:, :LEADING]
    return basis


def _boxes(points: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return points[lo:hi].min(axis=0), points[lo:hi].max(axis=0)


def _apart(one: tuple, two: tuple) -> float:
    """Smallest squared distance of points in two boxes."""
    gap = np.maximum(0.0, np.maximum(one[0] - two[1], two[0] - one[1]))
    return float(gap @ gap)


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))))


def join_intervals(
    raw: np.ndarray, lead: np.ndarray, first: np.ndarray, second: np.ndarray, cosine: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine at or above `cosine`, one of `first` and one of `second` (index
    arrays in grid order; the same array twice joins it with itself, each pair once).

    Recursion on halves of the longer interval; a pair of intervals whose boxes on the leading
    dimensions lie further apart than the threshold allows is skipped.
    """
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    reach = 2 - 2 * cosine + 1e-9
    known: dict[tuple[int, int, int], tuple] = {}

    def box(which: int, lo: int, hi: int) -> tuple:
        if (key := (which, lo, hi)) not in known:
            points = lead[(first, second)[which][lo:hi]]
            known[key] = (points.min(axis=0), points.max(axis=0))
        return known[key]

    own = first is second
    stack = [(0, len(first), 0, len(second))] if len(first) and len(second) else []
    while stack:
        a, b, c, d = stack.pop()
        if own and (a, b) > (c, d):
            continue
        if _apart(box(0, a, b), box(0 if own else 1, c, d)) > reach:
            continue
        if max(b - a, d - c) > LEAF:
            if own and (a, b) == (c, d):
                m = (a + b) // 2
                stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                stack += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
            else:
                stack += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
            continue
        left, right = first[a:b], second[c:d]
        cosines = unit[left] @ unit[right].T
        if own and (a, b) == (c, d):
            cosines[np.tril_indices(b - a)] = -2.0
        i, j = np.nonzero(cosines >= cosine - NEAR)
        sure = cosines[i, j] >= cosine + NEAR
        for k in np.flatnonzero(~sure):
            sure[k] = _exact(raw[left[i[k]]], raw[right[j[k]]]) >= cosine
        yield left[i[sure]], right[j[sure]]


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[tuple[int, int]]:
    """Links of `pairs` that span what they connect."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for one, two in pairs:
        for a, b in zip(one.tolist(), two.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))
    return kept


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row for each row of `vectors`: n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine in double precision is
    at least `cosine`. Null and zero vectors, and those with a null or non-finite component, link
    with nothing, nor do vectors of different length. Equal vectors of a label are joined as one
    that counts for all (repeated rows link to each other).

    Distinct vectors are put in epsilon grid order: sorted by the cells, of the width of the
    largest linking distance, of their leading principal dimensions. Spark cuts the sequence of
    each label into intervals of up to 4,096 vectors and pairs those whose boxes are near enough;
    a task joins two intervals by recursion. It returns sums and a spanning forest, never all
    pairs. All pairs of intervals that might link are joined: dense data costs what it must.
    """
    rows = cut(
        vectors.select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.col(embedding).cast("array<double>").alias("e"),
            F.col(label).alias("label"),
        ).withColumn("key", F.md5(F.concat_ws("|", F.col("label").cast("string"), F.to_json(F.struct("e")))))
    )
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False)
    )
    distinct = cut(
        rows.where(valid)
        .groupBy("key")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("e").alias("e"))
    )
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(BASIS_ROWS).select("e").toPandas()["e"]
    basis = principal([np.asarray(v, dtype=np.float64) for v in sample])
    width = math.sqrt(max(2 - 2 * cosine, 1e-12))

    def gridded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lead = np.zeros((len(batch), LEADING))
            for i, v in enumerate(batch["e"]):
                v = np.asarray(v, dtype=np.float64)
                along = basis.get(len(v))
                p = (v if along is None else v @ along)[:LEADING] / np.linalg.norm(v)
                lead[i, : len(p)] = p
            batch["lead"] = list(lead)
            batch["cells"] = list(np.floor(lead / width).astype(np.int32))
            yield batch

    count = distinct.count()
    ordered = distinct.select("label", F.size("e").alias("size"), "rep", "n", "e").mapInPandas(
        gridded, f"label {dict(distinct.dtypes)['label']}, size int, rep long, n long, e array<double>, lead array<double>, cells array<int>"
    )
    order = ["label", "size", "cells", "rep"]

    def interval(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at, used, current = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            ids = []
            for key in zip(batch["label"], batch["size"], strict=True):
                if key != current or used == INTERVAL:
                    current, used, at = key, 0, at + 1
                used += 1
                ids.append((part << 32) | at)
            batch["interval"] = ids
            yield batch

    placed = cut(
        ordered.repartitionByRange(max(1, math.ceil(count / INTERVAL)), *order)
        .sortWithinPartitions(*order)
        .mapInPandas(interval, f"{ordered.schema.simpleString()[7:-1].replace(',', ', ').replace(':', ' ')}, interval long")
    )
    bounds = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(LEADING) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = cut(placed.groupBy("label", "size", "interval").agg(*bounds))
    other = boxes.select("label", "size", *[F.col(c).alias("o_" + c) for c in boxes.columns if c not in ("label", "size")])
    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"o_hi{k}"), F.col(f"o_lo{k}") - F.col(f"hi{k}")), 2)
        for k in range(LEADING)
    )
    pairs = (
        boxes.join(other, ["label", "size"])
        .where((F.col("interval") <= F.col("o_interval")) & (gap <= width * width + 1e-9))
        .select(F.col("interval").alias("first"), F.col("o_interval").alias("second"))
    )
    sides = pairs.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("interval"))

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(order=frame["cells"].map(tuple)).sort_values(["order", "rep"], ignore_index=True)
        raw, lead = np.array(frame["e"].tolist()), np.array(frame["lead"].tolist())
        one = np.flatnonzero(frame["interval"].to_numpy() == frame["first"].to_numpy())
        two = np.flatnonzero(frame["interval"].to_numpy() == frame["second"].to_numpy())
        if frame["first"].iloc[0] == frame["second"].iloc[0]:
            two = one
        found = list(join_intervals(raw, lead, one, two, cosine))
        n, reps, links = frame["n"].to_numpy(), frame["rep"].to_numpy(), np.zeros(len(frame), dtype=np.int64)
        for a, b in found:
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
        linked = np.flatnonzero(links)
        forest = np.array(_forest(found, len(frame)), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame(
            {
                "a": np.concatenate([reps[linked], reps[forest[:, 0]]]),
                "b": np.concatenate([reps[linked], reps[forest[:, 1]]]),
                "links": np.concatenate([links[linked], np.zeros(len(forest), dtype=np.int64)]),
            }
        )

    found = cut(
        placed.select("interval", "rep", "n", "e", "lead", "cells")
        .join(sides, "interval")
        .groupBy("first", "second")
        .applyInPandas(joined, "a long, b long, links long")
    )
    roots = components(found.where("a <> b").select("a", "b"))
    sums = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = (
        distinct.select("key", "rep", "n")
        .join(sums, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "key",
            "n",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    linked = attach(rows.where(valid).select("vec_id", "key"), cut(named), "key", "n").drop("key")
    alone = rows.where(~valid).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


# One row per vector, from all pairs of a label (feasible on the small tables DuckDB is given).
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""
