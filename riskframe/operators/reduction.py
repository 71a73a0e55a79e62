"""Column reduction: shared null patterns, correlation clusters, presence flags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from riskframe.functions import scalar as S
from riskframe.operators.features import fit_medians

# Columns per aggregate, below the size where generated code is split.
CHUNK = 100


@dataclass(frozen=True)
class Reduction:
    source: tuple[str, ...]
    representatives: tuple[str, ...]
    presence: tuple[str, ...]
    medians: dict[str, float]


def null_fingerprints(df: DataFrame, columns: Sequence[str], id_: str) -> DataFrame:
    """`(column, nulls, present, fingerprint)`: columns null on the same rows agree on all three.

    The fingerprint XORs a hash of the ids of the null rows, so it combines before the shuffle.
    NaN counts as null.
    """
    parts = []
    for start in range(0, len(columns), CHUNK):
        chunk = list(columns[start : start + CHUNK])
        row = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count_if(_missing_as_null(df, c).isNull()).alias("nulls"),
                    F.count(_missing_as_null(df, c)).alias("present"),
                    F.coalesce(F.bit_xor(F.when(_missing_as_null(df, c).isNull(), F.xxhash64(id_))), F.lit(0).cast("long")).alias("fingerprint"),
                ).alias(f"c{i}")
                for i, c in enumerate(chunk)
            ]
        )
        parts.append(row.select(F.inline(F.array(*[f"c{i}" for i in range(len(chunk))]))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _grouped(rows: list, columns: Sequence[str]) -> list[list[str]]:
    by_column = {r["column"]: (r["nulls"], r["fingerprint"]) for r in rows}
    groups: dict[tuple, list[str]] = {}
    for c in columns:
        groups.setdefault(by_column[c], []).append(c)
    return list(groups.values())


def null_pattern_groups(df: DataFrame, columns: Sequence[str], id_: str) -> list[list[str]]:
    """Columns grouped by identical null pattern, in order of first appearance."""
    return _grouped(null_fingerprints(df, columns, id_).collect(), columns)


def _missing_as_null(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    return F.nanvl(x, F.lit(None).cast("double")) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else x


def group_correlations(df: DataFrame, groups: Sequence[Sequence[str]]) -> list[np.ndarray]:
    """One Pearson matrix per group of columns, each over the rows complete in its own group.

    One pass takes the means, a second one the sums of products of all groups about them: a task
    adds up its rows in small matrices, and Spark adds up the tasks. The way is the same for any
    number of columns. NaN counts as missing. A column that does not vary over the complete rows
    has no coefficient.
    """
    matrices = [np.eye(len(g)) for g in groups]
    columns = list(dict.fromkeys(c for g in groups if len(g) > 1 for c in g))
    if not columns:
        return matrices
    usable = df.select(*[_missing_as_null(df, c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    means: dict[str, float] = {}
    for start in range(0, len(columns), CHUNK):
        part = usable.columns[start : start + CHUNK]
        means |= usable.agg(*[F.avg(c).alias(c) for c in part]).first().asDict()
    centre = np.array([means[c] or 0.0 for c in usable.columns])
    places = [[columns.index(c) for c in g] if len(g) > 1 else [] for g in groups]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((len(at) + 1, len(at) + 1)) for at in places]
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - centre
            known = ~np.isnan(x)
            for g, at in enumerate(places):
                if at:
                    rows = x[known[:, at].all(axis=1)][:, at]
                    rows = np.column_stack([rows, np.ones(len(rows))])
                    sums[g] += rows.T @ rows
        for g, m in enumerate(sums):
            i, j = np.nonzero(np.triu(np.ones_like(m)))
            yield pd.DataFrame({"g": g, "i": i, "j": j, "v": m[i, j]})

    found = usable.mapInPandas(products, "g int, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    sums = [np.zeros((len(at) + 1, len(at) + 1)) for at in places]
    for r in found.collect():
        sums[r["g"]][r["i"], r["j"]] = sums[r["g"]][r["j"], r["i"]] = r["v"]
    for g, at in enumerate(places):
        if at:
            matrices[g] = _pearson(sums[g], np.abs(centre[at]))
    return matrices


def _pearson(m: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Coefficients from sums of products; the last row and column hold the sums and the count.

    `scale` is the size of the values: what varies by less than their rounding does not vary.
    """
    count, total = m[-1, -1], m[-1, :-1]
    if count == 0:
        return np.where(np.eye(len(total), dtype=bool), 1.0, np.nan)
    cross = m[:-1, :-1] - np.outer(total, total) / count
    spread = np.diag(cross).copy()
    rounding = 1e-12 * np.diag(m[:-1, :-1]) + count * (1e-14 * scale) ** 2
    spread[spread <= rounding] = np.nan
    r = cross / np.sqrt(np.outer(spread, spread))
    np.fill_diagonal(r, 1.0)
    return r


def _greedy(columns: Sequence[str], r: np.ndarray, threshold: float) -> list[list[str]]:
    r = np.abs(r)
    clusters, open_ = [], list(range(len(columns)))
    while open_:
        head = open_[0]
        taken = [head] + [j for j in open_[1:] if r[head, j] >= threshold]
        clusters.append([columns[j] for j in taken])
        open_ = [j for j in open_ if j not in taken]
    return clusters


def correlation_clusters(df: DataFrame, columns: Sequence[str], threshold: float) -> list[list[str]]:
    """Greedy clusters: the first unclaimed column takes every later one at `|r| >= threshold`.

    Only the small matrix of coefficients reaches the driver; an undefined one joins nothing.
    """
    columns = list(columns)
    return _greedy(columns, group_correlations(df, [columns])[0], threshold) if columns else []


def fit_reduction(
    train: DataFrame,
    columns: Sequence[str],
    id_: str,
    correlation_threshold: float = 0.90,
    presence_threshold: float = 0.95,
    min_rows: int = 50,
) -> Reduction:
    """Representatives with enough observed rows, and presence flags that vary and differ."""
    rows = null_fingerprints(train, columns, id_).collect()
    stats = {r["column"]: r for r in rows}
    groups = _grouped(rows, columns)
    observed = [[c for c in group if stats[c]["present"] >= min_rows] for group in groups]
    matrices = group_correlations(train, observed)
    representatives = [
        members[0]
        for columns_, r in zip(observed, matrices, strict=True)
        for members in _greedy(columns_, r, correlation_threshold)
    ]
    heads = [g[0] for g in groups if min(stats[g[0]]["nulls"], stats[g[0]]["present"]) >= min_rows]
    flags = train.select(*[S.presence(c).alias(c) for c in heads]) if heads else train
    presence = [members[0] for members in correlation_clusters(flags, heads, presence_threshold)]
    medians = (
        {r["column"]: r["median"] for r in fit_medians(train, representatives).collect()}
        if representatives
        else {}
    )
    return Reduction(tuple(columns), tuple(representatives), tuple(presence), medians)


def apply_reduction(df: DataFrame, fitted: Reduction, prefix: str = "vb_") -> DataFrame:
    """The source columns replaced by filled representatives and presence flags."""
    built = {
        f"{prefix}{c}": F.coalesce(F.col(c).cast("double"), F.lit(fitted.medians.get(c))).cast("float")
        for c in fitted.representatives
    }
    flags = {f"{prefix}present_{c}": S.presence(c) for c in fitted.presence}
    return df.withColumns({**built, **flags}).drop(*fitted.source)


def reduction_table(spark, fitted: Reduction, prefix: str = "vb_") -> DataFrame:
    """The fitted reduction in long form `(column, role, median)`."""
    rows = [(f"{prefix}{c}", "representative", float(fitted.medians[c])) for c in fitted.representatives]
    rows += [(f"{prefix}present_{c}", "presence", None) for c in fitted.presence]
    return spark.createDataFrame(rows, "column string, role string, median double")


__all__ = [
    "Reduction",
    "apply_reduction",
    "correlation_clusters",
    "fit_reduction",
    "null_fingerprints",
    "null_pattern_groups",
    "reduction_table",
]
