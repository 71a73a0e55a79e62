"""The serving transform: fitted tables applied to rows that carry no label."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskframe.operators.features import (
    add_amount_features,
    apply_amount_stats,
    apply_categories,
    apply_frequencies,
    fill_history,
)
from riskframe.operators.joins import check_matrix
from riskframe.operators.splits import add_time_columns
from riskframe.sources.io import conform


@dataclass(frozen=True)
class Fitted:
    """Tables fitted on train, and the columns each family reads."""

    frequencies: DataFrame
    stats: DataFrame
    vocabulary: DataFrame
    encoded: Sequence[str]
    entities: Sequence[str]
    categorical: Sequence[str]
    optional: T.StructType = field(default_factory=T.StructType)


def transform(df: DataFrame, fitted: Fitted, columns: Sequence[str] | None = None) -> DataFrame:
    """Every family built from fitted tables only; history is filled unless supplied.

    There is no ordering and no aggregate in it, so the same function serves a stream.
    """
    rows = conform(df, ["id", "dt", "amount", "product"], ["dt", "amount"], fitted.optional)
    rows = add_time_columns(rows)
    rows = add_amount_features(rows)
    rows = apply_frequencies(rows, fitted.frequencies, fitted.encoded)
    rows = apply_amount_stats(rows, fitted.stats, fitted.entities)
    rows = fill_history(rows)
    rows = apply_categories(rows, fitted.vocabulary, fitted.categorical)
    if columns is None:
        return rows
    unbuilt = [c for c in columns if c not in rows.columns]
    if unbuilt:
        raise ValueError(f"columns the model expects were not built: {unbuilt}")
    return rows.select(*columns)


def build_horizon(
    later: DataFrame, labelled: DataFrame, reference: DataFrame, fitted: Fitted, columns: Sequence[str],
    score: Callable[[DataFrame], DataFrame] | None = None, persisted: DataFrame | None = None,
    check: Callable[[DataFrame, DataFrame], None] | None = None,
) -> DataFrame:
    """Unlabelled rows through the same transform, once it has been proved on labelled rows.

    The proof is the training-time matrix, reproduced exactly; with `score`, which turns a matrix into
    scores, also the `persisted` scores, compared by `check`. Then the later rows are scored.
    """
    matrix = transform(labelled, fitted, columns)
    check_matrix(matrix, reference.select(*columns))
    if score is None:
        return transform(later, fitted, columns)
    if persisted is None or check is None:
        raise ValueError("scores on record are needed to prove a model by")
    check(score(matrix), persisted)
    return score(transform(later, fitted, columns))
