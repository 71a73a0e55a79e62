"""Joins with a cardinality contract, and equality checks between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.lookup import null_safe_join
from riskframe.plans.gates import gated


def _check_keys(left: DataFrame, right: DataFrame, key: str, matched: bool = False) -> None:
    """Refuse a side that repeats a key and, if `matched`, a right key without a left row.

    One job: keys of both sides are counted together, combined before the shuffle. Null keys join
    with nothing; they count as one key that may not repeat.
    """
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    shown = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    stray = (F.col("r") > 0) & ((F.col("l") == 0) | F.col(key).isNull())
    told = {"the left side repeats key": F.col("l") > 1, "the right side repeats key": F.col("r") > 1}
    if matched:
        told["no row to join to for"] = stray
    row = counts.agg(*[F.min(F.when(c, shown)).alias(f"k{i}") for i, c in enumerate(told.values())]).first()
    for found, name in zip(row, told, strict=True):
        if found is not None:
            raise ValueError(f"{name} {key}={found}")


def left_join_flag(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Left one-to-one join; the flag says whether the join matched, whatever the values."""
    marked = right.withColumn("_m", F.lit(True))
    return left.join(marked, key, "left").withColumn(flag, F.col("_m").isNotNull()).drop("_m")


def checked_left_join_flag(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """`left_join_flag` after proving both sides unique and every right row matched."""
    _check_keys(left, right, key, matched=True)
    return left_join_flag(left, right, key, flag)


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    _check_keys(left, right, key)
    return left.join(right, key, how)


def enrich_required(left: DataFrame, right: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Left one-to-one enrichment; a row left without a required value fails the job."""
    joined = left.join(right, key, "left")
    return gated(joined, {f"no {c} for {key}": F.col(c).isNull() for c in required})


def alignment(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of two runs that do not match up: `only_left`, `only_right`, `label_differs`, `both`."""
    left = a.select(F.col(key), F.col(label).alias("_la"), F.lit(1).alias("_a"))
    right = b.select(F.col(key), F.col(label).alias("_lb"), F.lit(1).alias("_b"))
    joined = left.join(right, key, "full_outer")
    return joined.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(F.col("_la") != F.col("_lb")).alias("label_differs"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both_sides"),
    )


def align_runs(a: DataFrame, b: DataFrame, key: str, label: str, names: tuple[str, str]) -> DataFrame:
    """Two score vectors of one population side by side, scores named after the runs."""
    row = alignment(a, b, key, label).first()
    if row["only_left"] or row["only_right"] or row["label_differs"]:
        raise ValueError(f"the runs differ: {row.asDict()}")
    return a.withColumnRenamed("score", names[0]).join(
        b.select(key, F.col("score").alias(names[1])), key
    )


def reproduction(a: DataFrame, b: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """How exactly one score vector repeats another: missing rows and unequal scores."""
    left = a.select(F.col(key), F.col(score).alias("_sa"), F.lit(1).alias("_a"))
    right = b.select(F.col(key), F.col(score).alias("_sb"), F.lit(1).alias("_b"))
    joined = left.join(right, key, "full_outer")
    return joined.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        F.count_if(
            F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_sa").eqNullSafe(F.col("_sb"))
        ).alias("unequal"),
    )


def check_reproduces(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    row = reproduction(a, b, key).first()
    if row["unmatched"] or row["unequal"]:
        raise ValueError(f"the scores do not reproduce: {row.asDict()}")


def matrix_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows held by one table and not the other, copies counted `(side, rows)`.

    One pass: rows are grouped with a signed count instead of being subtracted twice.
    """
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise ValueError("the tables differ in columns or types")
    signed = a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
    net = signed.groupBy(*a.columns).agg(F.sum("_w").alias("_net")).where("_net <> 0")
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("_net") > 0, F.col("_net"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0)).alias("only_right"),
    )


def check_matrix(a: DataFrame, b: DataFrame) -> None:
    row = matrix_difference(a, b).first()
    if row["only_left"] or row["only_right"]:
        raise ValueError(f"the matrices differ: {row.asDict()}")


def diff_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only `(key, side)`."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    joined = left.join(right, key, "full_outer").where("_a is null or _b is null")
    return joined.select(key, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def semi(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(a, b.select(*keys), keys, "left_semi")


def union_scores(*frames: DataFrame) -> DataFrame:
    """Score vectors stacked by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
