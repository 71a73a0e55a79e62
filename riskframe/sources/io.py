"""Typed scans and sinks."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.config import GLOBAL, SPLITS
from riskframe.plans.gates import gated

# Columns whose type is declared by name rather than by the default rule.
NAMED_TYPES: dict[str, T.DataType] = {
    "TransactionID": T.IntegerType(),
    "TransactionDT": T.IntegerType(),
    "TransactionAmt": T.DoubleType(),
    "isFraud": T.ByteType(),
    "has_identity": T.BooleanType(),
}


def declared_schema(columns: Iterable[str], text_columns: Iterable[str]) -> T.StructType:
    """Named columns by name, text columns as strings, every other number as float32."""
    text = set(text_columns)
    return T.StructType(
        [
            T.StructField(c, NAMED_TYPES.get(c, T.StringType() if c in text else T.FloatType()))
            for c in columns
        ]
    )


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return next(csv.reader([line[0]], delimiter=sep))


def read_typed(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV scan under a declared schema; a stray or undeclared column is refused."""
    header = _header(spark, path, sep)
    undeclared = sorted(set(header) - set(schema.names))
    absent = sorted(set(schema.names) - set(header))
    if undeclared or absent:
        raise ValueError(f"{path}: undeclared columns {undeclared}, declared but absent {absent}")
    ordered = T.StructType([schema[name] for name in header])
    return (
        spark.read.schema(ordered)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("sep", sep)
        .csv(path)
        .select(*schema.names)
    )


def measure_cardinality(
    df: DataFrame, columns: Sequence[str], sample_rows: int | None = None, head_by: str | None = None
) -> DataFrame:
    """Distinct non-null levels per text column `(column, levels, rows)`.

    `sample_rows` is the head sample the typing rule is stated on: the rows of smallest `head_by`,
    since a table has no order of its own. Without it the whole table is counted. Levels are
    counted before columns, so no task holds a column.
    """
    source = df.select(*columns)
    if sample_rows is not None:
        if head_by is None:
            raise ValueError("a head sample needs the column that orders the table")
        source = df.orderBy(head_by).limit(sample_rows).select(*columns)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]
    )
    per_level = source.select(F.inline(cells)).groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return per_level.groupBy("column").agg(
        F.count("level").alias("levels"), F.sum("rows").alias("rows")
    )


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, predicate: Column | str | None = None) -> DataFrame:
    """Parquet scan; the filter and the column list reach the reader."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def write_matrices(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """One directory per split; rows outside every split are dropped and accounted for.

    The rebalance lets adaptive execution cut a large split into even files. The source is read
    once: rows are counted as they pass on their way to the files.

    Returns `(split, rows)` with the dropped rows under a null split.
    """
    known = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    seen = Observation()
    counted = df.observe(
        seen, F.count_if(~known).alias("dropped"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )
    counted.where(known).hint("rebalance", F.col("split")).write.mode(mode).partitionBy("split").parquet(path)
    rows = [(None if s == "dropped" else s, n) for s, n in seen.get.items() if n]
    return df.sparkSession.createDataFrame(rows, "split string, rows long")


def load_matrices(spark: SparkSession, path: str, columns: Sequence[str] | None = None, splits: Sequence[str] = SPLITS) -> DataFrame:
    """All wanted splits as one table; the split comes back from the layout."""
    unknown = sorted(set(splits) - set(SPLITS))
    if unknown:
        raise ValueError(f"unknown splits: {unknown}")
    df = spark.read.parquet(path).where(F.col("split").isin(*splits))
    return df.select(*columns, "split") if columns else df


def write_predictions(df: DataFrame, path: str, splits: Sequence[str], mode: str = "error") -> None:
    """Score vector of the requested splits; an empty result is refused."""
    seen = Observation()
    kept = df.where(F.col("split").isin(*splits)).select("id", "split", "day", "is_fraud", "score")
    kept.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    if not seen.get.get("n"):
        _remove(df.sparkSession, path)
        raise ValueError(f"no rows in {list(splits)}: nothing to write")


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this process has just written, wherever it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_report(metrics: DataFrame, path: str, as_csv: bool = False, mode: str = "error") -> None:
    """Metric table as JSON lines (nested values kept) or as CSV."""
    if as_csv:
        metrics.write.mode(mode).option("header", True).csv(path)
    else:
        metrics.write.mode(mode).option("ignoreNullFields", False).json(path)


def rename_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Columns spelled with one prefix, renamed to another."""
    renames = {c: new + c[len(old):] for c in df.columns if c.startswith(old)}
    clash = sorted(set(renames.values()) & set(df.columns))
    if clash:
        raise ValueError(f"renaming {old!r} to {new!r} would duplicate {clash}")
    return df.withColumnsRenamed(renames)


def conform(df: DataFrame, required: Sequence[str], non_null: Sequence[str], optional: T.StructType) -> DataFrame:
    """Required inputs present, the non-null ones checked on use, absent optional ones typed nulls."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"required inputs are missing: {absent}")
    gaps = {f.name: F.lit(None).cast(f.dataType) for f in optional if f.name not in df.columns}
    if df.isStreaming:
        # a stream has no whole to count over: it ends at the row
        told = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} arrived null"))).otherwise(F.col(c)) for c in non_null}
        return df.withColumns({**told, **gaps})
    return gated(df, {f"{c} arrived null": F.col(c).isNull() for c in non_null}).withColumns(gaps)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The named columns cast to their declared types, in the declared order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def save_fitted(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def load_fitted(
    spark: SparkSession,
    path: str,
    group: str,
    key: str,
    dense_code: str | None = None,
    non_null: Sequence[str] = (),
    global_row: bool = False,
) -> DataFrame:
    """A fitted table read back and proved: no duplicate key, no null value, dense codes
    from zero, and one global row per group where the table promises one."""
    table = spark.read.parquet(path)
    problems = fitted_problems(table, group, key, dense_code, non_null, global_row)
    found = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).orderBy("problem").collect()
    if found:
        raise ValueError(f"{path}: " + "; ".join(f"{r['problem']} ({r['n']})" for r in found))
    return table


def fitted_problems(
    table: DataFrame,
    group: str,
    key: str,
    dense_code: str | None = None,
    non_null: Sequence[str] = (),
    global_row: bool = False,
) -> DataFrame:
    """Violations of a fitted table `(problem, grp, n)`."""
    twice = table.groupBy(group, key).count().where("count > 1")
    parts = [
        twice.select(F.lit("duplicate key").alias("problem"), F.col(group).cast("string").alias("grp"), F.col("count").alias("n"))
    ]
    for c in non_null:
        nulls = table.where(F.col(c).isNull()).groupBy(group).count()
        parts.append(nulls.select(F.lit(f"null {c}"), F.col(group).cast("string"), "count"))
    if dense_code:
        span = table.groupBy(group).agg(
            F.min(dense_code).alias("lo"), F.max(dense_code).alias("hi"), F.count(dense_code).alias("n")
        )
        gaps = span.where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1))
        shared = table.where(F.col(dense_code).isNotNull()).groupBy(group, dense_code).count().where("count > 1")
        parts.append(gaps.select(F.lit("codes not dense"), F.col(group).cast("string"), "n"))
        parts.append(shared.select(F.lit("code shared"), F.col(group).cast("string"), "count"))
    if global_row:
        rows = table.groupBy(group).agg(F.count_if(F.col(key) == GLOBAL).alias("n")).where("n <> 1")
        parts.append(rows.select(F.lit("global row"), F.col(group).cast("string"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def save_scalars(spark: SparkSession, values: Mapping, path: str, mode: str = "error") -> None:
    """Fitted scalars as one JSON document."""
    spark.createDataFrame([(json.dumps(dict(values)),)], "value string").coalesce(1).write.mode(mode).text(path)


def load_scalars(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def content_stamp(df: DataFrame) -> DataFrame:
    """12 hex characters that change when a row does, whatever the row order.

    Equal rows cancel under XOR, so every row is hashed with its number of copies: the MD5 of its
    cells as text, a null as a NUL character, joined by the unit separator.
    """
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in [*df.columns, "_copies"]]
    digest = F.md5(F.concat_ws("\x1f", *cells))
    halves = copies.select(*[F.conv(F.substring(digest, k, 15), 16, 10).cast("long").alias(n) for n, k in (("a", 1), ("b", 17))])
    parts = [F.bit_xor("a").cast("string"), F.bit_xor("b").cast("string"), F.count(F.lit(1)).cast("string")]
    return halves.agg(F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 12).alias("stamp"))



def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key by an order; the group limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
