"""What the corpus operators share: columns, the shared folder, splits of hot keys, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Links of one partition while components are found.
EDGES = 100_000

# Spark's own setting: shuffles of a frame made under it are removed when its action ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Fixed value: a word is a run of anything but space, tab, line feed to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, also set for checkpoints.

    On a local master without that setting a temporary folder is used; elsewhere it must be set,
    since a machine's own folder is not seen by the other executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there from now on.

    What it shuffled is on disk no longer than that. It is planned anew for this, so shuffles that
    other readers of `df` share are not touched.
    """
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(FREED)
    conf.set(FREED, "true")
    try:
        own = df.select("*")
    finally:
        conf.set(FREED, before)
    return own.checkpoint()


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids whose labels no model may see."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def attach(big: DataFrame, small: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """Inner join of `big` to the one row that `small` has for each `key`.

    `small[count]` is the number of rows of `big` with that key. Keys with over 1/`share` of all
    rows (fewer than `share` of them, so the broadcast is bounded) are joined where they lie;
    only the others are shuffled, and none of those is large.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = small.where(F.col(count) * share > total).drop(count)
    cold = small.where(F.col(count) * share <= total).drop(count)
    there = F.broadcast(hot)
    return big.join(there, key).unionByName(big.join(there.select(key), key, "left_anti").join(cold, key))


def runs(batches: Iterator, key: str) -> Iterator:
    """Batches cut so that no run of equal `key` values is spread over two of them."""
    import pandas as pd

    held = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[key].iloc[-1]
        if held and batch[key].iloc[0] == last and held[-1][key].iloc[-1] == last:
            held.append(batch)
            continue
        start = int((batch[key].to_numpy() != last).sum())
        yield pd.concat([*held, batch.iloc[:start]], ignore_index=True)
        held = [batch.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node reachable.

    Alternates the large-star and small-star steps: each is one aggregation with map-side
    combining and one join, and the links never grow. Every step is cut, so neither the plan nor
    the lineage grows with the number of rounds. Self links are allowed; nulls are not.
    """

    def star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
            joined = edges.join(least, "a")
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        ends = out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return ends.coalesce(parts).distinct().coalesce(parts)

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    for _ in range(rounds if before[0] else 0):
        # links never grow: as many partitions as they need, whatever the session's number is
        parts = before[0] // EDGES + 1
        edges = cut(star(star(edges.coalesce(parts), True, parts), False, parts))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
