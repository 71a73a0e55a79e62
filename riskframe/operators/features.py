"""Point-in-time feature families: amounts, frequency, entity statistics, vocabulary, fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.config import GLOBAL, MISSING, OTHER
from riskframe.functions import scalar as S
from riskframe.functions.lookup import lookup, null_safe_join
from riskframe.plans.ordering import prefix_sums, column_quantiles
from riskframe.plans.sizing import bounded, measured

# The round-amount band and the product it is crossed with.
AMOUNT_CONFIG = {"step": 50.0, "low": 150.0, "high": 500.0, "product": "H"}

WINDOWS = {"1h": 3_600, "24h": 86_400, "7d": 604_800}
FIRST_SEEN_GAP_DAYS = 30.0


def add_amount_features(
    df: DataFrame, amount: str = "amount", product: str = "product", config: Mapping = AMOUNT_CONFIG
) -> DataFrame:
    """Whole-dollar flag, round-in-band flag, and the latter within one product."""
    banded = S.is_round_in_band(amount, config["step"], config["low"], config["high"])
    flags = {
        "amt_whole_dollar": S.is_whole(amount),
        "amt_round_band": banded,
        "amt_round_band_product": banded & S.equals(product, config["product"]),
    }
    return df.withColumns({k: F.coalesce(v, F.lit(False)).cast("byte") for k, v in flags.items()})


def text_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key columns as rows `(column, level)` with null kept as null."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
            for c in columns
        ]
    )
    return df.select(F.inline(cells))


# ---- frequency ------------------------------------------------------------------


def fit_frequencies(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of training rows per level `(column, level, frequency)`; null is a level.

    Counts are combined before the shuffle, so a level holding most rows costs one row a task.
    Like every fit here, the table is kept and measured: each use joins it by its real size.
    """
    counts = text_cells(train, columns).groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    shares = counts.join(bounded(totals, len(columns)), "column").select(
        "column", S.level("level").alias("level"), (F.col("n") / F.col("total")).cast("float").alias("frequency")
    )
    return measured(shares)


def apply_frequencies(df: DataFrame, table: DataFrame, columns: Sequence[str], prefix: str = "freq_") -> DataFrame:
    """Look each column up in its own slice of the table; an unseen level scores 0."""
    for c in columns:
        slice_ = table.where(F.col("column") == c).select("level", F.col("frequency").alias(f"{prefix}{c}"))
        df = lookup(
            df.withColumn("_k", S.level(c)), slice_, "_k", {f"{prefix}{c}": F.lit(0.0).cast("float")}
        ).drop("_k")
    return df


# ---- entity amount statistics ----------------------------------------------------


def _amount_totals(train: DataFrame, amount: str) -> DataFrame:
    return train.agg(
        F.count(F.lit(1)).alias("g_count"),
        F.avg(amount).alias("g_mean"),
        F.stddev_samp(amount).alias("g_std"),
    ).withColumn(
        "g_std",
        F.when(F.col("g_std") > 0, F.col("g_std")).otherwise(
            F.raise_error(F.lit("training amounts have no spread")).cast("double")
        ),
    )


def fit_amount_stats(train: DataFrame, entities: Sequence[str], strength: float, amount: str = "amount") -> DataFrame:
    """Shrunk mean and deviation of the amount per entity level, plus an unshrunk global row.

    `(n·observed + k·prior) / (n + k)`; a level seen once has no deviation and counts as 0.
    """
    totals = measured(_amount_totals(train, amount))
    cells = F.array(
        *[F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("level")) for e in entities]
    )
    rows = train.select(F.col(amount).alias("_x"), F.inline(cells))
    observed = rows.groupBy("entity", "level").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("_x").alias("mean"),
        F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("std"),
    )
    n, k = F.col("count"), F.lit(float(strength))
    # one row of totals, attached as scalar subqueries rather than a join
    prior_mean, prior_std = totals.select("g_mean").scalar(), totals.select("g_std").scalar()
    shrunk = observed.select(
        "entity",
        S.level("level").alias("level"),
        "count",
        ((n * F.coalesce("mean", F.lit(0.0)) + k * prior_mean) / (n + k)).alias("mean"),
        ((n * F.col("std") + k * prior_std) / (n + k)).alias("std"),
    )
    whole = totals.select(
        F.explode(F.array(*[F.lit(e) for e in entities])).alias("entity"),
        F.lit(GLOBAL).alias("level"),
        F.col("g_count").alias("count"),
        F.col("g_mean").alias("mean"),
        F.col("g_std").alias("std"),
    )
    return measured(shrunk.unionByName(whole))


def apply_amount_stats(df: DataFrame, table: DataFrame, entities: Sequence[str], amount: str = "amount") -> DataFrame:
    """Mean, z and absolute z of the amount against its entity; unseen levels use the global row."""
    prior = table.where(F.col("level") == GLOBAL)
    for e in entities:
        one = prior.where(F.col("entity") == e)
        slice_ = table.where((F.col("entity") == e) & (F.col("level") != GLOBAL)).select(
            "level", F.col("mean").alias("_mean"), F.col("std").alias("_std")
        )
        df = lookup(df.withColumn("_k", S.level(e)), slice_, "_k", {"_mean": None, "_std": None})
        mean = F.coalesce("_mean", one.select("mean").scalar())
        std = F.coalesce("_std", one.select("std").scalar())
        df = df.withColumns({"_mean": mean, "_std": std})
        z = (F.col(amount) - F.col("_mean")) / F.col("_std")
        df = df.withColumns(
            {
                f"amt_mean_{e}": F.col("_mean").cast("float"),
                f"amt_z_{e}": z.cast("float"),
                f"amt_absz_{e}": F.abs(z).cast("float"),
            }
        ).drop("_k", "_mean", "_std")
    return df


# ---- vocabulary ------------------------------------------------------------------


def fit_categories(train: DataFrame, columns: Sequence[str], min_rows: int) -> DataFrame:
    """Vocabulary `(column, level, code)`: frequent levels in byte order, then the two sentinels.

    Codes are running positions, counted in buckets of neighbouring levels, so no column is numbered
    by one task and levels that begin alike do not meet in one.
    """
    counts = (
        text_cells(train, columns)
        .where("level is not null")
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_rows)
        .select("column", "level", F.lit(1).alias("one"))
    )
    kept = prefix_sums(measured(counts), "level", ["one"], ["column"]).select(
        "column", "level", (F.col("cum_one") - 1).cast("int").alias("code")
    )
    wanted = train.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    sizes = wanted.join(kept.groupBy("column").agg(F.count(F.lit(1)).alias("n")), "column", "left")
    size = F.coalesce("n", F.lit(0))
    sentinels = sizes.select(
        "column",
        F.inline(
            F.array(
                F.struct(F.lit(OTHER).alias("level"), size.cast("int").alias("code")),
                F.struct(F.lit(MISSING).alias("level"), (size + 1).cast("int").alias("code")),
            )
        ),
    )
    return measured(kept.unionByName(sentinels))


def apply_categories(df: DataFrame, table: DataFrame, columns: Sequence[str], codes: bool = False) -> DataFrame:
    """Each column as a vocabulary level, null and unseen routed to their sentinels."""
    for c in columns:
        slice_ = table.where(F.col("column") == c).select("level", F.col("code").alias("_code"))
        known = lookup(df.withColumn("_k", S.level(c)), slice_, "_k", {"_code": None})
        routed = F.when(F.col("_code").isNotNull(), F.col("_k")).otherwise(F.lit(OTHER))
        df = known.withColumn(c, routed)
        if codes:
            other = table.where((F.col("column") == c) & (F.col("level") == OTHER)).select("code").scalar()
            df = df.withColumn(f"{c}_code", F.coalesce("_code", other))
        df = df.drop("_k", "_code")
    return df


# ---- medians and null shares ------------------------------------------------------


def fit_medians(train: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Median of each numeric column `(column, median)`, exact unless asked otherwise."""
    if approximate:
        row = train.agg(*[F.percentile_approx(c, 0.5, 10_000).cast("double").alias(c) for c in columns])
        return row.unpivot([], list(columns), "column", "median")
    return column_quantiles(train, columns, probs=[0.5]).select("column", F.col("value").alias("median"))


def apply_medians(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls; the table holds one row per column, so it is read as literals."""
    found = {r["column"]: r["median"] for r in medians.where(F.col("column").isin(*columns)).collect()}
    unfitted = sorted(set(columns) - set(found))
    if unfitted:
        raise ValueError(f"no median was fitted for {unfitted}")
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(c, F.lit(found[c]).cast(types[c])) for c in columns})


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null share per column `(column, share)`, one pass over the table."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "share")


def select_by_null_share(train: DataFrame, columns: Sequence[str], limit: float) -> list[str]:
    """Columns whose null share on train is below the limit, in the given order."""
    shares = {r["column"]: r["share"] for r in null_shares(train, columns).collect()}
    return [c for c in columns if shares[c] < limit]


# ---- velocity ---------------------------------------------------------------------


def _entity_key(df: DataFrame, key: str) -> Column:
    """The entity with null as a value of its own: a number outside any id, or the text level."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    return S.level(key)


def velocity(
    df: DataFrame,
    key: str = "card",
    ts: str = "dt",
    id_: str = "id",
    windows: Mapping[str, int] = WINDOWS,
    first_seen_gap_days: float = FIRST_SEEN_GAP_DAYS,
) -> DataFrame:
    """Trailing counts in `(t - s, t]` and log recency per entity, over every row given.

    A row counts itself and the rows ahead of it in `(ts, id)` order; a null entity is an
    entity. The table is swept in slots of the shortest window: each row is an arrival in its
    own slot and, for every window, an expiry mark one window later. Exact order is needed
    only inside an `(entity, slot)`; whole slots between are counts. An entity that holds a
    third of all rows is therefore spread over as many groups as it has slots.
    """
    slot = min(windows.values())
    ragged = {name: s for name, s in windows.items() if s % slot}
    if ragged:
        raise ValueError(f"windows must be multiples of the shortest one: {ragged}")
    names = list(windows)
    arrivals = df.withColumns(
        {
            "_k": _entity_key(df, key),
            "_t": F.col(ts).cast("long"),
            "_slot": F.coalesce(S.floordiv(ts, slot), F.lit(0)),
        }
    )

    # whole slots: counts ahead of a slot within each window, and the last time seen before it
    per_slot = arrivals.groupBy("_k", "_slot").agg(F.count(F.lit(1)).alias("_n"), F.max("_t").alias("_last"))
    by_slot = Window.partitionBy("_k").orderBy("_slot")
    carried = {
        f"_w_{name}": F.coalesce(
            F.sum("_n").over(by_slot.rangeBetween(-(windows[name] // slot), -1)), F.lit(0)
        )
        for name in names
    }
    slots = per_slot.select(
        "_k",
        "_slot",
        *[c.alias(n) for n, c in carried.items()],
        F.lag("_last").over(by_slot).alias("_prev_slot_last"),
    )

    # one row per arrival, and one mark per window when that arrival leaves it
    marks = F.array(
        F.struct(F.lit(0).alias("shift"), F.lit("").alias("mark")),
        *[F.struct(F.lit(s).alias("shift"), F.lit(n).alias("mark")) for n, s in windows.items()],
    )
    payload = F.struct(*df.columns)
    swept = (
        arrivals.select("_k", "_t", F.col(id_).alias("_id"), payload.alias("_row"), F.inline(marks))
        .select(
            "_k",
            (F.col("_t") + F.col("shift")).alias("_t"),
            "_id",
            "mark",
            F.when(F.col("mark") == "", F.col("_row")).alias("_row"),
        )
        .withColumn("_slot", F.coalesce(S.floordiv("_t", slot), F.lit(0)))
    )
    arrival = (F.col("mark") == "").cast("int")
    # at one instant expiries come before arrivals, because the window is open on the left
    order = Window.partitionBy("_k", "_slot").orderBy("_t", arrival, "_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    running = swept.withColumns(
        {
            "_pos": F.sum(arrival).over(upto),
            "_prev": F.max(F.when(F.col("mark") == "", F.col("_t"))).over(ahead),
            **{f"_x_{n}": F.sum((F.col("mark") == n).cast("int")).over(upto) for n in names},
        }
    ).where("mark = ''")
    # both keys are never null, so the sweep's own partitioning serves the join
    joined = null_safe_join(running, slots, ["_k", "_slot"])
    gap = F.col("_t") - F.coalesce("_prev", "_prev_slot_last")
    counts = {
        f"vel_n{n}_{key}": (F.col(f"_w_{n}") + F.col("_pos") - F.col(f"_x_{n}")).cast("float") for n in names
    }
    recency = F.log1p(F.coalesce(gap.cast("double"), F.lit(first_seen_gap_days * 86_400))).cast("float")
    return joined.select(
        "_row.*", *[c.alias(n) for n, c in counts.items()], recency.alias(f"vel_recency_{key}")
    )


def velocity_columns(key: str = "card", windows: Mapping[str, int] = WINDOWS) -> list[str]:
    return [*(f"vel_n{n}_{key}" for n in windows), f"vel_recency_{key}"]


def fill_history(df: DataFrame, key: str = "card", first_seen_gap_days: float = FIRST_SEEN_GAP_DAYS) -> DataFrame:
    """Velocity columns a request does not carry, as if the entity were first seen now."""
    first = F.log1p(F.lit(first_seen_gap_days * 86_400))
    built: dict[str, Column] = {}
    for c in velocity_columns(key):
        if c in df.columns:
            built[c] = F.col(c).cast("float")
        else:
            built[c] = (first if c.startswith("vel_recency_") else F.lit(1.0)).cast("float")
    return df.withColumns(built)


def neutralise(df: DataFrame, key: str = "card") -> DataFrame:
    """Live-history columns replaced by their first-sighting defaults."""
    return fill_history(df.drop(*velocity_columns(key)), key)


def first_sighting_share(df: DataFrame, key: str = "card", first_seen_gap_days: float = FIRST_SEEN_GAP_DAYS) -> DataFrame:
    """Share of rows whose history already equals the defaults."""
    default = F.log1p(F.lit(first_seen_gap_days * 86_400)).cast("float")
    same = F.col(f"vel_recency_{key}") == default
    for c in velocity_columns(key)[:-1]:
        same = same & (F.col(c) == F.lit(1.0).cast("float"))
    return df.agg(F.avg(same.cast("double")).alias("first_sighting_share"))


# ---- orchestration ----------------------------------------------------------------


def build_features(
    df: DataFrame,
    encoded: Sequence[str],
    entities: Sequence[str],
    key: str = "card",
    strength: float = 10.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All families over every row, fitted on train only: `(features, frequencies, stats)`."""
    train = df.where(F.col("split") == "train")
    frequencies = fit_frequencies(train, encoded)
    stats = fit_amount_stats(train, entities, strength)
    out = velocity(df, key)
    out = add_amount_features(out)
    out = apply_frequencies(out, frequencies, encoded)
    out = apply_amount_stats(out, stats, entities)
    return out, frequencies, stats
