"""Learners as Spark jobs: a linear probe, a boosted challenger, and experiment arms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.config import Costs
from riskframe.operators.bootstrap import paired_day_bootstrap
from riskframe.operators.calibration import cost_arm
from riskframe.operators.features import apply_categories, fit_categories, neutralise
from riskframe.operators.ranking import ranking_metrics
from riskframe.plans.sizing import measured
from riskframe.session import materialise

T = TypeVar("T")


@dataclass(frozen=True)
class ProbeConfig:
    numeric: Sequence[str]
    deltas: Sequence[str] = field(default=())
    categorical: Sequence[str] = field(default=())
    min_rows: int = 50
    max_iter: int = 100
    balanced: bool = False
    label: str = "is_fraud"
    # numbers that are never missing: no median is looked for
    complete: Sequence[str] = field(default=())


@dataclass(frozen=True)
class Probe:
    config: ProbeConfig
    vocabulary: DataFrame | None
    model: PipelineModel

    @property
    def coefficients(self) -> list[float]:
        return list(self.model.stages[-1].coefficients.toArray())

    @property
    def intercept(self) -> float:
        return float(self.model.stages[-1].intercept)


def class_weight(train: DataFrame, label: str = "is_fraud") -> float:
    """Negatives per positive, from train only."""
    row = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if not row["p"] or not row["n"]:
        raise ValueError("a class weight needs both classes")
    return row["n"] / row["p"]


def with_class_weight(df: DataFrame, ratio: float, label: str = "is_fraud", out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def _prepared(df: DataFrame, config: ProbeConfig, vocabulary: DataFrame | None) -> DataFrame:
    """Doubles for numbers, a missing indicator per delta, vocabulary codes for categories."""
    numbers = {c: F.col(c).cast("double") for c in [*config.numeric, *config.deltas, *config.complete]}
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in config.deltas}
    out = df.withColumns({**flags, **numbers}) if numbers else df
    if config.categorical:
        out = apply_categories(out, vocabulary, config.categorical, codes=True)
    return out


def fit_probe(train: DataFrame, config: ProbeConfig) -> Probe:
    """Median-imputed, scaled and one-hot encoded logistic regression."""
    vocabulary = (
        measured(fit_categories(train, config.categorical, config.min_rows)) if config.categorical else None
    )
    prepared = _prepared(train, config, vocabulary)
    numbers = [*config.numeric, *config.deltas]
    filled = [f"{c}_filled" for c in numbers]
    codes, hot = [f"{c}_code" for c in config.categorical], [f"{c}_hot" for c in config.categorical]
    stages: list = []
    parts: list[str] = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=filled, strategy="median"))
    if filled or config.complete:
        stages += [
            VectorAssembler(inputCols=[*filled, *config.complete], outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    parts += [f"{c}_missing" for c in config.deltas]
    if codes:
        stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False))
        parts += hot
    weighted = {}
    if config.balanced:
        prepared = with_class_weight(prepared, class_weight(train, config.label), config.label)
        weighted = {"weightCol": "weight"}
    stages += [
        VectorAssembler(inputCols=parts, outputCol="features"),
        LogisticRegression(
            labelCol=config.label, featuresCol="features", maxIter=config.max_iter, regParam=1e-4,
            standardization=False, **weighted,
        ),
    ]
    typed_label = prepared.withColumn(config.label, F.col(config.label).cast("double"))
    model = Pipeline(stages=stages).fit(typed_label)
    # the training summary holds the session, which cannot travel to tasks once rows were observed in it
    fitted = model.stages[-1]._java_obj
    fitted.setSummary(train.sparkSession._jvm.scala.Option.apply(None))
    return Probe(config, vocabulary, model)


def score_probe(df: DataFrame, probe: Probe, keep: Sequence[str], out: str = "score") -> DataFrame:
    """Probability of the positive class, with the kept columns."""
    scored = probe.model.transform(_prepared(df, probe.config, probe.vocabulary))
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def probe_contributions(df: DataFrame, probe: Probe, keep: Sequence[str]) -> DataFrame:
    """`(keep…, contributions array, margin, base)`: coefficient times input, in log-odds."""
    scored = probe.model.transform(_prepared(df, probe.config, probe.vocabulary))
    values = vector_to_array("features")
    weights = F.array(*[F.lit(float(b)) for b in probe.coefficients])
    products = F.zip_with(values, weights, lambda x, b: x * b)
    return scored.select(
        *keep,
        products.alias("contributions"),
        vector_to_array("rawPrediction")[1].alias("margin"),
        F.lit(probe.intercept).alias("base"),
    )


# ---- boosted challenger ------------------------------------------------------------------------


def fit_tree(
    df: DataFrame, features: Sequence[str], label: str = "is_fraud", max_iter: int = 20, depth: int = 3, seed: int = 0,
    weight: str | None = None, validation_tolerance: float = 0.01,
) -> GBTClassificationModel:
    """Gradient-boosted trees on train, stopped early on the first validation split.

    Not the reference learner: nothing downstream depends on which learner made the scores.
    """
    rows = df.where(F.col("split").isin("train", "val_fit")).select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(-999.0)).alias(c) for c in features],
        F.col(label).cast("double").alias(label),
        (F.col("split") == "val_fit").alias("_validation"),
        *([weight] if weight else []),
    )
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    extra = {"weightCol": weight} if weight else {}
    learner = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=depth, seed=seed,
        validationIndicatorCol="_validation", validationTol=validation_tolerance, **extra,
    )
    return learner.fit(assembled)


def score_tree(df: DataFrame, model: GBTClassificationModel, features: Sequence[str], keep: Sequence[str], out: str = "score") -> DataFrame:
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-999.0)) for c in features})
    assembled = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(filled)
    return model.transform(assembled).select(*keep, vector_to_array("probability")[1].alias(out))


# ---- arms -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Arm:
    """One experiment: which features, which rows, which seed."""

    name: str
    features: tuple[str, ...]
    rows: Column | None = None
    seed: int = 0


def leave_family_out(features: Sequence[str], families: dict[str, Sequence[str]]) -> list[Arm]:
    """The full set, and one arm per family without it."""
    arms = [Arm("full", tuple(features))]
    for name, members in families.items():
        arms.append(Arm(name, tuple(c for c in features if c not in set(members))))
    return arms


def random_width_arms(features: Sequence[str], width: int, draws: int, seed: int) -> list[Arm]:
    """Arms with `width` columns removed at random: the noise a family's removal is read against."""
    import numpy as np

    rng = np.random.default_rng(seed)
    arms = []
    for i in range(draws):
        gone = set(rng.choice(len(features), size=width, replace=False).tolist())
        arms.append(Arm(f"width{width}_{i}", tuple(c for j, c in enumerate(features) if j not in gone)))
    return arms


def concurrently(tasks: Sequence[Callable[[], T]], spark: SparkSession, parallel: int = 4) -> list[T]:
    """Results of driver tasks that each start Spark jobs, some at a time, in order.

    Every thread has its own fair pool, so that small fits fill the executors a large one leaves;
    without a fair scheduler the pools are ignored and jobs queue.
    """

    def pooled(at: int, task: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{at % parallel}")
        try:
            return task()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=parallel) as threads:
        started = [threads.submit(inheritable_thread_target(spark)(partial(pooled, i, t))) for i, t in enumerate(tasks)]
        return [s.result() for s in started]


def run_arms(
    df: DataFrame, arms: Sequence[Arm], label: str = "is_fraud", split: str = "val_fit", max_iter: int = 10, depth: int = 3,
    parallel: int = 4,
) -> DataFrame:
    """One tree per arm on one cached matrix; `(arm, seed, features, pr_auc, roc_auc)`.

    The loop is over configurations, never over data; fits run side by side. The matrix is released
    when the metrics, a row an arm, are written.
    """
    matrix = df.persist()
    try:
        matrix.count()

        def scored(arm: Arm) -> DataFrame:
            rows = matrix if arm.rows is None else matrix.where(arm.rows | (F.col("split") != "train"))
            model = fit_tree(rows, arm.features, label, max_iter, depth, arm.seed)
            return score_tree(matrix.where(F.col("split") == split), model, arm.features, [label]).select(
                F.lit(arm.name).alias("arm"),
                F.lit(arm.seed).alias("seed"),
                F.lit(len(arm.features)).alias("features"),
                label,
                "score",
            )

        parts = concurrently([partial(scored, arm) for arm in arms], df.sparkSession, parallel)
        metrics = ranking_metrics(reduce(DataFrame.unionByName, parts), label, "score", ["arm", "seed", "features"])
        return materialise(metrics.select("arm", "seed", "features", "pr_auc", "roc_auc"), "arms")
    finally:
        matrix.unpersist()


def with_noise(df: DataFrame, width: int, seed: int) -> tuple[DataFrame, list[str]]:
    """`width` columns of noise that are a function of the row id, so a retry repeats them."""
    names = [f"noise_{i}" for i in range(width)]
    top = float(1 << 62)

    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 62)).cast("double") + 0.5) / top

    # Box-Muller on two hashed uniforms
    built = {
        n: F.sqrt(-2 * F.ln(uniform(2 * i))) * F.cos(2 * 3.141592653589793 * uniform(2 * i + 1))
        for i, n in enumerate(names)
    }
    return df.withColumns(built), names


def probe_metric(train: DataFrame, held: DataFrame, config: ProbeConfig) -> DataFrame:
    scored = score_probe(held, fit_probe(train, config), [config.label])
    return ranking_metrics(scored, config.label, "score")


def noise_floor(train: DataFrame, held: DataFrame, config: ProbeConfig, seeds: Sequence[int], width: int) -> DataFrame:
    """Metric change when columns of noise are added, per seed.

    Medians are taken once for all fits. Fits run side by side; their scores are written once, and
    one job ranks those of all seeds.
    """
    both = [train, held]
    if config.numeric:
        known = [f"{c}_known" for c in config.numeric]
        both = [df.withColumns({c: F.col(c).cast("double") for c in config.numeric}) for df in both]
        medians = Imputer(inputCols=list(config.numeric), outputCols=known, strategy="median").fit(both[0])
        both = [medians.transform(df) for df in both]
        config = replace(config, numeric=(), complete=[*config.complete, *known])
    both = [df.persist() for df in both]

    def scored(at: int, seed: int | None) -> DataFrame:
        rows, wider = both, config
        if seed is not None:
            noisy = [with_noise(df, width, seed) for df in both]
            rows, wider = [df for df, _ in noisy], replace(config, complete=[*config.complete, *noisy[0][1]])
        scores = score_probe(rows[1], fit_probe(rows[0], wider), [config.label])
        return materialise(scores.select(F.lit(at).alias("_fit"), config.label, "score"), "noise")

    fits = (None, *seeds)
    try:
        parts = concurrently([partial(scored, i, s) for i, s in enumerate(fits)], train.sparkSession)
    finally:
        for df in both:
            df.unpersist()
    metrics = ranking_metrics(reduce(DataFrame.unionByName, parts), config.label, "score", ["_fit"])
    table = materialise(metrics.select("_fit", "pr_auc"), "noise")
    reference = table.where("_fit = 0").select("pr_auc").scalar()
    seed = F.element_at(F.array(*[F.lit(s).cast("int") for s in fits]), F.col("_fit") + 1)
    return table.where("_fit > 0").select(
        seed.alias("seed"), F.lit(width).alias("width"), "pr_auc", (F.col("pr_auc") - reference).alias("delta")
    )


def family_probe(train: DataFrame, held: DataFrame, base: ProbeConfig, families: dict[str, Sequence[str]]) -> DataFrame:
    """The probe alone and with one extra family at a time."""
    out = probe_metric(train, held, base).select(F.lit("base").alias("family"), "pr_auc", "roc_auc")
    for name, members in families.items():
        wider = ProbeConfig(
            [*base.numeric, *members], base.deltas, base.categorical, base.min_rows, base.max_iter, base.balanced, base.label, base.complete
        )
        out = out.unionByName(probe_metric(train, held, wider).select(F.lit(name).alias("family"), "pr_auc", "roc_auc"))
    return out


def neutralised_scores(
    df: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str = "card"
) -> tuple[DataFrame, DataFrame]:
    """The same rows scored with their history and with first-sighting defaults."""
    return scorer(df), scorer(neutralise(df, key))


def compare_arms(
    arms: Mapping[str, DataFrame], reference: str, costs: Costs, capacity: float, method: str = "platt", folds: int = 4,
    score: str = "score", y: str = "is_fraud", amount: str = "amount", resamples: int = 2000, interval: float = 0.95,
    seed: int = 0, day_bound: int | None = None,
) -> DataFrame:
    """Scorings of the same rows side by side: `(arm, rows, pr_auc, usd_per_1000, reviews_per_day,
    block_rate, delta_pr_auc, delta_usd, low, high)`.

    The PR-AUC is that of the raw scores; the cost comes from probabilities calibrated out of fold.
    Deltas are against the `reference` arm, with the interval of the paired day bootstrap of their
    costs. Arms that do not cover the same ids end the job. Each arm is a table of id, day, label,
    amount and score.
    """
    decided, summaries = {}, []
    for name, rows in arms.items():
        costed, summary = cost_arm(rows, costs, capacity, method, folds, score, y, amount, day_bound)
        decided[name] = materialise(costed.select("id", "day", "cost"), "arm")
        ranked = ranking_metrics(rows, y, score).select("pr_auc")
        told = summary.select("rows", "usd_per_1000", "reviews_per_day", "block_rate").withColumn("pr_auc", ranked.scalar())
        summaries.append(told.select(F.lit(name).alias("arm"), "*"))
    table = materialise(reduce(DataFrame.unionByName, summaries), "summaries")
    base = table.where(F.col("arm") == reference)
    spans = []
    for name in arms:
        if name == reference:
            continue
        pair = decided[name].withColumnRenamed("cost", "a").join(
            decided[reference].select("id", F.col("day").alias("_day"), F.col("cost").alias("r")), "id", "full_outer"
        )
        # an id of one arm only leaves a null, which the bootstrap refuses
        pair = pair.withColumn("day", F.coalesce("day", "_day"))
        span = paired_day_bootstrap(pair, "a", "r", resamples, interval, seed)
        spans.append(span.select(F.lit(name).alias("arm"), "low", "high"))
    joined = table.join(reduce(DataFrame.unionByName, spans), "arm", "left") if spans else table.withColumns(
        {c: F.lit(None).cast("double") for c in ("low", "high")}
    )
    return joined.select(
        "arm", "rows", "pr_auc", "usd_per_1000", "reviews_per_day", "block_rate",
        (F.col("pr_auc") - base.select("pr_auc").scalar()).alias("delta_pr_auc"),
        (F.col("usd_per_1000") - base.select("usd_per_1000").scalar()).alias("delta_usd"), "low", "high",
    )
