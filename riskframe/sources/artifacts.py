"""A served model as one folder: pipeline, calibrator, fitted tables and their stamps, read back and proved."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.calibration import Isotonic, Platt
from riskframe.operators.horizon import Fitted
from riskframe.operators.learning import Probe, ProbeConfig, score_probe
from riskframe.sources.io import content_stamp, fitted_problems, load_scalars, save_scalars

TABLES = ("frequencies", "stats", "vocabulary")
# Columns that make a row of each fitted table unique, and that hold no null.
KEYS = {"frequencies": ("column", "level"), "stats": ("entity", "level"), "vocabulary": ("column", "level")}
VERSION = 1


@dataclass(frozen=True)
class Served:
    """What scoring needs: fitted tables, the probe on their columns, and its calibrator."""

    fitted: Fitted
    probe: Probe
    calibrator: Platt | Isotonic

    def score(self, matrix: DataFrame, keep: Sequence[str], raw: str = "uncalibrated", out: str = "calibrated") -> DataFrame:
        """The kept columns with the probe's score and the calibrated probability."""
        return self.calibrator.apply(score_probe(matrix, self.probe, keep, raw), raw, out)


def _stamp(df: DataFrame) -> str:
    return content_stamp(df).first()["stamp"]


def save_served(served: Served, path: str) -> None:
    """Write every part below `path`; the manifest comes last, so a broken write is never read."""
    spark = served.fitted.frequencies.sparkSession
    tables = {name: getattr(served.fitted, name) for name in TABLES}
    if served.probe.vocabulary is not None:
        tables["probe_vocabulary"] = served.probe.vocabulary
    isotonic = isinstance(served.calibrator, Isotonic)
    if isotonic:
        blocks = served.calibrator.breakpoints
        if not isinstance(blocks, DataFrame):
            raise ValueError("a curve of literal breakpoints has no table to save")
        tables["calibrator"] = blocks.select("lo", "hi", "p", "w")
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    served.probe.model.write().save(f"{path}/pipeline")
    stamps = {name: _stamp(spark.read.parquet(f"{path}/{name}")) for name in tables}
    config = {k: list(v) if isinstance(v, (tuple, list)) else v for k, v in asdict(served.probe.config).items()}
    lists = {k: list(getattr(served.fitted, k)) for k in ("encoded", "entities", "categorical")}
    calibrator = {"kind": "isotonic"} if isotonic else {"kind": "platt", **asdict(served.calibrator)}
    optional = served.fitted.optional.json()
    save_scalars(
        spark,
        {"version": VERSION, "stamps": stamps, "config": config, "fitted": lists, "calibrator": calibrator, "optional": optional,
         "coefficients": served.probe.coefficients, "intercept": served.probe.intercept},
        f"{path}/manifest",
    )


def load_served(spark: SparkSession, path: str) -> Served:
    """The model of a folder, after its parts are proved: version, stamps, keys, and coefficients."""
    import json

    manifest = load_scalars(spark, f"{path}/manifest")
    if manifest["version"] != VERSION:
        raise ValueError(f"{path}: version {manifest['version']}, expected {VERSION}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["stamps"]}
    for name, table in tables.items():
        if (found := _stamp(table)) != manifest["stamps"][name]:
            raise ValueError(f"{path}/{name}: stamp {found}, the manifest says {manifest['stamps'][name]}")
        if name in KEYS:
            problems = fitted_problems(table, *KEYS[name], non_null=[KEYS[name][0]]).limit(1).collect()
            if problems:
                raise ValueError(f"{path}/{name}: {problems[0]['problem']} in {problems[0]['grp']}")
    probe = Probe(ProbeConfig(**manifest["config"]), tables.get("probe_vocabulary"), PipelineModel.load(f"{path}/pipeline"))
    if probe.coefficients != manifest["coefficients"] or probe.intercept != manifest["intercept"]:
        raise ValueError(f"{path}/pipeline: other coefficients than the manifest's")
    kind = dict(manifest["calibrator"])
    calibrator = Isotonic(tables["calibrator"]) if kind.pop("kind") == "isotonic" else Platt(**kind)
    optional = T.StructType.fromJson(json.loads(manifest["optional"]))
    return Served(Fitted(*[tables[t] for t in TABLES], **manifest["fitted"], optional=optional), probe, calibrator)


def score_differences(scored: DataFrame, persisted: DataFrame, key: str = "id", columns: Sequence[str] = ("uncalibrated", "calibrated")) -> DataFrame:
    """Per score column: rows of one side only, rows that differ at all, and by how much at most."""
    right = persisted.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_there"))
    joined = scored.select(key, *columns, F.lit(1).alias("_here")).join(right, key, "full_outer")
    both = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("score"), (~both).alias("unmatched"), (both & ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias("differs"),
            F.abs(F.col(c) - F.col(f"_r_{c}")).alias("gap"),
        )
        for c in columns
    ])
    return joined.select(F.inline(cells)).groupBy("score").agg(
        F.count_if("unmatched").alias("unmatched"), F.count_if("differs").alias("differs"), F.max("gap").alias("worst")
    )


def check_scores(scored: DataFrame, persisted: DataFrame, key: str = "id") -> None:
    """Refuse scores that differ at all from those on record."""
    wrong = [r.asDict() for r in score_differences(scored, persisted, key).collect() if r["unmatched"] or r["differs"]]
    if wrong:
        raise ValueError(f"the scores differ from those on record: {wrong}")
