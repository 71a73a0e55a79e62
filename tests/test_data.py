import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.config import SplitBounds, feature_columns, metric_name, resolve_members
from riskframe.operators import joins, splits
from riskframe.sources import contract, io

BOUNDS = SplitBounds(1, 2, 6, 8, 10, 11)


def test_published_layout():
    bounds = SplitBounds(1, 30, 121, 141, 161, 182)
    assert bounds.ranges == {"train": (1, 90), "val_fit": (121, 140), "val_cal": (141, 160), "test": (161, 182)}
    assert bounds.with_window(gap_days=0).train_end == 120


@pytest.mark.parametrize("args", [(1, -1, 6, 8, 10, 11), (1, 2, 8, 6, 10, 11), (1, 2, 6, 8, 10, 9), (1, 5, 6, 8, 10, 11)])
def test_layout_refusals(args):
    with pytest.raises(ValueError):
        SplitBounds(*args)


def test_parameter_checks():
    assert feature_columns(["id", "a", "b"], ["id"], ["b"]) == ["a"]
    with pytest.raises(ValueError):
        feature_columns(["a"], [], ["z"])
    with pytest.raises(ValueError):
        resolve_members(["a"], {"x": ["a"], "y": ["a"]})
    assert metric_name("recall", 0.01) == "recall_100bp"
    with pytest.raises(ValueError):
        metric_name("recall", 0.00001)


@pytest.fixture(scope="module")
def days(spark):
    rows = [(i, d, int(d in (1, 5, 6, 8, 10))) for i, d in enumerate(range(1, 12))]
    return splits.assign_splits(spark.createDataFrame(rows, "id int, day int, is_fraud int"), BOUNDS)


def test_gap_days_have_no_split(days):
    assert {r["day"] for r in days.where("split is null").collect()} == {4, 5}


def test_summary_lists_all_sections(days):
    got = {r["section"]: (r["rows"], r["positives"]) for r in splits.summarize(days).collect()}
    assert got == {"train": (3, 1), "gap": (2, 1), "val_fit": (2, 1), "val_cal": (2, 1), "test": (2, 1)}
    with pytest.raises(ValueError, match="without positives"):
        splits.check_summary(splits.summarize(days.withColumn("is_fraud", F.lit(0))))


def test_split_validation(days):
    splits.validate_splits(days, BOUNDS)
    with pytest.raises(ValueError, match="empty"):
        splits.validate_splits(days.where("coalesce(split, '') <> 'val_cal'"), BOUNDS)
    moved = days.withColumn("split", F.when(F.col("day") == 4, "train").otherwise(F.col("split")))
    with pytest.raises(ValueError, match="outside"):
        splits.validate_splits(moved, BOUNDS)


def test_attach_refuses_lost_rows(days):
    assert splits.attach_splits(days.drop("split"), days.select("id", "split")).count() == 11
    with pytest.raises(ValueError, match="changed"):
        splits.attach_splits(days.drop("split"), days.select("id", "split").where("id > 0"))


def test_partition_counts_refuse_unknown_labels(days):
    with pytest.raises(Exception, match="unknown split"):
        splits.partition_counts(days.withColumn("split", F.lit("holdout"))).collect()


def test_cut_must_drop_something(days):
    assert splits.cut_from_day(days, 3).count() == 9
    with pytest.raises(ValueError, match="nothing"):
        splits.cut_from_day(days, 1)


# ---- joins --------------------------------------------------------------------------------------


def test_flag_comes_from_the_join_not_from_nulls(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, None)], "k int, v string")
    got = {r["k"]: r["hit"] for r in joins.checked_left_join_flag(left, right, "k", "hit").collect()}
    assert got == {1: True, 2: False}
    twice = right.union(right)
    with pytest.raises(ValueError, match="repeats"):
        joins.checked_left_join_flag(left, twice, "k", "hit")
    stray = spark.createDataFrame([(9, "x")], "k int, v string")
    with pytest.raises(ValueError, match="no row"):
        joins.checked_left_join_flag(left, stray, "k", "hit")


def test_required_enrichment_fails_on_a_gap(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5.0)], "k int, v double")
    with pytest.raises(Exception, match="no v for k"):
        joins.enrich_required(left, right, "k", ["v"]).collect()


def test_runs_must_align(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.6)], "id int, y int, score double")
    assert joins.align_runs(a, a, "id", "y", ("s1", "s2")).count() == 2
    for other in (a.where("id = 1"), a.withColumn("y", 1 - F.col("y"))):
        with pytest.raises(ValueError, match="differ"):
            joins.align_runs(a, other, "id", "y", ("s1", "s2"))


def test_reproduction_is_exact(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.6)], "id int, score double")
    joins.check_reproduces(a, a)
    with pytest.raises(ValueError, match="reproduce"):
        joins.check_reproduces(a, a.withColumn("score", F.col("score") * (1 + 1e-15)))


def test_matrices_compare_values_types_and_copies(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 0.5)], "id int, v double")
    joins.check_matrix(a, a)
    for other in (a.limit(1), a.withColumn("v", F.col("v").cast("float"))):
        with pytest.raises(ValueError):
            joins.check_matrix(a, other)


# ---- sources ------------------------------------------------------------------------------------


def test_typed_csv(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text("brand,amt,count\nvisa,1.5,2\n,2.5,3\n")
    schema = T.StructType.fromDDL("amt double, brand string, count int")
    assert [tuple(r) for r in io.read_typed(spark, path, schema).collect()] == [(1.5, "visa", 2), (2.5, None, 3)]
    for ddl in ("amt double, brand string", "amt double, brand string, count int, more int"):
        with pytest.raises(ValueError, match="columns"):
            io.read_typed(spark, path, T.StructType.fromDDL(ddl))


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "b.csv").write_text("amt\nabc\n")
    with pytest.raises(Exception):
        io.read_typed(spark, str(tmp_path / "b.csv"), T.StructType.fromDDL("amt double")).collect()


def test_declared_schema_types():
    schema = io.declared_schema(["TransactionID", "TransactionAmt", "V1", "M4"], ["M4"])
    assert [f.dataType.simpleString() for f in schema] == ["int", "double", "float", "string"]


def test_matrices_keep_splits_and_account_for_the_gap(days, spark, tmp_path):
    path = str(tmp_path / "m")
    accounts = {r["split"]: r["rows"] for r in io.write_matrices(days, path).collect()}
    assert accounts[None] == 2 and sum(accounts.values()) == 11
    back = io.load_matrices(spark, path, ["id"], ["train", "test"])
    assert back.columns == ["id", "split"] and back.count() == 5
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [split" in plan.replace("isnotnull(", "").replace("#", "") or "PartitionFilters" in plan


def test_predictions_refuse_an_empty_selection(days, tmp_path):
    scored = days.withColumn("score", F.lit(0.5))
    with pytest.raises(ValueError, match="nothing to write"):
        io.write_predictions(scored.where("split = 'train'"), str(tmp_path / "p"), ["test"])


def test_fitted_tables_are_proved_on_load(spark, tmp_path):
    good = spark.createDataFrame([("c", "a", 0), ("c", "b", 1)], "column string, level string, code int")
    io.save_fitted(good, str(tmp_path / "g"))
    assert io.load_fitted(spark, str(tmp_path / "g"), "column", "level", "code", ["code"]).count() == 2
    bad = spark.createDataFrame([("c", "a", 0), ("c", "a", 2), ("c", "d", None)], "column string, level string, code int")
    io.save_fitted(bad, str(tmp_path / "b"))
    with pytest.raises(ValueError) as e:
        io.load_fitted(spark, str(tmp_path / "b"), "column", "level", "code", ["code"], global_row=True)
    for part in ("duplicate", "null code", "dense", "global row"):
        assert part in str(e.value)


def test_scalars_round_trip(spark, tmp_path):
    values = {"a": 0.1 + 0.2, "grid": [1e-300, 5.5]}
    io.save_scalars(spark, values, str(tmp_path / "s"))
    assert io.load_scalars(spark, str(tmp_path / "s")) == values


def test_stamp_ignores_order_and_sees_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    stamp = io.content_stamp(df).first()[0]
    assert len(stamp) == 12 and stamp == io.content_stamp(df.orderBy(F.desc("k")).repartition(3)).first()[0]
    assert stamp != io.content_stamp(df.union(df.limit(1))).first()[0]
    assert stamp != io.content_stamp(df.union(df)).first()[0]


def test_prefix_renames_refuse_clashes(spark):
    df = spark.createDataFrame([(1, 2)], "`id-01` int, id_02 int")
    assert io.rename_prefix(df, "id-", "id_").columns == ["id_01", "id_02"]
    with pytest.raises(ValueError, match="duplicate"):
        io.rename_prefix(spark.createDataFrame([(1, 2)], "`id-01` int, id_01 int"), "id-", "id_")


def test_contract_reports_every_violation_at_once(spark):
    df = spark.createDataFrame([(1, "a", -1.0), (1, None, 2.0)], "k int, s string, v double")
    rules = (
        contract.Rule("k", dtype=T.LongType()), contract.Rule("s", nullable=False, isin=("b",)),
        contract.Rule("v", low=0, high=1), contract.Rule("gone"), contract.Rule("x.*", pattern=True),
    )
    found = {(r[0], r[1]): r[2] for r in contract.validate(df, contract.Contract(rules, (("k",),))).collect()}
    assert found == {
        ("k", "type"): 1, ("s", "null"): 1, ("s", "domain"): 1, ("v", "below"): 1, ("v", "above"): 1,
        ("gone", "missing"): 1, ("x.*", "missing"): 1, ("k", "unique"): 1,
    }
    with pytest.raises(ValueError, match="contract"):
        contract.enforce(df, contract.Contract(rules))
    contract.enforce(df, contract.Contract((contract.Rule("k", nullable=False),)))


def test_conform_fills_optional_and_refuses_missing(spark):
    df = spark.createDataFrame([(1, None)], "id int, amount double")
    optional = T.StructType.fromDDL("extra float")
    assert dict(io.conform(df, ["id"], ["id"], optional).dtypes)["extra"] == "float"
    with pytest.raises(ValueError, match="missing"):
        io.conform(df, ["dt"], [], optional)
    with pytest.raises(Exception, match="arrived null"):
        io.conform(df, ["id"], ["amount"], optional).collect()
