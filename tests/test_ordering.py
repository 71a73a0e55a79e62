"""Order statistics and running sums against numpy, with one bucket and with many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions.lookup import bin_by_edges, interpolate
from riskframe.plans import ordering as o

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def frame(spark):
    n = 3000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            # a third of all rows in one group, a third of all values tied
            "g": np.where(RNG.random(n) < 0.34, 0, RNG.integers(1, 9, n)),
            "x": np.where(RNG.random(n) < 0.34, 5.0, np.round(RNG.lognormal(1, 1, n), 2)),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_numpy(frame, bucket_rows):
    pdf, df = frame
    probs = [0, 0.1, 0.333, 0.5, 0.99, 1]
    got = o.quantiles(df, "x", probs).toPandas().sort_values("prob")["value"].to_numpy()
    np.testing.assert_allclose(got, np.quantile(pdf.x, probs), rtol=1e-12)


def test_grouped_quantiles_match_pandas(frame, bucket_rows):
    pdf, df = frame
    got = o.quantiles(df, "x", [0.25, 0.99], ["g"]).toPandas().set_index(["g", "prob"])["value"].sort_index()
    want = pdf.groupby("g").x.quantile([0.25, 0.99]).sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 29, 30, 100])
def test_discrete_quantiles_use_integer_positions(spark, n, bucket_rows):
    values = np.sort(np.round(RNG.random(n), 2))
    df = spark.createDataFrame(pd.DataFrame({"x": RNG.permutation(values)}))
    got = o.discrete_quantiles(df, "x", 10).toPandas().sort_values("k")["value"].to_numpy()
    k = np.arange(1, 10)
    np.testing.assert_array_equal(got, values[-(-k * n // 10) - 1])


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_match_cumsum(frame, bucket_rows, descending):
    pdf, df = frame
    steps = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    got = o.prefix_sums(steps, "x", ["n"], ["g"], descending).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("x", ascending=not descending)
        assert (part.n.cumsum() == part.cum_n).all()
        assert (part.total_n == part.n.sum()).all()


def test_values_at_ranks_report_what_is_ahead(frame, bucket_rows):
    pdf, df = frame
    ranks = [0, 10, 500, 2999]
    targets = df.sparkSession.createDataFrame([(r,) for r in ranks], "rank bigint")
    got = o.values_at_ranks(df, "x", targets, descending=True).toPandas().sort_values("rank")
    ordered = np.sort(pdf.x)[::-1]
    for row in got.itertuples():
        assert row.value == ordered[row.rank]
        assert row.before == (pdf.x > row.value).sum()
        assert row.tied == (pdf.x == row.value).sum()


def test_result_does_not_depend_on_partitioning(frame, bucket_rows):
    _, df = frame
    seen = set()
    for parts in (1, 7, 64):
        shuffled = df.orderBy(F.rand(3)).repartition(parts)
        rows = o.quantiles(shuffled, "x", [0.5, 0.9], ["g"]).collect()
        seen.add(tuple(sorted((r["g"], r["prob"], r["value"]) for r in rows)))
    assert len(seen) == 1


def test_column_quantiles_ignore_missing(spark, bucket_rows):
    pdf = pd.DataFrame({"a": [1.0, None, 3.0, 10.0], "b": [5.0, 5.0, None, 6.0]})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r["value"] for r in o.column_quantiles(df, ["a", "b"], probs=[0.5]).collect()}
    assert got == {"a": 3.0, "b": 5.0}


@pytest.mark.parametrize("side", ["left", "right"])
@pytest.mark.parametrize("count", [0, 1, 9, 64, 65, 400])
def test_bins_match_searchsorted(frame, side, count):
    pdf, df = frame
    edges = np.sort(np.round(RNG.lognormal(1, 1, count), 2))
    if count > 3:
        edges[1] = edges[2] = edges[0]
    got = bin_by_edges(df, "x", list(np.sort(edges)), side, "b").toPandas()
    np.testing.assert_array_equal(got.b, np.searchsorted(np.sort(edges), got.x, side=side))


def test_bins_leave_missing_values_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,)], "x double")
    for edges in ([1.0], [float(i) for i in range(100)]):
        got = [r["b"] for r in bin_by_edges(df, "x", edges, "left", "b").collect()]
        assert got[:2] == [None, None] and got[2] is not None


def test_unsorted_edges_are_refused(frame):
    with pytest.raises(ValueError, match="sorted"):
        bin_by_edges(frame[1], "x", [2.0, 1.0])


@pytest.mark.parametrize("count", [1, 2, 30, 200])
def test_interpolation_matches_numpy(frame, count):
    _, df = frame
    xs = np.unique(np.round(RNG.lognormal(1, 1, count), 3))
    ys = np.sort(RNG.random(len(xs)))
    got = interpolate(df, "x", list(xs), list(ys), "y").toPandas()
    np.testing.assert_allclose(got.y, np.interp(got.x, xs, ys), rtol=1e-12)


def test_inputs_never_order_a_whole_group_in_one_task(spark, frame):
    """Every row-level window carries the bucket in its partitioning."""
    _, df = frame
    steps = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    plan = o.prefix_sums(steps, "x", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "x#" in line.split("],")[0]]
    ordered_by_value = [line for line in plan.splitlines() if "Window [" in line and "[x#" in line]
    assert windows or ordered_by_value
    assert all("_b#" in line for line in ordered_by_value)


def test_nan_is_last_null_has_no_rank_and_texts_are_ordered(spark, bucket_rows):
    rows = [(i, [0.5, float("nan"), None, float("inf"), float("-inf"), 2.0][i % 6], f"same-prefix-{i * 37 % 400:03d}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, name string")
    targets = spark.createDataFrame([(k,) for k in (0, 70, 150, 250, 320)], "rank long")
    got = {r["rank"]: r["value"] for r in o.values_at_ranks(df, "x", targets).collect()}
    expected = sorted((r[1] for r in rows if r[1] is not None), key=lambda v: (v != v, v))
    for k, v in got.items():
        assert v == expected[k] or (v != v and expected[k] != expected[k])
    names = sorted(r[2] for r in rows)
    found = o.values_at_ranks(df, "name", targets, descending=True).collect()
    assert {r["rank"]: r["value"] for r in found} == {k: names[-1 - k] for k in (0, 70, 150, 250, 320)}
    steps = df.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    sums = {repr(r["x"]): r["cum_n"] for r in o.prefix_sums(steps, "x", ["n"]).collect()}
    assert sums["-inf"] < sums["0.5"] < sums["2.0"] < sums["inf"] < sums["nan"] == len(expected)


def test_buckets_never_decrease_and_tell_signs_zero_infinity_and_nan_apart(spark):
    from riskframe.plans.selection import number_bucket

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 2000), rng.lognormal(0, 80, 2000), -rng.lognormal(0, 80, 500), 2.0 ** np.arange(-1074, 1024, 7),
                        [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, np.inf, -np.inf, 1 - 2**-53, 1.0, 1 + 2**-52]])
    x = np.sort(np.concatenate([x, np.nextafter(x[:500], 9e9)]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*x, float("nan")])], "i long, x double")
    found = np.array([r["b"] for r in number_bucket(df, "x", "b").orderBy("i").collect()])
    assert (np.diff(found) >= 0).all() and found[-1] > found[-2]
    assert len(set(found)) > 2500
    assert (found[:-1][x < 0] <= found[:-1][x == 0].min()).all() and len(set(found[:-1][x == 0])) == 1


def test_sums_ahead_and_ineligible_rows(spark):
    from riskframe.plans.selection import Selection

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 900), "x": np.round(rng.lognormal(0, 2, 900), 1), "w": rng.integers(0, 9, 900), "ok": rng.random(900) < 0.7})
    pdf["g"] = pdf["g"].where(pdf["g"] > 0).astype("Int64")
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g long, x double, w long, ok boolean")
    chosen = Selection(df, "x", ["g"], descending=True, eligible=F.col("ok"), sums={"w": F.col("w")})
    totals = {r["g"]: (r["n"], r["rows"], r["w"]) for r in chosen.group_totals().collect()}
    targets = spark.createDataFrame([(g, r, f"{r}!") for g in (None, 1, 2) for r in (0, 17, 100, 9999)], "g long, rank long, name string")
    got = chosen.values(targets).collect()
    assert len(got) == 9
    for g, part in pdf.groupby("g", dropna=False):
        key = None if pd.isna(g) else int(g)
        ranked = part[part.ok].sort_values("x", ascending=False)
        assert totals[key] == (len(ranked), len(part), part.w.sum())
        for r in (r for r in got if r["g"] == key):
            v = ranked.x.iloc[r["rank"]]
            assert (r["value"], r["before"], r["tied"], r["name"]) == (v, (ranked.x > v).sum(), (ranked.x == v).sum(), f"{r['rank']}!")
            assert (r["w_before"], r["w_tied"]) == (ranked.w[ranked.x > v].sum(), ranked.w[ranked.x == v].sum())


def test_ranks_take_two_scans_and_no_cache(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).selectExpr("id % 3 AS g", "id * 0.37 AS x").write.parquet(path)
    spark.sparkContext.setJobGroup("ranks", "ranks")
    got = o.quantiles(spark.read.parquet(path), "x", [0.5], ["g"]).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ranks")
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == 3 and len(jobs) <= 12
    plan = o.quantiles(spark.read.parquet(path), "x", [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan
