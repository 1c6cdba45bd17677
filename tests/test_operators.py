"""Small literal tables for cases the test data lacks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.functions import stats, text
from gleanframe.functions.dates import bin_step, parse_timestamp, to_display_time
from gleanframe.operators import catalog, clean, metrics, profile, ranks, relate, scale, schema, trend, usage, view


def test_number_texts(spark):
    cases = {
        "12": 12.0, " 12 ": 12.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "-7": -7.0, "1d": None, "0x10": None, "nan": None,
        "inf": None, "": None, "-": None, "1,234": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r["s"]: r["n"] for r in df.select("s", text.parse_number(F.col("s")).alias("n")).collect()}
    assert got == cases


def test_redacted_texts(spark):
    m = text.MASK
    cases = {
        "at 10.20.30.40 now": f"at {m} now", "1.2.3.4": m, "a@b.c 1.2.3.4": f"{m} {m}", "12.34.56.78.90": f"{m}.90",
        "é1234567812345678": f"é{m}", "1234567812345678é": f"{m}é", "ü123-45-6789.": f"ü{m}.", "é10.20.30.40ñ": f"é{m}ñ",
        "x10.20.30.40": "x10.20.30.40", "_123-45-6789": "_123-45-6789", "10.20.30": "10.20.30", "": "", None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r["s"]: r["got"] for r in df.select("s", text.redact(F.col("s")).alias("got")).collect()}
    assert got == cases


def test_amount_and_integer_texts(spark):
    amounts = {"$1,234": 1234.0, "45%": 45.0, "€ 7.5": 7.5, "£-3": -3.0, "$$1": None}
    df = spark.createDataFrame([(c,) for c in amounts], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", text.parse_amount(F.col("s")).alias("n")).collect()} == amounts
    whole = {"1.0": 1, "1.7": None, "1e3": 1000, "9007199254740993": 9007199254740993, "99999999999999999999": None}
    df = spark.createDataFrame([(c,) for c in whole], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", text.parse_integer(F.col("s")).alias("n")).collect()} == whole


def test_date_texts(spark):
    cases = ["2024-02-29", "2024/02/29", "02/29/2024", "29-02-2024", "Feb 29, 2024", "2024-02-29T10:00:00", "12345", "soon"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(F.to_date(parse_timestamp(F.col("s")))).collect()]
    assert got == [dt.date(2024, 2, 29)] * 6 + [None] * 2


def test_month_steps_keep_the_day(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),)], "d date")
    got = df.select(*[bin_step(F.col("d"), "ME", F.lit(k)).alias(str(k)) for k in (1, 12)]).first()
    assert tuple(got) == (dt.date(2024, 3, 29), dt.date(2025, 2, 28))
    assert df.select(to_display_time(F.lit("2024-01-01 00:00:00").cast("timestamp"))).first()[0].hour == 5


def test_student_distribution():
    # quantiles from printed tables
    assert stats.student_two_sided([2.228], [10])[0] == pytest.approx(0.05, abs=2e-5)
    assert stats.student_two_sided([1.0], [1])[0] == pytest.approx(0.5, abs=1e-12)
    assert stats.student_two_sided([12.706], [1])[0] == pytest.approx(0.05, abs=1e-5)
    assert stats.student_two_sided([1.96], [1e9])[0] == pytest.approx(0.05, abs=1e-4)
    assert stats.slope_p_values([0.0, 1.0], [1.0, 0.0], [9, 9]) == [1.0, 0.0]


def test_p_value_agrees_with_linear_regression(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(7)
    rows = [(i, float(i), float(0.02 * i + rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    fitted = LinearRegression(solver="normal", labelCol="y").fit(
        VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    )
    got = trend.trend_p_values(df, ["k"], ["y"]).first()["p_value"]
    assert got == pytest.approx(fitted.summary.pValues[0], abs=1e-6)


def test_describe_tiny_and_empty(spark):
    df = spark.createDataFrame([(5.0, None, float("nan")), (5.0, None, 2.0)], "a double, b double, c double")
    got = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"]["std"] == 0.0 and got["a"]["skewness"] == 0.0 and got["c"]["std"] == 0.0
    assert got["c"]["null_pct"] == 50.0
    assert profile.describe_numeric(df.limit(0)).count() == 0


def test_empty_table_quality(spark):
    row = profile.table_quality(spark.createDataFrame([], "a long, b string")).first()
    assert row["completeness_pct"] == 100.0 and row["quality_score"] == 100.0 and row["duplicate_pct"] == 0.0
    assert profile.health_score(spark.createDataFrame([], "a long")).first()["health_status"] == "Excellent"


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(0.1, float(i), float(i * 2)) for i in range(9)], "k double, a double, b double")
    pairs = {(r["col1"], r["col2"]): r["r"] for r in relate.pearson_pairs(df).collect()}
    assert pairs["k", "a"] is None and pairs["a", "b"] == pytest.approx(1.0)
    assert relate.ranked_pairs(df).count() == 1
    ranks = {(r["col1"], r["col2"]): r["r"] for r in relate.spearman_pairs(df).collect()}
    assert ranks["k", "a"] is None and ranks["a", "b"] == pytest.approx(1.0)
    gaps = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (7.0, None), (None, 4.0)], "a double, b double")
    assert relate.spearman_pairs(gaps).first()["r"] is None
    assert relate.correlation_matrix(df.select("a")).count() == 0


def test_integer_sized_floats_keep_their_correlation(spark):
    df = spark.createDataFrame([(1e9 + i, 2e9 - i) for i in range(100)], "a double, b double")
    assert relate.pearson_pairs(df).first()["r"] == pytest.approx(-1.0, abs=1e-12)


def test_whole_row_copies_with_nulls_and_maps(spark):
    rows = [(1, None), (1, None), (2, "a")]
    df = spark.createDataFrame(rows, "a long, b string")
    assert clean.deduplicate(df).count() == 2
    assert [tuple(r) for r in clean.deduplicate(df, keep=False).collect()] == [(2, "a")]
    maps = spark.createDataFrame([({"x": 1, "y": 2},), ({"y": 2, "x": 1},), ({"x": 3},)], "m map<string,int>")
    assert clean.deduplicate(maps).count() == 2
    assert clean.deduplicate(maps, keep=False).count() == 1
    assert profile.table_quality(maps).first()["duplicate_rows"] == 1


def test_key_copies_keep_first_or_last(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "e"), (None, 1, "n"), (None, 2, "m")], "k long, t long, v string")
    first = {tuple(r) for r in clean.deduplicate(df, keys=["k"], order_by=["t"]).collect()}
    last = {tuple(r) for r in clean.deduplicate(df, "last", ["k"], ["t"]).collect()}
    assert first == {(1, 1, "a"), (2, 5, "e"), (None, 1, "n")}
    assert last == {(1, 3, "c"), (2, 5, "e"), (None, 2, "m")}
    assert [tuple(r) for r in clean.deduplicate(df, False, ["k"]).collect()] == [(2, 5, "e")]


def test_repeated_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long").toDF("a", "b", "a")
    out = clean.drop_repeated_columns(df)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (1, 2)


def test_impute_edge_cases(spark):
    df = spark.createDataFrame([(None, "b", 1, None), (None, "a", None, 2.0), (None, None, 4, 4.0)], "n double, s string, i long, x double")
    out = {c: [r[c] for r in clean.impute_all(df).collect()] for c in df.columns}
    assert out["n"] == [0.0] * 3 and sorted(out["s"]) == ["N/A", "a", "b"]
    assert sorted(out["i"]) == [1.0, 2.5, 4.0] and sorted(out["x"]) == [2.0, 3.0, 4.0]
    assert clean.column_mode(df, "s") == "a"
    assert clean.impute_column(df, "s", "median").collect() == df.collect()
    assert clean.impute_column(df, "s", "no_such").collect() == df.collect()


def test_amount_guard_spares_texts(spark):
    df = spark.createDataFrame([("Chad", "-5", 130.0), ("Peru", "7", 40.0)], "country string, price string, age double")
    out = clean.guard_amounts(df).collect()
    assert [r["country"] for r in out] == ["Chad", "Peru"]
    assert [r["price"] for r in out] == [None, 7.0] and [r["age"] for r in out] == [None, 40.0]


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(" a ", 1.0), ("N/A", -1.0), (None, None), ("b", 500.0), ("b", 500.0)], "s string, v double")
    for step in (clean.trim_and_null_tokens, clean.drop_empty_rows, clean.deduplicate, lambda d: clean.clip_outliers(d, ["v"])):
        once = step(df)
        assert sorted(map(repr, step(once).collect())) == sorted(map(repr, once.collect()))


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, None)], "`a.b` double, `c d` string")
    assert profile.describe_numeric(df).first()["mean"] == 2.0
    assert profile.null_profile(df).count() == 2 and profile.profile_table(df).count() == 2
    assert clean.impute_all(df).count() == 2 and view.search_rows(df, "X").count() == 1


def test_types_of_literal_columns(spark):
    rows = [(i, f"code{i}", f"2024-01-{i % 28 + 1:02d} 10:00:{i % 60:02d}.{i}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, code string, at string, none string")
    assert schema.logical_types(df) == {"i": "integer", "code": "string", "at": "datetime", "none": "string"}


def test_pii_by_value(spark):
    df = spark.createDataFrame([("123-45-6789", "10.0.0.1", "plain", ""), ("x", "10.0.0.2", "text", None)], "a string, b string, c string, d string")
    assert schema.pii_suspects(df) == ["a", "b"]
    masked = schema.mask_pii(df).collect()
    assert masked[0]["a"] == "••••••••" and masked[0]["c"] == "plain"


def test_personal_data_below_the_first_rows(spark):
    df = spark.range(100).selectExpr("id", "IF(id < 25, NULL, concat('u', id, '@example.com')) AS note", "concat('2024-01-0', id % 9 + 1, ' 10:00:', 10 + id % 50, '.', id) AS at")
    assert schema.pii_suspects(df) == ["note"]
    assert schema.mask_pii(df).where("note LIKE '%@%'").count() == 0


def test_cycle_of_versions_is_refused(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "v long, p long")
    with pytest.raises(ValueError, match="cycle"):
        catalog.version_lineage(df, "v", "p")


def test_deleting_keeps_versions_without_a_number(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", None, None), (None, 2, None)], "k string, n long, p long")
    got = {(r["k"], r["n"], r["p"]) for r in catalog.delete_version(df, "k", "n", "p", 1).collect()}
    assert got == {("a", 2, None), ("a", None, None), (None, 2, None)}


@pytest.mark.parametrize("limit", [0, 50_000])
def test_group_medians_with_infinities(spark, limit):
    inf = float("inf")
    rows = [("all", inf)] * 4 + [("some", v) for v in (1.0, 2.0, inf, inf)] + [("low", -inf), ("low", 3.0), ("low", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in ranks.grouped_quantiles(df, ["g"], "v", {"m": 0.5}, limit=limit).collect()}
    assert got == {"all": inf, "some": inf, "low": 3.0}


def test_wide_correlations_equal_narrow_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) + 50
    x[:, 1] += 3 * x[:, 0]
    x[:, 2] = 7.0
    x[::5, 3] = np.nan
    x[::7, 4] = np.inf
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(8)]).repartition(4)
    want = {(r["col1"], r["col2"]): r["r"] for r in relate.pearson_pairs(df).collect()}
    monkeypatch.setattr(relate, "WIDE", 1)
    got = {(r["col1"], r["col2"]): r["r"] for r in relate.pearson_pairs(df).collect()}
    assert set(got) == set(want)
    for pair, r in want.items():
        assert got[pair] == (None if r is None else pytest.approx(r, abs=1e-9)), pair


def test_onehot_vectors_of_many_values(spark):
    df = spark.createDataFrame([(i, f"v{i % 700:04d}" if i % 9 else None) for i in range(2000)], "i long, v string")
    got = scale.encode_onehot_vector(df, "v").collect()
    values = sorted({r["v"] for r in got if r["v"]})
    assert len(got) == 2000
    for r in got:
        assert r["v_onehot"].size == len(values)
        assert r["v_onehot"].indices.tolist() == ([] if r["v"] is None else [values.index(r["v"])])


def test_copies_by_digest(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), (None, "a", 0.0), ("a", None, None)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    got = profile.table_quality(df).first()
    assert got["duplicate_rows"] == 2 and got["null_cells"] == 6


def test_both_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "v double")
    assert profile.distinct_profile(df).first()["distinct_count"] == 2


def test_trend_needs_points_and_handles_flat(spark):
    day = dt.datetime(2024, 1, 1)
    flat = spark.createDataFrame([(day + dt.timedelta(days=i), 4.0) for i in (0, 1, 2, 6)], "t timestamp, v double")
    fit = trend.trend_fit(flat, "t", "v").first()
    assert fit["slope"] == 0.0 and fit["r_squared"] == 0.0 and fit["direction"] == "flat" and fit["bins"] == 7
    rising = spark.createDataFrame([(day + dt.timedelta(days=i), float(i)) for i in range(9)], "t timestamp, v double")
    assert trend.trend_fit(rising, "t", "v").first()["direction"] == "up"
    forecast = trend.trend_forecast(rising, "t", "v").collect()
    assert [r["predicted_mean"] for r in sorted(forecast, key=lambda r: r["step"])] == [9.0, 10.0, 11.0, 12.0, 13.0, 14.0]
    with pytest.raises(ValueError):
        trend.resample(flat.limit(2), "t", "v")


def test_resample_spans(spark):
    def freq(days):
        rows = [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 1) + dt.timedelta(days=days), 2.0), (dt.datetime(2024, 1, 2), 1.0)]
        return trend.time_span(spark.createDataFrame(rows, "t timestamp, v double"), "t", "v").freq
    assert [freq(d) for d in (89, 90, 364, 365)] == ["D", "W", "W", "ME"]


def test_regression_metrics_of_constant_labels(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert row["r2_score"] == 1.0 and row["rmse"] == 0.0 and row["mape_pct"] == 0.0


def test_scaling_a_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    for fn in (scale.scale_standard, scale.scale_minmax, scale.scale_robust):
        assert [r["v"] for r in fn(df).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        scale.encode_onehot(spark.range(300).selectExpr("CAST(id AS STRING) AS s"), "s")


def test_pages(spark):
    df = spark.range(45)
    assert [r["id"] for r in view.paginate(df, ["id"], 3, 20).collect()] == list(range(40, 45))
    assert view.clamp_page(0, 1000) == (1, 100)
    assert tuple(view.page_count(df.limit(0)).first()) == (0, 1)
    assert [r["id"] for r in view.page_after(df, "id", 40).collect()] == [41, 42, 43, 44]


def test_search_is_literal(spark):
    df = spark.createDataFrame([("50%",), ("50",), (None,)], "s string")
    assert view.search_rows(df, "0%").count() == 1 and view.search_rows(df, " ").count() == 3


def test_lineage_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 99)], "v long, p long")
    got = {r["v"]: (r["root"], r["depth"]) for r in catalog.version_lineage(df, "v", "p").collect()}
    assert got[39] == (0, 39) and got[0] == (0, 0) and got[100] == (100, 0)


def test_next_reset(spark):
    cases = {
        dt.datetime(2024, 5, 1, 12): 5, dt.datetime(2024, 5, 4, 23, 59): 5, dt.datetime(2024, 5, 5, 0, 30): 5,
        dt.datetime(2024, 5, 5, 1): 12, dt.datetime(2024, 5, 6): 12,
    }
    df = spark.createDataFrame([(now,) for now in cases], "now timestamp_ntz")
    got = {r["now"]: r["at"] for r in df.select("now", usage.next_reset(F.col("now")).alias("at")).collect()}
    assert got == {now: dt.datetime(2024, 5, day, 23, 59, 59) for now, day in cases.items()}


def test_group_means_stop_at_ten_groups(spark):
    many = spark.range(40).selectExpr("CAST(id % 11 AS STRING) AS g", "CAST(id AS DOUBLE) AS v")
    assert profile.small_group_means(many, "g", "v").count() == 0
    assert profile.small_group_means(many.where("g < 10"), "g", "v").count() == 5


def test_histogram_of_a_constant(spark):
    rows = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), bins=4).collect()
    assert sum(r["count"] for r in rows) == 2 and len(rows) == 4
    assert not any(math.isnan(r["low"]) for r in rows)


def test_usage_of_each_user(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user long")
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    got = usage.usage_summary(
        users, "user", now=F.lit("2024-05-15 10:00:00").cast("timestamp_ntz"),
        datasets=rows([(10, 1, None), (11, 1, "2024-01-01"), (12, 2, None), (13, None, None)], "dataset_id long, created_by long, deleted_at string"),
        versions=rows([(10, 1 << 30), (10, 1 << 29), (11, 7), (13, 5), (99, 5), (12, None)], "dataset_id long, byte_size long"),
        projects=rows([(1, None), (1, "2024-01-01")], "created_by long, archived_at string"),
        conversations=rows([(7, 1), (8, 2)], "conversation_id long, created_by long"),
        messages=rows([
            (7, "assistant", "x", '{"total_tokens": 500}'), (7, "user", "x", '{"total_tokens": 900}'), (7, "assistant", "a b", None),
            (8, "assistant", None, None), (9, "assistant", "x", None),
        ], "conversation_id long, role string, content string, token_usage string"),
        reports=rows([(1,), (1,), (None,)], "generated_by long"),
    )
    fields = ("datasets_uploaded", "projects_count", "reports_generated", "storage_bytes", "ai_tokens", "storage_gb", "storage_pct")
    assert {r["user"]: tuple(r[f] for f in fields) for r in got.collect()} == {
        1: (1, 1, 2, 3 << 29, 600, 1.5, 75.0), 2: (1, 0, 0, 0, 0, 0.0, 0.0), 3: (0, 0, 0, 0, 0, 0.0, 0.0),
    }
