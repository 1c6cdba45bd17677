"""Files, versions, rules, reports and summaries."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import profile
from gleanframe.plans import analyses, report, rules, summary
from gleanframe.plans.versions import Store
from gleanframe.sources import sinks, tables
from gleanframe.sources.workbooks import sheet_rows


def test_csv_types_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,price,flag,name,rate\n1,"$1,200",True,x,5%\n2,$7,False,"a, b",NA\n3,abc,True\n4,9,False,y,1,extra\n5,4,True,z,2,\n'
    )
    got = tables.load_table(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "double", "boolean", "string", "double"]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (1, 1200.0, True, "x", 5.0), (2, 7.0, False, "a, b", None), (3, None, True, None, None),
    ]


def test_formats():
    assert [tables.format_of(p) for p in ("a.parquet", "b/c.JSON", "x.xlsx", "y.unknown", "noending")] == [
        "parquet", "json", "xlsx", "csv", "csv",
    ]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert [tuple(r) for r in tables.load_table(spark, str(tmp_path / "a.json")).orderBy("a").collect()] == [(1, "x"), (2, None)]


def _workbook(path, rows):
    def cell(r, c, v):
        at = f"{chr(65 + c)}{r + 1}"
        if isinstance(v, str):
            return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
        return "" if v is None else f'<c r="{at}"><v>{v}</v></c>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_folder_of_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["k", "v"], [1, "x"], [2, None]])
    _workbook(tmp_path / "b.xlsx", [["k", "v"], [3, "y"]])
    assert list(sheet_rows((tmp_path / "b.xlsx").read_bytes())) == [["k", "v"], ["3", "y"]]
    got = tables.load_table(spark, str(tmp_path), "xlsx")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "x"), (2, None), (3, "y")]


def test_fingerprint_ignores_order_and_counts_copies(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 7 AS STRING) AS s")
    one = sinks.table_fingerprint(df).first()
    assert one == sinks.table_fingerprint(df.orderBy("s").repartition(5)).first()
    assert one["checksum"] != sinks.table_fingerprint(df.unionAll(df.limit(1))).first()["checksum"]
    assert one["checksum"] != sinks.table_fingerprint(df.withColumnRenamed("s", "t")).first()["checksum"]
    assert sinks.table_fingerprint(df.limit(0)).first()["rows"] == 0


def test_store_keeps_the_columns_of_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.columns("d").count() == 0
    raw = spark.createDataFrame([(1, "a@b.com", None), (2, "c@d.org", 0.5)], "id long, contact string, part double")
    store.append(raw, "d", "raw")
    store.append(raw.select("part", "id").limit(0), "d", "empty", 1)
    store.roll_back("d", 1)
    store.append(raw, "other", "raw")
    got = {(r["version_number"], r["ordinal"]): (r["column"], r["storage_type"], r["is_pii"]) for r in store.columns("d").collect()}
    whole = [("id", "bigint", False), ("contact", "string", True), ("part", "double", False)]
    assert got == {
        **{(v, i + 1): c for v in (1, 3) for i, c in enumerate(whole)}, (2, 1): ("part", "double", False), (2, 2): ("id", "bigint", False),
    }


def test_store_keeps_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    raw = spark.createDataFrame([(" a ", 1.0), ("b", None), ("b", None), (None, None)], "s string, v double")
    assert store.append(raw, "d", "raw") == 1
    assert store.clean("d") == 2
    rows = store.versions("d").collect()
    assert [(r["version_number"], r["stage"], r["row_count"], r["parent_version"]) for r in rows] == [
        (2, "cleaned", 2, 1), (1, "raw", 4, None),
    ]
    assert sorted(map(tuple, store.load("d").collect())) == [("a", 1.0), ("b", 1.0)]
    assert store.load("d", 1).count() == 4 and store.load("d", 99).count() == 2
    assert store.latest().first()["version_number"] == 2
    with pytest.raises(ValueError):
        store.load("none")
    assert store.roll_back("d", 1) == 3 and store.load("d").count() == 4
    store.delete("d", 1)
    assert [(r["version_number"], r["parent_version"]) for r in store.versions("d").collect()] == [(3, None), (2, None)]
    store.delete("d", 3)
    assert store.append(raw, "d", "raw", 2) == 4
    store.delete("d", 4)
    for version in (2, 9):
        with pytest.raises(ValueError):
            store.delete("d", version)


def test_rules_are_approved_by_id(spark):
    df = spark.createDataFrame([(" a ", "x@y.z"), ("b", "q@y.z"), ("b", "q@y.z")], "s string, email string")
    found = rules.suggested(df)
    assert [r.type for r in found] == ["trim_whitespace", "deduplicate", "mask_pii_fields"]
    chosen = rules.approve(found, ["rule_2"], {"rule_2": {"keep": False}})
    assert [tuple(r) for r in rules.apply_rules(df, chosen).collect()] == [(" a ", "x@y.z")]


def test_unknown_rule_changes_nothing(spark):
    df = spark.createDataFrame([(1,)], "a long")
    assert rules.apply_rules(df, [rules.Rule("nothing"), rules.Rule("impute_nulls", "missing")]).collect() == df.collect()


def test_analysis_dispatch(spark):
    df = spark.range(20).selectExpr("id AS a", "id * 2 AS b", "CAST(id % 3 AS STRING) AS g")
    assert analyses.run_analysis(df, "correlation", {"method": "spearman"}).where("section = 'top'").first()["strength"] == "strong"
    assert analyses.run_analysis(df, "anything").count() == 2
    assert analyses.run_analysis(df, "segment_compare", {"category_column": "g", "metric_column": "a"}).count() == 3
    with pytest.raises(ValueError):
        analyses.run_analysis(df, "trend", {"time_column": "t", "metric_column": "a"})


def _employees(spark):
    departments = ["Engineering"] * 40 + ["Sales"] * 30 + ["Support"] * 20 + ["Legal"] * 10
    rows = [
        (f"user-{i:05d}" if i else "user-SECRET", f"{100 + i}-{10 + i % 90}-{2000 + i}" if i else "999-88-7777",
         departments[i], 50000.0 + 250.0 * i if i else 9000000.0, float(i % 10))
        for i in range(100)
    ]
    return spark.createDataFrame(rows, "user_id string, ssn string, department string, salary double, tenure_years double")


def test_summary_holds_aggregates_only(spark):
    document = summary.safe_summary(_employees(spark), "staff", ["user_id"]).first()["document"]
    for secret in ("user-SECRET", "999-88-7777", "user-00050", "62500"):
        assert secret not in document
    got = json.loads(document)
    salary = {r["column"]: r for r in got["stats"]}["salary"]
    assert set(salary) >= {"mean", "median", "std", "min", "max", "outliers_count"}
    counts = {r["value"]: r["count"] for r in got["value_counts"]}
    assert counts["Engineering"] == 40 and len(counts) <= 5
    assert {r["column"] for r in got["value_counts"]} == {"department"}


def test_summary_of_sales(spark):
    rows = [(1000.0 + (i * 37) % 101, 600.0 + (i * 37) % 101 * 0.5, "NSEWC"[i % 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "revenue double, cost double, region string")
    got = json.loads(summary.safe_summary(df, "sales", ["revenue", "cost"]).first()["document"])
    assert got["total_rows"] == 50 and got["total_cols"] == 3 and len(got["correlations"]) >= 1
    assert len(got["groups"]) == 5


def test_report_of_a_table_without_numbers(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), (None,)], "s string")
    got = {(r["section"], r["metric"]) for r in report.table_report(df, ["s"]).collect()}
    assert ("finding", "dominance") in got and ("finding", "duplicates") in got and ("finding", "nulls") in got
    assert report.kpi_cards(df).count() == 4


def test_scores_stay_in_range(spark):
    df = spark.createDataFrame([(1, "null"), (1, "null"), (None, None)], "a long, s string")
    assert 0 <= profile.table_quality(df).first()["quality_score"] <= 100
    assert profile.health_score(df).first()["health_status"] == "Needs Cleaning"


def test_csv_files_meet_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("v,k,w\nz,3,9\n")
    got = {tuple(r) for r in tables.scan_csv(spark, str(tmp_path)).select("k", "v", "w").collect()}
    assert got == {("1", "x", None), ("2", "y", None), ("3", "z", "9")}


def test_workbooks_meet_by_header(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["k", "v"], [1, "x"]])
    _workbook(tmp_path / "b.XLSX", [["v", "k"], ["y", 2, "more"]])
    got = {tuple(r) for r in tables.load_table(spark, str(tmp_path), "xlsx").select("k", "v", "column_2").collect()}
    assert got == {(1, "x", None), (2, "y", "more")}


def test_old_workbooks_are_refused(spark, tmp_path):
    assert tables.format_of("old.xls") == "xls"
    with pytest.raises(ValueError, match="xlsx"):
        tables.load_table(spark, str(tmp_path / "old.xls"))


def test_a_failed_append_does_not_block(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    broken = spark.range(3).selectExpr("id", "raise_error('broken') AS x")
    with pytest.raises(Exception, match="broken"):
        store.append(broken, "d", "raw")
    assert store.append(spark.range(3), "d", "raw") == 1
    assert store.load("d").count() == 3


def test_files_of_any_age_count(spark, tmp_path):
    from gleanframe.streaming import live

    for i in range(20):
        day = 20 - i
        rows = spark.createDataFrame([(f"2024-01-{day:02d} 10:00:00", "a", 1.0)], "ts string, kind string, v double")
        rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = live.read_growing(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=5)
    cards = live.run_available(source, "ts", "kind", "v")
    assert cards.agg(F.sum("n")).first()[0] == 20 and cards.count() == 20


def test_number_formats_that_mean_dates():
    from gleanframe.sources.workbooks import format_kind, moment_text

    dates = ["yyyy-mm-dd", "d/m/yy", "h:mm AM/PM", "[$-409]mmm d", "mm:ss.0", r"dd\.mm", '"am" yyyy']
    assert [format_kind(c) for c in dates] == ["date"] * len(dates)
    others = ["General", "0.00", "#,##0", '0" days"', "[Red]0", "0%", "@", r"0\d", "_-* #,##0_-", '0;"d"']
    assert [format_kind(c) for c in others] == [None] * len(others)
    assert format_kind("[h]:mm") == format_kind("[mm]:ss") == "span"
    assert [moment_text(s, "date", False) for s in ("45000", "45000.5", "1", "59", "61", "0.75", "x", "1e300")] == [
        "2023-03-15", "2023-03-15 12:00:00", "1900-01-01", "1900-02-28", "1900-03-01", "18:00:00", "x", "1e300",
    ]
    assert moment_text("43538", "date", True) == "2023-03-15" and moment_text("1.5", "span", False) == "36:00:00"
