"""Shortcuts before costly parsers and patterns never change what they find."""

from datetime import date

from pyspark.sql import functions as F

from gleanframe.functions.constants import PII_PATTERNS
from gleanframe.functions.dates import DATE_FORMATS, format_shape, parse_timestamp
from gleanframe.operators import schema

DATES = [
    "2024-01-02", "2024-1-2 03:04:05", "2024/01/02", "2024/1/2", "01/02/2024", "13/13/2024", "02-01-2024", "02.01.2024", "Jan 2, 2024", "jan 12, 2024",
    "2 Jan 2024", "12 FEB 2024", "01/02/2024 03:04:05", "2024/01/02 03:04:05", "20240102", "20241302", "2024010", "+12024/01/02", " 2024/01/02 ", "May. 3, 2024",
    "Customer#000000001", "12", "", "x", "Jan 2", "2024", "1/2/24", "Feb 30, 2024", "007 Jan 2024", "2024-13-45", "-2024/01/02", "3 Sept 2024", None,
]
CELLS = [
    "a@b.co", "a@b", "x.y+z@some-host.example.com", "123-45-6789", "1234567", "123456", "+49 (30) 12345", "+1234567890123456", "(030) 123-4567", "1.2.3.4", "300.1.22.333",
    "1.2.3", "1234 5678 9012 3456", "1234-5678-9012-3456", "1234567890123456", "12345678901234567", "  123-45-6789\t", "", "   ", "é@b.co", "a@é.co", None, "123-45-67890",
]


def test_every_listed_format_has_a_shape():
    assert all(format_shape(f) for f in DATE_FORMATS)
    assert format_shape("EEE, d MMM yyyy") is None and format_shape("yyyy'T'HH") is None


def test_dates_parse_as_without_shapes(spark):
    text = F.trim("t")
    plain = F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(text)), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS],
    )
    rows = spark.createDataFrame([(t,) for t in DATES], "t string").select(
        "t", plain.cast("string").alias("want"), parse_timestamp(F.col("t")).cast("string").alias("got"),
    ).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows] and sum(r["got"] is not None for r in rows) > 12


def test_cells_fit_as_the_bare_patterns_say(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "c string").select(F.btrim("c", F.lit(" \t")).alias("c"))
    rows = df.select("c", *[schema._fits(F.col("c"), p).alias(p) for p in PII_PATTERNS], *[F.col("c").rlike(x).alias(f"want_{p}") for p, x in PII_PATTERNS.items()])
    for r in rows.collect():
        assert all(r[p] == r[f"want_{p}"] for p in PII_PATTERNS), r


def test_whole_numbers_fit_as_their_text_does(spark):
    numbers = [s * (10**k + d) for k in range(19) for d in (-1, 0, 1) for s in (1, -1)] + [0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    text = F.col("n").cast("string")
    want = [text.rlike(PII_PATTERNS[p]).alias(f"w{i}") for i, p in enumerate(("phone", "credit_card"))]
    got = [h.alias(f"g{i}") for i, h in enumerate(schema._number_fits(F.col("n")))]
    other = [text.rlike(PII_PATTERNS[p]).alias(p) for p in ("email", "ssn", "ip_address")]
    for r in df.select("n", *want, *got, *other).collect():
        assert (r["g0"], r["g1"]) == (r["w0"], r["w1"]) and not (r["email"] or r["ssn"] or r["ip_address"]), r


def test_types_that_fit_no_pattern(spark):
    df = spark.createDataFrame(
        [(1234567.0, True, date(2024, 1, 2), "12.50", 1234567, "a@b.co")], "f double, b boolean, d date, x string, n bigint, e string",
    ).withColumn("t", F.current_timestamp()).withColumn("dec", F.col("x").cast("decimal(12,2)")).withColumn("big", F.lit(1234567).cast("decimal(20,0)"))
    by_text = [
        c for c in df.columns if df.select(F.greatest(*[F.col(c).cast("string").rlike(p) for p in PII_PATTERNS.values()])).first()[0]
    ]
    assert schema.pii_by_value(df, df.columns) == by_text == ["d", "n", "e", "big"]
