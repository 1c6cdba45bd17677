"""Line-first cleaning with built-in functions only.

Rules look at one line at a time (end punctuation, navigation, boilerplate, shouting, symbols);
lines that fail any are removed, and a document that loses too much of its text is rejected.
Nothing is shuffled: a document is one row from scan to verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.operators.columns import ident

# fixed values of the measures
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
_GAP, _HAS_WORD = "[ \\t\\n\\x0B\\f\\r]+", "[^ \\t\\n\\x0B\\f\\r]"

# thresholds of the line rules
LONG_LINE_WORDS, SYMBOL_PERCENT, SEPARATORS = 8, 8, 3
# a document stays if its clean lines have this share of its word characters
KEEP_PERCENT = 50
ENDS = list(".!?…:;\"”’»)]'")
SEPARATOR = "[|»›•·]"
BOILERPLATE = [
    "lorem ipsum", "javascript", "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "sign in", "sign up", "subscribe", "click here", "read more", "share this", "released under the", "copyright ©", "{", "}",
]


def _words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP, -1))


def _any_of(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def line_verdict(line: Column, boilerplate: Column, symbols: Column, separators: Column) -> Column:
    """Name of the first rule that a line fails, null if it stays.

    The last three say whether the whole text can fail that rule at all, so that most lines are
    spared the search.
    """
    return (
        F.when(boilerplate & _any_of(F.lower(line), BOILERPLATE), "boilerplate")
        .when(symbols & (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > F.length(line) * SYMBOL_PERCENT), "symbols")
        .when(separators & (F.regexp_count(line, F.lit(SEPARATOR)) >= SEPARATORS), "navigation")
        .when((F.upper(line) == line) & (F.lower(line) != line) & (F.size(_words(line)) >= 3), "shouting")
        .when(
            ~F.substring(F.rtrim(line, F.lit(WHITE)), -1, 1).isin(ENDS) & (F.size(_words(line)) >= LONG_LINE_WORDS), "no end",
        )
    )


def clean_lines(
    df: DataFrame, *, key: str = "doc_id", text: str = "text",
    windows: int = 3, least_words: int = 50, repeat_percent: int = 50, keep_percent: int = KEEP_PERCENT,
) -> DataFrame:
    """(key, measures, base_failed, kept, clean_text, lines_removed), one row per input row.

    ``n_repeat_words`` counts words in windows that occur twice or more in the text, the first
    occurrence included; windows are told apart by a 64-bit hash.  A null or empty text has no
    words, fails the base rules and is not kept; its clean text is empty.  Equal rows get equal
    verdicts and an empty table gives an empty one.
    """
    t = F.col("__t")
    base = df.select(ident(key).alias("__key"), F.coalesce(ident(text).cast("string"), F.lit("")).alias("__t"))
    split = base.select(
        "__key", "__t", _words(t).alias("__w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(_HAS_WORD)).alias("__lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).alias("__symbols"),
        _any_of(F.lower(t), BOILERPLATE).alias("__boiler"), t.rlike(SEPARATOR).alias("__separators"),
    )
    n = F.size("__w")
    hashes = F.transform(
        F.sequence(F.lit(0), n - windows),
        lambda i: F.xxhash64(*[F.get(F.col("__w"), i + F.lit(j)) for j in range(windows)]),
    )
    marked = split.select(
        "*", F.when(n >= windows, hashes).otherwise(F.array().cast("array<bigint>")).alias("__h"),
        F.filter(F.col("__lines"), lambda x: line_verdict(
            x, F.col("__boiler"), F.col("__symbols") > 0, F.col("__separators"),
        ).isNull()).alias("__good"),
    )
    # only a text with some window twice is looked at by position
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = marked.select("*", F.when(repeats, F.array_sort(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )).alias("__p"))
    last = F.size("__p") - 1

    def again(p: Column, i: Column) -> Column:
        before = (i > 0) & (F.get(F.col("__p"), i - 1)["h"] == p["h"])
        after = (i < last) & (F.get(F.col("__p"), i + 1)["h"] == p["h"])
        return before | after

    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.filter("__p", again), lambda p: F.array(*[p["i"] + F.lit(j) for j in range(windows)])
    ))))
    good = F.array_join(_words(F.array_join("__good", "\n")), "")
    measured = placed.select(
        "__key", "__lines", "__good",
        n.cast("bigint").alias("n_words"), F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.col("__symbols").cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("__p").isNotNull(), covered).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.array_join("__good", "\n").alias("clean_text"),
        F.when(F.size("__good") == F.size("__lines"), F.length(F.array_join("__w", ""))).otherwise(F.length(good)).alias("__clean"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    enough = 100 * F.col("__clean") >= keep_percent * F.col("word_chars")
    return measured.select(
        F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & enough).alias("kept"), "clean_text",
        (F.size("__lines") - F.size("__good")).cast("bigint").alias("lines_removed"),
    )
