"""Cleaning rules as data, applied in order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gleanframe.functions.text import strip
from gleanframe.operators import clean
from gleanframe.operators.columns import ident, text_columns
from gleanframe.operators.schema import mask_pii, pii_suspects
from gleanframe.session import materialise


@dataclass(frozen=True)
class Rule:
    """One cleaning step; ``column=None`` means the whole table."""

    type: str
    column: str | None = None
    params: dict = field(default_factory=dict)
    id: str | None = None
    rationale: str = ""


def default_rules() -> list[Rule]:
    """What an empty rule list stands for."""
    return [
        Rule("trim_whitespace", params={"null_tokens": True}),
        Rule("drop_empty_rows", params={"guard_amounts": True}),
        Rule("deduplicate"),
        Rule("impute_nulls"),
    ]


# rules that look at the whole table before they can rewrite it
_SCANNING = ("impute_nulls", "clip_outliers", "filter_outliers", "drop_empty_cols")


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    """Apply one rule; unknown types and missing columns change nothing."""
    p = rule.params
    if rule.column is not None and rule.column not in df.columns:
        return df
    columns = [rule.column] if rule.column else None
    match rule.type.lower():
        case "trim_whitespace":
            step = clean.trim_and_null_tokens if p.get("null_tokens") else clean.trim_whitespace
            return step(df, columns)
        case "drop_empty_rows":
            if p.get("guard_amounts"):
                df = clean.guard_amounts(clean.drop_repeated_columns(df))
            return clean.drop_empty_rows(df)
        case "drop_empty_cols":
            return clean.drop_empty_columns(df)
        case "deduplicate":
            return clean.deduplicate(
                df, p.get("keep", "first"), p.get("keys", ()), p.get("order_by", ())
            )
        case "non_negative":
            return clean.non_negative(df, columns or clean.amount_columns(df))
        case "value_range" if rule.column:
            return clean.value_range(df, rule.column, p.get("min"), p.get("max"))
        case "type_coercion" if rule.column:
            return clean.coerce_type(df, rule.column, p.get("target_type"))
        case "impute_nulls" if rule.column:
            return clean.impute_column(df, rule.column, p.get("strategy", "median"), p.get("value"))
        case "impute_nulls":
            return clean.impute_all(df)
        case "clip_outliers":
            return clean.clip_outliers(df, columns, p.get("k", 1.5))
        case "filter_outliers":
            return clean.filter_outliers(df, columns, p.get("k", 1.5))
        case "mask_pii_fields":
            return mask_pii(df, columns)
    return df


def apply_rules(df: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """Fold the rules, or the default ones, over a table.

    Removing copies shuffles every row.  Where a later rule scans the table to find its
    values, the rows are written once after that shuffle instead of shuffled per scan.
    """
    todo = list(rules) or default_rules()

    def step(current: DataFrame, at: int) -> DataFrame:
        out = apply_rule(current, todo[at])
        if todo[at].type == "deduplicate" and any(r.type in _SCANNING for r in todo[at + 1:]):
            out = materialise(out, "deduplicated")
        return out

    return reduce(step, range(len(todo)), df)


def approve(
    suggested: Sequence[Rule], ids: Sequence[str], edits: dict[str, dict] | None = None,
) -> list[Rule]:
    """The approved rules in their suggested order, with edited parameters."""
    edits = edits or {}
    return [
        replace(r, params={**r.params, **edits.get(r.id, {})}) for r in suggested if r.id in set(ids)
    ]


def suggest_rules(df: DataFrame) -> DataFrame:
    """(rule, affected_rows) counted over the table: one scan, and one grouping for copies."""
    names = text_columns(df)
    empty, padded = F.lit(True), F.lit(False)
    for c in df.columns:
        empty = empty & ident(c).isNull()
    for c in names:
        padded = padded | F.coalesce(strip(ident(c)) != ident(c), F.lit(False))
    marked = df.select(clean.row_digest(df).alias("row"), empty.alias("empty"), padded.alias("padded"))
    grouped = marked.groupBy("row", "empty", "padded").agg(F.count(F.lit(1)).alias("n"))
    got = grouped.agg(
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("drop_empty_rows"),
        F.coalesce(F.sum(F.when(F.col("padded"), F.col("n"))), F.lit(0)).alias("trim_whitespace"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deduplicate"),
    )
    kinds = ["drop_empty_rows", "trim_whitespace", "deduplicate"]
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("affected_rows")) for k in kinds])
    return got.select(F.explode(pairs).alias("x")).select("x.*")


def suggested(df: DataFrame) -> list[Rule]:
    """Rules that would change something, numbered for approval, with a PII rule if needed."""
    counts = suggest_rules(df).collect()
    rules = [Rule(r["rule"], rationale=f"changes {r['affected_rows']} rows") for r in counts if r["affected_rows"]]
    rules += [
        Rule("mask_pii_fields", column=c, rationale="looks like personal data") for c in pii_suspects(df)
    ]
    return [replace(r, id=f"rule_{i + 1}") for i, r in enumerate(rules)]
