"""Token accounting, quotas and conversation lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.functions.constants import (
    DATASET_LIMIT, REPORT_LIMIT, STORAGE_LIMIT_GB, TOKEN_LIMIT, WHITE_SPACE,
)
from gleanframe.functions.text import strip
from gleanframe.operators.columns import ident

MEGABYTE = 1024 * 1024
GIGABYTE = 1024 * 1024 * 1024
# fixed values: price per token, in and out
TOKEN_PRICES = {"light": (0.0000001, 0.0000004), "full": (0.000002, 0.00001)}


def word_count(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{WHITE_SPACE}]+")))


def _json_int(usage: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(usage, f"$.{field}").try_cast("bigint"), F.lit(0))


def message_tokens(text: Column, usage: Column | None = None) -> Column:
    """Counted total, else input plus output, else an estimate from the words.

    A field counts as given when it is present, even with a null value.
    """
    estimate = F.when(
        F.length(text) > 0, F.greatest(F.lit(100), F.floor(word_count(text) * 1.4)).cast("bigint")
    ).otherwise(F.lit(0))
    if usage is None:
        return estimate
    fields = F.coalesce(F.json_object_keys(usage), F.array().cast("array<string>"))
    return (
        F.when(F.array_contains(fields, "total_tokens"), _json_int(usage, "total_tokens"))
        .when(
            F.array_contains(fields, "input_tokens") | F.array_contains(fields, "output_tokens"),
            _json_int(usage, "input_tokens") + _json_int(usage, "output_tokens"),
        )
        .otherwise(estimate)
    )


def token_usage(
    messages: DataFrame, by: str, role: str = "role", text: str = "text", usage: str | None = None,
) -> DataFrame:
    """(by, messages, tokens) over the assistant's messages."""
    tokens = message_tokens(ident(text), None if usage is None else ident(usage))
    return (
        messages.where(ident(role) == "assistant").groupBy(ident(by))
        .agg(F.count(F.lit(1)).alias("messages"), F.sum(tokens).alias("tokens"))
    )


def token_cost(
    df: DataFrame, tokens_in: str, tokens_out: str, price: str,
    prices: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Add ``cost``: tokens times the price of the row's plan, rounded to six digits.

    The price list is part of the expression; a plan without a price has no cost.
    """
    listed = prices or TOKEN_PRICES
    each = F.create_map(*[
        x for k, (i, o) in listed.items() for x in (F.lit(k), F.array(F.lit(i), F.lit(o)))
    ])[ident(price)]
    return df.withColumn("cost", F.round(ident(tokens_in) * each[0] + ident(tokens_out) * each[1], 6))


def quota_percent(used: Column, limit: float) -> Column:
    return F.least(F.lit(100.0), F.round(used * 100.0 / limit, 1))


def quota_status(df: DataFrame, tokens: str, size: str, reports: str, datasets: str) -> DataFrame:
    """Used share of each quota in percent, at most 100."""
    return df.select(
        "*",
        quota_percent(ident(tokens), TOKEN_LIMIT).alias("tokens_pct"),
        quota_percent(ident(size) / GIGABYTE, STORAGE_LIMIT_GB).alias("storage_pct"),
        quota_percent(ident(reports), REPORT_LIMIT).alias("reports_pct"),
        quota_percent(ident(datasets), DATASET_LIMIT).alias("datasets_pct"),
    )


def next_reset(now: Column) -> Column:
    """When quotas start anew: the last second of the coming Sunday.

    The first hour of a Sunday still looks to the end of that day; the rest of it to the next.
    """
    sunday = F.next_day(now - F.expr("INTERVAL 1 HOUR"), "SUN")
    return sunday.cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def storage_columns(size: Column) -> list[Column]:
    return [
        F.round(size / MEGABYTE, 2).alias("storage_mb"),
        F.round(size / GIGABYTE, 4).alias("storage_gb"),
    ]


def usage_summary(
    users: DataFrame, key: str, *, datasets: DataFrame, versions: DataFrame, projects: DataFrame, conversations: DataFrame,
    messages: DataFrame, reports: DataFrame, now: Column,
) -> DataFrame:
    """One row per user: what they own and used, its share of each quota, and when quotas start anew.

    Reads datasets (dataset_id, created_by, deleted_at), versions (dataset_id, byte_size), projects
    (created_by, archived_at), conversations (conversation_id, created_by), messages (conversation_id,
    role, content, token_usage) and reports (generated_by).  Deleted datasets with their versions and
    archived projects do not count; a user without any of it has zeros.

    Sizes and tokens are added up per dataset and conversation before they meet their owners, and all
    measures then meet in one grouping by user, so an owner of a third of all rows is combined before it.
    """
    measures = ("datasets_uploaded", "projects_count", "reports_generated", "storage_bytes", "ai_tokens")

    def facts(rows: DataFrame, owner: str, **given) -> DataFrame:
        cells = [given.get(m, F.lit(0)).cast("bigint").alias(m) for m in measures]
        return rows.where(ident(owner).isNotNull()).select(ident(owner).alias("__owner"), *cells)

    one = F.lit(1)
    live = datasets.where("deleted_at IS NULL").select(F.col("dataset_id").alias("__dataset"), "created_by")
    sizes = versions.groupBy("dataset_id").agg(F.sum(F.col("byte_size").cast("bigint")).alias("__size"))
    spent = token_usage(messages, "conversation_id", text="content", usage="token_usage").select(
        F.col("conversation_id").alias("__conversation"), "tokens"
    )
    sources = [
        facts(live, "created_by", datasets_uploaded=one),
        facts(live.join(sizes, F.col("__dataset") == F.col("dataset_id")), "created_by", storage_bytes=F.col("__size")),
        facts(projects.where("archived_at IS NULL"), "created_by", projects_count=one),
        facts(conversations.join(spent, F.col("conversation_id") == F.col("__conversation")), "created_by", ai_tokens=F.col("tokens")),
        facts(reports, "generated_by", reports_generated=one),
    ]
    used = reduce(DataFrame.unionByName, sources).groupBy("__owner").agg(*[F.sum(m).alias(m) for m in measures])
    owned = users.select(ident(key)).join(used, ident(key) == F.col("__owner"), "left").select(
        ident(key), *[F.coalesce(m, F.lit(0)).alias(m) for m in measures]
    )
    rated = quota_status(owned, "ai_tokens", "storage_bytes", "reports_generated", "datasets_uploaded")
    return rated.select("*", *storage_columns(F.col("storage_bytes")), next_reset(now).alias("resets_at"))


def conversation_list(
    messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", limit: int | None = 50,
) -> DataFrame:
    """Newest conversations: first question, preview of the last message, message count."""
    question = F.when(ident(role) == "user", ident(turn))
    got = messages.groupBy(ident(key)).agg(
        F.min_by(ident(text), question).alias("first_user_message"),
        F.max_by(ident(text), ident(turn)).alias("last_message"),
        F.count(F.lit(1)).alias("message_count"),
    ).select(
        ident(key), "first_user_message",
        F.substring("last_message", 1, 90).alias("last_message_preview"), "message_count",
    )
    return got if limit is None else got.orderBy(ident(key).desc()).limit(limit)
