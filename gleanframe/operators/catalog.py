"""Ownership chains, versions, lineage and cascaded deletion over catalog tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gleanframe.operators.columns import ident
from gleanframe.operators.lookup import attach
from gleanframe.operators.ranks import positions
from gleanframe.session import materialise


def ownership_chain(levels: Sequence[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """Inner joins from the innermost table up to its owners.

    ``levels`` runs from child to topmost owner as (table, its key, its foreign key to the
    next level).  Sizes decide the join kind; a hot owner is split by adaptive execution.
    """
    out, _, foreign = levels[0]
    for parent, key, next_foreign in levels[1:]:
        out = out.join(parent, ident(foreign) == ident(key))
        foreign = next_foreign
    return out


def entities_with_child(
    parents: DataFrame, key: str, children: DataFrame, foreign: str, exists: bool = True,
) -> DataFrame:
    """Parents that have (or lack) at least one child."""
    child_keys = children.select(ident(foreign).alias("__child")).distinct()
    how = "left_semi" if exists else "left_anti"
    return parents.join(child_keys, ident(key) == F.col("__child"), how)


def count_children(
    parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, object]],
) -> DataFrame:
    """One column per child measure, 0 without children.

    Each child table is aggregated by its foreign key before it meets the parents.
    """
    out = parents
    for name, (table, foreign, measure) in children.items():
        grouped = table.groupBy(ident(foreign).alias(f"__{name}")).agg(measure.alias(name))
        out = out.join(grouped, ident(key) == F.col(f"__{name}"), "left").drop(f"__{name}")
        out = out.withColumn(name, F.coalesce(ident(name), F.lit(0)))
    return out


def threads(
    parents: DataFrame, key: str, children: DataFrame, foreign: str, order: Sequence[str],
) -> DataFrame:
    """Each parent with its children in order, one row per child with its position.

    Rows, not a collected list: one parent may own a large share of all children, so their
    positions come from a distributed sort and the parent's columns by a salted join.
    """
    numbered = positions(children, order, by=[foreign]).withColumnRenamed(foreign, key)
    sizes = children.groupBy(ident(foreign).alias(key)).agg(F.count(F.lit(1)).alias("__n"))
    owners = parents.join(sizes, key).withColumn("__found", F.lit(True))
    return attach(numbered, owners, key, weight="__n").where("__found").drop("__found")


def latest_per_key(
    versions: DataFrame, key: str, number: str, payload: Sequence[str] = (),
) -> DataFrame:
    """(key, number, payload…, versions): the row with the highest version number."""
    top = F.max(F.struct(ident(number), *[ident(c) for c in payload])).alias("top")
    got = versions.groupBy(ident(key)).agg(top, F.count(F.lit(1)).alias("versions"))
    return got.select(
        ident(key), F.col("top")[number].alias(number), *[F.col("top")[c].alias(c) for c in payload],
        "versions",
    )


def resolve_versions(
    versions: DataFrame, key: str, number: str, requested: int, payload: Sequence[str] = (),
) -> DataFrame:
    """The requested version of every key, or its latest where that one is missing."""
    cells = F.struct((ident(number) == requested).alias("asked"), ident(number), *[ident(c) for c in payload])
    got = versions.groupBy(ident(key)).agg(F.max(cells).alias("top"))
    return got.select(ident(key), F.col("top")[number].alias(number), *[F.col("top")[c].alias(c) for c in payload])


def purge_cascade(
    tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str,
) -> dict[str, DataFrame]:
    """Every table without the rows that belong to deleted keys."""
    gone = deleted.select(ident(key).alias("__gone")).distinct()
    return {
        name: table.join(gone, ident(foreign) == F.col("__gone"), "left_anti")
        for name, (table, foreign) in tables.items()
    }


def delete_version(
    versions: DataFrame, key: str, number: str, parent: str, wanted: int,
) -> DataFrame:
    """Drop version ``wanted`` of every key that has another one; its children lose their parent."""
    counts = versions.groupBy(ident(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    sized = versions.join(counts, ident(key).eqNullSafe(F.col("__key")))
    # a version without a number is not the wanted one
    goes = F.coalesce((ident(number) == wanted) & (F.col("__n") > 1), F.lit(False))
    orphan = (ident(parent) == wanted) & (F.col("__n") > 1)
    return sized.where(~goes).select(*[
        F.when(~F.coalesce(orphan, F.lit(False)), ident(c)).alias(c) if c == parent else ident(c)
        for c in versions.columns
    ])


def version_lineage(versions: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth): first ancestor of each version and the number of steps to it.

    Every round doubles the distance covered, so a chain of n versions takes log2(n)
    rounds of one join; a table that needs more has a cycle and is refused.  A row that has
    reached its root takes no part in later rounds, and an ancestor that many rows wait for is
    spread over both sides of the join.
    """
    def ahead(rows: DataFrame, value: str, known: DataFrame) -> DataFrame:
        """``rows`` with the ancestor, if any, that ``known`` (id, …) has for ``value``."""
        wanted = rows.where(ident(value).isNotNull()).groupBy(ident(value).alias("__wanted")).agg(F.count(F.lit(1)).alias("n"))
        # both sides have one row per version
        lookup = known.join(wanted, F.col("__id") == F.col("__wanted")).drop("__wanted")
        return attach(rows, lookup.select(F.col("__id").alias(value), "n", F.col("__id").alias("__met"), *[c for c in known.columns if c != "__id"]), value)

    rows = versions.select(ident(key).alias("id"), ident(parent).alias("up"))
    first = ahead(rows, "up", rows.select(F.col("id").alias("__id"))).select(
        "id", F.coalesce("__met", "id").alias("root"), F.col("__met").isNotNull().cast("bigint").alias("depth"),
        F.col("__met").isNotNull().alias("moved"),
    )
    written = [materialise(first, "lineage")]
    # the last two rounds find nothing to move and nothing that waits
    for _ in range(written[0].count().bit_length() + 2):
        waiting = written[-1].where("moved").drop("moved")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, [w.where("NOT moved") for w in written]).select(F.col("id").alias(key), "root", "depth")
        # only ancestors that are not roots themselves move a row further
        known = reduce(DataFrame.unionByName, [waiting, *[w.where("NOT moved").drop("moved") for w in written]]).where("depth > 0").select(
            F.col("id").alias("__id"), F.col("root").alias("__root"), F.col("depth").alias("__depth")
        )
        written.append(materialise(ahead(waiting, "root", known).select(
            "id", F.coalesce("__root", "root").alias("root"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
            F.col("__met").isNotNull().alias("moved"),
        ), "lineage"))
    raise ValueError("the parents of some versions form a cycle")
