"""Joins that stand for lookups, keys and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_child(children: DataFrame, parent: str, order: list[str], value: str, into: str) -> DataFrame:
    """One row per parent: the value of its latest child; a single aggregate, without a sort."""
    return children.groupBy(parent).agg(F.max_by(value, F.struct(*order)).alias(into))


def with_latest(parents: DataFrame, children: DataFrame, parent: str, order: list[str], value: str, into: str) -> DataFrame:
    """Every parent with its latest child's value, empty when there is none."""
    return parents.join(latest_child(children, parent, order, value, into), parent, "left").withColumn(into, F.coalesce(into, F.lit("")))


def name_or(rows: DataFrame, names: DataFrame, key: str, name: str, fallback: str, into: str) -> DataFrame:
    """The name behind a key, else the fallback column."""
    return rows.join(names.select(key, name), key, "left").withColumn(into, F.coalesce(name, F.col(fallback))).drop(name)


def resolve_alias(rows: DataFrame, value: str, catalogue: DataFrame, canonical: str, aliases: str, catch_all: str, into: str) -> DataFrame:
    """Canonical names: an exact name first, then an alias, else the catch-all.

    The catalogue becomes one row per spelling, so the lookup is an equi-join.
    """
    names = catalogue.select(F.col(canonical).alias("__name"), F.col(canonical).alias("__spelling"), F.lit(0).alias("__rank"))
    others = catalogue.select(F.col(canonical).alias("__name"), F.explode(aliases).alias("__spelling"), F.lit(1).alias("__rank"))
    best = names.union(others).groupBy("__spelling").agg(F.min(F.struct("__rank", "__name")).alias("__best"))
    return rows.join(best, rows[value] == best["__spelling"], "left").withColumn(into, F.coalesce(F.col("__best.__name"), F.lit(catch_all))).drop("__spelling", "__best")


def same_content(left: DataFrame, right: DataFrame, content: str, *, keep: str) -> DataFrame:
    """``left`` rows whose content occurs in ``right``: hashes narrow, equality decides.

    The right side is reduced to one row per hash and text before the join.
    """
    r = right.select(F.md5(content).alias("__h2"), F.col(content).alias("__c"), F.col(keep).alias("__k")).groupBy("__h2", "__c").agg(F.min("__k").alias("match_id"))
    return left.withColumn("__h", F.md5(content)).join(r, (F.col("__h") == F.col("__h2")) & (F.col(content) == F.col("__c"))).drop("__h", "__h2", "__c")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows with a key that no parent has; null keys are no violation."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """A row per constraint with its number of violations."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_null_links(rows: DataFrame, link: str, source: DataFrame, on: str, value: str) -> DataFrame:
    """Set ``link`` from ``source`` where it is null; other links stay."""
    return rows.join(source.select(on, F.col(value).alias("__new")), on, "left").withColumn(link, F.coalesce(link, "__new")).drop("__new")


def unchanged(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``before`` whose content is the same in ``after``, told by a hash of all columns."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("__h"))
    same = digest(before).join(digest(after), [key, "__h"]).select(key)
    return before.join(same, key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, replace: bool = True) -> DataFrame:
    """Insert or replace, or insert or ignore; both are one anti join."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti")) if replace else old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def cascade(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent survives."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def nulled_references(rows: DataFrame, key: str, reference: str) -> DataFrame:
    """Self references to rows that are gone become null."""
    alive = rows.select(F.col(key).alias(reference), F.lit(True).alias("__alive"))
    return rows.join(alive, reference, "left").withColumn(reference, F.when(F.col("__alive"), F.col(reference))).drop("__alive")


def flagged(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
