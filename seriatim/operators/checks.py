"""Data checks in place of a database's constraints, and row-level access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[Column], name: str = "n") -> DataFrame:
    """Keys that more than one row has; rows with a null in the key never collide."""
    d = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    return d.dropna().groupBy(*d.columns).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def orphans(child: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``child`` whose parent is missing."""
    return child.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def out_of_range(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions with a weekday beyond 0 to 6 or an hour beyond 0 to 23."""
    return subscriptions.filter(~F.coalesce(F.col("preferred_day").between(0, 6), F.lit(True)) | ~F.coalesce(F.col("preferred_hour").between(0, 23), F.lit(True)))


def not_in(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(allowed))


def own_rows(df: DataFrame, owner: str, user: Column) -> DataFrame:
    """Rows that ``user`` may see and change."""
    return df.filter(F.col(owner) == user)


def may_insert_request(user: Column) -> Column:
    """Requests are public to read; only a signed-in user adds one by hand."""
    return user.isNotNull()


def already_subscribed(requests: DataFrame, subscriptions: DataFrame, active_only: bool) -> DataFrame:
    """``requests`` (subscriber_id, feed_id) that have a subscription, running ones only or in any state."""
    s = subscriptions.filter("is_active") if active_only else subscriptions
    return requests.join(s.select("subscriber_id", "feed_id"), ["subscriber_id", "feed_id"], "left_semi")
