"""Batch merges: upserts by key, insert-if-absent, and the vote counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(name: str, *tables: DataFrame) -> str:
    """A name that no column of ``tables`` has or starts with."""
    return "_" * (1 + max((len(c) for t in tables for c in t.columns), default=0)) + name


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` should be unique within a key."""
    r = unused("rank", df)
    return df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(r) == 1).drop(r)


def least_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the least by its other columns in order: the same in every run."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = unused("row", df)
    d = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias(row))
    return d.select(*(F.col(c) if c in keys else F.col(f"{row}.{c}").alias(c) for c in df.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """``rows`` (unique by ``keys``) merged in: new keys are added; of known ones the columns ``update`` (by default all that ``rows`` has) take the new values."""
    given = [c for c in rows.columns if c not in keys]
    update = given if update is None else update
    new, old = unused("new", target, rows), unused("old", target, rows)
    d = target.withColumn(old, F.lit(True)).join(rows.select(*keys, *(F.col(c).alias(f"{new}_{c}") for c in given), F.lit(True).alias(new)), keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys or c not in given:
            return F.col(c)
        if c in update:
            return F.when(F.col(new).isNotNull(), F.col(f"{new}_{c}")).otherwise(F.col(c))
        return F.when(F.col(old).isNull(), F.col(f"{new}_{c}")).otherwise(F.col(c))

    return d.select(*(value(c).alias(c) for c in target.columns))


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those of ``rows`` whose key it lacks, one for each key."""
    return target.unionByName(least_by(rows.select(*target.columns), keys).join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def count_votes(board: DataFrame, votes: DataFrame, as_of: Column) -> DataFrame:
    """The request board after ``votes`` (url, ts): known URLs (in any case) gain votes, new ones enter under their first spelling."""
    key, n, url = (unused(x, board) for x in ("key", "n", "url"))
    new = votes.groupBy(F.lower("url").alias(key)).agg(F.count("*").cast("int").alias(n), F.min_by("url", F.struct("ts", "url")).alias(url))
    d = board.withColumn(key, F.lower("url")).join(new, key, "full_outer")
    values = {"id": F.coalesce("id", F.sha2(key, 256)), "url": F.coalesce("url", url), "vote_count": (F.coalesce("vote_count", F.lit(0)) + F.coalesce(n, F.lit(0))).cast("int"), "status": F.coalesce("status", F.lit("pending")), "updated_at": F.when(F.col(n).isNotNull(), as_of).otherwise(F.col("updated_at")), "created_at": F.coalesce("created_at", as_of)}
    return d.select(*(values[c].alias(c) if c in values else F.col(c) for c in board.columns))


def cascade(child: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """``child`` without rows whose parent is gone (a null reference stays)."""
    kept = child.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return kept.select(*child.columns).unionByName(child.filter(F.col(column).isNull()))


def set_null(child: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """``child`` with a null reference where the parent is gone."""
    known = unused("known", child)
    p = parents.select(F.col(key).alias(column)).distinct().withColumn(known, F.lit(True))
    return child.join(p, column, "left").select(*(F.when(F.col(known), F.col(c)).alias(c) if c == column else F.col(c) for c in child.columns))
