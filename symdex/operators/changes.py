"""Differences between versions of an index, and how they are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "chunk_id", digest: str = "content_hash") -> DataFrame:
    """(key, status): added, updated, unchanged or deleted."""
    a, b = old.select(key, F.col(digest).alias("__a"), F.lit(1).alias("__o")), new.select(key, F.col(digest).alias("__b"), F.lit(1).alias("__n"))
    status = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def file_diff(indexed: DataFrame, current: DataFrame, changed: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, status) of distinct files: deleted (only indexed), added (only current), modified (in both and changed)."""
    i, c, m = (x.select(key).distinct() for x in (indexed, current, changed))
    gone = i.join(c, key, "left_anti").withColumn("status", F.lit("deleted"))
    new = c.join(i, key, "left_anti").withColumn("status", F.lit("added"))
    edited = m.join(c, key, "left_semi").join(i, key, "left_semi").withColumn("status", F.lit("modified"))
    return gone.unionByName(new).unionByName(edited)


def changed_since(files: DataFrame, time_col: str, since: Column) -> DataFrame:
    return files.where(F.col(time_col) > since)


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new put in the place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def with_collision_ids(df: DataFrame, base: Column, group: Column, order: list[Column], line: Column) -> DataFrame:
    """df with chunk_id: base, and `:line` after it from the second row on that has the same base."""
    n = F.row_number().over(Window.partitionBy(group, base).orderBy(*order))
    return df.withColumn("chunk_id", F.when(n > 1, F.concat_ws(":", base, line.cast("string"))).otherwise(base))


def islands(df: DataFrame, key: str, order: list, compound: Column) -> DataFrame:
    """df with (block, blocks): runs of simple rows are one block, each compound row is one of its own; numbers from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    start = df.withColumn("__c", compound).withColumn("__s", (F.col("__c") | F.coalesce(F.lag("__c").over(w), F.lit(True))).cast("int"))
    numbered = start.withColumn("block", (F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return numbered.withColumn("blocks", (F.max("block").over(Window.partitionBy(key)) + 1).cast("int")).drop("__c", "__s")


def to_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as flat rows: imports as a JSON array, '' for a parent or docstring that is null."""
    empty = F.array().cast("array<string>")
    flat = {"imports": F.to_json(F.coalesce("imports", empty)), "parent_class": F.coalesce("parent_class", F.lit("")), "docstring": F.coalesce("docstring", F.lit(""))}
    return chunks.withColumns(flat)


def from_rows(rows: DataFrame) -> DataFrame:
    """Chunks from flat rows, null for '' and an empty list for no or broken imports."""
    empty = F.array().cast("array<string>")
    made = {"imports": F.coalesce(F.from_json("imports", "array<string>"), empty), "parent_class": F.nullif(F.col("parent_class"), F.lit("")), "docstring": F.nullif(F.col("docstring"), F.lit(""))}
    return rows.withColumns(made)
