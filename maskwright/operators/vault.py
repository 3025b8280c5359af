"""The vault: a table of (key, value, created_at, updated_at) snapshots.

Every operation takes a snapshot and returns a new one; writers publish it by
writing a new table and switching over. Keys are ``kind:id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn

SCHEMA = "key string, value string, created_at long, updated_at long"


def upsert(vault: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """Insert (key, value) rows or update the value of existing keys, whose created_at stays.

    One shuffle on the key; of several rows with one key the largest value wins.
    """
    old = vault.select("key", "value", "created_at", "updated_at", F.lit(0).alias("rank"))
    new = rows.select("key", "value", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(1).alias("rank"))
    return old.unionByName(new).groupBy("key").agg(F.max_by("value", F.struct("rank", "value")).alias("value"), F.min_by("created_at", "rank").alias("created_at"), F.max("updated_at").alias("updated_at"))


def first_references(vault: DataFrame) -> DataFrame:
    """(kind, value, ref_id, key): the oldest reference of each value."""
    parsed = vault.withColumn("ref", fn.parse_key(F.col("key"))).where("ref IS NOT NULL")
    return parsed.groupBy(F.col("ref.kind").alias("kind"), "value").agg(F.min_by("key", F.struct("created_at", "key")).alias("key")).withColumn("ref_id", F.substring_index("key", ":", -1))


def write_values(vault: DataFrame, values: DataFrame, now: int) -> DataFrame:
    """Deduplicating write of (kind, value, ref_id): known values are touched, others get their new row."""
    wanted = values.select("kind", "value", "ref_id").groupBy("kind", "value").agg(F.min("ref_id").alias("new_id"))
    known = first_references(vault).select("kind", "value", F.col("key").alias("old_key"))
    rows = wanted.join(known, ["kind", "value"], "left").select(F.coalesce("old_key", fn.reference_key(F.col("kind"), F.col("new_id"))).alias("key"), "value")
    return upsert(vault, rows, now)


def delete(vault: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows of ``keys`` (column key)."""
    return vault.join(keys.select("key").distinct(), "key", "left_anti").select(*vault.columns)


def deleted(vault: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, existed) for every key asked for."""
    there = vault.select("key", F.lit(True).alias("there"))
    return keys.select("key").distinct().join(there, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("existed"))


def get(vault: DataFrame, key: str | Column) -> DataFrame:
    return vault.where(F.col("key") == key)


def listed(vault: DataFrame) -> DataFrame:
    """The first row, by key, of each (kind, value); rows with keys that are no references all stay. Unsorted."""
    ref = fn.parse_key(F.col("key"))
    marked = vault.withColumn("__kind", ref["kind"])
    first = Window.partitionBy("__kind", "value").orderBy("key")
    known = marked.where("__kind IS NOT NULL").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__kind")
    return known.unionByName(marked.where("__kind IS NULL").drop("__kind"))


def count(vault: DataFrame) -> DataFrame:
    """Rows as stored, duplicates included."""
    return vault.agg(F.count("*").alias("total"))
