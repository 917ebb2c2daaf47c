"""Keyed tables: upsert, partial update, soft delete, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Per key the row of the highest version; of equal versions the change wins."""
    both = table.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def deleted(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def patched(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of changes that aren't null replace those of the table's rows with that key. changes: one row per key."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = table.join(new, key, "left")
    return out.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def is_active(active: Column, removed: Column) -> Column:
    """The flag of rows that were written before there was one."""
    return F.coalesce(active, ~F.coalesce(removed, F.lit(False)))


def source_changed(url: Column, old_url: Column, selector: Column, old_selector: Column, has_content: Column) -> Column:
    plain = lambda c: F.nullif(F.trim(c), F.lit(""))
    return ~F.coalesce(has_content, F.lit(False)) | ~plain(url).eqNullSafe(plain(old_url)) | ~plain(selector).eqNullSafe(plain(old_selector))


def change_actions(incoming: DataFrame, state: DataFrame, key: str, hash_col: str = "content_hash") -> DataFrame:
    """key and action of each incoming row against the stored hashes: index, reindex, restore (unchanged but inactive) or skip; and delete for stored keys that don't come in."""
    old = state.select(F.col(key).alias("_key"), F.col(hash_col).alias("_hash"), F.col("is_active").alias("_active"))
    both = incoming.select(key, hash_col).join(old, F.col(key) == F.col("_key"), "full_outer")
    action = F.when(F.col(key).isNull(), "delete").when(F.col("_key").isNull(), "index").when(~F.col(hash_col).eqNullSafe(F.col("_hash")), "reindex").when(~F.coalesce("_active", F.lit(True)), "restore").otherwise("skip")
    return both.select(F.coalesce(key, "_key").alias(key), action.alias("action"))


def applied(table: DataFrame, log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """table after a log of bulk_sync, add, update and delete actions, of which the last per key counts; other actions are ignored."""
    known = log.where(F.col("action").isin("bulk_sync", "add", "update", "delete"))
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = known.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kept = table.join(last.select(key), key, "left_anti").select(key, *columns)
    return kept.unionByName(last.where("action <> 'delete'").select(key, *columns))


def update_action(active: Column, url: Column, old_url: Column, selector: Column, old_selector: Column, has_content: Column) -> Column:
    """deactivate, scrape (the source changed or there is no content) or metadata."""
    return F.when(~active, "deactivate").when(source_changed(url, old_url, selector, old_selector, has_content), "scrape").otherwise("metadata")


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """ids with the rows of table that have their key; null keys find nothing."""
    return ids.where(F.col(key).isNotNull()).join(table, key)


def replaced(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of incoming, and those of stored whose key doesn't come in."""
    return deleted(stored, incoming, key).unionByName(incoming)


def config(variables: DataFrame, names: DataFrame, default: str) -> DataFrame:
    """name and content of each name: the value that isn't deleted, else the default. variables: name, content, deleted_at."""
    live = variables.where("deleted_at IS NULL").groupBy("name").agg(F.min("content").alias("content"))
    return names.join(live, "name", "left").select("name", F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.lit(default)).alias("content"))
