"""Expansion of hits by their parents and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import text as T


def sibling_links(children: DataFrame, parent: str = "parent_chunk_id", order: str = "ordinal", chunk: str = "chunk_id") -> DataFrame:
    """window_prev_id and window_next_id within each parent."""
    w = Window.partitionBy(parent).orderBy(order)
    return children.withColumn("window_prev_id", F.lag(chunk).over(w)).withColumn("window_next_id", F.lead(chunk).over(w))


#: What is looked up for a hit, and the column with its id.
_SPOTS = {"parent": "parent_chunk_id", "prev": "window_prev_id", "next": "window_next_id"}


def _with_neighbours(hits: DataFrame, chunks: DataFrame, by: str | None) -> DataFrame:
    """hits with text and parent of the parent, the previous and the next chunk: three equi-joins on ids, or, if hits and chunks have the document by, one shuffle by it.

    Within a document an id is looked up by a window over all that have it, chunk or reference; then each hit's references come together again.
    """
    if by is None:
        look = chunks.select("chunk_id", "text", "parent_chunk_id")
        for name, key in _SPOTS.items():
            side = look.select(F.col("chunk_id").alias(f"{name}_key"), F.col("text").alias(f"{name}_text"), F.col("parent_chunk_id").alias(f"{name}_of"))
            hits = hits.join(side, F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
        return hits
    own = hits.withColumn("_hit", F.monotonically_increasing_id())
    none = F.lit(None)
    row = F.struct(*hits.columns)
    asked = [F.struct(F.lit(0).alias("spot"), none.cast("string").alias("key"), row.alias("row"))]
    asked += [F.struct(F.lit(i).alias("spot"), F.col(key).cast("string").alias("key"), F.when(F.lit(False), row).alias("row")) for i, key in enumerate(_SPOTS.values(), 1)]
    refs = own.select(F.col(by).alias("_by"), "_hit", F.inline(F.array(*asked))).where("spot = 0 OR key IS NOT NULL").withColumn("found", none.cast("struct<text:string,of:string>"))
    there = chunks.select(F.col(by).alias("_by"), none.cast("long").alias("_hit"), none.cast("int").alias("spot"), F.col("chunk_id").alias("key"), none.cast(refs.schema["row"].dataType).alias("row"), F.struct("text", F.col("parent_chunk_id").alias("of")).alias("found"))
    met = refs.unionByName(there).repartition("_by").withColumn("found", F.first("found", ignorenulls=True).over(Window.partitionBy("_by", "key"))).where("spot IS NOT NULL")
    out = met.groupBy("_by", "_hit").agg(F.first("row", ignorenulls=True).alias("row"), *(F.first(F.when(F.col("spot") == i, F.col("found")), ignorenulls=True).alias(name) for i, name in enumerate(_SPOTS, 1)))
    return out.select("row.*", *(F.col(f"{name}.{what}").alias(f"{name}_{what}") for name in _SPOTS for what in ("text", "of")))


def document_context(hits: DataFrame, chunks: DataFrame, by: str | None = None) -> DataFrame:
    """hits with context: the parent's text if there is any, else the chunk with those neighbours that share its parent; a chunk that ends open goes with the next one alone. by: the document that both have and that a chunk shares with its neighbours."""
    out = _with_neighbours(hits, chunks, by)
    same = lambda n: F.when(F.col("parent_chunk_id").isNotNull() & (F.col(f"{n}_of") == F.col("parent_chunk_id")), F.nullif(F.trim(F.col(f"{n}_text")), F.lit("")))
    open_end = F.rlike(F.trim(F.col("text")), F.lit("[:,—-]$"))
    beside = F.when(open_end & same("next").isNotNull(), F.concat_ws("\n\n", "text", same("next"))).otherwise(F.concat_ws("\n\n", same("prev"), F.col("text"), same("next")))
    parent = F.nullif(F.trim(F.col("parent_text")), F.lit(""))
    return out.withColumn("context", T.display(F.coalesce(parent, beside))).select(*hits.columns, "context")


def web_context(hits: DataFrame, chunks: DataFrame, by: str | None = None, *, short: int = 420) -> DataFrame:
    """hits with context: for a short chunk the parent's text, else the chunk with both neighbours, whatever their parents."""
    out = _with_neighbours(hits, chunks, by)
    parent = F.nullif(F.trim(F.col("parent_text")), F.lit(""))
    beside = F.concat_ws("\n\n", F.nullif(F.col("prev_text"), F.lit("")), "text", F.nullif(F.col("next_text"), F.lit("")))
    return out.withColumn("context", F.when(parent.isNotNull() & (F.length("text") < short), parent).otherwise(beside)).select(*hits.columns, "context")
