"""Laid-out pages as relational operators over raw blocks (page_number, text, x0, y0, x1, y1, font_size, is_bold, page_width, page_height)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import text as T


def line_blocks(spans: DataFrame, *, gap: float = 45.0) -> DataFrame:
    """Spans of a line (columns doc_id, page_number, line, x0, x1, y0, y1, text, font_size, is_bold) joined up to gaps that are wider than gap."""
    w = Window.partitionBy("doc_id", "page_number", "line").orderBy("x0", "x1")
    new = F.when(F.col("x0") - F.lag("x1").over(w) > gap, 1).otherwise(0)
    parts = spans.withColumn("part", F.sum(new).over(w))
    return parts.groupBy("doc_id", "page_number", "line", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"), (F.avg(F.col("is_bold").cast("int")) >= 0.5).alias("is_bold"),
    )


def median_fonts(raw: DataFrame, by: list[str]) -> DataFrame:
    return raw.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(11.0)).alias("median_font"))


def _covered(t: Callable[[str], Column], share: float) -> Column:
    """Whether share of a block's area or more lies in the box whose sides t gives."""
    width = F.greatest(F.lit(0.0), F.least(F.col("x1"), t("x1")) - F.greatest(F.col("x0"), t("x0")))
    height = F.greatest(F.lit(0.0), F.least(F.col("y1"), t("y1")) - F.greatest(F.col("y0"), t("y0")))
    return width * height / F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-9)) >= share


def without_tables(raw: DataFrame, tables: DataFrame, by: list[str], *, share: float = 0.3) -> DataFrame:
    """Blocks of which less than share of the area lies in any table's box of the page: an anti-join on the page and the overlap."""
    t = tables.select(*by, *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    same = [raw[b] == t[b] for b in by]
    return raw.join(t, [*same, _covered(lambda c: F.col(f"t_{c}"), share)], "left_anti")


def _in_margin() -> Column:
    return (F.col("y0") <= 0.08 * F.col("page_height")) | (F.col("y1") >= 0.94 * F.col("page_height"))


def _repeats(n: Column, pages: Column) -> Column:
    return (pages >= 2) & (n >= F.greatest(F.lit(2), F.floor(0.5 * pages)))


def repeated_noise(raw: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc and key of texts that stand in the margins of half the pages or more, and of two at least."""
    keyed = raw.withColumn("key", T.noise_key(F.col("text")))
    pages = raw.groupBy(doc).agg(F.countDistinct("page_number").alias("pages")).where("pages >= 2")
    seen = keyed.where(_in_margin() & (F.length("key") >= 4)).groupBy(doc, "key").agg(F.countDistinct("page_number").alias("n"))
    return seen.join(pages, doc).where(_repeats(F.col("n"), F.col("pages"))).select(doc, "key")


def without_noise(raw: DataFrame, doc: str = "doc_id") -> DataFrame:
    noise = repeated_noise(raw, doc).withColumnRenamed("key", "_key").withColumnRenamed(doc, "_doc")
    return raw.join(noise, (F.col(doc) == F.col("_doc")) & (T.noise_key(F.col("text")) == F.col("_key")), "left_anti")


def _side() -> Column:
    left = F.col("x1") < 0.55 * F.col("page_width")
    return F.when(F.col("x0") < 0.42 * F.col("page_width"), F.when(left, "l")).when(F.col("x0") > 0.45 * F.col("page_width"), "r")


def _column_stats() -> dict[str, Column]:
    """Aggregates over a page of blocks with their side."""
    left, right = F.col("side") == "l", F.col("side") == "r"
    return {"n": F.count("*"), "nl": F.count_if(left), "nr": F.count_if(right), "ml": F.median(F.when(left, F.col("x1"))), "mr": F.median(F.when(right, F.col("x0")))}


def _two(c: Callable[[str], Column], beside: Column) -> Column:
    return F.coalesce((c("n") >= 4) & (c("nl") >= 2) & (c("nr") >= 2) & (c("mr") - c("ml") >= 35) & F.coalesce(beside, F.lit(False)), F.lit(False))


def _level(ly0: Column, ly1: Column, y0: Column, y1: Column) -> Column:
    """Whether two blocks are side by side."""
    return ((ly0 < y1) & (y0 < ly1)) | (F.abs(ly0 - y0) < 18)


def columns_of(raw: DataFrame, by: list[str]) -> DataFrame:
    """by and two_columns: four blocks or more, two on each side, an opened gap of 35 between the medians, and a pair side by side."""
    s = raw.withColumn("side", _side())
    stats = s.groupBy(*by).agg(*(v.alias(k) for k, v in _column_stats().items()))
    a = s.where("side = 'l'").select(*by, F.col("y0").alias("ly0"), F.col("y1").alias("ly1"))
    b = s.where("side = 'r'").select(*by, "y0", "y1")
    beside = a.join(b, by).where(_level(F.col("ly0"), F.col("ly1"), F.col("y0"), F.col("y1"))).select(*by).distinct().withColumn("beside", F.lit(True))
    return stats.join(beside, by, "left").select(*by, _two(F.col, F.col("beside")).alias("two_columns"))


def reading_order(raw: DataFrame, by: list[str], two_columns: Column) -> DataFrame:
    """raw with block_order: by column where there are two, then by lines of 4 units, then from the left."""
    column = F.when(two_columns & ((F.col("x0") + F.col("x1")) / 2 > F.col("page_width") / 2), 1).otherwise(0)
    return raw.withColumn("block_order", F.row_number().over(Window.partitionBy(*by).orderBy(column, F.bround(F.col("y0") / 4) * 4, "x0", "y0")) - 1)


def needs_ocr(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by and needs_ocr: too little text, too few letters, or mostly splinters."""
    n = F.length(F.trim("text"))
    a = blocks.groupBy(*by).agg(F.count("text").alias("n"), F.sum(n).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"\p{L}"))).alias("letters"), F.avg((n <= 3).cast("int")).alias("splinters"), F.avg(F.size(T.words_of(F.trim("text")))).alias("words"))
    bad = (F.coalesce("chars", F.lit(0)) < 20) | (F.coalesce("letters", F.lit(0)) < 12) | (F.col("n") == 0) | ((F.col("n") >= 3) & (F.col("splinters") >= 0.6)) | ((F.col("n") >= 6) & (F.col("words") < 2))
    return a.select(*by, bad.alias("needs_ocr"))


_LIST = r"^(\d+[.)]|[-*]|[a-zA-Z][.)])\s+"


def _typed(own: DataFrame, heading: Column, by: str) -> DataFrame:
    """own (text, block_order) with block_type and heading_text, the last heading of the document up to there."""
    kind = F.when(heading, "heading").when(F.col("text").rlike(_LIST), "list_item").otherwise("paragraph")
    last = F.last(F.when(heading, F.col("text")), ignorenulls=True).over(Window.partitionBy(by).orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumns({"block_type": kind, "heading_text": F.coalesce(last, F.lit(""))})


def scan(raw: DataFrame, tables: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Raw blocks of laid-out pages as blocks of their documents, in reading order over all pages, without repeated margins and tables."""
    by = [doc, "page_number"]
    boxes = tables.select(*by, F.struct("x0", "y0", "x1", "y1").alias("_box"))
    own = raw.withColumn("_box", F.lit(None).cast(boxes.schema["_box"].dataType)).unionByName(boxes, allowMissingColumns=True)
    # one shuffle, by document: the rest is windows over its pages and texts; sorts are in an order that serves the next ones
    own = own.where(F.col(doc).isNotNull() & F.col("page_number").isNotNull()).repartition(doc)
    page, whole, alike = Window.partitionBy(*by), Window.partitionBy(doc), Window.partitionBy(doc, "_key")
    own = own.withColumn("_first", F.row_number().over(page.orderBy(F.col("_box").isNotNull())) == 1)
    own = own.withColumn("_boxes", F.collect_list("_box").over(page)).where("_box IS NULL")
    own = own.withColumn("_pages", F.count_if("_first").over(whole)).withColumn("_key", T.noise_key(F.col("text")))
    # repeated margins are told from all blocks, those in tables too
    seen = F.coalesce(_in_margin() & (F.length("_key") >= 4), F.lit(False))
    own = own.withColumn("_seen", seen).withColumn("_once", F.col("_seen") & (F.row_number().over(Window.partitionBy(doc, "_key", "page_number").orderBy(F.desc("_seen"))) == 1))
    own = own.withColumn("_n", F.count_if("_once").over(alike)).where(F.col("_key").isNull() | ~_repeats(F.col("_n"), F.col("_pages")))
    own = own.where(~F.coalesce(F.exists("_boxes", lambda b: _covered(lambda c: b[c], 0.3)), F.lit(False)))
    own = own.drop("_box", "_boxes", "_first", "_pages", "_key", "_seen", "_once", "_n").withColumn("raw_text", F.col("text")).withColumn("text", T.squeezed(F.col("text")))
    # the columns are told from the blocks that are left; blank ones count, but give no block
    own = own.withColumn("side", _side())
    rights = F.collect_list(F.when(F.col("side") == "r", F.struct("y0", "y1"))).over(page)
    stats = {f"_{k}": v.over(page) for k, v in _column_stats().items()}
    own = own.withColumns(stats | {"_rights": rights, "median_font": F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(page), F.lit(11.0))})
    own = own.withColumn("_beside", F.max(F.when(F.col("side") == "l", F.exists("_rights", lambda r: _level(F.col("y0"), F.col("y1"), r["y0"], r["y1"])))).over(page))
    own = own.withColumn("two_columns", _two(lambda c: F.col(f"_{c}"), F.col("_beside"))).drop("side", "_rights", "_beside", *stats).where("text <> ''")
    column = F.when(F.col("two_columns") & ((F.col("x0") + F.col("x1")) / 2 > F.col("page_width") / 2), 1).otherwise(0)
    order = Window.partitionBy(doc).orderBy("page_number", column, F.bround(F.col("y0") / 4) * 4, "x0", "y0")
    own = own.withColumn("block_order", F.row_number().over(order) - 1)
    return _typed(own, T.layout_heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("median_font")), doc)


def text_blocks(pages: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """by, block_order, text, block_type and heading_text of each paragraph of read pages."""
    parts = pages.select(by, F.posexplode(F.split(text_col, r"\n\s*\n+")).alias("i", "part")).select(by, "i", T.squeezed(F.col("part")).alias("text")).where("text <> ''")
    own = parts.withColumn("block_order", F.row_number().over(Window.partitionBy(by).orderBy("i")) - 1).drop("i")
    letters, upper = F.regexp_count("text", F.lit(r"\p{L}")), F.regexp_count("text", F.lit(r"\p{Lu}"))
    heading = F.col("text").rlike(r"(?i)^(bab|bagian|pasal)([^\p{L}\p{N}_]|$)") | ((letters >= 4) & (upper >= 0.72 * letters) & (F.size(F.split("text", " ")) <= 12))
    return _typed(own, heading, by)
