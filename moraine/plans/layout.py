"""Laid-out pages. The raw blocks are the documents' lines, put on pages of twelve by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators import layout
from moraine.plans.registry import query, table

_RAW = """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS n FROM documents),
raw AS (SELECT doc_id, n, n // 12 + 1 AS page_number, CASE WHEN n % 12 = 0 THEN 'Halaman ' || (n // 12) ELSE text END AS text, CASE WHEN n % 12 >= 6 THEN 320.0 ELSE 40.0 END::DOUBLE AS x0,
  (20 + (n % 12 % 6) * 130)::DOUBLE AS y0, CASE WHEN n % 12 >= 6 THEN 560.0 ELSE 40 + least(length(text), 40) * 6.0 END::DOUBLE AS x1, (32 + (n % 12 % 6) * 130)::DOUBLE AS y1,
  CASE WHEN length(text) < 60 THEN 20.0 ELSE 11.0 END::DOUBLE AS font_size, length(text) < 80 AS is_bold, 595.0::DOUBLE AS page_width, 842.0::DOUBLE AS page_height FROM lines)"""


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    right, row, size = F.col("n") % 12 >= 6, F.col("n") % 12 % 6, F.length("line")
    return d.select(
        "doc_id", "n", F.expr("cast(n div 12 + 1 AS int)").alias("page_number"), F.when(F.col("n") % 12 == 0, F.concat(F.lit("Halaman "), F.expr("n div 12").cast("string"))).otherwise(F.col("line")).alias("text"),
        F.when(right, 320.0).otherwise(40.0).alias("x0"), (20 + row * 130).cast("double").alias("y0"), F.when(right, 560.0).otherwise(40 + F.least(size, F.lit(40)) * 6.0).alias("x1"), (32 + row * 130).cast("double").alias("y1"),
        F.when(size < 60, 20.0).otherwise(11.0).alias("font_size"), (size < 80).alias("is_bold"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"),
    )


_PAGE = ["doc_id", "page_number"]


@query(_RAW + " SELECT doc_id, page_number, coalesce(median(CASE WHEN font_size > 0 THEN font_size END), 11.0) AS median_font FROM raw GROUP BY doc_id, page_number")
def page_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.median_fonts(raw_blocks(spark, sf_dir), _PAGE)


_OFFICIAL = r"'(?i)^(bab|bagian|pasal)([^\p{L}\p{N}_]|$)'"
_WORDS = r"len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> ''))"


@query(_RAW + rf""", fonts AS (SELECT doc_id, page_number, coalesce(median(CASE WHEN font_size > 0 THEN font_size END), 11.0) AS m FROM raw GROUP BY doc_id, page_number)
SELECT r.doc_id, n, (length(trim(text)) > 0 AND length(trim(text)) <= 140 AND (regexp_matches(trim(text), {_OFFICIAL}) OR (NOT regexp_matches(trim(text), '[.?!;]$')
  AND ((font_size >= greatest(14.0, 1.35 * m) AND {_WORDS} <= 14) OR (is_bold AND {_WORDS} <= 12 AND NOT regexp_matches(trim(text), '^(\d+[.)]|[-*]|[a-zA-Z][.)])\s+')))))) AS heading
FROM raw r JOIN fonts f ON f.doc_id = r.doc_id AND f.page_number = r.page_number""")
def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by font, weight and words."""
    raw = raw_blocks(spark, sf_dir)
    own = raw.join(layout.median_fonts(raw, _PAGE), _PAGE)
    return own.select("doc_id", "n", T.layout_heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("median_font")).alias("heading"))


_NOISE = r""", keyed AS (SELECT *, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '\d+', '#', 'g') AS key FROM raw),
pages AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM raw GROUP BY doc_id HAVING count(DISTINCT page_number) >= 2),
noise AS (SELECT k.doc_id, key FROM keyed k JOIN pages p ON p.doc_id = k.doc_id WHERE (y0 <= 0.08 * page_height OR y1 >= 0.94 * page_height) AND length(key) >= 4
  GROUP BY k.doc_id, key, pages HAVING count(DISTINCT page_number) >= greatest(2, floor(0.5 * pages)))"""


@query(_RAW + _NOISE + " SELECT doc_id, n FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM noise x WHERE x.doc_id = k.doc_id AND x.key = k.key)")
def without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without what repeats in the margins."""
    return layout.without_noise(raw_blocks(spark, sf_dir)).select("doc_id", "n")


@query(_RAW + """, boxes AS (SELECT doc_id, page_number, 30.0 AS tx0, 140.0 AS ty0, 300.0 AS tx1, 300.0 AS ty1 FROM raw GROUP BY doc_id, page_number)
SELECT r.doc_id, n FROM raw r JOIN boxes b ON b.doc_id = r.doc_id AND b.page_number = r.page_number
WHERE NOT (greatest(0.0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0.0, least(y1, ty1) - greatest(y0, ty0)) / greatest((x1 - x0) * (y1 - y0), 1e-9) >= 0.3)""")
def without_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that don't lie in a table; each page has one box."""
    raw = raw_blocks(spark, sf_dir)
    boxes = raw.select(*_PAGE).distinct().select(*_PAGE, F.lit(30.0).alias("x0"), F.lit(140.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(300.0).alias("y1"))
    return layout.without_tables(raw, boxes, _PAGE).select("doc_id", "n")


_COLUMNS = """, sided AS (SELECT *, CASE WHEN x0 < 0.42 * page_width THEN CASE WHEN x1 < 0.55 * page_width THEN 'l' END WHEN x0 > 0.45 * page_width THEN 'r' END AS side FROM raw),
stats AS (SELECT doc_id, page_number, count(*) AS n, count(*) FILTER (WHERE side = 'l') AS nl, count(*) FILTER (WHERE side = 'r') AS nr, median(CASE WHEN side = 'l' THEN x1 END) AS ml, median(CASE WHEN side = 'r' THEN x0 END) AS mr FROM sided GROUP BY doc_id, page_number),
beside AS (SELECT DISTINCT a.doc_id, a.page_number FROM sided a JOIN sided b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.side = 'l' AND b.side = 'r' WHERE (a.y0 < b.y1 AND b.y0 < a.y1) OR abs(a.y0 - b.y0) < 18),
two AS (SELECT s.doc_id, s.page_number, coalesce(n >= 4 AND nl >= 2 AND nr >= 2 AND mr - ml >= 35 AND b.doc_id IS NOT NULL, false) AS two_columns FROM stats s LEFT JOIN beside b ON b.doc_id = s.doc_id AND b.page_number = s.page_number)"""


@query(_RAW + _COLUMNS + """ SELECT r.doc_id, n, two_columns, (row_number() OVER (PARTITION BY r.doc_id, r.page_number ORDER BY CASE WHEN two_columns AND (x0 + x1) / 2 > page_width / 2 THEN 1 ELSE 0 END, round_even(y0 / 4, 0) * 4, x0, y0) - 1)::INTEGER AS block_order
FROM raw r JOIN two t ON t.doc_id = r.doc_id AND t.page_number = r.page_number""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in the order in which they are read, by columns where there are two."""
    raw = raw_blocks(spark, sf_dir)
    own = raw.join(layout.columns_of(raw, _PAGE), _PAGE)
    return layout.reading_order(own, _PAGE, F.col("two_columns")).select("doc_id", "n", "two_columns", "block_order")


@query(_RAW + rf""" SELECT doc_id, page_number, (coalesce(sum(length(trim(text))), 0) < 20 OR coalesce(sum(len(regexp_extract_all(text, '\p{{L}}'))), 0) < 12 OR count(text) = 0
  OR (count(text) >= 3 AND avg((length(trim(text)) <= 3)::INTEGER) >= 0.6) OR (count(text) >= 6 AND avg({_WORDS}) < 2)) AS needs_ocr FROM raw GROUP BY doc_id, page_number""")
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text is too little or too broken."""
    return layout.needs_ocr(raw_blocks(spark, sf_dir), _PAGE)


@query(r"""WITH words AS (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS text, generate_subscripts(list_filter(string_split(text, ' '), lambda w: w <> ''), 1)::INTEGER - 1 AS i FROM documents),
spans AS (SELECT doc_id, i // 400 + 1 AS page_number, i // 10 AS line, ((i % 10) * 60 + CASE WHEN i % 10 >= 5 THEN 50 ELSE 0 END)::DOUBLE AS x0, text, length(text) > 6 AS is_bold FROM words),
ended AS (SELECT *, x0 + 55 AS x1 FROM spans), marked AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, x1) > 45 THEN 1 ELSE 0 END AS new FROM ended),
parts AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, x1) AS part FROM marked)
SELECT doc_id, page_number, line, part::BIGINT AS part, string_agg(text, ' ' ORDER BY x0, x1, text) AS text, min(x0) AS x0, max(x1) AS x1, avg(is_bold::INTEGER) >= 0.5 AS is_bold FROM parts GROUP BY doc_id, page_number, line, part""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line joined up to wide gaps; ten words are a line, with a gap after five."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("i", "text"))
    x0 = ((F.col("i") % 10) * 60 + F.when(F.col("i") % 10 >= 5, 50).otherwise(0)).cast("double")
    spans = words.select("doc_id", F.expr("cast(i div 400 + 1 AS int)").alias("page_number"), F.expr("cast(i div 10 AS int)").alias("line"), x0.alias("x0"), (x0 + 55).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), "text", F.lit(11.0).alias("font_size"), (F.length("text") > 6).alias("is_bold"))
    return layout.line_blocks(spans).select("doc_id", "page_number", "line", "part", "text", "x0", "x1", "is_bold")
