"""Web pages: what is read off the raw page by expressions, and what the parser reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators.knowledge import unescaped
from moraine.plans.registry import query, table
from moraine.sources import files, html

_PLAIN = r"nullif(trim(regexp_replace(regexp_replace({}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '')"
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SELECT page_id, coalesce(" + ", ".join(_PLAIN.format(f"regexp_extract(html, '{p}', 1)") for p in (
    "(?is)<title[^>]*>(.*?)</title>", """(?i)<meta[^>]+property=["'']og:title["''][^>]+content=["'']([^"'']*)["'']""", "(?is)<h1[^>]*>(.*?)</h1>")) + ") AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query(f"""SELECT page_id, regexp_replace(replace(replace(replace({_STRIP}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS content FROM pages""")
def fallback_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text where no parser can be used."""
    return unescaped(table(spark, sf_dir, "pages").select("page_id", T.stripped_html(F.col("html")).alias("content")), "content")


@query(r"""SELECT page_id, (length(""" + _STRIP + r""") < 300 OR regexp_matches(html, '(?i)<(div|section)\s[^>]*(class|id)=["''][^"'']*\b(__next|__nuxt|app|root|vue-app)\b')
  OR (regexp_matches(html, '(?i)<script[^>]+src=["''][^"'']*\b(app|bundle|chunk|main|vendor)\b[^"'']*\.js') AND length(""" + _STRIP + r""") < 600)
  OR regexp_matches(lower(regexp_extract(html, '(?i)<meta[^>]+name=["'']generator["''][^>]+content=["'']([^"'']+)["'']', 1)), 'angular|create react app|gatsby|next\.js|nuxt|vite')) AS needs_js FROM pages""")
def needs_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a browser has to render."""
    p = table(spark, sf_dir, "pages").withColumn("n", F.length(T.stripped_html(F.col("html"))))
    return p.select("page_id", T.needs_rendering(F.col("html"), F.col("n")).alias("needs_js"))


@query(r"""SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain,
  greatest(0, 2.0 * (row_number() OVER (PARTITION BY regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) ORDER BY page_id) - 1))::DOUBLE AS start_after FROM pages""")
def fetch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page may be fetched if a domain is asked once in two seconds."""
    p = table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))
    n = F.row_number().over(Window.partitionBy("domain").orderBy("page_id"))
    return p.select("page_id", "domain", (2.0 * (n - 1)).alias("start_after"))


@query("""WITH forms AS (SELECT page_id, unnest([{'i': 'web:' || page_id, 'u': url, 't': ''}, {'i': '', 'u': url, 't': ''}, {'i': '', 'u': 'sql://rag_text/' || page_id, 't': ''}, {'i': '', 'u': 'document://' || page_id, 't': ''}, {'i': '', 'u': '', 't': 'a.PDF'}, {'i': '', 'u': '', 't': url}, {'i': 'x', 'u': '', 't': 'plain'}]) AS f FROM pages)
SELECT page_id, f.i AS i, f.u AS u, f.t AS t, CASE WHEN regexp_extract(f.i, '^(web|document|text):', 1) <> '' THEN regexp_extract(f.i, '^(web|document|text):', 1)
  WHEN contains(f.u, 'sql://rag_text') THEN 'text' WHEN contains(f.u, 'document://') THEN 'document' WHEN starts_with(f.u, 'http') OR contains(f.u, 'web://') THEN 'web'
  WHEN regexp_matches(f.t, '(?i)\\.(docx?|jpg|pdf|png|pptx?|txt|xlsx?)$') THEN 'document' WHEN regexp_matches(f.t, '^https?://') THEN 'web' ELSE 'unknown' END AS source FROM forms""")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reference is from, by its id, its address, or its title."""
    no = F.lit("")
    form = lambda i, u, t: F.struct(i.alias("i"), u.alias("u"), t.alias("t"))
    ident, url = F.col("page_id").cast("string"), F.col("url")
    forms = F.array(form(F.concat(F.lit("web:"), ident), url, no), form(no, url, no), form(no, F.concat(F.lit("sql://rag_text/"), ident), no), form(no, F.concat(F.lit("document://"), ident), no), form(no, no, F.lit("a.PDF")), form(no, no, url), form(F.lit("x"), no, F.lit("plain")))
    p = table(spark, sf_dir, "pages").select("page_id", F.inline(forms))
    return p.select("page_id", "i", "u", "t", T.source_type(F.col("i"), F.col("u"), F.col("t")).alias("source"))


@query("""SELECT page_id, url, CASE WHEN code IN (401, 403, 429) THEN CASE WHEN mode = 'http' THEN 'error' ELSE 'browser' END WHEN code >= 400 THEN 'error' WHEN mode = 'browser' OR (mode = 'auto' AND needs_js) THEN 'browser' ELSE 'http' END AS fetch_by
FROM (SELECT page_id, url, [200, 403, 404, 429, 500][page_id % 5 + 1] AS code, ['auto', 'http', 'browser'][page_id % 3 + 1] AS mode, length(""" + _STRIP + """) < 300 AS needs_js FROM pages)""")
def fetch_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a page is fetched after what the first request gave; the codes and modes are made up from the ids."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    p = table(spark, sf_dir, "pages").withColumns({"code": pick([200, 403, 404, 429, 500]), "mode": pick(["auto", "http", "browser"]), "js": F.length(T.stripped_html(F.col("html"))) < 300})
    return p.select("page_id", "url", T.fetch_by(F.col("code"), F.col("mode"), F.col("js")).alias("fetch_by"))


@query(r"""WITH said AS (SELECT page_id, unnest(['Konten terlalu pendek atau kosong', 'Tidak ada chunk', 'timeout', NULL]) AS message FROM pages)
SELECT page_id, message, CASE WHEN contains(lower(coalesce(message, '')), 'konten terlalu pendek atau kosong') OR contains(lower(coalesce(message, '')), 'tidak ada chunk') THEN 'target_web' ELSE 'rag_system' END AS source,
  CASE WHEN contains(lower(coalesce(message, '')), 'konten terlalu pendek atau kosong') THEN 'content_empty_after_cleaning' WHEN contains(lower(coalesce(message, '')), 'tidak ada chunk') THEN 'chunk_extraction_failed' ELSE 'internal_processing_error' END AS code FROM said""")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is to blame for a page that failed."""
    said = F.array(F.lit("Konten terlalu pendek atau kosong"), F.lit("Tidak ada chunk"), F.lit("timeout"), F.lit(None))
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(said).alias("message"))
    return p.select("page_id", "message", T.failure(F.col("message")).alias("f")).select("page_id", "message", "f.source", "f.code")


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with their path, table rows and text blocks of every page."""
    return html.read_blocks(table(spark, sf_dir, "pages")).withColumn("heading_path", F.array_join("heading_path", " > "))


@query()
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main text of every page, by its elements."""
    return html.read_clean(table(spark, sf_dir, "pages"))


@query()
def selected_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a selector names."""
    return html.read_selected(table(spark, sf_dir, "pages"), "article")


def _with_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a question and an answer in two parts, as the driver's pages have none."""
    pair = F.concat(F.lit("<dl><dt>What is the page about, number "), F.col("page_id").cast("string"), F.lit("?</dt><dd>It is at "), "url", F.lit("</dd><dd>and some more.</dd></dl>"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", pair).alias("html"))


@query("SELECT page_id, 0 AS ordinal, 'What is the page about, number ' || page_id || '?' AS question, 'It is at ' || url || chr(10) || 'and some more.' AS answer FROM pages")
def faq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of every page."""
    return html.read_faq(_with_pair(spark, sf_dir))


@query()
def faq_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the pairs of every page."""
    return html.read_faq_chunks(_with_pair(spark, sf_dir))


@query()
def web_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and child chunks of every page."""
    return html.read_chunks(table(spark, sf_dir, "pages"))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every document, read as markdown."""
    return files.read_markdown(table(spark, sf_dir, "documents")).withColumn("heading_path", F.array_join("heading_path", " > "))
