"""Queries for the rules of a live knowledge base; what the driver's tables don't hold is made up from their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators import knowledge as K
from moraine.operators import layout
from moraine.plans.layout import _COLUMNS, _NOISE, _PAGE, _RAW, raw_blocks
from moraine.plans.registry import query, table
from moraine.plans.retrieval import _CANDIDATES, candidates
from moraine.session import written


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND lang <> 'de' AND (doc_id % 5 <> 4)")
def searchable_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are active, not deleted and children; flags are missing for some."""
    d = table(spark, sf_dir, "documents")
    own = d.select("doc_id", F.when(F.col("doc_id") % 7 != 0, True).alias("is_active"), (F.col("lang") == "de").alias("is_deleted"), F.when(F.col("doc_id") % 5 == 4, "parent").otherwise("child").alias("level"))
    return own.where(K.searchable(F.col("is_active"), F.col("is_deleted"), F.col("level"))).select("doc_id")


_USULAN = _CANDIDATES + """,
contexts AS (SELECT qid, id, CASE WHEN id % 3 = 0 THEN 'usulan' ELSE 'web' END AS source_type, CASE WHEN id % 5 = 0 THEN '  ' ELSE 'isi ' || id END AS content, score, rank FROM candidates WHERE qid % 2 = 0)"""


def _contexts(c: DataFrame) -> DataFrame:
    return c.where("qid % 2 = 0").select("qid", "id", F.when(F.col("id") % 3 == 0, "usulan").otherwise("web").alias("source_type"), F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit("isi "), F.col("id").cast("string"))).alias("content"), "score", "rank")


@query(_USULAN + """
SELECT qid, id, content, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, id)::INTEGER AS place FROM contexts WHERE source_type = 'usulan' AND trim(content) <> '') WHERE place <= 3""")
def proposal_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that are proposals and not blank, three a query."""
    return K.proposal_contexts(_contexts(candidates(spark, sf_dir)), "qid", 3, ["rank", "id"]).select("qid", "id", "content", "place")


@query(_USULAN + """,
graph AS (SELECT qid, id, score, 'graph' AS note, true AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS p FROM contexts WHERE source_type = 'usulan' AND trim(content) <> '') WHERE p <= 5),
near AS (SELECT qid, id, score, CASE WHEN score >= 0.5 THEN 'relevant' ELSE '-' END AS note, score >= 0.5 AS accepted FROM candidates WHERE rank <= 5 AND qid NOT IN (SELECT qid FROM graph)),
every AS (SELECT *, max(accepted::INTEGER) OVER (PARTITION BY qid) = 1 AS some_ok FROM (SELECT * FROM graph UNION ALL SELECT * FROM near))
SELECT qid, id, round(score, 3) AS final_score, note, CASE WHEN some_ok THEN 'success' ELSE 'low_confidence' END AS status, row_number() OVER (PARTITION BY qid ORDER BY round(score, 3) DESC, id)::INTEGER AS place
FROM every WHERE accepted = some_ok AND (NOT some_ok OR qid % 11 <> 0)""")
def proposal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal search: graph contexts, or else the nearest by vector; queries divisible by 11 have another topic."""
    c = written(candidates(spark, sf_dir))
    topics = c.where("qid % 11 = 0").select("qid", F.lit(False).alias("relevant")).distinct()
    return K.proposals(_contexts(c), c.select("qid", "id", "score", "rank"), topics, "qid", threshold=0.5)


_DOCS = "(SELECT doc_id, text, source, lang, n_chars, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'document' WHEN 2 THEN 'web' END AS kind FROM documents)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").withColumn("kind", F.when(way == 0, "text").when(way == 1, "document").when(way == 2, "web"))


@query(f"""SELECT doc_id, json_extract_string(p, '$.status') AS status, json_extract_string(p, '$.source') AS source, json_extract_string(p, '$.q') AS question, json_extract_string(p, '$.a') AS answer, json_extract_string(p, '$.id') AS answer_id, json_extract_string(p, '$.note') AS note, n FROM (
  SELECT doc_id, json_object('status', 'success', 'source', kind, 'q', CASE WHEN kind = 'text' THEN lang ELSE '' END, 'a', CASE WHEN kind IN ('document', 'web') THEN text ELSE '' END, 'id', CASE WHEN kind = 'text' THEN 'a-' || doc_id END, 'note', 'good') AS p, 1 AS n FROM {_DOCS} WHERE kind IS NOT NULL)""")
def success_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response for a chosen candidate, built as JSON and read back."""
    d = _typed(spark, sf_dir).where("kind is not null")
    p = K.success_payload(F.col("kind"), F.col("lang"), F.concat(F.lit("a-"), F.col("doc_id").cast("string")), F.col("text"), F.lit(0.9), F.lit("good"), F.lit(2), F.lit(9), F.lit("asked"))
    return _read_back(d.withColumn("p", p))


@query(f"""SELECT doc_id, 'low_confidence' AS status, coalesce(kind, 'none') AS source, CASE WHEN kind IS NOT NULL THEN lang END AS question, CASE WHEN kind IS NOT NULL THEN CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END END AS answer,
  CASE WHEN kind IS NOT NULL THEN 'a-' || doc_id END AS answer_id, CASE WHEN kind IS NOT NULL THEN 'not_relevant_checked_4' END AS note, CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS n FROM {_DOCS}""")
def low_confidence_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response where nothing is relevant, built as JSON and read back; every fourth question has no candidate at all."""
    p = K.low_confidence_payload(F.col("kind"), F.col("lang"), F.concat(F.lit("a-"), F.col("doc_id").cast("string")), F.col("text"), F.lit(0.3), F.lit(4), F.lit(9), F.lit("asked"))
    return _read_back(_typed(spark, sf_dir).withColumn("p", p))


def _read_back(d: DataFrame) -> DataFrame:
    q = "array<struct<question:string,answer_id:string,answer_doc:string,note:string>>"
    own = d.select("doc_id", F.from_json("p", f"status string, source string, data struct<similar_questions:{q}>").alias("p")).select("doc_id", "p.status", "p.source", F.col("p.data.similar_questions").alias("s"))
    first = F.try_element_at("s", F.lit(1))
    return own.select("doc_id", "status", "source", first["question"].alias("question"), first["answer_doc"].alias("answer"), first["answer_id"].alias("answer_id"), first["note"].alias("note"), F.size("s").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'kb:main:web:' || doc_id WHEN 1 THEN ' text:a:' || doc_id || ' ' WHEN 2 THEN 'kb:main:video:' || doc_id WHEN 3 THEN 'usulan:' END AS t FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'text' ELSE '' END AS source_type, CASE doc_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'a:' || doc_id ELSE '' END AS source_id FROM d""")
def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and ids out of whole, short and broken descriptors."""
    i, way = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    t = F.when(way == 0, F.concat(F.lit("kb:main:web:"), i)).when(way == 1, F.concat(F.lit(" text:a:"), i, F.lit(" "))).when(way == 2, F.concat(F.lit("kb:main:video:"), i)).when(way == 3, F.lit("usulan:"))
    return table(spark, sf_dir, "documents").select("doc_id", K.descriptor(t).alias("d")).select("doc_id", "d.source_type", "d.source_id")


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Title: ' || source || chr(10) || 'Category: ' || lang || CASE WHEN text <> '' THEN chr(10) || chr(10) || 'Question:' || chr(10) || text ELSE '' END || chr(10) || chr(10) || 'Answer:' || chr(10) || 'j'
  WHEN 1 THEN 'Title: ' || source || chr(10) || 'Organization: ' || lang || chr(10) || 'File: f.pdf' || chr(10) || chr(10) || text WHEN 2 THEN 'Title: ' || source || chr(10) || 'URL: http://x/' || doc_id || chr(10) || chr(10) || text
  ELSE 'Title: ' || source || chr(10) || 'Organization: ' || lang || chr(10) || 'Request-ID: ' || doc_id || CASE WHEN text <> '' THEN chr(10) || chr(10) || 'Question:' || chr(10) || text ELSE '' END END AS content FROM {_DOCS}""")
def ingestion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is indexed of each of four types of source."""
    i = F.col("doc_id").cast("string")
    kind = F.coalesce("kind", F.lit("usulan"))
    text = K.ingestion_text(kind, F.col("source"), F.col("text"), category=F.col("lang"), organization=F.col("lang"), file=F.lit("f.pdf"), url=F.concat(F.lit("http://x/"), i), request_id=i, answer=F.lit("j"))
    return _typed(spark, sf_dir).select("doc_id", text.alias("content"))


@query(f"""WITH h AS (SELECT page_id, sha1(unhex('{K.NAMESPACE_URL}') || encode(url)) AS h FROM pages)
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def url_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", K.uuid5(F.col("url")).alias("uuid"))


@query("SELECT page_id, sha256(html) AS file_hash, octet_length(encode(html)) AS n FROM pages")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of files' bytes."""
    b = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(b, 256).alias("file_hash"), F.octet_length(b).cast("long").alias("n"))


@query("SELECT doc_id, 'a & b <c> \"d\" é ' || chr(160) || doc_id || ' &bogus ' || lang AS text FROM documents")
def unescaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character references by name and number resolved; what isn't one stays."""
    t = F.concat(F.lit("a &amp; b &lt;c&gt; &quot;d&#34; &#xE9; &nbsp;"), F.col("doc_id").cast("string"), F.lit(" &bogus "), F.col("lang"))
    return K.unescaped(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), "text")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE doc_id END AS n, CASE doc_id % 5 WHEN 0 THEN 'deep } {' WHEN 1 THEN 'deep } {' WHEN 2 THEN 'deep } {' END AS deep, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN doc_id % 2 = 0 ELSE true END AS relevant FROM documents""")
def nested_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of replies of all sorts: fenced, bare, in prose, cut off, and none; without a verdict a passage is relevant."""
    body = F.concat(F.lit('{"a": {"b": {"c": {"d": "deep } {"}}}, "n": '), F.col("doc_id").cast("string"), F.lit(', "relevant": '), (F.col("doc_id") % 2 == 0).cast("string"), F.lit("}"))
    way = F.col("doc_id") % 5
    reply = F.when(way == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(way == 1, body).when(way == 2, F.concat(F.lit("I think {so} that "), body, F.lit(" and more"))).when(way == 3, F.substring(body, 1, 20))
    d = table(spark, sf_dir, "documents").select("doc_id", K.json_column(reply).alias("j"))
    return d.select("doc_id", F.get_json_object("j", "$.n").cast("long").alias("n"), F.get_json_object("j", "$.a.b.c.d").alias("deep"), K.relevance_of(F.col("j")).alias("relevant"))


@query("""WITH d AS (SELECT doc_id, substr(text, 1, (doc_id % 30)::INTEGER) AS a, substr(text, 1, (doc_id % 47)::INTEGER) AS b FROM documents)
SELECT doc_id, CASE WHEN length(trim(a)) < 20 AND length(trim(b)) > length(trim(a)) THEN trim(b) ELSE trim(a) END AS text FROM d""")
def ocr_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two readings of a page the one that counts."""
    cut = lambda n: F.col("text").substr(F.lit(1), (F.col("doc_id") % n).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", K.page_ocr(cut(30), cut(47)).alias("text"))


@query("""WITH e AS (SELECT event_id, [200, 429, 500, 503, 400][event_id % 5 + 1] AS status, event_id % 3 + 1 AS attempt, [NULL, 'timeout', 'connect', 'read', 'empty', NULL, NULL][event_id % 7 + 1] AS error FROM events)
SELECT event_id, CASE WHEN status = 429 THEN attempt * 10 WHEN status IN (500, 503) THEN attempt * 5 END AS wait, CASE WHEN error = 'timeout' THEN 'timeout' WHEN error = 'connect' THEN 'connection_error' WHEN error = 'empty' THEN 'empty_content' WHEN error IS NOT NULL THEN 'request_error' WHEN status >= 400 THEN 'http_status_error' END AS code,
  CASE WHEN error IN ('timeout', 'connect', 'read') THEN true WHEN error IS NOT NULL OR status >= 400 THEN false END AS again, CASE WHEN status >= 500 THEN 'file_server_error' WHEN status >= 400 THEN 'file_http_error' END AS file FROM e""")
def request_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of failed requests, whether and when they are sent again."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    status, attempt, error = pick([200, 429, 500, 503, 400], 5), F.col("event_id") % 3 + 1, pick([None, "timeout", "connect", "read", "empty", None, None], 7)
    e = table(spark, sf_dir, "events").select("event_id", K.ocr_wait(status, attempt).alias("wait"), K.fetch_error(status, error).alias("f"), K.download_error(status).alias("file"))
    return e.select("event_id", "wait", "f.code", "f.again", "file")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN event_id::INTEGER ELSE 7 END AS i, CASE event_id % 4 WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN 1.5 ELSE 0.5 END AS d, event_id % 4 = 0 OR event_id = 1 AS b,
  CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN '1.5' ELSE 'Off|b' END AS l, CASE event_id % 4 WHEN 1 THEN least(100.0, event_id)::DOUBLE WHEN 2 THEN 1.5 ELSE 0.0 END AS pct FROM events""")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every type, with defaults where they are empty or can't be read."""
    way = F.col("event_id") % 4
    v = F.when(way == 1, F.col("event_id").cast("string")).when(way == 2, "1.5").when(way == 3, "Off, b,")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", K.setting(v, "int", F.lit(7)).alias("i"), K.setting(v, "double", F.lit(0.5)).alias("d"), K.setting(v, "boolean", F.lit(True)).alias("b"), F.array_join(K.setting(v, "array<string>", F.array(F.lit("x"))), "|").alias("l"), K.percent(v).alias("pct"))


@query("""WITH s AS (SELECT c_custkey AS id, c_custkey % 1000 + 100000 AS link, c_name AS name FROM customer), w AS (SELECT n_nationkey + 1 AS k FROM nation UNION ALL SELECT 100000 + n_nationkey FROM nation UNION ALL SELECT 999999)
SELECT k, coalesce((SELECT name FROM s WHERE id = k), (SELECT arg_min(name, id) FROM s WHERE link = k)) AS name FROM w""")
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by id, or by another field where no id fits."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 1000 + 100000).alias("link"), F.col("c_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    w = n.select((F.col("k") + 1).alias("k")).union(n.select(F.col("k") + 100000)).union(spark.range(1).select(F.lit(999999).cast("long")))
    return K.state_of(s, w, "id", "link").select("k", F.col("state.name").alias("name"))


@query("""WITH d AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: x <> '') AS q, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS a FROM documents),
p AS (SELECT doc_id, q, a, unnest(range(least(len(q), len(a)))) AS i FROM d)
SELECT doc_id, i::INTEGER AS place, q[i + 1] AS question, a[i + 1] AS answer FROM p""")
def zipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists by their places; the longer one is cut."""
    parts = lambda by: F.filter(F.split("text", by), lambda x: x != "")
    return K.zipped(table(spark, sf_dir, "documents").select("doc_id", parts(r"\. ").alias("q"), parts("\n").alias("a")), "q", "a")


@query("""WITH c AS (SELECT o_custkey AS t, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS row, o_orderstatus AS a, CASE WHEN o_orderkey % 3 > 0 THEN ' ' || o_orderpriority ELSE '' END AS b FROM orders),
l AS (SELECT *, trim(a) || ' | ' || trim(b) AS line, count(*) OVER (PARTITION BY t) AS rows, first_value(trim(a) || ' | ' || trim(b)) OVER (PARTITION BY t ORDER BY row) AS header FROM c)
SELECT t, row AS row_start, CASE WHEN rows = 1 THEN line ELSE header || chr(10) || line END AS text FROM l WHERE row > 0 OR rows = 1""")
def pdf_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables, each under its table's header; a customer's orders are a table."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row"), F.array("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" "), "o_orderpriority"))).alias("cells"))
    return K.table_rows(o, ["t"])


@query("""WITH s AS (SELECT page_id AS k, 'scraped' AS status, page_id % 3 <> 0 AS is_active, url, md5(html) AS hash FROM pages WHERE page_id % 4 <> 3),
l AS (SELECT page_id AS k, ['delete', 'register_inactive', 'edit', 'sync_done', 'sync_failed', 'note'][page_id % 6 + 1] AS action, CASE WHEN page_id % 5 = 0 THEN 'http://new/' || page_id END AS new_url, CASE WHEN page_id % 7 <> 0 THEN 'h' || page_id END AS new_hash FROM pages WHERE page_id % 9 <> 0)
SELECT coalesce(s.k, l.k) AS k, CASE WHEN action = 'delete' THEN 'deleted' WHEN action = 'register_inactive' THEN coalesce(status, 'inactive') WHEN action IN ('edit', 'sync_done') THEN 'scraped' WHEN action = 'sync_failed' THEN 'failed' ELSE status END AS status,
  CASE WHEN action IN ('delete', 'register_inactive') THEN false WHEN action = 'sync_done' THEN true ELSE coalesce(is_active, true) END AS is_active, coalesce(CASE WHEN action <> 'delete' THEN new_url END, url) AS url, CASE WHEN action IN ('edit', 'sync_done') THEN coalesce(new_hash, hash) ELSE hash END AS hash
FROM s FULL JOIN l ON s.k = l.k""")
def web_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of pages after their last action; earlier ones in the log don't count."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    states = p.where("page_id % 4 <> 3").select(k.alias("k"), F.lit("scraped").alias("status"), (k % 3 != 0).alias("is_active"), "url", F.md5("html").alias("hash"))
    pick = F.element_at(F.array(*map(F.lit, ["delete", "register_inactive", "edit", "sync_done", "sync_failed", "note"])), (k % 6 + 1).cast("int"))
    last = p.where("page_id % 9 <> 0").select(k.alias("k"), F.lit(2).alias("at"), pick.alias("action"), F.when(k % 5 == 0, F.concat(F.lit("http://new/"), k.cast("string"))).alias("url"), F.when(k % 7 != 0, F.concat(F.lit("h"), k.cast("string"))).alias("hash"))
    early = last.withColumns({"at": F.lit(1), "action": F.lit("delete"), "url": F.lit("x"), "hash": F.lit("x")})
    return K.web_state(states, last.union(early), "k", "at")


@query("""WITH j AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 60000000 * (event_id % 5) AS z FROM events)
SELECT user_id, event_id, coalesce(max(z) OVER (PARTITION BY user_id ORDER BY a, z, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= a, true) AS runs FROM j""")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that aren't begun as one for the same key is under way."""
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", a.alias("a"), (a + 60000000 * (F.col("event_id") % 5)).alias("z"))
    return K.first_in_flight(e, "user_id", "a", "z", "event_id").select("user_id", "event_id", "runs")


@query("""SELECT event_id, coalesce(lag(event_type || value) OVER (PARTITION BY user_id ORDER BY event_id) = event_type || value AND lag(value) OVER (PARTITION BY user_id ORDER BY event_id) = value, false) AS hit FROM (SELECT user_id, event_id, event_type, (event_id % 2)::VARCHAR AS value FROM events)""")
def layout_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that a cache of one entry has."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 2).alias("dpi"))
    return K.cache_hits(e, "user_id", "event_id", ["event_type", "dpi"]).select("event_id", "hit")


@query("SELECT doc_id, 'Does the passage answer the question?' || chr(10) || 'Question: ' || source || chr(10) || 'Passage: ' || text || chr(10) || 'Reply as JSON: {\"relevant\": true, \"reason\": \"\", \"reformulated_question\": \"\"}' AS prompt FROM documents")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's text with its values put in; a value isn't read for places again."""
    head, mid = (x.replace("{{", "{").replace("}}", "}") for x in K.PROMPTS["relevance"].split("{question}"))
    mid, tail = mid.split("{passage}")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(head), "source", F.lit(mid), "text", F.lit(tail)).alias("prompt"))


@query("""WITH d AS (SELECT 'document:' || doc_id AS file_path, doc_id FROM documents WHERE doc_id % 3 = 0), w AS (SELECT 'document:' || doc_id AS descriptor FROM labels)
SELECT w.descriptor, d.doc_id FROM w LEFT JOIN d ON d.file_path = w.descriptor""")
def found_by_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the index by their descriptors."""
    name = F.concat(F.lit("document:"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(name.alias("descriptor"), "doc_id")
    return table(spark, sf_dir, "labels").select(name.alias("descriptor")).join(d, "descriptor", "left")


@query("SELECT 'source' AS field, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang")
def payload_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of values on the fields that are filtered by."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).alias("field", "value"))
    return d.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY source")
def passed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that is passed on as it is."""
    return spark.sql("SELECT source, count(*) AS n FROM {docs} WHERE n_chars > {least} GROUP BY source", docs=table(spark, sf_dir, "documents"), least=100)


@query(_RAW + _NOISE + _COLUMNS.replace("FROM raw)", "FROM kept)", 1).replace(", sided AS", """, boxes AS (SELECT doc_id, page_number, 30.0 AS tx0, 140.0 AS ty0, 300.0 AS tx1, 300.0 AS ty1 FROM raw GROUP BY doc_id, page_number),
clean AS (SELECT k.* FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM noise x WHERE x.doc_id = k.doc_id AND x.key = k.key)),
kept AS (SELECT r.* FROM clean r JOIN boxes b ON b.doc_id = r.doc_id AND b.page_number = r.page_number WHERE NOT (greatest(0.0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0.0, least(y1, ty1) - greatest(y0, ty0)) / greatest((x1 - x0) * (y1 - y0), 1e-9) >= 0.3)),
sided AS""", 1) + r""",
placed AS (SELECT r.*, trim(regexp_replace(r.text, '\s+', ' ', 'g')) AS flat, CASE WHEN two_columns AND (x0 + x1) / 2 > page_width / 2 THEN 1 ELSE 0 END AS col, median(CASE WHEN font_size > 0 THEN font_size END) OVER (PARTITION BY r.doc_id, r.page_number) AS m FROM kept r JOIN two t ON t.doc_id = r.doc_id AND t.page_number = r.page_number),
marked AS (SELECT *, (length(flat) <= 140 AND (regexp_matches(flat, '(?i)^(bab|bagian|pasal)([^\p{L}\p{N}_]|$)') OR (NOT regexp_matches(flat, '[.?!;]$') AND ((font_size >= greatest(14.0, 1.35 * m) AND len(string_split(flat, ' ')) <= 14)
  OR (is_bold AND len(string_split(flat, ' ')) <= 12 AND NOT regexp_matches(flat, '^(\d+[.)]|[-*]|[a-zA-Z][.)])\s+')))))) AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, col, round_even(y0 / 4, 0) * 4, x0, y0) - 1 AS block_order FROM placed WHERE flat <> '')
SELECT doc_id, page_number, block_order::INTEGER AS block_order, flat AS text, CASE WHEN heading THEN 'heading' WHEN regexp_matches(flat, '^(\d+[.)]|[-*]|[a-zA-Z][.)])\s+') THEN 'list_item' ELSE 'paragraph' END AS block_type,
  coalesce(last_value(CASE WHEN heading THEN flat END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_order ROWS UNBOUNDED PRECEDING), '') AS heading_text FROM marked""")
def layout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid-out pages as blocks: without what repeats in the margins and what lies in tables, in reading order, with the heading they are under."""
    raw = raw_blocks(spark, sf_dir)
    boxes = raw.select(*_PAGE).distinct().select(*_PAGE, F.lit(30.0).alias("x0"), F.lit(140.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(300.0).alias("y1"))
    return layout.scan(raw, boxes).select("doc_id", "page_number", "block_order", "text", "block_type", "heading_text")


@query(r"""WITH parts AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n+')) AS p, generate_subscripts(string_split_regex(text, '\n\s*\n+'), 1) AS i FROM documents),
flat AS (SELECT doc_id, i, trim(regexp_replace(p, '\s+', ' ', 'g')) AS text FROM parts),
marked AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_order, regexp_matches(text, '(?i)^(bab|bagian|pasal)([^\p{L}\p{N}_]|$)') OR (len(regexp_extract_all(text, '\p{L}')) >= 4 AND len(regexp_extract_all(text, '\p{Lu}')) >= 0.72 * len(regexp_extract_all(text, '\p{L}')) AND len(string_split(text, ' ')) <= 12) AS heading FROM flat WHERE text <> '')
SELECT doc_id, block_order::INTEGER AS block_order, text, CASE WHEN heading THEN 'heading' WHEN regexp_matches(text, '^(\d+[.)]|[-*]|[a-zA-Z][.)])\s+') THEN 'list_item' ELSE 'paragraph' END AS block_type,
  coalesce(last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_order ROWS UNBOUNDED PRECEDING), '') AS heading_text FROM marked""")
def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of read pages as blocks under the last heading."""
    return layout.text_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
