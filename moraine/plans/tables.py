"""Keyed tables: upserts, patches, deletes, change detection and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators import maintenance
from moraine.plans.registry import query, table
from moraine.plans.texts import _HASH


@query("""WITH versions AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS version, 0 AS side FROM orders
  UNION ALL SELECT o_orderkey, 'X', o_totalprice * 2, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END, 1 FROM orders WHERE o_totalprice > 100000
  UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice, 1, 1 FROM orders WHERE o_totalprice > 400000)
SELECT o_orderkey, o_orderstatus, o_totalprice, version FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC, side DESC) AS n FROM versions) WHERE n = 1""")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after changes to the dear ones, and new ones."""
    o = table(spark, sf_dir, "orders")
    own = o.select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("version"))
    version = F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(1)
    changed = o.where("o_totalprice > 100000").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), version.alias("version"))
    new = o.where("o_totalprice > 400000").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice", F.lit(1).alias("version"))
    return maintenance.upserted(own, changed.unionByName(new), "o_orderkey", "version")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def point_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without those of customers in debt."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return maintenance.deleted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal > 5000 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def payload_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after a partial update: only what isn't null is set."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = c.where("c_acctbal < 0 OR c_acctbal > 5000").select("c_custkey", F.when(F.col("c_acctbal") < 0, "DEBT").alias("c_mktsegment"), F.when(F.col("c_acctbal") > 5000, 0.0).alias("c_acctbal"))
    return maintenance.patched(c, changes, "c_custkey")


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN true END, NOT coalesce(CASE WHEN toxic = 1 THEN true END, false)) AS is_active FROM labels")
def backfill_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag of rows that were written before there was one."""
    active, removed = F.when(F.col("quality") == 1, True), F.when(F.col("toxic") == 1, True)
    return table(spark, sf_dir, "labels").select("doc_id", maintenance.is_active(active, removed).alias("is_active"))


@query(f"""WITH incoming AS (SELECT doc_id, {_HASH} AS h, lang FROM documents),
state AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'old' ELSE h END AS h, lang <> 'es' AS active FROM incoming WHERE lang <> 'fr' UNION ALL SELECT -doc_id - 1, h, true FROM incoming WHERE lang = 'fr')
SELECT coalesce(i.doc_id, s.doc_id) AS doc_id, CASE WHEN i.doc_id IS NULL THEN 'delete' WHEN s.doc_id IS NULL THEN 'index' WHEN i.h <> s.h THEN 'reindex' WHEN NOT s.active THEN 'restore' ELSE 'skip' END AS action
FROM incoming i FULL JOIN state s ON i.doc_id = s.doc_id""")
def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done with each document against stored hashes: of these the French aren't there, the German differ, the Spanish are inactive."""
    incoming = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), "lang")
    state = incoming.where("lang <> 'fr'").select("doc_id", F.when(F.col("lang") == "de", "old").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("lang") != "es").alias("is_active"))
    state = state.unionByName(incoming.where("lang = 'fr'").select((-F.col("doc_id") - 1).alias("doc_id"), "content_hash", F.lit(True).alias("is_active")))
    return maintenance.change_actions(incoming, state, "doc_id")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'deactivate' WHEN page_id % 4 = 1 OR page_id % 4 = 2 THEN 'scrape' ELSE 'metadata' END AS action FROM pages""")
def source_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an update of a page's source leads to; the old states are made up from the ids."""
    kind = F.col("page_id") % 4
    old = F.when(kind == 1, F.concat("url", F.lit("/old"))).otherwise(F.concat(F.lit(" "), "url"))
    selector, old_selector = F.when(kind == 2, "article"), F.when(kind == 0, "  ")
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", maintenance.update_action(kind != 3, F.col("url"), old, selector, old_selector, F.lit(True)).alias("action"))


_LOG = "SELECT user_id, CASE event_type WHEN 'view' THEN 'bulk_sync' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'other' END AS action, event_id, value FROM events"


@query(f"""WITH log AS ({_LOG}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM log WHERE action <> 'other') WHERE n = 1)
SELECT c_custkey AS user_id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last) UNION ALL SELECT user_id, value FROM last WHERE action <> 'delete'""")
def apply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a log of adds, updates, deletes and whole syncs; events play the log."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    action = F.when(F.col("event_type") == "view", "bulk_sync").when(F.col("event_type") == "click", "add").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "delete").otherwise("other")
    log = table(spark, sf_dir, "events").select("user_id", action.alias("action"), "event_id", "value")
    return maintenance.applied(stored, log, "user_id", "event_id", ["value"])


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', doc_id) AS place FROM documents) WHERE place <= 1000")
def scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered scan page of each source, a thousand rows at most, parents (here: English) first."""
    from moraine.operators.ranking import top_n

    d = table(spark, sf_dir, "documents")
    return top_n(d, ["source"], 1000, F.col("lang") != "en", "doc_id", name="place").select("source", "doc_id", F.col("n_chars").alias("n"))


@query("SELECT l.doc_id, d.source, d.lang, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by ids."""
    return maintenance.lookup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", "quality")


@query("SELECT count(*) AS n, sum(CASE WHEN conv_id = turn OR turn = 1 THEN 1 ELSE 0 END)::BIGINT AS either FROM conversations")
def either_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one field or the other names."""
    c = table(spark, sf_dir, "conversations")
    return c.agg(F.count("*").alias("n"), F.count_if((F.col("conv_id") == F.col("turn")) | (F.col("turn") == 1)).alias("either"))


@query("""WITH stored AS (SELECT doc_id, 'document:' || doc_id AS descriptor, 'old' AS content FROM documents WHERE lang IN ('en', 'de'))
SELECT 'document:' || doc_id AS descriptor, lang AS content FROM documents WHERE lang <> 'de' UNION ALL SELECT descriptor, content FROM stored WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')""")
def replace_on_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored under a descriptor goes before what comes in is put there."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("descriptor"), F.col("lang").alias("content"))
    stored = d.where("content IN ('en', 'de')").select("descriptor", F.lit("old").alias("content"))
    return maintenance.replaced(stored, d.where("content <> 'de'"), "descriptor")


@query("""WITH variables AS (SELECT n_name AS name, n_name || '!' AS content, CASE WHEN n_regionkey = 0 THEN n_nationkey END AS deleted_at FROM nation)
SELECT n_name AS name, coalesce(nullif(trim(v.content), ''), 'default') AS content FROM nation LEFT JOIN variables v ON v.name = n_name AND v.deleted_at IS NULL""")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that aren't deleted, with a default for those that are missing."""
    n = table(spark, sf_dir, "nation")
    variables = n.select(F.col("n_name").alias("name"), F.concat("n_name", F.lit("!")).alias("content"), F.when(F.col("n_regionkey") == 0, F.col("n_nationkey")).alias("deleted_at"))
    return maintenance.config(variables, n.select(F.col("n_name").alias("name")), "default")
