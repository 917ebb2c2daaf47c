"""Vector search: every embedding is a query over all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators import ranking, vector
from moraine.plans.registry import query, table

_PAIRS = """pairs AS (
  SELECT a.vec_id AS qid, b.vec_id AS id, a.label AS q_label, b.label AS label,
         round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


def nearest_sql(k: int, where: str = "TRUE") -> str:
    """CTEs up to hits: the k best per query with their rank."""
    return f"""WITH {_PAIRS},
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM pairs WHERE {where})
  WHERE rank <= {k})"""


def nearest(spark: SparkSession, sf_dir: str, k: int, **options) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector.top_k(e, e, k, query_id="vec_id", exclude_same=True, **options)


def labelled(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return hits.join(e.select(F.col("vec_id").alias("id"), "label"), "id")


@query(nearest_sql(5) + " SELECT qid, id, score, rank FROM hits")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain top-k."""
    return nearest(spark, sf_dir, 5)


@query(nearest_sql(5, "q_label = label") + " SELECT qid, id, score, rank FROM hits")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k within the query's category; the filter comes before the search."""
    return nearest(spark, sf_dir, 5, group_col="label")


@query(nearest_sql(10, "score >= 0.5") + " SELECT qid, id, score, CASE WHEN score >= 0.7 THEN 'high_score' WHEN score >= 0.6 THEN 'good_score' ELSE 'marginal' END AS note FROM hits WHERE rank <= 5")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web search: the store's threshold, twice as many as wanted, the first ones kept, with notes."""
    hits = nearest(spark, sf_dir, 10, threshold=0.5).where("rank <= 5")
    return hits.select("qid", "id", "score", T.web_note(F.col("score")).alias("note"))


@query(nearest_sql(45) + """,
tiers AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS in_label FROM hits)
SELECT qid, id, label, score, rank FROM (
  SELECT qid, id, label, score, row_number() OVER (PARTITION BY qid ORDER BY label, score DESC, id)::INTEGER AS rank FROM tiers WHERE in_label <= 3)
WHERE rank <= 9""")
def vector_topk_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five times as many hits as wanted at most three of each label, labels in order, nine in all."""
    hits = labelled(nearest(spark, sf_dir, 45).drop("rank"), spark, sf_dir)
    first = ranking.top_n(hits, ["qid", "label"], 3, F.desc("score"), "id", name="in_label")
    return ranking.top_n(first.drop("in_label"), ["qid"], 9, "label", F.desc("score"), "id").select("qid", "id", "label", "score", "rank")


@query(nearest_sql(25) + """,
best AS (SELECT *, row_number() OVER (PARTITION BY qid, coalesce(label::VARCHAR, 'point:' || id) ORDER BY score DESC, rank) AS n FROM hits)
SELECT qid, id, label, score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS place FROM best WHERE n = 1) WHERE place <= 5""")
def parent_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five times as many hits as wanted, the best of each parent (here: label), the first five."""
    hits = labelled(nearest(spark, sf_dir, 25), spark, sf_dir)
    key = F.coalesce(F.col("label").cast("string"), F.concat(F.lit("point:"), F.col("id").cast("string")))
    best = ranking.best_per_key(hits, ["qid"], key, "score", "rank")
    return ranking.top_n(best, ["qid"], 5, F.desc("score"), "id", name="place").select("qid", "id", "label", "score", "place")


@query(nearest_sql(5, "score >= 0.5") + " SELECT qid, min(id) FILTER (WHERE rank = 1) AS first_id, min(label) FILTER (WHERE rank = 1) AS first_label, count(*) AS hits, max(score) AS best FROM hits GROUP BY qid")
def search_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct search: hits per query, with the metadata of the first."""
    hits = labelled(nearest(spark, sf_dir, 5, threshold=0.5), spark, sf_dir)
    return hits.groupBy("qid").agg(F.min_by("id", "rank").alias("first_id"), F.min_by("label", "rank").alias("first_label"), F.count("*").alias("hits"), F.max("score").alias("best"))


@query(nearest_sql(5) + """,
flagged AS (SELECT *, score >= 0.85 AS accepted, bool_or(score >= 0.85) OVER (PARTITION BY qid) AS any_ok FROM hits)
SELECT qid, id, score, accepted FROM flagged WHERE accepted = any_ok""")
def accept_or_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted hits of each query; where there are none, the rejected ones."""
    hits = nearest(spark, sf_dir, 5).withColumn("accepted", F.col("score") >= 0.85)
    some = F.bool_or("accepted").over(Window.partitionBy("qid"))
    return hits.withColumn("some", some).where("accepted = some").select("qid", "id", "score", "accepted")


@query(nearest_sql(5) + " SELECT qid, max(score) >= 0.92 AS early_exit, min(rank) FILTER (WHERE score >= 0.90) AS bypass_rank FROM hits GROUP BY qid")
def early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a hit is good enough to stop the search, and the rank of the first that needs no judge."""
    hits = nearest(spark, sf_dir, 5)
    return hits.groupBy("qid").agg((F.max("score") >= 0.92).alias("early_exit"), F.min(F.when(F.col("score") >= 0.90, F.col("rank"))).alias("bypass_rank"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored in a collection: the length of each vector, and its similarity with itself."""
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.cosine(v, v), 6).alias("self"), F.round(norm, 6).alias("norm"))
