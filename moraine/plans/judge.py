"""Replies of a judge: read, checked against the contract, and used for the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators import ranking
from moraine.plans.registry import query, table
from moraine.plans.retrieval import _CANDIDATES, candidates
from moraine.session import written

_REPLY = """CASE qid % 7 WHEN 0 THEN 'no JSON here' WHEN 1 THEN 'ranks' WHEN 2 THEN 'confidence' WHEN 3 THEN 'unexpected_answer' WHEN 4 THEN 'missing_answer' END"""


def replies(given: DataFrame) -> DataFrame:
    """qid, sources and a reply of each query: candidates over 0.3 are relevant, with half more as confidence; five of seven queries break the contract, each in its way."""
    way = F.col("qid") % 7
    relevant = F.col("score") >= 0.3
    answer = F.when(relevant & (F.col("source") != "text"), F.concat(F.lit("jawaban "), F.col("id").cast("string"))).otherwise("")
    answer = F.when((way == 3) & (F.col("source") == "text"), "x").when((way == 4), F.lit("")).otherwise(answer)
    row = F.struct(
        F.when((way == 1) & (F.col("rank") == 1), 99).otherwise(F.col("rank")).alias("rank"), (relevant | ((way == 4) & (F.col("source") != "text"))).alias("relevant"),
        F.when((way == 2) & (F.col("rank") == 1), 2.0).otherwise(F.greatest(F.lit(0.0), F.round(F.least(F.col("score") + 0.5, F.lit(1.0)), 2))).alias("confidence"), answer.alias("answer"), F.lit("r").alias("reason"),
    )
    own = given.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("assessments"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"))
    body = F.to_json(F.struct("assessments"))
    reply = F.when(F.col("qid") % 7 == 0, "no JSON here").when(F.col("qid") % 2 == 0, F.concat(F.lit("Berikut:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return own.select("qid", "sources", reply.alias("reply"))


_PROBLEM = _CANDIDATES + """,
asked AS (SELECT qid, bool_or(source = 'text') AS some_text, bool_or(source <> 'text') AS others FROM candidates GROUP BY qid),
problems AS (SELECT qid, CASE WHEN qid % 7 = 0 THEN 'not_json' WHEN qid % 7 = 1 THEN 'ranks' WHEN qid % 7 = 2 THEN 'confidence'
  WHEN qid % 7 = 3 AND some_text THEN 'unexpected_answer' WHEN qid % 7 = 4 AND others THEN 'missing_answer' END AS problem FROM asked)"""


@query(_PROBLEM + " SELECT qid, problem FROM problems")
def judge_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each reply breaks the contract; null where it keeps it."""
    r = replies(candidates(spark, sf_dir)).withColumn("items", ranking.assessments(F.col("reply")))
    return r.select("qid", ranking.contract_problem(F.col("items"), F.size("sources"), F.col("sources")).alias("problem"))


@query(_PROBLEM + """,
good AS (SELECT c.qid, c.id, c.source, c.rank, round(least(score + 0.5, 1.0), 2) AS confidence FROM candidates c JOIN problems p ON p.qid = c.qid WHERE p.problem IS NULL AND score >= 0.3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE source WHEN 'text' THEN 1 WHEN 'document' THEN 2 ELSE 3 END, confidence DESC, rank) AS n FROM good WHERE confidence >= 0.85)
SELECT qid, id, source, rank, confidence FROM ranked WHERE n = 1""")
def judge_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that is chosen after replies that keep the contract; answers that can't be given don't count."""
    given = written(candidates(spark, sf_dir))
    r = replies(given).withColumn("items", ranking.assessments(F.col("reply")))
    r = r.where(ranking.contract_problem(F.col("items"), F.size("sources"), F.col("sources")).isNull())
    said = r.select("qid", F.inline("items"))
    rows = said.join(given.select("qid", "rank", "id", "source"), ["qid", "rank"])
    usable = (F.col("source") == "text") | T.answer_problem(F.col("answer")).isNull()
    return ranking.judged(rows.where(usable & ~((F.col("source") != "text") & T.is_negative(F.col("answer"))))).select("qid", "id", "source", "rank", "confidence")


@query("""WITH modes AS (SELECT unnest(['batch', 'SINGLE', '  ', NULL, 'other']) AS stored), configured AS (SELECT unnest(['single', 'batch', NULL]) AS configured)
SELECT stored, configured, CASE WHEN lower(trim(coalesce(nullif(trim(stored), ''), configured))) IN ('single', 'batch') THEN lower(trim(coalesce(nullif(trim(stored), ''), configured))) ELSE 'single' END AS mode FROM modes, configured""")
def relevance_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode by what is stored, then by what is configured."""
    a = spark.createDataFrame([("batch",), ("SINGLE",), ("  ",), (None,), ("other",)], "stored string")
    b = spark.createDataFrame([("single",), ("batch",), (None,)], "configured string")
    return a.crossJoin(b).select("stored", "configured", T.mode_of(F.col("stored"), F.col("configured")).alias("mode"))


@query("""SELECT doc_id, CASE WHEN length(text) > 350 THEN substr(text, 1, 350) || '...' ELSE text END AS summary,
  concat_ws(chr(10) || chr(10), 'jawaban', CASE WHEN lang = 'en' THEN 'Dokumen: ' || source || '.pdf' || coalesce(', Halaman: ' || CASE WHEN doc_id % 2 = 0 THEN doc_id END, '') WHEN lang = 'de' THEN 'URL: ' || source || '.pdf' END) AS cited FROM documents""")
def answers_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown where no model answers: the summary's fallback, and an answer with its source."""
    kind = F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "web").otherwise("text")
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    cited = T.citation(F.lit("jawaban"), kind, F.concat("source", F.lit(".pdf")), page)
    return table(spark, sf_dir, "documents").select("doc_id", T.summary_fallback(F.col("text")).alias("summary"), cited.alias("cited"))


@query("""WITH hits AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, '{"success":' || CASE WHEN n > 300 THEN 'true' ELSE 'false' END || ',"length":' || n || '}' AS payload FROM hits""")
def response_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response as JSON."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("n", F.length("text"))
    return c.select("conv_id", "turn", F.to_json(F.struct((F.col("n") > 300).alias("success"), F.col("n").alias("length"))).alias("payload"))
