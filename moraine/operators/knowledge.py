"""Rules of a live knowledge base: what is searchable, what a proposal search answers, responses, states, retries, ids and headers."""

import html
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
#: Texts for models, with places for values in braces. A stored text of the same name goes before them.
PROMPTS = {
    "pre_filter": 'Decide whether the question belongs to city services. Question: {question}\nReply as JSON: {{"valid": true, "reason": "", "clean_question": ""}}',
    "relevance": 'Does the passage answer the question?\nQuestion: {question}\nPassage: {passage}\nReply as JSON: {{"relevant": true, "reason": "", "reformulated_question": ""}}',
    "batch_judge": "Judge each numbered candidate for the question.\nQuestion: {question}\nCandidates:\n{candidates}",
    "proposal_reformulate": 'Write the proposal as one plain sentence: {question}\nReply as JSON: {{"clean_request": ""}}',
    "proposal_topic": 'Is the topic the same?\nProposal: {question}\nTopic: {topic}\nReply as JSON: {{"relevant": true, "reason": ""}}',
    "extract_answer": "Answer from the text alone.\nQuestion: {question}\nText: {text}",
    "summary": "Summarise in three sentences: {text}",
    "ocr": "Write down the text of the picture as markdown, tables as tables.",
}


def searchable(active: Column, deleted: Column, level: Column) -> Column:
    """Only active child chunks that aren't deleted; a missing flag isn't one."""
    return F.coalesce(active, F.lit(False)) & ~F.coalesce(deleted, F.lit(True)) & F.coalesce(level == "child", F.lit(False))


def proposal_contexts(contexts: DataFrame, by: str, limit: int, order: list[Column | str]) -> DataFrame:
    """The first contexts of each query that are proposals and have any content."""
    own = contexts.where((F.col("source_type") == "usulan") & (F.length(F.trim(F.coalesce("content", F.lit("")))) > 0))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= limit)


def proposals(contexts: DataFrame, hits: DataFrame, topics: DataFrame, by: str, *, limit: int = 5, threshold: float = 0.85) -> DataFrame:
    """by, id, score, note, status and place of what a proposal search answers.

    contexts (by, id, source_type, content, score, rank) go before hits (by, id, score, rank), which count only for queries without any. Of hits those over
    the threshold are given, or, if there are none, the rest. topics (by, relevant): a query whose topic the judge doesn't
    take gives nothing; without a verdict it does.
    """
    own = proposal_contexts(contexts, by, limit, ["rank", "id"]).select(by, "id", F.col("score"), F.lit("graph").alias("note"), F.lit(True).alias("accepted"))
    other = hits.join(own.select(by).distinct(), by, "left_anti").where(F.col("rank") <= limit)
    other = other.select(by, "id", "score", F.when(F.col("score") >= threshold, "relevant").otherwise("-").alias("note"), (F.col("score") >= threshold).alias("accepted"))
    every = own.unionByName(other).withColumn("some", F.max("accepted").over(Window.partitionBy(by))).where(F.col("accepted") == F.col("some"))
    every = every.join(topics, by, "left").where(~F.col("some") | F.coalesce("relevant", F.lit(True)))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 3)), "id"))
    return every.select(by, "id", F.round("score", 3).alias("final_score"), "note", F.when(F.col("some"), "success").otherwise("low_confidence").alias("status"), place.alias("place"))


def success_payload(source: Column, question: Column, answer_id: Column, answer: Column, score: Column, note: Column, checked: Column, total: Column, asked: Column) -> Column:
    """The response to a question whose candidate was chosen, as JSON; nulls are left out."""
    text, other = source == "text", source.isin("document", "web")
    shown = F.struct(
        F.when(text, question).otherwise("").alias("question"), F.when(text, question).otherwise("").alias("question_rag_name"), F.when(text, answer_id).alias("answer_id"),
        F.when(other, answer).otherwise("").alias("answer_doc"), score.alias("final_score"), note.alias("note"),
    )
    meta = F.struct(asked.alias("original_question"), score.alias("final_score_top"), checked.alias("candidates_checked"), total.alias("total_candidates"))
    return F.to_json(F.struct(F.lit("success").alias("status"), source.alias("source"), F.struct(F.array(shown).alias("similar_questions"), meta.alias("metadata")).alias("data")))


def low_confidence_payload(source: Column, question: Column, answer_id: Column, answer: Column, score: Column, checked: Column, total: Column, asked: Column) -> Column:
    """The response to a question for which no candidate was relevant: the best one, its answer cut at 500 characters."""
    cut = F.when(F.length(answer) > 500, F.concat(F.substring(answer, 1, 500), F.lit("..."))).otherwise(answer)
    shown = F.struct(question.alias("question"), question.alias("question_rag_name"), answer_id.alias("answer_id"), cut.alias("answer_doc"), score.alias("final_score"), F.concat(F.lit("not_relevant_checked_"), checked.cast("string")).alias("note"))
    meta = F.struct(asked.alias("original_question"), score.alias("final_score_top"), checked.alias("candidates_checked"), total.alias("total_candidates"))
    data = F.struct(F.when(source.isNotNull(), F.array(shown)).otherwise(F.array().cast("array<struct<question:string,question_rag_name:string,answer_id:string,answer_doc:string,final_score:double,note:string>>")).alias("similar_questions"), meta.alias("metadata"))
    return F.to_json(F.struct(F.lit("low_confidence").alias("status"), F.coalesce(source, F.lit("none")).alias("source"), data.alias("data")))


def descriptor(text: Column) -> Column:
    """Source type and id of a whole or a short descriptor; both empty if it is neither."""
    t = F.trim(F.coalesce(text, F.lit("")))
    whole, short = r"(?s)^kb:[^:]*:(text|document|web|usulan):(.+)$", r"(?s)^(text|document|web|usulan):(.+)$"
    pattern = F.when(t.rlike(whole), F.lit(whole)).otherwise(F.lit(short))
    pick = lambda i: F.when(t.rlike(whole), F.regexp_extract(t, whole, i)).otherwise(F.regexp_extract(t, short, i))
    return F.when(pattern.isNotNull(), F.struct(pick(1).alias("source_type"), pick(2).alias("source_id")))


def _line(name: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value))


def ingestion_text(kind: Column, title: Column, body: Column, *, category: Column, organization: Column, file: Column, url: Column, request_id: Column, answer: Column) -> Column:
    """The text of a source as it is indexed: a header by its type, and its body."""
    asked, answered = F.when(F.length(body) > 0, F.concat(F.lit("\nQuestion:\n"), body)), F.when(F.length(answer) > 0, F.concat(F.lit("\nAnswer:\n"), answer))
    head = F.concat(F.lit("Title: "), title)
    return (
        F.when(kind == "text", F.concat_ws("\n", head, _line("Category", category), asked, answered))
        .when(kind == "document", F.concat(F.concat_ws("\n", head, _line("Organization", organization), _line("File", file)), F.lit("\n\n"), body))
        .when(kind == "web", F.concat(head, F.lit("\nURL: "), url, F.lit("\n\n"), body))
        .when(kind == "usulan", F.concat_ws("\n", head, _line("Organization", organization), _line("Request-ID", request_id), asked))
    )


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based UUID of a text (RFC 9562, version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescaped(df: DataFrame, column: str) -> DataFrame:
    """df with character references in a column resolved; only rows that may have any go through Python."""

    return df.withColumn(column, F.when(F.contains(column, F.lit("&")), _unescape(F.when(F.contains(column, F.lit("&")), F.col(column)))).otherwise(F.col(column)))


def json_of(reply: str | None) -> str | None:
    """The first JSON object in a reply: of its fenced block, or of the text; nested objects and strings with braces are read whole."""
    text = (reply or "").strip()
    if "```" in text:
        inner = text.split("```", 2)[1]
        text = inner[4:] if inner[:4].lower() == "json" else inner
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def json_column(column: Column) -> Column:
    """json_of() over a column, in Arrow batches."""
    return _json_of(column)


@F.pandas_udf(StringType())
def _json_of(replies: pd.Series) -> pd.Series:
    return replies.map(json_of)


def relevance_of(found: Column) -> Column:
    """The verdict in a judge's JSON; what can't be read counts as relevant."""
    return F.coalesce(F.get_json_object(found, "$.relevant") == "true", F.lit(True))


def page_ocr(first: Column, again: Column, least: int = 20) -> Column:
    """A page's text: of too short a first reading and that at a higher resolution the longer one."""
    a, b = F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(again, F.lit("")))
    return F.when((F.length(a) < least) & (F.length(b) > F.length(a)), b).otherwise(a)


def ocr_wait(status: Column, attempt: Column) -> Column:
    """Seconds to wait before a picture is sent again: 10 an attempt if there were too many, 5 after a server's error; null: don't send it again."""
    return F.when(status == 429, attempt * 10).when((status >= 500) & (status <= 599), attempt * 5)


def fetch_error(status: Column, error: Column) -> Column:
    """Code and whether another attempt is made, of a request that failed; null if it didn't."""
    code = F.when(error == "timeout", "timeout").when(error == "connect", "connection_error").when(error == "empty", "empty_content").when(error.isNotNull(), "request_error").when(status >= 400, "http_status_error")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), code.isin("timeout", "connection_error", "request_error").alias("again")))


def download_error(status: Column) -> Column:
    return F.when(status == 404, "file_not_found").when(status == 403, "file_forbidden").when((status >= 500) & (status <= 599), "file_server_error").when(status >= 400, "file_http_error")


def percent(value: Column) -> Column:
    """A number from 0 to 100; what isn't one is 0."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def setting(value: Column, kind: str, default: Column) -> Column:
    """A setting as int, double, boolean or array<string>; the default if it is empty or can't be read."""
    v = F.trim(F.coalesce(value, F.lit("")))
    if kind == "boolean":
        return F.when(v == "", default).otherwise(F.lower(v).isin("1", "true", "yes", "on"))
    if kind == "array<string>":
        own = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(own) == 0, default).otherwise(own)
    return F.coalesce(v.try_cast(kind), default)


def state_of(states: DataFrame, wanted: DataFrame, id_col: str, field: str) -> DataFrame:
    """The state of each wanted key: that with its id, or else, of those that name it in a field, the one with the lowest id."""
    by_id = states.select(F.col(id_col).alias("k"), F.struct(*states.columns).alias("own"))
    by_field = states.groupBy(F.col(field).alias("k")).agg(F.min_by(F.struct(*states.columns), id_col).alias("other"))
    keys = wanted.select("k")
    return keys.join(by_id, "k", "left").join(by_field, "k", "left").select("k", F.coalesce("own", "other").alias("state"))


def zipped(df: DataFrame, questions: str, answers: str) -> DataFrame:
    """A row for each question with the answer at its place; the longer list is cut."""
    n = F.least(F.size(questions), F.size(answers))
    pairs = F.arrays_zip(F.slice(questions, F.lit(1), n).alias("question"), F.slice(answers, F.lit(1), n).alias("answer"))
    return df.select(*(c for c in df.columns if c not in (questions, answers)), F.posexplode(pairs).alias("place", "pair")).select("*", F.col("pair.question").alias("question"), F.col("pair.answer").alias("answer")).drop("pair")


def table_rows(tables: DataFrame, by: list[str]) -> DataFrame:
    """by, row_start and text of each row of tables (by, row, cells): the header row over it; a table of one row is its header alone."""
    text = F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")
    w = Window.partitionBy(*by)
    own = tables.withColumn("line", text).withColumn("header", F.min_by("line", "row").over(w)).withColumn("rows", F.count("*").over(w)).withColumn("first", F.min("row").over(w))
    any_cell = F.exists("cells", lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    own = own.where(any_cell & ((F.col("row") > F.col("first")) | (F.col("rows") == 1)))
    return own.select(*by, (F.col("row") - F.col("first")).alias("row_start"), F.when(F.col("rows") == 1, F.col("line")).otherwise(F.concat_ws("\n", "header", "line")).alias("text"))


def web_state(states: DataFrame, log: DataFrame, key: str, order: str) -> DataFrame:
    """The states after the last action of each key: delete, register_inactive, edit, sync_done and sync_failed; other keys stay.

    states: key, status, is_active, url, hash. log: key, order, action, url, hash.
    """
    last = log.groupBy(key).agg(F.max_by(F.struct("action", F.col("url").alias("new_url"), F.col("hash").alias("new_hash")), order).alias("l")).select(key, "l.*")
    both = states.join(last, key, "full")
    a = F.col("action")
    status = F.when(a == "delete", "deleted").when(a == "register_inactive", F.coalesce("status", F.lit("inactive"))).when(a.isin("edit", "sync_done"), "scraped").when(a == "sync_failed", "failed").otherwise(F.col("status"))
    active = F.when(a.isin("delete", "register_inactive"), False).when(a == "sync_done", True).otherwise(F.coalesce("is_active", F.lit(True)))
    changed = a.isin("edit", "sync_done")
    return both.select(key, status.alias("status"), active.alias("is_active"), F.coalesce(F.when(a != "delete", F.col("new_url")), F.col("url")).alias("url"), F.when(changed, F.coalesce("new_hash", "hash")).otherwise(F.col("hash")).alias("hash"))


def first_in_flight(jobs: DataFrame, key: str, at: str, done: str, *ties: str) -> DataFrame:
    """Jobs with whether they run: not while one that was asked for before, for the same key, is under way."""
    earlier = F.max(done).over(Window.partitionBy(key).orderBy(at, done, *ties).rowsBetween(Window.unboundedPreceding, -1))
    return jobs.withColumn("runs", F.coalesce(earlier <= F.col(at), F.lit(True)))


def cache_hits(reads: DataFrame, by: str, order: str, key: list[str]) -> DataFrame:
    """Reads with whether a cache of one entry, named by path, time, size and resolution, has them."""
    own = F.struct(*key)
    return reads.withColumn("hit", F.coalesce(F.lag(own).over(Window.partitionBy(by).orderBy(order)) == own, F.lit(False)))
