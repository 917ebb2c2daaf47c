"""Calls to what lies outside: language models, web servers, and receivers of status. Each is a plug-in that executors call in batches.

A filter by a model lets a question through if the model fails or its reply can't be read; a judge that fails chooses nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators import ranking


class Model(Protocol):
    def ask(self, prompts: list[str]) -> list[str | None]:
        """A reply to each prompt; null where there is none."""


#: An address to its status, page and error; the error is null where there is a page.
Fetch = Callable[[str], tuple[int, str | None, str | None]]


def json_in(reply: Column) -> Column:
    """The JSON object in a reply, fenced or not; null where there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(reply, r"(?s)(\{.*\})", 1)), F.lit(""))


def replied(rows: DataFrame, model: Model, *, prompt_col: str = "prompt", reply_col: str = "reply", batch: int = 20) -> DataFrame:
    """rows with the model's reply to each prompt; null prompts aren't asked, and a call that fails gives null."""
    names = rows.columns
    schema = rows.select("*").schema.add(reply_col, "string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[str | None] = [None] * len(part)
            at = [i for i, p in enumerate(part[prompt_col]) if p is not None]
            for k in range(0, len(at), batch):
                own = at[k : k + batch]
                try:
                    for i, r in zip(own, model.ask([part[prompt_col].iloc[i] for i in own])):
                        out[i] = r
                except Exception:  # noqa: BLE001  what a plug-in raises isn't known; the policy for a missing reply is the caller's
                    continue
            yield part.assign(**{reply_col: pd.Series(out, index=part.index, dtype=object)})[[*names, reply_col]]

    return rows.mapInPandas(run, schema)


def prefiltered(questions: DataFrame, model: Model, prompt: Column, *, text_col: str = "text") -> DataFrame:
    """questions with valid, reason and clean_question. What the rules refuse isn't asked; without a reply that can be read a question is valid."""
    refused = T.hard_filter(F.col(text_col))
    asked = replied(questions.withColumn("_refused", refused).withColumn("prompt", F.when(refused.isNull(), prompt)), model)
    said = F.from_json(json_in(F.col("reply")), "valid boolean, reason string, clean_question string")
    out = asked.withColumn("_said", said)
    valid = F.col("_refused").isNull() & F.coalesce(F.col("_said.valid"), F.lit(True))
    clean = F.coalesce(F.nullif(F.trim("_said.clean_question"), F.lit("")), F.col(text_col))
    return out.select(*questions.columns, valid.alias("valid"), F.coalesce("_refused", F.when(~valid, F.col("_said.reason"))).alias("reason"), clean.alias("clean_question"))


def judged(candidates: DataFrame, model: Model, prompt: Callable[[Column, Column], Column], *, by: str = "qid", question: str = "question", most: int = 9, content_chars: int = 2000) -> DataFrame:
    """The candidate chosen for each question (by, rank, source, confidence, answer); none where the reply breaks the contract.

    candidates: by, question, rank, source, content. Of the first `most` the contents go to the model, cut to content_chars.
    """
    seen = candidates.where(F.col("rank") <= most)
    row = F.struct("rank", "source", F.substring("content", 1, content_chars).alias("content"))
    grouped = seen.groupBy(by).agg(F.first(question).alias("question"), F.array_sort(F.collect_list(row)).alias("rows"))
    asked = replied(grouped.withColumn("prompt", prompt(F.col("question"), F.to_json("rows"))), model).withColumn("items", ranking.assessments(F.col("reply")))
    sources = F.transform("rows", lambda r: r["source"])
    kept = asked.where(ranking.contract_problem(F.col("items"), F.size("rows"), sources).isNull()).select(by, F.inline("items"))
    rows = kept.join(seen.select(by, "rank", "source"), [by, "rank"])
    usable = (F.col("source") == "text") | (T.answer_problem(F.col("answer")).isNull() & ~T.is_negative(F.col("answer")))
    return ranking.judged(rows.where(usable), by).select(by, "rank", "source", "confidence", "answer")


def fetched(urls: DataFrame, fetch: Fetch, *, url_col: str = "url", gap_s: float = 2.0, retries: int = 3) -> DataFrame:
    """urls with status, html and error. A domain's pages are one task's, which leaves gap_s between them; failures to connect are tried again after 1, 2, 4 ... seconds."""
    schema = urls.select("*").schema.add("status", "integer").add("html", "string").add("error", "string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for part in parts:
            got = []
            for url, host in zip(part[url_col], part["_domain"]):
                for attempt in range(retries):
                    wait = last.get(host, 0.0) + gap_s - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    last[host] = time.monotonic()
                    try:
                        got.append(fetch(url))
                        break
                    except OSError as e:
                        if attempt + 1 == retries:
                            got.append((0, None, str(e)[:200]))
                        else:
                            time.sleep(2**attempt)
            part = part.drop(columns="_domain").assign(status=[g[0] for g in got], html=pd.Series([g[1] for g in got], index=part.index, dtype=object), error=pd.Series([g[2] for g in got], index=part.index, dtype=object))
            yield part.astype({"status": "int32"})

    return urls.withColumn("_domain", T.domain(F.col(url_col))).repartition("_domain").mapInPandas(run, schema)


def delivered(rows: DataFrame, send: Callable[[dict], None], *, attempts: int = 3, wait_s: float = 5.0) -> DataFrame:
    """rows with sent: whether the receiver took each within the attempts. For foreachBatch; a batch that runs again sends again."""
    schema = rows.select("*").schema.add("sent", "boolean")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ok = []
            for record in part.to_dict("records"):
                for attempt in range(attempts):
                    try:
                        send(record)
                        ok.append(True)
                        break
                    except OSError:
                        if attempt + 1 == attempts:
                            ok.append(False)
                        else:
                            time.sleep(wait_s)
            yield part.assign(sent=ok)

    return rows.mapInPandas(run, schema)
