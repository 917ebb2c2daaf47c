"""Ranking of candidates: per-key best, boosts, balanced top-n, judge contract and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import text as T

PRIORITY = {"text": 1, "document": 2, "web": 3}


def priority(source: Column) -> Column:
    """Rank of a source; web_scraping is web; unknown sources come last."""
    table = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.when(source == "web_scraping", "web").otherwise(source)), F.lit(99))


def best_per_key(hits: DataFrame, by: list[str], key: Column, score: str, *ties: str) -> DataFrame:
    """The best row of each key within by; the first of ties wins."""
    w = Window.partitionBy(*by, key).orderBy(F.desc(score), *ties)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_n(rows: DataFrame, by: list[str], n: int, *order: Column | str, name: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def balanced(rows: DataFrame, by: list[str], source: str, score: str, *, per_source: int = 3, total: int = 9, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """At most per_source rows of each source, sources by priority, total rows in all."""
    first = top_n(rows, [*by, source], per_source, F.desc(score), *ties, name="source_rank")
    return top_n(first.withColumn("priority", priority(F.col(source))), by, total, "priority", F.desc(score), *ties)


def boosted(candidates: DataFrame, question: str = "question", by: str = "qid", source: str = "source", score: str = "final_score") -> DataFrame:
    """Scores of text candidates of administrative questions raised by 15 per cent, unless documents clearly lead."""
    w = Window.partitionBy(by)
    doc = F.max(F.when(F.col(source) == "document", F.col(score))).over(w)
    text = F.max(F.when(F.col(source) == "text", F.col(score))).over(w)
    raise_ = doc.isNull() | (doc < 0.85) | ((text >= 0.70) & (doc - text < 0.15))
    use = (F.col(source) == "text") & T.is_administrative(F.col(question)) & raise_
    return candidates.withColumn("boosted", use).withColumn(score, F.when(F.col("boosted"), F.round(F.least(F.col(score) * 1.15, F.lit(1.0)), 4)).otherwise(F.col(score)))


def merged_sources(contexts: DataFrame, by: list[str], *, limit: int = 6000) -> DataFrame:
    """One row per source and source id: contents in order of rank that the text so far doesn't hold, a blank line apart, cut at limit; the best score."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content")))
    fold = F.aggregate(ordered, F.lit(""), lambda acc, x: F.when((F.trim(x["content"]) == "") | x["content"].isNull() | F.contains(acc, x["content"]), acc).when(acc == "", x["content"]).otherwise(F.concat(acc, F.lit("\n\n"), x["content"])))
    return contexts.groupBy(*by).agg(F.substring(fold, 1, limit).alias("content"), F.max("score").alias("score"), F.min("rank").alias("rank"))


ASSESSMENTS = "array<struct<rank:int,relevant:boolean,confidence:double,answer:string,reason:string>>"


def assessments(reply: Column) -> Column:
    """The assessments in a judge's reply, fenced or not; null where it isn't JSON of that shape."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    return F.from_json(body, f"struct<assessments:{ASSESSMENTS}>")["assessments"]


def contract_problem(items: Column, n: Column, sources: Column) -> Column:
    """Why the assessments of n candidates break the contract; null if they keep it. sources: of the candidates, by rank.

    Ranks must be 1..n, each once; relevance and a confidence in 0..1 must be there; an irrelevant or text candidate has no
    answer, and a relevant one of another source has one.
    """
    ranks = F.array_sort(F.transform(items, lambda a: a["rank"]))
    answered = lambda a: F.trim(F.coalesce(a["answer"], F.lit(""))) != ""
    wants = lambda a: a["relevant"] & (F.try_element_at(sources, a["rank"]) != "text")
    return (
        F.when(items.isNull(), "not_json")
        .when((n == 0) | (F.size(items) != n) | (ranks != F.sequence(F.lit(1), F.greatest(n, F.lit(1)))), "ranks")
        .when(F.exists(items, lambda a: a["relevant"].isNull()), "relevant")
        .when(F.exists(items, lambda a: a["confidence"].isNull() | (a["confidence"] < 0) | (a["confidence"] > 1)), "confidence")
        .when(F.exists(items, lambda a: ~wants(a) & answered(a)), "unexpected_answer")
        .when(F.exists(items, lambda a: wants(a) & ~answered(a)), "missing_answer")
    )


def judged(rows: DataFrame, by: str = "qid", *, least: float = 0.85) -> DataFrame:
    """Of relevant candidates at or over the least confidence the one of the first source, then of the highest confidence, then of the lowest rank."""
    use = rows.where(F.col("relevant") & (F.col("confidence") >= F.lit(max(0.85, least))))
    return top_n(use.withColumn("priority", priority(F.col("source"))), [by], 1, "priority", F.desc("confidence"), "rank", name="choice").drop("choice")
