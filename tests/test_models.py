from __future__ import annotations

import json

from pyspark.sql import functions as F

from moraine.operators import models


class Says:
    """Replies by what the prompt holds."""

    def __init__(self, replies: dict[str, str | None]):
        self.replies = replies

    def ask(self, prompts):
        if any("crash" in p for p in prompts):
            raise RuntimeError("down")
        return [next((r for k, r in self.replies.items() if k in p), None) for p in prompts]


def test_questions_pass_where_the_model_fails(spark):
    rows = [(1, "cara urus ktp"), (2, "jalan rusak sekali"), (3, "harga di jakarta"), (4, "crash the model"), (5, "tanpa balasan apa"), (6, None)]
    q = spark.createDataFrame(rows, "id int, text string").repartition(6)
    model = Says({"ktp": '```json\n{"valid": true, "clean_question": "urus ktp"}\n```', "rusak": 'ya {"valid": false, "reason": "keluhan"}', "tanpa": "bukan JSON"})
    got = {r.id: (r.valid, r.reason, r.clean_question) for r in models.prefiltered(q, model, F.col("text")).collect()}
    assert got[1] == (True, None, "urus ktp") and got[2][:2] == (False, "keluhan") and got[3][:2] == (False, "outside:jakarta")
    assert got[4][0] and got[5][0] and got[6][:1] == (True,)


def test_judge_chooses_nothing_where_it_fails(spark):
    rows = [(q, f"tanya {q}", r, s, "isi") for q in (1, 2, 3) for r, s in ((1, "web"), (2, "document"))]
    c = spark.createDataFrame(rows, "qid int, question string, rank int, source string, content string")
    good = [{"rank": 1, "relevant": True, "confidence": 0.99, "answer": "dari web"}, {"rank": 2, "relevant": True, "confidence": 0.9, "answer": "dari dokumen"}]
    model = Says({"tanya 1": json.dumps({"assessments": good}), "tanya 2": json.dumps({"assessments": good[:1]}), "tanya 3": json.dumps({"assessments": [good[0], good[1] | {"answer": "Tidak ditemukan"}]})})
    got = {r.qid: (r.source, r.answer) for r in models.judged(c, model, lambda q, rows: F.concat_ws(" ", q, rows)).collect()}
    assert got == {1: ("document", "dari dokumen"), 3: ("web", "dari web")}


def test_pages_are_fetched_and_tried_again(spark):
    seen: dict[str, int] = {}

    def fetch(url):
        seen[url] = seen.get(url, 0) + 1
        if url.endswith("/flaky") and seen[url] < 2 or url.endswith("/down"):
            raise OSError("no route")
        return (404, None, "not found") if url.endswith("/none") else (200, "<p>x</p>", None)

    urls = spark.createDataFrame([(f"http://a.b/{p}",) for p in ("ok", "flaky", "none", "down")], "url string")
    got = {r.url.rpartition("/")[2]: (r.status, r.html, r.error) for r in models.fetched(urls, fetch, gap_s=0.0, retries=2).collect()}
    assert got == {"ok": (200, "<p>x</p>", None), "flaky": (200, "<p>x</p>", None), "none": (404, None, "not found"), "down": (0, None, "no route")}


def test_statuses_are_delivered(spark):
    def send(record):
        if record["id"] == 2:
            raise OSError("refused")

    got = {r.id: r.sent for r in models.delivered(spark.createDataFrame([(1,), (2,)], "id int"), send, wait_s=0.0).collect()}
    assert got == {1: True, 2: False}
