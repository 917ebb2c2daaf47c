"""Golden cases: small inputs with the results that are expected of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.operators import chunking, context, embedding, layout, maintenance, progress, ranking, vector


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("answer,problem", [("Tidak ditemukan", "not_found"), ("Tidak ditemukan.\n\nDokumen: x", "not_found"), ("Rule 2: jawab", "prompt_leakage"), ("ATURAN KETAT: x", "prompt_leakage"), ("If not found say so", "prompt_leakage"), ("  ", "empty"), (None, "empty"), ("Bawa KTP.", None), ("Tidak ditemukannya itu", None)])
def test_answers(spark, answer, problem):
    assert one(spark, T.answer_problem(F.col("a")), a=answer) == problem


@pytest.mark.parametrize("question,why", [("cara buat ktp di Jakarta", "outside:jakarta"), ("siapa wali kota terbaik", "opinion"), ("ktp", "short"), ("syarat buat ktp", None), ("", "short"), ("pembaikan jalan raya", None)])
def test_refusals(spark, question, why):
    assert one(spark, T.hard_filter(F.col("q")), q=question) == why


@pytest.mark.parametrize("value,want", [('["a-1","a-2"]', ["a-1", "a-2"]), ("['a']", ["a"]), ("a", ["a"]), ("", []), (None, []), ("[]", [])])
def test_answer_ids(spark, value, want):
    assert one(spark, T.parse_answer_id(F.col("v")), v=value) == want


def test_document_ids(spark):
    p = one(spark, T.parsed_document_id(F.col("v")), v="kb:city-main:document:a:b")
    assert (p.kb, p.type, p.id) == ("city-main", "document", "a:b")
    assert one(spark, T.parsed_document_id(F.col("v")), v="kb:city-main:website:123").type is None
    assert one(spark, T.source_type(F.col("v"), F.lit(None), F.lit(None)), v="kb:city-main:website:123") == "unknown"


def test_header(spark):
    made = T.with_header({"Category-ID": F.lit("layanan"), "Answer-ID": F.lit(" "), "Request-ID": F.lit("7")}, F.col("t"))
    text = one(spark, made, t="body\n\nCategory-ID: no")
    assert text == "Category-ID: layanan\nRequest-ID: 7\n\nbody\n\nCategory-ID: no"
    assert one(spark, T.header_value(F.col("t"), "Category-ID"), t=text) == "layanan" and one(spark, T.header_value(F.col("t"), "Answer-ID"), t=text) is None


def test_best_of_each_parent(spark):
    hits = spark.createDataFrame([(0, "p1", 0.91, 1), (0, "p1", 0.82, 2), (0, "p2", 0.80, 3)], "q int, parent string, score double, rank int")
    got = ranking.best_per_key(hits, ["q"], F.col("parent"), "score", "rank").orderBy(F.desc("score")).collect()
    assert [r.score for r in got] == [0.91, 0.80]


@pytest.mark.parametrize("rows,want", [([("web", 0.99), ("document", 0.96), ("text", 0.85)], "text"), ([("text", 0.84), ("web", 0.99), ("document", 0.86)], "document"), ([("web", 0.5)], None)])
def test_choice(spark, rows, want):
    df = spark.createDataFrame([(1, i + 1, s, True, c) for i, (s, c) in enumerate(rows)], "qid int, rank int, source string, relevant boolean, confidence double")
    got = ranking.judged(df).collect()
    assert [r.source for r in got] == ([want] if want else [])


@pytest.mark.parametrize("reply,problem", [
    ('{"assessments":[{"rank":1,"relevant":true,"confidence":0.9,"answer":"x"},{"rank":2,"relevant":false,"confidence":0.1,"answer":""}]}', None),
    ('```json\n{"assessments":[{"rank":1,"relevant":true,"confidence":0.9,"answer":"x"},{"rank":1,"relevant":false,"confidence":0.1}]}\n```', "ranks"),
    ('{"assessments":[{"rank":1,"relevant":true,"confidence":0.9,"answer":""},{"rank":2,"relevant":false,"confidence":0.1}]}', "missing_answer"),
    ('{"assessments":[{"rank":1,"relevant":false,"confidence":0.9,"answer":"x"},{"rank":2,"relevant":false,"confidence":0.1}]}', "unexpected_answer"),
    ('{"assessments":[{"rank":1,"confidence":0.9},{"rank":2,"relevant":false,"confidence":0.1}]}', "relevant"), ("nothing", "not_json"), (None, "not_json"),
])
def test_contract(spark, reply, problem):
    sources = F.array(F.lit("document"), F.lit("text"))
    assert one(spark, ranking.contract_problem(ranking.assessments(F.col("r")), F.lit(2), sources), r=reply) == problem


def chunk_rows(spark):
    rows = [("a", "self text.", "p", "b", "c"), ("b", "before", "p", None, None), ("c", "after", "p", None, None), ("p", "the parent", None, None, None), ("d", "open:", "q", "b", "e"), ("e", "next of q", "q", None, None), ("f", "lone", "q", "b", "c")]
    return spark.createDataFrame(rows, "chunk_id string, text string, parent_chunk_id string, window_prev_id string, window_next_id string")


def test_context(spark):
    c = chunk_rows(spark)
    got = {r.chunk_id: r.context for r in context.document_context(c, c).collect()}
    assert got["a"] == "the parent" and got["d"] == "open:\n\nnext of q" and got["f"] == "lone"
    orphan = c.where("chunk_id <> 'p'")
    assert {r.chunk_id: r.context for r in context.document_context(orphan, orphan).collect()}["a"] == "before\n\nself text.\n\nafter"
    assert {r.chunk_id: r.context for r in context.web_context(orphan, orphan).collect()}["f"] == "before\n\nlone\n\nafter"


def test_two_headings_make_two_parents():
    blocks = [chunking.Block("First text.", heading="A", path=["A"]), chunking.Block("Second text.", heading="B", path=["B"], order=1)]
    got = chunking.chunk_blocks("s", blocks, (80, 200, 0), merge=False)
    children = [c for c in got if c.level == "child"]
    assert len(children) == 2 and len({c.parent for c in children}) == 2 and all(c.prev is None and c.next is None for c in children)
    assert [c.text for c in children] == ["A\nFirst text.", "B\nSecond text."] and chunking.chunk_blocks("s", blocks, (80, 200, 0), merge=False)[0].id == got[0].id


def test_large_blocks_are_cut_and_lose_nothing():
    text = " ".join(f"Sentence number {i} has some words." for i in range(300))
    got = chunking.chunk_blocks(1, [chunking.Block(text, path=["H"])], (80, 200, 0))
    children = [c for c in got if c.level == "child"]
    assert all(chunking.tokens(c.text) <= 100 for c in children)
    assert [w for c in children for w in c.text.split() if w != "H"] == text.split()
    assert [c.next for c in children if c.next] and chunking.chunk_blocks(1, []) == []


def page(spark, rows):
    return spark.createDataFrame([(1, p, t, float(x0), float(y0), float(x1), float(y1), s, False, 595.0, 842.0) for p, t, x0, y0, x1, y1, s in rows], "doc_id int, page_number int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, page_width double, page_height double")


def test_columns_are_read_one_after_the_other(spark):
    raw = page(spark, [(1, "L1", 40, 100, 250, 112, 11.0), (1, "R1", 320, 100, 550, 112, 11.0), (1, "L2", 40, 200, 250, 212, 11.0), (1, "R2", 320, 200, 550, 212, 11.0)])
    own = raw.join(layout.columns_of(raw, ["doc_id", "page_number"]), ["doc_id", "page_number"])
    got = layout.reading_order(own, ["doc_id", "page_number"], F.col("two_columns")).orderBy("block_order").collect()
    assert [r.text for r in got] == ["L1", "L2", "R1", "R2"]


def test_repeated_margins_go(spark):
    raw = page(spark, [(p, t, 40, y, 200, y + 12, 11.0) for p in (1, 2, 3) for t, y in ((f"Header {p}", 20), (f"Body {p} text", 400))])
    assert sorted(r.text for r in layout.without_noise(raw).collect()) == ["Body 1 text", "Body 2 text", "Body 3 text"]


def test_large_fonts_are_headings(spark):
    assert one(spark, T.layout_heading(F.col("t"), F.lit(24.0), F.lit(False), F.lit(11.0)), t="A title") is True
    assert one(spark, T.layout_heading(F.col("t"), F.lit(11.0), F.lit(True), F.lit(11.0)), t="1. listed") is False


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[10] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (None, x[0].tolist())], "vec_id long, embedding array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.rint(n @ n.T * 1e6).astype(int)
    want = {i: [j for j in sorted((j for j in range(300) if j != i), key=lambda j: (-keys[i, j], j))[:4]] for i in range(300)}
    got: dict = {}
    for r in vector.top_k(df, df, 4, query_id="vec_id", exclude_same=True, rows=37).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == want
    assert vector.top_k(df.limit(0), df, 4, query_id="vec_id").count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(1, "satu dua"), (2, "satu dua"), (3, None), (4, "lain")], "id long, text string")
    got = {r.id: r.embedding for r in embedding.embedded(df).collect()}
    assert got[1] == got[2] != got[4] and got[3] is None and abs(sum(v * v for v in got[1]) - 1) < 1e-5


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    c = spark.createDataFrame([(2, "B", 1), (3, "c", 1), (1, "old", 0)], "k int, v string, version int")
    got = maintenance.upserted(t, c, "k", "version")
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(r.k for r in maintenance.deleted(got, t, "k").collect()) == [3]


def test_sources_that_changed(spark):
    col = F.col
    same = dict(u=" x ", v="x", s=None, t="  ", h=True)
    change = maintenance.source_changed(col("u"), col("v"), col("s"), col("t"), col("h"))
    assert one(spark, change, **same) is False
    assert one(spark, change, **(same | {"h": False})) is True and one(spark, change, **(same | {"s": "main"})) is True


def test_progress_lines(spark):
    got = one(spark, progress.parsed(F.col("x"), "page int"), x='PROGRESS {"page": 3}')
    assert got.page == 3 and one(spark, progress.parsed(F.col("x"), "page int"), x='{"page": 3}') is None


@pytest.mark.parametrize("kind,threshold,grouped", [("float", None, False), ("double", None, True), ("float", 0.3, True), ("double", 0.6, False)])
def test_search_over_many_cells(spark, monkeypatch, kind, threshold, grouped):
    """Queries and corpus are cut into several cells each, equal scores and copies lie on the cuts, and some queries have no group."""
    for name, value in (("QUERY_BYTES", 1 << 13), ("CORPUS_BYTES", 1 << 13), ("STRIP", 16)):
        monkeypatch.setattr(vector, name, value)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(700, 4)), 1).astype(np.float32)
    x[::7], x[x.any(axis=1) == 0] = x[3], 1.0
    groups = [None if i % 11 == 0 else f"g{i % 3}" for i in range(700)]
    df = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, groups))] + [(900, None, "g0"), (901, [0.0] * 4, "g1"), (None, [1.0] * 4, "g1")], f"vec_id long, embedding array<{kind}>, g string").repartition(5)
    assert min(vector._cells(df, df, "embedding", 6, (kind == "float", kind == "float"))) > 1
    n = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    keys = np.rint(n @ n.T * 1e6).astype(int)
    want = {}
    for i in range(700):
        may = [j for j in range(700) if j != i and (not grouped or groups[i] is None or groups[i] == groups[j]) and (threshold is None or keys[i, j] >= threshold * 1e6)]
        if may:
            want[i] = sorted(may, key=lambda j: (-keys[i, j], j))[:6]
    got: dict = {}
    for r in vector.top_k(df, df, 6, query_id="vec_id", exclude_same=True, threshold=threshold, group_col="g" if grouped else None, rows=50).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
        assert r.score == keys[r.qid, r.id] / 1e6
    assert got == want


def test_search_shares_no_task_between_partitions(spark):
    """Vectors are packed once for each side, not again for each pair of partitions, and no task has a product of partitions."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>").repartition(6)
    plan = vector.top_k(df, df, 3, query_id="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
