"""What queries do more than once, by their plans."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moraine import session
from moraine.functions import text as T
from moraine.operators import chunking, context, layout, vector
from moraine.plans import registry
from moraine.sources import files, html


@pytest.mark.parametrize("name", ["proposal_search", "judge_select", "candidate_merge", "acceptance_ladder"])
def test_the_search_runs_once(spark, monkeypatch, name):
    """A search that is read several times is written, or read once."""
    ran, real = [], vector.top_k
    monkeypatch.setattr(vector, "top_k", lambda *a, **b: ran.append(1) or real(*a, **b))
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(ran) == 1 and df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 3


def test_rows_leave_the_worker_in_small_batches(spark, monkeypatch):
    """However many rows a batch has, and however many rows each gives, what is held at once is bounded, and what reaches Python is cut by bytes."""
    runs = []
    monkeypatch.setattr(session, "map_batches", lambda df, run, schema: runs.append(run))
    text = "\n\n".join(f"Paragraph {i} has these words and then some more of them." for i in range(60))
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "x")], "page_id long, html string")
    chunking.chunk_texts(docs), html.read_chunks(pages), html.read_selected(pages, "article"), files.read_markdown(docs)
    for run, value in zip(runs, (text, f"<article><p>{text}</p></article>", f"<article><p>{text}</p></article>", text), strict=True):
        got = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array([value] * 900)], names=["id", "text"])])))
        assert len(got) > 2 and max(b.num_rows for b in got) <= session.OUT_ROWS and max(b.nbytes for b in got) < 3 * session.OUT_CHARS
        assert {i for b in got for i in b.column(0).to_pylist()} == set(range(900))


def test_batches_of_texts_are_cut_by_bytes(spark):
    """The session's batches are small once such a map is planned."""
    docs = spark.createDataFrame([(i, "word " * 20_000) for i in range(200)], "doc_id long, text string").coalesce(1)
    sizes = session.map_batches(docs, lambda parts: (pa.RecordBatch.from_arrays([pa.array([p.nbytes])], names=["n"]) for p in parts), "n long").collect()
    assert len(sizes) > 3 and max(r.n for r in sizes) < 2 * session.ARROW_BYTES


def test_contexts_by_document(spark):
    """Looked up within the document, contexts are the same as by joins; ids of other documents aren't reached, and hits that are there twice stay twice."""
    rows = [(d, f"{d}{c}", t, p and f"{d}{p}", a and f"{d}{a}", b and f"{d}{b}") for d in (1, 2) for c, t, p, a, b in [("a", "self text.", "p", "b", "c"), ("b", "before", "p", None, None), ("c", "after", "p", None, None), ("d", "open:", "q", "b", "e"), ("e", "next of q", "q", None, None), ("f", "lone", "q", "b", "c")]]
    c = spark.createDataFrame(rows + [(1, "1p", "the parent", None, None, None)], "doc int, chunk_id string, text string, parent_chunk_id string, window_prev_id string, window_next_id string")
    hits = c.unionByName(c.where("chunk_id = '2a'"))
    for of in (context.document_context, context.web_context):
        want, got = (sorted((r.chunk_id, r.context) for r in x.collect()) for x in (of(hits, c), of(hits, c, "doc")))
        assert got == want and len(got) == 14


@pytest.mark.parametrize("name", ["document_context", "web_context"])
def test_contexts_shuffle_texts_once(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_scan_shuffles_blocks_once(spark):
    """One exchange of the blocks and two for the boxes, which are a distinct of the blocks' pages."""
    df = registry.QUERIES["layout_scan"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3


def test_scan_by_its_steps(spark):
    """Repeated margins, tables, columns and nulls give what the single operators give one after the other."""
    rows = [(d, p, t, float(x), float(y), x + 200.0, y + 12.0, 20.0 if y == 300 else 11.0, y == 400, 595.0, 842.0) for d in (1, 2) for p in (1, 2, 3) for t, x, y in [(f"Head {p}", 40, 20), (f"Head {p}", 40, 500), ("left", 40, 100), ("Right title", 320, 100), ("  ", 320, 200), (f"Only {d * p}", 40, 300), (None, 40, 400), ("In a table", 45, 600), ("low", 320, 820 if p == d else 700)]]
    rows += [(3, 1, "One page", 40.0, 20.0, 90.0, 32.0, 11.0, False, 595.0, 842.0), (None, 1, "x", 1.0, 1.0, 2.0, 2.0, 1.0, False, 595.0, 842.0), (1, None, "Head 9", 40.0, 20.0, 90.0, 32.0, 11.0, False, 595.0, 842.0), (1, 1, "no place", None, None, None, None, None, None, 595.0, 842.0)]
    raw = spark.createDataFrame(rows, "doc_id int, page_number int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, page_width double, page_height double")
    boxes = spark.createDataFrame([(1, 1, 30.0, 590.0, 300.0, 640.0), (1, 1, 30.0, 590.0, 300.0, 640.0), (2, 3, 30.0, 590.0, 300.0, 640.0), (9, 9, 0.0, 0.0, 1.0, 1.0), (1, None, 0.0, 0.0, 600.0, 900.0), (1, 2, None, 0.0, 600.0, 900.0)], "doc_id int, page_number int, x0 double, y0 double, x1 double, y1 double")
    by = ["doc_id", "page_number"]
    own = layout.without_tables(layout.without_noise(raw), boxes, by).withColumn("text", T.squeezed(F.col("text")))
    own = own.join(layout.columns_of(own, by), by).join(layout.median_fonts(own, by), by).where("text <> ''")
    bag = lambda df: sorted(map(repr, df.select(*by, "text", "x0", "y0", "two_columns", "median_font").collect()))
    got = layout.scan(raw, boxes)
    assert bag(got) == bag(own) and got.count() > 20 and got.where("two_columns").count() > 0


@pytest.mark.parametrize("n,m,dim", [(10_000, 180_000, 384), (130_000, 1_800_000, 384), (600_000, 600_000, 64)])
def test_cells_are_bounded_and_large(spark, n, m, dim):
    """A worker's queries and the corpus behind them keep to their bytes; the corpus isn't cut finer than that unless a cell still has many rows."""
    count = lambda rows: spark.range(rows).select("id", F.array_repeat(F.lit(1.0).cast("float"), dim).alias("v"))
    few = spark.range(1).select(F.array_repeat(F.lit(1.0).cast("float"), dim).alias("v"))
    sized = type("Sized", (), {"agg": lambda self, *a: type("Row", (), {"first": lambda self: (n, few.select(F.size("v")).first()[0])})(), "sparkSession": spark})()
    q, c = vector._cells(sized, count(m).select("id"), "v", 25, (True, True))
    assert n / q * (8 * dim + 16 * 25 + 32) <= vector.QUERY_BYTES * 1.01 and m / c * (4 * dim + 8) <= vector.CORPUS_BYTES * 1.01
    assert m / c >= min(vector.CELL_ROWS, m) or c == -(-m * (4 * dim + 8) // vector.CORPUS_BYTES)
