from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from moraine.llm import licenses as lic
from moraine.llm.common import word_hashes
from tests.compare import DATA
from tests.llm.fixtures import LONG, bad_docs


def brute(text: str | None, k: int = 3, slack: int = 8, threshold: float = 0.8) -> list[tuple]:
    """Diagonals, spans and the choice among them with loops."""
    h = word_hashes(pa.array([(text or "").lower()]))[0].tolist()
    places: dict[tuple, list[int]] = {}
    for i in range(len(h) - k + 1):
        places.setdefault(tuple(h[i : i + k]), []).append(i)
    spans = []
    for name, own in lic.TEMPLATES.items():
        t = word_hashes(pa.array([own.lower()]))[0].tolist()
        hits = sorted((i - j, i, j) for j in range(len(t) - k + 1) for i in places.get(tuple(t[j : j + k]), ()))
        groups: list[list[tuple]] = []
        for x in hits:
            if groups and x[0] - groups[-1][-1][0] <= min(slack, len(t) // 4):
                groups[-1].append(x)
            else:
                groups.append([x])
        for gr in groups:
            held = {j + d for _, _, j in gr for d in range(k)}
            begin, end = min(i for _, i, _ in gr), max(i for _, i, _ in gr) + k
            if round(len(held) / len(t), 6) >= threshold and end - begin <= len(t) + slack:
                spans.append((begin, end, name, len(held), round(len(held) / len(t), 6), len(gr)))
    out: list[tuple] = []
    for x in sorted(spans, key=lambda s: (-s[3], -s[4], s[0], s[2])):
        if all(x[1] <= t[0] or t[1] <= x[0] for t in out):
            out.append(x)
    return sorted((*s[2].split("/"), s[0], s[1], s[5], s[4]) for s in out)


def got(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.licence, r.form, r.begin, r.end, r.votes, r.coverage))
    return {i: sorted(v) for i, v in out.items()}


def test_against_brute_force(spark):
    rows = list(zip(*(pq.read_table(DATA / "sf0.01/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))
    want = {i: b for i, t in rows if (b := brute(t))}
    assert want and got(lic.scanned(spark.read.parquet(str(DATA / "sf0.01/documents.parquet")))) == want


MIT = lic.TEMPLATES["MIT/text"]


def test_words_put_in_and_left_out(spark):
    w = MIT.split()
    rows = [(1, "x " + MIT), (2, " ".join([*w[:20], "new", "words", *w[20:]])), (3, " ".join(w[:30] + w[34:])), (4, " ".join(w[:20])), (5, f"{MIT} between {MIT}"), (6, "License MIT the under"), (7, MIT.upper().replace(" ", "\n "))]
    found = got(lic.scanned(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == {i: b for i, t in rows if (b := brute(t))}
    assert {i: [x[0] for x in v] for i, v in found.items()} == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 5: ["MIT", "MIT"], 7: ["MIT"]}


def test_spans_that_only_a_third_overlaps_are_both_kept(spark):
    """A overlaps B and B overlaps C, but A and C stand apart: both of them stay."""
    w = [f"w{i}" for i in range(40)]
    templates = {"A/x": " ".join(w[:14]), "B/x": " ".join(w[10:22]), "C/x": " ".join(w[20:30])}
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    assert sorted((r.licence, r.begin, r.end) for r in lic.scanned(docs, templates=templates).collect()) == [("A", 0, 14), ("C", 20, 30)]


def test_each_template_is_found_as_itself(spark):
    rows = [(i, f"some words {t} and others") for i, t in enumerate(lic.TEMPLATES.values())]
    found = got(lic.scanned(spark.createDataFrame(rows, "doc_id long, text string")))
    names = list(lic.TEMPLATES)
    for i, v in found.items():
        assert (names[i].split("/")[0], "proprietary")[0] in {x[0] for x in v}, (names[i], v)
    assert len(found) == len(rows)


def test_bad_rows(spark):
    more = [(50, MIT, "en", "a"), (50, MIT, "en", "a"), (51, LONG + " All rights reserved", "en", "a")]
    docs = bad_docs(spark).unionByName(bad_docs(spark, more))
    found = got(lic.scanned(docs))
    assert {i: len(v) for i, v in found.items()} == {50: 2, 51: 1}
    assert lic.scanned(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lic.scanned(docs, templates={"x/y": "two words"})
