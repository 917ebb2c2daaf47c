from __future__ import annotations

import re

import pyarrow.parquet as pq

from moraine.llm import tiling
from tests.compare import DATA
from tests.llm.fixtures import WORDS, bad_docs, items


def words(text: str | None) -> list[str]:
    return re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (text or "").lower())


def brute(doc: list[str], item: list[str], k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling as it is defined: the longest common run of unmarked words, marked, again and again."""
    used_d, used_i, out = [False] * len(doc), [False] * len(item), []
    places: dict[str, list[int]] = {}
    for d, w in enumerate(doc):
        places.setdefault(w, []).append(d)
    while True:
        best = (0, 0, 0)
        for i, w in enumerate(item):
            for d in places.get(w, ()):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not used_i[i + n] and not used_d[d + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < k:
            return out
        out.append((n, i, d))
        used_i[i : i + n] = [True] * n
        used_d[d : d + n] = [True] * n


def wanted(docs, bench, k=4, threshold=0.5) -> dict:
    out = {}
    for d, text in docs:
        dw = words(text)
        grams = {tuple(dw[i : i + k]) for i in range(len(dw) - k + 1)}
        for i, own in bench:
            iw = words(own)
            if not grams.isdisjoint(tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)):
                tiles = brute(dw, iw, k)
                if tiles and sum(t[0] for t in tiles) / len(iw) >= threshold:
                    out[d, i] = (round(sum(t[0] for t in tiles) / len(iw), 6), len(tiles), max(t[0] for t in tiles))
    return out


def got(df) -> dict:
    rows = df.collect()
    out = {(r.doc_id, r.item_id): (r.coverage, r.tiles, r.longest) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_brute_force(spark):
    d = DATA / "sf0.001"
    docs, bench = (list(zip(*(pq.read_table(d / f"{t}.parquet")[c].to_pylist() for c in cols))) for t, cols in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    want = wanted(docs, bench)
    assert want and got(tiling.contaminated(spark.read.parquet(str(d / "documents.parquet")), spark.read.parquet(str(d / "benchmark.parquet")))) == want


PASSAGE = [f"{w}{i}" for i, w in enumerate(WORDS)]


def test_moved_passages_are_caught(spark):
    moved = " ".join(["before", *PASSAGE[10:], "between", *PASSAGE[:10], "after"])
    half = " ".join([*PASSAGE[:9], *["else"] * 30])
    docs = [(1, moved), (2, half), (3, " ".join(reversed(PASSAGE))), (4, " ".join(PASSAGE).upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = [(0, " ".join(PASSAGE)), (1, "too short"), (2, None)]
    want = wanted(docs, bench)
    assert set(want) == {(1, 0), (4, 0)} and want[1, 0] == (1.0, 2, 10)
    assert got(tiling.contaminated(df, items(spark, bench))) == want
    # a set of items that is too large to be sent to the workers gives the same
    assert got(tiling.contaminated(df, items(spark, bench), filter_seeds=0)) == want


def test_repeated_words_and_ties(spark):
    docs = [(1, "a b c d a b c d a b c d x a b c d"), (2, "a a a a a a a a"), (3, "a b c d")]
    bench = [(0, "a b c d a b c d"), (1, "a a a a a"), (2, "a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(tiling.contaminated(df, items(spark, bench))) == wanted(docs, bench)


def test_bad_rows(spark):
    docs = bad_docs(spark)
    bench = items(spark, [(0, " ".join(f"w{i}" for i in range(500, 520))), (None, "w1 w2 w3 w4 w5"), (3, None), (4, ""), (0, "other text of the same item id")])
    out = tiling.decontaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted([r.doc_id or -1 for r in out.collect()]) == sorted([r.doc_id or -1 for r in docs.collect() if r.doc_id != 6])
    found = tiling.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(6, 0), (6, None)}
    twice = tiling.contaminated(docs.union(docs), bench).collect()
    assert len(twice) == 2
    assert tiling.decontaminated(docs.limit(0), bench).count() == 0
    assert tiling.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_scripts_without_spaces_and_short_items(spark):
    question = "水的沸点是多少摄氏度？在标准大气压下，答案是一百度。"
    docs = [(1, f"前言：{question}结束"), (2, "今天天气很好。我们去公园散步，然后回家吃饭。"), (3, "the Capital of\u00a0France, is"), (4, "capital france of"), (5, "café—au lait")]
    bench = [(0, question), (1, "capital of France"), (2, "lait"), (3, "。？")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (tiling.FILTER_SEEDS, 0):
        found = got(tiling.contaminated(df, items(spark, bench), filter_seeds=limit))
        assert {k: v[0] for k, v in found.items()} == {(1, 0): 1.0, (3, 1): 1.0, (5, 2): 1.0}
