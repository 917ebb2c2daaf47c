from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from moraine.llm import simhash
from tests.compare import DATA
from tests.llm.fixtures import LONG, bad_docs, sentence


def brute_groups(rows: list[tuple[int, str | None]], distance: int = 20) -> dict[int, set[int]]:
    """Positions of rows by group, for groups of two or more, by comparing all pairs."""
    f, has = simhash.fingerprints(pa.array([(t or "").lower() for _, t in rows]))
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1).astype(np.int32)
    apart = bits.sum(1)[:, None] + bits.sum(1)[None, :] - 2 * bits @ bits.T
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(apart <= distance)):
        if i < j and has[i] and has[j]:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    out: dict[int, set[int]] = {}
    for i in range(len(rows)):
        if has[i]:
            out.setdefault(root(i), set()).add(i)
    return {r: g for r, g in out.items() if len(g) > 1}


def survivors(rows, distance=20) -> list[tuple]:
    lost = set()
    for g in brute_groups(rows, distance).values():
        keep = min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
        lost |= g - {keep}
    return [r for i, r in enumerate(rows) if i not in lost]


def test_against_all_pairs(spark, sf="sf0.01"):
    docs = spark.read.parquet(str(DATA / sf / "documents.parquet"))
    rows = list(zip(*(pq.read_table(DATA / sf / "documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))
    want = {}
    for g in brute_groups(rows).values():
        ids = sorted(rows[i][0] for i in g)
        want |= {i: (ids[0], len(ids)) for i in ids[1:]}
    got = {r.doc_id: (r.kept_id, r.members) for r in simhash.duplicates(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in simhash.deduplicated(docs).select("doc_id").collect()}
    assert kept == {i for i, _ in rows} - set(want)


def test_copies_are_caught_and_others_stay(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"t{w}" for w in rng.integers(0, 5000, 200)) for _ in range(40)]
    near = [b.replace(b.split()[3], "changed", 1) for b in base[:20]]
    rows = [(i, t) for i, t in enumerate(base + near + base[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(range(40))


@pytest.mark.parametrize("distance,parts", [(3, 5), (20, 7), (20, None), (20, 4), (0, None)])
def test_pairs_are_exact_at_any_setting(spark, distance, parts):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, (60, 2), dtype=np.int64)
    rows = {tuple(map(int, x)) for x in base}
    for a, b in base[:40]:
        for n in (1, distance or 1, distance + 1):
            flip = rng.choice(126, n, replace=False)
            rows.add((int(a) ^ sum(1 << int(f) for f in flip if f < 63), int(b) ^ sum(1 << int(f - 63) for f in flip if f >= 63)))
    df = spark.createDataFrame(sorted(rows), "a long, b long")
    named = {r.h: (r.a, r.b) for r in df.selectExpr("a", "b", "xxhash64(a, b) AS h").collect()}
    got = [frozenset((named[r.x], named[r.y])) for r in simhash.near_pairs(df, distance, parts).collect()]
    want = {frozenset(p) for p in combinations(rows, 2) if sum((x ^ y).bit_count() for x, y in zip(*p)) <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_probes_stay_out_of_the_driver(spark):
    """Fingerprints that are few enough to be broadcast have far more probes, which are joined by a shuffle."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(int, x)) for x in rng.integers(0, 1 << 62, (200, 2))], "a long, b long")
    pairs = simhash.near_pairs(df, 20)
    pairs.collect()
    ran = pairs._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in ran and "SortMergeJoin" in ran and "Broadcast" not in ran


def test_parts_must_fit(spark):
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([(1, 2)], "a long, b long"), 3, 2)


@pytest.mark.parametrize("distance", [0, 1, 4, 35, 40, 60, 127])
def test_every_distance_has_a_plan(distance):
    chosen = simhash.plan(1000, np.zeros(128), 1000 * np.eye(128), distance, None if distance > 2 else 3)
    assert sum(chosen.thresholds) == distance - len(chosen.bits) + 1
    assert sorted(b for own in chosen.bits for b in own) == list(range(128))


def test_parts_follow_the_number_of_documents():
    """Candidates a document grow far less than the documents do."""
    plans = {n: simhash.plan(n, np.zeros(128), n * np.eye(128), 20) for n in (10**3, 10**5, 10**7, 10**9)}
    parts = [len(p.bits) for p in plans.values()]
    assert parts == sorted(parts, reverse=True) and parts[0] > parts[-1]
    fixed = simhash.plan(10**9, np.zeros(128), 10**9 * np.eye(128), 20, 7)
    assert plans[10**9].candidates < fixed.candidates / 20


def test_long_chains_end_as_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "x long, y long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_bad_rows(spark):
    docs = bad_docs(spark)
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = survivors(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(want, key=key)
    assert (3, None) in want and (4, "") in want and (6, LONG) in want and want.count((1, sentence(1))) == 1
    assert simhash.deduplicated(docs.limit(0)).count() == 0 and simhash.duplicates(docs.limit(0)).count() == 0


def test_allocation_is_the_least_by_trial():
    counts = [[0.0, 5.0, 9.0], [0.0, 1.0, 30.0], [0.0, 2.0, 4.0]]
    best = simhash.allocate(counts, 0)
    every = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a + b + c == 0]
    cost = lambda t: sum(c[x + 1] for c, x in zip(counts, t))
    assert sum(best) == 0 and cost(best) == min(map(cost, every))


def test_near_copies_in_scripts_without_spaces():
    text = "".join(chr(0x4E00 + (i * 7919) % 3000) + ("，" if i % 9 == 8 else "") for i in range(300))
    f, has = simhash.fingerprints(pa.array([text, text[:100] + "新" + text[101:]]))
    assert has.all() and sum(int(x).bit_count() for x in f[0] ^ f[1]) <= 20
