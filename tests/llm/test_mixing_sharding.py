from __future__ import annotations

from collections import Counter
from fractions import Fraction

from moraine.llm import mixing, sharding
from tests.compare import bag, compare, DATA, duck
from tests.llm.fixtures import bad_docs


def test_mixture_against_sql_with_bad_rows(spark):
    docs = bad_docs(spark)
    db = duck(DATA / "sf0.001")
    db.sql("CREATE TABLE bad (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO bad VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in docs.collect()])
    for budget, block in ((0.75, 64), (1.0, 16), (0.3, 4096)):
        got = mixing.mixed(docs, budget=budget, block_tokens=block, shard_blocks=4).withColumnRenamed("doc", "doc_id")
        rows = db.execute(mixing.mixture_sql(budget, block, 4, docs="bad"))
        names = [c[0] for c in rows.description]
        assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(names, rows.fetchall())
    assert mixing.mixed(docs.limit(0)).count() == 0
    out = mixing.selected(docs, budget=1.0)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert mixing.selected(docs.limit(0)).count() == 0


def test_quotas_are_those_of_highest_quotients(spark):
    weights = {"a": 5.0, "b": 3.0, "c": 1.0}
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, weights=weights, budget=0.5, block_tokens=50, shard_blocks=8)
    seats = sorted({(r.seat, r.source, r.shard) for r in got.collect()})
    have = Counter({s: 40 for s in weights})
    quotients = sorted(((-Fraction(int(w * 200000), 2 * k - 1), s) for s, w in weights.items() for k in range(1, have[s] + 1)))
    assert [s for _, s, _ in seats] == [s for _, s in quotients[:60]]
    for shard in {x for *_, x in seats[:40]}:  # as long as no source runs out, each shard has the weights' quotas
        n = Counter(s for _, s, x in seats if x == shard)
        assert all(abs(n[s] - 8 * w / 9) <= 1 for s, w in weights.items())


def test_quotas_are_the_steps_of_the_apportionment(spark):
    """Each shard's quotas: Sainte-Lague for all seats up to it, by dividing one seat after the other, less that for those before."""
    docs = spark.createDataFrame([(i, "w " * 10, "abcd"[min(i % 7, 3)]) for i in range(700)], "doc_id long, text string, source string")
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 0.1}
    own = mixing.checkpointed(mixing.placed(docs, block_tokens=50))
    got = {(r.shard, r.source): r.quota for r in mixing.quotas(own, weights=weights, budget=0.6, shard_blocks=8).collect()}
    have = {"a": 20, "b": 20, "c": 20, "d": 80}
    n, want = Counter(), Counter()
    for seat in range(int(sum(have.values()) * 0.6)):
        best = max((s for s in weights if n[s] < have[s]), key=lambda s: (Fraction(int(weights[s] * 200000), 2 * n[s] + 1), [-ord(c) for c in s]))
        n[best] += 1
        want[seat // 8, best] += 1
    assert got == dict(want)
    rows = mixing.mixed(docs, weights=weights, budget=0.6, shard_blocks=8, block_tokens=50).select("source", "block", "seat").distinct().collect()
    assert len({(r.source, r.block) for r in rows}) == len(rows) == sum(got.values())  # a seat takes one block, a block one seat


def test_realised_shares_follow_the_quotas(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    for r in mixing.realised(docs, block_tokens=1024).collect():
        assert abs(r.seat_share - r.token_share) < 0.06, r
    assert mixing.realised(docs.limit(0)).count() == 0


def test_equal_weights_go_by_name(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(30)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, budget=1.0, block_tokens=20)
    assert [s for _, s in sorted({(r.seat, r.source) for r in got.collect()})][:6] == ["a", "b", "c", "a", "b", "c"]


def test_shards_against_sql_with_bad_rows(spark):
    docs = bad_docs(spark)
    db = duck(DATA / "sf0.001")
    db.sql("CREATE TABLE bad (doc_id BIGINT)")
    db.executemany("INSERT INTO bad VALUES (?)", [(r.doc_id,) for r in docs.collect()])
    got = sharding.sharded(docs.select("doc_id"))
    rows = db.execute(sharding.placement_sql(docs="bad"))
    names = [c[0] for c in rows.description]
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(names, rows.fetchall())
    out = sharding.sharded(docs.withColumn("Region", docs["key"]))
    assert out.columns == [*docs.columns, "region", "rack", "shard"] and out.count() == docs.count()
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_movement_stays_in_the_subtree(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = dict(sharding.TREE)
    before = {r.doc_id: r for r in sharding.sharded(docs, tree=tree).collect()}
    tree["r0/k1/s2"] *= 3
    after = {r.doc_id: r for r in sharding.sharded(docs, tree=tree).collect()}
    moved = [(before[i], after[i]) for i in before if before[i].shard != after[i].shard]
    assert moved and all(a.rack == b.rack == "r0/k1" and b.shard == "r0/k1/s2" for a, b in moved)
    tree = dict(sharding.TREE) | {"r1": 4.0}
    after = {r.doc_id: r for r in sharding.sharded(docs, tree=tree).collect()}
    assert all(after[i].region == "r1" for i in before if before[i].shard != after[i].shard)
    share = Counter(r.region for r in before.values())
    assert all(abs(share[r] / 20_000 - w / 10) < 0.02 for r, w in (("r0", 5), ("r1", 3), ("r2", 2)))


def test_empty_nodes_have_no_place(spark):
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    got = sharding.sharded(docs, tree={"x": 1.0, "y": 0.0, "x/a": 0.0}).collect()
    assert {(r.region, r.rack, r.shard) for r in got} == {("x", None, None)}
    assert {r.region for r in sharding.sharded(docs, tree={}).collect()} == {None}


def test_registered_sql(spark):
    from moraine.llm import queries

    for name in ("op3_hash_tree_sharding", "op6_source_mixing", "op9_exact_topk"):
        compare(queries.QUERIES[name](spark, str(DATA / "sf0.001")), queries.ORACLE_SQL[name], DATA / "sf0.001")
