from __future__ import annotations

import corpus_pipeline
from moraine.llm import mixing, queries, sharding, simhash, toxicity
from tests.compare import DATA, bag, duck
from tests.llm.fixtures import bad_docs
from tests.llm.test_simhash import survivors
from tests.llm.test_tiling import wanted

SF = DATA / "sf0.001"


def test_against_brute_force(spark):
    """Each stage by its brute-force version, on what the one before kept."""
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    model = toxicity.train(docs, spark.read.parquet(str(SF / "labels.parquet")))
    db = duck(SF)
    rows = db.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    kept = survivors([r for r in rows if model.score(r[1]) < 0.5])
    leaked = {d for d, _ in wanted(kept, db.sql("SELECT item_id, text FROM benchmark").fetchall())}
    kept = [(i,) for i, _ in kept if i not in leaked]
    db.sql("CREATE TABLE left_ids (id BIGINT)")
    db.executemany("INSERT INTO left_ids VALUES (?)", kept)
    db.sql("CREATE TABLE clean AS SELECT * FROM documents WHERE doc_id IN (SELECT id FROM left_ids)")
    db.sql(f"CREATE TABLE mixed AS {mixing.mixture_sql(docs='clean')}")
    db.sql("CREATE TABLE final AS SELECT d.* FROM clean d JOIN mixed m ON m.doc_id = d.doc_id")
    want = db.execute(f"SELECT f.*, p.region, p.rack, p.shard FROM final f JOIN ({sharding.placement_sql(docs='final')}) p ON p.doc_id = f.doc_id")
    names = [c[0] for c in want.description]
    out = corpus_pipeline.run(spark, str(SF))
    assert out.columns == names
    assert bag(names, [tuple(r) for r in out.collect()]) == bag(names, want.fetchall())
    assert 0 < out.count() < len(rows)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "benchmark", "mixture", "shards"]
    docs = bad_docs(spark)
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True]):
        out = stage(spark, docs, str(SF))
        assert out.columns == (docs.columns + ["region", "rack", "shard"] if last else docs.columns), name
        assert stage(spark, docs.limit(0), str(SF)).count() == 0
        assert out.count() <= docs.count()


def test_near_duplicates_broadcast_no_probes(spark, monkeypatch):
    """The second stage joins what it makes of the documents by a shuffle, also where the documents are few."""
    ran, components = [], simhash.components

    def watched(edges):
        edges.collect()
        ran.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(simhash, "components", watched)
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    assert 0 < corpus_pipeline.drop_near_duplicates(spark, docs, str(SF)).count() < docs.count()
    assert len(ran) == 1 and "SortMergeJoin" in ran[0] and "Broadcast" not in ran[0]


def test_near_duplicates_broadcast_no_groups(spark, monkeypatch):
    """Nor do the edges, the components or the groups of the second stage go through the driver."""
    ran, checkpointed = [], simhash.checkpointed

    def watched(df):
        df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(simhash, "checkpointed", watched)
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    assert 0 < corpus_pipeline.drop_near_duplicates(spark, docs, str(SF)).count() < docs.count()
    assert len(ran) > 4 and sum("SortMergeJoin" in p for p in ran) > 2 and not [p for p in ran if "Broadcast" in p]


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
