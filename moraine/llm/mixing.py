"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

* Each source's documents are put in a seeded order (by a hash of the id) and that stream of tokens is cut into
  blocks of `block_tokens`; a document belongs to the block that its first token is in.
* Seats are allocated by highest quotients: the k-th seat of a source has the quotient weight / (2k - 1), and seats come in the
  order of their quotients, ties by source name, then k. A source can't get more seats than it has blocks.
* `budget`, a share of all blocks, says how many seats there are. A mixture that keeps everything would have the sources' own
  proportions, so blocks of sources over their weight have to go; three quarters is what leaves room for that.
* The seats fill one shard after the other with `shard_blocks` each. A shard's quota of a source is the apportionment of all seats up to that shard
  less that of the shards before it (Sainte-Lague never takes a seat back as seats are added), so quotas
  are whole numbers, every shard is filled, and even sources too small for a seat in each shard get theirs.
* Which block takes a source's k-th seat is a seeded permutation of its blocks, (multiplier * (k - 1) + start) mod blocks,
  multiplier a prime greater than the number of blocks, prime and start drawn by hash.

A document is never cut, so a block's own tokens vary by the documents that reach over its ends (one longer than
several blocks leaves those after its first empty, which count as seats all the same): over a source's seats this evens out, as
seats are of the stream's equal cuts. realised() gives what the shares came to.

The weights are the square roots of the sources' tokens, unless given, as whole numbers of millionths of the greatest. Quotients are
ranked by a sort within buckets of their logarithm, none with more than some 0.3 % of all blocks, and added up over the buckets; running sums of tokens
are taken in 4,096 hash ranges of each source and added up over the ranges. So there is no window over a whole source or
table, and nothing grows with the number of sources but their own table.

Defined cases: a null text or one without words has no tokens and belongs to the block where its place in the stream
is; null and empty sources are sources of their own. Rows that share a doc_id and a source are placed together, as one
document; if a doc_id is in several sources, each row follows its own. A source without tokens has one block.
An empty table gives an empty table. Further columns pass through; internal names give way to the table's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import fresh
from moraine.session import checkpointed

BLOCK_TOKENS = 8192
SHARD_BLOCKS = 64
BUDGET = 0.75
SEED = "mix-1"
#: The greatest primes below 2 ** 31; a source may have fewer blocks than that.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
#: Buckets for each doubling of the quotient.
BUCKETS = 256


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    """md5 of the seed and the parts, in hexadecimal; a null part is \\N."""
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts)))


def placed(docs: DataFrame, *, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc, source and block (from 0) of each document."""
    own = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), tokens(text_col).alias("n"))
    own = own.groupBy("doc", "source").agg(F.sum("n").alias("n")).withColumn("h", seeded(F.lit(seed), F.col("doc")))
    own = own.withColumn("range", F.substring("h", 1, 3))
    before = Window.partitionBy("source", "range").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = own.groupBy("source", "range").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("start"))
    joined = own.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return joined.select("doc", "source", F.expr(f"(start + at) div {int(block_tokens)}").alias("block"), "n")


def seats(own: DataFrame, *, weights: dict[str, float] | None = None, budget: float = BUDGET, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED) -> DataFrame:
    """source, k, seat (from 0), shard, and block for each seat; own: placed(), materialised."""
    spark = own.sparkSession
    sources = own.groupBy("source").agg((F.max("block") + 1).alias("blocks"), F.sum("n").alias("tokens"))
    if weights is None:
        share = F.sqrt(F.col("tokens").cast("double"))
    else:
        share = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")).cast("double")
        sources = sources.where(share > 0)
    sources = checkpointed(sources.withColumn("share", share))
    peak, total = sources.agg(F.max("share"), F.sum("blocks")).first()
    weight = F.greatest(F.lit(1), F.floor(1000000 * F.col("share") / F.greatest(F.lit(peak), F.lit(1e-9)))).cast("long")
    hashed = lambda at: f"cast(conv(substr(md5(concat('{seed}', ':offset:', coalesce(source, '\\\\N'))), {at}, 8), 16, 10) as long)"
    sources = sources.withColumn("weight", weight).withColumn("start", F.expr(f"{hashed(1)} % blocks")).withColumn("prime", F.expr(f"element_at(array({', '.join(f'{p}L' for p in PRIMES)}), cast({hashed(9)} % {len(PRIMES)} as int) + 1)"))
    # a source of any number of blocks is counted out in two steps, so no row becomes more than 65,536 at once
    runs = sources.withColumn("low", F.explode(F.expr("sequence(1L, blocks, 65536L)"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "low")
    every = runs.withColumn("k", F.explode(F.expr("sequence(low, least(low + 65535L, blocks))"))).withColumn("q", F.col("weight").cast("double") / (2 * F.col("k") - 1))
    every = checkpointed(every.withColumn("bucket", F.floor(F.log2("q") * BUCKETS)).select("source", "k", "q", "bucket", F.expr("(prime * (k - 1) + start) % blocks").alias("block")))
    # some thousands of buckets at most, whatever the table's size: weights span 20 doublings, seats 32
    counts = sorted(((r.bucket, r.n) for r in every.groupBy("bucket").agg(F.count("*").alias("n")).collect()), reverse=True)
    before, ahead = [], 0
    for bucket, n in counts:
        before.append((bucket, ahead))
        ahead += n
    offsets = F.broadcast(spark.createDataFrame(before, "bucket long, ahead long"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("q"), F.col("source").asc_nulls_first(), "k"))
    out = every.withColumn("within", within).join(offsets, "bucket").withColumn("seat", F.col("ahead") + F.col("within") - 1)
    return out.where(F.col("seat") < F.floor(F.lit(total or 0) * F.lit(budget))).select("source", "k", "seat", F.expr(f"seat div {int(shard_blocks)}").alias("shard"), "block")


def quotas(own: DataFrame, **options) -> DataFrame:
    """shard, source and quota: how many seats each shard has for a source, before blocks are chosen."""
    return seats(own, **options).groupBy("shard", "source").agg(F.count("*").alias("quota"))


def mixed(docs: DataFrame, *, weights: dict[str, float] | None = None, budget: float = BUDGET, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc, source, block, seat and shard of each document whose block gets a seat."""
    own = checkpointed(placed(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options))
    taken = seats(own, weights=weights, budget=budget, shard_blocks=shard_blocks, seed=seed).select(F.col("source").alias("s"), F.col("block").alias("b"), "seat", "shard")
    return own.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("doc", "source", "block", "seat", "shard")


def realised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """source, seats and tokens, with their shares of all: what the mixture came to."""
    own = checkpointed(placed(docs, id_col=id_col, text_col=text_col, source_col=source_col, **{k: v for k, v in options.items() if k in ("block_tokens", "seed")}))
    taken = seats(own, **{k: v for k, v in options.items() if k != "block_tokens"}).select(F.col("source").alias("s"), F.col("block").alias("b"), "seat")
    n = taken.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").groupBy(F.col("s").alias("source")).agg(F.count_distinct("seat").alias("seats"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    all_ = n.agg(F.sum("seats").alias("all_seats"), F.sum("tokens").alias("all_tokens")).first()
    return n.select("source", "seats", "tokens", (F.col("seats") / F.lit(all_[0] or 1)).alias("seat_share"), (F.col("tokens") / F.lit(all_[1] or 1)).alias("token_share"))


def selected(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The documents of the blocks that got seats, with the columns they came with."""
    d, s = fresh(docs, "mixed_doc", "mixed_source")
    stay = mixed(docs, id_col=id_col, source_col=source_col, **options).select(F.col("doc").alias(d), F.col("source").alias(s))
    return docs.join(stay, docs[id_col].eqNullSafe(stay[d]) & docs[source_col].eqNullSafe(stay[s]), "left_semi")


def mixture_sql(budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED, docs: str = "documents") -> str:
    """The rows of mixed() by a sort of all blocks: doc_id, source, block, seat, shard."""
    return rf"""
WITH own AS (
  SELECT doc_id, source, sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0))::BIGINT AS n,
         md5(concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, '\N'))) AS h
  FROM {docs} GROUP BY doc_id, source),
placed AS (
  SELECT doc_id, source, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {block_tokens} AS block FROM own),
sources AS (
  SELECT source, max(block) + 1 AS blocks, sqrt(sum(n)::DOUBLE) AS share, md5(concat('{seed}', ':offset:', coalesce(source, '\N'))) AS h FROM placed GROUP BY source),
weighted AS (
  SELECT source, blocks, greatest(1, floor(1000000 * share / greatest(max(share) OVER (), 1e-9)))::BIGINT AS weight,
         ('0x' || substr(h, 1, 8))::BIGINT % blocks AS first_block, {list(PRIMES)}[1 + ('0x' || substr(h, 9, 8))::BIGINT % {len(PRIMES)}]::BIGINT AS prime
  FROM sources),
seats AS (
  SELECT source, (prime * (k - 1) + first_block) % blocks AS block,
         row_number() OVER (ORDER BY weight::DOUBLE / (2 * k - 1) DESC, source NULLS FIRST, k) - 1 AS seat
  FROM (SELECT *, unnest(range(1, blocks + 1)) AS k FROM weighted))
SELECT p.doc_id, p.source, p.block, s.seat, s.seat // {shard_blocks} AS shard
FROM placed p JOIN seats s ON p.source IS NOT DISTINCT FROM s.source AND p.block = s.block
WHERE s.seat < floor((SELECT sum(blocks) FROM weighted) * {budget})"""
