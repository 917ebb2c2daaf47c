"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if tiles cover enough of the item's words. Tiles are runs of at
least `min_match` words that both have, found longest first, and no word of either side is in two tiles; their order
doesn't matter, so passages whose sentences were moved about are caught as well.

* Seeds are rolling Karp-Rabin hashes of min_match words. Documents' seeds are joined with the items' seeds.
  A set of items of a checked size is sent to the workers, which drop seeds that no item has before the join; a
  larger one is joined by a shuffle of all seeds. The rows are the same.
* A match of n words is n - min_match + 1 seeds in a row on one diagonal, so all matches of a pair, of every
  length, follow from its seeds, and the texts aren't read again.
* Pairs that can't reach the threshold are left out before tiling: tiles of c words hold c / min_match seeds at least.

Defined cases: items of fewer than min_match words are one seed of all their words, so a document that has them in a
row has a tile of the whole item. Texts without words have no seeds: such documents are clean, such items match
nothing. Of matches of one length the first in the item, then in the document, is marked
first. Rows that repeat are judged alike; a pair of a document and an item is listed once for each distinct
text of that doc_id. An item_id with several texts counts for each of them by itself. Empty tables give an empty
result. Further columns pass through; internal names give way to the table's own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import batches, fresh, gram_hashes, map_texts, row_key, without, word_hashes
from moraine.session import checkpointed

#: Seeds of all items, at 8 bytes each, up to which they are sent to the workers.
FILTER_SEEDS = 4_000_000


def seeds(docs: DataFrame, key: str, text: str, k: int, wanted: np.ndarray | None = None, shorter: Iterable[int] = (), whole: bool = False) -> DataFrame:
    """key, at (word), seed and words (of the whole text), for every k words of each text; only seeds in wanted (sorted), if that is given.

    Seeds of the lengths in shorter come besides; with whole, only those that are all words of a text.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        for part in parts:
            for own, keys in batches(part.column(1), part.column(0)):
                h, ptr = word_hashes(own)
                of = np.repeat(np.arange(len(own)), np.diff(ptr))
                for n in (k, *shorter):
                    g = gram_hashes(h, n)
                    doc = of[: len(g)]
                    use = np.arange(len(g)) + n <= ptr[doc + 1]
                    if whole and n != k:
                        use &= np.diff(ptr)[doc] == n
                    if known is not None:
                        use &= known[np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))] == g if len(known) else False
                    i = np.flatnonzero(use)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[i])), pa.array((i - ptr[doc[i]]).astype(np.int32)), pa.array(g[i].view(np.int64)), pa.array(np.diff(ptr)[doc[i]].astype(np.int32))], names=["key", "at", "seed", "words"])

    return map_texts(docs.select(F.col(key).alias("key"), F.lower(text).alias("text")), run, f"key {kind}, at int, seed long, words int")


def tile(at: np.ndarray, item_at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in the item, place in the document) from the places of all shared seeds."""
    order = np.lexsort((item_at, at - item_at))
    at, item_at = at[order], item_at[order]
    breaks = np.flatnonzero((np.diff(item_at) != 1) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], breaks])
    n = np.diff(np.append(first, len(at)))
    heap = [(-int(c + k - 1), int(item_at[f]), int(at[f])) for f, c in zip(first, n)]
    heapq.heapify(heap)
    item_used, doc_used, tiles = set(), set(), []
    while heap:
        size, i, d = heapq.heappop(heap)
        free = [j for j in range(-size) if i + j not in item_used and d + j not in doc_used]
        if len(free) == -size:
            tiles.append((-size, i, d))
            item_used.update(range(i, i - size))
            doc_used.update(range(d, d - size))
            continue
        start = 0  # what is left of the match comes in again
        for x in range(1, len(free) + 1):
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - start >= k:
                    heapq.heappush(heap, (start - x, i + free[start], d + free[start]))
                start = x
    return tiles


def tiled(docs: DataFrame, items: DataFrame, *, min_match: int = 4, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", filter_seeds: int = FILTER_SEEDS) -> DataFrame:
    """key (of the row), doc, item, coverage, tiles and longest, for each pair at or over the threshold."""
    k = min_match
    bench = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    bench = bench.withColumn("item_key", row_key("item", "text"))
    bench = checkpointed(seeds(bench.select("item_key", "text"), "item_key", "text", k, None, range(1, k), True).join(bench.select(F.col("item_key").alias("key"), "item"), "key"))
    shorter = sorted(r.words for r in bench.where(F.col("words") < k).select("words").distinct().collect())
    wanted = None
    if bench.count() <= filter_seeds:
        wanted = np.unique(np.array(bench.select("seed").distinct().toPandas()["seed"], np.int64).view(np.uint64))
    keyed = docs.select(F.struct(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc")).alias("row"), F.col(text_col).alias("text"))
    mine = seeds(keyed, "row", "text", k, wanted, shorter).select(F.col("key.key").alias("key"), F.col("key.doc").alias("doc"), F.col("at"), "seed")
    # a row that repeats must not double its seeds
    mine = mine.groupBy("key", "at", "seed").agg(F.first("doc").alias("doc"))
    met = mine.join(bench.select(F.col("key").alias("item_key"), "item", F.col("at").alias("item_at"), "seed", "words"), "seed")
    pairs = met.groupBy("key", "item_key").agg(F.first("doc").alias("doc"), F.first("item").alias("item"), F.first("words").alias("words"), F.countDistinct("item_at").alias("n"), F.collect_list("at").alias("at"), F.collect_list("item_at").alias("item_at"))
    pairs = pairs.where(F.col("n") * k >= F.col("words") * threshold).select("key", "doc", "item", "words", "at", "item_at")
    schema = pairs.select("key", "doc", "item").schema.add("coverage", "double").add("tiles", "integer").add("longest", "integer")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [tile(np.array(a.as_py()), np.array(i.as_py()), min(k, n)) for n, a, i in zip(part.column(3).to_pylist(), part.column(4), part.column(5))]
            covered = np.array([sum(t[0] for t in f) for f in found], float) / np.maximum(part.column(3).to_numpy(), 1)
            keep = pa.array(covered >= threshold)
            out = [*part.columns[:3], pa.array(np.round(covered, 6)), pa.array([len(f) for f in found], pa.int32()), pa.array([max((t[0] for t in f), default=0) for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names).filter(keep)

    return pairs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """The id of each contaminated document, with the item, the share of it that is covered, the number of tiles and the longest."""
    found = tiled(docs, items, id_col=id_col, item_col=item_col, **options)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "coverage", "tiles", "longest")


def decontaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates, with the columns they came with."""
    (key,) = fresh(docs, "row_key_of_text")
    lost = checkpointed(tiled(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("key").alias(key)).distinct())
    return without(docs.withColumn(key, row_key(id_col, text_col)), key, lost).select(*docs.columns)
