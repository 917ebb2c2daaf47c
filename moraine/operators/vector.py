"""Exact vector top-k for batches of queries, by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.session import map_batches

#: Rows of a block, and of the queries that meet it at once; a block of 1,024-dimensional vectors is 8 MB as floats, 16 as doubles.
BLOCK_ROWS, STRIP = 2048, 256
SCALE = 1e6
#: Bytes of the queries that a worker holds at once, with what it has found for them; bytes of the corpus that are sorted behind them.
QUERY_BYTES, CORPUS_BYTES = 96 << 20, 192 << 20
#: Multiplications that a cell is worth, most cells for their sake as a multiple of the cores, and the corpus rows of a cell without need for less: the first
#: ones cost most, as they are all among the best so far.
CELL_WORK, CELLS, CELL_ROWS = 6.4e10, 4, 1 << 15
NONE = -(1 << 62)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, inside the JVM. For a few pairs; top_k() is for many."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def normalised(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Vectors at length 1, as they are stored in a collection, so similarity is one dot product."""
    v = F.col(vector_col)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn(vector_col, F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)))


def _is_float(vectors: DataFrame, vector_col: str) -> bool:
    return vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>"


def blocks(vectors: DataFrame, id_col: str, vector_col: str, group_col: str | None, rows: int) -> DataFrame:
    """at, g, ids and v: packed vectors as they are (floats, or else doubles), of one group each; at numbers the blocks of a partition on. Null ids, null and zero vectors are left out."""
    group = F.col(group_col).cast("string") if group_col else F.lit("")
    kind = np.float32 if _is_float(vectors, vector_col) else np.float64

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for part in parts:
            if not part.num_rows:
                continue
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(part.num_rows, -1)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            ids = part.column(0).to_numpy()
            groups = part.column(2).fill_null("\0").dictionary_encode()
            names, of = groups.dictionary.to_pylist(), groups.indices.to_numpy()
            own = np.flatnonzero((norm > 0) & np.isfinite(norm))
            own = own[np.argsort(of[own], kind="stable")]
            for g, i in zip(names, np.split(own, np.searchsorted(of[own], np.arange(1, len(names))))):
                for a in range(0, len(i), rows):
                    b = i[a : a + rows]
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([g], pa.string()), pa.array([ids[b].tobytes()], pa.binary()), pa.array([x[b].tobytes()], pa.binary())], names=["at", "g", "ids", "v"])
                    at += 1

    v = F.col(vector_col) if kind == np.float32 else F.col(vector_col).cast("array<double>")
    own = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), group.alias("g"))
    return map_batches(own, pack, "at int, g string, ids binary, v binary")


class Block:
    """Ids and vectors of a block, and these at length 1 as floats, for products that only tell which pairs are worth a second look."""

    def __init__(self, ids: list[np.ndarray], x: list[np.ndarray]):
        self.ids, self.x = np.concatenate(ids), np.concatenate(x)
        wide = self.x.astype(np.float64)
        self.norm = np.linalg.norm(wide, axis=1)
        self.unit = (wide / self.norm[:, None]).astype(np.float32)

    def at(self, rows: np.ndarray) -> np.ndarray:
        return self.x[rows].astype(np.float64) / self.norm[rows, None]


class Asked(Block):
    """Queries with the k best of each so far: keys are scores times SCALE, by the lowest id where equal."""

    def __init__(self, ids: list[np.ndarray], x: list[np.ndarray], k: int, least: float):
        super().__init__(ids, x)
        self.k, self.slack = k, (self.x.shape[1] + 8) * 2.0**-24 + 1 / SCALE
        self.key = np.full((len(self.ids), k), NONE)
        self.id = np.full((len(self.ids), k), np.iinfo(np.int64).max)
        self.least = max(least, NONE)
        self.cut = np.full(len(self.ids), -np.inf if least == NONE else least / SCALE - self.slack, np.float32)

    def meet(self, c: Block, exclude_same: bool) -> None:
        """Take what is among the best of c. The products of floats are off by less than slack, so what could count is computed again in doubles."""
        room = np.empty((STRIP, len(c.ids)), np.float32)
        few = self.k + exclude_same
        for a in range(0, len(self.ids), STRIP):
            unit, cut = self.unit[a : a + STRIP], self.cut[a : a + STRIP]
            s = np.matmul(unit, c.unit.T, out=room[: len(unit)])
            some = np.flatnonzero(s.max(axis=1) >= cut)
            if not len(some):
                continue
            s = s if len(some) == len(s) else s[some]
            if s.shape[1] > 4 * few:  # only what is among the best of the block can enter
                full = s >= cut[some, None] if cut.min() > -np.inf else None
                many = np.flatnonzero(full.sum(axis=1, dtype=np.int32) > 4 * few) if full is not None else np.arange(len(s))
                if len(many):
                    top = np.partition(s[many], -few, axis=1)[:, -few] - np.float32(2 * self.slack)
                    cut[some[many]] = np.maximum(cut[some[many]], top)
            row, col = np.divmod(np.flatnonzero(s >= cut[some, None]), s.shape[1])
            self._add(a + some[row], col, c, exclude_same)

    def _add(self, row: np.ndarray, col: np.ndarray, c: Block, exclude_same: bool) -> None:
        if exclude_same:
            other = self.ids[row] != c.ids[col]
            row, col = row[other], col[other]
        if not len(row):
            return
        step = max(1, (1 << 20) // self.x.shape[1])
        key = np.concatenate([np.rint(np.einsum("ij,ij->i", self.at(row[a : a + step]), c.at(col[a : a + step])) * SCALE).astype(np.int64) for a in range(0, len(row), step)])
        new = (key >= self.key[row, -1]) & (key >= self.least)
        row, col, key = row[new], col[new], key[new]
        touched = np.unique(row)
        rows = np.concatenate([row, np.repeat(touched, self.k)])
        key, ident = np.concatenate([key, self.key[touched].ravel()]), np.concatenate([c.ids[col], self.id[touched].ravel()])
        by = np.lexsort((ident, -key, rows))
        at = by[(np.searchsorted(rows[by], touched)[:, None] + np.arange(self.k)).ravel()]
        self.key[touched], self.id[touched] = key[at].reshape(-1, self.k), ident[at].reshape(-1, self.k)
        worst = self.key[touched, -1]
        self.cut[touched] = np.maximum(self.cut[touched], np.where(worst == NONE, -np.inf, worst / SCALE - self.slack).astype(np.float32))

    def found(self) -> pa.RecordBatch:
        use = (self.key != NONE).ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.k)[use]), pa.array(self.id.ravel()[use]), pa.array(self.key.ravel()[use])], names=["qid", "id", "key"])


def _cells(queries: DataFrame, corpus: DataFrame, query_vector: str, k: int, floats: tuple[bool, bool]) -> tuple[int, int]:
    """Into how many groups the queries and the corpus are cut: by the bytes a worker may hold, then by the work."""
    n, dim = queries.agg(F.count("*"), F.greatest(F.coalesce(F.max(F.size(query_vector)), F.lit(1)), F.lit(1))).first()
    m = corpus.count()
    query, row = dim * (8 if floats[0] else 12) + 16 * k + 32, dim * (4 if floats[1] else 8) + 8
    most = max(48, CELLS * queries.sparkSession.sparkContext.defaultParallelism)
    wanted = max(1, min(most, round(n * m * dim / CELL_WORK)))
    q, c = max(1, -(-n * query // QUERY_BYTES)), max(1, -(-m * row // CORPUS_BYTES))
    # the corpus goes to each group of queries, and each group of the corpus gives k rows a query
    best = round((wanted * m * row / max(1, n * k * 20)) ** 0.5)
    c = max(c, min(best, -(-wanted // q), m // CELL_ROWS))
    return max(q, -(-wanted // c)), c


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "qid", query_vector: str = "embedding", id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = None, exclude_same: bool = False, threshold: float | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """qid, id, score (rounded to 6 digits) and rank of the k best per query; equal scores by the lowest id.

    group_col: queries meet only the corpus rows of their group (a category filter before the search); a query without a group meets all.
    Queries and corpus are cut into groups of bounded bytes; a cell of one of each is one task, which holds its queries while the
    corpus passes by, block by block. Only k rows per query leave it, and are ranked with those of the other cells.
    """
    floats = _is_float(queries, query_vector), _is_float(corpus, vector_col)
    kinds = [np.float32 if x else np.float64 for x in floats]
    least = NONE if threshold is None else int(np.ceil(threshold * SCALE))

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}  # blocks that aren't joined to larger ones yet
        asked: dict[str, list[Asked]] = {}
        waiting, of_corpus = 0, False

        def flush() -> None:
            nonlocal waiting
            for g, (ids, x) in held.items():
                c = Block(ids, x)
                # "\0" stands for no group
                for q in [*(asked.get(g, ()) if g != "\0" else ()), *asked.get("\0", ())]:
                    q.meet(c, exclude_same)
            held.clear()
            waiting = 0

        def ask(g: str) -> None:
            ids, x = held.pop(g)
            ids, x = np.concatenate(ids), np.concatenate(x)
            asked.setdefault(g, []).extend(Asked([ids[a : a + rows]], [x[a : a + rows]], k, least) for a in range(0, len(ids), rows))

        for part in parts:
            for side, g, ids, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
                if side and not of_corpus:
                    for name in [*held]:
                        ask(name)
                    of_corpus = True
                ids = np.frombuffer(ids.as_buffer(), np.int64).copy()
                own = held.setdefault(g, ([], []))
                own[0].append(ids)
                own[1].append(np.frombuffer(v.as_buffer(), kinds[side]).reshape(len(ids), -1).copy())
                waiting += len(ids)
                if not side and sum(map(len, own[0])) >= rows:
                    ask(g)
                elif side and waiting >= rows:
                    flush()
        if of_corpus:
            flush()
        for q in (q for many in asked.values() for q in many):
            yield q.found()

    of_queries, of_corpus = _cells(queries, corpus, query_vector, k, floats)
    q = blocks(queries, query_id, query_vector, group_col, rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(of_corpus - 1)))).select((F.col("at") % of_queries * of_corpus + F.col("other")).alias("cell"), F.lit(0).alias("side"), "g", "ids", "v")
    c = blocks(corpus, id_col, vector_col, group_col, rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1)))).select((F.col("other") * of_corpus + F.col("at") % of_corpus).alias("cell"), F.lit(1).alias("side"), "g", "ids", "v")
    cells = q.unionByName(c).repartitionById(of_queries * of_corpus, "cell").sortWithinPartitions("side").select("side", "g", "ids", "v")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("key"), "id"))
    return map_batches(cells, best, "qid long, id long, key long").withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "id", (F.col("key") / SCALE).alias("score"), "rank")
