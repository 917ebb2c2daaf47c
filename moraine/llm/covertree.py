"""Exact top-k search by cosine similarity with dual-tree cover-tree search.

All vectors are normalised, so the nearest by Euclidean distance are the most similar. Data and queries are indexed
alike, by cover trees (each node's points lie within its covering radius, children are further apart than the radius divided
by BASE, and cover their points with it). A pair of a query node and a data node can't hold a better neighbour if the distance of their
centres less both covering radii exceeds the worst k-th distance among the queries of the node.

* The data is cut into cells by the nearest of a set of pivots, and large cells into parts by hash, so no tree has many more than CELL
  points, whatever the table holds. Trees are built once and kept in a table.
* Queries are taken in blocks of bounded bytes. A block has one tree, which is built once and sent to the workers, that hold the
  data: only queries and results are moved, never the data.
* A first pass searches each query's own cell and one tree in SAMPLE of the others; what it finds bounds each query's k-th score.
* A second pass descends the block's tree and each data tree with these bounds. Only points that reach a query's bound leave
  the workers, and Spark keeps each query's best. Leaves are compared as matrices.

Pruning never loses a neighbour, so the result is exact; where distances concentrate, as for uniform vectors in many dimensions, it prunes
nothing, and all points are compared with all queries. A node whose children would be nearly as many as its points is a leaf.

Defined cases: scores are rounded to 6 digits; equal scores go by the lowest id. Null ids, null, empty and zero vectors,
vectors with null or not finite numbers, and of a length other than the most frequent one (of equals the least) have no
neighbours and are none. Of rows that share an id the one with the lowest vector counts. A row is no neighbour of itself. With
fewer than k others, all are listed. An empty table gives an empty result. Further columns are left out; if the id's column
has a result's name (neighbor_id, score, rank), the result's gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import fresh
from moraine.session import checkpointed

BASE = 1.3
LEAF = 64
CELL = 2048
#: Most pivots; they go to all workers (2 MB at 64 dimensions). Cells beyond that grow, and are cut into more parts.
PIVOTS = 4096
#: Bytes of the queries of a block.
BLOCK_BYTES = 32 << 20
#: One data tree in so many is searched for all queries before the rest is.
SAMPLE = 64
#: Entries of a matrix of scores that is computed at once.
BLOCK = 1 << 20
SCALE = 1e6
NONE = -(1 << 62)


class Node:
    __slots__ = ("center", "radius", "start", "end", "children")

    def __init__(self, center: np.ndarray, radius: float, start: int, end: int, children: list[Node]):
        self.center, self.radius, self.start, self.end, self.children = center, radius, start, end, children


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - p) ** 2).sum(1), 0.0))


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Node]:
    """An order of the points, and the tree over the points in that order."""
    order = np.arange(len(x))

    def make(start: int, end: int) -> Node:
        own = x[order[start:end]]
        center = own[0]
        d = distances(own, center)
        radius = float(d.max())
        if end - start <= leaf or radius == 0.0:
            return Node(center, radius, start, end, [])
        # points further than radius / BASE from all centres become centres, the farthest first
        near, owner, centers, most = d, np.zeros(end - start, int), 1, max(8, (end - start) // 8)
        while near[j := int(near.argmax())] > radius / BASE:
            if centers >= most:
                return Node(center, radius, start, end, [])
            dj = distances(own, own[j])
            owner[dj < near] = centers
            near = np.minimum(near, dj)
            centers += 1
        by = np.argsort(owner, kind="stable")
        order[start:end] = order[start:end][by]
        cuts = start + np.searchsorted(owner[by], np.arange(centers + 1))
        return Node(center, radius, start, end, [make(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a])

    root = make(0, len(x))
    return order, root


class Best:
    """The k best of each query so far: key is the rounded score times SCALE, by the lowest id where equal."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.key = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, a: int, b: int) -> float:
        """The greatest distance at which a point could still enter the best of a query in a..b."""
        key = self.key[a:b, -1].min()
        return np.inf if key == NONE else float(np.sqrt(max(0.0, 2 - 2 * ((key - 2) / SCALE)))) + 1e-9

    def add(self, a: int, keys: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """keys: of queries a.. (rows) with the points ids (columns); own: the queries' ids."""
        last = self.key[a : a + len(keys), -1]
        if keys.shape[1] > 4 * self.k:  # only what is among the k + 1 best of the block can enter
            cut = np.partition(keys, keys.shape[1] - self.k - 1, axis=1)[:, keys.shape[1] - self.k - 1]
            last = np.maximum(last, cut)
        row, col = np.nonzero(keys >= last[:, None])
        new = ids[col] != own[row]
        row, col = row[new], col[new]
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([row, np.repeat(touched, self.k)])
        key = np.concatenate([keys[row, col], self.key[a + touched].ravel()])
        ident = np.concatenate([ids[col], self.id[a + touched].ravel()])
        by = np.lexsort((ident, -key, rows))
        rows, key, ident = rows[by], key[by], ident[by]
        first = np.searchsorted(rows, touched)
        at = (first[:, None] + np.arange(self.k)).ravel()
        self.key[a + touched] = key[at].reshape(-1, self.k)
        self.id[a + touched] = ident[at].reshape(-1, self.k)


def search(qx: np.ndarray, qid: np.ndarray, qroot: Node, rx: np.ndarray, rid: np.ndarray, rroot: Node, best: Best) -> int:
    """Search the data tree for all queries of the query tree at once. Gives the number of pairs of points compared."""
    todo, compared = [(qroot, rroot)], 0
    while todo:
        q, r = todo.pop()
        if float(np.linalg.norm(q.center - r.center)) - q.radius - r.radius > best.worst(q.start, q.end):
            continue
        if not q.children and not r.children:
            step = max(1, BLOCK // (r.end - r.start))
            for a in range(q.start, q.end, step):
                b = min(q.end, a + step)
                for c in range(r.start, r.end, BLOCK):
                    d = min(r.end, c + BLOCK)
                    best.add(a, np.rint((qx[a:b] @ rx[c:d].T) * SCALE).astype(np.int64), rid[c:d], qid[a:b])
                    compared += (b - a) * (d - c)
        elif not r.children or (q.children and q.radius > r.radius):
            todo += [(child, r) for child in q.children]
        else:  # the nearest child last, so that it is searched first
            todo += [(q, child) for child in sorted(r.children, key=lambda n: -float(np.linalg.norm(n.center - q.center)))]
    return compared


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def points(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id and vector of the rows that count, and their number of dimensions (0: there are none)."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size.n if size else 0
    return own.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), dim


class Tree:
    """A cover tree as arrays, to be kept in a table or sent: the points in its order, and its nodes in the order of a walk."""

    @staticmethod
    def dump(root: Node) -> tuple[bytes, bytes, bytes]:
        """Centres, radii, and start, end and number of children of each node, parents first."""
        nodes, todo = [], [root]
        while todo:
            n = todo.pop()
            nodes.append(n)
            todo += reversed(n.children)
        return np.array([n.center for n in nodes]).tobytes(), np.array([n.radius for n in nodes]).tobytes(), np.array([(n.start, n.end, len(n.children)) for n in nodes], np.int64).tobytes()

    @staticmethod
    def load(centers: bytes, radii: bytes, shape: bytes, dim: int) -> Node:
        c, r, s = np.frombuffer(centers).reshape(-1, dim), np.frombuffer(radii), np.frombuffer(shape, np.int64).reshape(-1, 3)
        stack: list[tuple[Node, int]] = []
        root = None
        for center, radius, (start, end, n) in zip(c, r, s):
            node = Node(center, float(radius), int(start), int(end), [])
            while stack and len(stack[-1][0].children) == stack[-1][1]:
                stack.pop()
            if stack:
                stack[-1][0].children.append(node)
            else:
                root = node
            stack.append((node, int(n)))
        return root


_TREE = "cell int, ids binary, x binary, centers binary, radii binary, shape binary"


def indexed(own: DataFrame, dim: int) -> tuple[DataFrame, np.ndarray]:
    """The data trees, one a row (cell, ids, x and the nodes), and the pivots; own: points(), materialised."""
    spark = own.sparkSession
    n = own.count()
    wanted = min(PIVOTS, max(1, -(-n // CELL)))
    pivots = np.array([r.v for r in own.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _vectors(part.column(1), dim)
            cell = (x @ shared.value.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["cell", "id", "v"])

    assigned = checkpointed(own.mapInArrow(assign, "cell int, id long, v binary"))
    # a row for each cell, PIVOTS at most
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n")).select(F.col("cell").alias("c"), F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    cut = assigned.join(F.broadcast(sizes), F.col("cell") == F.col("c")).select("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "v")

    def index(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["v"].to_pylist())).reshape(-1, dim)
        ids = table["id"].to_numpy()
        by = np.argsort(ids)  # the tree doesn't depend on the order in which rows came
        order, root = build(x[by])
        row = [table["cell"][0].as_py(), ids[by][order].tobytes(), x[by][order].tobytes(), *Tree.dump(root)]
        return pa.table({c: pa.array([v], t) for c, v, t in zip("cell ids x centers radii shape".split(), row, [pa.int32()] + [pa.binary()] * 5)})

    return checkpointed(cut.groupBy("cell", "part").applyInArrow(index, _TREE)), pivots


def _found(block: tuple, k: int, best: Best) -> pa.RecordBatch:
    """The rows that were found: id, neighbor and key."""
    use = (best.id != np.iinfo(np.int64).max).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(block[0], k)[use]), pa.array(best.id.ravel()[use]), pa.array(best.key.ravel()[use])], names=["id", "neighbor", "key"])


def _searched(trees: DataFrame, block: tuple, k: int, dim: int, first: bool) -> DataFrame:
    """id, neighbor and key of each query's best in each partition of trees; block: ids, vectors, tree, own cells and bounds of the queries, in the tree's order."""
    shared = trees.sparkSession.sparkContext.broadcast(block)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qx, tree, cells, bounds = shared.value
        root = Tree.load(*tree, dim)
        best = Best(len(qids), k)
        if bounds is not None:
            best.key[:] = bounds[:, None]
        for part in parts:
            for cell, ids, x, *nodes in zip(*(c.to_pylist() for c in part.columns)):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, dim)
                if first and int(ids[0]) % SAMPLE:  # for the queries of this cell only
                    mine = np.flatnonzero(cells == cell)
                    if len(mine):
                        own = Best(len(mine), k)
                        own.key, own.id = best.key[mine], best.id[mine]
                        for a in range(0, len(mine), step := max(1, BLOCK // len(x))):
                            own.add(a, np.rint((qx[mine[a : a + step]] @ x.T) * SCALE).astype(np.int64), ids, qids[mine[a : a + step]])
                        best.key[mine], best.id[mine] = own.key, own.id
                else:
                    search(qx, qids, root, x, ids, Tree.load(*nodes, dim), best)
        yield _found(shared.value, k, best)

    rows = trees.mapInArrow(run, "id long, neighbor long, key long")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("key"), "neighbor"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, *, queries: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, neighbor_id, score and rank of the k most similar others of every row; queries: of those rows only, by a condition on the id's column."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    names = fresh(vectors.select(id_col), "neighbor_id", "score", "rank")
    result = lambda df: df.select(F.col("id").cast(kind).alias(id_col), F.col("neighbor").cast(kind).alias(names[0]), (F.col("key") / SCALE).alias(names[1]), F.col("rank").cast("int").alias(names[2]))
    empty = result(spark.createDataFrame([], "id long, neighbor long, key long, rank int"))
    own, dim = points(vectors, id_col, vector_col)
    if not dim:
        return empty
    own = checkpointed(own)
    asked = own if queries is None else own.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id")
    n = asked.count()
    if not n:
        return empty
    trees, pivots = indexed(own, dim)
    blocks = -(-n * dim * 8 // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()  # BLOCK_BYTES, about
        if not len(rows):
            continue
        ids, x = rows["id"].to_numpy(), _vectors(rows["v"].combine_chunks(), dim)
        by = np.argsort(ids)
        ids, x = ids[by], x[by]
        order, root = build(x)
        ids, x = ids[order], x[order]
        cells = np.concatenate([(x[a : a + 4096] @ pivots.T).argmax(1) for a in range(0, len(x), 4096)])
        block = (ids, x, Tree.dump(root), cells)
        near = _searched(trees, (*block, None), k, dim, True).where(F.col("rank") == k).select("id", "key").toArrow()
        bounds = np.full(len(ids), NONE)
        at = np.argsort(ids)
        bounds[at[np.searchsorted(ids[at], near["id"].to_numpy())]] = near["key"].to_numpy()
        part = checkpointed(_searched(trees, (*block, bounds), k, dim, False)) if blocks > 1 else _searched(trees, (*block, bounds), k, dim, False)
        out = part if out is None else out.union(part)
    return result(out)


def top_k_sql(k: int = 10, every: int = 20) -> str:
    """Each row whose id is divisible by every, against all rows."""
    return f"""
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id)::INTEGER AS rank FROM pairs)
SELECT vec_id, neighbor_id, score, rank FROM ranked WHERE rank <= {k}"""
