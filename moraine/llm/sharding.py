"""Sharding by a hierarchical weighted hash tree.

A document goes down the levels region, rack and shard. At each node every child draws a straw: ln(u) / weight, u in
(0, 1] a hash of the key and the child's path; the longest (the greatest) wins, so a child is chosen with probability
proportional to its weight. A change of a child's weight changes only that child's straws: documents move to it if
it grows and from it if it shrinks, and where it is inside a rack, only within that rack, if the rack's and the
region's own weights stay. All is a map over rows, without a shuffle; the tree is a literal of the plan.

Defined cases: a null key is a key of its own; rows with one key go to one shard. Ties (equal straws) go to the path
that is greatest as a string. Children of weight 0 or less get nothing; a node without any other has no place, and gives
null from there down. An empty table gives an empty table. Columns named region, rack or shard are
replaced; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import fresh

LEVELS = ("region", "rack", "shard")
SEED = "tree-1"

#: Weights by path: a region, region/rack, or region/rack/shard.
TREE: dict[str, float] = {}
for _r, _weight, _racks in (("r0", 5.0, 3), ("r1", 3.0, 2), ("r2", 2.0, 2)):
    TREE[_r] = _weight
    for _k in range(_racks):
        TREE[f"{_r}/k{_k}"] = 1.0 + 0.5 * _k
        for _s in range(4):
            TREE[f"{_r}/k{_k}/s{_s}"] = 2.0 if _s == 0 else 1.0


def straw(key: Column, path: Column, weight: Column, seed: str) -> Column:
    """ln((h + 1) / 2**48) / weight for the first 48 bits of the md5 of seed, path and key."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), path, key)), 1, 12), 16, 10).cast("double")
    return F.log((h + 1) / F.lit(float(1 << 48))) / weight


def sharded(docs: DataFrame, *, tree: dict[str, float] | None = None, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """docs with columns region, rack and shard; rack and shard are whole paths."""
    tree = TREE if tree is None else tree
    key, *nodes = fresh(docs, "key_of_tree", *(f"{n}_of_tree" for n in LEVELS))
    out = docs.withColumn(key, F.coalesce(F.col(id_col).cast("string"), F.lit("\\N")))
    for level, node in enumerate(nodes):
        groups: dict[str, list[tuple[str, float]]] = {}
        for path, weight in sorted(tree.items()):
            if path.count("/") == level and weight > 0:
                groups.setdefault(path.rpartition("/")[0], []).append((path, float(weight)))
        if not groups:
            out = out.withColumn(node, F.lit(None).cast("string"))
            continue
        child = lambda own: F.array(*(F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in own))
        children = F.create_map(*(x for parent, own in groups.items() for x in (F.lit(parent), child(own))))
        draws = F.transform(F.try_element_at(children, F.col(nodes[level - 1]) if level else F.lit("")), lambda c: F.struct(straw(F.col(key), c["path"], c["weight"], seed).alias("straw"), c["path"].alias("path")))
        out = out.withColumn(node, F.array_max(draws)["path"])
    kept = [c for c in docs.columns if c.lower() not in LEVELS]
    return out.select(*kept, *(F.col(n).alias(level) for n, level in zip(nodes, LEVELS)))


def placement_sql(tree: dict[str, float] | None = None, seed: str = SEED, docs: str = "documents") -> str:
    """doc_id, region, rack and shard by a join with the tree's nodes at each level."""
    rows = ", ".join(f"('{p}', '{p.rpartition('/')[0]}', {w!r}::DOUBLE, {p.count('/')})" for p, w in (TREE if tree is None else tree).items() if w > 0)
    level = """
{to} AS (
  SELECT DISTINCT ON (k) k, path AS node FROM (
    SELECT d.k, t.path, ln((('0x' || substr(md5(concat_ws(':', '{seed}', t.path, d.k)), 1, 12))::BIGINT + 1)::DOUBLE / {scale}) / t.weight AS straw
    FROM {of} d JOIN tree t ON t.level = {level} AND t.parent = d.node)
  ORDER BY k, straw DESC, path DESC)"""
    steps = ",".join(level.format(to=n, of=o, level=i, seed=seed, scale=float(1 << 48)) for i, (o, n) in enumerate((("keys", "a"), ("a", "b"), ("b", "c"))))
    return f"""
WITH tree(path, parent, weight, level) AS (VALUES {rows}),
keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '\\N') AS k, '' AS node FROM {docs}),{steps}
SELECT d.doc_id, a.node AS region, b.node AS rack, c.node AS shard
FROM {docs} d LEFT JOIN a ON a.k = coalesce(d.doc_id::VARCHAR, '\\N') LEFT JOIN b ON b.k = a.k LEFT JOIN c ON c.k = a.k"""
