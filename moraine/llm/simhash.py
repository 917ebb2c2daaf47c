"""SimHash near-duplicates by the generalised pigeonhole principle.

Every document gets a 128-bit SimHash of its set of words. Two documents are near-duplicates if their
fingerprints differ in at most `distance` bits. To find all such pairs the bits are divided into parts, and each
part i gets a threshold t_i >= -1 with sum(t_i) = distance - parts + 1. Then two fingerprints within `distance`
differ in at most t_i bits in at least one part: otherwise they would differ in sum(t_i + 1) = distance + 1 or more.

* Bits that are correlated over the corpus share a part, as they tend to differ together.
* The thresholds are allocated by dynamic programming on the estimated number of candidates of each part and
  threshold, and on the rows that have to be probed for it. The estimates rest on the bits' means and correlations
  over all fingerprints. The number of parts is the one whose allocation costs least, so parts get wider, and candidates
  a document fewer, as there are more documents: wider parts with higher thresholds take more probes instead.
* Probing: two values within t bits share a value within t - t // 2 bits of one and t // 2 of the other, so both
  sides list such values and are joined on them. A pair counts only at one fixed meeting value in the
  first part where it is within the threshold, so no distinct is needed.
* Verifying: the Hamming distance of the whole fingerprints, in the join itself.

Alike fingerprints are joined to one row first, so a group of any number of copies probes once. Groups are the
connected components of the pairs. There are no caps on groups, partners or candidates.

Defined cases: a document whose text is null or has no words has no fingerprint and belongs to no group.
Rows that repeat, and rows of one doc_id with different texts, are documents of their own. Of a group the
document with the lowest doc_id stays (null ids last; ties by the row's hash), and of rows alike in id and text
just one. An empty table gives an empty table. Further columns pass through; internal names give way
to the table's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, lgamma
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import batches, fresh, map_texts, mix, row_key, small, without, word_hashes
from moraine.session import checkpointed

BITS = 128
#: Widest part, so that its values and its number fit one 64-bit integer.
WIDEST = 56
GROUPS = 64
#: What a probed row costs, in candidates (measured: 1.1 and 0.15 microseconds).
PROBE_COST = 8.0
PROBES_A_TASK = 4_000_000
_SALT = np.uint64(0xD6E8FEB86659FD93)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of lower-case texts as (n, 2) unsigned integers, and which texts have one."""
    h, at = word_hashes(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    has, start = np.unique(doc, return_index=True)
    out = np.zeros((n, 2), np.uint64)
    if len(has):
        size = np.diff(np.append(start, len(h)))
        for half, x in enumerate((h, mix(h ^ _SALT))):
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
            out[has, half] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    mask = np.zeros(n, bool)
    mask[has] = True
    return out, mask


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (of the row), id, a and b (the fingerprint's halves), for each document with words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text, key, id_ in batches(part.column(2), part.column(0), part.column(1)):
                f, has = fingerprints(text)
                has = pa.array(has)
                yield pa.RecordBatch.from_arrays([key.filter(has), id_.filter(has), *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)).filter(has) for i in (0, 1))], names=["key", "id", "a", "b"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    return map_texts(rows, run, f"key long, id {kind}, a long, b long")


def moments(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of fingerprints, the bits' sums as +1 and -1, and the sums of their products, over all rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(BITS), np.zeros((BITS, BITS))
        for part in parts:
            x = signs(part)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()]), pa.array([ss.tobytes()])], names=["n", "s", "ss"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"n": [sum(table["n"].to_pylist())], **{c: pa.array([sum(np.frombuffer(x) for x in table[c].to_pylist()).tobytes()], pa.binary()) for c in ("s", "ss")}})

    # a row of fixed size for each partition, added up in groups, so that GROUPS of them come to the driver at most
    rows = prints.select("a", "b").mapInArrow(run, "n long, s binary, ss binary").groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS))).applyInArrow(add, "n long, s binary, ss binary").collect()
    return sum(r.n for r in rows), sum((np.frombuffer(r.s) for r in rows), np.zeros(BITS)), sum((np.frombuffer(r.ss).reshape(BITS, BITS) for r in rows), np.zeros((BITS, BITS)))


def signs(part: pa.RecordBatch) -> np.ndarray:
    x = np.stack([part.column(i).to_numpy().view(np.uint64) for i in (0, 1)], 1).copy()
    return np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def partition_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Divide the bits into parts of nearly equal size, each grown by the bit that correlates most with those it has."""
    left = set(range(len(correlation)))
    strength = np.abs(correlation) - np.eye(len(correlation))
    out = []
    for i in range(parts):
        size = len(left) // (parts - i)
        rest = sorted(left)
        own = [rest[int(np.argmax(strength[np.ix_(rest, rest)].max(1)))]]
        left.discard(own[0])
        while len(own) < size:
            rest = sorted(left)
            own.append(rest[int(np.argmax(strength[np.ix_(rest, own)].sum(1)))])
            left.discard(own[-1])
        out.append(sorted(own))
    return out


def within(mean: np.ndarray, correlation: np.ndarray) -> np.ndarray:
    """P(two random values of a part differ in at most t bits), t = 0, 1, ...: a beta-binomial with the mean and variance that the bits' moments give.

    Bit i of two independent documents differs with probability (1 - E[s_i]**2) / 2, and the covariance of two
    such events is (E[s_i s_j]**2 - E[s_i]**2 E[s_j]**2) / 4.
    """
    n = len(mean)
    p = float(np.clip(((1 - mean**2) / 2).mean(), 1e-6, 0.5))
    var = float(max((correlation**2 - np.outer(mean**2, mean**2)).sum() / 4, 1e-9))
    rho = min(max((var / (n * p * (1 - p)) - 1) / max(n - 1, 1), 1e-6), 0.99)
    a, b = p * (1 / rho - 1), (1 - p) * (1 / rho - 1)
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    mass = [np.exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + beta(k + a, n - k + b) - beta(a, b)) for k in range(n + 1)]
    return np.minimum(np.cumsum(mass), 1.0)


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most radius bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def allocate(counts: list[list[float]], total: int) -> list[int]:
    """Thresholds, from -1 (the part isn't probed) up, with the given sum and the least sum of counts. counts[i][t + 1]: cost of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in counts:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, x in enumerate(part, -1):
                if s + t not in after or c + x < after[s + t][0]:
                    after[s + t] = (c + x, [*chosen, t])
        best = after
    return best[total][1]


def sphere(width: int, radius: int) -> int:
    """The number of masks of at most radius bits."""
    return sum(comb(width, r) for r in range(radius + 1))


class Plan(NamedTuple):
    """The bits of each part and its threshold; by estimate, candidates and probed rows in all."""

    bits: list[list[int]]
    thresholds: list[int]
    candidates: float
    probes: float


def plan(n: int, sums: np.ndarray, products: np.ndarray, distance: int, parts: int | None = None, probe_cost: float = PROBE_COST) -> Plan:
    """The cheapest plan, of those with the given number of parts if it is given."""
    mean, corr = sums / max(n, 1), products / max(n, 1)
    best: tuple[float, Plan] | None = None
    for number in range(-(-BITS // WIDEST), min(distance + 1, BITS) + 1) if parts is None else [parts]:
        bits = partition_bits(corr - np.outer(mean, mean), number)
        counts, own = [], []
        for of in bits:
            p, w = within(mean[of], corr[np.ix_(of, of)]), len(of)
            own.append([(0.0, 0.0), *((n * n / 2 * p[t], float(n * (sphere(w, t - t // 2) + sphere(w, t // 2)))) for t in range(min(distance, w) + 1))])
            counts.append([c + probe_cost * r for c, r in own[-1]])
        thresholds = allocate(counts, distance - number + 1)
        candidates, probes = (sum(o[t + 1][i] for o, t in zip(own, thresholds)) for i in (0, 1))
        cost = candidates + probe_cost * probes
        if best is None or cost < best[0]:
            best = cost, Plan(bits, thresholds, candidates, probes)
    return best[1]


def part_value(bits: list[int]) -> Column:
    """The bits of a part, of columns a and b, as one number."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        bit = F.shiftrightunsigned(F.col("a" if b < 64 else "b"), b % 64).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit, i))
    return out


def near_pairs(prints: DataFrame, distance: int, parts: int | None = None) -> DataFrame:
    """x, y: hashes of the fingerprints of all pairs within distance; prints: distinct fingerprints a, b. Each pair comes once.

    Probes carry the fingerprint and nothing else that identifies it, as they are the most that is shuffled.
    """
    if distance < 0 or (parts is not None and parts * WIDEST < BITS):
        raise ValueError(f"{parts} parts of {BITS} bits are too wide; a part has at most {WIDEST}" if distance >= 0 else "distance is negative")
    if parts is None and distance + 1 < -(-BITS // WIDEST):
        parts = -(-BITS // WIDEST)
    chosen = plan(*moments(prints), distance, parts)
    bits, thresholds = chosen.bits, chosen.thresholds
    used = [i for i, t in enumerate(thresholds) if t >= 0]
    # checkpointed rows may lie in few partitions, and each row becomes many
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(chosen.probes // PROBES_A_TASK))
    prints = prints.repartition(tasks, "a", "b")

    def meetings(around: Column, i: int):
        return lambda v: F.transform(around, lambda m: F.struct(v.bitwiseXOR(m).bitwiseOR(F.lit(i << WIDEST).cast("long")).alias("at"), m.alias("m")))

    def probes(side: int) -> DataFrame:
        lists = []
        for i in used:
            radius = thresholds[i] // 2 if side else thresholds[i] - thresholds[i] // 2
            around = F.expr("array(" + ",".join(f"{m}L" for m in ball(len(bits[i]), radius)) + ")")
            # transform over a one-entry array takes the bits out once, not for each entry of the ball
            lists.append(F.flatten(F.transform(F.array(part_value(bits[i])), meetings(around, i))))
        exploded = prints.select("a", "b", F.explode(F.concat(*lists)).alias("p"))
        return exploded.select(F.col("p.at").alias("at"), F.col("p.m").alias(f"m{side}"), *(F.col(c).alias(f"{c}{side}") for c in ("a", "b")))

    def signed(v: int) -> Column:
        return F.lit(v - (1 << 64) if v >> 63 else v).cast("long")

    xa, xb = F.col("a0").bitwiseXOR(F.col("a1")), F.col("b0").bitwiseXOR(F.col("b1"))

    def apart(i: int) -> Column:
        lo, hi = sum(1 << x for x in bits[i] if x < 64), sum(1 << (x - 64) for x in bits[i] if x >= 64)
        return F.bit_count(xa.bitwiseAND(signed(lo))) + F.bit_count(xb.bitwiseAND(signed(hi)))

    # of the values where two rows meet in a part, the one counts where side 1 has as many of the differing bits as it may, and the lowest
    m0, m1, part = F.col("m0"), F.col("m1"), F.shiftright("at", WIDEST)
    most = F.coalesce(*(F.when(part == i, F.lit(thresholds[i] // 2)) for i in used))
    meeting = (m0.bitwiseAND(m1) == 0) & (F.bit_count(m1) == F.least(most, F.bit_count(m0.bitwiseXOR(m1)))) & ((m0 == 0) | (m1 < m0.bitwiseAND(-m0)))
    first = F.coalesce(*(F.when(apart(i) <= thresholds[i], F.lit(i)) for i in used))
    close = (F.bit_count(xa) + F.bit_count(xb)) <= distance
    once = (F.col("a0") < F.col("a1")) | ((F.col("a0") == F.col("a1")) & (F.col("b0") < F.col("b1")))
    # Spark takes a row's probes for as small as the row itself, so without the hint it broadcasts them all through the driver when the fingerprints are few
    met = probes(0).hint("merge").join(probes(1).hint("merge"), "at").where(once & meeting & close & (part == first))
    return met.select(F.xxhash64("a0", "b0").alias("x"), F.xxhash64("a1", "b1").alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the lowest node of the connected component, for each node of edges (x, y).

    Large-star and small-star steps in turn, until no edge changes. Each step's edges are checkpointed, so an
    executor that is lost costs one step. The joins carry the hint, so no step's edges go through the driver.
    """
    edges = checkpointed(edges.select("x", "y"))
    seen = None
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: what is greater than a node is tied to the lowest of its neighbours
        large = both.where("y > x").hint("merge").join(low, "x").select(F.col("m").alias("x"), "y").distinct()
        # small star: a node and what is lower than it are tied to the lowest
        down = large.select(F.col("y").alias("n"), F.col("x").alias("o"))
        least = down.groupBy("n").agg(F.min("o").alias("m"))
        small = down.hint("merge").join(least, "n").select(F.col("m").alias("x"), F.col("o").alias("y")).where("x < y").union(least.select(F.col("m").alias("x"), F.col("n").alias("y"))).distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if state == seen:
            return edges.select(F.col("y").alias("node"), F.col("x").alias("root")).union(edges.select(F.col("x").alias("node"), F.col("x").alias("root")).distinct())
        seen = state


def grouped(docs: DataFrame, *, distance: int = 20, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, id, keep (key of the one that stays), keep_id and members, for each distinct row of a group of two or more."""
    prints = checkpointed(fingerprinted(docs, id_col, text_col))
    distinct = checkpointed(prints.select("a", "b").distinct())
    roots = components(near_pairs(distinct, distance, parts))
    own = prints.groupBy("a", "b", "key").agg(F.first("id").alias("id"), F.count("*").alias("n"))
    print_ = F.xxhash64("a", "b")
    placed = own.withColumn("node", print_).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("id").isNull().alias("u"), F.col("id").alias("id"), F.col("key").alias("key"))
    first = placed.groupBy("root").agg(F.min(order).alias("f"), F.sum("n").alias("members")).where("members > 1")
    return checkpointed(placed.join(first.hint("merge"), "root").select("key", "id", F.col("f.key").alias("keep"), F.col("f.id").alias("keep_id"), "members", "n"))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The id of each row that goes, with the id of the one of its group that stays and the number of rows in the group."""
    g = grouped(docs, id_col=id_col, text_col=text_col, **options)
    times = F.col("n") - (F.col("key") == F.col("keep")).cast("int")
    return g.where(times > 0).select(F.col("id").alias(id_col), F.col("keep_id").alias("kept_id"), F.col("members"), F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("one")).drop("one")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with the columns it came with."""
    g = grouped(docs, id_col=id_col, text_col=text_col, **options)
    key, gone = fresh(docs, "row_key_of_text", "gone")
    out = docs.withColumn(key, row_key(id_col, text_col))
    lost = g.where("key != keep").select(F.col("key").alias(key)).distinct()
    out = without(out, key, lost)
    # of rows alike in id and text one stays; only what a group keeps can be repeated
    again = g.where("key = keep and n > 1").select(F.col("key").alias(key), F.lit(True).alias(gone))
    if again.isEmpty():
        return out.select(*docs.columns)
    marked = out.join(F.broadcast(again) if small(again) else again, key, "left")
    twice = marked.where(F.col(gone)).dropDuplicates([key])
    return marked.where(F.col(gone).isNull()).unionByName(twice).select(*docs.columns)
