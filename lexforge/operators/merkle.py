"""Digests of tables as Merkle trees over ranges of hashed keys.

A leaf is a range of the keys' hashes, named by its first hexadecimal digits. It holds the number of its rows
and four sums of 32-bit parts of the rows' hashes; sums don't depend on order, are partial before they
shuffle, count repeated rows, and can be taken away again, so a delta updates the leaves that its rows
lie in and nothing else. A node's digest is over its children's, up to the root. Two trees are
compared from the root down, and only below nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = ["l0", "l1", "l2", "l3"]
LEAF = "node string, n long, l0 long, l1 long, l2 long, l3 long"
#: Leaves of a depth: 16 to its power.
DEPTH = 4
#: Differing nodes of a level whose children are asked for as ranges of names; beyond it, by a join.
RANGES = 64


def row_hash(columns: list[str]) -> Column:
    """16 bytes of a row: the MD5 of its columns as text."""
    return F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))))


def leaf_of(key: list[str], depth: int) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in key))), 1, depth)


def leaves(rows: DataFrame, key: list[str], depth: int, sign: int = 1) -> DataFrame:
    """node, n and the lanes' sums of rows with a `_hash`; sign -1 to take them away."""
    part = lambda i: F.conv(F.hex(F.substring("_hash", 1 + 4 * i, 4)), 16, 10).cast("bigint")
    return rows.groupBy(leaf_of(key, depth).alias("node")).agg((F.count(F.lit(1)) * sign).alias("n"), *((F.sum(part(i)) * sign).alias(lane) for i, lane in enumerate(LANES)))


def added(*parts: DataFrame) -> DataFrame:
    """The sum of leaves; those left without rows go."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n", *LANES))).filter("n <> 0")


def tree(leaf: DataFrame, depth: int) -> DataFrame:
    """level, node, n, digest: the leaves (level = depth) and what stands above them, up to the root
    (level 0, node ''). A node has 16 children at most."""
    at = leaf.select(F.lit(depth).alias("level"), "node", "n", F.md5(F.concat_ws("|", "n", *LANES)).alias("digest"))
    out = at
    for level in range(depth - 1, -1, -1):
        kids = F.sort_array(F.collect_list(F.struct("node", "digest")))
        at = at.groupBy(F.substring("node", 1, level).alias("node")).agg(F.sum("n").alias("n"), F.md5(F.array_join(F.transform(kids, lambda x: x["digest"]), "|")).alias("digest")).select(F.lit(level).alias("level"), "node", "n", "digest")
        out = out.unionByName(at)
    return out


def root(leaf: DataFrame, depth: int) -> DataFrame:
    """(n, digest) of the whole table; of an empty one 0 and the digest of nothing."""
    top = tree(leaf, depth).filter("level = 0")
    return top.agg(F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.max("digest"), F.md5(F.lit(""))).alias("digest"))  # one row


def table_digest(df: DataFrame, key: list[str], columns: list[str], depth: int = DEPTH) -> DataFrame:
    """(n, digest) of a table from scratch."""
    return root(leaves(df.withColumn("_hash", row_hash(columns)), key, depth), depth)


def differing(a: DataFrame, b: DataFrame, depth: int) -> list[DataFrame]:
    """By level, the nodes (node) at which two stored trees differ: each level is read only below the
    nodes of the one above."""
    found: list[DataFrame] = []
    for level in range(depth + 1):
        sides = [t.filter(F.col("level") == level) for t in (a, b)]
        if level:
            few = [r.node for r in found[-1].limit(RANGES + 1).collect()]
            if not few:
                return found
            if len(few) <= RANGES:
                below = F.lit(False)
                for p in few:
                    below = below | F.col("node").between(p + "0", p + "f")
                sides = [s.filter(below) for s in sides]
            else:
                above = found[-1].withColumnRenamed("node", "_above")
                sides = [s.join(above, F.substring("node", 1, level - 1) == F.col("_above"), "left_semi") for s in sides]
        x, y = (s.select("node", F.col("digest").alias(name)) for s, name in zip(sides, "xy", strict=True))
        found.append(x.join(y, "node", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("node"))
    return found
