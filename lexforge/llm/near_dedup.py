"""Operator 1: near-duplicate groups by fast similarity sketching.

Method (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching, FOCS 2017). A document's set of
word shingles is thrown into t bins in rounds: in rounds 0..t-1 each element goes to a bin that
the round's hash names, in rounds t..2t-1 all elements go to bin (round - t). A bin keeps the
smallest (round, hash) it gets, so every bin is filled after 2t rounds at most, for sets of any
size, and the share of equal bins of two sets estimates their Jaccard similarity with Chernoff
bounds. The t bins make b bands of r bins.

With t = 96, r = 4 a pair of similarity 0.85 shares no band with probability
(1 - 0.85^4)^24 = 2e-8; pairs that share one are confirmed on the full sets.

Plan at scale, n documents:
* one pass over the texts makes (doc_id, set size, set key, band keys) rows, written
  to the shared folder (about 0.2 KB a document);
* equal sets become one class (partial aggregation: a class with a third of all rows costs a row
  per map task); only class representatives, the smallest doc_id each, go on;
* within a bucket (equal band key) each member is first paired with the smallest member: m - 1
  pairs, not m². Confirmed pairs make components. What is left are pairs across components within
  a bucket; all of them whose signatures don't rule the link out are confirmed in a second round, so
  no link between components is lost, and pairs inside a component, which can't change it, are
  never made. A bucket of more than `BLOCK` members is dealt in blocks, so that no task compares more
  than two blocks;
* components by alternating large-star / small-star rounds on DataFrames, each cut by a checkpoint;
* texts are read twice: once to sketch, once to write those of bucket members.
Nothing is collected to the driver but counts. Hot keys (classes, buckets, star centres, documents of
many pairs) are those with more than one in `HOT_SHARE` of a table's rows, so at most as many: what is
joined to their rows is broadcast, or dealt anew where it is text, and the rest has no hot key.

Nulls, empties: a document without words (or null) has an empty set, links with nothing, is kept.
Rows with a null doc_id can't be linked: each is returned as its own row with a null component and
kept true. A repeated doc_id counts as one document; of its texts the one of the smallest xxhash64
stands for it. Ties: the smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashes, narrow, small_batches, split_words, written

T, R = 96, 4
SKETCH = "doc_id bigint, tk bigint, n_shingles bigint, set_key binary, bands array<bigint>"
#: A key is hot with more than this share of the rows, and more than so many; members compared at once.
HOT_SHARE, HOT_ROWS, BLOCK = 1000, 1000, 2000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _C[1]
    x = (x ^ (x >> _U(27))) * _C[2]
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit shingle hashes; one for a shorter text's whole sequence;
    none without words. Words are hashed per distinct word of the batch."""
    words, index, offsets = split_words(texts)
    hashed = hashes(pc.ascii_lower(words))
    at = np.flatnonzero(~pc.equal(words, "").to_numpy(zero_copy_only=False)[index])
    begin, h = np.searchsorted(at, offsets).tolist(), hashed[index[at]]
    n = max(len(h) - width + 1, 0)
    x = h[:n].copy()
    for k in range(1, width):
        x = mix(x + _C[0]) + h[k : n + k]
    x, out = mix(x), []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if a < b < a + width:
            y = np.array([_C[2]])
            for k in range(a, b):
                y = mix(y + _C[0]) + h[k : k + 1]
            out.append(mix(y))
        else:
            out.append(np.unique(x[a : max(a, b - width + 1)]))
    return out


def fast_sketch(x: np.ndarray, t: int = T) -> np.ndarray:
    """t values of (round << 32 | hash), every bin filled."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, full, np.uint64)
    at, step = 0, max(1, 2048 // len(x))
    while at < t and (out == full).any():
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)  # some rounds at once, as sets can be tiny
        h = mix(x[None, :] + (rounds * _C[0] + _C[2])[:, None])
        bins = ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((h & _U(0xFFFFFFFF)) | (rounds << _U(32))[:, None]).ravel())
        at += step
    for b in np.flatnonzero(out == full):
        i = t + int(b)
        out[b] = ((mix(x + (np.array([i], np.uint64) * _C[0] + _C[2])) & _U(0xFFFFFFFF)) | _U(i << 32)).min()
    return out


def _sketches(width: int, bands: int):
    def run(batches):
        offsets = mix(np.arange(1, bands + 1, dtype=np.uint64) * _C[0])
        for batch in batches:
            n, keys, cuts = [], [], []
            for s in shingle_sets(batch.column(2), width):
                n.append(len(s))
                if not len(s):
                    keys.append(None), cuts.append(None)
                    continue
                b = offsets.copy()
                for part in fast_sketch(s, bands * R).reshape(bands, R).T:
                    b = mix(b + part)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                cuts.append(b.view(np.int64).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(cuts, pa.list_(pa.int64()))], names=["doc_id", "tk", "n_shingles", "set_key", "bands"])

    return run


#: One-bit bins of the signature that the second round compares, and its standard deviations of margin.
BITS, MARGIN = 1024, 4.5


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            rows = [np.packbits((fast_sketch(x, BITS) & _U(1)).astype(np.uint8)).view(np.int64) for x in shingle_sets(batch.column(1), width)]
            rows = np.stack(rows) if rows else np.empty((0, BITS // 64), np.int64)
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["doc_id", *(f"s{k}" for k in range(BITS // 64))])

    return run


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            # rows of one a come together: its set is made once
            _, first, which = np.unique(a.to_numpy(), return_index=True, return_inverse=True)
            left, out = shingle_sets(batch.column(2).take(pa.array(first)), width), []
            for k, y in zip(which.tolist(), shingle_sets(batch.column(3), width), strict=True):
                both = len(np.intersect1d(left[k], y, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(left[k]) + len(y) - both))
            keep = pa.array(out, pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


#: Ids that may be broadcast (about 75 MB as a hash table); beyond, a shuffled join.
BROADCAST_IDS = 500_000


def hot_limit(rows: int) -> int:
    return max(rows // HOT_SHARE, HOT_ROWS)


def attach(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join of rows (total of them) to a table that is cheap to read again, with a row per key and n,
    its number of rows. Hot keys, HOT_SHARE of them at most, are broadcast, and their rows dealt by
    a hash of the whole row."""
    limit = hot_limit(total)
    hot = table.filter(F.col("n") > limit)
    if total <= limit or not hot.count():
        return rows.join(table.drop("n"), key, how)
    given = F.struct(*(c for c in table.columns if c not in (key, "n")))
    some = rows.join(F.broadcast(hot.select(key, given.alias("_hot"))), key, "left")
    dealt = F.xxhash64(*rows.columns).cast("string").cast(table.schema[key].dataType) if table.schema[key].dataType.typeName() == "binary" else F.xxhash64(*rows.columns)
    some = some.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(dealt))
    rest = table.filter(F.col("n") <= limit).select(F.col(key).alias("_key"), given.alias("_rest"))
    out = some.join(rest, "_key", "left").withColumn("_got", F.coalesce("_hot", "_rest"))
    return (out.filter("_got is not null") if how == "inner" else out).select(*rows.columns, "_got.*")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents (doc_id, tk, text) in ids(doc_id, tk)."""
    few = ids.count() <= BROADCAST_IDS // 2
    return docs.join(F.broadcast(ids) if few else ids, ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"]).select("doc_id", "text")


def confirm(text: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that reach the similarity on their full sets; text: doc_id, text.
    Pairs of a hot a are dealt, HOT_ROWS together, to copies of its text."""
    both = pairs.join(text.toDF("b", "text_b"), "b")
    left = text.toDF("a", "text_a")
    limit = hot_limit(pairs.count())
    hot = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > limit))
    if hot.count():
        deals = F.broadcast(hot.select("a", F.ceil(F.col("n") / HOT_ROWS).cast("bigint").alias("deals")))
        zero, n = F.lit(0).cast("bigint"), F.coalesce("deals", F.lit(1).cast("bigint"))
        both = both.join(deals, "a", "left").withColumn("deal", F.pmod(F.xxhash64("b"), n)).drop("deals")
        left = left.join(deals, "a", "left").select("a", "text_a", F.explode(F.sequence(zero, n - 1)).alias("deal"))
        both = both.join(left, ["a", "deal"])
    else:
        both = both.join(left, "a")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a bigint, b bigint"))


def degrees(edges: DataFrame) -> tuple[int, int, bool]:
    """(edges, largest degree, whether they are stars around the smallest of each component) of distinct
    edges (u, v) with u > v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    each = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("up").alias("ups"))
    r = each.agg(F.sum("ups"), F.max("n"), F.max((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("n") > 1)))).first()
    return r[0] or 0, r[1] or 0, not r[2]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of undirected edges (a, b): component is the smallest node
    reachable. Alternates large-star and small-star (Kiveris et al., SoCC 2014) until all edges lead
    from a node to the smallest: O(log² n) rounds, every step an aggregation and a join."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    n, most, done = degrees(e)

    def smallest(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
        """rows with m, the smallest of low's; a star's centre may be hot."""
        return attach(rows, cut(low), "u", total) if most > hot_limit(total) else rows.join(low.drop("n"), "u")

    while not done:
        # large-star: every neighbour above u points to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        e = smallest(both, low, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small-star: u and its smaller neighbours point to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        star = smallest(e, low, n).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(star.filter("u <> v").distinct())
        n, most, done = degrees(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def one_text_each(docs: DataFrame) -> DataFrame | None:
    """(doc_id, tk) of repeated ids of rows (doc_id, tk): the text that stands; None without any."""
    again = cut(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("tk").alias("tk")).filter("n > 1").drop("n"))
    return again if again.limit(1).count() else None


def text_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tk", F.xxhash64("text"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = T) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id. Documents link when
    100 * |intersection| >= percent * |union| of their shingle sets of `width` words."""
    docs = text_key(narrow(docs))
    bands = bins // R
    small_batches(docs.sparkSession)
    table = written(docs.select("doc_id", "tk", "text").mapInArrow(_sketches(width, bands), SKETCH))
    nameless, table = table.filter("doc_id is null"), table.filter("doc_id is not null")
    again = one_text_each(table)
    if again is not None:
        table = table.join(again, "doc_id", "left_anti").unionByName(table.join(again, ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id"]))
    full = table.filter("set_key is not null")
    total = full.count()
    classes = written(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    member = written(attach(full.select("doc_id", "n_shingles", "set_key"), classes, "set_key", total).drop("set_key"))
    copies = cut(member.filter("doc_id <> rep").select("doc_id"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    reps = written(full.join(copies, "doc_id", "left_anti").select("doc_id", "tk", "n_shingles", "bands"))

    bucket = reps.select("doc_id", "tk", F.explode("bands").alias("bucket"))
    centre = written(bucket.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    shared = written(attach(bucket, centre, "bucket", total))  # members of buckets that hold more than one
    first = cut(shared.filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    text = written(texts_of(docs, cut(shared.select("doc_id", "tk").distinct())))
    edges = confirm(text, first, width, percent)
    groups = cut(components(edges))

    # Second round: members of a bucket that are still in different components.
    own = cut(shared.join(groups, shared["doc_id"] == groups["node"], "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("c")))
    spread = cut(own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2").select("bucket", "n", F.col("n").alias("size")))
    open_ = cut(attach(own, spread, "bucket", total))
    if open_.limit(1).count():
        ids = cut(open_.select("doc_id").distinct())
        signs = text.join(ids, "doc_id", "left_semi").mapInArrow(_signatures(width), ", ".join(["doc_id bigint", *(f"s{k} bigint" for k in range(BITS // 64))]))
        signs = written(signs.join(reps.drop("tk"), "doc_id"))
        second = cross_pairs(open_.join(signs, "doc_id"), percent, bands)
        second = cut(second.join(first, ["a", "b"], "left_anti"))
        groups = cut(components(edges.unionByName(confirm(text, second, width, percent))))

    none = table.filter("set_key is null").unionByName(nameless).select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    grouped = groups.join(classes.select(F.col("rep").alias("node"), "n"), "node").select(F.col("node").alias("rep"), "component", "n")
    out = attach(member, cut(grouped), "rep", total, "left").select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")).unionByName(none)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def cross_pairs(members: DataFrame, percent: int, bands: int) -> DataFrame:
    """Distinct pairs (a, b) of one bucket but different components that may reach the similarity:
    set sizes allow it, and so do the signatures of 1024 one-bit bins. Two sets of similarity s agree
    in a bin with probability (1 + s) / 2; a pair at the threshold falls 4.5 standard deviations
    below its mean with a chance of 5e-6, and then matters only if it is the sole link. Members of a
    bucket lie in blocks of about BLOCK, and pairs of blocks are keys of the join."""
    p, words = (1 + percent / 100) / 2, BITS // 64
    most = BITS - int(BITS * p - MARGIN * (BITS * p * (1 - p)) ** 0.5)
    blocks = F.ceil(F.col("size") / BLOCK).cast("bigint")
    members = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    members = members.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("size", "other")
    key = ["bucket", "lo", "hi"]
    x, y = (members.select([F.col(c).alias(f"{c}_{side}") for c in members.columns if c not in key] + key) for side in "xy")
    differ = sum((F.bit_count(F.col(f"s{k}_x").bitwiseXOR(F.col(f"s{k}_y"))) for k in range(words)), F.lit(0))
    shared = F.lit(None).cast("bigint")  # the first band that the two share makes the pair, so that it is made once
    for k in reversed(range(bands)):
        shared = F.when(F.col("bands_x")[k] == F.col("bands_y")[k], F.col("bands_x")[k]).otherwise(shared)
    met = F.lit(True)
    for k in key:
        met = met & (x[k] == y[k])
    pair = x.join(y, met & (F.col("doc_id_x") < F.col("doc_id_y")) & (F.col("c_x") != F.col("c_y")) & ((F.col("block_x") != F.col("block_y")) | (x["lo"] == x["hi"]))
        & (100 * F.least("n_shingles_x", "n_shingles_y") >= percent * F.greatest("n_shingles_x", "n_shingles_y")) & (differ <= most) & (shared == x["bucket"]))
    return pair.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"))
