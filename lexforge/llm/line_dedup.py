"""Operator 13: line dedup. Lines whose key is found in three documents or more stay only in the
largest doc_id that holds them.

Levelled sorted runs of line hashes (`LineRuns`). A run has one row per line key: its 128-bit hash and
the three largest doc_ids that hold it, which is all that the rule asks for, and which merges without
counting twice. Runs are tables bucketed and sorted by the hash, so joins between them and with a
batch don't shuffle them. Each new batch of documents is reduced to its keys, merge-anti-joined with
the runs (a key whose three largest holders all exceed the batch's tells nothing new), and what
remains is added as a run of its own; whenever `FANOUT` runs lie on a level, they are compacted by an
outer merge join into one of the next level. In the end all runs are merged, and the keys with a third
holder are the ones to drop. They are broadcast to one pass over the texts if they are at most
`BROADCAST_KEYS`; else the lines are joined with them, and each text with its own hits.

Scale: texts are read twice and, up to that bound, never shuffled; of lines only 24 bytes a key and
holder move, after each task has cut a key to its three largest holders, so a line that every document holds
is three rows a task. Adding a batch again, after a failure, changes nothing.

Rows: a null text is empty and has one empty line. A row without doc_id counts as no document, and
loses lines as any other that isn't the largest. Rows of one doc_id are one document. Keys are
compared by 128-bit hashes. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_chunks, narrow, scratch_dir, small_batches, written

LEAST_CHARS, HOLDERS = 20, 3
#: Batches that a whole table is dealt into, runs a level holds before they are compacted, and keys
#: a bucket of a run has at about.
BATCHES, FANOUT, BUCKET_KEYS = 4, 2, 2_000_000
#: Keys to drop that are broadcast at most (24 bytes each), and rows that a task cuts to the largest holders at a time.
BROADCAST_KEYS, BUFFER = 500_000, 1 << 19
_BLANK, _CONTINUED = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0))
_HASH = ["h1", "h2"]


def line_key(line: bytes, least: int) -> bytes | None:
    """16 bytes of the stripped, lower-cased line; None if it is short."""
    k = line.strip(_BLANK).lower()
    return xxhash.xxh3_128_digest(k) if len(k) >= least and len(k.translate(None, _CONTINUED)) >= least else None


def pairs(digests: list[bytes]) -> np.ndarray:
    """Two 64-bit integers a digest."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def largest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, docs) cut to each key's HOLDERS largest documents, in order."""
    order = np.lexsort((~docs, keys[:, 1], keys[:, 0]))
    keys, docs = keys[order], docs[order]
    new_key = np.ones(len(docs), bool)
    new_key[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    new = new_key.copy()
    new[1:] |= docs[1:] != docs[:-1]
    keys, docs, new_key = keys[new], docs[new], new_key[new]
    at = np.arange(len(docs))
    keep = at - np.maximum.accumulate(np.where(new_key, at, 0)) < HOLDERS
    return keys[keep], docs[keep]


def held(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2, doc_id: of every task's line keys the largest holders."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, owners, lengths = [], [], []

        def out() -> pa.RecordBatch:
            keys, ids = largest(pairs(digests), np.repeat(np.array(owners, np.int64), lengths))
            return pa.record_batch([keys[:, 0].copy(), keys[:, 1].copy(), ids], ["h1", "h2", "doc_id"])

        for b in in_chunks(batches, 8 << 20):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = {k for line in text.split(b"\n") if (k := line_key(line, least))}
                digests += mine
                owners.append(doc)
                lengths.append(len(mine))
            if len(digests) >= BUFFER:
                yield out()
                digests, owners, lengths = [], [], []
        if digests:
            yield out()

    small_batches(docs.sparkSession)
    return docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(over, "h1 long, h2 long, doc_id long")


class LineRuns:
    """Sorted runs of line keys in levels, kept as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels = spark, buckets, []
        self.name = f"lexforge_runs_{uuid.uuid4().hex}"
        self.made = 0

    def store(self, run: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        run.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def add(self, rows: DataFrame) -> None:
        """A batch's (h1, h2, doc_id): what the runs don't know yet becomes a run."""
        dealt = rows.repartition(self.buckets, *_HASH).distinct()
        place = F.row_number().over(W.partitionBy(*_HASH).orderBy(F.desc("doc_id")))
        batch = dealt.select("*", place.alias("place")).filter(F.col("place") <= HOLDERS).groupBy(*_HASH).agg(*(F.max(F.when(F.col("place") == k + 1, F.col("doc_id"))).alias(f"top{k}") for k in range(HOLDERS)))
        for run in (name for level in self.levels for name in level):
            known = self.spark.table(run).filter(f"top{HOLDERS - 1} is not null").select(*(F.col(h).alias(f"_{h}") for h in _HASH), F.col(f"top{HOLDERS - 1}").alias("_least")).hint("merge")
            batch = batch.join(known, F.expr("h1 = _h1 and h2 = _h2 and top0 < _least"), "left_anti")
        self.put(self.store(batch), 0)

    def put(self, run: str, level: int) -> None:
        """Places a run; a full level is compacted into the next."""
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            full, self.levels[level] = self.levels[level], []
            self.put(self.compact(full), level + 1)

    def compact(self, runs: list[str]) -> str:
        out = self.store(reduce(self.merged, map(self.spark.table, runs)))
        for run in runs:
            self.drop(run)
        return out

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Outer merge join of two runs: each key with the largest holders of both."""
        tops = [f"top{k}" for k in range(HOLDERS)]
        b = b.select(*(F.col(c).alias(f"_{c}") for c in (*_HASH, *tops))).hint("merge")
        all_ = F.array(*map(F.col, tops), *(F.col(f"_{c}") for c in tops))
        best = F.slice(F.sort_array(F.array_distinct(F.filter(all_, lambda x: x.isNotNull())), asc=False), 1, HOLDERS)
        both = a.join(b, F.expr("h1 = _h1 and h2 = _h2"), "full_outer").select(*(F.coalesce(h, f"_{h}").alias(h) for h in _HASH), best.alias("best"))
        return both.select(*_HASH, *(F.get("best", F.lit(k)).alias(t) for k, t in enumerate(tops)))

    def common(self) -> DataFrame:
        """h1, h2, top: the keys that have HOLDERS documents, with the largest; written, as the runs go."""
        runs = [name for level in self.levels for name in level]
        if len(runs) > 1:
            runs = [self.compact(runs)]
        out = written(self.spark.table(runs[0]).filter(f"top{HOLDERS - 1} is not null").select(*_HASH, F.col("top0").alias("top")))
        self.drop(runs[0])
        self.levels = []
        return out

    def drop(self, name: str) -> None:
        """The table and, as it has a path of its own, its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(self.spark)}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class Lookup:
    """Places of digests among sorted ones, -1 where there is none."""

    def __init__(self, keys: np.ndarray, tops: np.ndarray):
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.keys, self.tops = keys[order], tops[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        at = np.searchsorted(self.keys[:, 0], keys[:, 0])
        found = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        while len(todo):  # again only for keys that share their first half
            todo = todo[at[todo] < n]
            todo = todo[self.keys[at[todo], 0] == keys[todo, 0]]
            hit = self.keys[at[todo], 1] == keys[todo, 1]
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return found


DECIDED = "doc_id long, text binary, n_lines long, n_dropped long"


def decided(docs: DataFrame, least: int, known: Lookup | None) -> DataFrame:
    """doc_id, text of the kept lines, n_lines, n_dropped. docs: doc_id, text and, without `known`, gone:
    the digests to drop of the text."""
    told = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_chunks(batches, 8 << 20):
            ids, texts = b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            lines = [t.split(b"\n") for t in texts]
            keys = [[line_key(x, least) for x in ls] for ls in lines]
            if told is not None:
                asked = [k for ks in keys for k in ks if k]
                places = told.value.find(pairs(asked))
                tops = np.where(places < 0, 0, told.value.tops[places] if len(told.value.tops) else 0)
                at = iter(zip((places >= 0).tolist(), tops.tolist(), strict=True))
                gone = [[k is not None and (hit := next(at))[0] and hit[1] != doc for k in ks] for doc, ks in zip(ids, keys, strict=True)]
            else:
                sets = [frozenset(x or ()) for x in b.column(1).to_pylist()]
                gone = [[k in s for k in ks] for s, ks in zip(sets, keys, strict=True)]
            kept = [b"\n".join(x for x, g in zip(ls, gs, strict=True) if not g) for ls, gs in zip(lines, gone, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(kept, pa.binary()), pa.array(map(len, lines), pa.int64()), pa.array(map(sum, gone), pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return docs.mapInArrow(over, DECIDED).withColumn("text", F.col("text").cast("string"))


def joined(docs: DataFrame, common: DataFrame, least: int) -> DataFrame:
    """doc_id, gone, text: each text with the digests it loses, by joins; rows of one id and text share them."""

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_chunks(batches, 8 << 20):
            mine = [list({k for line in t.split(b"\n") if (k := line_key(line, least))}) for t in b.column(2).to_pylist()]
            n = [len(x) for x in mine]
            flat = [k for x in mine for k in x]
            h = pairs(flat)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), h[:, 0].copy(), h[:, 1].copy(), pa.array(flat, pa.binary())], ["doc_id", "tk", "h1", "h2", "key"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.col("text").cast("binary").alias("text"))
    each = keyed.mapInArrow(lines, "doc_id long, tk long, h1 long, h2 long, key binary")
    lost = each.join(common.hint("merge"), _HASH).filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = lost.groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_set("key").alias("gone"))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left").select("doc_id", "gone", "text")


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """doc_id, text without the lines that go, n_lines, n_dropped."""
    spark, docs = docs.sparkSession, narrow(docs)
    rows = written(held(docs, least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))))
    n = rows.count()
    runs = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_KEYS)))
    for k in range(batches):
        runs.add(rows.filter(F.col("batch") == k).drop("batch"))
    common = runs.common()
    binary = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if common.count() > BROADCAST_KEYS:
        return decided(joined(docs, common, least), least, None)
    t = common.toArrow()
    column = lambda c: t.column(c).to_numpy()
    return decided(binary, least, Lookup(np.stack([column(h) for h in _HASH], 1).reshape(-1, 2), column("top")))
