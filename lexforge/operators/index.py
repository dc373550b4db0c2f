"""The stored inverted index: built once, read by term, best postings first.

Layout under one folder: `postings` (term, chunk_id, document_id, tf, len, part and the columns that
searches filter by), sorted within each file by a hash bucket of the term, term and falling impact, in small
row groups, of which a search reads those of its terms. A posting's impact is `part`, its share of a BM25 score without the term's weight; impacts
are cut into levels, and a term's postings of a level are a block. `heads` has each block's number of
postings and its largest impact; `forward` a row per chunk with its terms; `terms` (term, df).
So a search reads the blocks that can still reach the best k, and its candidates' postings.

Postings lie in a folder a bucket. Segments are of the collection, as search engines have them: one task writes all postings of its chunks, so
that a term of every chunk lies in all of them. Tokens are cut on the JVM; a batch's term counts are made on
arrays. Neither texts nor postings are shuffled by the build, only a row per (segment, term, level).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.stem import stem
from ..functions.text import STOPWORDS, TOKEN, tokens

K1, B = 1.5, 0.75
#: Buckets at least and at most, postings a bucket has at about, levels of an impact of one.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS, LEVELS = 32, 4096, 50_000_000, 64
#: Bytes of chunks' rows that a segment of postings is made of, and of a row group.
SEGMENT_BYTES, GROUP_BYTES = 16 << 20, 1 << 20
#: Columns by which searches filter; they stand in each posting, where they take next to no room.
FILTERS = "kind string, source string, lang string, valid_from date, valid_to date"


def _counts(batches):
    """(chunk's columns, len, terms, tfs): a chunk's distinct terms with their counts."""
    for batch in batches:
        words = batch.column(batch.num_columns - 1)
        sizes = words.value_lengths().to_numpy()
        code = words.flatten().dictionary_encode()
        width = max(len(code.dictionary), 1)
        pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + code.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.append(0, np.cumsum(np.bincount(pairs // width, minlength=len(sizes)))).astype(np.int32))
        terms = code.dictionary.take(pa.array(pairs % width)).cast(pa.string())
        yield pa.record_batch([*batch.columns[:-1], pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], names=[*batch.schema.names[:-1], "len", "terms", "tfs"])


def plain(body: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(body), F.lit(TOKEN), F.lit(0))


def french(body: Column) -> Column:
    """Folded, without French function words, stemmed; a query's terms must go the same way."""
    return stem(F.filter(tokens(body), lambda w: ~w.isin(STOPWORDS)))


def part(tf: Column, length: Column, avg_len: float) -> Column:
    """A posting's impact: its share of a score but for the term's weight; 2.5 at most."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def build(chunks: DataFrame, path: str, analyzer: Callable[[Column], Column] = plain) -> None:
    """Writes the index of chunks (chunk_id, document_id, body and the columns of FILTERS)."""
    spark = chunks.sparkSession
    names = ["chunk_id", "document_id", *(c.split()[0] for c in FILTERS.split(", "))]
    words = analyzer(F.coalesce("body", F.lit("")))
    schema = ", ".join([f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}", f"document_id {chunks.schema['document_id'].dataType.simpleString()}", FILTERS, "len bigint, terms array<string>, tfs array<bigint>"])
    storage.small_batches(spark)
    rows = chunks.select(*names, words.alias("words")).mapInArrow(_counts, schema)
    rows.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    s = forward.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), F.sum(F.size("terms")).alias("postings")).first()
    total, avg_len = s.postings or 0, s.avg_len or 1.0
    buckets = min(MOST_BUCKETS, max(BUCKETS, total // BUCKET_ROWS))
    posts = forward.select(*names, "len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(*names, "len", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    impact = part(F.col("tf"), F.col("len"), avg_len)
    posts = posts.select("*", impact.alias("part"), F.floor(impact * LEVELS).cast("int").alias("level"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    with in_splits(spark, SEGMENT_BYTES):  # a task sorts the postings of a split
        posts.sortWithinPartitions("bucket", "term", F.desc("level"), "chunk_id").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(f"{path}/postings")
    heads = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("top"))
    heads.sortWithinPartitions("bucket", "term", F.desc("level")).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/heads")
    df = spark.read.parquet(f"{path}/heads").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    df.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/terms")
    spark.createDataFrame([(s.n, avg_len, buckets)], "n long, avg_len double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


@contextmanager
def in_splits(spark: SparkSession, size: int):
    """Files are read in splits of at most so many bytes meanwhile."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucket_of(term: str, buckets: int) -> int:
    """What Spark's pmod(xxhash64(term), buckets) is."""
    h = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


@dataclass
class Index:
    postings: DataFrame
    heads: DataFrame
    forward: DataFrame
    terms: DataFrame
    n: int
    avg_len: float
    buckets: int
    known: dict[str, list[tuple[int, int, float]]] = field(default_factory=dict)

    @property
    def chunks(self) -> DataFrame:
        """chunk_id, document_id and the filter columns, a row per chunk."""
        return self.forward.drop("terms", "tfs")

    def of(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of these terms; buckets and terms are pushed to the scan, which skips other row groups."""
        return rows.filter(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(terms))

    def blocks(self, terms: list[str]) -> dict[str, list[tuple[int, int, float]]]:
        """(level, postings, largest impact) of the blocks of a query's terms, best first, remembered: the
        index doesn't change. A term has 160 of them at most."""
        new = [t for t in terms if t not in self.known]
        if new:
            self.known |= {t: [] for t in new}
            for r in self.of(self.heads, new).collect():
                self.known[r.term].append((r.level, r.n, r.top))
            for t in new:
                self.known[t].sort(reverse=True)
        return {t: self.known[t] for t in terms if self.known[t]}

    def weights(self, terms: list[str]) -> dict[str, float]:
        """idf = ln(1 + (N - df + 0.5) / (df + 0.5)) of a query's terms that stand in the index."""
        df = {t: sum(n for _, n, _ in bs) for t, bs in self.blocks(terms).items()}
        return {t: math.log(1 + (self.n - n + 0.5) / (n + 0.5)) for t, n in df.items()}

    def weighted(self, idf: dict[str, float], term: str = "term") -> Column:
        out = F.lit(0.0)
        for t, x in idf.items():
            out = F.when(F.col(term) == t, x).otherwise(out)
        return out

    def scores(self, terms: list[str], keep: Column | None = None) -> DataFrame:
        """chunk_id, document_id and filter columns, score (rounded to 6 places) of every chunk that
        holds a term and passes the filter. Of the collection only the blocks' counts of the query's
        terms come to the driver."""
        posts = self.of(self.postings, terms)
        if keep is not None:
            posts = posts.filter(keep)
        first = [F.first(c).alias(c) for c in posts.columns if c not in ("term", "tf", "len", "part", "level", "bucket", "chunk_id", "document_id")]
        return posts.groupBy("chunk_id", "document_id").agg(*first, F.round(F.sum(self.weighted(self.weights(terms)) * F.col("part")), 6).alias("score"))

    # --- best first

    def cuts(self, terms: list[str], least: float) -> dict[str, tuple[int, float]]:
        """By term, the level from which on blocks are read, and the largest impact of those below it, such that a
        chunk with none of the read postings stays under `least`. The blocks with most postings for
        the score that leaving them out may cost go first."""
        idf, blocks = self.weights(terms), {t: list(reversed(b)) for t, b in self.blocks(terms).items()}
        left, at = least, dict.fromkeys(blocks, 0)
        while True:
            gain = []
            for t, b in blocks.items():
                cut = b[at[t] - 1][2] if at[t] else 0.0
                rows = 0
                for k in range(at[t], len(b)):
                    rows += b[k][1]
                    cost = idf[t] * (b[k][2] - cut)
                    if cost < left:
                        gain.append((rows / (cost + 1e-12), t, k, cost))
            if not gain:
                return {t: (b[at[t]][0] if at[t] < len(b) else b[-1][0] + 1, b[at[t] - 1][2] if at[t] else 0.0) for t, b in blocks.items()}
            _, t, k, cost = max(gain)
            left, at[t] = left - cost, k + 1

    def read(self, terms: list[str], levels: dict[str, int]) -> DataFrame:
        """Postings of the terms from a level on each."""
        some = F.lit(False)
        for t, level in levels.items():
            some = some | ((F.col("term") == t) & (F.col("level") >= level))
        return self.of(self.postings, terms).filter(some)

    def best(self, terms: list[str], limit: int, keep: Column | None = None, told: dict | None = None) -> DataFrame:
        """chunk_id, document_id, filter columns and score of the best `limit` chunks (ties: smaller
        chunk_id), equal to those of `scores`. First the best blocks give a bound that the result
        reaches; then blocks that can't reach it aren't read, and candidates get their whole scores
        from their own postings. told: gets the postings there are, and those read."""
        order = [F.desc("score"), F.asc("chunk_id")]
        idf, blocks = self.weights(terms), self.blocks(terms)
        total = sum(n for b in blocks.values() for _, n, _ in b)
        told = {} if told is None else told
        told |= {"postings": total, "read": total}
        if total <= SMALL:
            return self.scores(terms, keep).orderBy(*order).limit(limit)
        kept = (lambda df: df if keep is None else df.filter(keep))
        worth = self.weighted(idf) * F.col("part")
        first, seen = {}, 0
        for t, b in blocks.items():
            rows = 0
            for level, n, _ in b:
                rows += n
                first[t] = level
                if rows >= FIRST * limit:
                    break
            seen += rows
        low = kept(self.read(terms, first)).groupBy("chunk_id").agg(F.sum(worth).alias("low")).orderBy(F.desc("low")).limit(limit).collect()
        if len(low) < limit:
            return self.scores(terms, keep).orderBy(*order).limit(limit)
        least = low[-1].low - 1e-6
        cut = self.cuts(terms, least)
        told["read"] = seen + sum(n for t, b in blocks.items() for level, n, _ in b if level >= cut[t][0])
        rest = sum(idf[t] * x for t, (_, x) in cut.items())
        # what the terms not met in the read blocks can add at most
        more = self.weighted({t: idf[t] * x for t, (_, x) in cut.items()})
        found = kept(self.read(terms, {t: level for t, (level, _) in cut.items()})).groupBy("chunk_id").agg(F.sum(worth - more).alias("gain"))
        ids = found.filter(F.col("gain") + rest >= least).select("chunk_id")
        few = [r.chunk_id for r in ids.limit(CANDIDATES + 1).collect()]
        posts = self.of(self.postings, terms)
        posts = posts.filter(F.col("chunk_id").isin(few)) if len(few) <= CANDIDATES else posts.join(ids, "chunk_id", "left_semi")
        names = [c for c in posts.columns if c not in ("term", "tf", "len", "part", "level", "bucket", "chunk_id", "document_id")]
        # a term's share is one posting's; they are added in the query's order
        shares = [F.max(F.when(F.col("term") == t, x * F.col("part"))).alias(f"_{i}") for i, (t, x) in enumerate(idf.items())]
        whole = posts.groupBy("chunk_id", "document_id").agg(*(F.first(c).alias(c) for c in names), *shares)
        score = F.lit(0.0)
        for i in range(len(shares)):
            score = score + F.coalesce(f"_{i}", F.lit(0.0))
        return whole.select("chunk_id", "document_id", *names, F.round(score, 6).alias("score")).orderBy(*order).limit(limit)


#: Up to so many postings all are read at once; postings a term gives to the first bound, for each row asked for;
#: candidates that are looked up by their ids.
SMALL, FIRST, CANDIDATES = 20_000, 20, 2_000


def open_index(spark: SparkSession, path: str) -> Index:
    s = spark.read.parquet(f"{path}/stats").first()
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "heads", "forward", "terms")), s.n, s.avg_len, s.buckets)


_open: dict[str, Index] = {}


def stored(chunks: DataFrame, *key: str) -> Index:
    """The index of chunks under a key: built where it isn't yet, opened once a session."""
    spark = chunks.sparkSession
    path = storage.place(spark, "index", *key)
    if path not in _open:
        if not storage.complete(spark, f"{path}/stats"):
            build(chunks, path)
        _open[path] = open_index(spark, path)
    return _open[path]
