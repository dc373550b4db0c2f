"""Operator 11: filter interaction audit. For every order of a set of filters: what each step removes,
what it finds already gone, what it costs in good and toxic documents, and its Shapley count.

Fingerprint-routed RDD. Each task keeps the texts it has seen in collision chains: fingerprint
(xxhash) -> [text, smallest id, its rows]. A row of a larger id than its text's smallest is a
duplicate for certain and is emitted at once, so a group of copies, however large, leaves a task as
one chain entry. Entries are partitioned by fingerprint; there chains meet, full texts decide (texts
travel and lie compressed), and the smallest ids remain. Rows emitted before go on by their own id,
so no partition gets a group's members. combineByKey merges vectors of counts by mask of failed
filters, one vector a part; all 120 orders are read off a part's vector.

Memory: a task's chains are flushed at `FLUSH` bytes; the number of partitions of fingerprints follows
the bytes of all texts, so that each holds about `PARTITION` of them, compressed.

Rows: a null text counts as empty, and empty texts are copies of each other. A null doc_id is larger
than none and smaller than none: its row never fails as a duplicate and makes no other fail. Rows of one
id and one text don't fail each other. A null part is the empty string. Of several labels of a
document, any that says 1 counts. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Callable, Iterable, Iterator

import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter: its letter and whether (text as UTF-8, its words) fails it.
Filter = tuple[str, Callable[[bytes, list[bytes]], bool]]
_CAPITALS, _CONTINUED = string.ascii_uppercase.encode(), bytes(range(0x80, 0xC0))
_SYMBOLS = re.compile(rb"[#$%&*|]")


def code_points(text: bytes) -> int:
    return len(text.translate(None, _CONTINUED))


FILTERS: list[Filter] = [
    ("A", lambda text, words: len(words) < 100),
    ("B", lambda text, words: 100 * len(set(words)) < 80 * len(words)),
    ("C", lambda text, words: 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * code_points(text)),
    ("D", lambda text, words: _SYMBOLS.search(text) is not None),
]
DUPLICATE = "E"
#: Compressed bytes of chains that a task keeps before it passes them on; bytes of text, packed then, that
#: a partition of fingerprints gets at about.
FLUSH, PARTITION = 32 << 20, 128 << 20


class Chains:
    """fingerprint -> [[text, smallest id, mask, {part: rows of that id}], ...]; texts compressed."""

    def __init__(self):
        self.by, self.size, self.unpack = {}, 0, zstandard.ZstdDecompressor().decompress

    def same(self, a: bytes, b: bytes) -> bool:
        return a == b or self.unpack(a) == self.unpack(b)

    def put(self, key: int, text: bytes, doc: int, mask: int, parts: dict[str, int], last: int) -> Iterator[tuple]:
        """Adds an entry; yields (doc, part, mask, n) of rows that have become duplicates."""
        chain = self.by.setdefault(key, [])
        at = next((e for e in chain if self.same(e[0], text)), None)
        if at is None:
            chain.append([text, doc, mask, dict(parts)])
            self.size += len(text) + 200
        elif at[1] == doc:
            for p, n in parts.items():
                at[3][p] = at[3].get(p, 0) + n
        else:
            larger = (doc, parts) if doc > at[1] else (at[1], at[3])
            if doc < at[1]:
                at[1], at[3] = doc, dict(parts)
            yield from ((larger[0], p, mask | last, n) for p, n in larger[1].items())

    def entries(self) -> Iterator[tuple[int, list]]:
        return ((key, e) for key, chain in self.by.items() for e in chain)


def masks(docs: DataFrame, part: str, filters: list[Filter]) -> DataFrame:
    """doc_id, part, mask, n: bit i of the mask is set if the i-th filter fails; the last bit is the
    duplicates'. n counts equal rows."""
    tests, last = [f for _, f in filters], 1 << len(filters)

    def local(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        pack, chains = zstandard.ZstdCompressor(level=1).compress, Chains()
        for doc, text, p in rows:
            text = text.encode()
            words = text.split()
            mask = sum(1 << i for i, f in enumerate(tests) if f(text, words))
            if doc is None:
                yield xxhash.xxh3_64_intdigest(text), (doc, p, mask, 1)
                continue
            for gone in chains.put(xxhash.xxh3_64_intdigest(text), pack(text), doc, mask, {p: 1}, last):
                yield hash(gone[0]), gone
            if chains.size > FLUSH:
                yield from chains.entries()
                chains = Chains()
        yield from chains.entries()

    def meet(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
        chains = Chains()
        for key, x in records:
            if isinstance(x, tuple):
                yield x
            else:
                yield from chains.put(key, *x, last)
        for _, (_, doc, mask, parts) in chains.entries():
            yield from ((doc, p, mask, n) for p, n in parts.items())

    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col(part).cast("string"), F.lit("")))
    routed = rows.rdd.mapPartitions(local).partitionBy(n, lambda key: key).mapPartitions(meet)
    return spark.createDataFrame(routed, "doc_id long, part string, mask int, n long", verifySchema=False)


def orders(letters: str, vector: list[int]) -> Iterator[tuple]:
    """(filter_order, step, counts...) of every order, from counts, good and toxic by mask."""
    k = len(letters)
    count, good, toxic = (vector[i << k : (i + 1) << k] for i in range(3))
    firsts = [0] + [len(list(itertools.permutations(range(k)))) // size for size in range(1, k + 1)]
    bits = {x: 1 << i for i, x in enumerate(letters)}
    total = {x: sum(c * firsts[m.bit_count()] for m, c in enumerate(count) if m & b) for x, b in bits.items()}
    for order in itertools.permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            b = bits[x]
            here = [m for m in range(1 << k) if m & b and not m & before]
            redundant = sum(count[m] for m in range(1 << k) if m & b and m & before)
            before |= b
            kept = sum(c for m, c in enumerate(count) if not m & before)
            yield "".join(order), step, kept, sum(count[m] for m in here), redundant, count[b], sum(good[m] for m in here), sum(toxic[m] for m in here), total[x]


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: list[Filter] = FILTERS) -> DataFrame:
    """One row per part, order of the filters (and of the duplicate filter) and step."""
    letters = "".join(x for x, _ in filters) + DUPLICATE
    width = 1 << len(letters)
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    told = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = masks(docs, part, filters).join(told, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(vector: list[int], x: tuple) -> list[int]:
        mask, n, good, toxic = x
        vector[mask] += n
        vector[width + mask] += n * good
        vector[2 * width + mask] += n * toxic
        return vector

    merged = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda x: add([0] * (3 * width), x), add, merged)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda pv: ((pv[0], *x) for x in orders(letters, pv[1]))), REPORT, verifySchema=False)
