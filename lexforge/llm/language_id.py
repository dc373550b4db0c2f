"""Operator 3: language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree: counts of a byte after its last 4, 3, 2, 1 and
0 bytes; contexts of the two longest orders that were met but once, in all languages together, are
cut off. A byte that a context didn't see escapes to the next shorter one by method C (Cleary, Witten,
Moffat): with n counts of d distinct bytes, P(byte) = count / (n + d), P(escape) = d / (n + d); contexts
never seen cost nothing; order -1 is uniform over 256 bytes. The statistics are frozen after the fit,
so the exact code length of a byte depends on the last five bytes alone. The trees of all languages
are merged: a node has the code lengths of its byte in every language, its escapes worked in, so
that one look-up in a hash table settles most bytes, and others go on from the escape costs of their
context in the shorter order's table. A text's code length is the sum over all of its bytes; the
shortest code wins, ties go to the first language by name.

Fit: training rows with a language, at most about `SAMPLE` of them with about `CHARS` characters, chosen
by hash, counted in one map and one aggregation; the driver gets a row per language and distinct five
bytes of these, some hundred thousand, and no node of their trees is left out but contexts met once. So
the trees are broadcast at any size of the corpus (about 30 MB with 4 languages, 4 more bytes a node
with each). Scoring is one map, no shuffle.

`und` with score 0 for null texts, texts without a letter, and if nothing could be learned.
Otherwise score is the winner's posterior at `TEMPER` bits weight a byte. Repeated rows are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, in_chunks, narrow, small_batches

SAMPLE, CHARS, TEMPER = 6000, 16_000_000, 0.5
ORDER, GROUP = 4, 1 << 18
_U = np.uint64
#: What stands before a text.
START = b"\n" * ORDER


def grams(data: np.ndarray) -> np.ndarray:
    """Codes of the five bytes that end at each byte but the first four."""
    code = data[: len(data) - ORDER].astype(_U)
    for k in range(1, ORDER + 1):
        code = (code << _U(8)) | data[k : len(data) - ORDER + k]
    return code


def _count(batches):
    """Five-byte strings per language: (lang, code, n)."""
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, codes in held.items():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            held.setdefault(lang.as_py(), []).append(grams(np.frombuffer(START + text.as_py(), np.uint8)))
            size += 8 * len(held[lang.as_py()][-1])
            if size > 64 << 20:
                yield from flush()
                size = 0
    yield from flush()


class Table:
    """Open-addressing hash table of codes to rows of a matrix."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray) -> None:
        self.rows = rows.astype(np.float32)
        self.bits = max(4, int(4 * len(codes)).bit_length())
        self.keys, self.at = np.full(1 << self.bits, ~_U(0), _U), np.zeros(1 << self.bits, np.int32)
        slot, todo = self._slot(codes), np.arange(len(codes))
        while len(todo):
            free = self.keys[slot[todo]] == ~_U(0)
            self.keys[slot[todo[free]]] = codes[todo[free]]  # of codes for one slot the last one stays
            self.at[slot[todo[free]]] = todo[free]
            todo = todo[self.keys[slot[todo]] != codes[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for codes that aren't in the table."""
        slot = self._slot(codes)
        key = self.keys[slot]
        out = np.where(key == codes, self.at[slot], -1)
        todo = np.flatnonzero((key != codes) & (key != ~_U(0)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot[todo]]
            hit = key == codes[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (key != ~_U(0))]
        return out


class Model:
    """The merged, frozen context trees of languages, of (language, code of five bytes, n) counts."""

    def __init__(self, lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        self.langs = sorted(set(lang.tolist()))
        which = np.searchsorted(np.array(self.langs), lang)
        self.nodes, self.escapes = [], []
        for k in range(ORDER + 1):
            mask = _U((1 << 8 * (k + 1)) - 1)
            keys, at = np.unique(code & mask, return_inverse=True)
            count = np.zeros((len(keys), len(self.langs)), np.float32)
            np.add.at(count, (at, which), n)
            total = np.add.reduceat(count.sum(1), begin := np.flatnonzero(np.diff(keys >> _U(8), prepend=~_U(0)))) if k else np.array([np.inf])
            if k >= ORDER - 1:  # contexts met but once go
                keep = np.repeat(total >= 2, np.diff(np.append(begin, len(keys))))
                keys, count = keys[keep], count[keep]
            if not len(keys):
                break
            begin = np.flatnonzero(np.diff(keys >> _U(8), prepend=~_U(0))) if k else np.zeros(1, np.int64)
            sizes = np.diff(np.append(begin, len(keys)))
            total, distinct = np.add.reduceat(count, begin), np.add.reduceat((count > 0).astype(float), begin)
            both = np.maximum(total + distinct, 1)
            escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / both), 0.0)
            bits = np.where(count > 0, -np.log2(np.maximum(count, 1) / np.repeat(both, sizes, 0)), np.repeat(escape, sizes, 0) + self.bits(keys))  # these are of the shorter orders
            self.nodes.append(Table(keys, bits))
            self.escapes.append(Table(keys[begin] >> _U(8), escape))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code lengths of the last of each five bytes, by language."""
        out = np.zeros((len(code), len(self.langs)), np.float32)
        todo = np.arange(len(code))
        for k in range(len(self.nodes) - 1, -1, -1):
            gram = code[todo] & _U((1 << 8 * (k + 1)) - 1)
            row = self.nodes[k].find(gram)
            hit = row >= 0
            out[todo[hit]] += self.nodes[k].rows[row[hit]]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                return out
            row = self.escapes[k].find(gram >> _U(8))
            out[todo[row >= 0]] += self.escapes[k].rows[row[row >= 0]]
        out[todo] += 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of whole texts, by language; short ones together, long ones piece by piece."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[int] = []
        size = 0

        def flush():
            data = np.frombuffer(b"".join(START + texts[k] for k in held), np.uint8)
            sizes = np.array([len(texts[k]) for k in held])
            ends = np.cumsum(sizes + ORDER)
            code = grams(data)
            own = np.ones(len(code), bool)  # not what ends within the next text's START
            for e in ends[:-1].tolist():
                own[e - ORDER : e] = False
            bits = self.bits(code[own])
            some = sizes > 0
            out[np.array(held)[some]] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], dtype=np.float64)

        for k, t in enumerate(texts):
            if len(t) > GROUP:
                data = np.frombuffer(START + t, np.uint8)
                for at in range(0, len(t), GROUP):
                    out[k] += self.bits(grams(data[at : at + GROUP + ORDER])).sum(0, dtype=np.float64)
                continue
            held.append(k)
            size += len(t)
            if size > GROUP:
                flush()
                held, size = [], 0
        if held and size:
            flush()
        return out


def _identify(model):
    def run(batches):
        m = model.value
        for batch in in_chunks(batches, 8 << 20):
            known = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = [t.as_py() if k else b"" for k, t in zip(known, batch.column(2), strict=True)]
            bits = m.lengths(texts)
            best = bits.argmin(1)
            odds = np.exp2(-np.minimum(TEMPER * (bits - bits.min(1, keepdims=True)), 1000)).sum(1)
            pred = np.where(known, np.array(m.langs, object)[best], "und")
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, 1 / odds, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text <> '' and lang is not null").filter(~held_out(3, 1))
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    rows_, chars = seen.n, seen.chars or 0
    picked = bounded_sample(known, "doc_id", min(sample, int(rows_ * CHARS / chars)) if chars > CHARS else sample, 4, rows_)
    rows = picked.select("lang", F.col("text").cast("binary")).mapInArrow(_count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    plain = narrow(docs)
    if not rows.num_rows:
        return plain.select("doc_id", held_out(3, 1).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = Model(np.array(rows.column("lang").to_pylist()), rows.column("code").to_numpy().view(_U), rows.column("n").to_numpy())
    out = plain.select("doc_id", F.col("text").rlike(r"\p{L}").alias("known"), F.col("text").cast("binary")).mapInArrow(_identify(spark.sparkContext.broadcast(model)), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
