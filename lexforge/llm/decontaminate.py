"""Operator 6: benchmark decontamination by template canonicalisation.

A text becomes a sequence of canonical words: numbers, names and units give way to typed
placeholders, other words are lower-cased and lose the punctuation around them. A name is a
capitalised word that doesn't start a sentence, unless the text shouts (two capitals or more in the
word). Windows of `WINDOW` canonical words with enough ordinary words among them are hashed and
joined with the windows of the benchmark items. A document is reported for an item if it holds at
least `COVERAGE` of the item's distinct windows and the slots are consistent: along the alignment
that most shared windows have, one benchmark value stands for one value of the document, so that a
question with other numbers or names is caught, and mere likeness of form isn't.

Placeholders depend on case and on where a sentence starts, so a copy may differ from its item in
them. Hence a second form of each text, its words lower-cased as they stand: a document is also
reported if it holds at least `COVERAGE` of the item's windows in this exact form. An item shorter
than a window is one window, its whole text, wherever it stands: a common word that is an item is
reported in each document with that word.

Words are classified and hashed per distinct word of a batch, windows are rolled over the whole
batch as arrays.

Plan at scale. The benchmark's windows of both forms are broadcast as sorted arrays behind a check
of their size (`BROADCAST_ROWS`; about 50 bytes each); documents are then scanned once, no text
moves. Beyond that size the same scan emits only windows that pass a filter of the benchmark's
hashes (two bits each of a table of at most 32 MB; beyond `FILTER_HASHES` hashes all windows), and a
shuffled join, with each benchmark window dealt to `SALTS` partitions or more, as documents are many, so that a window of every
document is no hot key, finds the candidates; they are confirmed on their texts by the same code.

Rows: one per (doc_id, item_id) reported, whatever rows repeat: of several texts under one id that
match, the greatest (coverage, n_windows, n_slots, consistency) stands. Documents without a match, null and
empty texts among them, give no row. Null items and items without a word are ignored; those without
a window of three ordinary words have the exact form only. A pair that both forms reach has the
first one's figures; the exact form has consistency 1. Ties for the commonest alignment: the one met
first. U+0002 as a word counts as a line break.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashes, in_chunks, narrow, small_batches, split_words

WINDOW, COVERAGE, CONSISTENT = 5, 0.8, 0.8
BROADCAST_ROWS, FILTER_HASHES, BROADCAST_PAIRS = 500_000, 16_000_000, 500_000
#: Partitions that each benchmark window is dealt to at least, and documents a partition of one window has at about.
SALTS, SALT_ROWS = 16, 2_000_000
#: Units of measure.
UNITS = set("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs hours minutes seconds days weeks months years usd eur gbp dollars euros cents percent pct meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres gallons degrees celsius fahrenheit mph kmh watts volts".split())
_EDGE = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»„“”‘’…–—¿¡"
_NUMBER = r"^[+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?$"
_NAMED, _ENDS = r"^\p{Lu}\p{Ll}+$", r"[.!?:][\"'”’)»]*$"
NUMBER, NAME, UNIT, SPACE = 1, 2, 3, 0
#: Codes below are placeholders.
ORDINARY = 16
_LINE = "\x02"
OUT = "doc_id bigint, item_id bigint, coverage double, n_windows bigint, n_slots bigint, consistency double"


class Canonical:
    """The canonical words of a batch of texts, one after the other: codes, codes of the exact form,
    where each text begins; words that are punctuation only are left out."""

    def __init__(self, texts: pa.Array) -> None:
        words, index, offsets = split_words(pc.replace_substring(texts, "\n", f" {_LINE} "), unicode=True)
        core = pc.utf8_trim(words, characters=_EDGE)
        low = pc.utf8_lower(core)
        told = lambda a: a.to_numpy(zero_copy_only=False)
        line = told(pc.equal(words, _LINE))
        blank = told(pc.equal(core, "")) | line
        number = told(pc.match_substring_regex(core, _NUMBER))
        unit = told(pc.is_in(low, pa.array(sorted(UNITS)))) & (told(pc.utf8_length(core)) > 1)
        named = told(pc.match_substring_regex(core, _NAMED))
        ends = told(pc.match_substring_regex(words, _ENDS)) | line
        plain = hashes(low) | np.uint64(ORDINARY)
        first = np.select([number, unit], [np.uint64(NUMBER), np.uint64(UNIT)], plain)
        inner = np.where(named & ~number & ~unit, np.uint64(NAME), first)

        at = np.flatnonzero(~blank[index])  # the words that are kept
        self.begin = np.searchsorted(at, offsets)
        ended = np.concatenate([[0], np.cumsum(ends[index])])  # sentence ends before each word
        start = np.diff(ended[at], prepend=0) > 0
        start[self.begin[:-1][self.begin[:-1] < len(at)]] = True
        which = index[at]
        self.words, self.which = words, which
        self.exact = plain[which]
        self.codes = np.where(start, first[which], inner[which])
        self.end = np.repeat(self.begin[1:], np.diff(self.begin))

    def windows(self, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of the windows within a text that have at least three ordinary words."""
        n = len(codes) - width + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        mixed = codes * np.uint64(0x9E3779B97F4A7C15)
        for k in range(width):
            h ^= mixed[k : k + n]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        ordinary = np.concatenate([[0], np.cumsum(codes >= ORDINARY)])
        at = np.flatnonzero((np.arange(width, n + width) <= self.end[:n]) & (ordinary[width:] - ordinary[:n] >= min(3, width)))
        return h[at], at

    def both(self, widths) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of the windows of both forms; widths: of the items' exact windows."""
        h, at = zip(self.windows(self.codes, WINDOW), *(self.exact_windows(w) for w in widths), strict=True)
        return np.concatenate(h), np.concatenate(at)

    def exact_windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        h, at = self.windows(self.exact, width)
        return h ^ np.uint64(0x5851F42D4C957F2D), at

    def word(self, place: int) -> str:
        return self.words[int(self.which[place])].as_py().strip(_EDGE)


def item_windows(texts: pa.Array) -> tuple[Canonical, list[tuple[int, int, int, np.ndarray, np.ndarray]]]:
    """The canonical words of items, and (item's number, form, width, hashes, positions in the item) of
    their forms, 1 being the exact one; only forms that have windows."""
    c, out = Canonical(texts), []
    size = np.diff(c.begin)
    for form, width in [(0, WINDOW), *((1, w) for w in np.unique(np.minimum(size[size > 0], WINDOW)).tolist())]:
        h, at = c.windows(c.codes, width) if not form else c.exact_windows(width)
        item = np.searchsorted(c.begin, at, "right") - 1
        for k in np.unique(item).tolist():
            if form and min(size[k], WINDOW) != width:
                continue
            mine = item == k
            out.append((k, form, width, h[mine], at[mine] - c.begin[k]))
    return c, out


class Index:
    """The benchmark's windows: sorted hashes with postings, and a table of bits in front of them.
    Items are told apart by their row, so that one id may have several texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [i for i, _ in items]
        c, forms = item_windows(pa.array([t for _, t in items], pa.string()))
        self.n = np.zeros((len(items), 2), np.int64)
        self.widths = sorted({width for _, form, width, _, _ in forms if form})
        h = np.concatenate([np.empty(0, np.uint64), *(f[3] for f in forms)])
        rows = np.concatenate([np.empty((0, 3), np.int64), *(np.stack([np.full(len(f[4]), f[0]), np.full(len(f[4]), f[1]), f[4]], 1) for f in forms)])
        for k, form, _, own, _ in forms:
            self.n[k, form] = len(np.unique(own))
        order = np.argsort(h, kind="stable")
        self.hashes, at = np.unique(h[order], return_index=True)
        self.postings, self.at = rows[order], np.append(at, len(h))
        self.bits = np.zeros(1 << 22, np.bool_)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        slot = np.flatnonzero(c.codes < ORDINARY)  # (item's row, place) -> the benchmark's value
        item = np.searchsorted(c.begin, slot, "right") - 1
        self.slot = {(k, p): c.word(s) for k, p, s in zip(item.tolist(), (slot - c.begin[item]).tolist(), slot.tolist(), strict=True)}

    def matches(self, texts: pa.Array):
        """(text's number, item_id, coverage, windows, slots, consistency) of the items that texts hold."""
        if not len(self.hashes):
            return
        c = Canonical(texts)
        h, at = c.both(self.widths)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        h, at = h[maybe], at[maybe]
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        here = self.hashes[k] == h
        k, at = k[here], at[here]
        times = self.at[k + 1] - self.at[k]
        hit = np.repeat(np.arange(len(k)), times)
        post = self.postings[np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + self.at[k][hit]]
        text = np.searchsorted(c.begin, at, "right") - 1
        group = (text[hit] * len(self.items) + post[:, 0]) * 2 + post[:, 1]
        distinct = np.unique(np.stack([group, k[hit]], 1), axis=0)[:, 0]
        groups, found = np.unique(distinct, return_counts=True)
        share = found / self.n[groups // 2 % len(self.items), groups % 2]
        groups, share = groups[share >= COVERAGE], share[share >= COVERAGE]
        if not len(groups):
            return
        some = np.flatnonzero(np.isin(group, groups))
        order = some[np.lexsort((at[hit[some]], group[some]))]
        parts = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
        done: set[tuple[int, int]] = set()
        for g, coverage, part in zip(groups.tolist(), share.tolist(), parts, strict=True):
            doc, item, form = g // 2 // len(self.items), g // 2 % len(self.items), g % 2
            if (doc, item) in done:
                continue
            slots, same = self.slots(item, at[hit[part]], post[part, 2], int(c.begin[doc]), c)
            if form or same >= CONSISTENT:
                done.add((doc, item))
                yield doc, self.items[item], coverage, len(part), slots, 1.0 if form else same

    def slots(self, item: int, at: np.ndarray, place: np.ndarray, begin: int, c: Canonical) -> tuple[int, float]:
        """Slots of the item on the commonest alignment, and the share of them whose benchmark value
        stands for its usual document value."""
        shifts = (at - begin - place).tolist()
        shift = Counter(shifts).most_common(1)[0][0]
        pairs: dict[str, Counter] = defaultdict(Counter)
        for p in sorted({p + k for p, s in zip(place.tolist(), shifts, strict=True) if s == shift for k in range(WINDOW)}):
            if (item, p) in self.slot:
                pairs[self.slot[item, p]][c.word(begin + p + shift)] += 1
        n = sum(sum(x.values()) for x in pairs.values())
        return n, sum(max(x.values()) for x in pairs.values()) / n if n else 1.0


_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
_NAMES = ["doc_id", "item_id", "coverage", "n_windows", "n_slots", "consistency"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _scan(index):
    def run(batches):
        for batch in in_chunks(batches, 8 << 20):
            ids = batch.column(0)
            yield _batch([(ids[m[0]].as_py(), *m[1:]) for m in index.value.matches(batch.column(1))])

    return run


def _items(batches):
    """(row, form, window hash, width) rows of items (row, text), for the shuffled join."""
    for batch in in_chunks(batches, 4 << 20):
        row = batch.column(0)
        out = [(row[k].as_py(), form, x, width) for k, form, width, h, _ in item_windows(batch.column(1))[1] for x in np.unique(h).view(np.int64).tolist()]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["row", "form", "h", "width"])


def bit_table(h: np.ndarray) -> np.ndarray:
    """Two bits for each hash in a table of 16 bits a hash, a power of two."""
    bits = np.zeros(1 << max(10, (2 * len(h)).bit_length()), np.uint8)
    for b in bits_of(h, len(bits)):
        np.bitwise_or.at(bits, b >> 3, (1 << (b & 7)).astype(np.uint8))
    return bits


def bits_of(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(8 * size - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _hashed(widths, table):
    """(doc_id, tk, h) of the windows of documents (doc_id, tk, text) that pass the table, distinct in
    a text."""

    def run(batches):
        for batch in in_chunks(batches, 4 << 20):
            c = Canonical(batch.column(2))
            h, at = c.both(widths)
            if table is not None:
                a, b = bits_of(h, len(table.value))
                keep = np.flatnonzero((table.value[a >> 3] >> (a & 7)) & (table.value[b >> 3] >> (b & 7)) & 1)
                h, at = h[keep], at[keep]
            text = np.searchsorted(c.begin, at, "right") - 1
            rows = np.unique(np.stack([text, h.view(np.int64)], 1), axis=0)
            take = pa.array(rows[:, 0])
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(rows[:, 1])], names=["doc_id", "tk", "h"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, coverage, n_windows, n_slots, consistency of the matches."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = narrow(docs).filter("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if words <= 3 * broadcast_rows:  # a word has a window of each form
        index = spark.sparkContext.broadcast(Index(sorted(tuple(r) for r in items.collect())))
        found = docs.mapInArrow(_scan(index), OUT)
    else:
        found = docs_join(docs, items)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*_NAMES[2:])).alias("m"))
    return best.select("doc_id", "item_id", *(f"m.{c}" for c in _NAMES[2:]))


def docs_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As the scan of a broadcast index, by a shuffled join: rows may repeat."""
    spark = docs.sparkSession
    items = items.withColumn("row", F.xxhash64("item_id", "text"))
    mine = cut(items.select("row", "text").mapInArrow(_items, "row bigint, form int, h bigint, width int"))
    widths = sorted(r.width for r in mine.filter("form = 1").select("width").distinct().collect())
    distinct, table = mine.select("h").distinct(), None
    if distinct.count() <= FILTER_HASHES:
        table = spark.sparkContext.broadcast(bit_table(distinct.toArrow().column("h").to_numpy().view(np.uint64)))
    # more partitions for more documents, but no more copies of windows than a quarter of these
    n_docs, n_windows = docs.count(), max(1, mine.count())
    salts = max(SALTS, min(n_docs // SALT_ROWS, n_docs // (4 * n_windows)))
    size = mine.groupBy("row", "form").agg(F.count("*").alias("n"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")  # one id may have several texts
    seen = keyed.mapInArrow(_hashed(widths, table), "doc_id bigint, tk bigint, h bigint").withColumn("salt", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(salts)))
    dealt = mine.select("row", "form", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    hit = seen.join(dealt, ["h", "salt"]).groupBy("doc_id", "tk", "row", "form").agg(F.count_distinct("h").alias("k"))
    full = hit.join(size, ["row", "form"]).filter(F.col("k") >= COVERAGE * F.col("n")).select("doc_id", "tk", "row").distinct()
    # Few pairs are left: their texts come together for the slots; where they are few indeed, no other text moves.
    full = cut(full)
    full = F.broadcast(full) if full.count() <= BROADCAST_PAIRS else full
    pair = full.join(keyed.withColumnRenamed("text", "text_d"), ["doc_id", "tk"]).join(items.withColumnRenamed("text", "text_i"), "row").select("doc_id", "item_id", "text_i", "text_d")

    def verify(batches):
        for batch in batches:
            out = []
            for d, i, ti, k in zip(*batch.columns[:3], range(batch.num_rows), strict=True):
                out += [(d.as_py(), *m[1:]) for m in Index([(i.as_py(), ti.as_py())]).matches(batch.column(3).slice(k, 1))]
            yield _batch(out)

    return pair.mapInArrow(verify, OUT)
