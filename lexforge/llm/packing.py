"""Operator 10: cost-balanced sequence packing.

A document is its token ids, each less than 2^16 here, then the end id. Its cost is estimated as
linear plus quadratic in the length of its pieces (attention is kept within a piece). Pieces are
assigned in descending length to the sequence of the lowest cost that has room for them; where none
has, the piece is cut: the sequence of the lowest cost takes what fits, the rest queues again.

Padding. A group of N tokens gets N // 2048 sequences of capacity 2048, and the rest N % 2048 is
written as powers of two, one short sequence each, which need no padding. The capacities sum to N
and every id is placed, so no sequence is padded at all.

Scale. Each map task packs its own rows in groups of about `GROUP` tokens (4 MB of ids), so there
is no shuffle, memory is bounded whatever a row or partition holds, and a lost task is redone
alone. sequence_id is the number of the task's partition, then a running number: unique, not dense.

Where the tokenizer's definition says that tokens depend on one white-space separated word at a time
(`by_words`: it drops white space and no pre-token crosses it), ids are learned per distinct word of a
batch; any other tokenizer gets whole texts.

Null text: empty, a document of the end id alone. Repeated rows are packed each by itself. Empty
table: no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, small_batches, split_words

CAPACITY, END, GROUP = 2048, 1, 1 << 20
#: Cost of a piece: LINEAR * n + QUADRATIC * n²; at 2048 both parts weigh alike.
LINEAR, QUADRATIC = 1.0, 1 / 2048
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The letters and the ASCII punctuation of plain words. Such a word is its letters and
#: the punctuation behind them: two pre-tokens, whose ids can be learned apart and in lower case.
LETTERS, PUNCTUATION = "A-Za-zÀ-ÖØ-öø-įıĲ-ſ", r"!-/:-@\[-`{-~"
_PLAIN = f"^(?P<head>[{LETTERS}]+)(?P<tail>[{PUNCTUATION}]*)$"
#: Parts that may be encoded joined, as each is one pre-token whatever its neighbours are.
_JOINED = f"^(?:[{LETTERS}]+|[{PUNCTUATION}]+)$"
#: What stands between joined parts: a pre-token of its own, of one id.
_BETWEEN = "\x7f"
#: What a tokenizer must do before its model for white space to part its tokens and case
#: not to matter.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_words(definition: str) -> bool:
    """Whether a tokenizer's ids of a text are those of its white-space separated words in lower case."""
    d = json.loads(definition)
    steps = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaced = any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in d.get("added_tokens", []))
    return (d.get("normalizer") or {}).get("normalizers") == _NORMAL and steps[:1] == [_SPLIT] and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in steps[1:]) and not spaced


class Encoder:
    """Ids of texts as bytes of unsigned 32-bit integers. A batch's distinct words are found by
    dictionary encoding; their parts are looked up in a bounded memo, which holds parts that recur
    within a batch, or encoded, many in one call; the ids of the texts are gathered by word."""

    MEMO, CALL = 150_000, 512

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_words = by_words(definition)
        self.memo: dict[str, bytes] = {}
        between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> list[bytes]:
        """As _alone, for parts that may be joined."""
        out: list[bytes] = []
        for at in range(0, len(parts), self.CALL):
            some = parts[at : at + self.CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.between) * 4).tolist(), 4 * len(ids)]
            if len(ends) != len(some):  # a part has the id between: not with this model, but then
                out += self._alone(some)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]
        return out

    def _parts(self, parts: pa.Array, recur: np.ndarray) -> pa.Array:
        """The ids of distinct parts."""
        names = parts.to_pylist()
        got = list(map(self.memo.get, names))
        new = np.array([k for k, ids in enumerate(got) if ids is None], np.int64)
        if len(new):
            joined = pc.match_substring_regex(parts.take(pa.array(new)), _JOINED).to_numpy(zero_copy_only=False) & (self.between is not None)
            for some, encode in ((new[joined], self._together), (new[~joined], self._alone)):
                for k, ids in zip(some.tolist(), encode([names[k] for k in some.tolist()]), strict=True):
                    got[k] = ids
            if len(self.memo) > self.MEMO:
                self.memo.clear()
            self.memo |= {names[k]: got[k] for k in new[recur[new]].tolist() if len(names[k]) < 64}
        return pa.array(got, pa.large_binary())

    def _words(self, words: pa.Array, index: np.ndarray) -> pa.Array:
        """The ids of distinct words; index: of their occurrences."""
        cut = pc.extract_regex(words, _PLAIN)
        head = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "head")), words)
        parts = pa.concat_arrays([head, pc.coalesce(pc.struct_field(cut, "tail"), "")]).dictionary_encode()
        which = parts.indices.to_numpy()
        uses = np.bincount(which, np.tile(np.bincount(index, minlength=len(words)), 2), len(parts.dictionary))
        ids = self._parts(parts.dictionary, uses > 1).take(pa.array(which.reshape(2, -1).T.ravel()))
        at = np.frombuffer(ids.buffers()[1], np.int64, 2 * len(words) + 1)[::2]
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.ascontiguousarray(at)), ids.buffers()[2]])

    def documents(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text, with the end id."""
        end = END.to_bytes(4, "little")
        if not self.by_words:
            return [memoryview(x + end) for x in self._alone(texts.to_pylist())]
        words, index, offsets = split_words(texts)
        table = pa.concat_arrays([self._words(words, index), pa.array([end], pa.large_binary())])
        ids = table.take(pa.array(np.insert(index, offsets[1:], len(words))))
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[offsets + np.arange(len(offsets))].tolist()
        data = memoryview(ids.buffers()[2])
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The worker's encoder, remembered over its tasks; one task runs in a worker at a time."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


class Room:
    """Open sequences by remaining capacity: a tree of least costs over capacities 0..size."""

    def __init__(self, capacities: list[int], size: int) -> None:
        self.n = 1 << size.bit_length()
        self.left, self.cost, self.heaps = list(capacities), [0.0] * len(capacities), {}
        self.tree = [(np.inf, -1)] * (2 * self.n)
        for k, c in enumerate(capacities):
            self.heaps.setdefault(c, []).append((0.0, k))
        for c, h in self.heaps.items():
            heapq.heapify(h)
            self.tree[self.n + c] = h[0]
        for i in range(self.n - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def _set(self, c: int) -> None:
        h, i = self.heaps[c], self.n + c
        self.tree[i] = h[0] if h else (np.inf, -1)
        while i > 1:
            i //= 2
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def lowest(self, need: int) -> int:
        """The sequence of the lowest cost with at least `need` left; -1 if none has."""
        best, lo, hi = (np.inf, -1), self.n + need, 2 * self.n
        while lo < hi:
            if lo & 1:
                best, lo = min(best, self.tree[lo]), lo + 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo, hi = lo // 2, hi // 2
        return best[1]

    def put(self, k: int, n: int) -> None:
        c = self.left[k]
        heapq.heappop(self.heaps[c])  # the lowest of its capacity, as lowest() chose it
        self._set(c)
        self.left[k] -= n
        self.cost[k] += LINEAR * n + QUADRATIC * n * n
        if self.left[k]:
            heapq.heappush(self.heaps.setdefault(self.left[k], []), (self.cost[k], k))
            self._set(self.left[k])


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of documents of these lengths; sequences
    of full capacity come first, then one for each power of two of the rest."""
    total = sum(lengths)
    whole, rest = divmod(total, capacity)
    caps = [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    room, out = Room(caps, capacity), []
    queue = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        k = room.lowest(min(n, capacity))
        if k < 0:
            k = room.lowest(1)
        take = min(n, room.left[k])
        out.append((d, start, take, k, caps[k] - room.left[k]))
        room.put(k, take)
        if take < n:
            heapq.heappush(queue, (take - n, d, start + take))
    return out


def _pieces(definition):
    def run(batches):
        encoder, seq = encoder_of(definition.value), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        ids: list[int | None] = []
        docs: list[memoryview] = []
        held = 0

        def flush():
            nonlocal seq, ids, docs, held
            pieces = pack([len(b) // 4 for b in docs])
            d, start, length, k, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            crc = [zlib.crc32(docs[i][4 * s : 4 * (s + n)]) for i, s, n, _, _ in pieces]
            sizes = np.array([len(b) // 4 for b in docs], np.int64)
            out = pa.record_batch([pa.array(ids, pa.int64()).take(pa.array(d)), *map(pa.array, (start, length, np.array(crc, np.int64), sizes[d], k + seq, offset))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            seq += int(k.max()) + 1
            ids, docs, held = [], [], 0
            return out

        for batch in in_chunks(batches, 8 << 20):
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder.documents(batch.column(1)), strict=True):
                docs.append(tokens)
                ids.append(doc_id)
                held += len(docs[-1])
                if held >= 4 * GROUP:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with open(path or tokenizer_path(), encoding="utf-8") as f:  # on the driver; executors get it by broadcast (2 MB)
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    return src.mapInArrow(_pieces(definition), SCHEMA)
