"""Operator 2: toxicity by Levenshtein automata over a lexicon trie, with context windows.

Fit (training rows only, at most about `SAMPLE` labelled rows chosen by hash, written once): words
whose share among toxic documents is far above that among others make the lexicon. Words have 1 to
40 letters; a term must stand in 0.4 % of the sample's toxic documents (`LEAST_DOCS` at least), so
rarer terms are not learned, and the lexicon has at most 250 times as many words as a toxic document
has distinct ones on average. Terms under 5 letters match exactly only. The automata of all strings
within one edit of a term (two from 9 letters on; a letter too many, too few, another, or two swapped,
the first letter too) are intersected with the trie of the lexicon and made deterministic step by
step. So misspelled terms are caught, after undoing look-alikes, stretched letters of any length,
letters spelled one by one and a possessive. Each
distinct word is looked up once a task, in a bounded memo.

A hit counts by its context: the window of `CONTEXT` words around it holds quotation marks around
the hit or reporting words (quotation) or further hits and second-person address (abuse). The
document's features (exact, fuzzy, quoted and clustered hits, their share of the words) go into a
logistic model fitted on the driver to the sample's features (a few floats a row).

Null and empty texts, and every text when nothing was learned, get the model's score of no hits.
Repeated rows are scored alike. Nothing moves in a shuffle when scoring: one map over the texts.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, held_out, narrow, small_batches, written

SAMPLE, CONTEXT, THRESHOLD = 20_000, 8, 0.3
LEAST_DOCS, LEAST_ODDS = 5, 3.0
#: Words that report speech, and words that address someone.
REPORT = set("said says quote quoted quoting called wrote writes reported allegedly so-called dit dijo sagte".split())
ADDRESS = set("you your you're u tu te vous du dich ihr usted".split())
#: Look-alike characters and the letters they stand for.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
QUOTES = "\"'“”„«»‘’"
_EDGE = re.compile(r"^[^\w@$!]+|[^\w]+$")
_STRETCH = re.compile(r"(.)\1{2,}")
_POSSESSIVE, _SPELLED, _START = re.compile(r"['’]s$"), re.compile(r"\w(?:[-._*]\w){2,}"), re.compile(r"^[^\w@$!]+")
N_FEATURES = 7


def plain(word: str) -> str:
    return _EDGE.sub("", word).lower()


def undisguised(raw: str, w: str) -> str:
    """The word, plain as w, without what hides it: letters spelled one by one, a possessive, look-alikes
    (also at its end) and stretches, whatever its length."""
    if raw[-1:] in ("@", "$"):
        w = _START.sub("", raw).lower()
    elif w.isalpha() and not _STRETCH.search(w):
        return w
    w = _POSSESSIVE.sub("", w)
    if _SPELLED.fullmatch(w):
        w = w[::2]
    return _STRETCH.sub(r"\1", w if w.isalpha() else w.translate(LOOKALIKE))


def limit(term: str) -> int:
    """Edits allowed from a term: short ones have many lawful neighbours and must match exactly."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie and made deterministic as
    far as words need it. A state is a set of (trie node, edits used, letter owed by a swap). Steps
    are remembered, so a word costs one look-up a letter until no term is near."""

    STATES = 50_000

    def __init__(self, terms) -> None:
        # nodes: children, allowed edits of the longest term below, allowed edits of the term here (-1: none)
        self.kids: list[dict[str, int]] = [{}]
        self.room, self.own = [0], [-1]
        for term in sorted(terms):
            node, k = 0, limit(term)
            for ch in term:
                self.room[node] = max(self.room[node], k)
                if ch not in self.kids[node]:
                    self.kids[node][ch] = len(self.kids)
                    self.kids.append({}), self.room.append(0), self.own.append(-1)
                node = self.kids[node][ch]
            self.room[node] = max(self.room[node], k)
            self.own[node] = k
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.ends: list[bool] = []
        self.longest = max((len(t) + limit(t) for t in terms), default=0)

    def _state(self, found) -> int:
        """The number of a set, closed under letters left out; -1 for the empty set."""
        todo, seen = list(found), set()
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            node, e, owed = s
            if not owed and e < self.room[node]:
                todo += [(kid, e + 1, "") for kid in self.kids[node].values() if e + 1 <= self.room[kid]]
        if not seen:
            return -1
        key = frozenset(seen)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.ends.append(any(not owed and e <= self.own[node] for node, e, owed in key))
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e, owed in self.sets[state]:
            if owed:
                if owed == ch:
                    out.add((node, e, ""))
                continue
            if ch in self.kids[node]:
                out.add((self.kids[node][ch], e, ""))
            if e < self.room[node]:
                out.add((node, e + 1, ""))  # a letter too many
                for other, kid in self.kids[node].items():
                    if e + 1 <= self.room[kid]:
                        out.add((kid, e + 1, ""))  # another letter
                        if other != ch and ch in self.kids[kid]:
                            out.add((self.kids[kid][ch], e + 1, other))  # two letters swapped
        return self._state(out)

    def accepts(self, word: str) -> bool:
        if not word or len(word) > self.longest:
            return False
        if len(self.sets) > self.STATES:
            self.ids, self.sets, self.steps, self.ends = {}, [], {}, []
        if not self.sets:
            self._state([(0, 0, "")])  # the first state is number 0
        state = 0
        for ch in word:
            nxt = self.steps.get((state, ch))
            if nxt is None:
                nxt = self.steps[state, ch] = self._step(state, ch)
            if nxt < 0:
                return False
            state = nxt
        return self.ends[state]


class Lookup(dict):
    """word as written -> 0 none, 1 fuzzy hit, 2 exact hit; remembered, cleared when full."""

    LIMIT = 300_000

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.automaton = lexicon, Automaton(lexicon)

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        out, w = 0, plain(raw)
        if w in self.lexicon:
            out = 2
        else:
            w = undisguised(raw, w)
            out = int(w in self.lexicon or len(w) >= 4 and self.automaton.accepts(w))
        if len(raw) < 100:
            self[raw] = out
        return out


def features(look: Lookup, text: str) -> list[float]:
    words = text.split()
    hits = [(i, h) for i, h in enumerate(map(look.__getitem__, words)) if h]
    if not hits:
        return [0.0] * N_FEATURES
    exact = fuzzy = quoted = close = addressed = 0
    at = [i for i, _ in hits]
    for k, (i, h) in enumerate(hits):
        around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
        raw = words[i]
        inner = [plain(w) for w in around]
        in_quotes = raw[:1] in QUOTES or (raw[-1:] in QUOTES and len(raw) > 1)
        if in_quotes or not REPORT.isdisjoint(inner):
            quoted += 1
        if (k and i - at[k - 1] <= CONTEXT) or (k + 1 < len(at) and at[k + 1] - i <= CONTEXT):
            close += 1
        addressed += not ADDRESS.isdisjoint(inner)
        exact += h == 2
        fuzzy += h == 1
    n = len(hits)
    return [math.log1p(exact), math.log1p(fuzzy), float(exact > 0), quoted / n, close / n, addressed / n, math.log1p(1000 * n / len(words))]


def _terms(batches):
    """(word, toxic, documents that hold it) counted over a task's rows."""
    from collections import Counter

    count: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
            count[toxic.as_py()].update({w for w in map(plain, text.as_py().split()) if 0 < len(w) <= 40})
        for toxic in (0, 1):
            if len(count[toxic]) > 200_000:
                yield _counted(count[toxic], toxic)
                count[toxic].clear()
    for toxic in (0, 1):
        yield _counted(count[toxic], toxic)


def _counted(count, toxic):
    return pa.record_batch([pa.array(list(count), pa.string()), pa.array([toxic] * len(count), pa.int32()), pa.array(list(count.values()), pa.int64())], names=["word", "toxic", "n"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """word -> log odds of being in toxic documents, of rows (toxic, text)."""
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return {}
    c = rows.select("toxic", "text").mapInArrow(_terms, "word string, toxic int, n bigint").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("g"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    # A word must mark a good part of toxic documents, else chance co-occurrence on few pages passes.
    least = max(LEAST_DOCS, 0.004 * bad)
    top = c.filter(F.col("b") >= least).select("word", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS)
    return {r.word: r.odds for r in top.collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a small ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * 0.5
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> dict:
    """Lexicon and weights, from labelled rows that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = cut(bounded_sample(marks, "doc_id", SAMPLE, 3))
    rows = written(docs.join(F.broadcast(marks), "doc_id").select("toxic", "text"))
    lexicon = learn_lexicon(rows)
    empty = {"lexicon": lexicon, "w": np.zeros(N_FEATURES), "b": -5.0}
    if not lexicon:
        return empty

    def run(batches):
        look = Lookup(lexicon)
        for batch in batches:
            x = [features(look, t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    w, b = fit_logistic(x, y)
    return {"lexicon": lexicon, "w": w, "b": b}


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits."""
    small_batches(docs.sparkSession)
    docs = narrow(docs)
    model = train(docs, labels)

    def run(batches):
        look = Lookup(model["lexicon"])
        for batch in batches:
            x = np.array([features(look, t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ model["w"] + model["b"], -30, 30)))
            hits = np.rint(np.expm1(x[:, 0]) + np.expm1(x[:, 1])).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array(hits)], names=["doc_id", "score", "n_hits"])

    out = docs.mapInArrow(run, "doc_id bigint, score double, n_hits bigint")
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")
