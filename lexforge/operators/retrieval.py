"""Lexical, dense and hybrid retrieval: top-k engines over chunk tables.

Scale. BM25 reads the stored index's buckets of the query's terms (`index`), filters postings by the
columns that stand in them, and shuffles one row per (chunk, query term); `bm25_scores` states the
formula over a chunk table. Dense retrieval is a scan with a top-k per task, or of the stored cells
nearest to the query. A global rank is taken after the limit, so no window sees more than k rows.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import TOKEN, snippet, tokens
from .index import K1, B, Index

RRF_K, LEXICAL_WEIGHT, DENSE_WEIGHT = 60, 1.0, 0.3
POOL_FACTOR = 4


def asof(date: str, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity: start <= date < end, null bounds open."""
    d = F.lit(date).cast("date")
    return (F.col(start).isNull() | (F.col(start) <= d)) & (F.col(end).isNull() | (F.col(end) > d))


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A gap-free rank; for tables already limited to few rows."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))


def query_terms(text: str) -> list[str]:
    """Distinct terms of a query, as the analyzer cuts them; none is an error."""
    import regex

    found = list(dict.fromkeys(regex.findall(TOKEN, text.lower())))
    if not found:
        raise ValueError("bad_input: the query has no term")
    return found


def bm25_scores(chunks: DataFrame, terms: list[str], folded: bool = False) -> DataFrame:
    """chunk_id, score (rounded to 6 places) of every chunk that holds a term.
    idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    words = tokens(F.col("body")) if folded else F.regexp_extract_all(F.lower("body"), F.lit(TOKEN), F.lit(0))
    doc = chunks.select("chunk_id", words.alias("words")).select("chunk_id", F.size("words").alias("len"), F.filter("words", lambda w: w.isin(terms)).alias("hits"))
    stats = doc.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = doc.filter(F.size("hits") > 0).select("chunk_id", "len", F.explode("hits").alias("term")).groupBy("chunk_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))  # a row per query term, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return x.groupBy("chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def lexical_topk(index: Index, terms: list[str], limit: int, keep: Column | None = None) -> DataFrame:
    """chunk_id, document_id, score, rank: filters first, then the best `limit`."""
    order = [F.desc("score"), F.asc("chunk_id")]
    return numbered(index.best(terms, limit, keep), order).select("chunk_id", "document_id", "score", "rank")


def distance(embedding: Column, query: list[float]) -> Column:
    """Euclidean distance in doubles, rounded to 6 places so that ties are the same everywhere."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.round(F.sqrt(F.aggregate(F.zip_with(embedding, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)), 6)


def dense_topk(vectors: DataFrame, query: list[float], limit: int, documents: DataFrame | None = None, keep: Column | None = None, pool: int = POOL_FACTOR) -> DataFrame:
    """document_id, distance, rank: a pool of pool * limit nearest, filtered after, ranked anew."""
    near = vectors.select("document_id", distance(F.col("embedding"), query).alias("distance")).orderBy("distance", "document_id").limit(pool * limit)
    if documents is not None and keep is not None:
        near = near.join(documents.filter(keep).select("document_id"), "document_id", "left_semi")
    order = [F.asc("distance"), F.asc("document_id")]
    return numbered(near.orderBy(*order).limit(limit), order)


def rrf(rank: Column, weight: float = 1.0) -> Column:
    return F.lit(float(weight)) / (RRF_K + rank)


def rrf_fuse(lexical: DataFrame, dense: DataFrame, weights: tuple[float, float] = (LEXICAL_WEIGHT, DENSE_WEIGHT)) -> DataFrame:
    """document_id, lexical_rank, dense_rank, score from two rankings (document_id, rank)."""
    null = F.lit(None).cast("bigint")
    both = lexical.select("document_id", F.col("rank").alias("l"), null.alias("d")).unionByName(dense.select("document_id", null.alias("l"), F.col("rank").alias("d")))
    g = both.groupBy("document_id").agg(F.min("l").alias("lexical_rank"), F.min("d").alias("dense_rank"))
    score = F.coalesce(rrf(F.col("lexical_rank"), weights[0]), F.lit(0.0)) + F.coalesce(rrf(F.col("dense_rank"), weights[1]), F.lit(0.0))
    return g.withColumn("score", F.round(score, 8))


def rrf_weights(lexical: float | None = None, dense: float | None = None) -> tuple[float, float]:
    """Given weights, else those of the environment, else the defaults; they must be finite and not negative."""
    import math

    def level(given: float | None, name: str, default: float) -> float:
        if given is not None:
            return given
        try:
            return float(os.environ.get(name, default))
        except ValueError as e:
            raise ValueError(f"bad_input: {name} is no number") from e

    out = (level(lexical, "LEXFORGE_RRF_LEXICAL_WEIGHT", LEXICAL_WEIGHT), level(dense, "LEXFORGE_RRF_DENSE_WEIGHT", DENSE_WEIGHT))
    if not all(math.isfinite(w) and w >= 0 for w in out):
        raise ValueError("bad_input: a fusion weight must be finite and at least 0")
    return out


def best_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def after_cursor(df: DataFrame, score: float, last_id, score_col: str = "score", id_col: str = "chunk_id") -> DataFrame:
    """Rows after (score, id) in the order score descending, id ascending."""
    s, i = F.col(score_col), F.col(id_col)
    return df.filter((s < score) | ((s == score) & (i > last_id)))


def fanout_rrf(ranked: DataFrame, corpus: str, page: int) -> DataFrame:
    """Merges per-corpus rankings by 1 / (60 + rank in the corpus): corpus, document_id, local_score,
    cross_score; ties by corpus, then id. Each corpus needs its best `page` rows only."""
    local = ranked.withColumn("r", F.row_number().over(W.partitionBy(corpus).orderBy(F.desc("score"), "document_id"))).filter(F.col("r") <= page)
    return local.select(corpus, "document_id", F.col("score").alias("local_score"), F.round(rrf(F.col("r")), 8).alias("cross_score")).orderBy(F.desc("cross_score"), corpus, "document_id").limit(page)


def fanout_page(ranked: DataFrame, corpus: str, key: str, depth: int, after: Cursor | None = None) -> DataFrame:
    """Rows of per-corpus rankings (corpus, key, score), the best `depth` of each, with the score that
    merges them and the local one, in order of (score descending, corpus, key); after a cursor, if given."""
    local = ranked.withColumn("r", F.row_number().over(W.partitionBy(corpus).orderBy(F.desc("score"), key))).filter(F.col("r") <= depth)
    out = local.withColumn("local_score", F.col("score")).withColumn("score", F.round(rrf(F.col("r")), 8)).drop("r")
    if after is not None:
        s, at = F.col("score"), F.struct(F.lit(after.corpus), F.lit(after.last_id).cast(ranked.schema[key].dataType))
        out = out.filter((s < after.score) | ((s == after.score) & (F.struct(corpus, key) > at)))
    return out.orderBy(F.desc("score"), corpus, key)


@dataclass(frozen=True)
class Cursor:
    group: str
    score: float
    corpus: str | None
    last_id: str

    def encode(self) -> str:
        if self.corpus is not None:
            return f"mc:{self.group}:{self.score}:{self.corpus}:{self.last_id}"
        return f"doc:{self.score}:{self.last_id}" if self.group == "document" else f"{self.score}:{self.last_id}"


def parse_cursor(text: str, group: str) -> Cursor:
    """Reads a cursor of one of three forms; ids may hold colons. Another grouping is an error."""
    import math

    try:
        if text.startswith("mc:"):
            _, g, score, corpus, last = text.split(":", 4)
        elif text.startswith("doc:"):
            _, score, last = text.split(":", 2)
            g, corpus = "document", None
        else:
            score, last = text.split(":", 1)
            g, corpus = "chunk", None
        value = float(score)
    except ValueError as e:
        raise ValueError(f"bad_input: malformed cursor {text!r}") from e
    if g != group or not math.isfinite(value) or not last:
        raise ValueError(f"bad_input: cursor {text!r} does not fit grouping {group}")
    return Cursor(g, value, corpus, last)


def implied_rank(score: float) -> int:
    """The rank that a fused single-arm score stands for."""
    return max(0, round(1 / score) - RRF_K) if score > 0 else 0


def fanout_depth(cursor_score: float | None, page: int) -> int:
    """Rows that each arm of a fan-out needs for the page after a cursor, and one to tell of more."""
    return (implied_rank(cursor_score) if cursor_score is not None else 0) + page + 1


def authority_tier(source: Column, publication: Column) -> tuple[Column, Column]:
    """(tier, whether the publication marker is missing where one is expected)."""
    p = F.lower(publication)
    tier = F.when(source == "cass", F.when(p == "oui", 3).otherwise(2)).when(source == "inca", 1).when(source == "jade", F.when(p == "a", 2).when(p == "b", 1).otherwise(0)).otherwise(0)
    return tier, source.isin("cass", "jade") & publication.isNull()


def authority_rerank(candidates: DataFrame, weight: float, band: float = 0.05) -> DataFrame:
    """Within bands of nearly equal score (led by the band's first row, at most `band` below it),
    rows of one order of courts are put into the slots that order holds, by
    score * (1 + weight * tier / 3); other rows keep their places. Rows: query_id, id, order_key,
    tier, score; adds position. Off (input order) for weight <= 0."""

    def run(pdf):
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        if weight > 0:
            out, i = [], 0
            while i < len(pdf):
                lead, j = pdf.score[i], i
                while j < len(pdf) and pdf.score[j] >= lead * (1 - band):
                    j += 1
                slots = list(range(i, j))
                for _, rows in pdf.iloc[i:j].groupby("order_key", sort=False):
                    best = sorted(rows.index, key=lambda k: -pdf.score[k] * (1 + weight * pdf.tier[k] / 3))
                    for slot, k in zip(rows.index, best, strict=True):
                        slots[slot - i] = k
                out += slots
                i = j
            pdf = pdf.loc[out].reset_index(drop=True)
        pdf["position"] = range(1, len(pdf) + 1)
        return pdf[["query_id", "id", "order_key", "tier", "score", "position"]]

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, id long, order_key string, tier long, score double, position long")


def ivfflat_lists(rows: int) -> int:
    return max(1, rows // 1000 if rows <= 1_000_000 else int(rows**0.5))


def ivfflat_probes(lists: int, asked: int | None = None) -> int:
    return asked or min(4096, max(1, int(lists**0.5)))


def with_snippet(df: DataFrame) -> DataFrame:
    return df.withColumn("snippet", snippet(F.col("body")))
