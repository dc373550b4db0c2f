"""The search request: validation, routing, paging, audit. Orchestration on the driver over few rows;
the work is in the DataFrames of `retrieval`."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import cells
from . import retrieval as R
from .index import Index

_INTENT = re.compile(r"(?i)^(?P<prefix>.*)\barticle\s+(?P<number>(?:[LRD][.\s]*)?\d[\w.-]*)(?P<rest>.*)$", re.S)
_DATE = re.compile(r"en vigueur au (\d{4}-\d{2}-\d{2})")


@dataclass(frozen=True)
class Request:
    query: str
    as_of: str
    mode: str = "hybrid"
    group_by: str = "chunk"
    top_k: int = 10
    cursor: str | None = None
    embedding: list[float] | None = None
    fingerprint: str | None = None
    weights: tuple[float, float] = (R.LEXICAL_WEIGHT, R.DENSE_WEIGHT)
    kind: str | None = None
    #: Corpora (values of the index's lang) that are searched apart and merged by rank.
    corpora: tuple[str, ...] = ()
    #: Weight of the authority of sources within bands of like score; 0: off. Its page is the first only.
    authority: float = 0.0
    #: Cells that the dense arm reads, where it has cells; None: as many as their manifest says.
    probes: int | None = None


@dataclass(frozen=True)
class Response:
    rows: list[dict]
    next_cursor: str | None
    routing: dict = field(default_factory=dict)


def citation_intent(query: str, as_of: str) -> dict | None:
    """The last article named, its date if one is given, and what stands before it as a code hint."""
    m = _INTENT.match(query)
    if not m:
        return None
    d = _DATE.search(m["rest"])
    return {"number": re.sub(r"[\s.]+", "", m["number"]).upper(), "as_of": d[1] if d else as_of, "hint": m["prefix"].strip() or None}


def validate(r: Request, fingerprint: str | None) -> None:
    if not r.query.strip() or r.top_k < 1:
        raise ValueError("bad_input: a query and top_k of at least 1 are needed")
    if r.mode not in ("hybrid", "bm25", "dense") or r.group_by not in ("chunk", "document"):
        raise ValueError("bad_input: unknown mode or grouping")
    if r.mode != "bm25" and r.embedding is None:
        raise ValueError("bad_input: dense retrieval needs an embedding")
    if r.mode != "bm25" and r.fingerprint != fingerprint:
        raise ValueError("fingerprint_mismatch: the query and the active generation differ")
    R.rrf_weights(*r.weights)


#: Rows that authority may move, for each row of a page.
WINDOW = 8


def scored(r: Request, documents: DataFrame, index: Index, vectors: DataFrame | str, keep: Column, limit: int) -> DataFrame:
    """chunk_id, document_id, score of both arms' best `limit` that pass the filter, fused; the best
    chunk of each document if grouped so."""
    arms = []
    if r.mode != "dense":
        arms.append(R.lexical_topk(index, R.query_terms(r.query), limit, keep).select("chunk_id", "document_id", "rank").withColumn("arm", F.lit(0)))
    if r.mode != "bm25":
        if isinstance(vectors, str):  # stored cells, with the filters' columns and the first chunk beside each vector
            known = keep & F.col("chunk_id").isNotNull()  # a vector without a document has no columns beside it
            d = cells.search(documents.sparkSession, vectors, r.embedding, limit, r.probes, r.fingerprint, known, R.POOL_FACTOR)
            arms.append(d.select("chunk_id", "document_id", "rank").withColumn("arm", F.lit(1)))
    if r.mode != "bm25" and not isinstance(vectors, str):
        d = R.dense_topk(vectors, r.embedding, limit, documents, keep)
        first = index.chunks.join(F.broadcast(d.select("document_id")), "document_id", "left_semi").groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id"))
        arms.append(d.join(F.broadcast(first), "document_id").select("chunk_id", "document_id", "rank").withColumn("arm", F.lit(1)))  # at most `limit` rows each
    ranks = arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])
    weights = r.weights if r.mode == "hybrid" else (1.0, 1.0)
    part = lambda arm: F.coalesce(R.rrf(F.min(F.when(F.col("arm") == arm, F.col("rank"))), weights[arm]), F.lit(0.0))
    out = ranks.groupBy("chunk_id", "document_id").agg(F.round(part(0) + part(1), 8).alias("score"))
    return R.best_per(out, "document_id", [F.desc("score"), F.asc("chunk_id")]) if r.group_by == "document" else out


def best_fragments(ask: Callable[[int], DataFrame], limit: int, score: str) -> list[Row]:
    """The best row of each of the first `limit` documents of a ranking: more rows are asked for until so many
    documents are met or there are no more rows."""
    n = 4 * limit
    while True:
        rows = ask(n).collect()
        first: dict = {}
        for x in sorted(rows, key=lambda x: ((x[score] if score == "distance" else -x[score]), x["chunk_id"])):
            first.setdefault(x["document_id"], x)
        if len(first) >= limit or len(rows) < n:
            return list(first.values())[:limit]
        n *= 4


def zone_search(units: Index, vectors: str, terms: list[str], embedding: list[float], zone: str, limit: int, keep: Column | None = None, probes: int | None = None, fingerprint: str | None = None) -> DataFrame:
    """document_id, unit_id, score: decisions by one zone's units, a decision by its best one. Both arms filter
    by zone (the index's kind) and `keep` (source, dates) before they rank: postings and vectors have
    these columns beside them, and cells are probed until enough pass. The unit shown is the
    lexical arm's, else the dense one's."""
    spark = units.forward.sparkSession
    inside = F.col("kind") == zone
    inside = inside if keep is None else inside & keep
    lex = best_fragments(lambda n: units.best(terms, n, inside), limit, "score")
    near = lambda n: cells.search(spark, vectors, embedding, n, probes, fingerprint, inside, 0).withColumnsRenamed({"document_id": "chunk_id", "decision_id": "document_id"})
    den = best_fragments(near, limit, "distance")
    rows = [(x["document_id"], x["chunk_id"], arm, k) for arm, found in ((0, lex), (1, den)) for k, x in enumerate(found, 1)]
    ranks = spark.createDataFrame(rows, "document_id long, unit_id string, arm int, rank long")
    part = lambda arm, w: F.coalesce(R.rrf(F.min(F.when(F.col("arm") == arm, F.col("rank"))), w), F.lit(0.0))
    return ranks.groupBy("document_id").agg(F.min_by("unit_id", "arm").alias("unit_id"), F.round(part(0, R.LEXICAL_WEIGHT) + part(1, R.DENSE_WEIGHT), 8).alias("score"))


def search(r: Request, documents: DataFrame, index: Index | Callable[[], Index], vectors: DataFrame | str, fingerprint: str | None = None) -> Response:
    """Routes citation-shaped hybrid queries to the exact resolver, others to retrieval; one row more
    than a page tells whether a next page exists. index: one, or what opens it, called by retrieval alone.
    vectors: a table, scanned whole, or the path of stored cells."""
    validate(r, fingerprint)
    intent = citation_intent(r.query, r.as_of) if r.mode == "hybrid" and not r.corpora else None
    audit = {"route": "fanout" if r.corpora else r.mode, "fallback": False}
    if intent:
        exact = documents.filter((F.lower(F.trim("title")) == f"article {intent['number'].lower()}") & R.asof(intent["as_of"])).orderBy(F.desc_nulls_last("valid_from"), "document_id")
        rows = [x.asDict() for x in exact.select("document_id", "title").limit(r.top_k).collect()]
        if rows:
            return Response(rows, None, audit | {"route": "structured"})
        audit["fallback"] = True
    index = index() if callable(index) else index
    key, keep = "document_id" if r.group_by == "document" else "chunk_id", R.asof(r.as_of)
    keep = keep if r.kind is None else keep & (F.col("kind") == r.kind)
    cursor = R.parse_cursor(r.cursor, r.group_by) if r.cursor else None
    each = 4 if r.group_by == "chunk" else 20
    if r.corpora:
        depth = R.fanout_depth(cursor and cursor.score, r.top_k)
        arms = [scored(r, documents, index, vectors, keep & (F.col("lang") == c), each * depth).withColumn("corpus", F.lit(c)) for c in r.corpora]
        rows = R.fanout_page(reduce(DataFrame.unionByName, arms), "corpus", key, depth, cursor).limit(r.top_k + 1).collect()
    else:
        found = scored(r, documents, index, vectors, keep, each * r.top_k)
        if r.authority > 0:
            return Response(by_authority(r, found, documents, key), None, audit | {"authority": r.authority})
        found = found if cursor is None else R.after_cursor(found, cursor.score, cursor.last_id, id_col=key)
        rows = found.orderBy(F.desc("score"), key).limit(r.top_k + 1).collect()
    page = [x.asDict() for x in rows[: r.top_k]]
    last = page[-1] if len(rows) > r.top_k else None
    return Response(page, last and R.Cursor(r.group_by, last["score"], last.get("corpus"), str(last[key])).encode(), audit)


def by_authority(r: Request, found: DataFrame, documents: DataFrame, key: str) -> list[dict]:
    """The first page when sources of more authority may go before others of like score."""
    order = [F.desc("score"), F.asc(key)]
    window = R.numbered(found.orderBy(*order).limit(WINDOW * r.top_k), order, "id")
    tier, _ = R.authority_tier(F.col("source"), F.col("publication") if "publication" in documents.columns else F.lit(None).cast("string"))
    court = F.when(F.col("source") == "jade", "administrative").otherwise("judicial")
    c = window.join(documents, "document_id").select(F.lit(0).cast("bigint").alias("query_id"), "id", court.alias("order_key"), tier.cast("bigint").alias("tier"), "score")
    placed = R.authority_rerank(c, r.authority).filter(F.col("position") <= r.top_k).select("id", "position", "tier")
    rows = window.join(placed, "id").orderBy("position").collect()
    return [{k: v for k, v in x.asDict().items() if k not in ("id", "position")} for x in rows]
