"""Queries of search: BM25, dense, fused, grouped, paged, compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..adapters import CHUNKS_SQL, DOCS_SQL, chunks, docs, indexed, read, stored_chunks
from ..operators import cells as C
from ..operators import retrieval as R
from ..operators import search as S
from ..operators.index import stored
from .registry import query

TERMS = ["the", "mit", "license", "de", "er"]
DAY = "2008-06-01"
BM25_SQL = """tok AS (SELECT chunk_id, document_id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS w FROM chunks),
len AS (SELECT chunk_id, document_id, len(w) AS n FROM tok),
st AS (SELECT count(*) AS total, avg(n) AS avg_len FROM len),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(list_filter(w, lambda x: x IN ('the', 'mit', 'license', 'de', 'er'))) AS term FROM tok) GROUP BY ALL),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT chunk_id, document_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / avg_len))), 6) AS score
  FROM tf JOIN dfreq USING (term) JOIN len USING (chunk_id), st GROUP BY chunk_id, document_id),
live AS (SELECT document_id FROM docs WHERE (valid_from IS NULL OR valid_from <= DATE '2008-06-01') AND (valid_to IS NULL OR valid_to > DATE '2008-06-01')),
lex AS (SELECT chunk_id, document_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE document_id IN (SELECT document_id FROM live) QUALIFY rank <= 50)"""
#: The query vector is that of vec_id 7; rows 0..499 stand for documents of the same id.
DENSE_SQL = """dist AS (SELECT e.vec_id AS document_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))), 6) AS distance
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
pool AS (SELECT * FROM dist ORDER BY distance, document_id LIMIT 200),
den AS (SELECT document_id, distance, row_number() OVER (ORDER BY distance, document_id) AS rank FROM pool WHERE document_id IN (SELECT document_id FROM live) QUALIFY rank <= 50)"""
FUSE_SQL = """fused AS (SELECT document_id, min(l) AS lexical_rank, min(d) AS dense_rank,
  round(coalesce(1.0::DOUBLE / (60 + min(l)), 0) + coalesce(0.3::DOUBLE / (60 + min(d)), 0), 8) AS score
  FROM (SELECT document_id, rank AS l, NULL AS d FROM lex UNION ALL SELECT document_id, NULL, rank FROM den) GROUP BY document_id)"""
LEX, DEN, FUSE = (DOCS_SQL, CHUNKS_SQL, BM25_SQL), (DENSE_SQL,), (FUSE_SQL,)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding", F.col("label").cast("bigint").alias("label"))


_asked: dict[tuple[str, str], list[float]] = {}


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """What an embedder gives for the query, once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _asked:
        _asked[key] = list(vectors(spark, sf_dir).filter("document_id = 7").first().embedding)
    return _asked[key]


def lexical(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    return R.lexical_topk(indexed(spark, sf_dir), TERMS, limit, R.asof(DAY))


def dense(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    return R.dense_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), limit, docs(spark, sf_dir), R.asof(DAY))


def page(df: DataFrame) -> DataFrame:
    """A ranking's page, computed once for all that is made of it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf_fuse(lexical(spark, sf_dir), dense(spark, sf_dir))


@query("SELECT chunk_id, document_id, score, rank FROM lex", *LEX)
def lexical_topk(spark, sf_dir):
    return lexical(spark, sf_dir)


@query("SELECT chunk_id, document_id, round(1.0::DOUBLE / (60 + rank), 8) AS rrf_score, score, rank, substr(regexp_replace(body, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), 1, 280) AS snippet FROM lex JOIN chunks USING (chunk_id, document_id) WHERE rank <= 20", *LEX)
def bm25_only(spark, sf_dir):
    best = lexical(spark, sf_dir, 20)
    rows = best.collect()  # a page; its chunks alone are read
    bodies = stored_chunks(spark, sf_dir).filter(F.col("document_id").isin([r.document_id for r in rows])).select("chunk_id", "body")
    top = bodies.join(F.broadcast(spark.createDataFrame(rows, best.schema)), "chunk_id")
    return R.with_snippet(top).select("chunk_id", "document_id", F.round(R.rrf(F.col("rank")), 8).alias("rrf_score"), "score", "rank", "snippet")


@query("SELECT chunk_id, score FROM bm", *LEX)
def bm25_reference(spark, sf_dir):
    return R.bm25_scores(chunks(spark, sf_dir), TERMS)


@query("SELECT document_id, distance, rank FROM den", *LEX, *DEN)
def dense_topk(spark, sf_dir):
    return dense(spark, sf_dir)


@query("SELECT document_id, round(1.0::DOUBLE / (60 + rank), 8) AS rrf_score FROM den WHERE rank <= 20", *LEX, *DEN)
def dense_only(spark, sf_dir):
    return dense(spark, sf_dir).filter("rank <= 20").select("document_id", F.round(R.rrf(F.col("rank")), 8).alias("rrf_score"))


@query("SELECT document_id, lexical_rank, dense_rank, score FROM fused", *LEX, *DEN, *FUSE)
def rrf_fuse(spark, sf_dir):
    return fused(spark, sf_dir)


@query("SELECT document_id, rank, arm FROM (SELECT document_id, rank, 'lexical' AS arm FROM lex UNION ALL SELECT document_id, rank, 'dense' FROM den)", *LEX, *DEN)
def union_all_ranks(spark, sf_dir):
    return lexical(spark, sf_dir).select("document_id", "rank", F.lit("lexical").alias("arm")).unionByName(dense(spark, sf_dir).select("document_id", "rank", F.lit("dense").alias("arm")))


@query("SELECT chunk_id, document_id, score FROM lex ORDER BY score DESC, chunk_id LIMIT 10", *LEX)
def group_chunk(spark, sf_dir):
    return lexical(spark, sf_dir).orderBy(F.desc("score"), "chunk_id").limit(10).select("chunk_id", "document_id", "score")


@query("SELECT document_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS n FROM bm) WHERE n = 1 ORDER BY score DESC, document_id LIMIT 25", *LEX)
def group_document(spark, sf_dir):
    s = indexed(spark, sf_dir).scores(TERMS)
    return R.best_per(s, "document_id", [F.desc("score"), F.asc("chunk_id")]).orderBy(F.desc("score"), "document_id").limit(25).select("document_id", "chunk_id", "score")


@query("SELECT chunk_id, score FROM bm WHERE score < 3.0 OR (score = 3.0 AND chunk_id > '5') ORDER BY score DESC, chunk_id LIMIT 20", *LEX)
def keyset_chunk(spark, sf_dir):
    return R.after_cursor(indexed(spark, sf_dir).scores(TERMS), 3.0, "5").orderBy(F.desc("score"), "chunk_id").limit(20).select("chunk_id", "score")


@query("SELECT document_id, score FROM fused WHERE score < 0.012 OR (score = 0.012 AND document_id > 40) ORDER BY score DESC, document_id LIMIT 15", *LEX, *DEN, *FUSE)
def keyset_document(spark, sf_dir):
    return R.after_cursor(fused(spark, sf_dir), 0.012, 40, id_col="document_id").orderBy(F.desc("score"), "document_id").limit(15).select("document_id", "score")


@query("SELECT source, document_id FROM docs WHERE (source, document_id) > ('src12', 40) ORDER BY source, document_id LIMIT 50", DOCS_SQL)
def keyset_tuple(spark, sf_dir):
    return docs(spark, sf_dir).select("source", "document_id").filter(F.struct("source", "document_id") > F.struct(F.lit("src12"), F.lit(40).cast("bigint"))).orderBy("source", "document_id").limit(50)


@query(
    """WITH per AS (SELECT lang AS corpus, document_id, max(score) AS score FROM bm JOIN docs USING (document_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, document_id) AS n FROM per QUALIFY n <= 20)
    SELECT corpus, document_id, score AS local_score, round(1.0::DOUBLE / (60 + n), 8) AS cross_score FROM r ORDER BY cross_score DESC, corpus, document_id LIMIT 20""",
    *LEX,
)
def fanout_rrf(spark, sf_dir):
    per = indexed(spark, sf_dir).scores(TERMS).groupBy("document_id").agg(F.max("score").alias("score"), F.first("lang").alias("corpus"))
    return R.fanout_rrf(per, "corpus", 20)


ZONES = ["motivations", "moyens", "dispositif"]
#: Units of decisions: their lines that aren't blank go round the zones; each has a vector.
UNITS_SQL = """lines AS (SELECT document_id, source, valid_from, valid_to, x, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS k FROM
    (SELECT *, unnest(range(0, len(string_split(body, chr(10))))) AS i, unnest(string_split(body, chr(10))) AS x FROM docs WHERE kind = 'decision') WHERE trim(x) <> ''),
  units AS (SELECT document_id || ':' || ['motivations', 'moyens', 'dispositif'][1 + k % 3] || ':' || (k // 3) AS unit_id, document_id, ['motivations', 'moyens', 'dispositif'][1 + k % 3] AS zone, k // 3 AS fragment_index, source, valid_from, valid_to, x AS body,
    (document_id * 3 + k) % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id FROM lines)"""
ZONE_SQL = """ut AS (SELECT *, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS w FROM units),
  ust AS (SELECT count(*) AS total, avg(len(w)) AS avg_len FROM ut),
  utf AS (SELECT unit_id, len(w) AS n, unnest(list_filter(w, lambda x: x IN ('the', 'mit', 'license', 'de', 'er'))) AS term FROM ut),
  uc AS (SELECT unit_id, n, term, count(*) AS tf FROM utf GROUP BY ALL), ud AS (SELECT term, count(*) AS df FROM uc GROUP BY term),
  ub AS (SELECT unit_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / avg_len))), 6) AS score FROM uc JOIN ud USING (term), ust GROUP BY unit_id),
  inside AS (SELECT * FROM units WHERE zone = 'motivations' AND source <> 'src1' AND valid_from <= DATE '2008-06-01' AND (valid_to IS NULL OR valid_to > DATE '2008-06-01')),
  ul AS (SELECT document_id, unit_id, row_number() OVER (ORDER BY score DESC, unit_id) AS rank FROM (SELECT document_id, unit_id, score FROM inside JOIN ub USING (unit_id) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, unit_id) = 1) QUALIFY rank <= 30),
  ue AS (SELECT document_id, unit_id, distance, row_number() OVER (ORDER BY distance, unit_id) AS rank FROM (SELECT i.document_id, i.unit_id, d.distance FROM inside i JOIN dist d ON d.document_id = i.vec_id QUALIFY row_number() OVER (PARTITION BY i.document_id ORDER BY distance, unit_id) = 1) QUALIFY rank <= 30)"""


def units(spark, sf_dir):
    """The zone units of decisions, as chunks whose kind is the zone, with their vectors' ids."""
    d = docs(spark, sf_dir).filter("kind = 'decision'")
    k = F.col("k")
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (k % 3 + 1).cast("int"))
    n = read(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    lines = d.select("document_id", "source", "lang", "valid_from", "valid_to", F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("k", "body"))
    fragment = F.floor(k / 3).cast("bigint")
    return lines.select(F.concat_ws(":", F.col("document_id").cast("string"), zone, fragment.cast("string")).alias("chunk_id"), "document_id", zone.alias("kind"), "source", "lang", "valid_from", "valid_to", "body", ((F.col("document_id") * 3 + k) % n).alias("vec_id"))


def zone_store(spark, sf_dir):
    """The units' index and cells, built where they aren't yet."""
    u = units(spark, sf_dir)
    path = storage.place(spark, "unit-cells", sf_dir)
    if C.manifest(spark, path) is None:
        e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        v = u.join(e, "vec_id").select(F.col("chunk_id").alias("document_id"), F.col("document_id").alias("decision_id"), "embedding", "kind", "source", "lang", "valid_from", "valid_to")
        C.build(v, v.select("document_id"), path, max(16, R.ivfflat_lists(v.count())), "fp")
    return stored(u.drop("vec_id"), "units", sf_dir), path


@query("SELECT document_id, coalesce(min(CASE WHEN arm = 0 THEN unit_id END), min(unit_id)) AS unit_id, round(coalesce(1.0::DOUBLE / (60 + min(CASE WHEN arm = 0 THEN rank END)), 0) + coalesce(0.3::DOUBLE / (60 + min(CASE WHEN arm = 1 THEN rank END)), 0), 8) AS score FROM (SELECT document_id, unit_id, rank, 0 AS arm FROM ul UNION ALL SELECT document_id, unit_id, rank, 1 FROM ue) GROUP BY document_id", *LEX, *DEN, UNITS_SQL, ZONE_SQL)
def zone_search(spark, sf_dir):
    """Decisions by their motivations, of all courts but one and in force on a day; all cells are probed here, so that
    the result is the exact one."""
    index, path = zone_store(spark, sf_dir)
    keep = (F.col("source") != "src1") & R.asof(DAY)
    return S.zone_search(index, path, TERMS, query_vector(spark, sf_dir), "motivations", 30, keep, C.manifest(spark, path)["lists"], "fp")


@query(
    """WITH a AS (SELECT document_id, min(rank) AS bm25 FROM lex GROUP BY document_id), d AS (SELECT document_id, rank AS dense FROM den),
    h AS (SELECT document_id, row_number() OVER (ORDER BY score DESC, document_id) AS hybrid FROM fused)
    SELECT document_id, bm25, dense, hybrid, least(coalesce(bm25, 1000000), coalesce(dense, 1000000), coalesce(hybrid, 1000000)) AS best FROM a FULL JOIN d USING (document_id) FULL JOIN h USING (document_id)""",
    *LEX, *DEN, *FUSE,
)
def compare(spark, sf_dir):
    order = [F.desc("score"), F.asc("document_id")]
    lex, den = page(lexical(spark, sf_dir)), page(dense(spark, sf_dir))
    a = lex.groupBy("document_id").agg(F.min("rank").alias("bm25"))
    d = den.select("document_id", F.col("rank").alias("dense"))
    h = R.numbered(R.rrf_fuse(lex, den), order, "hybrid").select("document_id", "hybrid")
    x = a.join(d, "document_id", "full").join(h, "document_id", "full")
    return x.select("document_id", "bm25", "dense", "hybrid", F.least(*(F.coalesce(c, F.lit(1000000).cast("bigint")) for c in ("bm25", "dense", "hybrid"))).alias("best"))


@query("SELECT (SELECT count(*) FROM (SELECT document_id FROM lex INTERSECT SELECT document_id FROM den)) AS bm25_dense, (SELECT count(*) FROM (SELECT document_id FROM lex INTERSECT SELECT document_id FROM fused)) AS bm25_hybrid", *LEX, *DEN, *FUSE)
def mode_overlap(spark, sf_dir):
    lex, den = page(lexical(spark, sf_dir)), page(dense(spark, sf_dir))
    a, d, h = (x.select("document_id") for x in (lex, den, R.rrf_fuse(lex, den)))
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(a.intersect(d), "bm25_dense").join(n(a.intersect(h), "bm25_hybrid"))


def cells(spark, sf_dir) -> tuple[str, dict]:
    """The stored cells of the vectors, built where they aren't yet, and their manifest. Beside a vector stand
    the columns that searches filter by and its document's first chunk."""
    path = storage.place(spark, "cells", sf_dir)
    m = C.manifest(spark, path)
    if m is None:
        v = vectors(spark, sf_dir)
        first = chunks(spark, sf_dir).groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id"))
        beside = docs(spark, sf_dir).select("document_id", "kind", "source", "lang", "valid_from", "valid_to").join(first, "document_id")
        m = C.build(v.join(beside, "document_id", "left"), v.select("document_id"), path, max(16, R.ivfflat_lists(v.count())), "fp")
    return path, m


@query()
def ivfflat_search(spark, sf_dir):
    """The manifest's probes; tests hold its recall against the exact order."""
    path, _ = cells(spark, sf_dir)
    return C.search(spark, path, query_vector(spark, sf_dir), 20, None, "fp").select("document_id", "distance", "rank")


@query("SELECT CAST(count(*) AS BIGINT) AS \"rows\", CAST(64 AS BIGINT) AS dimension, 'fp' AS fingerprint, CAST(0 AS BIGINT) AS missing, true AS recalled FROM embeddings")
def ivfflat_build(spark, sf_dir):
    """The manifest of the stored cells, whether any vector is missing in them, and whether the probes' recall is 0.9 or more."""
    path, m = cells(spark, sf_dir)
    lost = vectors(spark, sf_dir).join(spark.read.parquet(f"{path}/cells"), "document_id", "left_anti").agg(F.count("*").alias("missing"))
    recalled = max((r for p, r in m["curve"] if p <= m["probes"]), default=0.0) >= 0.9
    return lost.select(F.lit(m["rows"]).cast("bigint").alias("rows"), F.lit(m["dimension"]).cast("bigint").alias("dimension"), F.lit(m["fingerprint"]).alias("fingerprint"), "missing", F.lit(recalled).alias("recalled"))


@query(
    """WITH t AS (SELECT e.vec_id AS document_id, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)
    SELECT document_id, CAST(label AS BIGINT) AS label, cosine FROM t ORDER BY cosine DESC, document_id LIMIT 30"""
)
def dense_cosine_eval(spark, sf_dir):
    q = F.array(*map(F.lit, query_vector(spark, sf_dir)))
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, sf_dir).select("document_id", "label", F.round(dot, 6).alias("cosine")).orderBy(F.desc("cosine"), "document_id").limit(30)


@query()
def authority_rerank(spark, sf_dir):
    d = lexical(spark, sf_dir).join(docs(spark, sf_dir).select("document_id", "source", "kind"), "document_id")
    tier, _ = R.authority_tier(F.when(F.col("document_id") % 5 == 0, "cass").otherwise("jade"), F.when(F.col("document_id") % 2 == 0, "oui").otherwise("b"))
    return R.authority_rerank(d.select(F.lit(0).cast("bigint").alias("query_id"), F.col("document_id").alias("id"), F.col("kind").alias("order_key"), tier.cast("bigint").alias("tier"), "score"), 0.1)


@query(
    """SELECT doc_id AS document_id, CAST(CASE s WHEN 'cass' THEN CASE WHEN lower(p) = 'oui' THEN 3 ELSE 2 END WHEN 'inca' THEN 1 WHEN 'jade' THEN CASE lower(p) WHEN 'a' THEN 2 WHEN 'b' THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS tier, s IN ('cass', 'jade') AND p IS NULL AS marker_absent
    FROM (SELECT d.doc_id, ['cass', 'inca', 'capp', 'jade'][1 + d.doc_id % 4] AS s, CASE l.quality WHEN 1 THEN CASE WHEN d.doc_id % 4 = 3 THEN 'A' ELSE 'OUI' END WHEN 0 THEN 'b' END AS p FROM documents d LEFT JOIN labels l USING (doc_id))"""
)
def authority_tier(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = F.element_at(F.array(*map(F.lit, ("cass", "inca", "capp", "jade"))), (F.col("doc_id") % 4 + 1).cast("int"))
    p = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 4 == 3, "A").otherwise("OUI")).when(F.col("quality") == 0, "b")
    tier, absent = R.authority_tier(s, p)
    return d.select(F.col("doc_id").alias("document_id"), tier.cast("bigint").alias("tier"), absent.alias("marker_absent"))
