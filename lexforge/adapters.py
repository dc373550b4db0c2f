"""The legal data model over plain tables: each relation as a DataFrame, and as a DuckDB CTE for oracles.

A relation's two forms state the same thing; queries and their oracles build on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.index import Index, stored
from .storage import kept

CHUNK = 6000

DOCS_SQL = """docs AS (
  SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 1 THEN 'decision' ELSE 'article' END AS kind, source, lang, text AS body,
    'Article ' || (doc_id % 400) AS title, 'doc:' || doc_id AS source_uid, n_chars,
    DATE '2000-01-01' + CAST(doc_id % 6000 AS INTEGER) AS valid_from,
    CASE WHEN doc_id % 3 = 0 THEN DATE '2000-01-01' + CAST(doc_id % 6000 + doc_id % 2000 + 1 AS INTEGER) END AS valid_to
  FROM documents)"""
CHUNKS_SQL = f"""chunks AS (
  SELECT document_id, CAST(i AS BIGINT) AS chunk_index, document_id || ':' || i AS chunk_id, substr(body, CAST(i * {CHUNK} + 1 AS BIGINT), {CHUNK}) AS body
  FROM (SELECT document_id, body, unnest(range(0, greatest(1, CAST(ceil(length(body) / {CHUNK}.0) AS BIGINT)))) AS i FROM docs))"""
VERSIONS_SQL = """versions AS (
  SELECT o_custkey AS family, o_orderkey AS version_id, CAST(o_orderdate AS DATE) AS valid_from, o_totalprice AS amount, o_orderpriority AS label,
    lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS valid_to
  FROM orders)"""
EDGES_SQL = """edges AS (
  SELECT l_orderkey AS from_id, l_partkey AS to_id, l_returnflag AS tag, l_linestatus AS status, CAST(l_linenumber AS BIGINT) AS position,
    CAST(l_shipdate AS DATE) AS debut FROM lineitem)"""
CHANGES_SQL = """changes AS (
  SELECT event_id AS change_seq, user_id AS scope, value, 'c' || (user_id % 3) AS corpus,
    CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'replace_set' ELSE 'upsert' END AS op,
    CASE WHEN event_id % 3 = 0 THEN 'documents' WHEN event_id % 3 = 1 THEN 'chunks' ELSE 'chunk_embeddings' END AS relation FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    k = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        k.alias("document_id"),
        F.when(k % 2 == 1, "decision").otherwise("article").alias("kind"),
        "source",
        "lang",
        F.col("text").alias("body"),
        F.concat(F.lit("Article "), (k % 400).cast("string")).alias("title"),
        F.concat(F.lit("doc:"), k.cast("string")).alias("source_uid"),
        "n_chars",
        day(k % 6000).alias("valid_from"),
        F.when(k % 3 == 0, day(k % 6000 + k % 2000 + 1)).alias("valid_to"),
    )


def chunks(spark: SparkSession, sf_dir: str, *beside: str) -> DataFrame:
    """The chunks; beside: columns of their documents."""
    n = F.greatest(F.lit(1), F.ceil(F.length("body") / CHUNK)).cast("int")
    d = docs(spark, sf_dir).select("document_id", *beside, "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return d.select("document_id", F.col("i").cast("bigint").alias("chunk_index"), F.concat_ws(":", F.col("document_id").cast("string"), F.col("i").cast("string")).alias("chunk_id"), F.substring("body", F.col("i") * CHUNK + 1, F.lit(CHUNK)).alias("body"), *beside)


def indexed(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the chunks."""
    return stored(chunks(spark, sf_dir, "kind", "source", "lang", "valid_from", "valid_to"), sf_dir)


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks in order of their documents, so that a few are read without the rest."""
    c = chunks(spark, sf_dir)
    return kept(c.repartitionByRange("document_id").sortWithinPartitions("document_id", "chunk_index"), "chunks", sf_dir)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").cast("date").alias("valid_from"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("label"))
    return o.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("family").orderBy("valid_from", "version_id")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("bigint").alias("position"), F.col("l_shipdate").cast("date").alias("debut"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("change_seq"),
        F.col("user_id").alias("scope"),
        "value",
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("corpus"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "replace_set").otherwise("upsert").alias("op"),
        F.when(k % 3 == 0, "documents").when(k % 3 == 1, "chunks").otherwise("chunk_embeddings").alias("relation"),
    )
