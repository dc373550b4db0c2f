"""Queries of scalar functions: numbers, dates, timestamps, JSON, HTML, URLs, cursors, query text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import DOCS_SQL, docs, read
from ..functions import text as T
from ..operators import retrieval as R
from .registry import query


@query("SELECT doc_id, ['L121-3', 'R12', '1240', 'D5-A'][1 + doc_id % 4] AS number FROM documents")
def article_number(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("l. 121‑3", "R.12", " 12 40 ", "d5-a"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", T.article_number(raw).alias("number"))


@query("SELECT doc_id, ['code civil', 'code de procédure civile', 'code du travail'][1 + doc_id % 3] AS name FROM documents")
def code_name(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("Code  Civil."), F.lit(" code de\nprocédure civile,."), F.lit("CODE DU TRAVAIL")), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", T.code_name(raw).alias("name"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000000 END AS unix, epoch_us(ts) // 1000000 AS back FROM events""")
def compact_timestamps(spark, sf_dir):
    """To and from the compact form and RFC 3339; another shape is null."""
    e = read(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("u")).select("event_id", T.to_compact(F.col("u")).alias("compact"), T.to_rfc3339(F.col("u")).alias("rfc3339"))
    wrong = F.when(F.col("event_id") % 5 == 0, F.concat("compact", F.lit("0"))).otherwise(F.col("compact"))
    return e.select("event_id", "compact", "rfc3339", F.unix_seconds(T.compact_time(wrong)).alias("unix"), T.from_rfc3339(F.col("rfc3339")).alias("back"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AS has_big, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS n_numbers, event_id % 3 = 0 AS contains_x, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS built,
  CASE WHEN event_id % 2 = 0 THEN 'array' ELSE 'object' END AS kind FROM events""")
def json_fields(spark, sf_dir):
    """Fields, casts, array length, containment, building and the type of a value."""
    k = F.col("event_id")
    value = F.get_json_object("props", "$.k").cast("bigint")
    numbers = F.when(k % 3 == 0, F.lit('["12.345", "x", "7"]')).otherwise(F.lit('["1", "2"]'))
    shape = F.when(k % 2 == 0, F.lit(" [1]")).otherwise(F.lit('{"a":1}'))
    return read(spark, sf_dir, "events").select("event_id", value.alias("k"), (value >= 50).alias("has_big"), F.json_array_length(numbers).alias("n_numbers"), F.array_contains(F.from_json(numbers, "array<string>"), "x").alias("contains_x"), F.to_json(F.struct(k.alias("id"), F.col("event_type").alias("kind"))).alias("built"), F.when(F.ltrim(shape).startswith("["), "array").otherwise("object").alias("kind"))


@query("SELECT page_id, nullif(regexp_extract(html, 'href=\"([^\"]*)\"', 1), '') AS href, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text FROM pages")
def html_fields(spark, sf_dir):
    """The first link, and the text without tags."""
    return read(spark, sf_dir, "pages").select("page_id", F.nullif(T.first_href(F.col("html")), F.lit("")).alias("href"), F.md5(T.plain_text(F.col("html"))).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'code civil & ' || page_id END AS q FROM pages")
def url_query(spark, sf_dir):
    """The `query` parameter of an address, decoded; null without one."""
    k = F.col("page_id")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://h.example/s?a=b&query=code+civil%20%26%20"), k.cast("string"), F.lit("&z=1"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("query"))).alias("q"))


@query("SELECT document_id, md5(array_to_string(regexp_extract_all(body, '[\\p{L}\\p{N}]+'), ' ')) AS query FROM docs", DOCS_SQL)
def query_text_norm(spark, sf_dir):
    return docs(spark, sf_dir).select("document_id", F.md5(T.query_text(F.col("body"))).alias("query"))


@query("""SELECT * FROM (VALUES ('0.5:chunk:a:0', 'chunk', true, 0.5::DOUBLE, NULL, 'chunk:a:0'), ('doc:0.25:a:b', 'document', true, 0.25, NULL, 'a:b'), ('mc:chunk:0.5:core:x:y:z', 'chunk', true, 0.5, 'core', 'x:y:z'), ('mc:document:1.0:c:d', 'document', true, 1.0, 'c', 'd'),
  ('doc:0.25:a', 'chunk', false, NULL, NULL, NULL), ('0.5:a', 'document', false, NULL, NULL, NULL), ('nan:a', 'chunk', false, NULL, NULL, NULL), ('0.5:', 'chunk', false, NULL, NULL, NULL), ('x', 'chunk', false, NULL, NULL, NULL), ('mc:chunk:0.5:core', 'chunk', false, NULL, NULL, NULL), ('', 'chunk', false, NULL, NULL, NULL)) t(given, grouping_, ok, score, corpus, last_id)""")  # fmt: skip
def cursor_codec(spark, sf_dir):
    """Every form of a cursor, and what isn't one or is one of another grouping."""
    given = [("0.5:chunk:a:0", "chunk"), ("doc:0.25:a:b", "document"), ("mc:chunk:0.5:core:x:y:z", "chunk"), ("mc:document:1.0:c:d", "document"), ("doc:0.25:a", "chunk"), ("0.5:a", "document"), ("nan:a", "chunk"), ("0.5:", "chunk"), ("x", "chunk"), ("mc:chunk:0.5:core", "chunk"), ("", "chunk")]

    def read_one(text, group):
        try:
            c = R.parse_cursor(text, group)
            assert c.encode() == text
            return (text, group, True, c.score, c.corpus, c.last_id)
        except ValueError:
            return (text, group, False, None, None, None)

    return spark.createDataFrame([read_one(*g) for g in given], "given string, grouping_ string, ok boolean, score double, corpus string, last_id string")


@query("SELECT * FROM (VALUES (NULL, 10, 11), (0.5::DOUBLE, 10, 11), (0.015384615384615385::DOUBLE, 10, 16), (0.01::DOUBLE, 5, 46)) t(cursor_score, page, depth)")
def fanout_depth(spark, sf_dir):
    """How deep each arm of a fan-out must go for the page after a cursor."""
    rows = [(s, p, R.fanout_depth(s, p)) for s, p in ((None, 10), (0.5, 10), (1 / 65, 10), (0.01, 5))]
    return spark.createDataFrame(rows, "cursor_score double, page int, depth int")


@query("WITH s AS (SELECT source, count(*) * 2000 AS n FROM documents GROUP BY source UNION ALL SELECT 'all', count(*) * 100000 FROM documents), l AS (SELECT *, greatest(1, CASE WHEN n <= 1000000 THEN n // 1000 ELSE CAST(floor(sqrt(n)) AS BIGINT) END) AS lists FROM s) SELECT source, n, lists, CAST(least(4096, greatest(1, floor(sqrt(lists)))) AS BIGINT) AS probes FROM l")
def ivfflat_lists(spark, sf_dir):
    """Lists and probes of each source's vectors and of all, if documents had some thousand vectors each."""
    d = read(spark, sf_dir, "documents")
    n = d.groupBy("source").agg((F.count("*") * 2000).alias("n")).unionByName(d.agg(F.lit("all").alias("source"), (F.count("*") * 100000).alias("n")))
    lists = F.greatest(F.lit(1).cast("bigint"), F.when(F.col("n") <= 1_000_000, F.floor(F.col("n") / 1000)).otherwise(F.floor(F.sqrt("n"))))
    return n.select("source", "n", lists.alias("lists")).select("*", F.least(F.lit(4096).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.floor(F.sqrt("lists")))).alias("probes"))
