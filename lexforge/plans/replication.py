"""Queries of delta replication: ranges, coalescing, apply, accounting, feeds, gates, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..adapters import CHANGES_SQL, changes, read
from ..operators import delta as D
from ..operators import merkle
from ..operators.segments import Delta, Store, Table
from .registry import ORACLES, merkle_sql, query


@query("SELECT change_seq, scope, op FROM changes WHERE corpus = 'c1' AND change_seq > 100 AND change_seq <= 5000 ORDER BY change_seq", CHANGES_SQL)
def changed_scopes(spark, sf_dir):
    return D.changed_scopes(changes(spark, sf_dir), "c1", 100, 5000).select("change_seq", "scope", "op")


@query("SELECT corpus, coalesce(max(change_seq), 0) AS high FROM changes GROUP BY corpus", CHANGES_SQL)
def high_water(spark, sf_dir):
    return D.high_water(changes(spark, sf_dir))


COALESCE_SQL = """co AS (SELECT corpus, scope, max(change_seq) AS last_seq, CASE WHEN bool_or(op = 'replace_set') THEN 'replace_set' ELSE 'rows' END AS mode, bool_or(relation IN ('documents', 'chunks')) AS chunks_wide,
  bool_or(relation = 'chunk_embeddings') AND NOT bool_or(relation IN ('documents', 'chunks')) AS embeddings_only FROM changes GROUP BY corpus, scope)"""


@query("SELECT corpus, scope, last_seq, mode, chunks_wide, embeddings_only FROM co", CHANGES_SQL, COALESCE_SQL)
def coalesce_scopes(spark, sf_dir):
    return D.coalesce_scopes(changes(spark, sf_dir))


#: Scopes of a change and its day, so that some days hold embedding changes only.
DAILY_SQL = "daily AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d %H') AS scope, CASE WHEN event_id % 3 = 0 THEN 'documents' WHEN event_id % 3 = 1 THEN 'chunks' ELSE 'chunk_embeddings' END AS relation FROM events)"


@query("SELECT DISTINCT scope FROM daily WHERE relation = 'chunk_embeddings' EXCEPT (SELECT scope FROM daily WHERE relation IN ('chunks', 'documents'))", DAILY_SQL)
def scope_union_difference(spark, sf_dir):
    k = F.col("event_id")
    c = read(spark, sf_dir, "events").select(F.concat_ws("@", F.col("user_id").cast("string"), F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd HH")).alias("scope"), F.when(k % 3 == 0, "documents").when(k % 3 == 1, "chunks").otherwise("chunk_embeddings").alias("relation"))
    wide = c.filter("relation = 'chunks'").select("scope").union(c.filter("relation = 'documents'").select("scope")).distinct()
    return c.filter("relation = 'chunk_embeddings'").select("scope").distinct().join(wide, "scope", "left_anti")


@query("""SELECT DISTINCT 'documents' AS relation, c.scope, CASE WHEN cu.c_custkey IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM changes c LEFT JOIN customer cu ON cu.c_custkey = c.scope AND cu.c_acctbal > 0
  UNION ALL SELECT DISTINCT 'citations', c.scope, 'upsert' FROM changes c JOIN customer cu ON cu.c_custkey = c.scope AND cu.c_acctbal > 0""", CHANGES_SQL)  # fmt: skip
def diff_rows(spark, sf_dir):
    """Citations are never deleted."""
    here = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("scope"))
    of = lambda r: D.diff_rows(changes(spark, sf_dir), here, r).select(F.lit(r).alias("relation"), "scope", "op")
    return of("documents").unionByName(of("citations"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT doc_id + 100000000, 'added' FROM documents WHERE doc_id % 10 = 0")
def apply_upserts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = d.filter("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("source")).unionByName(d.filter("doc_id % 10 = 0").select((F.col("doc_id") + 100000000).alias("doc_id"), F.lit("added").alias("source")))
    return D.apply_upserts(d, rows, "doc_id")


@query("SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def apply_deletes(spark, sf_dir):
    """Children of deleted parents go too."""
    gone = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("n"))
    return D.apply_deletes(rows, gone, "o_orderkey", "l_orderkey")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, turn + 100, 'new' FROM conversations WHERE conv_id % 10 = 0")
def apply_replace_set(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    scopes = c.filter("conv_id % 5 = 0").select("conv_id")
    rows = c.filter("conv_id % 10 = 0").select("conv_id", (F.col("turn") + 100).alias("turn"), F.lit("new").alias("role"))
    return D.apply_replace_set(c, rows, scopes, "conv_id")


@query("""SELECT conv_id, count(*) AS n, 'sha256:' || sha256('[' || string_agg('{"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn) || ']') AS digest FROM conversations GROUP BY conv_id""")
def set_digest(spark, sf_dir):
    return D.set_digests(read(spark, sf_dir, "conversations"), "conv_id", "turn", ["turn", "role"])


@query("""SELECT conv_id, count(*) AS n, string_agg('{"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn) AS rows_json FROM conversations GROUP BY conv_id""")
def replace_set(spark, sf_dir):
    """A scope's whole set as one payload, in key order."""
    line = F.to_json(F.struct("role", "turn"))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("j")))), lambda x: x["j"]), ",").alias("rows_json"))


# --- accounting --------------------------------------------------------------------------------

MEMBERS_SQL = """members AS (SELECT 'r' || (event_id // 100) AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'inserted' WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'parsed' ELSE 'discovered' END AS status, ts AS updated_at, event_id AS member_id,
    'a' || (user_id % 7) AS archive_name, 'm' || user_id AS member_path, 'p2' AS parser_version, 's1' AS schema_version, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE 'c1' END AS code_version, 'h' || (user_id % 5) AS source_payload_hash FROM events),
  wanted AS (SELECT 'a' || (c_custkey % 7) AS archive_name, 'm' || c_custkey AS member_path, CASE WHEN c_custkey % 11 = 3 THEN 'p3' ELSE 'p2' END AS parser_version, 's1' AS schema_version, 'c1' AS code_version, CASE WHEN c_custkey % 13 = 5 THEN 'hx' ELSE 'h' || (c_custkey % 5) END AS source_payload_hash FROM customer)"""


@query("""WITH last AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY archive_name, member_path ORDER BY updated_at DESC, member_id DESC) = 1),
  j AS (SELECT w.archive_name, w.member_path, l.run_id, l.status, concat_ws(',', CASE WHEN l.parser_version <> w.parser_version THEN 'parser_version' END, CASE WHEN l.schema_version <> w.schema_version THEN 'schema_version' END, CASE WHEN l.code_version <> w.code_version THEN 'code_version' END, CASE WHEN l.source_payload_hash <> w.source_payload_hash THEN 'source_payload_hash' END) AS mismatched
    FROM wanted w LEFT JOIN last l ON l.archive_name = w.archive_name AND l.member_path = w.member_path)
  SELECT archive_name, member_path, CASE WHEN run_id IS NULL THEN 'process' WHEN mismatched <> '' THEN 'blocked_incompatible' WHEN status IN ('inserted', 'skipped') THEN 'skip' ELSE 'retry' END AS action,
    CASE WHEN run_id IS NULL THEN 'new_member' WHEN mismatched <> '' THEN 'compatibility_mismatch' WHEN status IN ('inserted', 'skipped') THEN 'compatible_complete' WHEN status = 'failed' THEN 'previous_failed' ELSE 'previous_unfinished' END AS reason,
    run_id AS previous_run_id, status AS previous_status, coalesce(mismatched, '') AS mismatched FROM j""", MEMBERS_SQL)  # fmt: skip
def resume_decision(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "inserted").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "click", "parsed").otherwise("discovered")
    members = read(spark, sf_dir, "events").select(s("r", F.floor(e / 100)).alias("run_id"), status.alias("status"), F.col("ts").alias("updated_at"), e.alias("member_id"), s("a", u % 7).alias("archive_name"), s("m", u).alias("member_path"), F.lit("p2").alias("parser_version"), F.lit("s1").alias("schema_version"), F.when(e % 5 == 0, "old").otherwise("c1").alias("code_version"), s("h", u % 5).alias("source_payload_hash"))
    k = F.col("c_custkey")
    wanted = read(spark, sf_dir, "customer").select(s("a", k % 7).alias("archive_name"), s("m", k).alias("member_path"), F.when(k % 11 == 3, "p3").otherwise("p2").alias("parser_version"), F.lit("s1").alias("schema_version"), F.lit("c1").alias("code_version"), F.when(k % 13 == 5, "hx").otherwise(s("h", k % 5)).alias("source_payload_hash"))
    return D.resume_decision(wanted, members)


@query("""SELECT o_orderpriority AS source, max(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND coalesce(o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0, false) = false THEN strftime(o_orderdate, '%Y%m%d%H%M%S') END) AS "cursor" FROM orders GROUP BY o_orderpriority""")
def ingest_cursor(spark, sf_dir):
    """Runs over orders; some have no stamp, some were limited to a few members, some don't say."""
    k = F.col("o_orderkey")
    stamp = F.date_format(F.to_utc_timestamp("o_orderdate", F.current_timezone()), "yyyyMMddHHmmss")
    return D.ingest_cursor(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.when(k % 5 != 0, stamp).alias("stamp"), F.when(k % 4 != 0, k % 3 == 0).alias("member_limited")))


SOURCES_SQL = "sources AS (SELECT n_name AS source, 'g' || n_regionkey AS run_group, CASE WHEN n_nationkey % 4 <> 0 THEN 'b' || (n_nationkey % 3) END AS fetched, CASE WHEN n_nationkey % 5 <> 0 THEN 'b' || (n_nationkey % 2) END AS adopted FROM nation), decided AS (SELECT *, CASE WHEN fetched IS NULL THEN 'no_baseline_fetched' WHEN fetched IS NOT DISTINCT FROM adopted THEN 'current' ELSE 'rebaseline_pending' END AS state FROM sources)"


def sources(spark, sf_dir):
    k = F.col("n_nationkey")
    b = lambda m: F.concat(F.lit("b"), (k % m).cast("string"))
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("run_group"), F.when(k % 4 != 0, b(3)).alias("fetched"), F.when(k % 5 != 0, b(2)).alias("adopted"))


@query("SELECT source, run_group, fetched, adopted, state FROM decided", SOURCES_SQL)
def baseline_decision(spark, sf_dir):
    return D.baseline_decision(sources(spark, sf_dir))


@query("SELECT run_group, CASE WHEN bool_or(state = 'rebaseline_pending') THEN 'rebaseline' ELSE 'incremental' END AS kind, coalesce(string_agg(CASE WHEN state = 'rebaseline_pending' THEN source || ':' || fetched END, ',' ORDER BY source), '') AS pending FROM decided GROUP BY run_group", SOURCES_SQL)
def group_run_kind(spark, sf_dir):
    return D.group_run_kind(D.baseline_decision(sources(spark, sf_dir)))


@query("""SELECT * FROM (VALUES ('settled', 'current', false, false, false), ('a failure', 'broken', true, false, false), ('unpublished', 'broken', false, false, false), ('pending baseline', 'stale', false, false, true),
  ('in flight', 'stale', false, true, false), ('never ran', 'stale', false, true, false), ('too old', 'stale', false, true, false)) t(scenario, overall, failed, behind, pending)""")  # fmt: skip
def producer_status(spark, sf_dir):
    """Each rule on a producer of two groups of which one breaks it."""
    day = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")
    ran = lambda *rows: spark.createDataFrame(rows, "run_group string, outcome string, ended_on int").select("run_group", "outcome", F.to_timestamp(F.concat(F.lit("2024-01-"), F.lpad(F.col("ended_on").cast("string"), 2, "0"))).alias("ended_at"))
    state = lambda x: spark.createDataFrame([("s", x)], "source string, state string")
    fine = ("a", "success", 9)
    cases = [("settled", ran(fine, ("b", "success", 9)), "current", True), ("a failure", ran(fine, ("b", "failure", 9)), "current", True), ("unpublished", ran(fine), "current", False), ("pending baseline", ran(fine), "rebaseline_pending", True), ("in flight", ran(fine, ("b", "running", None)), "current", True), ("never ran", ran(fine, ("b", None, None)), "current", True), ("too old", ran(fine, ("b", "success", 7)), "current", True)]
    out = [D.producer_status(r, state(s), published, day(10), 2 * 86_400).select(F.lit(name).alias("scenario"), "*") for name, r, s, published in cases]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


#: Packages over parts: five corpora, a rebaseline now and then, and corpus c3 misses some.
CATALOG_SQL = """catalog AS (SELECT corpus, 'p' || k AS package_id, CASE WHEN n = 0 THEN 'baseline' WHEN n % 37 = 0 THEN 'rebaseline' ELSE 'incremental' END AS package_kind, greatest(n - 1, 0) AS from_sequence, n AS to_sequence, n AS package_sequence
  FROM (SELECT p_partkey AS k, 'c' || (p_partkey % 5) AS corpus, p_partkey // 5 AS n FROM part) WHERE NOT (corpus = 'c3' AND n % 10 = 9))"""


def catalog(spark, sf_dir):
    k, n = F.col("p_partkey"), F.floor(F.col("p_partkey") / 5)
    c = read(spark, sf_dir, "part").select(F.concat(F.lit("c"), (k % 5).cast("string")).alias("corpus"), F.concat(F.lit("p"), k.cast("string")).alias("package_id"), F.when(n == 0, "baseline").when(n % 37 == 0, "rebaseline").otherwise("incremental").alias("package_kind"), F.greatest(n - 1, F.lit(0)).alias("from_sequence"), n.alias("to_sequence"), n.alias("package_sequence"))
    return c.filter("NOT (corpus = 'c3' AND to_sequence % 10 = 9)")


@query("SELECT corpus, package_id, package_kind, from_sequence, to_sequence, package_sequence FROM catalog QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY package_sequence DESC) = 1", CATALOG_SQL)
def catalog_latest(spark, sf_dir):
    return D.catalog_latest(catalog(spark, sf_dir))


@query("SELECT corpus, package_sequence, package_id, package_kind FROM catalog ORDER BY corpus, package_sequence", CATALOG_SQL)
def catalog_rows(spark, sf_dir):
    return catalog(spark, sf_dir).select("corpus", "package_sequence", "package_id", "package_kind").orderBy("corpus", "package_sequence")


@query("""WITH media AS (SELECT corpus, package_id AS media_id, to_sequence AS media_seq FROM catalog WHERE package_kind <> 'incremental' QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY to_sequence DESC) = 1),
  inc AS (SELECT c.* FROM catalog c JOIN media m ON m.corpus = c.corpus WHERE package_kind = 'incremental' AND to_sequence > media_seq QUALIFY row_number() OVER (PARTITION BY c.corpus ORDER BY to_sequence DESC) <= 12),
  g AS (SELECT corpus, max(to_sequence) AS top, min(from_sequence) AS low, count(*) AS n, bool_or(from_sequence <> prev) AS gap FROM (SELECT *, coalesce(lag(to_sequence) OVER (PARTITION BY corpus ORDER BY to_sequence), from_sequence) AS prev FROM inc) GROUP BY corpus)
  SELECT m.corpus, media_id, coalesce(top, media_seq) AS head, coalesce(low, media_seq) AS min_available, coalesce(n, 0) AS n_packages, CASE WHEN coalesce(low, media_seq) > 1 THEN coalesce(low, media_seq) - 1 END AS requires_baseline_to, coalesce(gap, false) AS gap FROM media m LEFT JOIN g ON g.corpus = m.corpus""", CATALOG_SQL)  # fmt: skip
def manifest_build(spark, sf_dir):
    return D.manifest_build(catalog(spark, sf_dir), 12)


@query("""SELECT user_id AS document_id, status, epoch_us(fetched) // 1000000 + ttl AS expires, epoch_us(fetched) // 1000000 + ttl <= epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000 AS expired FROM (
  SELECT *, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'not_found' WHEN 'error' THEN 'upstream_error' WHEN 'signup' THEN 'unsupported' ELSE 'invalid_offsets' END AS status, CASE event_type WHEN 'view' THEN 2592000 WHEN 'purchase' THEN 2592000 WHEN 'error' THEN 3600 ELSE 604800 END AS ttl, ts AS fetched FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""")  # fmt: skip
def zone_cache_read(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "view", "ok").when(kind == "click", "not_found").when(kind == "error", "upstream_error").when(kind == "signup", "unsupported").otherwise("invalid_offsets")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), status.alias("status"), F.col("ts").alias("fetched_at"))
    now = F.to_timestamp(F.lit("2024-01-20T00:00:00Z"))
    return D.zone_cache_read(rows, now).select("document_id", "status", F.unix_timestamp("expires_at").alias("expires"), "expired")


#: The catalog with what its packages cost and ask for, what each corpus publishes, and clients' positions.
FEEDS_SQL = """priced AS (SELECT c.*, 10 + p_size AS size, 2 * p_size AS unpacked, p_size % 5 AS seconds, p_size = 50 AS reissue, CASE WHEN p_size = 49 THEN 2 ELSE 1 END AS client, CASE WHEN p_size = 48 THEN 25 ELSE 24 END AS schema, CASE WHEN p_size = 47 THEN 'other' ELSE 'fp' END AS stamp FROM catalog c JOIN part ON package_id = 'p' || p_partkey),
  media AS (SELECT * FROM priced WHERE package_kind <> 'incremental' QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY to_sequence DESC) = 1),
  kept AS (SELECT p.* FROM priced p JOIN media m ON m.corpus = p.corpus WHERE p.package_kind = 'incremental' AND p.to_sequence > m.to_sequence QUALIFY row_number() OVER (PARTITION BY p.corpus ORDER BY p.to_sequence DESC) <= 30),
  feeds AS (SELECT m.corpus, coalesce(k.head, m.to_sequence) AS head, coalesce(k.low, m.to_sequence) AS min_available, m.package_id AS baseline_id, m.package_kind AS baseline_kind, m.to_sequence AS baseline_sequence, 20 * m.size AS base_size, 20 * m.unpacked AS base_unpacked, 40 AS load_seconds, m.client AS base_client, m.schema AS base_schema
    FROM media m LEFT JOIN (SELECT corpus, max(to_sequence) AS head, min(from_sequence) AS low FROM kept GROUP BY corpus) k ON k.corpus = m.corpus),
  cursors AS (SELECT c_custkey AS client_id, f.corpus, CASE WHEN c_custkey % 11 <> 0 THEN head + 1 - c_custkey % 37 END AS sequence, CASE WHEN c_custkey % 13 = 0 THEN 'older' ELSE 'fp' END AS stamp FROM customer JOIN feeds f ON f.corpus = 'c' || (c_custkey % 5))"""


def feeds(spark, sf_dir):
    """(increments, feeds, cursors) as in FEEDS_SQL."""
    k, z = F.col("p_partkey"), F.col("p_size")
    cost = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("package_id"), (10 + z).alias("size"), (2 * z).alias("unpacked"), (z % 5).alias("seconds"), (z == 50).alias("reissue"), F.when(z == 49, 2).otherwise(1).alias("client"), F.when(z == 48, 25).otherwise(24).alias("schema"), F.when(z == 47, "other").otherwise("fp").alias("stamp"))
    priced = catalog(spark, sf_dir).join(cost, "package_id")
    m = D.manifest_build(catalog(spark, sf_dir), 30).select("corpus", "head", "min_available", F.col("media_id").alias("package_id"))
    media = priced.drop("corpus").join(F.broadcast(m), "package_id")  # a row per corpus
    feed = media.select("corpus", "head", "min_available", F.col("package_id").alias("baseline_id"), F.col("package_kind").alias("baseline_kind"), F.col("to_sequence").alias("baseline_sequence"), (20 * F.col("size")).alias("base_size"), (20 * F.col("unpacked")).alias("base_unpacked"), F.lit(40).alias("load_seconds"), F.col("client").alias("base_client"), F.col("schema").alias("base_schema"))
    c = F.col("c_custkey")
    cursors = read(spark, sf_dir, "customer").select(c.alias("client_id"), F.concat(F.lit("c"), (c % 5).cast("string")).alias("corpus")).join(F.broadcast(feed.select("corpus", "head")), "corpus")
    k = F.col("client_id")
    cursors = cursors.select("client_id", "corpus", F.when(k % 11 != 0, F.col("head") + 1 - k % 37).alias("sequence"), F.when(k % 13 == 0, "older").otherwise("fp").alias("stamp"))
    return priced.filter("package_kind = 'incremental'"), feed, cursors


_LOAD = "CASE WHEN 1 < base_client THEN 'client_too_old' WHEN base_schema > 24 THEN 'schema_ahead' END"


@query(f"""WITH chain AS (SELECT c.client_id, count(*) AS packages, count(DISTINCT p.from_sequence) AS met, sum(p.size) AS size, sum(p.unpacked) AS unpacked, sum(p.seconds) AS seconds, bool_or(p.reissue OR p.stamp <> c.stamp) AS other, max(p.client) AS client, max(p.schema) AS schema
    FROM cursors c JOIN feeds f ON f.corpus = c.corpus JOIN priced p ON p.corpus = c.corpus AND p.package_kind = 'incremental' AND p.from_sequence >= c.sequence AND p.to_sequence <= f.head AND p.to_sequence = p.from_sequence + 1 GROUP BY c.client_id),
  r AS (SELECT c.client_id, c.corpus, c.sequence, f.*, h.packages, CASE WHEN baseline_sequence > head THEN 'wrong' WHEN c.sequence IS NULL THEN 'load' WHEN c.sequence = head THEN 'up_to_date' WHEN c.sequence > head THEN 'wrong' WHEN c.sequence < min_available OR h.packages IS NULL OR h.packages <> head - c.sequence OR met <> h.packages THEN 'reload'
      WHEN h.client > 1 THEN 'old' WHEN h.schema > 24 THEN 'newer' WHEN other OR h.packages > 25 OR CASE WHEN base_size = 0 THEN h.size > 0 ELSE 1000 * h.size > 800 * base_size END OR CASE WHEN base_unpacked = 0 THEN h.unpacked > 0 ELSE 1000 * h.unpacked > 800 * base_unpacked END OR h.seconds > least(3600, load_seconds) THEN 'reload' ELSE 'incremental' END AS route
    FROM cursors c JOIN feeds f ON f.corpus = c.corpus LEFT JOIN chain h ON h.client_id = c.client_id),
  d AS (SELECT *, CASE route WHEN 'wrong' THEN 'wrong_generation' WHEN 'old' THEN 'client_too_old' WHEN 'load' THEN {_LOAD} WHEN 'reload' THEN CASE WHEN baseline_kind = 'rebaseline' AND baseline_sequence > sequence THEN {_LOAD} ELSE 'baseline_required' END
      WHEN 'newer' THEN CASE WHEN baseline_kind = 'rebaseline' AND baseline_sequence > sequence AND ({_LOAD}) IS NULL THEN NULL ELSE 'schema_ahead' END END AS code FROM r)
  SELECT client_id, corpus, CASE WHEN code IS NOT NULL THEN 'blocked' WHEN route IN ('up_to_date', 'incremental') THEN route ELSE 'fresh_baseline' END AS plan, CASE WHEN code IS NULL AND route = 'incremental' THEN packages ELSE 0 END AS packages, CASE WHEN code IS NULL AND route NOT IN ('up_to_date', 'incremental') THEN baseline_id END AS baseline_id, code FROM d""", CATALOG_SQL, FEEDS_SQL)  # fmt: skip
def plan_catchup(spark, sf_dir):
    """The plan of every client of a published catalog, chains by pointer doubling."""
    return D.plan_catchups(*feeds(spark, sf_dir), D.Policy(max_packages=25))


@query(f"SELECT code, count(*) AS n FROM ({ORACLES['plan_catchup']}) WHERE code IS NOT NULL GROUP BY code")
def reject_codes(spark, sf_dir):
    """The codes with which clients are stopped; all of the closed vocabulary."""
    known = [c.value for c in D.Reject]
    told = F.when(F.col("code").isin(known), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("no such code: "), F.col("code"))).cast("string"))
    return plan_catchup(spark, sf_dir).filter("code IS NOT NULL").groupBy(told.alias("code")).agg(F.count("*").alias("n"))


# --- feeds, gates, generations -----------------------------------------------------------------

def outcome(f, *args) -> str:
    try:
        return f(*args) or "ok"
    except D.Rejected as e:
        return e.code.value


@query("""SELECT * FROM (VALUES ('schema_gate', '24,24,24', 'equal'), ('schema_gate', '24,23,24', 'additive_ahead'), ('schema_gate', '24,25,24', 'schema_ahead'), ('schema_gate', '25,24,24', 'client_too_old'), ('schema_gate', '23,24,24', 'baseline_required'),
  ('compat_check', 'same', 'ok'), ('compat_check', 'fingerprint', 'embedding_fingerprint_mismatch'), ('compat_check', 'builder', 'builder_version_mismatch'), ('compat_check', 'absent builder', 'builder_version_mismatch'),
  ('media_idempotency', 'absent', 'apply'), ('media_idempotency', 'same', 'noop'), ('media_idempotency', 'other digest', 'digest_mismatch'), ('media_idempotency', 'ahead', 'wrong_generation'), ('media_idempotency', 'behind', 'baseline_required'), ('media_idempotency', 'behind, rebaseline', 'apply'),
  ('activation_guard', 'first, absent', 'ok'), ('activation_guard', 'first, installed', 'baseline_required'), ('activation_guard', 'exact', 'ok'), ('activation_guard', 'not exact', 'wrong_generation'), ('activation_guard', 'forward', 'ok'), ('activation_guard', 'not forward', 'wrong_generation')) t(gate, given, outcome)""")  # fmt: skip
def apply_gates(spark, sf_dir):
    s, b = D.Stamps(24, "f", (("chunks", "1"),)), D.Stamps
    now = D.State(5, "p5", "d5", 1, "base", s)
    cases = [("schema_gate", ",".join(map(str, x)), D.schema_gate, x) for x in ((24, 24, 24), (24, 23, 24), (24, 25, 24), (25, 24, 24), (23, 24, 24))]
    cases += [("compat_check", n, D.compat_check, (x, s)) for n, x in (("same", s), ("fingerprint", b(24, "g")), ("builder", b(24, "f", (("chunks", "2"),))), ("absent builder", b(24, "f", (("zones", "1"),))))]
    cases += [("media_idempotency", n, D.media_idempotency, x) for n, x in (("absent", (None, 5, "p5", "d5", False)), ("same", (now, 5, "p5", "d5", False)), ("other digest", (now, 5, "p5", "x", False)), ("ahead", (now, 4, "p4", "d4", True)), ("behind", (now, 6, "p6", "d6", False)), ("behind, rebaseline", (now, 6, "p6", "d6", True)))]
    cases += [("activation_guard", n, D.activation_guard, x) for n, x in (("first, absent", (None, "first")), ("first, installed", (now, "first")), ("exact", (now, "exact", 5)), ("not exact", (now, "exact", 4)), ("forward", (now, "forward", 6)), ("not forward", (now, "forward", 5)))]
    return spark.createDataFrame([(g, n, outcome(f, *x)) for g, n, f, x in cases], "gate string, given string, outcome string")


@query("SELECT relation, row_number() OVER (ORDER BY position) - 1 AS nth, n FROM (SELECT relation, count(*) AS n FROM changes GROUP BY relation) JOIN (SELECT unnest(['documents', 'chunks', 'chunk_embeddings', 'graph_edges', 'zone_units', 'zone_unit_embeddings', 'decision_zones', 'citations', 'citation_resolutions', 'metadata_roots']) AS relation, unnest(range(0, 10)) AS position) USING (relation)", CHANGES_SQL)
def apply_order(spark, sf_dir):
    """The relations that a log changes, in the order in which they are applied."""
    g = changes(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, D.APPLY_ORDER)), F.col("relation"))
    return g.select("relation", (F.row_number().over(W.orderBy(at)) - 1).cast("bigint").alias("nth"), "n")  # ten relations at most


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 = 0) AS m FROM documents)
  SELECT * FROM (SELECT 'no baseline' AS step, 'baseline_required' AS outcome, CAST(NULL AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS n FROM n UNION ALL SELECT 'baseline', 'applied', 1, n FROM n UNION ALL SELECT 'baseline again', 'noop', 1, n FROM n UNION ALL SELECT 'gap', 'sequence_gap', 1, n FROM n
  UNION ALL SELECT 'other chain', 'wrong_generation', 1, n FROM n UNION ALL SELECT 'wrong digest', 'digest_mismatch', 1, n FROM n UNION ALL SELECT 'increment', 'applied', 2, n + m FROM n UNION ALL SELECT 'increment again', 'noop', 2, n + m FROM n UNION ALL SELECT 'rebaseline', 'applied', 9, n FROM n)""")  # fmt: skip
def apply_incremental(spark, sf_dir):
    """A corpus's life: refusals move nothing, what is applied twice moves once."""
    g = D.Generations(spark, storage.place(spark, "generations", sf_dir, uuid.uuid4().hex))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    more = d.filter("id % 10 = 0").select((F.col("id") + 100000000).alias("id"), F.lit("added").alias("source"))
    whole, delta = {"documents": Table(d, ["id"])}, {"documents": Delta(more)}
    r = merkle.table_digest(d.unionByName(more), ["id"], d.columns).first()
    step = lambda **x: D.Package(**{"package_id": "p2", "digest": "d2", "from_sequence": 1, "to_sequence": 2, "previous_id": "b1", "expected": {"documents": (r.n, r.digest)}, **x})
    base, again = D.Baseline("b1", "baseline", 1), D.Baseline("b9", "rebaseline", 9)
    rows = []

    def take(name, f, *args):
        what = outcome(f, *args)
        now = g.state()
        rows.append((name, what, now and now.sequence, g.read("documents").count() if now else 0))

    take("no baseline", g.apply, step(), delta)
    take("baseline", g.load, base, "d1", whole)
    take("baseline again", g.load, base, "d1", whole)
    take("gap", g.apply, step(from_sequence=4, to_sequence=5), delta)
    take("other chain", g.apply, step(previous_id="b0"), delta)
    take("wrong digest", g.apply, step(expected={"documents": (r.n, "x")}), delta)
    take("increment", g.apply, step(), delta)
    take("increment again", g.apply, step(), delta)
    take("rebaseline", g.load, again, "d9", whole)
    return spark.createDataFrame(rows, "step string, outcome string, sequence long, n long")


@query("SELECT 'before' AS version, doc_id AS id, source FROM documents UNION ALL SELECT 'active', doc_id, CASE WHEN doc_id % 50 = 0 THEN 'changed' ELSE source END FROM documents WHERE doc_id % 50 <> 1")
def activate_generation(spark, sf_dir):
    """A reader keeps the version that it opened, while the next one, applied and compacted, is active."""
    g = D.Generations(spark, storage.place(spark, "generations", sf_dir, uuid.uuid4().hex))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    g.load(D.Baseline("b1", "baseline", 1), "d1", {"documents": Table(d, ["id"])})
    opened, at = g.read("documents"), g.store.version()
    g.apply(D.Package("p2", "d2", 1, 2), {"documents": Delta(d.filter("id % 50 = 0").withColumn("source", F.lit("changed")), d.filter("id % 50 = 1").select("id"))})
    g.store.settle(g.store.prepare("documents", "base"))
    assert g.store.version() == at + 2
    return opened.select(F.lit("before").alias("version"), "*").unionByName(g.read("documents").select(F.lit("active").alias("version"), "*"))


#: Increments over the documents, as a chain of segments: what changes, what goes.
LIFE_SQL = """life AS (SELECT doc_id AS id, doc_id % 100 AS k, doc_id % 200 = 1 AS back, doc_id % 3 = 0 AS large, source FROM documents),
  ended AS (SELECT id, CASE WHEN large THEN 'large' WHEN k = 0 THEN 'again' WHEN back THEN 'back' ELSE source END AS source FROM life WHERE k <> 1 OR back OR large UNION ALL SELECT id + 100000000, 'new' FROM life WHERE k = 2)"""


_LIVES: dict[tuple[str, str], tuple[Store, list]] = {}


def life(spark, sf_dir):
    """(store, steps): the steps with the rows they wrote, the rows visible and the table's segments after
    them; gone through once a session and input."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _LIVES:
        _LIVES[at] = live(spark, sf_dir)
    return _LIVES[at]


def live(spark, sf_dir):
    s = Store(spark, storage.place(spark, "segments", sf_dir, uuid.uuid4().hex))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    named = lambda rows, x: rows.withColumn("source", F.lit(x))
    steps = []

    def tell(step: str) -> None:
        segments = s.manifest()["tables"]["documents"]["segments"]
        steps.append((step, segments[0 if step in ("create", "compact to base") else -1]["rows"], s.read("documents").count(), len(segments)))

    s.create({"documents": Table(d, ["id"])})
    tell("create")
    changes = [("upsert", Delta(named(d.filter("id % 100 = 0"), "first"))), ("delete", Delta(d.limit(0), d.filter("id % 100 = 1").select("id"))), ("upsert and insert", Delta(named(d.filter("id % 100 = 0"), "again").unionByName(named(d.filter("id % 100 = 2").withColumn("id", F.col("id") + 100000000), "new")))), ("insert deleted", Delta(named(d.filter("id % 200 = 1"), "back")))]
    for name, delta in changes:
        s.apply({"documents": delta})
        tell(name)
    tell(f"compact to {s.compact('documents')}")
    s.apply({"documents": Delta(named(d.filter("id % 3 = 0"), "large"))})
    tell("large upsert")
    tell(f"compact to {s.compact('documents')}")
    return s, steps


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (back) AS nb, count(*) FILTER (large) AS nl, count(*) FILTER (k = 1 AND NOT back AND large) AS again FROM life)
  SELECT unnest(['create', 'upsert', 'delete', 'upsert and insert', 'insert deleted', 'compact to deltas', 'large upsert', 'compact to base']) AS step, unnest([n, n0, n1, n0 + n2, nb, n0 + n1 + n2, nl, n - n1 + n2 + nb + again]) AS written,
    unnest([n, n, n - n1, n - n1 + n2, n - n1 + n2 + nb, n - n1 + n2 + nb, n - n1 + n2 + nb + again, n - n1 + n2 + nb + again]) AS visible, unnest(CAST([1, 2, 3, 4, 5, 2, 3, 1] AS BIGINT[])) AS segments FROM n""", LIFE_SQL)  # fmt: skip
def segment_writes(spark, sf_dir):
    """An increment writes its own rows; so does a compaction of deltas; only a large one rewrites the base."""
    return spark.createDataFrame(life(spark, sf_dir)[1], "step string, written long, visible long, segments long")


@query("SELECT id, source FROM ended", LIFE_SQL)
def segment_merge(spark, sf_dir):
    return life(spark, sf_dir)[0].read("documents")


@query(f"WITH x AS {merkle_sql('ended', 'id', 'id, source')} SELECT n, digest FROM x", LIFE_SQL)
def digest_after_apply(spark, sf_dir):
    """The root of leaves that deltas updated equals the one from scratch."""
    s = life(spark, sf_dir)[0]
    return merkle.root(s.leaves("documents"), merkle.DEPTH)


@query(f"SELECT DISTINCT substr(md5(CAST(doc_id AS VARCHAR)), 1, {merkle.DEPTH}) AS node FROM documents WHERE doc_id % 97 = 3")
def digest_locate(spark, sf_dir):
    """The leaves in which two copies of a table differ, found from the root down over stored trees."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    other = d.withColumn("text", F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    stored = []
    for rows in (d, other):
        path = storage.place(spark, "tree", sf_dir, uuid.uuid4().hex)
        leaf = merkle.leaves(rows.withColumn("_hash", merkle.row_hash(rows.columns)), ["doc_id"], merkle.DEPTH)
        merkle.tree(leaf, merkle.DEPTH).repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(path)
        stored.append(spark.read.parquet(path))
    return merkle.differing(*stored, merkle.DEPTH)[-1]


# --- streams -----------------------------------------------------------------------------------


@query("SELECT user_id AS scope, max(event_id) AS last_seq, bool_or(event_type = 'purchase') AS replaced, count(*) AS n FROM events GROUP BY user_id")
def changelog_stream(spark, sf_dir):
    """The batch twin's result, by a bounded run of the stream into a table with a ledger."""
    from ..streaming.changelog import coalesce_stream_once

    return coalesce_stream_once(spark, f"{sf_dir}/events.parquet")


#: The log's lanes: each has its own sequence; a quarter of it is a block.
LANES_SQL = """lanes AS (SELECT event_id % 16 AS corpus, event_id // 16 AS change_seq, ts, user_id AS scope, event_type, 4 * (event_id // 16) // (1 + (SELECT max(event_id) // 16 FROM events)) AS block FROM events)"""


def lanes(spark, sf_dir):
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    seq = F.floor(k / 16).cast("bigint")
    top = e.agg(F.max(seq)).first()[0] or 0
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "replace_set").otherwise("upsert")
    return e.select((k % 16).cast("string").alias("corpus"), seq.alias("change_seq"), "ts", F.col("user_id").alias("scope"), op.alias("op"), F.floor(4 * seq / (top + 1)).alias("block"))


@query("SELECT corpus::BIGINT AS corpus, change_seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'replace_set' ELSE 'upsert' END AS op, scope, CAST(CASE WHEN block = 0 THEN 1 ELSE 2 END AS BIGINT) AS released FROM lanes", LANES_SQL)
def ordered_stream(spark, sf_dir):
    """The log's quarters come third, first (twice), fourth and second, in files of their own, with a restart between:
    what is released, and by which of the releasing batches."""
    from ..streaming import changelog as C

    root = storage.place(spark, "ordered", sf_dir, uuid.uuid4().hex)
    rows = lanes(spark, sf_dir)
    keep = lambda batch, k: batch.select("*", F.lit(k).alias("batch")).write.mode("overwrite").parquet(f"{root}/out/{k}")
    for part in ([[2], [0]], [[3, 0], [1]]):
        for blocks in part:
            rows.filter(F.col("block").isin(blocks)).drop("block").coalesce(1).write.mode("append").parquet(f"{root}/in")
        s = spark.readStream.schema("corpus string, change_seq long, ts timestamp, scope long, op string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        C.run_available(C.in_order(s), keep, root)
    out = spark.read.parquet(f"{root}/out/*")
    nth = out.select("batch").distinct().select("batch", F.rank().over(W.orderBy("batch")).cast("bigint").alias("released"))  # as many rows as batches
    return out.join(F.broadcast(nth), "batch").select(F.col("corpus").cast("bigint").alias("corpus"), "change_seq", "op", "scope", "released")


@query("""WITH RECURSIVE looked AS (SELECT DISTINCT user_id AS document_id, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'not_found' WHEN 'error' THEN 'upstream_error' WHEN 'signup' THEN 'unsupported' ELSE 'invalid_offsets' END AS status, epoch_us(ts) // 1000 AS ms FROM events),
  timed AS (SELECT *, CASE status WHEN 'ok' THEN 2592000000 WHEN 'invalid_offsets' THEN 2592000000 WHEN 'upstream_error' THEN 3600000 ELSE 604800000 END AS ttl FROM looked),
  passed AS (SELECT document_id, status, min(ms) AS ms, ttl FROM timed GROUP BY ALL UNION ALL SELECT p.document_id, p.status, min(t.ms), p.ttl FROM passed p JOIN timed t ON t.document_id = p.document_id AND t.status = p.status AND t.ms >= p.ms + p.ttl GROUP BY p.document_id, p.status, p.ms, p.ttl)
  SELECT document_id, status, ms FROM passed""")  # fmt: skip
def ttl_stream(spark, sf_dir):
    """Look-ups as a stream: those that no living cache row answers."""
    from ..streaming import changelog as C

    root = storage.place(spark, "ttl", sf_dir, uuid.uuid4().hex)
    kind = F.col("event_type")
    status = F.when(kind == "view", "ok").when(kind == "click", "not_found").when(kind == "error", "upstream_error").when(kind == "signup", "unsupported").otherwise("invalid_offsets")
    read(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), status.alias("status"), F.date_trunc("millisecond", "ts").alias("fetched_at")).write.parquet(f"{root}/in")
    s = spark.readStream.schema("document_id long, status string, fetched_at timestamp").parquet(f"{root}/in")
    C.run_available(C.while_cached(s), lambda batch, k: batch.write.mode("overwrite").parquet(f"{root}/out/{k}"), root)
    return spark.read.parquet(f"{root}/out/*").select("document_id", "status", F.unix_millis("fetched_at").alias("ms"))
