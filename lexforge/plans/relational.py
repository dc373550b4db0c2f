"""Queries over graph, versions, hierarchy, references, coverage and accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import CHUNKS_SQL, DOCS_SQL, EDGES_SQL, VERSIONS_SQL, chunks, docs, edges, read, versions
from ..operators import merkle
from ..operators import relations as X
from ..operators.retrieval import asof
from .cite import LEGAL_SQL, legal
from .registry import merkle_sql, query

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
n = lambda: F.count("*")


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(n().alias("n"))


@query("SELECT document_id, kind, source FROM docs WHERE (valid_from IS NULL OR valid_from <= DATE '2008-06-01') AND (valid_to IS NULL OR valid_to > DATE '2008-06-01')", DOCS_SQL)
def asof_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(asof("2008-06-01")).select("document_id", "kind", "source")


@query("SELECT document_id FROM docs WHERE kind = 'decision'", DOCS_SQL)
def kind_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter("kind = 'decision'").select("document_id")


@query("SELECT document_id, source, lang FROM docs WHERE kind = 'decision' AND source ILIKE '%RC1%' AND lang ILIKE '%R%' AND lower(CASE WHEN document_id % 3 = 0 THEN 'OUI' ELSE 'non' END) = 'oui' AND valid_from BETWEEN DATE '2000-01-01' AND DATE '2012-12-31'", DOCS_SQL)
def decision_filters(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("canonical_json", F.to_json(F.struct(F.col("source").alias("jurisdiction"), F.col("lang").alias("formation"), F.when(F.col("document_id") % 3 == 0, "OUI").otherwise("non").alias("publication"))))
    return d.filter(X.decision_filters("RC1", "R", "Oui", "2000-01-01", "2012-12-31")).select("document_id", "source", "lang")


@query("SELECT document_id FROM docs WHERE contains(body, '%')", DOCS_SQL)
def like_escape(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.contains("body", F.lit("%"))).select("document_id")


@query(
    "SELECT from_id FROM edges GROUP BY from_id HAVING bool_or(tag = 'R' AND status = 'F') AND bool_or(tag = 'N' AND status = 'O')", EDGES_SQL
)
def jsonb_contains(spark, sf_dir):
    """Each listed object matches some element of the attribute array."""
    a = edges(spark, sf_dir).groupBy("from_id").agg(F.collect_set(F.struct("tag", "status")).alias("attrs"))
    has = lambda t, s: F.exists("attrs", lambda x: (x["tag"] == t) & (x["status"] == s))
    return a.filter(has("R", "F") & has("N", "O")).select("from_id")


@query("SELECT DISTINCT p_partkey AS target_id, p_name AS name FROM part JOIN edges ON to_id = p_partkey WHERE from_id = 7 AND tag = 'R' AND to_id <> 7 ORDER BY target_id LIMIT 20", EDGES_SQL)
def cites(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("name"))
    return X.cites(edges(spark, sf_dir), parts, 7, 20)


@query("SELECT DISTINCT from_id FROM edges WHERE to_id = 42 AND from_id <> 42 ORDER BY from_id LIMIT 20", EDGES_SQL)
def cited_by(spark, sf_dir):
    return X.cited_by(edges(spark, sf_dir), 42, 20)


@query("SELECT to_id AS document_id, valid_from, rank FROM (SELECT *, row_number() OVER (ORDER BY valid_from, to_id) - 1 AS rank FROM (SELECT DISTINCT to_id, valid_from FROM edges JOIN versions ON version_id = to_id WHERE from_id < 400 AND tag = 'A' AND to_id <> from_id)) WHERE rank < 25", EDGES_SQL, VERSIONS_SQL)
def temporal(spark, sf_dir):
    """Version edges, by when the versions start; of some seeds at once."""
    v, e = versions(spark, sf_dir), edges(spark, sf_dir)
    one = e.filter("from_id < 400 AND to_id <> from_id").withColumn("from_id", F.lit(-1).cast("bigint"))
    top = X.temporal(one, v, -1).orderBy("valid_from", "document_id").limit(25)
    return top.withColumn("rank", F.row_number().over(W.orderBy("valid_from", "document_id")).cast("bigint") - 1)  # after the limit


@query("SELECT DISTINCT from_id, valid_from FROM edges JOIN versions ON version_id = from_id WHERE to_id = 42 AND status = 'F' ORDER BY valid_from DESC NULLS LAST, from_id LIMIT 15", EDGES_SQL, VERSIONS_SQL)
def interpreted_by(spark, sf_dir):
    e = edges(spark, sf_dir).filter("to_id = 42 AND status = 'F'").select("from_id").distinct()
    v = versions(spark, sf_dir)
    return e.join(v, e["from_id"] == v["version_id"]).select("from_id", "valid_from").orderBy(F.desc_nulls_last("valid_from"), "from_id").limit(15)


@query("SELECT document_id, position, (SELECT count(DISTINCT from_id) >= 25 FROM edges WHERE to_id < 5) AS possibly_truncated FROM (SELECT from_id AS document_id, min(position) AS position FROM edges WHERE to_id < 5 GROUP BY from_id ORDER BY position, from_id LIMIT 25) ORDER BY document_id", EDGES_SQL)
def related_order(spark, sf_dir):
    """Limited in the relation's own order, then given by id."""
    e = edges(spark, sf_dir).filter("to_id < 5").groupBy(F.col("from_id").alias("document_id")).agg(F.min("position").alias("position"))
    return X.related_page(e, [F.asc("position"), F.asc("document_id")], 25)


@query("SELECT chunk_id, c.document_id, kind FROM chunks c JOIN docs d ON d.document_id = c.document_id", DOCS_SQL, CHUNKS_SQL)
def join_chunk_doc(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "document_id").join(docs(spark, sf_dir).select("document_id", "kind"), "document_id").select("chunk_id", "document_id", "kind")


@query("SELECT family, version_id, valid_from, version_id = 100 AS is_target FROM versions WHERE family = (SELECT family FROM versions WHERE version_id = 100)", VERSIONS_SQL)
def version_family(spark, sf_dir):
    return X.version_family(versions(spark, sf_dir), 100)


@query("SELECT family, version_id, valid_from, amount FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY valid_from DESC, version_id) AS k FROM versions WHERE valid_from <= DATE '1996-06-01' AND (valid_to IS NULL OR valid_to > DATE '1996-06-01')) WHERE k = 1", VERSIONS_SQL)
def asof_version(spark, sf_dir):
    return X.pick_asof(versions(spark, sf_dir), "1996-06-01")


@query(
    """WITH a AS (SELECT family, arg_max(version_id, (valid_from, -version_id)) AS v FROM versions WHERE valid_from <= DATE '1995-01-01' AND (valid_to IS NULL OR valid_to > DATE '1995-01-01') GROUP BY family),
    b AS (SELECT family, arg_max(version_id, (valid_from, -version_id)) AS v FROM versions WHERE valid_from <= DATE '1997-01-01' AND (valid_to IS NULL OR valid_to > DATE '1997-01-01') GROUP BY family)
    SELECT f.family, a.v AS before_id, b.v AS after_id, a.v IS DISTINCT FROM b.v AS changed FROM (SELECT DISTINCT family FROM versions) f LEFT JOIN a USING (family) LEFT JOIN b USING (family)""",
    VERSIONS_SQL,
)
def diff(spark, sf_dir):
    return X.diff(versions(spark, sf_dir), "1995-01-01", "1997-01-01")


@query(
    """WITH refs AS (SELECT c_custkey AS ref_id, c_custkey AS family, DATE '1993-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS on_date FROM customer)
    SELECT ref_id, (SELECT arg_max(version_id, (valid_from, -version_id)) FROM versions v WHERE v.family = refs.family AND v.valid_from <= on_date AND (v.valid_to IS NULL OR v.valid_to > on_date)) AS version_id FROM refs""",
    VERSIONS_SQL,
)
def resolve_logical(spark, sf_dir):
    refs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_custkey").alias("family"), F.date_add(F.lit("1993-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int")).alias("on_date"))
    return X.resolve_logical(refs, versions(spark, sf_dir))


REFS_SQL = """refs AS (SELECT doc_id AS ref_id, CASE doc_id % 10 WHEN 0 THEN 'document_version' WHEN 1 THEN 'decision' WHEN 2 THEN 'logical_article' WHEN 3 THEN 'decision' WHEN 4 THEN 'chunk' WHEN 5 THEN 'zone_unit' WHEN 6 THEN 'logical_article' WHEN 7 THEN 'document_version' WHEN 8 THEN 'logical_article' ELSE 'unknown' END AS target_kind,
    CASE WHEN doc_id % 10 IN (0, 5) THEN document_id WHEN doc_id % 10 = 1 THEN CASE WHEN doc_id % 20 = 1 THEN document_id ELSE 'cass:none' END END AS pin, CASE WHEN doc_id % 10 = 3 THEN source END AS ref_source, CASE WHEN doc_id % 10 IN (3, 4, 6, 8) THEN uid END AS ref_uid, CASE WHEN doc_id % 10 = 2 THEN 'g' || uid END AS ref_group,
    CASE WHEN doc_id % 10 IN (2, 4, 6) THEN DATE '2008-06-01' END AS as_of, CASE WHEN doc_id % 10 = 2 THEN document_id END AS prior FROM legal)"""


@query("""WITH grouped AS (SELECT *, 'g' || uid AS grp, kind = 'article' AS art FROM legal), live AS (SELECT * FROM grouped WHERE (valid_from IS NULL OR valid_from <= DATE '2008-06-01') AND (valid_to IS NULL OR valid_to > DATE '2008-06-01')),
  how AS (SELECT *, CASE WHEN pin IS NOT NULL AND target_kind IN ('document_version', 'decision', 'chunk', 'zone_unit') THEN 'pin' WHEN target_kind = 'decision' AND ref_source IS NOT NULL AND ref_uid IS NOT NULL THEN 'repair' WHEN target_kind IN ('logical_article', 'chunk', 'zone_unit') AND as_of IS NOT NULL AND (ref_group IS NOT NULL OR ref_uid IS NOT NULL) THEN 'logical' ELSE 'invalid' END AS how FROM refs),
  r AS (SELECT ref_id, how, prior, CASE how WHEN 'pin' THEN (SELECT document_id FROM grouped g WHERE g.document_id = pin) WHEN 'repair' THEN (SELECT arg_min(document_id, (valid_from IS NULL, -epoch(valid_from), document_id)) FROM grouped g WHERE g.source = ref_source AND g.uid = ref_uid)
    WHEN 'logical' THEN (SELECT arg_min(document_id, (valid_from IS NULL, -epoch(valid_from), document_id)) FROM live g WHERE CASE WHEN ref_group IS NOT NULL THEN g.grp = ref_group ELSE g.uid = ref_uid END) END AS resolved_id FROM how)
  SELECT ref_id, resolved_id, CASE WHEN how = 'invalid' THEN 'invalid' WHEN resolved_id IS NULL THEN 'missing' WHEN how = 'logical' AND prior IS NOT NULL AND prior <> resolved_id THEN 'changed' ELSE 'resolved' END AS status FROM r""", LEGAL_SQL, REFS_SQL)  # fmt: skip
def validate_refs(spark, sf_dir):
    """Pins, repairs and logical references of every kind, and such as lack their keys."""
    d = legal(spark, sf_dir).withColumn("version_group", F.concat(F.lit("g"), "source_uid"))
    k, none = F.col("ref_id"), F.lit(None).cast("string")
    r = legal(spark, sf_dir, "ref_id")
    m = k % 10
    kinds = F.element_at(F.array(*map(F.lit, ("document_version", "decision", "logical_article", "decision", "chunk", "zone_unit", "logical_article", "document_version", "logical_article", "unknown"))), (m + 1).cast("int"))
    pin = F.when(m.isin(0, 5), F.col("document_id")).when(m == 1, F.when(k % 20 == 1, F.col("document_id")).otherwise("cass:none"))
    refs = r.select("ref_id", kinds.alias("target_kind"), pin.alias("document_id"), F.when(m == 3, F.col("source")).alias("source"), F.when(m.isin(3, 4, 6, 8), F.col("source_uid")).alias("source_uid"), F.when(m == 2, F.concat(F.lit("g"), "source_uid")).otherwise(none).alias("version_group"), F.when(m.isin(2, 4, 6), F.lit("2008-06-01").cast("date")).alias("as_of"), F.when(m == 2, F.col("document_id")).alias("prior_id"))
    return X.validate_refs(refs, d)


CUSTOMERS_SQL = "nodes AS (SELECT c_custkey AS node_id, c_name AS name, r_name || '/' || n_name || '/' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def nodes(spark, sf_dir) -> DataFrame:
    c, na, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(na), c["c_nationkey"] == na["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return j.select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"))


@query("SELECT node_id, name, count(*) OVER () AS n_siblings FROM nodes WHERE path = (SELECT path FROM nodes WHERE node_id = 5) AND node_id <> 5 ORDER BY name, node_id LIMIT 50", CUSTOMERS_SQL)
def context_siblings(spark, sf_dir):
    return X.siblings(nodes(spark, sf_dir), 5, 50)


CONTEXT_SQL = """placed AS (SELECT *, CASE WHEN document_id % 10 = 9 THEN [] ELSE [kind, lang] END AS path FROM docs),
asked AS (SELECT * FROM (VALUES ('dated', 64, DATE '2008-06-01'), ('undated', 30, NULL), ('out of force', 33, DATE '2020-01-01'), ('no path', 79, DATE '2008-06-01')) t(ask, target, day)),
t AS (SELECT a.ask, p.*, coalesce(a.day, p.valid_from) AS at FROM asked a JOIN placed p ON p.document_id = a.target WHERE a.day IS NULL OR ((p.valid_from IS NULL OR p.valid_from <= a.day) AND (p.valid_to IS NULL OR p.valid_to > a.day))),
sib AS (SELECT t.ask, d.document_id, d.title FROM t JOIN placed d ON d.source = t.source AND d.kind = t.kind AND d.path = t.path AND len(t.path) > 0 AND d.document_id <> t.document_id AND (d.valid_from IS NULL OR d.valid_from <= t.at) AND (d.valid_to IS NULL OR d.valid_to > t.at)),
rows_ AS (SELECT ask, 'target' AS part, CAST(0 AS BIGINT) AS position, document_id, title FROM t UNION ALL SELECT ask, 'ancestor', unnest(range(0, len(path))), NULL, unnest(path) FROM t UNION ALL SELECT * FROM (SELECT ask, 'sibling', row_number() OVER (PARTITION BY ask ORDER BY title, document_id) - 1 AS n, document_id, title FROM sib) WHERE n < 3)"""


@query("SELECT r.ask, part, position, document_id, title, coalesce(n, 0) AS sibling_count, coalesce(n, 0) > 3 AS truncated FROM rows_ r LEFT JOIN (SELECT ask, count(*) AS n FROM sib GROUP BY ask) c ON c.ask = r.ask", DOCS_SQL, CONTEXT_SQL)
def context(spark, sf_dir):
    """A target's place: itself, its ancestry, its siblings in force; a target out of force has none."""
    k = F.col("document_id")
    d = docs(spark, sf_dir).withColumn("path", F.when(k % 10 == 9, F.array().cast("array<string>")).otherwise(F.array("kind", "lang")))
    asks = [("dated", 64, "2008-06-01"), ("undated", 30, None), ("out of force", 33, "2020-01-01"), ("no path", 79, "2008-06-01")]
    return reduce(DataFrame.unionByName, (X.context(d, target, day, 3).select(F.lit(ask).alias("ask"), "*") for ask, target, day in asks))


@query("SELECT d.document_id, ordinal, title, (SELECT string_agg(chunk_id, ',' ORDER BY chunk_index) FROM chunks c WHERE c.document_id = d.document_id) AS chunks FROM (SELECT unnest([5, 3, 5, 999999999, 8]) AS document_id, unnest(range(0, 5)) AS ordinal) r JOIN docs d ON d.document_id = r.document_id", DOCS_SQL, CHUNKS_SQL)
def fetch_ordered(spark, sf_dir):
    f = X.fetch_ordered(docs(spark, sf_dir).select("document_id", "title"), [5, 3, 5, 999999999, 8], chunks(spark, sf_dir).select("document_id", "chunk_index", "chunk_id"))
    return f.withColumn("chunks", F.array_join("chunks", ","))


@query("SELECT d.document_id, arg_min(chunk_id, chunk_index) AS chunk_id FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id WHERE kind = 'article' GROUP BY d.document_id", DOCS_SQL, CHUNKS_SQL)
def first_chunk_lateral(spark, sf_dir):
    first = chunks(spark, sf_dir).groupBy("document_id").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
    return docs(spark, sf_dir).filter("kind = 'article'").select("document_id").join(first, "document_id", "left")


TURNS_SQL = "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER w AS section, count(CASE WHEN role = 'user' THEN 1 END) OVER w AS n_before, list(CASE WHEN role = 'user' THEN turn END) OVER w AS ls, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def turn_links(spark, sf_dir):
    return X.nearest_preceding(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user")


@query(f"SELECT conv_id, turn, section FROM ({TURNS_SQL}) WHERE role <> 'user'")
def nearest_preceding_section(spark, sf_dir):
    return turn_links(spark, sf_dir).select("conv_id", "turn", "section")


@query(f"SELECT conv_id, turn, n_before, coalesce(array_to_string(list_filter(ls, lambda x: x IS NOT NULL), ','), '') AS sections FROM ({TURNS_SQL}) WHERE role <> 'user'")
def preceding_sections_agg(spark, sf_dir):
    c = X.preceding_sections(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user")
    return c.select("conv_id", "turn", "n_before", F.array_join(F.transform("sections", lambda x: x.cast("string")), ",").alias("sections"))


@query("SELECT o_orderkey AS document_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_direct_edge(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")).join(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id")), "document_id", "left_anti")


@query("SELECT document_id, 'direct' AS branch FROM (SELECT DISTINCT from_id AS document_id FROM edges WHERE tag = 'A') UNION ALL SELECT DISTINCT from_id, 'fallback' FROM edges WHERE from_id NOT IN (SELECT from_id FROM edges WHERE tag = 'A')", EDGES_SQL)
def hierarchy_candidates(spark, sf_dir):
    e = edges(spark, sf_dir)
    direct = e.filter("tag = 'A'").select(F.col("from_id").alias("document_id")).distinct()
    rest = e.select(F.col("from_id").alias("document_id")).distinct().join(direct, "document_id", "left_anti")
    return direct.withColumn("branch", F.lit("direct")).unionByName(rest.withColumn("branch", F.lit("fallback")))


@query("SELECT d.document_id FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.document_id AND e.label <> 0 AND e.vec_id % 11 <> 0 AND len(e.embedding) = 64 WHERE e.vec_id IS NULL", DOCS_SQL)
def embed_pending(spark, sf_dir):
    """Documents without a vector under the wanted fingerprint, model and dimension."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.when(F.col("label") == 0, "old").otherwise("fp").alias("fingerprint"), F.when(F.col("vec_id") % 11 == 0, "m0").otherwise("m1").alias("model"), F.size("embedding").alias("dimension"))
    return docs(spark, sf_dir).select("document_id").join(e.filter("fingerprint = 'fp' AND model = 'm1' AND dimension = 64"), "document_id", "left_anti")


ZONES_SQL = "zones AS (SELECT doc_id AS document_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'not_found' END AS status, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER)) AS fetched_at, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 + CASE WHEN quality = 1 THEN 30 ELSE 7 END AS INTEGER)) AS expires_at, CASE WHEN toxic = 0 THEN 'h' END AS text_hash FROM labels)"
DUE_SQL = "(z.document_id IS NULL OR expires_at <= TIMESTAMP '2024-01-25' OR (status = 'ok' AND text_hash IS NULL) {0})"


@query(f"SELECT 'oldest' AS walk, document_id FROM (SELECT d.document_id FROM docs d LEFT JOIN zones z ON z.document_id = d.document_id WHERE kind = 'decision' AND d.document_id > 20 AND {DUE_SQL.format('')} ORDER BY 1 LIMIT 100) UNION ALL SELECT 'recent', document_id FROM (SELECT d.document_id FROM docs d LEFT JOIN zones z ON z.document_id = d.document_id WHERE kind = 'decision' AND valid_from >= DATE '2000-02-01' AND {DUE_SQL.format("OR fetched_at < TIMESTAMP '2024-01-10'")} ORDER BY 1 DESC LIMIT 100)", DOCS_SQL, ZONES_SQL)
def enrich_candidates(spark, sf_dir):
    """A page from a cursor on, oldest first, and one of recent decisions, with re-fetching."""
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    k = F.col("doc_id")
    z = read(spark, sf_dir, "labels").select(k.alias("document_id"), F.when(F.col("quality") == 1, "ok").otherwise("not_found").alias("status"), day(k % 30).alias("fetched_at"), day(k % 30 + F.when(F.col("quality") == 1, 30).otherwise(7)).alias("expires_at"), F.when(F.col("toxic") == 0, "h").alias("text_hash"))
    d = docs(spark, sf_dir).filter("kind = 'decision'").select("document_id", "valid_from")
    a = X.enrich_candidates(d, z, "2024-01-25T00:00:00Z", after=20)
    b = X.enrich_candidates(d, z, "2024-01-25T00:00:00Z", since="2024-01-10T00:00:00Z", cutoff="2000-02-01", newest_first=True)
    return a.select(F.lit("oldest").alias("walk"), "document_id").unionByName(b.select(F.lit("recent").alias("walk"), "document_id"))


@query("SELECT d.document_id, z.document_id IS NULL AS missing FROM docs d LEFT JOIN zones z ON z.document_id = d.document_id WHERE kind = 'decision' AND " + DUE_SQL.format(""), DOCS_SQL, ZONES_SQL)
def enrich_left_join(spark, sf_dir):
    """Decisions whose zone row is missing, expired or hashless: all of them."""
    now = F.lit("2024-01-25T00:00:00Z").cast("timestamp")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    k, ok = F.col("doc_id"), F.col("quality") == 1
    z = read(spark, sf_dir, "labels").select(k.alias("document_id"), (day(k % 30 + F.when(ok, 30).otherwise(7)) <= now).alias("expired"), (ok & (F.col("toxic") != 0)).alias("hashless"), F.lit(True).alias("there"))
    j = docs(spark, sf_dir).filter("kind = 'decision'").select("document_id").join(z, "document_id", "left")
    return j.filter("there IS NULL OR expired OR hashless").select("document_id", F.col("there").isNull().alias("missing"))


@query("SELECT d.document_id, count(c.chunk_id) AS n_units FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id AND c.chunk_index > 0 GROUP BY d.document_id, n_chars HAVING count(c.chunk_id) = 0 OR n_chars > 12000", DOCS_SQL, CHUNKS_SQL)
def derivable_exists(spark, sf_dir):
    """No units, or stale ones."""
    u = chunks(spark, sf_dir).filter("chunk_index > 0").groupBy("document_id").agg(n().alias("n_units"))
    j = docs(spark, sf_dir).select("document_id", "n_chars").join(u, "document_id", "left").select("document_id", "n_chars", F.coalesce("n_units", F.lit(0).cast("bigint")).alias("n_units"))
    return j.filter("n_units = 0 OR n_chars > 12000").select("document_id", "n_units")


@query("SELECT 'documents' AS metric, kind AS label, count(*) AS n FROM docs GROUP BY kind UNION ALL SELECT 'source', source, count(*) FROM docs GROUP BY source UNION ALL SELECT 'edges', tag, count(*) FROM edges GROUP BY tag UNION ALL SELECT 'edge_source', status, count(*) FROM edges GROUP BY status", DOCS_SQL, EDGES_SQL)
def corpus_stats(spark, sf_dir):
    d, e = docs(spark, sf_dir), edges(spark, sf_dir)
    parts = [("documents", d, "kind"), ("source", d, "source"), ("edges", e, "tag"), ("edge_source", e, "status")]
    return reduce(DataFrame.unionByName, (x.groupBy(F.col(c).alias("label")).agg(n().alias("n")).select(F.lit(m).alias("metric"), "label", "n") for m, x, c in parts))


@query("SELECT family, version_id AS run_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY valid_from DESC, version_id DESC) AS k FROM versions WHERE label <> '5-LOW') WHERE k = 1", VERSIONS_SQL)
def source_coverage(spark, sf_dir):
    v = versions(spark, sf_dir).filter("label <> '5-LOW'")
    return X.latest(v, ["family"], [F.desc_nulls_last("valid_from"), F.desc("version_id")]).select("family", F.col("version_id").alias("run_id"), "amount")


@query("SELECT d.document_id, d.title, (SELECT count(*) FROM chunks c WHERE c.document_id = d.document_id) AS n_chunks, (SELECT count(*) FROM edges e WHERE e.from_id = d.document_id) AS n_edges FROM docs d WHERE d.document_id = 65", DOCS_SQL, CHUNKS_SQL, EDGES_SQL)
def inspect(spark, sf_dir):
    d = docs(spark, sf_dir).filter("document_id = 65").select("document_id", "title")
    c = chunks(spark, sf_dir).filter("document_id = 65").agg(n().alias("n_chunks"))
    e = edges(spark, sf_dir).filter("from_id = 65").agg(n().alias("n_edges"))
    return d.join(c).join(e)  # one row each


@query("SELECT kind, count(DISTINCT d.document_id) AS n_documents, count(DISTINCT d.document_id) FILTER (WHERE e.vec_id IS NOT NULL) AS n_covered FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.document_id GROUP BY kind", DOCS_SQL)
def projection_coverage(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(True).alias("has")).distinct()
    j = docs(spark, sf_dir).select("document_id", "kind").join(e, "document_id", "left")
    return j.groupBy("kind").agg(F.countDistinct("document_id").alias("n_documents"), F.countDistinct(F.when(F.col("has"), F.col("document_id"))).alias("n_covered"))


@query("SELECT count(*) AS n_chunks, count(*) FILTER (WHERE e.vec_id IS NOT NULL AND e.label = 1) AS n_embedded FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.document_id", DOCS_SQL)
def embedding_coverage(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "label")
    return docs(spark, sf_dir).select("document_id").join(e, "document_id", "left").agg(n().alias("n_chunks"), F.count_if(F.col("label") == 1).alias("n_embedded"))


COVERAGE_SQL = "covered AS (SELECT lang AS corpus, count(*) AS documents, count(*) FILTER (WHERE document_id % 50 <> 7 OR lang <> 'fr') AS projected, count(*) AS chunks, count(*) FILTER (WHERE lang <> 'de' OR document_id % 20 <> 3) AS embedded FROM docs GROUP BY lang UNION ALL SELECT 'none', 0, 0, 0, 0)"


def covered(spark, sf_dir) -> DataFrame:
    """Generations over languages: one lacks projections, one embeddings, and an empty one."""
    k, lang = F.col("document_id"), F.col("lang")
    c = docs(spark, sf_dir).groupBy(lang.alias("corpus")).agg(n().alias("documents"), F.count_if((k % 50 != 7) | (lang != "fr")).alias("projected"), n().alias("chunks"), F.count_if((lang != "de") | (k % 20 != 3)).alias("embedded"))
    return c.unionByName(spark.createDataFrame([("none", 0, 0, 0, 0)], "corpus string, documents long, projected long, chunks long, embedded long"))


@query("SELECT corpus, documents, projected, chunks, embedded FROM covered", DOCS_SQL, COVERAGE_SQL)
def generation_coverage(spark, sf_dir):
    return covered(spark, sf_dir)


@query("SELECT corpus, CASE WHEN documents = 0 THEN 'empty' WHEN projected = documents AND embedded = chunks THEN 'ready' ELSE 'incomplete' END AS state, CASE WHEN documents > 0 AND projected = documents AND embedded = chunks THEN 'ready' ELSE 'incomplete' END AS alone FROM covered", DOCS_SQL, COVERAGE_SQL)
def readiness_stamp(spark, sf_dir):
    """States among other corpora, and alone; tests hold that an incomplete one fails the stamp."""
    c = covered(spark, sf_dir)
    return X.readiness(c, True).join(X.readiness(c, False).withColumnRenamed("state", "alone"), "corpus")


@query("""WITH z AS (SELECT d.document_id, d.source, quality, toxic FROM docs d JOIN labels l ON l.doc_id = d.document_id WHERE kind = 'decision'), u AS (SELECT document_id, CASE chunk_index % 3 WHEN 0 THEN 'motivations' WHEN 1 THEN 'moyens' ELSE 'dispositif' END AS zone, chunk_id FROM chunks WHERE document_id IN (SELECT document_id FROM z WHERE quality = 1))
  SELECT 'zones' AS metric, source || ':' || CASE quality WHEN 1 THEN 'ok' ELSE 'not_found' END AS label, count(*) AS n FROM z GROUP BY 2 UNION ALL SELECT 'units', zone, count(*) FROM u GROUP BY zone UNION ALL SELECT 'decisions', 'total', count(DISTINCT document_id) FROM u
  UNION ALL SELECT 'pending', 'total', count(*) FROM u WHERE document_id NOT IN (SELECT vec_id FROM embeddings)""", DOCS_SQL, CHUNKS_SQL)  # fmt: skip
def zone_coverage(spark, sf_dir):
    """Zone rows by source and status, units by zone, decisions that have any, units without a vector."""
    z = docs(spark, sf_dir).filter("kind = 'decision'").select("document_id", "source").join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality"), "document_id")
    i = F.col("chunk_index") % 3
    u = chunks(spark, sf_dir).join(z.filter("quality = 1").select("document_id"), "document_id", "left_semi").select("document_id", F.when(i == 0, "motivations").when(i == 1, "moyens").otherwise("dispositif").alias("zone"))
    pending = u.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id")), "document_id", "left_anti")
    parts = [z.groupBy(F.concat_ws(":", "source", F.when(F.col("quality") == 1, "ok").otherwise("not_found")).alias("label")).agg(n().alias("n")).select(F.lit("zones").alias("metric"), "label", "n"), u.groupBy(F.col("zone").alias("label")).agg(n().alias("n")).select(F.lit("units").alias("metric"), "label", "n")]
    parts += [x.select(F.lit(m).alias("metric"), F.lit("total").alias("label"), "n") for m, x in (("decisions", u.agg(F.countDistinct("document_id").alias("n"))), ("pending", pending.agg(n().alias("n"))))]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT coalesce(source, 'total') AS source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(body, '[0-9]{4}')) AS n_reachable FROM docs GROUP BY GROUPING SETS ((source), ())", DOCS_SQL)
def resolver_reachable(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.rollup("source").agg(n().alias("n"), F.count_if(F.col("body").rlike("[0-9]{4}")).alias("n_reachable")).select(F.coalesce("source", F.lit("total")).alias("source"), "n", "n_reachable")


@query("SELECT to_id AS citation_key, count(*) AS occurrence_count FROM edges JOIN part ON p_partkey = to_id GROUP BY to_id, p_size HAVING count(*) IS DISTINCT FROM p_size", EDGES_SQL)
def citation_counts(spark, sf_dir):
    """Recomputed counts, only where they differ from the stored one."""
    now = edges(spark, sf_dir).groupBy(F.col("to_id").alias("citation_key")).agg(n().alias("occurrence_count"))
    old = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("citation_key"), big("p_size").alias("old"))
    return now.join(old, "citation_key").filter(~F.col("occurrence_count").eqNullSafe(F.col("old"))).select("citation_key", "occurrence_count")


@query("SELECT status, count(*) AS n, count(DISTINCT from_id) AS n_decisions FROM edges GROUP BY status", EDGES_SQL)
def citation_coverage(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("status").agg(n().alias("n"), F.countDistinct("from_id").alias("n_decisions"))


@query("""WITH run AS (SELECT user_id, event_type AS last FROM events ORDER BY ts DESC, event_id DESC LIMIT 1), m AS (SELECT e.* FROM events e JOIN run USING (user_id))
  SELECT 'status' AS metric, event_type AS label, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY event_type UNION ALL SELECT 'failed_percent', 'total', round(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) FROM m
  UNION ALL SELECT 'error_class', 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4), count(*) FROM m WHERE event_type = 'error' GROUP BY 2 UNION ALL SELECT 'warning', 'latest run is ' || last, 1 FROM run WHERE last <> 'purchase' UNION ALL SELECT 'warning', 'members failed', 1 FROM m WHERE event_type = 'error' GROUP BY 1""")  # fmt: skip
def ingest_health(spark, sf_dir):
    """The latest run's members by status, the share that failed, error classes, and warnings."""
    e = read(spark, sf_dir, "events")
    run = e.agg(F.max_by(F.struct("user_id", F.col("event_type").alias("last")), F.struct("ts", "event_id")).alias("r")).select("r.*")
    m = e.join(F.broadcast(run), "user_id")  # one row
    row = lambda df, metric, label, value: df.select(F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value"))
    bad = m.filter("event_type = 'error'")
    kind = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("bigint") % 4).cast("string"))
    parts = [
        row(m.groupBy("event_type").agg(n().alias("n")), "status", F.col("event_type"), F.col("n")),
        row(m.agg(F.round(100.0 * F.count_if(F.col("event_type") == "error") / n(), 6).alias("p")), "failed_percent", F.lit("total"), F.col("p")),
        row(bad.groupBy(kind.alias("k")).agg(n().alias("n")), "error_class", F.col("k"), F.col("n")),
        row(run.filter("last <> 'purchase'"), "warning", F.concat(F.lit("latest run is "), F.col("last")), F.lit(1)),
        row(bad.agg(n().alias("n")).filter("n > 0"), "warning", F.lit("members failed"), F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT l_partkey AS key, max(l_returnflag) AS corpus FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = 1")
def corpus_attribution(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_returnflag").alias("corpus"), F.countDistinct("l_returnflag").alias("k")).filter("k = 1").drop("k")


@query("WITH f AS (SELECT family, md5(string_agg(CAST(version_id AS VARCHAR), ',' ORDER BY CAST(version_id AS VARCHAR))) AS family_key, min(version_id) AS seed FROM (SELECT DISTINCT family, version_id FROM versions) GROUP BY family) SELECT family_key, min(seed) AS seed FROM f GROUP BY family_key", VERSIONS_SQL)
def family_key(spark, sf_dir):
    f = versions(spark, sf_dir).groupBy("family").agg(F.md5(F.array_join(F.sort_array(F.collect_set(F.col("version_id").cast("string"))), ",")).alias("family_key"), F.min("version_id").alias("seed"))
    return f.groupBy("family_key").agg(F.min("seed").alias("seed"))


@query("SELECT family, count(DISTINCT version_id) AS n FROM versions GROUP BY family HAVING count(DISTINCT version_id) >= 2 AND bool_or(label = '1-URGENT')", VERSIONS_SQL)
def valid_families(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("family").agg(F.countDistinct("version_id").alias("n"), F.bool_or(F.col("label") == "1-URGENT").alias("ok")).filter("n >= 2 AND ok").drop("ok")


@query(f"WITH x AS {merkle_sql('docs', 'document_id', 'document_id, kind, source, valid_to')} SELECT n, digest FROM x", DOCS_SQL)
def table_digest(spark, sf_dir):
    return merkle.table_digest(docs(spark, sf_dir), ["document_id"], ["document_id", "kind", "source", "valid_to"])


SNAPSHOT = {"documents": ("docs", "document_id", ["document_id", "kind", "source"]), "chunks": ("(SELECT document_id * 1000 + chunk_index AS id, * FROM chunks)", "id", ["id", "chunk_id"]), "edges": ("(SELECT from_id * 100 + position AS id, * FROM edges)", "id", ["id", "to_id"]), "embeddings": ("embeddings", "vec_id", ["vec_id", "label"]), "metadata": ("pages", "page_id", ["page_id", "url"])}


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS part, digest AS signature FROM {merkle_sql(t, k, ', '.join(cols))}" for name, (t, k, cols) in SNAPSHOT.items()) + ") SELECT part, signature FROM s UNION ALL SELECT 'root', md5(string_agg(signature, chr(10) ORDER BY part)) FROM s", DOCS_SQL, CHUNKS_SQL, EDGES_SQL)
def replay_snapshot(spark, sf_dir):
    """Signatures of five tables, the roots of their trees, and the root over them."""
    key = lambda a, m, b: (F.col(a) * m + F.col(b)).alias("id")
    tables = {"documents": docs(spark, sf_dir), "chunks": chunks(spark, sf_dir).select("*", key("document_id", 1000, "chunk_index")), "edges": edges(spark, sf_dir).select("*", key("from_id", 100, "position")), "embeddings": read(spark, sf_dir, "embeddings"), "metadata": read(spark, sf_dir, "pages")}
    parts = reduce(DataFrame.unionByName, (merkle.table_digest(tables[name], [k], cols).select(F.lit(name).alias("part"), F.col("digest").alias("signature")) for name, (_, k, cols) in SNAPSHOT.items()))
    root = parts.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "signature"))), lambda x: x["signature"]), "\n")).alias("signature"))  # five rows
    return parts.unionByName(root.select(F.lit("root").alias("part"), "signature"))


@query("SELECT string_agg(corpus || ':' || g || ':' || s, ',' ORDER BY corpus) AS signature FROM (SELECT lang AS corpus, CAST(count(*) AS VARCHAR) AS g, CAST(max(document_id) AS VARCHAR) AS s FROM docs GROUP BY lang)", DOCS_SQL)
def read_signature(spark, sf_dir):
    s = docs(spark, sf_dir).groupBy("lang").agg(F.concat_ws(":", "lang", n().cast("string"), F.max("document_id").cast("string")).alias("x"))
    return s.agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("signature"))


@query("SELECT md5('fp,64,' || count(*) || ',' || sum(n_chars) || ',' || (SELECT string_agg(source || '=' || v, ';' ORDER BY source) FROM (SELECT source, max(valid_from) AS v FROM docs GROUP BY source))) AS revision FROM docs", DOCS_SQL)
def index_revision(spark, sf_dir):
    """Of the manifest, the counts, and the newest version of each source."""
    d = docs(spark, sf_dir).groupBy("source").agg(n().alias("n"), F.sum("n_chars").alias("chars"), F.max("valid_from").cast("string").alias("v"))
    newest = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "v"))), lambda x: F.concat_ws("=", x["source"], x["v"])), ";")
    return d.agg(F.md5(F.concat_ws(",", F.lit("fp,64"), F.sum("n").cast("string"), F.sum("chars").cast("string"), newest)).alias("revision"))


@query("SELECT document_id, source, 'even' AS generation FROM docs WHERE document_id % 2 = 0 UNION ALL SELECT document_id, source, 'odd' FROM docs WHERE document_id % 2 = 1", DOCS_SQL)
def union_views(spark, sf_dir):
    d = docs(spark, sf_dir)
    parts = [d.filter(F.col("document_id") % 2 == k).select("document_id", "source", F.lit(name).alias("generation")) for k, name in enumerate(("even", "odd"))]
    return X.union_views(spark, parts, "document_id long, source string, generation string")


@query("SELECT document_id, source_uid FROM docs d WHERE n_chars >= 60 AND kind = 'article' AND valid_from IS NOT NULL ORDER BY document_id LIMIT 60", DOCS_SQL)
def gold_known_item(spark, sf_dir):
    return docs(spark, sf_dir).filter("n_chars >= 60 AND kind = 'article' AND valid_from IS NOT NULL").select("document_id", "source_uid").orderBy("document_id").limit(60)


@query(
    """WITH seed AS (SELECT DISTINCT from_id FROM edges ORDER BY from_id LIMIT 2000), q AS (SELECT document_id, substr(arg_min(body, chunk_index), 1, 2000) AS query FROM chunks GROUP BY document_id)
    SELECT e.from_id AS seed, string_agg(DISTINCT CAST(to_id AS VARCHAR), ',' ORDER BY CAST(to_id AS VARCHAR)) AS gold, md5(any_value(query)) AS query FROM edges e JOIN seed USING (from_id) JOIN part ON p_partkey = to_id JOIN q ON q.document_id = e.from_id WHERE tag = 'R' GROUP BY e.from_id ORDER BY seed LIMIT 60""",
    DOCS_SQL, CHUNKS_SQL, EDGES_SQL,
)
def gold_cross_reference(spark, sf_dir):
    """Of a pool of citing seeds those that have targets and a text, with the text as the question."""
    e = edges(spark, sf_dir)
    seed = e.select("from_id").distinct().orderBy("from_id").limit(2000)
    hit = e.filter("tag = 'R'").join(F.broadcast(seed), "from_id").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("to_id")), "to_id")
    gold = hit.groupBy(F.col("from_id").alias("seed")).agg(F.array_join(F.sort_array(F.collect_set(F.col("to_id").cast("string"))), ",").alias("gold"))
    q = chunks(spark, sf_dir).groupBy(F.col("document_id").alias("seed")).agg(F.md5(F.substring(F.min_by("body", "chunk_index"), 1, 2000)).alias("query"))
    return gold.join(q, "seed").orderBy("seed").limit(60)


@query("SELECT version_id, family, valid_from + CAST((valid_to - valid_from) // 2 AS INTEGER) AS on_date FROM versions WHERE valid_to - valid_from > 2 AND family IN (SELECT family FROM versions GROUP BY family HAVING count(*) >= 2)", VERSIONS_SQL)
def gold_temporal(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("k", F.count("*").over(W.partitionBy("family"))).filter((F.col("k") >= 2) & (F.datediff("valid_to", "valid_from") > 2))
    return v.select("version_id", "family", F.date_add("valid_from", F.floor(F.datediff("valid_to", "valid_from") / 2).cast("int")).alias("on_date"))
