"""Queries over text: identifiers, citations, HTML, chunks, zones, hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import CHUNKS_SQL, DOCS_SQL, chunks, docs, read
from ..functions import tables
from ..functions import text as T
from ..operators import derive as D
from ..operators.index import french
from .registry import query

WS = "[ \\t\\n\\r\\f\\v]+"


@query(f"SELECT document_id, substr(regexp_replace(body, '{WS}', ' ', 'g'), 1, 280) AS snippet FROM docs", DOCS_SQL)
def snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("document_id", T.snippet(F.col("body")).alias("snippet"))


STRIP_SQL = "regexp_replace(regexp_replace(body, 'ECLI:[A-Z]{2}:[A-Z0-9.:]+', ' ', 'g'), '(JURI|CETA)TEXT[0-9]{12}', ' ', 'g')"


@query(f"SELECT document_id, x AS excerpt FROM (SELECT document_id, substr(trim(regexp_replace({STRIP_SQL}, '{WS}', ' ', 'g')), 1, 500) AS x FROM docs) WHERE length(x) >= 60 ORDER BY document_id LIMIT 100", DOCS_SQL)
def strip_identifiers(spark, sf_dir):
    x = docs(spark, sf_dir).select("document_id", T.strip_identifiers(F.col("body")).alias("excerpt"))
    return x.filter(F.length("excerpt") >= 60).orderBy("document_id").limit(100)


@query("SELECT source, document_id FROM (SELECT source, document_id, row_number() OVER (PARTITION BY source ORDER BY document_id) AS k FROM docs WHERE length(body) >= 60) WHERE k = 1", DOCS_SQL)
def gold_headnote(spark, sf_dir):
    d = docs(spark, sf_dir).filter(F.length("body") >= 60)
    return d.groupBy("source").agg(F.min("document_id").alias("document_id"))


FOLD_SQL = f"replace(replace(translate(lower(body), '{T.ACCENTED}', '{T.FOLDED}'), 'œ', 'oe'), 'æ', 'ae')"


@query(f"SELECT document_id, md5({FOLD_SQL}) AS folded FROM docs", DOCS_SQL)
def accent_fold(spark, sf_dir):
    return docs(spark, sf_dir).select("document_id", F.md5(T.fold(F.col("body"))).alias("folded"))


CITATION_FOLD_SQL = f"replace(replace(translate(lower(body), '{T.CITATION_ACCENTED}', '{T.CITATION_FOLDED}'), 'œ', 'oe'), 'æ', 'ae')"


@query(f"SELECT document_id, md5(trim(regexp_replace({CITATION_FOLD_SQL}, '[^a-z0-9-]+', ' ', 'g'))) AS folded FROM docs", DOCS_SQL)
def citation_fold(spark, sf_dir):
    return docs(spark, sf_dir).select("document_id", F.md5(T.fold_citation(F.col("body"))).alias("folded"))


@query(f"SELECT document_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms FROM (SELECT document_id, list_filter(regexp_extract_all({FOLD_SQL}, '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)})) AS w FROM docs)", DOCS_SQL)
def fr_analyzer_tokens(spark, sf_dir):
    w = F.filter(T.tokens(F.col("body")), lambda x: ~x.isin(T.STOPWORDS))
    return docs(spark, sf_dir).select("document_id", w.alias("w")).select("document_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_terms"))


@query()
def fr_analyzer(spark, sf_dir):
    return docs(spark, sf_dir).filter("lang = 'fr'").select("document_id", french(F.col("body")).alias("w")).select("document_id", F.size(F.array_distinct("w")).cast("bigint").alias("n_stems"))


@query("""SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?i)</?(p|br|li|div|blockquote|tr|td|th|table)([ \\t\\n\\r\\f\\v][^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '[ \\t\\r\\f]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text FROM pages""")  # fmt: skip
def xml_text_norm(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text"))


@query("SELECT document_id, CAST(i AS BIGINT) AS chunk_index, md5(substr(body, CAST(i * 6000 + 1 AS BIGINT), 6000)) AS body FROM (SELECT document_id, body, unnest(range(0, greatest(1, CAST(ceil(length(body) / 6000.0) AS BIGINT)))) AS i FROM docs)", DOCS_SQL)
def chunk_hard_split(spark, sf_dir):
    d = docs(spark, sf_dir).select("document_id", F.explode(D.hard_split(F.col("body"))).alias("c"))
    return d.select("document_id", "c.chunk_index", F.md5("c.body").alias("body"))


def pack_sql(pieces: str, room: str) -> str:
    """CTEs that pack pieces (document_id, i, j, x) line by line into chunks: packed(document_id, chunk_index, body)."""
    over = "w.size + 1 + p.n > w.room"
    return f"""numbered AS (SELECT document_id, x, length(x) AS n, {room} AS room, row_number() OVER (PARTITION BY document_id ORDER BY i, j) - 1 AS k FROM ({pieces})),
walk AS (SELECT document_id, k, CAST(0 AS BIGINT) AS c, n AS size, room FROM numbered WHERE k = 0 UNION ALL SELECT p.document_id, p.k, CASE WHEN {over} THEN w.c + 1 ELSE w.c END, CASE WHEN {over} THEN p.n ELSE w.size + 1 + p.n END, w.room FROM walk w JOIN numbered p ON p.document_id = w.document_id AND p.k = w.k + 1),
packed AS (SELECT w.document_id, c AS chunk_index, string_agg(x, chr(10) ORDER BY w.k) AS body FROM walk w JOIN numbered p ON p.document_id = w.document_id AND p.k = w.k GROUP BY w.document_id, c)"""


LINES_SQL = "lined AS (SELECT document_id, kind, title, body, unnest(range(0, len(string_split(body, chr(10))))) AS i, regexp_replace(unnest(string_split(body, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM docs)"
CUT_SQL = "SELECT document_id, i, j, substr(line, CAST(j * 6000 + 1 AS BIGINT), 6000) AS x FROM (SELECT *, unnest(range(0, CAST(ceil(length(line) / 6000.0) AS BIGINT))) AS j FROM lined WHERE kind = 'decision' AND line <> '')"
RECURSIVE = "RECURSIVE " + DOCS_SQL


@query("SELECT document_id, chunk_index + CASE WHEN document_id % 3 = 0 THEN 1 ELSE 0 END AS chunk_index, md5(body) AS body FROM packed UNION ALL SELECT document_id, 0, md5(title) FROM docs WHERE kind = 'decision' AND document_id % 3 = 0", RECURSIVE, LINES_SQL, pack_sql(CUT_SQL, "6000"))
def chunk_decision(spark, sf_dir):
    """A summary chunk where there is a summary, then packed paragraphs."""
    summary = F.when(F.col("document_id") % 3 == 0, F.concat(F.col("title"), F.lit(" ")))
    d = docs(spark, sf_dir).filter("kind = 'decision'").select("document_id", F.explode(D.decision_chunks(F.col("body"), summary)).alias("c"))
    return d.select("document_id", F.col("c.chunk_index").cast("bigint").alias("chunk_index"), F.md5("c.body").alias("body"))


@query("""SELECT a.document_id, coalesce(p.chunk_index, 0) AS chunk_index, md5(a.title || chr(10) || chr(10) || coalesce(p.body, a.body)) AS body FROM docs a LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM packed) p ON p.document_id = a.document_id AND p.n > 1 AND length(a.body) > 5998 - length(a.title) WHERE a.kind = 'article'""", RECURSIVE, LINES_SQL, pack_sql("SELECT document_id, i, 0 AS j, line AS x, title FROM lined WHERE kind = 'article' AND line <> ''", "5998 - length(title)"))
def chunk_article(spark, sf_dir):
    """Whole if it fits with its context, else packed lines measured with the context."""
    d = docs(spark, sf_dir).filter("kind = 'article'")
    c = d.select("document_id", "title", F.explode(D.article_chunks(F.col("body"), F.col("title"))).alias("c"))
    return c.select("document_id", F.col("c.chunk_index").cast("bigint").alias("chunk_index"), F.md5(D.contextualize(F.array(), F.col("title"), F.col("c.body"))).alias("body"))


@query("SELECT document_id, md5('Livre I > ' || title || chr(10) || chr(10) || body) AS body FROM docs", DOCS_SQL)
def contextualize(spark, sf_dir):
    return docs(spark, sf_dir).select("document_id", F.md5(D.contextualize(F.array(F.lit("Livre I")), F.col("title"), F.col("body"))).alias("body"))


@query("SELECT document_id, CAST(s AS BIGINT) AS start, md5(substr(body, s + 1, 50)) AS text FROM (SELECT document_id, body, unnest([0, 100, 5000]) AS s FROM docs) WHERE s + 50 <= length(body) AND trim(substr(body, s + 1, 50)) <> ''", DOCS_SQL)
def zone_normalize(spark, sf_dir):
    z = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(s + 50).alias("end")) for s in (0, 100, 5000)))
    d = docs(spark, sf_dir).select("document_id", F.explode(D.zone_slices(F.col("body"), z)).alias("z"))
    return d.select("document_id", F.col("z.start").cast("bigint").alias("start"), F.md5("z.text").alias("text"))


@query("""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS fragment_index, md5(x) AS body FROM
  (SELECT document_id, unnest(range(0, len(string_split(body, chr(10))))) AS i, unnest(string_split(body, chr(10))) AS x FROM docs WHERE kind = 'decision') WHERE trim(x) <> ''""", DOCS_SQL)  # fmt: skip
def zone_units(spark, sf_dir):
    d = docs(spark, sf_dir).filter("kind = 'decision'").select("document_id", F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("i", "x"))
    return d.select("document_id", F.col("i").cast("bigint").alias("fragment_index"), F.md5("x").alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN NULL ELSE 'old' END AS fingerprint FROM documents")
def fp_preserve(spark, sf_dir):
    k, t = F.col("doc_id"), F.col("text")
    new_body = F.when(k % 3 == 0, F.concat(t, F.lit("!"))).otherwise(t)
    return read(spark, sf_dir, "documents").select("doc_id", D.fp_preserve(t, new_body, F.lit("old"), F.when(k % 5 == 0, "new")).alias("fingerprint"))


@query("SELECT document_id, CASE WHEN length(body) >= 50 AND trim(substr(body, 1, 50)) <> '' OR length(body) >= 5050 AND trim(substr(body, 5001, 50)) <> '' THEN 'ok' ELSE 'invalid_offsets' END AS status FROM docs", DOCS_SQL)
def zone_status(spark, sf_dir):
    """Zones of a decision; out of range, reversed and blank offsets don't count."""
    z = lambda *xs: D.zone_slices(F.col("body"), F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in xs)))
    return docs(spark, sf_dir).select("document_id", D.zone_status(z((0, 50)), z((5000, 5050), (40, 20)), z((-1, 4), (7, 7))).alias("status"))


@query("""SELECT d.doc_id AS document_id, CASE WHEN quality IS NOT NULL AND toxic = 0 THEN CASE WHEN quality = 1 AND d.doc_id % 3 <> 0 THEN 'official' ELSE 'fallback' END WHEN d.doc_id % 2 = 1 THEN 'enrich' ELSE 'fallback' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""")
def zone_cache_action(spark, sf_dir):
    """Cached rows over labels: an expired one counts as none; only Cassation decisions are enriched."""
    j = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "not_found")
    source = F.when(F.col("doc_id") % 2 == 1, "cass").otherwise("jade")
    return j.select(F.col("doc_id").alias("document_id"), D.zone_cache_action(status, F.col("toxic") == 1, F.col("doc_id") % 3 != 0, True, source).alias("action"))


@query("""SELECT doc_id AS document_id, unnest(CASE doc_id % 6 WHEN 0 THEN ['L121-3', '12'] WHEN 1 THEN ['R1332-2'] WHEN 3 THEN ['7'] WHEN 5 THEN ['D5'] ELSE [] END) AS number, unnest(CASE doc_id % 6 WHEN 0 THEN ['code civil et l' || chr(39), 'même code'] WHEN 1 THEN [''] WHEN 3 THEN ['code de commerce'] WHEN 5 THEN ['code rural'] ELSE [] END) AS code FROM documents""")
def inferred_citations(spark, sf_dir):
    forms = ["Vu l'article L. 121-3 du code civil et l'article 12 du même code.", "articles R.1332-2 et suivants.", "selon l'article 8 de la convention.", "article 7 du code de commerce, article 7 du code  de commerce.", "rien.", "article d 5 du Code rural; article 9."]
    forms[5] = forms[5].replace("Code", "code")
    body = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("document_id") % 6 + 1).cast("int")), F.repeat(F.lit(" "), 90), F.col("body"))
    d = docs(spark, sf_dir).select("document_id", F.explode(D.inferred_citations(F.col("document_id"), body)).alias("c"))
    return d.select("document_id", "c.number", "c.code")


PARTS_SQL = "SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'Sommaire ' || doc_id END AS summary, 'Vu le code' || chr(10) || 'VU : la loi' AS visa, CASE doc_id % 3 WHEN 0 THEN 'Décide : rejette' WHEN 1 THEN 'd e c i d e que' ELSE 'PAR CES MOTIFS x' END AS dispositif, CAST(NULL AS VARCHAR) AS moyens FROM documents"


@query(PARTS_SQL)
def decision_part(spark, sf_dir):
    k = F.col("doc_id")
    end = F.when(k % 3 == 0, F.lit("PAR CES MOTIFS x\nDécide : rejette \n")).when(k % 3 == 1, F.lit("PAR CES MOTIFS x\n d e c i d e que")).otherwise(F.lit("decide\nPAR CES MOTIFS x"))
    body = F.concat(F.lit("En-tête\n\n Vu le code\n\nVU : la loi\nAttendu que "), F.regexp_replace("text", "(?i)d[eé]cide", ""), F.lit("\nVu plus tard\n"), end)
    summary = F.when(k % 2 == 0, F.concat(F.lit("Sommaire "), k.cast("string"))).otherwise(F.lit(" "))
    return read(spark, sf_dir, "documents").select(k.alias("document_id"), *(D.decision_part(p, body, summary).alias(p) for p in ("summary", "visa", "dispositif", "moyens")))


BACKFILL_SQL = """based AS (SELECT *, CASE WHEN document_id % 4 = 0 THEN ['Code', 'X', 'Y'] ELSE ['Code'] END AS path FROM docs WHERE kind = 'article'),
linked AS (SELECT document_id, p, CASE p WHEN 2 THEN ['Code', 'L2', 'T2'] ELSE ['Code', 'L' || p] END AS section, valid_from + CAST((document_id % 3 - p) * 10 AS INTEGER) <= CASE WHEN document_id % 7 = 0 THEN valid_from - 15 ELSE valid_from END AS valid FROM (SELECT *, unnest([0, 1, 2]) AS p FROM based WHERE document_id % 5 <> 0)),
filled AS (SELECT b.document_id, b.title, coalesce(CASE WHEN len(section) > len(path) THEN section END, path) AS new_path, coalesce(len(section) > len(path), false) AS changed FROM based b LEFT JOIN (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY NOT valid, p) = 1) l ON l.document_id = b.document_id)"""


def backfilled(spark, sf_dir):
    k = F.col("document_id")
    a = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    d = docs(spark, sf_dir).filter("kind = 'article'").select("document_id", "title", F.when(k % 4 == 0, a("Code", "X", "Y")).otherwise(a("Code")).alias("path"), "valid_from")
    p = F.col("position")
    links = d.filter(k % 5 != 0).select("document_id", "valid_from", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position"))
    links = links.select("document_id", "position", F.when(p == 2, a("Code", "L2", "T2")).otherwise(a("Code", F.concat(F.lit("L"), p.cast("string")))).alias("section_path"), F.date_add("valid_from", ((k % 3 - p) * 10).cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.when(k % 7 == 0, F.date_sub("valid_from", 15)).otherwise(F.col("valid_from")).alias("anchor"))
    return d, D.hierarchy_backfill(d, links)


@query("SELECT document_id, array_to_string(new_path, ' > ') AS path, changed FROM filled", DOCS_SQL, BACKFILL_SQL)
def hierarchy_backfill(spark, sf_dir):
    return backfilled(spark, sf_dir)[1].select("document_id", F.concat_ws(" > ", "new_path").alias("path"), "changed")


@query("SELECT chunk_id, md5(array_to_string(new_path, ' > ') || ' > ' || f.title || chr(10) || chr(10) || c.body) AS body, CASE WHEN NOT changed THEN 'fp' END AS fingerprint FROM chunks c JOIN filled f ON f.document_id = c.document_id", DOCS_SQL, CHUNKS_SQL, BACKFILL_SQL)
def hierarchy_rebuild(spark, sf_dir):
    """Contextualized bodies anew, and embeddings of changed ones given up."""
    d, b = backfilled(spark, sf_dir)
    c = chunks(spark, sf_dir).withColumn("fingerprint", F.lit("fp"))
    return D.rebuilt_chunks(c, d, b).select("chunk_id", F.md5("contextualized_body").alias("body"), "fingerprint")


@query("SELECT chunk_id, CAST(8 AS BIGINT) AS dimension, CAST(least(length(body), 1000) % 8 AS BIGINT) AS at, 1.0::DOUBLE AS norm FROM chunks", DOCS_SQL, CHUNKS_SQL)
def embed(spark, sf_dir):
    """With a provider that tells the length it was given."""
    provider = lambda texts: [[float(k == len(t) % 8) for k in range(8)] for t in texts]
    e = D.embed(chunks(spark, sf_dir), provider, 8, 1000)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("chunk_id", F.size("embedding").cast("bigint").alias("dimension"), (F.array_position("embedding", 1.0) - 1).alias("at"), norm.alias("norm"))


@query("SELECT document_id, chunk_index, md5(body) AS body, length(body) AS chars FROM packed", RECURSIVE, LINES_SQL, pack_sql(CUT_SQL, "6000"))
def sql_chunk_text(spark, sf_dir):
    """The chunker as a table function in SQL, joined to each decision."""
    tables.register(spark)
    docs(spark, sf_dir).filter("kind = 'decision'").createOrReplaceTempView("lexforge_decisions")
    return spark.sql("SELECT d.document_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, md5(c.body) AS body, c.chars FROM lexforge_decisions d, LATERAL chunk_text(d.body, 6000, 'chunk_index,chars,body') c")
