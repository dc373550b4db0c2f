"""Queries of the cite command: classification, lookups, states, the strict gate, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import DOCS_SQL, docs, read
from ..functions import tables
from ..functions import text as T
from ..operators import citations as C
from ..operators.retrieval import asof
from .registry import query

DAY = "2008-06-01"
#: The legal corpus over documents: four article rows share a publisher id, six decisions an ECLI.
LEGAL_SQL = """legal AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'legi:' || uid || '@' || vf ELSE source || ':' || uid END AS document_id, * EXCLUDE (vf, vt), CAST(vf AS DATE) AS valid_from, CAST(vt AS DATE) AS valid_to FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'article' ELSE 'decision' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'legi' WHEN doc_id % 4 = 1 THEN 'cass' ELSE 'jade' END AS source,
    CASE WHEN doc_id % 2 = 0 THEN 'LEGIARTI' || lpad(CAST(doc_id - doc_id % 8 AS VARCHAR), 12, '0') WHEN doc_id % 4 = 1 THEN 'JURITEXT' || lpad(CAST(doc_id AS VARCHAR), 12, '0') ELSE 'CETATEXT' || lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS uid,
    CASE WHEN doc_id % 3 = 0 THEN 'Code civil' ELSE 'Code du travail' END AS citation, 'Article ' || (doc_id % 400) AS title,
    strftime(DATE '2000-01-01' + CAST(doc_id % 6000 AS INTEGER), '%Y-%m-%d') AS vf, CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2000-01-01' + CAST(doc_id % 6000 + doc_id % 2000 + 1 AS INTEGER), '%Y-%m-%d') END AS vt,
    CASE WHEN doc_id % 2 = 1 THEN 'ECLI:FR:CCASS:2021:C' || (100000 + doc_id // 12) END AS ecli,
    CASE WHEN doc_id % 2 = 1 THEN (10 + doc_id % 80) || '-' || (10 + doc_id % 90) || '.' || (100 + doc_id % 900) END AS number FROM documents))"""
ROOTS_SQL = """roots AS (
  SELECT page_id, kind || ':' || page_id AS metadata_key, kind AS root_kind, CASE kind WHEN 'SECTION_TA' THEN 'LEGISCTA' ELSE 'LEGITEXT' END || lpad(CAST(page_id // 6 AS VARCHAR), 12, '0') AS source_uid, url AS title,
    CASE WHEN kind = 'TEXTELR' THEN 'JUSX' || lpad(CAST(page_id // 6 AS VARCHAR), 7, '0') || 'L' END AS nor, DATE '2001-01-01' + CAST(page_id % 4000 AS INTEGER) AS valid_from, CAST(NULL AS DATE) AS valid_to
  FROM (SELECT *, ['TEXTE_VERSION', 'SECTION_TA', 'TEXTELR'][1 + page_id % 3] AS kind FROM pages))"""
CITES_SQL = """cits AS (SELECT doc_id AS cite_id, CASE doc_id % 16
  WHEN 0 THEN 'legi:LEGIARTI' || lpad(CAST(doc_id - doc_id % 8 AS VARCHAR), 12, '0') || '@' || strftime(DATE '2000-01-01' + CAST(doc_id % 6000 AS INTEGER), '%Y-%m-%d')
  WHEN 1 THEN ' cass:JURITEXT' || lpad(CAST(doc_id AS VARCHAR), 12, '0') WHEN 2 THEN 'voir legiarti' || lpad(CAST(doc_id - doc_id % 8 AS VARCHAR), 12, '0') || ' et suivants'
  WHEN 3 THEN 'CETATEXT' || lpad(CAST(doc_id AS VARCHAR), 12, '0') WHEN 4 THEN 'l''article ' || (doc_id % 400) || ' du Code civil' WHEN 5 THEN 'ecli:fr:ccass:2021:c' || (100000 + doc_id // 12)
  WHEN 6 THEN 'Article L. ' || (doc_id % 50) || '-1 du Code pénal' WHEN 7 THEN (10 + doc_id % 80) || '-' || (10 + doc_id % 90) || '.' || (100 + doc_id % 900) WHEN 8 THEN 'legi:LEGIARTI999999999999@2001-01-01'
  WHEN 9 THEN 'rien d''utile ici' WHEN 10 THEN 'LEGITEXT' || lpad(CAST(doc_id // 96 AS VARCHAR), 12, '0') WHEN 11 THEN 'jade:CETATEXT' || lpad(CAST(doc_id AS VARCHAR), 12, '0') WHEN 12 THEN 'LEGISCTA' || lpad(CAST(doc_id // 96 AS VARCHAR), 12, '0')
  WHEN 13 THEN ' ' WHEN 14 THEN 'jusx ' || lpad(CAST(doc_id // 96 AS VARCHAR), 7, '0') || ' l' ELSE 'articles 12 et article ' || (doc_id % 90) || ' du code des assurances' END AS cite FROM documents)"""
_U = "regexp_extract(upper(cite), '{0}([0-9]{{12}})', 1)"
PARSED_SQL = f"""normal AS (SELECT *, trim(cite) AS t, trim(regexp_replace(replace(translate(lower(cite), 'àâäçéèêëîïôöùûü', 'aaaceeeeiioouuu'), 'œ', 'oe'), '[^a-z0-9-]+', ' ', 'g')) AS f FROM cits),
numbered AS (SELECT *, regexp_extract(' ' || f || ' ', ' article ([a-z0-9-]*[0-9][a-z0-9-]*|(?:lo|l|r|d) [a-z0-9-]*[0-9][a-z0-9-]*) ', 1) AS art, upper(regexp_replace(cite, '[^A-Za-z0-9]+', '', 'g')) AS solid, replace(replace(t, '.', ''), ' ', '') AS dense FROM normal),
classed AS (SELECT *, CASE WHEN starts_with(t, 'legi:') THEN 'document_id' WHEN regexp_matches(t, '^(cass|capp|inca|jade):') THEN 'decision_document_id' WHEN {_U.format('LEGIARTI')} <> '' THEN 'legiarti' WHEN {_U.format('LEGITEXT')} <> '' THEN 'legitext'
  WHEN {_U.format('LEGISCTA')} <> '' THEN 'legiscta' WHEN {_U.format('JURITEXT')} <> '' OR {_U.format('CETATEXT')} <> '' THEN 'decision_id' WHEN starts_with(upper(t), 'ECLI:') THEN 'ecli' WHEN art <> '' THEN 'free_text_article'
  WHEN regexp_matches(dense, '^[0-9]{{2}}-[0-9]{{4,6}}$') THEN 'pourvoi' WHEN regexp_matches(solid, '^[A-Z]{{4}}[0-9]{{7}}[A-Z]$') THEN 'nor' ELSE 'malformed' END AS class FROM numbered),
parsed AS (SELECT cite_id, cite, f, class, CASE WHEN class IN ('document_id', 'decision_document_id') THEN t WHEN class IN ('legiarti', 'legitext', 'legiscta', 'decision_id') THEN regexp_extract(upper(cite), '(LEGIARTI|LEGITEXT|LEGISCTA|JURITEXT|CETATEXT)[0-9]{{12}}', 0)
  WHEN class = 'ecli' THEN upper(t) WHEN class = 'free_text_article' THEN replace(art, ' ', '') WHEN class = 'pourvoi' THEN dense WHEN class = 'nor' THEN solid ELSE nullif(f, '') END AS value,
  list_filter([{', '.join(repr(c) for c in T.CODES)}], lambda c: contains(' ' || f || ' ', ' ' || c || ' '))[1] AS hint, nullif(regexp_extract(upper(cite), '(LEGIARTI|JURITEXT|CETATEXT)[0-9]{{12}}', 0), '') AS u FROM classed)"""
MATCHES_SQL = """found AS (
  SELECT cite_id, class, 'document' AS target_type, document_id, CAST(NULL AS VARCHAR) AS metadata_key, d.source, d.kind, d.uid AS source_uid, d.title, valid_from, valid_to, class NOT IN ('document_id', 'decision_document_id', 'free_text_article') OR document_id = value AS exact FROM parsed p JOIN legal d ON
    class IN ('document_id', 'decision_document_id') AND (document_id = value OR d.uid = u) OR class = 'legiarti' AND d.uid = value OR class = 'decision_id' AND kind = 'decision' AND d.uid = value OR class = 'ecli' AND upper(ecli) = value
    OR class = 'pourvoi' AND replace(number, '.', '') = value OR class = 'free_text_article' AND kind = 'article' AND contains(lower(citation || ' ' || title), 'article ' || value) AND (hint IS NULL OR contains(lower(citation || ' ' || title), hint))
  UNION ALL SELECT cite_id, class, 'metadata_root', NULL, metadata_key, 'legi', lower(root_kind), source_uid, title, valid_from, valid_to, true FROM parsed p JOIN roots r ON
    class = 'legitext' AND root_kind <> 'SECTION_TA' AND source_uid = value OR class = 'legiscta' AND root_kind = 'SECTION_TA' AND source_uid = value OR class = 'nor' AND nor = value),
matches AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cite_id ORDER BY exact DESC, valid_from DESC NULLS LAST, target_type, source_uid, document_id, metadata_key) AS rank FROM found) WHERE rank <= 20)"""
LIVE_SQL = f"(valid_from IS NULL OR valid_from <= DATE '{DAY}') AND (valid_to IS NULL OR valid_to > DATE '{DAY}')"
STATES_SQL = f"""states AS (SELECT p.cite_id, p.cite, p.class, p.value, n AS match_count, v AS valid_match_count, CASE WHEN p.class = 'malformed' OR n = 0 THEN 'not_found' WHEN p.class = 'document_id' THEN CASE WHEN e > 0 THEN 'exact' ELSE 'stale_version' END
  WHEN p.class IN ('free_text_article', 'legiarti', 'legitext', 'legiscta', 'nor') THEN CASE WHEN v = 0 THEN 'stale_version' WHEN v > 1 THEN 'ambiguous' WHEN p.class = 'free_text_article' THEN 'normalized' ELSE 'exact' END
  WHEN n > 1 THEN 'ambiguous' WHEN p.class = 'pourvoi' THEN 'normalized' ELSE 'exact' END AS state FROM parsed p JOIN (SELECT parsed.cite_id, count(m.class) AS n, count(m.class) FILTER (WHERE {LIVE_SQL}) AS v, count(m.class) FILTER (WHERE exact AND {LIVE_SQL}) AS e FROM parsed LEFT JOIN matches m ON m.cite_id = parsed.cite_id GROUP BY parsed.cite_id) g ON g.cite_id = p.cite_id)"""
PARSED, CITED = (CITES_SQL, PARSED_SQL), (LEGAL_SQL, ROOTS_SQL, CITES_SQL, PARSED_SQL, MATCHES_SQL)


def day(n, since: str):
    return F.date_add(F.lit(since).cast("date"), n.cast("int"))


def padded(prefix: str, n) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 12, "0"))


def legal(spark, sf_dir, number: str | None = None) -> DataFrame:
    """The corpus; with a name, also the number that a row was made of."""
    k, article = F.col("doc_id"), F.col("doc_id") % 2 == 0
    starts, ends = day(k % 6000, "2000-01-01"), F.when(k % 3 == 0, day(k % 6000 + k % 2000 + 1, "2000-01-01"))
    uid = F.when(article, padded("LEGIARTI", k - k % 8)).when(k % 4 == 1, padded("JURITEXT", k)).otherwise(padded("CETATEXT", k))
    source = F.when(article, "legi").when(k % 4 == 1, "cass").otherwise("jade")
    case = F.concat((10 + k % 80).cast("string"), F.lit("-"), (10 + k % 90).cast("string"), F.lit("."), (100 + k % 900).cast("string"))
    return read(spark, sf_dir, "documents").select(
        *([k.alias(number)] if number else []), F.when(article, F.concat(F.lit("legi:"), uid, F.lit("@"), starts.cast("string"))).otherwise(F.concat(source, F.lit(":"), uid)).alias("document_id"),
        source.alias("source"), F.when(article, "article").otherwise("decision").alias("kind"), uid.alias("source_uid"), F.when(k % 3 == 0, "Code civil").otherwise("Code du travail").alias("citation"),
        F.concat(F.lit("Article "), (k % 400).cast("string")).alias("title"), starts.alias("valid_from"), ends.alias("valid_to"),
        F.when(~article, F.concat(F.lit("ECLI:FR:CCASS:2021:C"), (100000 + F.floor(k / 12)).cast("string"))).alias("ecli"), F.when(~article, F.array(case)).alias("case_numbers"),
    )


def roots(spark, sf_dir) -> DataFrame:
    k = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ("TEXTE_VERSION", "SECTION_TA", "TEXTELR"))), (k % 3 + 1).cast("int"))
    sixth = F.floor(k / 6)
    r = read(spark, sf_dir, "pages").select("*", kind.alias("root_kind"))
    return r.select(F.concat_ws(":", "root_kind", k.cast("string")).alias("metadata_key"), "root_kind", F.when(F.col("root_kind") == "SECTION_TA", padded("LEGISCTA", sixth)).otherwise(padded("LEGITEXT", sixth)).alias("source_uid"), F.col("url").alias("title"), F.when(F.col("root_kind") == "TEXTELR", F.concat(F.lit("JUSX"), F.lpad(sixth.cast("string"), 7, "0"), F.lit("L"))).alias("nor"), day(k % 4000, "2001-01-01").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))


def citations(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    s = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    text = F.floor(k / 96)
    forms = [
        s("legi:", padded("LEGIARTI", k - k % 8), "@", day(k % 6000, "2000-01-01")), s(" cass:", padded("JURITEXT", k)), s("voir ", padded("legiarti", k - k % 8), " et suivants"), padded("CETATEXT", k),
        s("l'article ", k % 400, " du Code civil"), s("ecli:fr:ccass:2021:c", 100000 + F.floor(k / 12)), s("Article L. ", k % 50, "-1 du Code pénal"), s(10 + k % 80, "-", 10 + k % 90, ".", 100 + k % 900),
        F.lit("legi:LEGIARTI999999999999@2001-01-01"), F.lit("rien d'utile ici"), padded("LEGITEXT", text), s("jade:", padded("CETATEXT", k)), padded("LEGISCTA", text), F.lit(" "),
        s("jusx ", F.lpad(text.cast("string"), 7, "0"), " l"), s("articles 12 et article ", k % 90, " du code des assurances"),
    ]
    return read(spark, sf_dir, "documents").select(k.alias("cite_id"), F.element_at(F.array(*forms), (k % 16 + 1).cast("int")).alias("cite"))


def looked_up(spark, sf_dir, only: str | None = None) -> DataFrame:
    return C.cite_lookup(citations(spark, sf_dir), legal(spark, sf_dir), roots(spark, sf_dir), only=only)


def judged(spark, sf_dir) -> DataFrame:
    return C.cite_states(citations(spark, sf_dir), looked_up(spark, sf_dir), DAY)


@query("SELECT cite_id, class, value FROM parsed", *PARSED)
def parse_citation(spark, sf_dir):
    return C.parsed(citations(spark, sf_dir)).select("cite_id", "class", "value")


@query("SELECT cite_id, hint FROM parsed", *PARSED)
def code_hint(spark, sf_dir):
    return C.parsed(citations(spark, sf_dir)).select("cite_id", "hint")


@query("SELECT cite_id, u AS uid FROM parsed", *PARSED)
def uid_extraction(spark, sf_dir):
    return C.parsed(citations(spark, sf_dir)).select("cite_id", "uid")


@query("SELECT cite_id, rank, exact, target_type, document_id, metadata_key, source, kind, source_uid, title FROM matches", *CITED)
def cite_lookup(spark, sf_dir):
    """All nine lookups of a batch of citations at once."""
    return looked_up(spark, sf_dir).drop("valid_from", "valid_to")


@query("SELECT cite_id, rank, document_id, title FROM matches WHERE class = 'free_text_article'", *CITED)
def cite_freetext(spark, sf_dir):
    """Substring match: article 33 also finds 330."""
    return looked_up(spark, sf_dir, "free_text_article").select("cite_id", "rank", "document_id", "title")


@query("SELECT cite_id, class, match_count, valid_match_count, state FROM states", *CITED, STATES_SQL)
def cite_state(spark, sf_dir):
    return judged(spark, sf_dir).drop("cite", "value")


@query("SELECT cite_id, state, 'no_results: strict citation verification failed for `' || cite || '` with state `' || state || '`' AS error FROM states WHERE state NOT IN ('exact', 'normalized')", *CITED, STATES_SQL)
def cite_strict(spark, sf_dir):
    """What the strict gate refuses, with its error."""
    told = F.concat(F.lit("no_results: strict citation verification failed for `"), F.col("cite"), F.lit("` with state `"), F.col("state"), F.lit("`"))
    return C.strict_failures(judged(spark, sf_dir)).select("cite_id", "state", told.alias("error"))


@query(f"SELECT cite_id, document_id, metadata_key, {LIVE_SQL} AS valid_on_as_of FROM matches", *CITED)
def validity_annotation(spark, sf_dir):
    return looked_up(spark, sf_dir).select("cite_id", "document_id", "metadata_key", asof(DAY).alias("valid_on_as_of"))


@query(f"SELECT document_id, valid_from FROM docs WHERE lower(trim(title)) = 'article 33' AND {LIVE_SQL} ORDER BY valid_from DESC NULLS LAST, document_id LIMIT 10", DOCS_SQL)
def resolve_citation(spark, sf_dir):
    """Exact title, as of a date."""
    return docs(spark, sf_dir).filter((F.lower(F.trim("title")) == "article 33") & asof(DAY)).orderBy(F.desc_nulls_last("valid_from"), "document_id").limit(10).select("document_id", "valid_from")


_FOUND = " UNION ALL ".join(f"SELECT cite_id, '{kind}' AS kind, unnest(regexp_extract_all(cite, '{pattern}')) AS matched FROM cits" for kind, pattern in tables.IDENTIFIERS.items() if kind != "pourvoi")


@query(f"SELECT cite_id, kind, upper(matched) AS value, count(*) AS n FROM ({_FOUND}) GROUP BY ALL", CITES_SQL)
def sql_extract_citations(spark, sf_dir):
    """Identifiers in citations by the table function, some kinds only, counted in SQL."""
    tables.register(spark)
    citations(spark, sf_dir).createOrReplaceTempView("lexforge_citations")
    return spark.sql("SELECT c.cite_id, x.kind, x.value, count(*) AS n FROM lexforge_citations c, LATERAL extract_citations(c.cite, 'article_id,text_id,section_id,decision_id,ecli', true) x WHERE upper(x.matched) = x.value GROUP BY ALL")
