"""Queries of enrichment, identifiers, archives and the search request."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import CHUNKS_SQL, DOCS_SQL, docs, indexed, read
from ..functions import text as T
from ..operators import derive as D
from ..operators import enrich as E
from ..operators import search as S
from ..sources import archives as A
from .registry import query
from .retrieval import BM25_SQL, DAY, DENSE_SQL, cells, query_vector, vectors

#: Decisions over documents: two case numbers each, some of an invalid form.
DEC_SQL = """decs AS (SELECT doc_id AS document_id, 'ECLI:FR:CCASS:2021:C' || (100000 + doc_id) AS ecli, CASE WHEN doc_id % 4 = 0 THEN ['bad'] ELSE ['x', (10 + doc_id % 80) || '-' || (10 + doc_id % 90) || '.' || (100 + doc_id % 900)] END AS nums FROM documents)"""


def decisions(spark, sf_dir):
    k = F.col("doc_id")
    num = F.concat((10 + k % 80).cast("string"), F.lit("-"), (10 + k % 90).cast("string"), F.lit("."), (100 + k % 900).cast("string"))
    return read(spark, sf_dir, "documents").select(k.alias("document_id"), F.concat(F.lit("ECLI:FR:CCASS:2021:C"), (100000 + k).cast("string")).alias("ecli"), F.when(k % 4 == 0, F.array(F.lit("bad"))).otherwise(F.array(F.lit("x"), num)).alias("nums"))


@query("SELECT document_id, array_to_string(list_transform(nums, lambda x: replace(replace(x, '.', ''), ' ', '')), ',') AS numbers FROM decs", DEC_SQL)
def normalized_case_numbers(spark, sf_dir):
    return decisions(spark, sf_dir).select("document_id", F.array_join(E.normalized_case_numbers(F.col("nums")), ",").alias("numbers"))


@query("SELECT document_id FROM decs WHERE len(list_filter(nums, lambda x: regexp_matches(replace(x, '.', ''), '^[0-9]{2}-[0-9]{4,6}$'))) > 0", DEC_SQL)
def parser_valid_pourvoi(spark, sf_dir):
    return decisions(spark, sf_dir).filter(E.has_valid_case_number(E.normalized_case_numbers(F.col("nums")))).select("document_id")


@query("SELECT document_id, ecli, list_filter(list_transform(nums, lambda x: replace(x, '.', '')), lambda x: regexp_matches(x, '^[0-9]{2}-[0-9]{4,6}$'))[1] AS case_number FROM decs", DEC_SQL)
def decision_meta(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return E.decision_meta(d.select("document_id", "ecli", E.normalized_case_numbers(F.col("nums")).alias("case_numbers")))


@query("SELECT document_id, ecli FROM decs WHERE regexp_matches(ecli, '^ECLI:FR:CCASS:2021:C1000[0-9]{2}$')", DEC_SQL)
def ecli_filter(spark, sf_dir):
    return decisions(spark, sf_dir).filter(F.col("ecli").rlike(r"^ECLI:FR:CCASS:2021:C1000[0-9]{2}$")).select("document_id", "ecli")


@query("SELECT document_id FROM (SELECT document_id, 'CETATEXT' || lpad(CAST(document_id AS VARCHAR), CASE WHEN document_id % 4 = 0 THEN 12 ELSE 11 END, '0') AS u FROM decs) WHERE regexp_matches(u, '^CETATEXT[0-9]{12}$')", DEC_SQL)
def cetatext_filter(spark, sf_dir):
    u = F.concat(F.lit("CETATEXT"), F.when(F.col("document_id") % 4 == 0, F.lpad(F.col("document_id").cast("string"), 12, "0")).otherwise(F.lpad(F.col("document_id").cast("string"), 11, "0")))
    return decisions(spark, sf_dir).filter(u.rlike("^CETATEXT[0-9]{12}$")).select("document_id")


@query("SELECT document_id, ecli AS query FROM decs ORDER BY document_id LIMIT 30", DEC_SQL)
def gold_ecli(spark, sf_dir):
    return decisions(spark, sf_dir).select("document_id", F.col("ecli").alias("query")).orderBy("document_id").limit(30)


@query("SELECT n AS query, min(document_id) AS document_id FROM (SELECT document_id, replace(nums[2], '.', '') AS n FROM decs WHERE len(nums) > 1) GROUP BY n ORDER BY document_id LIMIT 30", DEC_SQL)
def gold_pourvoi(spark, sf_dir):
    d = decisions(spark, sf_dir).filter(F.size("nums") > 1).select("document_id", F.translate(F.get("nums", F.lit(1)), ".", "").alias("query"))
    return d.groupBy("query").agg(F.min("document_id").alias("document_id")).orderBy("document_id").limit(30)


#: Visas by their form: a title, a link, no article, another connector, no number.
VISA_SQL = """visas AS (SELECT doc_id AS document_id, CASE doc_id % 5 WHEN 0 THEN 'L.' || (doc_id % 90 + 1) WHEN 1 THEN '609' WHEN 3 THEN '12' END AS article, CASE doc_id % 5 WHEN 0 THEN 'code civil' WHEN 1 THEN 'code de procédure civile' WHEN 3 THEN 'code du travail' END AS code, CASE doc_id % 5 WHEN 1 THEN 'legifrance_url_query' ELSE 'visa_title_regex' END AS method FROM documents WHERE doc_id % 5 NOT IN (2, 4))"""


def visa(k) -> F.Column:
    return F.element_at(
        F.array(F.concat(F.lit("<b>Article L. "), (k % 90 + 1).cast("string"), F.lit("</b> du Code  civil.")), F.lit('<a HREF="https://www.legifrance.gouv.fr/x?a=1&amp;query=609%20code%20de%20proc%C3%A9dure%20civile">Article 610 du code pénal</a>'), F.lit("Loi n° 12"), F.lit("article 12 des Code du travail ,"), F.lit("code civil")),
        (k % 5 + 1).cast("int"),
    )


@query("SELECT document_id, article, code, method FROM visas", VISA_SQL)
def parse_visa(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), T.settled(E.parse_visa(visa(F.col("doc_id")))).alias("p"))
    return d.filter("p is not null").select("document_id", "p.*")


def occurrences(spark, sf_dir):
    """Two responses a decision; the newest one with visas counts."""
    k, one = F.col("doc_id"), lambda t: F.array(F.struct(t.alias("title")))
    d = read(spark, sf_dir, "documents")
    old = d.select((k * 2).alias("response_id"), k.alias("document_id"), one(F.when(k % 7 == 0, visa(k)).otherwise(F.lit("Article 500 du code pénal"))).alias("visas"))
    new = d.select((k * 2 + 1).alias("response_id"), k.alias("document_id"), F.when(k % 7 == 0, F.filter(one(visa(k)), lambda x: F.lit(False))).otherwise(F.array(F.struct(visa(k).alias("title")), F.struct(F.lit("Article 1 du code rural").alias("title")))).alias("visas"))
    return E.collect_citations(old.unionByName(new))


OCC_SQL = VISA_SQL + ", occ AS (SELECT document_id, article, code FROM visas UNION ALL SELECT doc_id, '1', 'code rural' FROM documents WHERE doc_id % 7 <> 0), keyed AS (SELECT *, 'legi-cite:' || sha256('legi-citation:v1' || chr(0) || article || chr(0) || code) AS citation_key FROM occ)"


@query("SELECT article, code, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM occ GROUP BY article, code", OCC_SQL)
def collect_citations(spark, sf_dir):
    return occurrences(spark, sf_dir).groupBy("article", "code").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"))


@query("SELECT article, code, CASE WHEN code = 'code rural' THEN 'resolved' ELSE 'pending' END AS status, count(*) AS occurrence_count FROM occ GROUP BY article, code UNION ALL SELECT 'gone', 'gone', 'resolved', 0", OCC_SQL)
def pend_citations(spark, sf_dir):
    """New keys are pending, known ones keep their state, and counts are those of all occurrences, old ones too."""
    occ = occurrences(spark, sf_dir)
    table = E.insert_occurrences(occ.filter("document_id % 2 = 0"), occ)
    known = spark.createDataFrame([("core", "1", "code rural"), ("core", "gone", "gone"), ("other", "1", "code rural")], "corpus string, article string, code string")
    known = known.select("corpus", E.citation_key(F.col("article"), F.col("code")).alias("citation_key"), F.lit("resolved").alias("status"), F.lit(7).cast("bigint").alias("occurrence_count"))
    names = occ.select("citation_key", "article", "code").distinct()
    out = E.pend_citations(known, table, "core").filter("corpus = 'core'").join(names, "citation_key", "left")
    return out.select(F.coalesce("article", F.lit("gone")).alias("article"), F.coalesce("code", F.lit("gone")).alias("code"), "status", "occurrence_count")


@query("SELECT 'core' AS corpus, doc_id AS citation_key, CASE WHEN doc_id % 3 = 0 THEN 'resolved' WHEN doc_id % 3 = 1 THEN 'error' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'f2' END AS fingerprint, CASE WHEN doc_id % 3 = 1 THEN 'timeout' END AS error FROM documents")
def update_resolution(spark, sf_dir):
    k, none = F.col("citation_key"), F.lit(None).cast("string")
    d = read(spark, sf_dir, "documents").select(F.lit("core").alias("corpus"), F.col("doc_id").alias("citation_key"))
    row = lambda x, status, n, fp, error: x.select("corpus", "citation_key", F.lit(status).alias("status"), F.lit(n).cast("bigint").alias("response_id"), fp.alias("fingerprint"), error.alias("error"))
    table = row(d, "pending", 0, none, none)
    out = row(d.filter(k % 3 < 2), "error", 1, none, F.lit("timeout")).unionByName(row(d.filter(k % 3 == 0), "resolved", 2, F.lit("f2"), none))
    return E.update_resolution(table, out).drop("response_id")


@query("""WITH w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem WHERE l_orderkey = o_orderkey) WHEN o_orderkey % 5 = 0 THEN DATE '1900-01-01' END AS day FROM orders)
  SELECT o_orderkey AS document_id, l_partkey AS result_id FROM w JOIN lineitem ON l_orderkey = o_orderkey AND (day IS NULL OR day = CAST(l_shipdate AS DATE)) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) = 1""")
def find_match(spark, sf_dir):
    """Half of the wanted decisions have a day, that of their last result; some a day that none has."""
    number = lambda c: F.concat(F.lit("n. "), F.col(c).cast("string"))
    lines = read(spark, sf_dir, "lineitem")
    last, k = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last")), F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    wanted = orders.join(last, k == F.col("l_orderkey"), "left").select(k.alias("document_id"), number("o_orderkey").alias("number"), F.when(k % 2 == 0, F.col("last")).when(k % 5 == 0, F.lit("1900-01-01").cast("date")).alias("day"))
    results = lines.select(F.col("l_partkey").alias("result_id"), F.col("l_linenumber").alias("position"), number("l_orderkey").alias("number"), F.col("l_shipdate").cast("date").alias("day"))
    return E.find_match(wanted, results)


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'LEGIARTI' || lpad(CAST(page_id AS VARCHAR), 12, '0') ELSE href END AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages)")
def publisher_edges(spark, sf_dir):
    """The id of a link goes before its address, and a publisher id in either stands for it."""
    k, none = F.col("page_id"), F.lit(None).cast("string")
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), lambda h: F.struct(F.when(k % 2 == 0, F.concat(F.lit("see legiarti"), F.lpad(k.cast("string"), 12, "0"))).otherwise(F.lit(" ")).alias("id"), none.alias("cid"), none.alias("cidtexte"), h.alias("href"), F.lit("").alias("text")))
    return E.publisher_edges(read(spark, sf_dir, "pages").select(k.alias("document_id"), links.alias("links"))).select(F.col("document_id").alias("page_id"), "target")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A > B' WHEN 1 THEN 'A > C' WHEN 2 THEN 'Livre II > Titre II' ELSE 'X > Y' END AS path FROM documents")
def toc_stack(spark, sf_dir):
    """A repeat of the top, a sibling, a gap in the levels that is cut off, a start below the first level."""
    lists = [(("A", 1), ("A", 2), ("B", 2)), (("A", 1), ("B", 2), ("C", 2)), (("Livre I", 1), ("Section gap", 3), ("Livre II", 1), ("Titre II", 2)), (("X", 3), ("Y", 2))]
    made = F.array(*(F.array(*(F.struct(F.lit(t).alias("title"), F.lit(n).alias("level")) for t, n in x)) for x in lists))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" > ", D.toc_stack(F.element_at(made, (F.col("doc_id") % 4 + 1).cast("int")))).alias("path"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/b/a/b/c' WHEN 1 THEN 'a/b/a/b/x' WHEN 2 THEN 'a/b/a/b' ELSE 'a/b/a/b/b' END AS path FROM documents")
def overlap_merge(spark, sf_dir):
    """The longest overlap counts: of two, of none, of all, of one (b ends, b starts)."""
    second = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in ("abc", "x", "abab", "bb"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", D.overlap_merge(F.array(*map(F.lit, "abab")), second)).alias("path"))


NAMES_SQL = """names AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'LEGI_2024' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '01-000000.tar.gz' WHEN 1 THEN 'Freemium_legi_global_2024' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '15-000000.tar.gz' ELSE 'CASS_20240101-000000.tar.gz' END AS name FROM documents),
parsed AS (SELECT DISTINCT name, CASE WHEN starts_with(name, 'LEGI') THEN 'delta' WHEN starts_with(name, 'Free') THEN 'baseline' END AS kind, regexp_extract(name, '([0-9]{8})-([0-9]{6})', 1) || regexp_extract(name, '([0-9]{8})-([0-9]{6})', 2) AS st FROM names)"""


def names(spark, sf_dir):
    k = F.col("doc_id")
    month = F.lpad((k % 12 + 1).cast("string"), 2, "0")
    name = F.when(k % 3 == 0, F.concat(F.lit("LEGI_2024"), month, F.lit("01-000000.tar.gz"))).when(k % 3 == 1, F.concat(F.lit("Freemium_legi_global_2024"), month, F.lit("15-000000.tar.gz"))).otherwise(F.lit("CASS_20240101-000000.tar.gz"))
    return read(spark, sf_dir, "documents").select(name.alias("name")).distinct()


@query("SELECT name, kind, CASE WHEN kind IS NOT NULL THEN st END AS stamp FROM parsed", NAMES_SQL)
def src_archive_name(spark, sf_dir):
    return names(spark, sf_dir).select("name", A.parse_name(F.col("name"), "legi").alias("p")).select("name", "p.kind", "p.stamp")


@query("SELECT name, CASE WHEN kind IS NULL THEN 'unrecognized_filename' WHEN kind = 'baseline' AND st < m THEN 'older_baseline' WHEN kind = 'baseline' THEN 'baseline' WHEN st > m THEN 'delta' ELSE 'delta_not_after_selected_baseline' END AS action FROM parsed, (SELECT max(st) FILTER (WHERE kind = 'baseline') AS m FROM parsed)", NAMES_SQL)
def plan_archives(spark, sf_dir):
    return A.plan_archives(names(spark, sf_dir), "legi").select("name", "action")


@query("SELECT name FROM parsed, (SELECT max(st) FILTER (WHERE kind = 'baseline') AS m FROM parsed) WHERE kind = 'delta' AND st > m OR kind = 'baseline' AND st = m", NAMES_SQL)
def select_archives(spark, sf_dir):
    return A.select_archives(A.plan_archives(names(spark, sf_dir), "legi")).select("name")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) END AS day FROM documents")
def valid_dates(spark, sf_dir):
    k = F.col("doc_id")
    text = F.when(k % 10 == 0, F.lit("2023-02-29")).when(k % 10 == 1, F.lit("2999-01-01")).otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", T.valid_date(text).alias("day"))


SEARCH_TERMS = BM25_SQL.replace("IN ('the', 'mit', 'license', 'de', 'er')", "IN ('the', 'mit', 'license')").replace("QUALIFY rank <= 50", "QUALIFY rank <= 20")
SEARCH_DENSE = DENSE_SQL.replace("LIMIT 200", "LIMIT 80").replace("QUALIFY rank <= 50", "QUALIFY rank <= 20")


@query("""WITH firsts AS (SELECT document_id, min(chunk_id) AS chunk_id FROM chunks GROUP BY document_id), arms AS (SELECT chunk_id, document_id, rank AS l, NULL AS d FROM lex UNION ALL SELECT chunk_id, document_id, NULL, rank FROM den JOIN firsts USING (document_id)),
  s AS (SELECT chunk_id, document_id, round(coalesce(1.0::DOUBLE / (60 + min(l)), 0) + coalesce(0.3::DOUBLE / (60 + min(d)), 0), 8) AS score FROM arms GROUP BY chunk_id, document_id)
  SELECT row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS position, chunk_id, document_id, score FROM s ORDER BY score DESC, chunk_id LIMIT 10""", DOCS_SQL, CHUNKS_SQL, SEARCH_TERMS, SEARCH_DENSE)  # fmt: skip
def search(spark, sf_dir):
    """The whole request, paged twice; the second page starts at the first one's cursor. The dense arm reads
    stored cells: all of them here, so that the result is the exact one."""
    d, c, (path, m) = docs(spark, sf_dir), indexed(spark, sf_dir), cells(spark, sf_dir)
    ask = lambda cursor: S.search(S.Request("the mit license", DAY, top_k=5, cursor=cursor, embedding=query_vector(spark, sf_dir), fingerprint="fp", probes=m["lists"]), d, c, path, "fp")
    first = ask(None)
    rows = first.rows + (ask(first.next_cursor).rows if first.next_cursor else [])
    return spark.createDataFrame([(i, r["chunk_id"], r["document_id"], r["score"]) for i, r in enumerate(rows)], "position long, chunk_id string, document_id long, score double")


@query()
def search_probed(spark, sf_dir):
    """The request as users send it: the manifest's probes; tests hold its page against the exact one."""
    d, c, (path, _) = docs(spark, sf_dir), indexed(spark, sf_dir), cells(spark, sf_dir)
    out = S.search(S.Request("the mit license", DAY, top_k=10, embedding=query_vector(spark, sf_dir), fingerprint="fp"), d, c, path, "fp")
    return spark.createDataFrame([(i, r["chunk_id"], r["document_id"], r["score"]) for i, r in enumerate(out.rows)], "position long, chunk_id string, document_id long, score double")


@query(f"SELECT document_id, 'structured' AS route FROM docs WHERE lower(trim(title)) = 'article 34' AND (valid_from IS NULL OR valid_from <= DATE '{DAY}') AND (valid_to IS NULL OR valid_to > DATE '{DAY}') ORDER BY valid_from DESC NULLS LAST, document_id LIMIT 10", DOCS_SQL)
def search_citation(spark, sf_dir):
    d, v = docs(spark, sf_dir), vectors(spark, sf_dir)
    out = S.search(S.Request("code civil article 34", DAY, embedding=[0.0] * 64, fingerprint="fp"), d, lambda: indexed(spark, sf_dir), v, "fp")
    return spark.createDataFrame([(r["document_id"], out.routing["route"]) for r in out.rows], "document_id long, route string")


@query("""WITH l AS (SELECT chunk_id, document_id, lang AS corpus, row_number() OVER (PARTITION BY lang ORDER BY round(1.0::DOUBLE / (60 + rank), 8) DESC, chunk_id) AS n FROM (SELECT b.chunk_id, b.document_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, chunk_id) AS rank FROM bm b JOIN docs d ON d.document_id = b.document_id WHERE d.document_id IN (SELECT document_id FROM live) AND lang IN ('en', 'de') AND kind = 'decision'))
  SELECT row_number() OVER (ORDER BY round(1.0::DOUBLE / (60 + n), 8) DESC, corpus, chunk_id) - 1 AS position, corpus, chunk_id, document_id, round(1.0::DOUBLE / (60 + n), 8) AS score FROM l ORDER BY score DESC, corpus, chunk_id LIMIT 12""", DOCS_SQL, CHUNKS_SQL, SEARCH_TERMS)  # fmt: skip
def search_fanout(spark, sf_dir):
    """Two corpora apart, decisions only, three pages of four by the cursor."""
    d, c, v = docs(spark, sf_dir), indexed(spark, sf_dir), vectors(spark, sf_dir)
    rows, cursor = [], None
    for _ in range(3):
        out = S.search(S.Request("the mit license", DAY, mode="bm25", top_k=4, cursor=cursor, kind="decision", corpora=("en", "de")), d, c, v)
        rows += out.rows
        cursor = out.next_cursor
        if cursor is None:
            break
    return spark.createDataFrame([(i, r["corpus"], r["chunk_id"], r["document_id"], r["score"]) for i, r in enumerate(rows)], "position long, corpus string, chunk_id string, document_id long, score double")


EXPAND_SQL = """asked AS (SELECT doc_id, ['Responsabilité du fait des choses', 'un délai : action', 'rien', 'contrat; dommages-intérêts et force obligatoire'][1 + doc_id % 4] AS q FROM documents),
  given AS (SELECT * FROM (VALUES (0, 'civil-liability-fault-damage', ['responsabilite civile', 'fait quelconque', 'faute', 'dommage', 'prejudice', 'reparation du dommage', 'article 1240', 'article 1241']), (1, 'civil-prescription', ['prescription extinctive', 'delai de prescription', 'action personnelle', 'action mobiliere', 'article 2219', 'article 2224']),
  (3, 'contract-non-performance-damages', ['obligation contractuelle', 'inexecution du contrat', 'dommages et interets', 'article 1103', 'article 1231-1'])) t(r, seed, terms))"""


@query("SELECT doc_id, seed, unnest(terms) AS term FROM asked JOIN given ON r = doc_id % 4", EXPAND_SQL)
def expand(spark, sf_dir):
    q = F.element_at(F.array(F.lit("Responsabilité du fait des choses"), F.lit("un délai : action"), F.lit("rien"), F.lit("contrat; dommages-intérêts et force obligatoire")), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(D.expand(q)).alias("x")).select("doc_id", "x.*")


ROUTE_SQL = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'L121-3' WHEN 1 THEN '9' WHEN 2 THEN '7' END AS number, CASE doc_id % 5 WHEN 1 THEN '2010-05-06' WHEN 0 THEN '2008-06-01' WHEN 2 THEN '2008-06-01' END AS as_of, CASE doc_id % 5 WHEN 0 THEN 'code du travail' WHEN 2 THEN 'voir article 5 et' END AS hint FROM documents"""


@query(ROUTE_SQL)
def citation_intent(spark, sf_dir):
    """The router's reading of queries: the last article named, its date, what stands before as a hint."""
    forms = ["code du travail article L. 121-3", "article 9 en vigueur au 2010-05-06", "voir article 5 et article 7", "sans numéro : article", "rien"]
    found = [S.citation_intent(f, DAY) or {} for f in forms]
    table = spark.createDataFrame([(i, x.get("number"), x.get("as_of"), x.get("hint")) for i, x in enumerate(found)], "r long, number string, as_of string, hint string")
    return read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("r")).join(F.broadcast(table), "r").drop("r")
