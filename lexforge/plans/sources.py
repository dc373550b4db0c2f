"""Queries of sources and sinks: listings, archives, XML, JSON lines, upserts, exports."""

from __future__ import annotations

import io
import tarfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from .. import storage
from ..adapters import CHUNKS_SQL, DOCS_SQL, EDGES_SQL, chunks, docs, edges, read
from ..operators.segments import Delta, Store, Table
from ..sources import archives as A
from ..sources import xml as X
from .cite import LEGAL_SQL, ROOTS_SQL, legal, roots
from .registry import query

#: An index page over pages: an archive of the source or of another, and links that are no files.
LISTING_SQL = """listing AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'LEGI_20240' || (1 + page_id % 9) || '01-000000.tar.gz' WHEN page_id % 3 = 1 THEN 'Freemium_legi_global_20240' || (1 + page_id % 9) || '15-000000.tar.gz' ELSE 'CASS_20240101-000000.tar.gz' END AS name,
  CASE WHEN page_id % 4 <> 0 THEN '2024-01-' || (10 + page_id % 19) || ' 07:15' END AS date, CASE WHEN page_id % 4 IN (1, 2) THEN (page_id % 90) || 'M' END AS size, 'read me ' || (page_id % 7) || '.txt' AS other FROM pages)"""


def listing(spark, sf_dir):
    k = F.col("page_id")
    s = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    name = F.when(k % 3 == 0, s("LEGI_20240", 1 + k % 9, "01-000000.tar.gz")).when(k % 3 == 1, s("Freemium_legi_global_20240", 1 + k % 9, "15-000000.tar.gz")).otherwise(F.lit("CASS_20240101-000000.tar.gz"))
    tail = F.when(k % 4 == 0, F.lit("")).otherwise(s("  2024-01-", 10 + k % 19, " 07:15  ", F.when(k % 4 == 3, F.lit("-")).otherwise(s(k % 90, "M"))))
    row = s('<a href="?C=N;O=D">Name</a> <a href="../">up</a> <a href="/abs/x.txt">x</a> <a href="sub/">sub</a> <a href="https://h.example/y.txt">y</a>\n<A class="f" HREF=\'./', name, "'>", name, "</a>", tail, '\n<a href="read%20me%20', k % 7, '.txt">r</a> 2024')
    return read(spark, sf_dir, "pages").select("page_id", row.alias("html"))


@query("SELECT page_id, name, date, size FROM listing UNION ALL SELECT page_id, other, NULL, NULL FROM listing", LISTING_SQL)
def src_apache_listing(spark, sf_dir):
    return listing(spark, sf_dir).select("page_id", F.explode(A.parse_listing(F.col("html"))).alias("x")).select("page_id", "x.*")


@query("SELECT page_id, name, CASE WHEN page_id % 3 = 0 THEN 'delta' ELSE 'baseline' END AS kind, regexp_extract(name, '([0-9]{8})', 1) || '000000' AS stamp FROM listing WHERE page_id % 3 <> 2", LISTING_SQL)
def source_listing(spark, sf_dir):
    return listing(spark, sf_dir).select("page_id", F.explode(A.source_listing(F.col("html"), "legi")).alias("x")).select("page_id", "x.name", "x.kind", "x.stamp")


@query("SELECT DISTINCT name FROM listing WHERE name NOT IN (SELECT name FROM listing WHERE page_id % 9 < 4)", LISTING_SQL)
def fetch_plan(spark, sf_dir):
    """What is listed but not in the kept cursor."""
    every = listing(spark, sf_dir).select("page_id", F.explode(A.parse_listing(F.col("html"))).alias("x")).filter("x.name like '%.tar.gz'").select("page_id", "x.name")
    path = storage.place(spark, "fetched", sf_dir, uuid.uuid4().hex)
    every.filter("page_id % 9 < 4").select("name").distinct().write.mode("overwrite").parquet(path)
    return A.fetch_plan(every, spark.read.parquet(path))


def packed(spark, sf_dir, broken: int | None = None):
    """Pages in archives: path, content; one archive may be cut in the middle."""

    def run(pdf):
        data = io.BytesIO()
        with tarfile.open(fileobj=data, mode="w:gz") as tar:
            for k, html in zip(pdf.page_id, pdf.html, strict=True):
                body = html.encode()
                info = tarfile.TarInfo(f"pages/{k}.xml")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                info = tarfile.TarInfo(f"pages/{k}.txt")
                tar.addfile(info)
        n = int(pdf.page_id.iloc[0]) % 8
        content = data.getvalue()
        return pd.DataFrame({"path": [f"LEGI_2024010{n + 1}-000000.tar.gz"], "content": [content[: len(content) // 2] if n == broken else content]})

    return read(spark, sf_dir, "pages").select("page_id", "html").groupBy(F.col("page_id") % 8).applyInPandas(run, "path string, content binary")


@query("SELECT 'LEGI_2024010' || (page_id % 8 + 1) || '-000000.tar.gz' AS archive, 'pages/' || page_id || '.xml' AS member, CAST(strlen(html) AS BIGINT) AS size, 'sha256:' || sha256(html) AS sha256 FROM pages")
def src_targz(spark, sf_dir):
    return A.members_of(packed(spark, sf_dir)).select("archive", "member", "size", "sha256")


@query("SELECT 'LEGI_2024010' || (page_id % 8 + 1) || '-000000.tar.gz' AS archive, page_id % 8 <> 3 AS ok, CASE WHEN page_id % 8 <> 3 THEN count(*) END AS n_members FROM pages GROUP BY page_id % 8")
def verify_targz(spark, sf_dir):
    """The broken archive is told apart; how much of it can be read doesn't count."""
    return A.verify_archives(A.members_of(packed(spark, sf_dir, broken=3))).select("archive", "ok", F.when(F.col("ok"), F.col("n_members")).alias("n_members"))


CLEAN_SQL = "x AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS n, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS clean FROM documents), y AS (SELECT *, CASE WHEN clean = '' THEN 'fin' ELSE clean || chr(10) || 'fin' END AS body FROM x)"


def element(tag: str, *inner) -> F.Column:
    return F.concat(F.lit(f"<{tag}>"), *(F.lit(x) if isinstance(x, str) else x for x in inner), F.lit(f"</{tag.split()[0]}>"))


def xml_members(spark, sf_dir, make):
    k = F.col("doc_id")
    n = F.lpad(k.cast("string"), 12, "0")
    clean = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    body = element("BLOC_TEXTUEL", element("CONTENU", element("p", F.lit("  "), clean), element("p", "fin"), "<br/>"))
    return read(spark, sf_dir, "documents").select(k.cast("string").alias("member"), make(k, n, body).cast("binary").alias("xml"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS member, 'article' AS root_kind, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'legi:LEGIARTI' || n || '@2001-02-28' END AS document_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'Code civil Article ' || (doc_id % 90) END AS citation, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN md5(body) END AS body,
  CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 2 = 0 THEN '2020-01-01' END AS valid_to, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'Code civil > Livre ' || (doc_id % 5) END AS path, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'LEGIARTI000000000007' END AS target,
  CASE WHEN doc_id % 11 = 0 THEN 'invalid id: LEGIARTI12' WHEN doc_id % 13 = 0 THEN 'invalid date META_ARTICLE/DATE_DEBUT: 2001-02-30' END AS error FROM y""", CLEAN_SQL)  # fmt: skip
def xml_article(spark, sf_dir):
    def make(k, n, body):
        uid = F.when(k % 11 == 0, F.lit("LEGIARTI12")).otherwise(F.concat(F.lit("LEGIARTI"), n))
        start = F.when((k % 13 == 0) & (k % 11 != 0), "2001-02-30").otherwise("2001-02-28")
        return element("ARTICLE", element("META", element("META_COMMUN", element("ID", uid), element("NATURE", "Article")), element("META_ARTICLE", element("NUM", (k % 90).cast("string")), element("DATE_DEBUT", start), element("DATE_FIN", F.when(k % 2 == 0, "2020-01-01").otherwise("2999-01-01")))), element("CONTEXTE", element("TEXTE cid='LEGITEXT000000000001'", element("TITRE_TXT", "Code civil"), element("TM", element("TITRE_TM", F.lit("Livre "), (k % 5).cast("string"))))), body, element("LIENS", element("LIEN cidtexte='x' id='see LEGIARTI000000000007'", "art. 7")))

    r = X.parse_members(xml_members(spark, sf_dir, make), "legi")
    return r.select("member", "root_kind", "document_id", "citation", F.md5("body").alias("body"), "valid_to", F.when(F.col("hierarchy_path").isNotNull(), F.array_join("hierarchy_path", " > ")).alias("path"), F.get("links", F.lit(0))["target"].alias("target"), "error")


@query("SELECT CAST(doc_id AS VARCHAR) AS member, 'LEGISCTA' || n AS source_uid, 'Section ' || (doc_id % 9) AS title, 'LEGITEXT000000000002' AS parent_uid, '1999-01-01' AS valid_from, CASE WHEN doc_id % 2 = 0 THEN '2010-10-10' END AS valid_to, 'Code > Titre' AS path FROM y", CLEAN_SQL)
def xml_section(spark, sf_dir):
    make = lambda k, n, body: element("SECTION_TA", element("ID", F.lit("LEGISCTA"), n), element("TITRE_TA", F.lit("Section "), (k % 9).cast("string")), element("CONTEXTE", F.concat(F.lit("<TEXTE cid='LEGITEXT000000000002'><TITRE_TXT debut='1999-01-01' fin='"), F.when(k % 2 == 0, "2010-10-10").otherwise("2999-01-01"), F.lit("'>Code</TITRE_TXT><TM><TITRE_TM>Titre</TITRE_TM></TM></TEXTE>"))))
    r = X.parse_members(xml_members(spark, sf_dir, make), "legi")
    return r.select("member", "source_uid", "title", "parent_uid", "valid_from", "valid_to", F.array_join("hierarchy_path", " > ").alias("path"))


@query("SELECT CAST(doc_id AS VARCHAR) AS member, CASE WHEN doc_id % 6 <> 0 THEN 'LEGITEXT' || n END AS source_uid, CASE WHEN doc_id % 6 <> 0 THEN 'Loi ' || doc_id END AS title, CASE WHEN doc_id % 6 <> 0 THEN 'VIGUEUR' END AS status, CASE WHEN doc_id % 6 <> 0 THEN '2999-01-01' END AS valid_to_raw, CASE WHEN doc_id % 6 = 0 THEN 'missing META_TEXTE_VERSION/ETAT' END AS error FROM y", CLEAN_SQL)
def xml_text_version(spark, sf_dir):
    make = lambda k, n, body: element("TEXTE_VERSION", element("META_COMMUN", element("ID", F.lit("LEGITEXT"), n)), element("META_TEXTE_VERSION", element("TITRE", F.lit("Loi "), k.cast("string")), F.when(k % 6 != 0, "<ETAT>VIGUEUR</ETAT>").otherwise(""), element("DATE_DEBUT", "2000-02-29"), element("DATE_FIN", "2999-01-01")))
    return X.parse_members(xml_members(spark, sf_dir, make), "legi").select("member", "source_uid", "title", "status", "valid_to_raw", "error")


@query("SELECT CAST(doc_id AS VARCHAR) AS member, 'JUSX' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || 'L' AS nor, '1998-01-01' AS valid_from, 'LIEN_SECTION_TA:1:Livre I,LIEN_ART:3:' || doc_id AS links FROM y", CLEAN_SQL)
def xml_textelr(spark, sf_dir):
    make = lambda k, n, body: element("TEXTELR", element("META_COMMUN", element("ID", F.lit("LEGITEXT"), n)), element("META_TEXTE_CHRONICLE", element("NOR", F.lit("JUSX"), F.lpad(k.cast("string"), 7, "0"), F.lit("L"))), element("STRUCT", "<LIEN_SECTION_TA cid='LEGISCTA000000000001' debut='1999-01-01' niv='1'>Livre  I</LIEN_SECTION_TA><LIEN_ART id='LEGIARTI000000000001' debut='1998-01-01' niv='3'>", k.cast("string"), "</LIEN_ART>"))
    r = X.parse_members(xml_members(spark, sf_dir, make), "legi")
    return r.select("member", "nor", "valid_from", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["tag"], x["level"].cast("string"), x["text"])), ",").alias("links"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS member, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'cass:JURITEXT' || n END AS document_id, CASE WHEN doc_id % 5 > 1 THEN md5(body) END AS body, CASE WHEN doc_id % 5 > 1 THEN 'oui' END AS publication, CASE WHEN doc_id % 5 > 1 THEN '12-34.567,98-76.543' END AS numbers, CASE WHEN doc_id % 5 > 1 THEN 'PRINCIPAL=Un sommaire,analyse=Deux' END AS summaries,
  CASE doc_id % 5 WHEN 0 THEN 'root TEXTE_JURI_ADMIN does not belong to source cass' WHEN 1 THEN 'skipped: JURITEXT' || n || ' has an empty body' END AS error FROM y""", CLEAN_SQL)  # fmt: skip
def xml_decision(spark, sf_dir):
    def make(k, n, body):
        inner = F.concat(element("META", element("META_COMMUN", element("ID", F.lit("JURITEXT"), n)), element("META_JURI", element("TITRE", "T"), element("DATE_DEC", "2021-03-04")), "<NUMEROS_AFFAIRES><NUMERO_AFFAIRE>12-34.567</NUMERO_AFFAIRE><NUMERO_AFFAIRE> 98-76.543 </NUMERO_AFFAIRE></NUMEROS_AFFAIRES><PUBLI_BULL publie='oui'/>"), element("TEXTE", F.when(k % 5 == 1, "<BLOC_TEXTUEL><CONTENU> </CONTENU></BLOC_TEXTUEL>").otherwise(body), "<SOMMAIRE><SCT ID='1' TYPE='PRINCIPAL'>Un  sommaire</SCT><ANA>Deux</ANA></SOMMAIRE>"))
        return F.when(k % 5 == 0, element("TEXTE_JURI_ADMIN", inner)).otherwise(element("TEXTE_JURI_JUDI", inner))

    r = X.parse_members(xml_members(spark, sf_dir, make), "cass")
    some = lambda c: F.when(F.col("error").isNull(), c)
    return r.select("member", "document_id", F.md5("body").alias("body"), "publication", some(F.array_join("case_numbers", ",")).alias("numbers"), some(F.array_join(F.transform("summaries", lambda x: F.concat_ws("=", x["kind"], x["text"])), ",")).alias("summaries"), "error")


@query("SELECT doc_id, md5(text) AS text FROM documents")
def src_jsonl_batched(spark, sf_dir):
    """Written as JSON lines with blank ones among them, and read by schema."""
    path = storage.place(spark, "jsonl", sf_dir, uuid.uuid4().hex)
    lines = read(spark, sf_dir, "documents").select(F.explode(F.array(F.to_json(F.struct("doc_id", "text")), F.lit(""))).alias("value"))
    lines.write.mode("overwrite").text(path)
    return A.read_jsonl(spark, path, "doc_id long, text string").filter("doc_id is not null").select("doc_id", F.md5("text").alias("text"))


# --- sinks -------------------------------------------------------------------------------------


def upserted(spark, sf_dir, table, rows, key):
    """A table after a batch, through a store's segments."""
    s = Store(spark, storage.place(spark, "sink", sf_dir, uuid.uuid4().hex))
    s.create({"rows": Table(table, [key])})
    A.upsert(s, "rows", rows, key, "seq")
    return s.read("rows")


_STORES: dict[tuple, Store] = {}


def kept_store(kind: str, build):
    """The store of a kind, filled once a session and input."""

    def of(spark, sf_dir) -> Store:
        at = (spark.sparkContext.applicationId, kind, sf_dir)
        if at not in _STORES:
            s = Store(spark, storage.place(spark, kind, sf_dir, uuid.uuid4().hex))
            build(spark, sf_dir, s)
            _STORES[at] = s
        return _STORES[at]

    return of


def fill(spark, sf_dir, s: Store) -> None:
    """A batch over the documents: a quarter changes (each twice, the older row second), a fiftieth is new."""
    d = docs(spark, sf_dir).select("document_id", "body")
    old = d.withColumn("seq", F.lit(0))
    changed, k = d.filter("document_id % 4 = 1"), F.col("document_id")
    rows = changed.select("document_id", F.concat("body", F.lit("!")).alias("body"), F.lit(2).alias("seq")).unionByName(changed.select("document_id", F.lit("older").alias("body"), F.lit(1).alias("seq")))
    rows = rows.unionByName(d.filter("document_id % 50 = 0").select((k + 100000000).alias("document_id"), F.lit("added").alias("body"), F.lit(2).alias("seq")))
    c = chunks(spark, sf_dir).select("chunk_id", "document_id", "body", F.lit("old").alias("fingerprint"))
    touched = F.col("document_id") % 4 == 1
    new_chunks = c.filter(touched).select("chunk_id", "document_id", F.when(k % 8 == 1, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"), F.when(k % 16 == 13, "new").alias("fingerprint"))
    e = edges(spark, sf_dir).select(F.col("from_id").alias("document_id"), "to_id")
    s.create({"documents": Table(old, ["document_id"]), "chunks": Table(c, ["document_id"]), "edges": Table(e, ["document_id"])})
    A.upsert_documents(s, (rows, new_chunks, e.filter(touched).select("document_id", F.lit(0).cast("bigint").alias("to_id"))))


batch = kept_store("batch", fill)


@query("SELECT document_id, md5(CASE WHEN document_id % 4 = 1 THEN body || '!' ELSE body END) AS body FROM docs UNION ALL SELECT document_id + 100000000, md5('added') FROM docs WHERE document_id % 50 = 0", DOCS_SQL)
def sink_upsert_documents(spark, sf_dir):
    return batch(spark, sf_dir).read("documents").select("document_id", F.md5("body").alias("body"))


@query("SELECT chunk_id, CASE WHEN document_id % 16 = 13 THEN 'new' WHEN document_id % 8 = 1 THEN NULL ELSE 'old' END AS fingerprint FROM chunks", DOCS_SQL, CHUNKS_SQL)
def sink_upsert_chunks(spark, sf_dir):
    """A changed text loses its fingerprint, a new fingerprint wins, others stay."""
    return batch(spark, sf_dir).read("chunks").select("chunk_id", "fingerprint")


@query("""SELECT from_id AS document_id, CASE WHEN from_id % 4 = 1 AND from_id IN (SELECT doc_id FROM documents) THEN 0 ELSE to_id END AS to_id FROM edges WHERE NOT (from_id % 4 = 1 AND from_id NOT IN (SELECT doc_id FROM documents))
  UNION ALL SELECT from_id, to_id FROM edges WHERE from_id % 4 = 1 AND from_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT from_id, 0 FROM edges WHERE from_id % 4 = 1 AND from_id NOT IN (SELECT doc_id FROM documents)""", EDGES_SQL)  # fmt: skip
def sink_upsert_edges(spark, sf_dir):
    """Edges of documents of the batch are replaced; the batch brings edges of others, too."""
    return batch(spark, sf_dir).read("edges")


@query("SELECT document_id, source_uid, CASE WHEN doc_id % 6 = 1 THEN 'Revised ' || doc_id ELSE title END AS title FROM (SELECT *, uid AS source_uid FROM legal) WHERE kind = 'decision'", LEGAL_SQL)
def sink_upsert_decisions(spark, sf_dir):
    d = legal(spark, sf_dir).filter("kind = 'decision'").select("document_id", "source_uid", "title", F.lit(0).alias("seq"))
    n = F.substring("source_uid", 9, 12).cast("bigint")
    rows = d.filter(n % 6 == 1).select("document_id", "source_uid", F.concat(F.lit("Revised "), n.cast("string")).alias("title"), F.lit(1).alias("seq"))
    return upserted(spark, sf_dir, d, rows, "document_id").select("document_id", "source_uid", "title")


@query("SELECT metadata_key, root_kind, CASE WHEN page_id % 4 = 0 THEN 'renamed' ELSE title END AS title FROM roots UNION ALL SELECT 'new:' || page_id, root_kind, title FROM roots WHERE page_id % 10 = 0", ROOTS_SQL)
def sink_upsert_metadata(spark, sf_dir):
    r = roots(spark, sf_dir).select("metadata_key", "root_kind", "title", F.lit(0).alias("seq"))
    k = F.regexp_extract("metadata_key", "([0-9]+)$", 1).cast("bigint")
    rows = r.filter(k % 4 == 0).withColumn("title", F.lit("renamed")).unionByName(r.filter(k % 10 == 0).withColumn("metadata_key", F.concat(F.lit("new:"), k.cast("string")))).withColumn("seq", F.lit(1))
    return upserted(spark, sf_dir, r, rows, "metadata_key").select("metadata_key", "root_kind", "title")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE CAST(label AS BIGINT) END AS label FROM embeddings")
def sink_upsert_embeddings(spark, sf_dir):
    """A guarded batch; tests hold that a missing or conflicting fingerprint fails it."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("label"), F.lit("fp").alias("embedding_fingerprint"), F.lit(0).alias("seq"))
    rows = e.filter("chunk_id % 3 = 0").withColumns({"label": F.lit(99).cast("bigint"), "seq": F.lit(1)})
    s = Store(spark, storage.place(spark, "sink", sf_dir, uuid.uuid4().hex))
    s.create({"rows": Table(e, ["chunk_id"])})
    A.upsert_embeddings(s, "rows", rows, e.select("chunk_id", "embedding_fingerprint"), "seq")
    return s.read("rows").select("chunk_id", "label")


@query("SELECT conv_id AS document_id, turn AS fragment_index, md5(text) AS body FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, 0, md5('whole') FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 6 = 0")
def sink_replace_zone_units(spark, sf_dir):
    """Units of some documents give way to one, those of others to none."""
    u = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("fragment_index"), F.md5("text").alias("body"))
    scopes = u.filter("document_id % 3 = 0").select("document_id").distinct()
    rows = scopes.filter("document_id % 6 = 0").select("document_id", F.lit(0).cast("bigint").alias("fragment_index"), F.md5(F.lit("whole")).alias("body"))
    s = Store(spark, storage.place(spark, "sink", sf_dir, uuid.uuid4().hex))
    s.create({"rows": Table(u, ["document_id"])})
    s.apply({"rows": Delta(rows, scopes)})
    return s.read("rows")


@query("SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM pages")
def sink_api_archive(spark, sf_dir):
    """Append only: what is sent twice stands twice."""
    path = storage.place(spark, "api", sf_dir, uuid.uuid4().hex)
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("response"))
    A.append(p, path)
    A.append(p.filter("page_id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT document_id, title FROM docs WHERE lang = 'fr'", DOCS_SQL)
def sink_baseline_copy(spark, sf_dir):
    path = storage.place(spark, "baseline", sf_dir, uuid.uuid4().hex)
    A.baseline_copy(docs(spark, sf_dir).select("document_id", "title", F.col("lang").alias("corpus"), F.length("body").alias("n")), "document_id", path, "fr", ("n", "corpus"))
    return spark.read.parquet(path)
