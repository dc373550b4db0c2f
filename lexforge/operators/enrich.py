"""Decision metadata and legislation citations: latest responses, visa parsing, resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_name, first_href, plain_text, settled

CASE_NUMBER = r"^[0-9]{2}-[0-9]{4,6}$"


def normalized_case_numbers(numbers: Column) -> Column:
    """Without dots and spaces."""
    return F.transform(numbers, lambda c: F.translate(c, ". ", ""))


def has_valid_case_number(numbers: Column) -> Column:
    return F.exists(numbers, lambda c: c.rlike(CASE_NUMBER))


def decision_meta(decisions: DataFrame) -> DataFrame:
    """document_id, ecli, the first case number of a valid form, in order."""
    ok = F.filter("case_numbers", lambda c: c.rlike(CASE_NUMBER))
    return decisions.select("document_id", "ecli", F.try_element_at(ok, F.lit(1)).alias("case_number"))


def parse_visa(title: Column) -> Column:
    """struct<article, code, method> of a visa's HTML title, null for what isn't an article of a code. The
    `query` parameter of its Légifrance link counts first, else its text; either is cut at `code`, a
    leading label and a trailing connector go."""

    def cut(text: Column, method: str) -> Column:
        t = F.trim(text)
        part = lambda k: F.regexp_extract(t, "(?is)^(.+?)(code.*)$", k)
        article = F.trim(F.regexp_replace(F.regexp_replace(F.trim(part(1)), "[, ]+$", ""), "^(?:Article|article)", ""))
        article = F.trim(F.regexp_replace(article, "(?i) (?:de la|de l'|des|du|de)$", ""))
        code = F.regexp_replace(F.trim(part(2)), "[., ]+$", "")
        article, code = F.upper(F.regexp_replace(article, r"\s+", "")), code_name(code)
        return F.when(~t.rlike("(?i)^code") & (article != "") & (F.length(code) >= 4), F.struct(article.alias("article"), code.alias("code"), F.lit(method).alias("method")))

    url = first_href(title)
    asked = F.when(url.contains("legifrance"), F.try_url_decode(F.try_parse_url(F.replace(url, F.lit("&amp;"), F.lit("&")), F.lit("QUERY"), F.lit("query"))))
    return F.coalesce(cut(asked, "legifrance_url_query"), cut(plain_text(title), "visa_title_regex"))


def citation_key(article: Column, code: Column) -> Column:
    return F.concat(F.lit("legi-cite:"), F.sha2(F.concat_ws("\x00", F.lit("legi-citation:v1"), article, code), 256))


def collect_citations(responses: DataFrame) -> DataFrame:
    """Occurrences of the newest response per decision that has visas: occurrence_id, document_id,
    visa_index, article, code, citation_key. responses: response_id, document_id, visas
    array<struct<title>>."""
    newest = responses.filter(F.size("visas") > 0).groupBy("document_id").agg(F.max_by("visas", "response_id").alias("visas"))
    v = newest.select("document_id", F.posexplode("visas").alias("visa_index", "v")).select("document_id", "visa_index", settled(parse_visa(F.col("v.title"))).alias("p")).filter("p is not null")
    v = v.select("document_id", "visa_index", "p.article", "p.code", citation_key(F.col("p.article"), F.col("p.code")).alias("citation_key"))
    return v.withColumn("occurrence_id", F.concat_ws("#", F.col("document_id").cast("string"), F.col("visa_index").cast("string"), "citation_key")).dropDuplicates(["occurrence_id"])


def insert_occurrences(table: DataFrame, new: DataFrame) -> DataFrame:
    """Occurrences that weren't there join; others stay as they are."""
    return table.unionByName(new.join(table.select("occurrence_id"), "occurrence_id", "left_anti").select(*table.columns))


def pend_citations(resolutions: DataFrame, occurrences: DataFrame, corpus: str) -> DataFrame:
    """Resolutions (corpus, citation_key, status, occurrence_count) with a pending row for each new key,
    and the counts of all occurrences."""
    n = occurrences.groupBy("citation_key").agg(F.count("*").alias("n"))
    j = resolutions.filter(F.col("corpus") == corpus).join(n, "citation_key", "full")
    own = j.select(F.lit(corpus).alias("corpus"), "citation_key", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("n", F.lit(0)).alias("occurrence_count"))
    return own.unionByName(resolutions.filter(F.col("corpus") != corpus).select(*own.columns))


def update_resolution(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The newest outcome (status, response_id, fingerprint, error) of each (corpus, citation_key) stands;
    others keep their row."""
    key = ["corpus", "citation_key"]
    new = outcomes.groupBy(*key).agg(F.max_by(F.struct("status", "response_id", "fingerprint", "error"), "response_id").alias("o")).select(*key, "o.*")
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def find_match(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Per wanted decision (document_id, number, day) the first result (result_id, position, number,
    day) of that number and day; any day only if the wanted one has none."""
    r = results.select("result_id", "position", F.translate("number", ". ", "").alias("n"), F.col("day").alias("result_day"))
    j = wanted.withColumn("n", F.translate("number", ". ", "")).join(r, "n").filter(F.col("day").isNull() | (F.col("day") == F.col("result_day")))
    return j.groupBy("document_id").agg(F.min_by("result_id", F.struct("position", "result_id")).alias("result_id"))


PUBLISHER_ID = "(?:LEGIARTI|LEGITEXT|LEGISCTA|JURITEXT|CETATEXT|JORFTEXT)[0-9]{12}"


def publisher_edges(documents: DataFrame) -> DataFrame:
    """An edge per link (id, cid, cidtexte, href, text) with a text or a target: edge_id, document_id,
    target, text. The first attribute that isn't blank is the target, or the publisher id in it."""
    some = lambda c: F.when(F.trim(F.col(f"l.{c}")) != "", F.col(f"l.{c}"))
    raw = F.coalesce(*map(some, ("id", "cid", "cidtexte", "href")))
    uid = F.regexp_extract(F.upper(raw), PUBLISHER_ID, 0)
    e = documents.select("document_id", F.posexplode("links").alias("position", "l")).withColumn("target", F.when(uid != "", uid).otherwise(raw)).filter((F.coalesce("l.text", F.lit("")) != "") | F.col("target").isNotNull())
    ident = F.sha2(F.concat_ws("\x00", F.col("document_id").cast("string"), F.col("position").cast("string"), F.coalesce("target", F.lit("")), F.coalesce("l.text", F.lit(""))), 256)
    return e.select(ident.alias("edge_id"), "document_id", "target", F.col("l.text").alias("text"))
