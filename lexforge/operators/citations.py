"""Citations in batch: classified, looked up among documents and metadata roots, judged, gated.

Every lookup is an equality of (lookup, key, hint), so all citations of a batch meet the corpus in one
join: a document offers its id, its publisher id, its ECLI, its case numbers, and for free text the
prefixes of the numbers behind `article ` in its citation and title, as a substring match finds them,
without a hint and with each code that it names; a metadata root offers its publisher id and its NOR.
Citations that ask the same are one question. Offers are cut to the best `limit` of their key before they
meet questions, in each task already, so a key that many documents offer and many citations ask for
isn't multiplied out: the join has `limit` rows a question, and so has the result a citation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CODES, ascii_upper, case_number, code_hint, parse_citation, settled, uid
from .retrieval import asof

MATCH = ["target_type", "document_id", "metadata_key", "source", "kind", "source_uid", "title", "valid_from", "valid_to"]


def parsed(citations: DataFrame) -> DataFrame:
    """cite_id, cite, class, value, hint, uid, lookup, key of citations (cite_id, cite)."""
    cite = F.col("cite")
    c = citations.select("cite_id", "cite", settled(parse_citation(cite)).alias("p"), settled(code_hint(cite)).alias("hint"), settled(F.coalesce(uid(cite, "LEGIARTI"), uid(cite, "JURITEXT"), uid(cite, "CETATEXT"))).alias("uid"))
    c = c.select("cite_id", "cite", "p.class", "p.value", "hint", "uid")
    lookup = F.when(F.col("class").isin("document_id", "decision_document_id"), "id").when(F.col("class") != "malformed", F.col("class"))
    return c.select("*", lookup.alias("lookup"), F.when(F.col("class") == "nor", ascii_upper(F.col("value"))).otherwise(F.col("value")).alias("key"))


def article_keys(text: Column) -> Column:
    """Prefixes, with a digit, of what stands behind each `article ` of a lower-cased text."""
    after = F.transform(F.filter(F.split(text, "article ", -1), lambda x: x.isNotNull()), lambda x: F.regexp_extract(x, "^[a-z0-9-]+", 0))
    after = F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0)))
    cuts = F.flatten(F.transform(after, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda n: F.substring(x, F.lit(1), n)))))
    return F.array_distinct(F.filter(cuts, lambda x: x.rlike("[0-9]")))


def offered(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """lookup, key, hint, exact and the columns of MATCH: what the corpus can be cited by. documents:
    document_id, source, kind, source_uid, citation, title, valid_from, valid_to, ecli, case_numbers;
    roots: metadata_key, root_kind, source_uid, title, nor, valid_from, valid_to."""
    text = F.lower(F.concat_ws(" ", "citation", "title"))
    decision, entry = F.col("kind") == "decision", lambda k, key, exact, hint=F.lit(""): F.struct(F.lit(k).alias("lookup"), key.alias("key"), F.lit(exact).alias("exact"), hint.alias("hint"))
    single = F.filter(
        F.array(
            entry("id", F.col("document_id"), True),
            entry("uid", F.col("source_uid"), False),
            entry("legiarti", F.col("source_uid"), True),
            entry("decision_id", F.when(decision, F.col("source_uid")), True),
            entry("ecli", F.when(decision, ascii_upper(F.col("ecli"))), True),
        ),
        lambda x: x["key"].isNotNull(),
    )
    numbers = F.when(decision, F.array_distinct(F.filter(F.transform("case_numbers", case_number), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))
    articles = F.when(F.col("kind") == "article", article_keys(text)).otherwise(F.array().cast("array<string>"))
    hints = F.filter(F.array(F.lit(""), *(F.when(F.contains(text, F.lit(c)), c) for c in CODES)), lambda h: h.isNotNull())
    free = F.flatten(F.transform(hints, lambda h: F.transform(articles, lambda x: entry("free_text_article", x, False, h))))
    many = F.concat(single, F.transform(F.coalesce(numbers, F.array().cast("array<string>")), lambda x: entry("pourvoi", x, True)), free)
    none = F.lit(None).cast("string")
    d = documents.select(F.lit("document").alias("target_type"), "document_id", none.alias("metadata_key"), "source", "kind", "source_uid", "title", "valid_from", "valid_to", F.explode(settled(many)).alias("k"))
    kind = F.col("root_kind")
    own = F.filter(F.array(entry("legitext", F.when(kind.isin("TEXTE_VERSION", "TEXTELR"), F.col("source_uid")), True), entry("legiscta", F.when(kind == "SECTION_TA", F.col("source_uid")), True), entry("nor", F.when(kind == "TEXTELR", ascii_upper(F.col("nor"))), True)), lambda x: x["key"].isNotNull())
    r = roots.select(F.lit("metadata_root").alias("target_type"), none.alias("document_id"), "metadata_key", F.lit("legi").alias("source"), F.lower(kind).alias("kind"), "source_uid", "title", "valid_from", "valid_to", F.explode(own).alias("k"))
    return d.unionByName(r).select(*MATCH, "k.*")


def best_of(found: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The best `limit` rows (columns of MATCH, exact) of each group, with their rank."""
    order = [F.desc("exact"), F.desc_nulls_last("valid_from"), F.asc("target_type"), F.asc("source_uid"), F.asc_nulls_last("document_id"), F.asc_nulls_last("metadata_key")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)


QUESTION = ["lookup", "key", "uid", "hint"]


def cite_lookup(citations: DataFrame, documents: DataFrame, roots: DataFrame, limit: int = 20, only: str | None = None) -> DataFrame:
    """cite_id, rank, exact and the matches, the best `limit` of each citation. An id that holds a
    publisher id also finds the documents of that one. only: a class of citations, others are left out."""
    given = parsed(citations).filter("lookup is not null and key is not null")
    given = given if only is None else given.filter(F.col("class") == only)
    uid_ = F.when(F.col("lookup") == "id", F.col("uid"))
    hint = F.when(F.col("lookup") == "free_text_article", F.col("hint"))
    asked = given.select("cite_id", "lookup", "key", F.coalesce(uid_, F.lit("")).alias("uid"), F.coalesce(hint, F.lit("")).alias("hint")).distinct()
    one = lambda lookup, key: F.struct(F.lit(lookup).alias("_lookup"), F.col(key).alias("_key"))
    own = F.array(F.struct(F.col("lookup").alias("_lookup"), F.col("key").alias("_key")))
    keys = F.when((F.col("lookup") == "id") & (F.col("uid") != ""), F.array(one("id", "key"), one("uid", "uid"))).otherwise(own)
    each = asked.select(*QUESTION).distinct().select(*QUESTION, F.explode(keys).alias("k")).select(*QUESTION, "k.*")
    offers = best_of(offered(documents, roots).distinct(), ["lookup", "key", "hint"], limit).drop("rank")
    offers = offers.withColumnsRenamed({c: f"_{c}" for c in ("lookup", "key", "hint")})
    found = each.join(offers, (each["_lookup"] == offers["_lookup"]) & (each["_key"] == offers["_key"]) & (each["hint"] == offers["_hint"]))
    found = found.groupBy(*QUESTION, *MATCH).agg(F.bool_or("exact").alias("exact"))  # an id may be found both ways
    answers = best_of(found, QUESTION, limit)
    return asked.join(answers, QUESTION).select("cite_id", *MATCH, "exact", F.col("rank").cast("bigint").alias("rank"))


def cite_states(citations: DataFrame, matches: DataFrame, as_of: str, pinned: bool = True) -> DataFrame:
    """cite_id, class, value, match_count, valid_match_count, state. as_of is the date; pinned: whether
    the request names it, without which an exact id is exact whatever its validity. Decisions are dated,
    not versioned: they exist or don't."""
    valid = asof(as_of)
    m = matches.groupBy("cite_id").agg(F.count("*").alias("match_count"), F.count_if(valid).alias("valid_match_count"), F.bool_or(F.col("exact") & (valid if pinned else F.lit(True))).alias("exact_valid"))
    j = parsed(citations).join(m, "cite_id", "left")
    n, v = F.coalesce("match_count", F.lit(0)), F.coalesce("valid_match_count", F.lit(0))
    by = lambda count, one: F.when(count == 0, "stale_version").when(count == 1, one).otherwise("ambiguous")
    state = (
        F.when((F.col("class") == "malformed") | (n == 0), "not_found")
        .when(F.col("class") == "document_id", F.when(F.col("exact_valid"), "exact").otherwise("stale_version"))
        .when(F.col("class") == "free_text_article", by(v, "normalized"))
        .when(F.col("class").isin("legiarti", "legitext", "legiscta", "nor"), by(v, "exact"))
        .when(F.col("class") == "pourvoi", by(n, "normalized"))
        .otherwise(by(n, "exact"))
    )
    return j.select("cite_id", "cite", "class", "value", n.cast("bigint").alias("match_count"), v.cast("bigint").alias("valid_match_count"), state.alias("state"))


def cite_strict(states: DataFrame) -> DataFrame:
    """The states, if each is exact or normalized; else the query fails and names one citation."""
    bad = ~F.col("state").isin("exact", "normalized")
    told = F.concat(F.lit("no_results: strict citation verification failed for `"), F.col("cite"), F.lit("` with state `"), F.col("state"), F.lit("`"))
    return states.withColumn("state", F.when(bad, F.raise_error(told).cast("string")).otherwise(F.col("state")))


def strict_failures(states: DataFrame) -> DataFrame:
    """The citations that cite_strict refuses."""
    return states.filter(~F.col("state").isin("exact", "normalized"))
