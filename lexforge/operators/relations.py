"""Graph, version, reference and coverage operators. Depth-1 joins only; seeds are few by contract
and are pushed into the edge scan as a filter before anything is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import settled
from .retrieval import asof


def cites(edges: DataFrame, targets: DataFrame, seed: int, limit: int) -> DataFrame:
    """Targets that the seed cites, itself excluded."""
    out = edges.filter((F.col("from_id") == seed) & (F.col("tag") == "R") & (F.col("to_id") != seed)).select("to_id").distinct()
    return out.join(targets, out["to_id"] == targets["target_id"]).select("target_id", "name").orderBy("target_id").limit(limit)


def cited_by(edges: DataFrame, seed: int, limit: int) -> DataFrame:
    return edges.filter((F.col("to_id") == seed) & (F.col("from_id") != seed)).select("from_id").distinct().orderBy("from_id").limit(limit)


def version_family(versions: DataFrame, target: int) -> DataFrame:
    """The target's family, earliest first (null starts first), with the target marked."""
    family = versions.filter(F.col("version_id") == target).select("family")
    return versions.join(F.broadcast(family), "family").select("family", "version_id", "valid_from", (F.col("version_id") == target).alias("is_target"))


def pick_asof(versions: DataFrame, date: str, key: str = "family") -> DataFrame:
    """The version of each family in force on a date, the newest start first, then the smallest id."""
    live = versions.filter(asof(date))
    pick = F.max_by(F.struct("version_id", "valid_from", "amount"), F.struct(F.col("valid_from"), -F.col("version_id")))
    return live.groupBy(key).agg(pick.alias("v")).select(key, "v.version_id", "v.valid_from", "v.amount")


def diff(versions: DataFrame, before: str, after: str) -> DataFrame:
    """family, the versions on two dates, and whether they differ (unknown on both: they don't)."""
    a = pick_asof(versions, before).select("family", F.col("version_id").alias("before_id"))
    b = pick_asof(versions, after).select("family", F.col("version_id").alias("after_id"))
    x = versions.select("family").distinct().join(a, "family", "left").join(b, "family", "left")
    return x.select("family", "before_id", "after_id", (~F.col("before_id").eqNullSafe(F.col("after_id"))).alias("changed"))


def resolve_logical(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """For many references (ref_id, family, on_date) at once: the version in force, null if none."""
    j = refs.join(versions, "family", "left").filter(F.col("version_id").isNull() | ((F.col("valid_from") <= F.col("on_date")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("on_date")))))
    best = j.groupBy("ref_id").agg(F.max_by("version_id", F.struct(F.col("valid_from"), -F.col("version_id"))).alias("version_id"))
    return refs.select("ref_id").join(best, "ref_id", "left")


def siblings(nodes: DataFrame, seed: int, limit: int) -> DataFrame:
    """Nodes with the seed's path, itself excluded, with their full number; a path's hash meets first."""
    key = F.md5("path")
    path = nodes.filter(F.col("node_id") == seed).select(key.alias("_k"), F.col("path").alias("_p"))
    s = nodes.withColumn("_k", key).join(F.broadcast(path), "_k").filter((F.col("path") == F.col("_p")) & (F.col("node_id") != seed))  # one row
    return s.select("node_id", "name").orderBy("name", "node_id").limit(limit).join(s.agg(F.count("*").alias("n_siblings")))


def context(documents: DataFrame, target: int, as_of: str | None, limit: int) -> DataFrame:
    """part (target, ancestor, sibling), position, document_id, title, sibling_count, truncated of a
    document (document_id, source, kind, title, path, valid_from, valid_to). Without a date its own start
    counts; a target that isn't in force on the date has no rows."""
    t = documents.filter(F.col("document_id") == target).withColumn("day", F.coalesce(F.lit(as_of).cast("date"), "valid_from", F.current_date()))
    live = lambda p: (F.col(f"{p}valid_from").isNull() | (F.col(f"{p}valid_from") <= F.col("day"))) & (F.col(f"{p}valid_to").isNull() | (F.col(f"{p}valid_to") > F.col("day")))
    t = t if as_of is None else t.filter(live(""))
    key = [F.col("source"), F.col("kind"), F.md5(F.to_json("path")).alias("k")]
    seed = t.filter(F.size("path") > 0).select(*key, F.col("path").alias("_path"), "day")
    s = documents.select(*key, "document_id", "title", "path", "valid_from", "valid_to").join(F.broadcast(seed), ["source", "kind", "k"]).filter((F.col("path") == F.col("_path")) & (F.col("document_id") != target) & live(""))  # one row
    count = s.agg(F.count("*").alias("sibling_count"))
    top = s.select("document_id", "title").orderBy("title", "document_id").limit(limit).withColumn("position", F.row_number().over(W.orderBy("title", "document_id")) - 1)
    rows = t.select(F.lit("target").alias("part"), F.lit(0).alias("position"), "document_id", "title").unionByName(t.select(F.lit("ancestor").alias("part"), F.posexplode("path").alias("position", "title"), F.lit(None).cast("bigint").alias("document_id"))).unionByName(top.select(F.lit("sibling").alias("part"), "position", "document_id", "title"))
    return rows.join(count).withColumn("truncated", F.col("sibling_count") > limit).withColumn("position", F.col("position").cast("bigint"))


def related_page(neighbours: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` neighbours in the relation's own order, given by id, with whether there may be more."""
    page = neighbours.orderBy(*order).limit(limit)
    return page.join(page.agg((F.count("*") >= limit).alias("possibly_truncated"))).orderBy("document_id")


def temporal(edges: DataFrame, versions: DataFrame, seed: int) -> DataFrame:
    """The versions that a document's version edges lead to: document_id, valid_from; itself excluded."""
    out = edges.filter((F.col("from_id") == seed) & (F.col("tag") == "A") & (F.col("to_id") != seed)).select(F.col("to_id").alias("document_id")).distinct()
    return out.join(versions.select(F.col("version_id").alias("document_id"), "valid_from"), "document_id")


def validate_refs(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """ref_id, resolved_id, status of references (ref_id, target_kind, document_id, source, source_uid,
    version_group, as_of, prior_id) against documents (document_id, source, source_uid, version_group,
    valid_from, valid_to). A pin exists or is missing; a decision without one is the newest of its
    source and publisher id; a logical article is its group's (else its publisher id's) version in force,
    changed if it was another one before; what lacks its keys is invalid. All by hash joins."""
    r, kind = refs, F.col("target_kind")
    pin = F.col("document_id").isNotNull() & kind.isin("document_version", "decision", "chunk", "zone_unit")
    repair = ~pin & (kind == "decision") & F.col("source").isNotNull() & F.col("source_uid").isNotNull()
    logical = ~pin & kind.isin("logical_article", "chunk", "zone_unit") & F.col("as_of").isNotNull() & (F.col("version_group").isNotNull() | F.col("source_uid").isNotNull())
    r = r.withColumn("how", settled(F.when(pin, "pin").when(repair, "repair").when(logical, "logical").otherwise("invalid")))
    key = F.when(F.col("how") == "pin", F.concat(F.lit("p:"), "document_id")).when(F.col("how") == "repair", F.concat(F.lit("d:"), "source", F.lit(":"), "source_uid")).when((F.col("how") == "logical") & F.col("version_group").isNotNull(), F.concat(F.lit("g:"), "version_group")).when(F.col("how") == "logical", F.concat(F.lit("u:"), "source_uid"))
    r = r.select("ref_id", "how", "prior_id", "as_of", F.when(F.col("how") == "logical", F.col("source")).alias("scope"), settled(key).alias("key"))
    offers = F.filter(F.array(F.concat(F.lit("p:"), "document_id"), F.concat(F.lit("d:"), "source", F.lit(":"), "source_uid"), F.concat(F.lit("g:"), "version_group"), F.concat(F.lit("u:"), "source_uid")), lambda x: x.isNotNull())
    d = documents.select(F.col("document_id").alias("found_id"), F.col("source").alias("found_source"), "valid_from", "valid_to", F.explode(offers).alias("key"))
    live = (F.col("how") != "logical") | (((F.col("valid_from").isNull()) | (F.col("valid_from") <= F.col("as_of"))) & (F.col("valid_to").isNull() | (F.col("as_of") < F.col("valid_to"))) & (F.col("scope").isNull() | (F.col("scope") == F.col("found_source"))))
    best = r.join(d, "key").filter(live).groupBy("ref_id").agg(F.min_by("found_id", F.struct(F.col("valid_from").isNull(), -F.datediff("valid_from", F.lit("1970-01-01").cast("date")), F.col("found_id"))).alias("resolved_id"))
    j = r.join(best, "ref_id", "left")
    changed = (F.col("how") == "logical") & F.col("prior_id").isNotNull() & (F.col("prior_id") != F.col("resolved_id"))
    status = F.when(F.col("how") == "invalid", "invalid").when(F.col("resolved_id").isNull(), "missing").when(changed, "changed").otherwise("resolved")
    return j.select("ref_id", "resolved_id", status.alias("status"))


def enrich_candidates(decisions: DataFrame, zones: DataFrame, now: str, since: str | None = None, cutoff: str | None = None, after: int | None = None, limit: int = 100, newest_first: bool = False) -> DataFrame:
    """A page of decisions (document_id, valid_from) whose zone row (status, fetched_at, expires_at,
    text_hash) is missing, expired, without the hash it should have, or fetched before `since`; of
    decisions from `cutoff` on, if given; after a cursor, in either direction."""
    at = lambda t: F.lit(t).cast("timestamp")
    due = F.col("status").isNull() | (F.col("expires_at") <= at(now)) | (F.col("status").isin("ok", "invalid_offsets") & F.col("text_hash").isNull())
    due = due if since is None else due | (F.col("fetched_at") < at(since))
    d = decisions if cutoff is None else decisions.filter(F.col("valid_from").isNotNull() & (F.col("valid_from") >= F.lit(cutoff).cast("date")))
    if after is not None:
        d = d.filter(F.col("document_id") < after if newest_first else F.col("document_id") > after)
    return d.join(zones, "document_id", "left").filter(F.coalesce(due, F.lit(False))).select("document_id").orderBy(F.desc("document_id") if newest_first else F.asc("document_id")).limit(limit)


def decision_filters(jurisdiction: str | None = None, formation: str | None = None, publication: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Conditions on decisions (kind, canonical_json, valid_from); any of them asks for a decision.
    Wildcards in the names count, as the data model has it."""
    field = lambda k: F.get_json_object("canonical_json", f"$.{k}")
    out = F.lit(True)
    for name, value in (("jurisdiction", jurisdiction), ("formation", formation)):
        out = out if value is None else out & F.ilike(field(name), F.lit(f"%{value}%"))
    out = out if publication is None else out & (F.lower(field("publication")) == publication.lower())
    out = out if since is None else out & (F.col("valid_from") >= F.lit(since).cast("date"))
    out = out if until is None else out & (F.col("valid_from") <= F.lit(until).cast("date"))
    given = any(x is not None for x in (jurisdiction, formation, publication, since, until))
    return out & (F.col("kind") == "decision") if given else out


def readiness(coverage: DataFrame, several: bool) -> DataFrame:
    """corpus, state of active generations (corpus, documents, projected, chunks, embedded): ready if all
    is projected and embedded, incomplete else; an empty one is empty, which counts as ready only where
    other corpora are served."""
    whole = (F.col("projected") == F.col("documents")) & (F.col("embedded") == F.col("chunks"))
    state = F.when((F.col("documents") == 0) | (F.col("chunks") == 0), F.lit("empty" if several else "incomplete")).when(whole, "ready").otherwise("incomplete")
    return coverage.select("corpus", state.alias("state"))


def readiness_stamp(coverage: DataFrame, several: bool) -> DataFrame:
    """The states; the query fails and names a corpus if one is incomplete."""
    told = F.concat(F.lit("readiness: coverage of corpus "), F.col("corpus"), F.lit(" is incomplete"))
    return readiness(coverage, several).withColumn("state", F.when(F.col("state") == "incomplete", F.raise_error(told).cast("string")).otherwise(F.col("state")))


def nearest_preceding(links: DataFrame, group: str, order: str, is_section: Column) -> DataFrame:
    """The nearest earlier section link of each other link of an ordered list, and how many came before."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return links.withColumn("section", F.last(F.when(is_section, F.col(order)), ignorenulls=True).over(w)).withColumn("n_before", F.count(F.when(is_section, 1)).over(w)).filter(~is_section)


def preceding_sections(links: DataFrame, group: str, order: str, is_section: Column) -> DataFrame:
    """nearest_preceding with the list of all earlier sections: the group's sections are gathered once,
    and each link takes as many of them as came before it."""
    s = links.filter(is_section).groupBy(group).agg(F.sort_array(F.collect_list(order)).alias("_all"))
    j = nearest_preceding(links, group, order, is_section).join(s, group, "left")
    return j.withColumn("sections", F.slice(F.coalesce("_all", F.array().cast(s.schema["_all"].dataType)), F.lit(1), F.col("n_before").cast("int"))).drop("_all")


def fetch_ordered(rows: DataFrame, ids: list[int], chunks: DataFrame | None = None) -> DataFrame:
    """Rows of the asked ids in request order; repeated ids give repeated rows. With chunks (document_id,
    chunk_index, chunk_id), each row has its own in order; only the asked documents' are gathered."""
    spark = rows.sparkSession
    want = spark.createDataFrame([(i, k) for i, k in enumerate(ids)], "ordinal long, document_id long")
    out = F.broadcast(want).join(rows, "document_id")  # as many rows as were asked for
    if chunks is not None:
        own = chunks.filter(F.col("document_id").isin(sorted(set(ids)))).groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
        out = out.join(own, "document_id", "left")
    return out.orderBy("ordinal")


def union_views(spark, parts: list[DataFrame], schema: str) -> DataFrame:
    """All parts' rows; an empty table of the schema without any part."""
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
