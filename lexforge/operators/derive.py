"""Chunks, zones, hierarchy, citations: derivations within a row, native wherever the state of a
sequential scan fits an aggregate over an array."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..storage import small_batches

MAX_CHARS = 6000
PARTS = "array<struct<chunk_index:int,body:string>>"


def pack_paragraphs(text: str, limit: int = MAX_CHARS) -> list[str]:
    """Greedy packing of lines up to the limit in characters, a newline counting one; longer lines
    are cut hard."""
    out, held, size = [], [], 0
    for line in (p.strip() for p in text.split("\n")):
        for at in range(0, len(line), limit):
            piece = line[at : at + limit]
            if held and size + 1 + len(piece) > limit:
                out.append("\n".join(held))
                held, size = [], 0
            size += len(piece) + (1 if held else 0)
            held.append(piece)
    return [*out, "\n".join(held)] if held else out


def _decision_chunks(body: pd.Series, summary: pd.Series) -> pd.Series:

    def one(text, head):
        parts = ([head.strip()] if head and head.strip() else []) + pack_paragraphs(text or "")
        return [{"chunk_index": i, "body": p} for i, p in enumerate(parts)]

    return pd.Series([one(t, s) for t, s in zip(body, summary, strict=True)], dtype=object)


def pack_lines(lines: list[str], room: int) -> list[str]:
    """Greedy packing of whole lines, a newline counting one; a line longer than the room stands alone."""
    out: list[str] = []
    for line in lines:
        if out and len(out[-1]) + 1 + len(line) <= room:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def _article_chunks(body: pd.Series, context: pd.Series) -> pd.Series:

    def one(text, ctx):
        text, room = text or "", MAX_CHARS - (len(ctx) + 2 if ctx else 0)
        parts = [text] if len(text) <= room else pack_lines([p.strip() for p in text.split("\n") if p.strip()], room)
        return [{"chunk_index": i, "body": p} for i, p in enumerate(parts if len(parts) > 1 else [text])]

    return pd.Series([one(t, c) for t, c in zip(body, context, strict=True)], dtype=object)


def decision_chunks(body: Column, summary: Column) -> Column:
    """An optional summary chunk, then packed paragraphs."""
    small_batches(SparkSession.active())
    return F.pandas_udf(_decision_chunks, PARTS)(body, summary)


def article_chunks(body: Column, context: Column) -> Column:
    """The whole article if it fits with its context; else paragraphs packed into what room is left."""
    small_batches(SparkSession.active())
    return F.pandas_udf(_article_chunks, PARTS)(body, context)


def contextualize(path: Column, title: Column, body: Column) -> Column:
    """path > … > title, a blank line, the body."""
    return F.concat_ws("\n\n", F.concat_ws(" > ", path, title), body)


def hard_split(body: Column, size: int = MAX_CHARS) -> Column:
    """array<struct<chunk_index, body>> of pieces of at most `size` characters."""
    last = F.greatest(F.lit(0), F.ceil(F.length(body) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("bigint").alias("chunk_index"), F.substring(body, i * size + 1, F.lit(size)).alias("body")))


def zone_slices(text: Column, offsets: Column) -> Column:
    """Slices by character offsets; those out of range or blank go."""
    ok = F.filter(offsets, lambda o: (o["start"] >= 0) & (o["end"] >= o["start"]) & (o["end"] <= F.length(text)))
    cut = F.transform(ok, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), F.substring(text, (o["start"] + 1).cast("int"), (o["end"] - o["start"]).cast("int")).alias("text")))
    return F.filter(cut, lambda z: F.trim(z["text"]) != "")


def zone_status(*zones: Column) -> Column:
    """ok if any zone has a slice, else invalid_offsets."""
    return F.when(sum((F.size(z) for z in zones), F.lit(0)) > 0, "ok").otherwise("invalid_offsets")


def zone_text_hash(text: Column, zones: Column, provider_id: Column, updated: Column) -> Column:
    """What a resolved zone snapshot is told by: sha256 of its parts, NUL between them."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x00", F.coalesce(text, F.lit("")), F.to_json(zones), F.coalesce(provider_id, F.lit("")), F.coalesce(updated, F.lit(""))), 256))


def toc_stack(links: Column) -> Column:
    """The section titles above the end of a list of (title, level): each cuts the stack to the
    levels above it and is pushed; a repeat of the top isn't."""

    def step(stack: Column, x: Column) -> Column:
        kept = F.slice(stack, F.lit(1), F.least(F.size(stack), F.greatest(x["level"] - 1, F.lit(0))))
        return F.when((F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) == x["title"]), kept).otherwise(F.concat(kept, F.array(x["title"])))

    return F.aggregate(links, F.array().cast("array<string>"), step)


def overlap_merge(a: Column, b: Column) -> Column:
    """a then b, sharing the longest end of a that is a start of b."""
    k = F.aggregate(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), F.lit(0), lambda best, n: F.when((n > 0) & (F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.lit(1), n)), n).otherwise(best))
    return F.concat(F.slice(a, F.lit(1), F.size(a) - k), b)


def hierarchy_backfill(documents: DataFrame, links: DataFrame) -> DataFrame:
    """document_id, old_path, new_path, changed. documents: document_id, path; links: document_id,
    position, section_path, valid_from, valid_to, anchor. The first link whose section is valid at the
    anchor (else the first) gives the path; it replaces the document's only if deeper."""
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("anchor"))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("anchor")))
    first = links.groupBy("document_id").agg(F.min_by("section_path", F.struct((~valid).alias("v"), "position")).alias("section_path"))
    j = documents.select("document_id", F.col("path").alias("old_path")).join(first, "document_id", "left")
    new = F.when(F.size(F.coalesce("section_path", F.array().cast("array<string>"))) > F.size("old_path"), F.col("section_path")).otherwise(F.col("old_path"))
    return j.select("document_id", "old_path", new.alias("new_path"), (new != F.col("old_path")).alias("changed"))


def rebuilt_chunks(chunks: DataFrame, titles: DataFrame, backfilled: DataFrame) -> DataFrame:
    """Chunks (chunk_id, document_id, body, fingerprint) with their contextualized bodies; where the path
    changed the fingerprint is lost, so that the chunk is embedded anew."""
    j = chunks.join(titles.select("document_id", "title"), "document_id").join(backfilled.select("document_id", "new_path", "changed"), "document_id")
    return j.select("chunk_id", "document_id", contextualize(F.col("new_path"), F.col("title"), F.col("body")).alias("contextualized_body"), F.when(~F.col("changed"), F.col("fingerprint")).alias("fingerprint"))


def fp_preserve(old_body: Column, new_body: Column, old: Column, new: Column) -> Column:
    """The fingerprint after an upsert: null if the text changed and none came, the new one if it
    came, else the old one."""
    return F.when(new.isNotNull(), new).when(~old_body.eqNullSafe(new_body), F.lit(None)).otherwise(old)


#: An article reference, a code's name behind it, and the next reference.
_ARTICLE = re.compile(r"(?i)\barticles?\s+((?:[LRD]\.?\s?)?\d+(?:[-\u2011]\d+)*)")
_CODE = re.compile(r"(?i)\bdu\s+(m[êe]me\s+)?code\b([^.;,\n)]{0,48})")
_NEXT = re.compile(r"(?i)\barticles?\b")


def _inferred_citations(document_id: pd.Series, body: pd.Series) -> pd.Series:

    def one(doc, text):
        text, found = text or "", {}
        for m in _ARTICLE.finditer(text):
            if len(found) == 64:
                break
            number = re.sub("[^LRD0-9-]", "", m[1].upper().replace("\u2011", "-"))
            window = _NEXT.split(text[m.end() : m.end() + 80].encode()[:80].decode(errors="ignore"), maxsplit=1)[0]
            code = _CODE.search(window)
            name = "" if not code else "même code" if code[1] else f"code {' '.join(code[2].split())}".strip()
            if number[:1].isdigit() and not code:
                continue  # perhaps of a treaty
            found.setdefault((number, name), hashlib.sha256("\0".join((str(doc), number, name)).encode()).hexdigest())
        return [{"number": a, "code": c, "edge_id": e} for (a, c), e in found.items()]

    return pd.Series([one(d, t) for d, t in zip(document_id, body, strict=True)], dtype=object)


def inferred_citations(document_id: Column, body: Column) -> Column:
    """Article references that carry a prefix letter, or a code name within 80 bytes and before the
    next reference; distinct, 64 at most (the operator's own limit)."""
    return F.pandas_udf(_inferred_citations, "array<struct<number:string,code:string,edge_id:string>>")(document_id, body)


#: What a dispositif starts with; the last one counts.
DISPOSITIF = r"(?s)^.*((?:(?i:PAR CES MOTIFS|D E C I D E|DECIDE)|DÉCIDE|Décide|décide).*)$"


def decision_part(part: str, body: Column, summary: Column) -> Column:
    """summary: as it comes; dispositif: from the last marker on; visa: the first run of lines that start
    with Vu, blank ones aside; motivations and moyens can't be told from the text: null."""
    if part == "summary":
        return F.when(F.trim(summary) != "", summary)
    if part == "dispositif":
        return F.nullif(F.regexp_replace(F.regexp_extract(body, DISPOSITIF, 1), r"^\s+|\s+$", ""), F.lit(""))
    if part == "visa":
        lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        vu = lambda x: F.upper(x).rlike("^VU(?: |$)")
        run = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), lambda s, x: F.when((s["at"] == 2) | ((s["at"] == 0) & ~vu(x)), s).when(vu(x), F.struct(F.lit(1).alias("at"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(F.struct(F.lit(2).alias("at"), s["out"].alias("out"))), lambda s: s["out"])
        return F.nullif(F.array_join(run, "\n"), F.lit(""))
    if part in ("motivations", "moyens"):
        return F.lit(None).cast("string")
    raise ValueError(f"unsupported part {part!r}")


def zone_cache_action(status: Column, expired: Column, has_part: Column, online: bool, source: Column) -> Column:
    """official: a living ok row that has the part; a living row otherwise falls back; without one, a
    Cassation decision is enriched if the request may go online."""
    living = status.isNotNull() & ~F.coalesce(expired, F.lit(False))
    return F.when(living & (status == "ok") & has_part, "official").when(living, "fallback").when(F.lit(online) & source.isin("cass", "inca"), "enrich").otherwise("fallback")


#: Phrases and the terms that they bring in, by seed.
SEEDS = {
    "civil-liability-fault-damage": (["responsabilite", "faute", "dommage", "reparation", "prejudice"], ["responsabilite civile", "fait quelconque", "faute", "dommage", "prejudice", "reparation du dommage", "article 1240", "article 1241"]),
    "contract-non-performance-damages": (["contrat", "contractuel", "obligation", "inexecution", "dommages interets"], ["force obligatoire", "obligation contractuelle", "inexecution du contrat", "dommages et interets", "article 1103", "article 1231-1"]),
    "civil-prescription": (["prescription", "delai", "action", "forclusion"], ["prescription extinctive", "delai de prescription", "action personnelle", "action mobiliere", "article 2219", "article 2224"]),
}


def expand(c: Column) -> Column:
    """array<struct<seed, term>>: the terms of each seed one of whose phrases stands whole in the folded
    query, without those that it has and those that came before."""
    folded = F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), F.lit(" "))
    plain = lambda t: t.replace("-", " ")
    parts, seen = [], set()
    for seed, (phrases, terms) in SEEDS.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | folded.contains(f" {p} ")
        assert seen.isdisjoint(terms)  # so that no term comes twice
        seen.update(terms)
        parts += [F.when(hit & ~folded.contains(f" {plain(t)} "), F.struct(F.lit(seed).alias("seed"), F.lit(t).alias("term"))) for t in terms]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimension: int, budget: int, batch: int = 32, attempts: int = 3) -> DataFrame:
    """chunk_id, embedding of chunks (chunk_id, body): texts go to the provider in batches, cut to the
    budget of characters; a batch that fails is tried again, `attempts` times in all; a vector of
    another dimension, or whose norm is more than 0.01 off 1, fails the query at once."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [(t.as_py() or "")[:budget] for t in part.column(1)]
                for n in range(1, attempts + 1):
                    try:
                        vectors = np.asarray(provider(texts), np.float64)
                        break
                    except OSError:
                        if n == attempts:
                            raise
                if vectors.shape != (len(texts), dimension):
                    raise ValueError(f"embedding of shape {vectors.shape}, not of dimension {dimension}")
                if (np.abs(np.linalg.norm(vectors, axis=1) - 1) > 0.01).any():
                    raise ValueError("embedding that isn't normalised")
                yield pa.record_batch([part.column(0), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["chunk_id", "embedding"])

    return chunks.select("chunk_id", "body").mapInArrow(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, embedding array<double>")
