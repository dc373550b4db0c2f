"""Article, section, text and decision XML to canonical records.

Mixed content needs a parser, so members go through Python in Arrow batches; each member becomes one
record or tells its error, and nothing but the batch at hand is held.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import small_batches

#: Tags that break a line, roots by kind, publisher ids by kind, end dates that mean none.
BLOCKS = {"p", "br", "li", "div", "blockquote", "tr", "td", "th", "table"}
ROOTS = {"ARTICLE": "article", "SECTION_TA": "section", "TEXTE_VERSION": "text_version", "TEXTELR": "textelr", "TEXTE_JURI_JUDI": "decision", "TEXTE_JURI_ADMIN": "decision"}
IDS = {"ARTICLE": "LEGIARTI", "SECTION_TA": "LEGISCTA", "TEXTE_VERSION": "LEGITEXT", "TEXTELR": "LEGITEXT", "TEXTE_JURI_JUDI": "JURITEXT", "TEXTE_JURI_ADMIN": "CETATEXT"}
FAMILY = {"legi": {"ARTICLE", "SECTION_TA", "TEXTE_VERSION", "TEXTELR"}, "cass": {"TEXTE_JURI_JUDI"}, "capp": {"TEXTE_JURI_JUDI"}, "inca": {"TEXTE_JURI_JUDI"}, "jade": {"TEXTE_JURI_ADMIN"}}
OPEN_ENDED = {"2999-01-01", "2999-12-31"}
LINK = "struct<tag:string,target:string,text:string,level:int,position:int>"
RECORD = f"member string, root_kind string, document_id string, source_uid string, title string, title_full string, citation string, body string, status string, nature string, number string, cid string, nor string, parent_uid string, jurisdiction string, formation string, publication string, ecli string, case_numbers array<string>, summaries array<struct<kind:string,text:string>>, valid_from string, valid_to string, valid_to_raw string, hierarchy_path array<string>, links array<{LINK}>, source_payload_hash string, error string"
_ARROW = pa.schema([(c, pa.list_(pa.string()) if c in ("case_numbers", "hierarchy_path") else pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])) if c == "summaries" else pa.list_(pa.struct([("tag", pa.string()), ("target", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("position", pa.int32())])) if c == "links" else pa.string()) for c in "member root_kind document_id source_uid title title_full citation body status nature number cid nor parent_uid jurisdiction formation publication ecli case_numbers summaries valid_from valid_to valid_to_raw hierarchy_path links source_payload_hash error".split()])


def squash(text: str | None) -> str:
    return " ".join((text or "").split())


def flat_text(nodes) -> str:
    """Text with white space squashed, block tags as one line break, no blank lines."""
    parts: list[str] = []

    def walk(e: ET.Element) -> None:
        block = e.tag.lower() in BLOCKS
        parts.append("\n" if block else "")
        parts.append(re.sub(r"\s+", " ", e.text or ""))
        for kid in e:
            walk(kid)
            parts.append(re.sub(r"\s+", " ", kid.tail or ""))
        parts.append("\n" if block else "")

    for node in nodes:
        walk(node)
    return "\n".join(x for x in map(squash, "".join(parts).split("\n")) if x)


class Bad(ValueError):
    """A member that gives no record; str() is its error."""


def day(name: str, value: str | None) -> str:
    try:
        if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value or ""):
            return datetime.date.fromisoformat(value).isoformat()
    except ValueError:
        pass
    raise Bad(f"invalid date {name}: {value}")


def parse(xml: bytes, source: str) -> dict:
    """One record; errors are told in `error`, an empty decision body is a skip."""
    out: dict = dict.fromkeys(_ARROW.names)
    out["source_payload_hash"] = "sha256:" + hashlib.sha256(xml).hexdigest()
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return out | {"error": f"malformed: {e}"}
    if root.tag not in ROOTS:
        return out | {"error": f"unsupported root {root.tag}"}
    if root.tag not in FAMILY.get(source, ()):
        return out | {"root_kind": ROOTS[root.tag], "error": f"root {root.tag} does not belong to source {source}"}
    try:
        return out | {"root_kind": ROOTS[root.tag]} | _READERS[root.tag](_Member(root, source))
    except Bad as e:
        return out | {"root_kind": ROOTS[root.tag], "error": str(e)}


class _Member:
    def __init__(self, root: ET.Element, source: str) -> None:
        self.root, self.source = root, source

    def first(self, path: str) -> str | None:
        """The first non-blank text at a path (parent/tag)."""
        return next((t for e in self.root.iterfind(f".//{path}") if (t := (e.text or "").strip())), None)

    def must(self, path: str) -> str:
        value = self.first(path)
        if value is None:
            raise Bad(f"missing {path}")
        return value

    def uid(self, value: str | None) -> str:
        prefix = IDS[self.root.tag]
        if not re.fullmatch(f"{prefix}[0-9]{{12}}", value or ""):
            raise Bad(f"invalid id: {value}")
        return value

    def span(self, start: str, end: str) -> dict:
        raw = self.must(end)
        return {"valid_from": day(start, self.must(start)), "valid_to": None if raw in OPEN_ENDED else day(end, raw), "valid_to_raw": raw}

    def body(self) -> str:
        return flat_text(self.root.iterfind(".//BLOC_TEXTUEL/CONTENU"))

    def path(self) -> list[str]:
        return [t for c in self.root.iter("CONTEXTE") for e in c.iter() if e.tag in ("TITRE_TXT", "TITRE_TM") and (t := (e.text or "").strip())]

    def links(self, targets: tuple[str, ...]) -> list[dict]:
        """Links with a text or a target: the first of the attributes, as the publisher id in it if it has one."""
        out = []
        for i, e in enumerate(x for x in self.root.iter() if x.tag == "LIEN" or x.tag.startswith("LIEN_")):
            value = next((e.attrib[a] for a in targets if (e.attrib.get(a) or "").strip()), None)
            uid = re.search(r"(?:LEGIARTI|LEGITEXT|LEGISCTA|JURITEXT|CETATEXT|JORFTEXT)[0-9]{12}", (value or "").upper())
            level = e.attrib.get("niv", "")
            out.append({"tag": e.tag, "target": uid[0] if uid else value, "text": squash("".join(e.itertext())) or None, "level": int(level) if level.isdigit() else None, "position": i})
        return [x for x in out if x["target"] or x["text"]]


def _article(m: _Member) -> dict:
    uid = m.uid(m.must("META_COMMUN/ID"))
    number, path, body = m.first("META_ARTICLE/NUM"), m.path(), m.body()
    span, title = m.span("META_ARTICLE/DATE_DEBUT", "META_ARTICLE/DATE_FIN"), f"Article {number or uid}"
    if not body:
        raise Bad("missing BLOC_TEXTUEL/CONTENU")
    return {"document_id": f"legi:{uid}@{span['valid_from']}", "source_uid": uid, "title": title, "citation": f"{path[0] if path else 'LEGI'} {title}", "body": body, "status": m.first("META_ARTICLE/ETAT"), "nature": m.must("META_COMMUN/NATURE"), "number": number, "hierarchy_path": path, "links": m.links(("id", "cid", "cidtexte", "href")), **span}


def _section(m: _Member) -> dict:
    uid = m.uid(next(iter(t for e in m.root.findall("ID") if (t := (e.text or "").strip())), None))
    titles = [e for c in m.root.iter("CONTEXTE") for e in c.iter("TITRE_TXT")]
    last = lambda a: next((e.attrib[a] for e in reversed(titles) if (e.attrib.get(a) or "").strip()), None)
    parent = next((e.attrib["cid"] for c in m.root.iter("CONTEXTE") for e in c.iter("TEXTE") if (e.attrib.get("cid") or "").strip()), None)
    start, end = last("debut"), last("fin")
    return {"source_uid": uid, "title": squash(m.root.findtext("TITRE_TA")) or None, "parent_uid": parent, "hierarchy_path": m.path(), "valid_from": start and day("debut", start), "valid_to": None if end is None or end in OPEN_ENDED else day("fin", end), "valid_to_raw": end}


def _text_version(m: _Member) -> dict:
    at = "META_TEXTE_VERSION"
    return {"source_uid": m.uid(m.must("META_COMMUN/ID")), "title": m.must(f"{at}/TITRE"), "title_full": m.first(f"{at}/TITREFULL"), "status": m.must(f"{at}/ETAT"), "nature": m.first("META_COMMUN/NATURE"), **m.span(f"{at}/DATE_DEBUT", f"{at}/DATE_FIN")}


def _textelr(m: _Member) -> dict:
    at = "META_TEXTE_CHRONICLE"
    starts = [day("debut", e.attrib["debut"].strip()) for e in m.root.iter() if e.tag.startswith("LIEN_") and (e.attrib.get("debut") or "").strip()]
    return {"source_uid": m.uid(m.must("META_COMMUN/ID")), "cid": m.first(f"{at}/CID"), "number": m.first(f"{at}/NUM"), "nor": m.first(f"{at}/NOR"), "nature": m.first("META_COMMUN/NATURE"), "valid_from": min(starts, default=None), "links": m.links(("id", "cid"))}


def _decision(m: _Member) -> dict:
    every = lambda tag: squash(" ".join(e.text or "" for e in m.root.iter(tag))) or None
    uid, date, body = m.uid(every("ID")), day("DATE_DEC", every("DATE_DEC")), m.body()
    if not body:
        raise Bad(f"skipped: {uid} has an empty body")
    sums = [{"kind": "analyse" if e.tag == "ANA" else e.attrib.get("TYPE", "PRINCIPAL"), "text": squash("".join(e.itertext()))} for e in m.root.iter() if e.tag in ("SCT", "ANA")]
    flag = next((e.attrib["publie"] for e in m.root.iter("PUBLI_BULL") if "publie" in e.attrib), None) if m.root.tag == "TEXTE_JURI_JUDI" else every("PUBLI_RECUEIL")
    title = every("TITRE")
    return {"document_id": f"{m.source}:{uid}", "source_uid": uid, "title": title, "citation": title, "body": body, "nature": every("NATURE"), "number": every("NUMERO"), "jurisdiction": every("JURIDICTION"), "formation": every("FORMATION"), "publication": flag, "ecli": every("ECLI"), "case_numbers": [t for e in m.root.iter("NUMERO_AFFAIRE") if (t := (e.text or "").strip())], "summaries": [s for s in sums if s["text"]], "valid_from": date, "links": m.links(("id", "cidtexte"))}


_READERS = {"ARTICLE": _article, "SECTION_TA": _section, "TEXTE_VERSION": _text_version, "TEXTELR": _textelr, "TEXTE_JURI_JUDI": _decision, "TEXTE_JURI_ADMIN": _decision}


def parse_members(members: DataFrame, source: str) -> DataFrame:
    """Canonical records of archive members (member, xml); those with an error go to a reject table
    by a filter on `error`."""

    def run(batches):
        for batch in batches:
            rows = [parse(x.as_py(), source) | {"member": m.as_py()} for m, x in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    small_batches(members.sparkSession)
    return members.filter("xml is not null").select("member", "xml").mapInArrow(run, RECORD)
