"""Operator 5: secret scan by multipart credential linking. Native: DataFrame functions only.

Base findings (assign, access, hex) stand by themselves. The method adds weak candidates: short or
otherwise named assigned secrets, account identifiers and endpoints. None of them is a secret on its
own; each is reported only if complementary parts of a credential lie in its scope, the interval of
`SCOPE` code points around it: a weak secret needs an identifier, access key or endpoint; an
identifier needs a secret; an endpoint needs both. Weak secrets that overlap a strong finding are part
of it. The interval join runs inside the row, over the few parts of a text, by one sort and running
values, so nothing is shuffled at any size and a text of many parts costs no square of them.

Row by row: null text counts as empty, empty text has no spans, rows and their repeats stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow
from .spans import SPAN, apart, empty, find_all, hashed, listed, masked, near, ranked, with_settled

#: The patterns of the base kinds, in order; hex and access as maximal runs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts.
WEAK = r"""(?i:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|private|access|account|storage|shared|client)_?key|credential)s?(?i:[_-]?(?:access|value))?(?i:[_-]?key)?["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{6,})"""
IDENTIFIER = r"""(?i:(?<![A-Za-z])(?:user(?:name)?|login|account|client_?id|app_?id|tenant_?id|key_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
ENDPOINT = r"""(?i:\b(?:https?|ftps?|ssh|amqps?|redis|mongodb|postgres(?:ql)?|mysql|jdbc:[a-z]+))://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"""
KINDS = ["assign", "access", "hex", "weak_secret", "identifier", "endpoint"]
SCOPE = 200


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, assign, access, hex (base spans), extra (linked weak spans as (start, kind, end))."""
    none = empty(SPAN)
    any_of = lambda *words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
    only = lambda condition, found: f"CASE WHEN {condition} THEN {found} ELSE {none} END"
    assigned = f"filter({find_all('text', ASSIGN, 2)}, s -> length(s.part) >= 12)"
    found = with_settled(
        docs.select("doc_id", "text"),
        assign=only(any_of("passw", "secret", "token", "apikey", "api_key"), assigned),
        access=only("contains(text, 'AKIA')", find_all("text", ACCESS)),
        hex=find_all("text", HEX),
        ids=only("text RLIKE '[:=]' AND " + any_of("user", "login", "account", "client", "_id", "keyid", "appid", "tenantid"), find_all("text", IDENTIFIER, 1)),
        ends=only("contains(text, '://')", find_all("text", ENDPOINT)),
    )
    # Without keys or endpoints there is nothing to link, so most texts end here.
    found = with_settled(found, weak=only("size(ids) + size(ends) + size(access) > 0 AND text RLIKE '[:=]'", find_all("text", WEAK, 1)))
    linked = "size(weak) + size(assign) + size(access) > 0"
    found = with_settled(found, ids=only(linked, "ids"), ends=only(linked, "ends"))
    found = apart(found, "weak", "weak", "concat(assign, access, hex)")
    secrets, keys = "concat(assign, access, weak)", "concat(ids, access)"
    found = near(found, "secrets", "weak", "concat(ids, access, ends)", SCOPE)
    found = near(found, "names", "ids", secrets, SCOPE)
    found = near(found, "served", "ends", keys, SCOPE)
    found = near(found, "places", "served", secrets, SCOPE)
    return found.selectExpr("doc_id", "text", "assign", "access", "hex", f"concat({ranked('secrets', 3)}, {ranked('names', 4)}, {ranked('places', 5)}) AS extra")


BASE = f"concat({ranked('assign', 0)}, {ranked('access', 1)}, {ranked('hex', 2)})"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    s = secret_spans(narrow(docs))
    return s.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]),
        hashed(BASE, KINDS).alias("base_sha256"),
        F.expr(listed(f"concat({BASE}, extra)", KINDS)).alias("spans"),
        F.size("extra").cast("bigint").alias("n_linked"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with all their columns; in text, every reported span but bare endpoints and
    identifiers gives way to the mask. Overlapping spans are masked together."""
    keep = [c for c in docs.columns if c != "text"]
    src = docs.select(F.struct(*docs.columns).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = with_settled(secret_spans(src), found=f"sort_array(concat({BASE}, filter(extra, e -> e.kind = 3)))")
    out = spans.select("doc_id", F.expr(masked("text", "found", mask)).alias("text"))
    text = F.when(F.col("doc_id.text").isNull(), F.lit(None).cast("string")).otherwise(F.col("text"))
    return out.select(*((text if c == "text" else F.col("doc_id")[c]).alias(c) for c in docs.columns)) if keep else out.select(text.alias("text"))
