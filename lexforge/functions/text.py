"""Text functions as native columns: folding, tokens, identifiers, citations, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to, one for one; ligatures fold to two letters.
ACCENTED, FOLDED = "àâäáãåçéèêëîïíìôöóòõûüùúñÿý", "aaaaaaceeeeiiiiooooouuuunyy"
TOKEN = r"[\p{L}\p{N}]+"
#: French function words that the analyzer drops.
STOPWORDS = "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split()
#: Code names, folded, in the order in which a hint is looked for.
CODES = ["code civil", "code penal", "code de procedure civile", "code de procedure penale", "code du travail", "code de la consommation", "code des assurances", "code de commerce", "code de l environnement", "code de la sante publique", "code general des impots"]
#: Letters that citations fold, one for one; other letters beyond ASCII part words.
CITATION_ACCENTED, CITATION_FOLDED = "àâäçéèêëîïôöùûü", "aaaceeeeiioouuu"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ID_PREFIXES = ["LEGIARTI", "LEGITEXT", "LEGISCTA", "JURITEXT", "CETATEXT", "JORFTEXT"]


def settled(value: Column) -> Column:
    """The value, computed once a row: a condition that always holds, but that Catalyst takes for
    changing, keeps it from copying a large expression into each place that uses the column."""
    return F.when(F.spark_partition_id() >= 0, value)


def fold(c: Column) -> Column:
    """Lower case without accents; œ and æ become two letters."""
    c = F.translate(F.lower(c), ACCENTED, FOLDED)
    return F.replace(F.replace(c, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def fold_citation(c: Column) -> Column:
    """Folded text in which everything but ASCII letters, digits and hyphens is one space."""
    low = F.translate(F.lower(c), CITATION_ACCENTED, CITATION_FOLDED)
    low = F.replace(F.replace(low, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(low, r"[^a-z0-9-]+", " "))


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def query_text(c: Column) -> Column:
    """A query's letters and digits, one space between their runs."""
    return F.array_join(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), " ")


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def snippet(c: Column, width: int = 280) -> Column:
    return F.substring(F.regexp_replace(c, r"\s+", " "), 1, width)


def strip_identifiers(c: Column, case_numbers: bool = False) -> Column:
    """Text without ECLI and publisher ids (and case numbers), squashed, at most 500 characters."""
    c = F.regexp_replace(c, r"ECLI:[A-Z]{2}:[A-Z0-9.:]+", " ")
    c = F.regexp_replace(c, r"(JURI|CETA)TEXT[0-9]{12}", " ")
    if case_numbers:
        c = F.regexp_replace(c, r"[0-9]{2}-[0-9]{2}\.?[0-9]{3}", " ")
    return F.substring(squash(c), 1, 500)


def uid(c: Column, prefix: str) -> Column:
    """The publisher id at the first place of its prefix: the prefix and twelve digits; else null."""
    rest = F.get(F.split(ascii_upper(c), prefix, 2), F.lit(1))
    digits = F.regexp_extract(rest, "^[0-9]{12}", 0)
    return F.when(digits != "", F.concat(F.lit(prefix), digits))


#: The classes of citations, in their precedence.
CLASSES = ["document_id", "decision_document_id", "legiarti", "legitext", "legiscta", "decision_id", "ecli", "free_text_article", "pourvoi", "nor", "malformed"]
_NUMBER = "[a-z0-9-]*[0-9][a-z0-9-]*"


def article_in(folded: Column) -> Column:
    """The number behind the first `article` that has one, a prefix l, lo, r or d before it joined; else null."""
    pattern = rf" article (?:({_NUMBER})|(lo|l|r|d) ({_NUMBER}))(?= )"
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    part = lambda k: F.regexp_extract(padded, pattern, k)
    return F.nullif(F.concat(part(1), part(2), part(3)), F.lit(""))


def case_number(c: Column) -> Column:
    """A case number without dots and spaces, if the text is one; else null."""
    compact = F.translate(c, ". ", "")
    return F.when(compact.rlike("^[0-9]{2}-[0-9]{4,6}$"), compact)


def parse_citation(c: Column) -> Column:
    """struct<class, value> of a free-text citation, the first class in the fixed precedence that fits; a
    malformed one has its folded text, null if that is empty."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    folded, upper = fold_citation(t), ascii_upper(t)
    compact = ascii_upper(F.regexp_replace(t, "[^A-Za-z0-9]+", ""))
    order = [
        ("document_id", F.when(t.startswith("legi:"), t)),
        ("decision_document_id", F.when(t.rlike("^(cass|capp|inca|jade):"), t)),
        ("legiarti", uid(t, "LEGIARTI")),
        ("legitext", uid(t, "LEGITEXT")),
        ("legiscta", uid(t, "LEGISCTA")),
        ("decision_id", F.coalesce(uid(t, "JURITEXT"), uid(t, "CETATEXT"))),
        ("ecli", F.when(upper.startswith("ECLI:"), upper)),
        ("free_text_article", article_in(folded)),
        ("pourvoi", case_number(t)),
        ("nor", F.when(compact.rlike("^[A-Z]{4}[0-9]{7}[A-Z]$"), compact)),
    ]
    one = lambda name, got: F.struct(F.lit(name).alias("class"), got.alias("value"))
    return F.coalesce(*(F.when(got.isNotNull(), one(name, got)) for name, got in order), one("malformed", F.nullif(folded, F.lit(""))))


def code_hint(c: Column) -> Column:
    """The first code whose name stands in the text as whole words; else null."""
    folded = F.concat(F.lit(" "), fold_citation(c), F.lit(" "))
    out = F.lit(None).cast("string")
    for name in reversed(CODES):
        out = F.when(folded.contains(f" {name} "), name).otherwise(out)
    return out


def article_number(c: Column) -> Column:
    """Upper case, no white space, plain hyphens, no dot after L, R or D."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.upper(c), F.lit("‑"), F.lit("-")), r"\s+", ""), r"^([LRD])\.", "$1")


def code_name(c: Column) -> Column:
    return F.rtrim(squash(F.lower(c)), F.lit(".,"))


def valid_date(c: Column) -> Column:
    """The date of an ISO string of the right shape that the calendar has; else null. Open-ended
    sentinels become null too."""
    d = F.try_to_date(F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c), "yyyy-MM-dd")
    return F.when(c.isin("2999-01-01", "2999-12-31"), F.lit(None).cast("date")).otherwise(d)


def compact_time(c: Column) -> Column:
    """The timestamp (UTC) of a compact one, YYYYMMDDHHMMSS; null if it isn't of that shape."""
    return F.when(c.rlike("^[0-9]{14}$"), F.try_to_timestamp(F.concat(c, F.lit(" UTC")), F.lit("yyyyMMddHHmmss z")))


def to_compact(unix: Column) -> Column:
    """YYYYMMDDHHMMSS of seconds since 1970, UTC."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(unix), F.current_timezone()), "yyyyMMddHHmmss")


def to_rfc3339(unix: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(unix), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(c: Column) -> Column:
    """Seconds since 1970 of YYYY-MM-DDTHH:MM:SSZ; null if it isn't of that shape."""
    ok = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return F.when(ok, F.unix_seconds(F.try_to_timestamp(F.concat(F.rtrim(c, F.lit("Z")), F.lit(" UTC")), F.lit("yyyy-MM-dd'T'HH:mm:ss z"))))


def first_href(c: Column) -> Column:
    """The first href="..." of an HTML fragment; null without one."""
    return F.when(c.rlike('(?i)href="[^"]*"'), F.regexp_extract(c, '(?i)href="([^"]*)"', 1))


def plain_text(c: Column) -> Column:
    """Without tags, white space squashed."""
    return squash(F.regexp_replace(c, "<[^>]*>", ""))


def html_text(c: Column) -> Column:
    """Block tags break lines, other tags go, white space is squashed, blank lines go."""
    c = F.regexp_replace(c, r"(?i)</?(p|br|li|div|blockquote|tr|td|th|table)(\s[^>]*)?/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
