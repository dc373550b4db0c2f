"""Table functions for SQL: `chunk_text` and `extract_citations`, for lateral joins over any table with text.

Their columns depend on constant arguments: `chunk_text(text, limit, columns)` gives the named ones of
chunk_index, body and chars; `extract_citations(text, kinds, matched)` takes the named kinds only (null:
all) and adds the text as it stands if `matched` is true. Null texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.derive import MAX_CHARS, pack_paragraphs

_COLUMNS = {"chunk_index": IntegerType(), "body": StringType(), "chars": LongType()}
#: How publishers' identifiers look in running text.
IDENTIFIERS = {"article_id": r"(?i)LEGIARTI[0-9]{12}", "text_id": r"(?i)LEGITEXT[0-9]{12}", "section_id": r"(?i)LEGISCTA[0-9]{12}", "decision_id": r"(?i)(?:JURI|CETA)TEXT[0-9]{12}", "ecli": r"(?i)ECLI:[A-Z]{2}:[A-Z0-9.:]+", "pourvoi": r"[0-9]{2}-[0-9]{2}\.?[0-9]{3}"}


def constant(arg: AnalyzeArgument | None, name: str, default):
    """A constant argument's value; a column fails the query."""
    if arg is None:
        return default
    if not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return default if arg.value is None else arg.value


def listed(text: str | None, known: dict, name: str) -> list[str]:
    """The comma-joined names of a text, which must be known; all if it is null."""
    names = list(known) if text is None else [x.strip() for x in text.split(",")]
    if bad := [x for x in names if x not in known]:
        raise ValueError(f"{name}: {', '.join(bad)} is none of {', '.join(known)}")
    return names


class ChunkText:
    """Paragraphs packed greedily up to a limit of characters."""

    @staticmethod
    def analyze(text: AnalyzeArgument, limit: AnalyzeArgument | None = None, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        if constant(limit, "limit", MAX_CHARS) < 1:
            raise ValueError("limit must be 1 or more")
        names = listed(constant(columns, "columns", None), _COLUMNS, "columns")
        return AnalyzeResult(StructType([StructField(n, _COLUMNS[n]) for n in names]))

    def eval(self, text: str | None, limit: int | None = None, columns: str | None = None) -> Iterator[tuple]:
        names = listed(columns, _COLUMNS, "columns")
        for i, body in enumerate(pack_paragraphs(text or "", limit or MAX_CHARS)):
            row = {"chunk_index": i, "body": body, "chars": len(body)}
            yield tuple(row[n] for n in names)


class ExtractCitations:
    """The identifiers that stand in a text, by kind, in order."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kinds: AnalyzeArgument | None = None, matched: AnalyzeArgument | None = None) -> AnalyzeResult:
        listed(constant(kinds, "kinds", None), IDENTIFIERS, "kinds")
        fields = [StructField("kind", StringType()), StructField("value", StringType()), StructField("position", IntegerType())]
        return AnalyzeResult(StructType(fields + [StructField("matched", StringType())] * bool(constant(matched, "matched", False))))

    def eval(self, text: str | None, kinds: str | None = None, matched: bool | None = None) -> Iterator[tuple]:
        for kind in listed(kinds, IDENTIFIERS, "kinds"):
            for i, m in enumerate(re.finditer(IDENTIFIERS[kind], text or "")):
                yield (kind, m[0].upper(), i, m[0]) if matched else (kind, m[0].upper(), i)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("chunk_text", udtf(ChunkText))
    spark.udtf.register("extract_citations", udtf(ExtractCitations))
