"""Named queries and, where SQL can state them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.merkle import DEPTH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *relations: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name. relations: CTEs that the SQL builds on."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if relations:
                rest = text.removeprefix("WITH ") if text.startswith("WITH ") else None
                text = f"WITH {', '.join(relations)}{',' if rest else ''} {rest or text}"
            ORACLES[f.__name__] = text
        return f

    return add


def merkle_sql(table: str, key: str, columns: str, depth: int = DEPTH) -> str:
    """(n, digest) of a table's Merkle tree, as SQL in brackets."""
    lanes = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS l{i}" for i in range(4))
    text = lambda cols: "concat_ws('|', " + ", ".join(f"coalesce(CAST({c.strip()} AS VARCHAR), '\\N')" for c in cols.split(",")) + ")"
    out = f"(WITH t{depth} AS (SELECT node, n, md5(concat_ws('|', n, l0, l1, l2, l3)) AS d FROM (SELECT substr(md5({text(key)}), 1, {depth}) AS node, count(*) AS n, {lanes} FROM (SELECT *, md5({text(columns)}) AS h FROM {table}) GROUP BY ALL))"
    for k in range(depth - 1, -1, -1):
        out += f", t{k} AS (SELECT substr(node, 1, {k}) AS node, sum(n) AS n, md5(string_agg(d, '|' ORDER BY node)) AS d FROM t{k + 1} GROUP BY 1)"
    return out + " SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS n, coalesce(max(d), md5('')) AS digest FROM t0)"
