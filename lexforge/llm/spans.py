"""Spans of regular expressions as native columns: offsets in code points, no Python on executors.

``split`` and ``regexp_extract_all`` see the same leftmost, non-overlapping matches, so the running
sums of the lengths of gaps and matches are the offsets. Running values are taken block by block, so a
text with many matches costs about BLOCK steps a match, not one for each match before it.

Expressions are SQL text: one of a thousand parts is one call to the JVM, where columns put together in
Python are thousands of calls, seconds of every query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,part:string,before:string,after:string>"
BLOCK = 64
PIECE = 4096


def literal(pattern: str) -> str:
    """A regular expression as a raw SQL string."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def let(value: str, name: str, body: str) -> str:
    """The body with the value under a name, computed once: Catalyst can't inline a lambda's variable."""
    return f"transform(array({value}), {name} -> {body})[0]"


def settled(value: str) -> str:
    """The value, for a column that later steps use within higher-order functions: a condition that
    always holds, but that Catalyst takes for changing, keeps it from inlining the expression there."""
    return f"CASE WHEN spark_partition_id() >= 0 THEN {value} END"


def empty(kind: str) -> str:
    return f"CAST(array() AS array<{kind}>)"


def with_settled(df: DataFrame, **columns: str) -> DataFrame:
    """Adds columns, settled."""
    return df.selectExpr(*(f"`{c}`" for c in df.columns if c not in columns), *(f"{settled(x)} AS `{c}`" for c, x in columns.items()))


def running(values: str, add: Callable[[str, str], str], zero: str, kind: str) -> str:
    """array<kind> of zero + v0, zero + v0 + v1, ... for an associative add of values of a kind."""
    first = f"CAST({zero} AS {kind})"

    def scan(xs: str, start: str) -> str:
        step = let(add("s_.v", "x_"), "n_", f"named_struct('v', n_, 'out', CAST(concat(s_.out, array(n_)) AS array<{kind}>))")
        return f"aggregate({xs}, named_struct('v', CAST({start} AS {kind}), 'out', {empty(kind)}), (s_, x_) -> {step}, s_ -> s_.out)"

    blocks = f"transform(sequence(0, CAST(floor((size(v_) - 1) / {BLOCK}) AS int)), b_ -> slice(v_, b_ * {BLOCK} + 1, {BLOCK}))"
    sums = scan(f"transform(bs_, xs_ -> aggregate(xs_, {first}, (a_, y_) -> {add('a_', 'y_')}))", zero)
    joined = let(f"concat(array({first}), {sums})", "st_", f"flatten(transform(bs_, (xs_, k_) -> {scan('xs_', 'st_[k_]')}))")
    return let(values, "v_", f"CASE WHEN size(v_) = 0 THEN {empty(kind)} ELSE {let(blocks, 'bs_', joined)} END")


def find_all(text: str, pattern: str, group: int = 0, context: int = 0) -> str:
    """array<struct<start, end, text, part, before, after>> of all matches; part is the text of the
    group; before and after are up to `context` characters around, next to other matches fewer."""
    p = literal(pattern)
    ends = running("transform(m_.hits, (h, i) -> length(h) + length(m_.gaps[i]))", lambda a, b: f"{a} + {b}", "0", "int")
    before = f"right(concat(CASE WHEN i > 0 THEN right(m_.hits[greatest(i - 1, 0)], {context}) ELSE '' END, m_.gaps[i]), {context})" if context else "''"
    after = f"left(m_.gaps[i + 1], {context})" if context else "''"
    one = f"named_struct('start', e_[i] - length(h), 'end', e_[i], 'text', h, 'part', m_.parts[i], 'before', {before}, 'after', {after})"
    placed = let(ends, "e_", f"CAST(transform(m_.hits, (h, i) -> {one}) AS array<{SPAN}>)")
    parts = f"regexp_extract_all({text}, {p}, {group})" if group else "f_"
    some = let(f"named_struct('hits', f_, 'gaps', split({text}, {p}, -1), 'parts', {parts})", "m_", placed)
    return let(f"regexp_extract_all({text}, {p}, 0)", "f_", f"CASE WHEN size(f_) = 0 THEN {empty(SPAN)} ELSE {some} END")


_EDGE = "struct<start:int,other:int,end:int>"


def reached(df: DataFrame, out: str, ones: str, others: str, reach: int) -> DataFrame:
    """Adds array<boolean>, for each of ones (by rising start): whether one of others lies within
    `reach` characters of it; -1: whether one overlaps it. One sort and two running values. Empty if
    either is. Steps are columns of their own, as nested functions of this depth resolve slowly."""
    edge = lambda xs, kind: f"transform({xs}, s -> named_struct('start', s.start, 'other', {kind}, 'end', s.end))"
    every = f"sort_array(CAST(concat({edge(ones, 0)}, {edge(others, 1)}) AS array<{_EDGE}>))"
    df = with_settled(df, _edges=f"CASE WHEN size({ones}) = 0 OR size({others}) = 0 THEN {empty(_EDGE)} ELSE {every} END")
    side = lambda xs, c: f"transform({xs}, x -> CASE WHEN x.other = 1 THEN x.{c} END)"
    df = with_settled(df, _last=running(side("_edges", "end"), lambda a, b: f"greatest({a}, {b})", "NULL", "int"), _first=f"reverse({running(side('reverse(_edges)', 'start'), lambda a, b: f'least({a}, {b})', 'NULL', 'int')})")
    flag = f"CASE WHEN x.other = 0 THEN coalesce(_last[i] >= x.start - ({reach}), false) OR coalesce(_first[i] <= x.end + ({reach}), false) END"
    return with_settled(df, **{out: f"filter(transform(_edges, (x, i) -> {flag}), x -> x IS NOT NULL)"}).drop("_edges", "_last", "_first")


def near(df: DataFrame, out: str, ones: str, others: str, reach: int) -> DataFrame:
    """Adds those of ones that one of others lies within reach of."""
    df = reached(df, "_flags", ones, others, reach)
    return with_settled(df, **{out: f"filter({ones}, (s, i) -> get(_flags, i))"}).drop("_flags")


def apart(df: DataFrame, out: str, ones: str, others: str) -> DataFrame:
    """Adds those of ones that none of others overlaps."""
    df = reached(df, "_flags", ones, others, -1)
    return with_settled(df, **{out: f"filter({ones}, (s, i) -> NOT coalesce(get(_flags, i), false))"}).drop("_flags")


def masked(text: str, spans: str, mask: str) -> str:
    """The text with spans (by rising start) masked, overlapping ones together."""

    def piece(start: str, length: str) -> str:
        """substring, by way of fixed pieces of the text: a place far behind isn't counted up to anew."""
        two = "concat(get(p_.pieces, k_), coalesce(get(p_.pieces, k_ + 1), ''))"
        body = f"CASE WHEN {length} <= 0 THEN '' WHEN {length} <= {PIECE} THEN substring({two}, {start} - k_ * {PIECE} + 1, {length}) ELSE substring(p_.text, {start} + 1, {length}) END"
        return let(f"CAST(floor({start} / {PIECE}) AS int)", "k_", body)

    kept = let("CASE WHEN i > 0 THEN l_[greatest(i - 1, 0)] ELSE 0 END", "at_", f"CASE WHEN s.start >= at_ THEN concat({piece('at_', '(s.start - at_)')}, '{mask}') ELSE '' END")
    rebuilt = f"concat(array_join(transform(p_.spans, (s, i) -> {kept}), ''), substring(p_.text, l_[size(l_) - 1] + 1, length(p_.text)))"
    ends = running("transform(p_.spans, s -> s.end)", lambda a, b: f"greatest({a}, {b})", "0", "int")
    pieces = f"transform(sequence(0, CAST(floor(length({text}) / {PIECE}) AS int)), k -> substring({text}, k * {PIECE} + 1, {PIECE}))"
    whole = let(f"named_struct('text', {text}, 'spans', {spans}, 'pieces', {pieces})", "p_", let(ends, "l_", rebuilt))
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {whole} END"


def ranked(spans: str, kind: int) -> str:
    """As array<struct<start, kind, end>>, whose natural order is by start, then kind."""
    return f"transform({spans}, s -> named_struct('start', s.start, 'kind', {kind}, 'end', s.end))"


def listed(spans: str, names: list[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    kinds = ", ".join(f"'{n}'" for n in names)
    return f"array_join(transform(sort_array({spans}), s -> concat_ws(':', array({kinds})[s.kind], CAST(s.start AS string), CAST(s.end AS string))), ',')"


def hashed(spans: str, names: list[str]):
    """sha256 of the list, as a column."""
    return F.sha2(F.expr(listed(spans, names)), 256)
