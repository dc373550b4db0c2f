"""Operator 7: personal data by candidate gradient boosting. Native: DataFrame functions only.

High-recall generators propose overlapping spans: anything around an @ or a spelled-out one, any
longer run of digits with separators. Each candidate has format features (digits, groups,
separators, checks) and context features (a keyword before it, its neighbours). Boosted trees of depth
two give the log odds that it is personal data; candidates from a calibrated threshold of their
generator on are added to the base spans.

Labels. Base matches pass exact checks, but candidates that base finds needn't be found again. So the
positives are base matches of the documents in other spellings, in their own context (`FORMS`: without
the plus, with other separators, `name [at] host [dot] tld`), so that base no longer matches them,
base matches themselves, and well-formed candidates that a keyword supports; negatives are the documents'
other candidates that no base match overlaps, and spellings that break a check (another last digit of a card, an address part over 255). A few fixed
`SEEDS` and `OTHERS` join them, each as `WEIGHT` examples, so that a corpus without base matches has a
model too.

Fit: candidates of all documents are counted by feature vector in one aggregation. The driver receives
the counted vectors (small integers of bounded range, some thousands of kinds), never texts or ids,
boosts over those of three quarters of the documents, and sets each generator's threshold on the others:
the lowest score, of even odds or better, from which on `PRECISION` of the candidates are positives.
The trees are compiled to column expressions, so scoring is a projection without a shuffle.

Row by row: null text counts as empty, empty text has no spans, rows and their repeats stay. No added
span overlaps a base span; of an e-mail-like and a number-like candidate that overlap, the former
stands.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow
from .spans import SPAN, apart, empty, find_all, hashed, let, listed, literal, ranked, reached, with_settled

PRECISION, ROUNDS, SHRINK, CONTEXT, WEIGHT = 0.98, 60, 0.4, 24, 20
KINDS = ["email", "ip", "card", "phone", "email_like", "number_like"]
#: The base patterns, in order, written so that Java matches them without recursion
#: and in linear time: a run is entered at its start only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators. A name is what stands between white space and punctuation that no address has.
_NAME, _DOT = r"[^\s@<>,;:|()\[\]{}]++", r"\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?"
EMAIL_LIKE = rf"(?:\G|(?<![^\s@<>,;:|()\[\]{{}}])(?<!(?i:dot)\x20?[\])}}]\x20?)){_NAME}(?:{_DOT}{_NAME})*+\x20?(?:@|[\[({{]\x20?(?i:at)\x20?[\])}}])\x20?{_NAME}(?:{_DOT}{_NAME})*+"
NUMBER_LIKE = r"[+(]?[0-9][0-9\x20().\[\]-]{5,}[0-9]"
#: Context keywords by class: before the candidate, with two short words between at most; those of what
#: isn't personal right before it.
_BETWEEN = r"(?:[^\p{L}\p{N}]+\p{L}{1,6}){0,2}[^\p{L}\p{N}]*$"
CONTEXTS = [rf"(?i)(?<!\p{{L}})(?:{words}){_BETWEEN}" for words in ("phone|tel|call|mobile|fax|whatsapp|sms|dial|reach|ring", "card|visa|master|iban|account", "ip|host|server|addr|address|ping", "mail|contact|write to")] + [r"(?i)(?:version|build|release|isbn|issn|doi|pages?|date|year|order|ticket|no|nr|pp|table|section)\W*$"]
NAMES = ["gen", "digits", "plus", "luhn", "dots", "seps", "quad", "context", "glued_before", "glued_after", "domain", "groups", "longest", "brackets", "last", "lead"]

#: Other spellings of base matches t: (label, SQL of t). A blank one is none.
_PLAIN = "substring(t, 2, length(t))"
_LOCAL = r"regexp_replace(t, r'^\+[0-9]{1,3}[\x20.-]+', '')"
_GROUPED = "regexp_replace(regexp_replace(t, '[^0-9]+', ''), '([0-9]{4})', '$1%s')"
FORMS = {
    "email": [(1, "replace(t, '@', ' [at] ')"), (1, "replace(t, '@', '(at)')"), (1, "replace(t, '@', ' @ ')"), (1, "replace(replace(t, '@', ' [at] '), '.', ' [dot] ')"), (0, "regexp_replace(t, '@.*$', ' @ noon')"), (0, "regexp_replace(t, '^.*@([^.]*).*$', 'see @$1 here')")],
    "ip": [(1, "replace(t, '.', ' . ')"), (1, "replace(t, '.', '[.]')"), (0, "regexp_replace(t, '^[0-9]+', '399')"), (0, r"concat('4', regexp_replace(t, r'\.[0-9]+$', '.20481'))")],
    "card": [(1, f"rtrim('.', {_GROUPED % '.'})"), (1, f"trim({_GROUPED % '  '})"), (0, "concat(substring(t, 1, length(t) - 1), CAST((CAST(substring(t, -1, 1) AS int) + 3) % 10 AS string))")],
    "phone": [(1, _PLAIN), (1, f"concat('00', {_PLAIN})"), *((1, rf"regexp_replace({_PLAIN}, r'[\x20().-]+', '{c}')") for c in "-. "), (1, _LOCAL), *((1, f"ltrim('{c}', regexp_replace({_LOCAL}, '[^0-9]+', '{c}'))") for c in ".-")],
}
#: Base matches in a sentence, (kind, before, match, after); and what isn't personal.
SEEDS = [
    ("email", "contact ", "jane.doe@example.com", " for more"), ("email", "mail ", "info@example.org", ", or"), ("email", "as ", "j_smith99@mail.example.net", " said"), ("email", "write to ", "a.b@example.co.uk", ". Then"),
    ("ip", "server ", "192.0.2.17", " is up"), ("ip", "from ", "198.51.100.4", " and"), ("ip", "host ", "203.0.113.250", ", then"), ("ip", "the ", "10.1.20.3", " seen"),
    ("card", "card ", "4539 1488 0343 6467", " was"), ("card", "visa ", "4111111111111111", ", paid"), ("card", "with ", "5500-0000-0000-0004", " and"), ("card", "account ", "4012888888881881", " now"),
    ("phone", "call ", "+1 (555) 010-9999", " today"), ("phone", "tel ", "+44 20 7946 0958", ", or"), ("phone", "at ", "+33 1 70 36 39 50", " and"), ("phone", "phone: ", "+49-30-901820-11", " by"), ("phone", "mobile ", "+1 202-555-0143", " is"), ("phone", "or ", "+1.212.555.0187", " then"),
]
OTHERS = [
    "version 10.0.19045.3570 is out", "build 1.2.3.45678 failed", "ISBN 978-3-16-148410-0 of the book", "on 2024-01-15 2024-02-20 we met", "from 1990-2005 on", "about 1 000 000 000 people", "sum 12.345.678 units", "pi is 3.1415926535 or so", "in 2019 2020 2021 2022 and", "order no 20231105 shipped", "pages 100-250 of it", "table 1 2 3 4 5 6 7 8 9 10", "scores 12 15 18 21 24 27 30", "ticket 000123456789012345678901 open", "at 0.000000001 of it", "meet @ noon there", "12 @ 30 each", "see @someone here", "wins (2) - (1) now", "id 7f3a9876543210ffee done", "range 10.5-20.75 of", "year 1999 - 2000 it", "doi 10.1000/182 of", "section 4.2.1.10 says", "ratio 16.0000009 found", "1.000.000,00 paid", "on 01.02.2003 04.05.2006 there",
]
#: Numbers in two groups, personal only for the words before them.
CALLS = ["please call me 0171 2345678 then", "his phone number is 030 9018203 now", "tel 0221 4567890 or", "ring us on 0161 4960000 today", "fax to 0421 3334455 please", "mobile 0151 23456789 and"]
COUNTS = ["in all 0171 2345678 of them", "counted 2045 1234567 of it", "sums 120 4567890 and", "between 0161 4960000 units", "lot 0421 3334455 sold", "from 030 9018203 on"]


def digits_of(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]+', '')"


def luhn(digits: str) -> str:
    """Of a string of digits; right to left, every second digit doubled."""
    value = let("CAST(substring(d_, -j_, 1) AS int) * CASE WHEN j_ % 2 = 0 THEN 2 ELSE 1 END", "y_", "CASE WHEN y_ > 9 THEN y_ - 9 ELSE y_ END")
    return let(digits, "d_", f"(aggregate(sequence(1, length(d_)), 0, (a_, j_) -> a_ + {value}) % 10 = 0)")


def small_parts(ip: str) -> str:
    """Whether every dotted part is at most 255, whatever its length and leading zeros."""
    part = let("regexp_replace(p_, '^0+', '')", "q_", "(length(q_) < 3 OR (length(q_) = 3 AND q_ <= '255'))")
    return rf"forall(split({ip}, r'\.'), p_ -> {part})"


def base_spans(docs: DataFrame, context: int = 0) -> DataFrame:
    """doc_id, text, email, ip, card, phone: arrays of spans; and base, all as (start, kind, end)."""
    has = r"text RLIKE r'[0-9]{3}|[0-9][\x20.-][0-9]'"  # most prose has no such digits: three passes saved
    n_digits = f"length({digits_of('s.text')})"
    only = lambda condition, found: f"CASE WHEN {condition} THEN {found} ELSE {empty(SPAN)} END"
    kept = lambda pattern, good: f"filter({find_all('text', pattern, 0, context)}, s -> {good})"
    found = with_settled(
        docs.select("doc_id", "text"),
        email=only("contains(text, '@')", find_all("text", EMAIL, 0, context)),
        ip=only(r"text RLIKE r'[0-9]\.[0-9]'", kept(IP, small_parts("s.text"))),
        card=only(has, kept(CARD, f"CASE WHEN {n_digits} BETWEEN 12 AND 19 THEN {luhn(digits_of('s.text'))} ELSE false END")),
        phone=only("contains(text, '+')", kept(PHONE, f"{n_digits} BETWEEN 9 AND 15")),
    )
    return with_settled(found, base=f"concat({', '.join(ranked(k, i) for i, k in enumerate(KINDS[:4]))})")


CAND = "struct<start:int,kind:int,end:int,hit:boolean,f:array<int>>"


def features(gen: int) -> list[str]:
    """SQL of a candidate s's features, as in NAMES."""
    flag = lambda c: f"coalesce({c}, false)"
    digits, groups = "c_.d", "c_.g"
    context = "CASE " + " ".join(f"WHEN s.before RLIKE {literal(p)} THEN {k}" for k, p in reversed([*enumerate(CONTEXTS, 1)])) + " ELSE 0 END"
    dots = r"regexp_replace(s.text, '[^.]+', '')"
    return [
        str(gen),
        f"least(length({digits}), 20)",
        flag("contains(s.text, '+')"),
        flag(f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn(digits)} END"),
        f"least(length({dots}), 4)",
        r"least(length(regexp_replace(s.text, r'[^\x20()-]+', '')), 9)",
        flag(f"CASE WHEN s.text RLIKE '^[0-9]+([^0-9]{{1,3}}[0-9]+){{3}}$' THEN {small_parts(_DOTTED)} END"),
        context,
        flag(r"s.before RLIKE r'[\p{L}\p{N}]$'"),
        flag(r"s.after RLIKE r'^[\p{L}\p{N}]'"),
        flag(r"s.text RLIKE r'(?i)(?:@|at[\])}])\x20?[a-z0-9-]+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[a-z0-9-]+)+\.?$'"),
        f"least(size({groups}), 9)",
        f"least(coalesce(array_max(transform({groups}, g -> length(g))), 0), 17)",
        flag(r"s.text RLIKE r'[()\[\]]'"),
        f"least(coalesce(length(try_element_at({groups}, -1)), 0), 17)",
        r"CASE WHEN s.text RLIKE r'^[+(]*00' THEN 2 WHEN s.text RLIKE r'^[+(]*0' THEN 1 ELSE 0 END",
    ]


_DOTTED = "regexp_replace(s.text, '[^0-9]+', '.')"


def with_candidates(spans: DataFrame) -> DataFrame:
    """Adds c0 and c1, the generators' candidates with features; hit: overlaps a base span."""
    likely = r"contains(text, '@') OR text RLIKE r'(?i)[\[({]\x20?at\x20?[\])}]'"
    digits = r"text RLIKE r'[0-9][0-9\x20().\[\]-]{5,}[0-9]'"
    only = lambda condition, pattern: f"CASE WHEN {condition} THEN {find_all('text', pattern, 0, CONTEXT)} ELSE {empty(SPAN)} END"
    found = with_settled(spans, g0=only(likely, EMAIL_LIKE), g1=only(digits, NUMBER_LIKE))
    for gen in (0, 1):
        found = reached(found, f"h{gen}", f"g{gen}", "base", -1)
        parts = f"named_struct('d', {digits_of('s.text')}, 'g', filter(split(s.text, '[^0-9]+', -1), g -> g <> ''))"
        f = let(parts, "c_", f"array({', '.join(f'CAST({x} AS int)' for x in features(gen))})")
        one = f"named_struct('start', s.start, 'kind', {4 + gen}, 'end', s.end, 'hit', coalesce(get(h{gen}, i), false), 'f', {f})"
        found = with_settled(found, **{f"c{gen}": f"CAST(transform(g{gen}, (s, i) -> {one}) AS array<{CAND}>)"}).drop(f"g{gen}", f"h{gen}")
    return found


def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> dict:
    """Trees of depth two over counted feature vectors, by Newton boosting of the logistic loss."""
    n = pos + neg
    f = np.full(len(x), np.log((pos.sum() + 1) / (neg.sum() + 1)))
    start, trees = float(f[0]) if len(f) else 0.0, []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        out = (0.0, -1, 0)
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(x.shape[1]):
            v = x[rows, j]
            cuts = np.unique(v)[1:]
            if len(cuts):  # sums below each cut, from one pass over the values
                gl, hl = (np.cumsum(np.bincount(v, w[rows]))[cuts - 1] for w in (g, h))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > out[0] + 1e-9:
                    out = (float(gain[k]), j, int(cuts[k]))
        return out

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = pos - n * p, n * p * (1 - p)
        leaf = lambda rows, g=g, h=h: float(np.clip(SHRINK * g[rows].sum() / (h[rows].sum() + 1), -2, 2))
        rows = np.ones(len(x), bool)
        _, j, c = best(rows, g, h)
        if j < 0:
            break
        sides = []
        for side in (rows & (x[:, j] < c), rows & (x[:, j] >= c)):
            _, j2, c2 = best(side, g, h)
            a, b = (side & (x[:, j2] < c2), side & (x[:, j2] >= c2)) if j2 >= 0 else (side, side)
            sides.append((max(j2, 0), c2, leaf(a), leaf(b)))
            f[a] += leaf(a)
            if j2 >= 0:
                f[b] += leaf(b)
        trees.append((j, c, *sides))
    return {"start": start, "trees": trees}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """The trees' log odds; as compiled() does it in columns."""
    f = np.full(len(x), model["start"])
    for j, c, (a, ca, la, ha), (b, cb, lb, hb) in model["trees"]:
        f += np.where(x[:, j] < c, np.where(x[:, a] < ca, la, ha), np.where(x[:, b] < cb, lb, hb))
    return f


def calibrated(f: np.ndarray, pos: np.ndarray, n: np.ndarray) -> float:
    """The lowest score, of even odds or better, from which on PRECISION of the candidates are positive."""
    least, good, seen = np.inf, 0.0, 0.0
    for value in np.unique(f)[::-1]:  # candidates of one score stand or fall together
        good, seen = good + pos[f == value].sum(), seen + n[f == value].sum()
        if value < 0 or good < PRECISION * seen:
            break
        least = float(value)
    return least


def compiled(model: dict, f: str) -> str:
    """The trees as one SQL expression over the feature array."""
    leaf = lambda side: f"CASE WHEN {f}[{side[0]}] < {side[1]} THEN {side[2]!r}D ELSE {side[3]!r}D END"
    return " + ".join([f"{model['start']!r}D", *(f"CASE WHEN {f}[{j}] < {c} THEN {leaf(left)} ELSE {leaf(right)} END" for j, c, left, right in model["trees"])])


def examples(docs: DataFrame) -> DataFrame:
    """(f, label, held, w) of candidates to learn from; held: for the threshold; w: weight. One plan: the
    documents' texts, what isn't personal, and the other spellings of base matches, each in a text of
    its own, pass the generators together."""
    spark = docs.sparkSession
    tag = "struct<held:boolean,w:int,label:int,a:int,b:int>"
    tagged = lambda df, held, w, label, a, b, text: df.selectExpr(f"CAST(named_struct('held', {held}, 'w', {w}, 'label', {label}, 'a', {a}, 'b', {b}) AS {tag}) AS doc_id", f"{text} AS text")
    held = "pmod(xxhash64(11, doc_id), 4) = 0"
    own = tagged(docs, held, 1, "NULL", "NULL", "NULL", "text")
    fixed = [(t, label, h) for label, texts in ((0, OTHERS), (1, CALLS), (0, COUNTS)) for t in texts for h in (False, True)]
    other = tagged(spark.createDataFrame(fixed, "t string, l int, h boolean"), "h", WEIGHT, "l", 0, "length(t)", "t")
    base = base_spans(docs, CONTEXT)
    matches = base.selectExpr(f"{held} AS held", f"explode(concat({', '.join(f'transform({k}, s -> struct({chr(39)}{k}{chr(39)} AS kind, s.before, s.text AS t, s.after))' for k in KINDS[:4])})) AS s").selectExpr("held", "s.*", "1 AS w")
    seeds = spark.createDataFrame([(i % 4 == 3, *x, WEIGHT) for i, x in enumerate(SEEDS)], "held boolean, kind string, before string, t string, after string, w int")
    spelled = "CASE kind " + " ".join(f"WHEN '{k}' THEN array({', '.join(f'struct({label} AS label, {form} AS t)' for label, form in forms)})" for k, forms in FORMS.items()) + " END"
    each = matches.unionByName(seeds).selectExpr("held", "before", "after", "w", f"explode({spelled}) AS x")
    new = tagged(each, "held", "w", "x.label", "length(before)", "length(concat(before, x.t))", "concat(before, x.t, after)")
    c = with_candidates(base_spans(own.unionByName(other).unionByName(new))).selectExpr("doc_id.*", "explode(concat(c0, c1)) AS c")
    f = {name: f"c.f[{k}]" for k, name in enumerate(NAMES)}
    clean = f"{f['glued_before']} = 0 AND {f['glued_after']} = 0"
    kinds = f"({f['context']} = 1 AND {f['digits']} BETWEEN 7 AND 15) OR ({f['context']} = 2 AND {f['luhn']} = 1) OR ({f['context']} = 3 AND {f['quad']} = 1)"
    supported = f"({f['gen']} = 0 AND {f['domain']} = 1) OR ({clean} AND {f['gen']} = 1 AND ({kinds}))"
    # a text of the documents counts whole; of another, candidates over its subject that base doesn't find
    told = c.filter("label IS NULL OR (NOT c.hit AND c.start < b AND c.end > a)")
    return told.selectExpr("c.f AS f", f"coalesce(label, CAST(c.hit OR {supported} AS int)) AS label", "held", "w")


def fit(docs: DataFrame) -> dict:
    docs = docs.filter("doc_id is not null")
    cells = examples(docs).groupBy("f", "held").agg(F.sum(F.col("label") * F.col("w")).alias("pos"), F.sum("w").alias("n")).orderBy(F.desc("n"), "f", "held").collect()
    x = np.array([r.f for r in cells], np.int64).reshape(-1, len(NAMES))
    pos, n, held = (np.array([r[k] for r in cells], float) for k in ("pos", "n", "held"))
    learn = held == 0
    model = boost(x[learn], pos[learn], (n - pos)[learn])
    f = scores(model, x)
    model["least"] = [calibrated(f[mine], pos[mine], n[mine]) for mine in ((held == 1) & (x[:, 0] == gen) for gen in (0, 1))]
    return model


def pii_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, text, email, ip, card, phone, base, extra (start, kind, end)."""
    model = model or fit(docs)
    found = with_candidates(base_spans(docs))
    for gen, least in enumerate(model["least"]):
        found = with_settled(found, **{f"c{gen}": f"filter(c{gen}, c -> NOT c.hit AND {compiled(model, 'c.f')} >= {least!r}D)" if np.isfinite(least) else empty(CAND)})
    found = apart(found, "c1", "c1", "c0")
    plain = lambda c: f"transform({c}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"
    return with_settled(found, extra=f"concat({plain('c0')}, {plain('c1')})").select("doc_id", "text", *KINDS[:4], "base", "extra")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    s = pii_spans(narrow(docs))
    return s.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]),
        hashed("base", KINDS).alias("base_sha256"),
        F.expr(listed("concat(base, extra)", KINDS)).alias("spans"),
        F.size("extra").cast("bigint").alias("n_added"),
    )
