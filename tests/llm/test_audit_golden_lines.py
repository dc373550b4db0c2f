"""Operators 11 to 13 against brute force and awkward rows; their oracles run in test_llm.py."""

import datetime as dt
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import filter_audit, line_dedup, survivorship

TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CLASHING = ["part", "mask", "n", "good", "text2", "h1", "h2", "top", "batch", "gone", "tk", "cluster_id", "rank", "field", "fresh", "trust", "order", "latest", "value", "at"]


def clashing(df):
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHING if c not in df.columns))


# --- op11 --------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails, out = [], []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                rows.append([part, order, step, len(left), len(gone), sum(x in f[1] and bool(f[1] & set(order[: step - 1])) for f in mine), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)])
        shapley = {x: sum(r[4] for r in rows if r[1][r[2] - 1] == x) for x in "ABCDE"}
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def audit_docs(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(["a", "B", "cc", "Dd", "e#", "é", "\x1c"]) if r.random() < 0.5 else f"w{r.randrange(200)}" for _ in range(r.choice([0, 3, 99, 100, 130]))]
        out.append((i, r.choice(" \n\t").join(words), r.choice(["en", "fr", None, ""])))
    out += [(1000 + i, out[r.randrange(5)][1], "en") for i in range(40)]  # copies
    out += [(-5, "copy of all", "de"), (1, None, None), (None, "copy of all", "de"), (None, None, "de"), (7, out[7][1], out[7][2]), (7, out[7][1], "fr"), (7, "another text of id 7", "fr")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_audit(spark, parts):
    docs, labels = audit_docs(1, 60), [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(2, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1)]
    got = filter_audit.filter_audit(clashing(spark.createDataFrame(docs, DOCS).repartition(parts)), clashing(spark.createDataFrame(labels, LABELS)))
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)


def test_audit_of_no_rows_and_long_texts(spark):
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    docs = [(i, "word " * 200_000, "en") for i in range(4)]
    got = filter_audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).filter("filter_order = 'EABCD'").collect()
    assert {r.step: (r.removed, r.kept) for r in got} == {1: (3, 1), 2: (0, 1), 3: (1, 0), 4: (0, 0), 5: (0, 0)}


def test_chains_part_texts_of_one_fingerprint():
    import zstandard

    pack, c, last = zstandard.ZstdCompressor().compress, filter_audit.Chains(), 16
    put = lambda t, i, parts=None: list(c.put(1, pack(t), i, 2, parts or {"p": 1}, last))
    assert put(b"x", 5) == [] and put(b"y", 9) == [] and put(b"x", 5, {"q": 2}) == []
    assert put(b"x", 7) == [(7, "p", 18, 1)] and sorted(put(b"x", 3)) == [(5, "p", 18, 1), (5, "q", 18, 2)]
    assert sorted(e[1] for _, e in c.entries()) == [3, 9]
    # the same text packed otherwise is the same text
    assert list(c.put(1, zstandard.ZstdCompressor(level=19).compress(b"y"), 10, 2, {"p": 1}, last)) == [(10, "p", 18, 1)]


# --- op12 --------------------------------------------------------------------------------------


def brute_golden(clients):
    blank = lambda s: None if s is None or not s.strip(" \t\n\x0b\x0c\r") else s
    order = {"partner": 3, "store": 2, "web": 1, "crm": 0}
    groups = {}
    for c in clients:
        groups.setdefault(c[0] if c[1] is None else c[1], []).append(c)
    out = []
    for cluster, rows in groups.items():
        latest = max((r[3] for r in rows if r[3]), default=None)
        rs = []
        for i, _, source, at, name, email, city, nation, segment, balance in rows:
            fresh = at is not None and latest - at <= dt.timedelta(hours=720)
            recent = [at is not None, at or dt.datetime.min, order.get(source, -1), i is not None, -(i or 0)]
            rs.append({"id": i, "fresh": fresh, "recent": recent, "trusted": [fresh, order.get(source, -1), *recent], "name": blank(name), "email": blank(email), "city": blank(city), "nation": nation, "segment": blank(segment), "balance": balance})

        def best(have, key):
            return max(filter(have, rs), key=key, default={})

        seg = best(lambda r: r["segment"] is not None, lambda r: (r["recent"], r["segment"]))
        mail = best(lambda r: r["email"] is not None, lambda r: (r["trusted"], r["email"]))
        name = best(lambda r: r["name"] is not None, lambda r: (len(r["name"]), r["trusted"], r["name"]))
        bal = best(lambda r: r["balance"] is not None, lambda r: (r["segment"] == seg.get("segment"), r["recent"], r["balance"]))
        n = lambda r: (r["city"] is not None) + (r["nation"] is not None)
        addr = best(lambda r: True, lambda r: (n(r), r["trusted"], r["city"] or "", -1 if r["nation"] is None else r["nation"]))
        cents = None if not bal else int(np.floor(100 * bal["balance"] + 0.5))
        out.append((cluster, len(rs), sum(not r["fresh"] for r in rs), name.get("name"), mail.get("email"), seg.get("segment"), addr["city"], addr["nation"], cents, name.get("id"), mail.get("id"), seg.get("id"), bal.get("id"), addr["id"] if n(addr) else None))
    return sorted(out, key=repr)


def client_rows(seed, n):
    r, t = random.Random(seed), dt.datetime(2024, 5, 1)
    step = [dt.timedelta(0), dt.timedelta(hours=720), dt.timedelta(hours=720, microseconds=1), dt.timedelta(days=3), dt.timedelta(days=90)]
    some = lambda *x: r.choice(x)
    rows = [
        (i, some(None, 1, 1, 2, 3), some("partner", "store", "web", "crm", "other", None, " "), some(None, t, *(t - s for s in step)), some(None, "", " \t", "Ann", "Ann Lee", "Ännä Lé", " Bob "), some(None, "", "a@x.org", "b@x.org"),
         some(None, "\n", "Ober", "Unter"), some(None, 1, 2), some(None, "", "retail", "web"), some(None, 1.005, -2.5, 10.0, 0.0))
        for i in range(n)
    ]
    return rows + [(5, 1, None, None, None, None, None, None, None, None), (None, None, "web", t, "No Id", None, "Ober", 1, "retail", 3.0), (None, 2, "web", t, "Without", "w@x.org", None, None, None, 4.0)]


def test_golden(spark):
    rows = client_rows(1, 150)
    got = survivorship.golden_records(clashing(spark.createDataFrame(rows, CLIENTS)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_golden(rows)


def test_golden_ties_and_no_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, None, "web", t, n, "a@x", "Ober", 1, s, b) for n, s, b in (("Ann", "x", 1.0), ("Bob", "y", 2.0), ("Ann", "x", 1.0))]
    got = survivorship.golden_records(spark.createDataFrame(rows, CLIENTS)).collect()
    assert [(r.name, r.segment, r.balance_cents, r.n_records) for r in got] == [("Bob", "y", 200, 3)]
    assert survivorship.golden_records(spark.createDataFrame([], CLIENTS)).count() == 0
    odd = [(1, None, "web", None, None, None, None, None, None, b) for b in (float("nan"), float("inf"))]
    assert [(r.balance_cents, r.balance_from, r.n_stale) for r in survivorship.golden_records(spark.createDataFrame(odd, CLIENTS)).collect()] == [(None, None, 2)]


def test_golden_in_another_zone(spark):
    """Times have no zone: an hour that a session's zone skips still counts."""
    t = dt.datetime(2024, 3, 31, 2, 30)
    rows = [(1, 9, "web", t, "A", None, None, None, None, None), (2, 9, "web", t - dt.timedelta(hours=720), "B", None, None, None, None, None), (3, 9, "web", t - dt.timedelta(hours=720, microseconds=1), "C", None, None, None, None, None)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r.n_stale for r in survivorship.golden_records(spark.createDataFrame(rows, CLIENTS)).collect()] == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- op13 --------------------------------------------------------------------------------------


def brute_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(TR)
    holders = {}
    for i, t, *_ in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                holders.setdefault(key(line), set()).add(i)
    top = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_docs(seed, n):
    r = random.Random(seed)
    pool = [f"line number {i} of the pool{'é' * (i % 3)}" for i in range(40)] + ["nineteen points éé.", "twenty code points é", "é" * 19, "É" * 20, "short", "", " "]
    spell = [lambda s: s, str.upper, lambda s: f"\t {s} \r", lambda s: s + "\x1c"]
    docs = [(r.randrange(-5, 200), "\n".join(r.choice(spell)(r.choice(pool)) for _ in range(r.randrange(0, 9))), "x") for _ in range(n)]
    return docs + [(None, "\n".join(pool), "x"), (3, None, "x"), (4, "", "x"), (5, "\n", "x"), (9_000, "a line that stands alone here", "x"), (1 << 62, pool[0], "x"), (-(1 << 63), pool[0], "x")] + docs[:3]


@pytest.mark.parametrize("bound", [500_000, 0])
@pytest.mark.parametrize("batches", [1, 5])
def test_lines(spark, monkeypatch, bound, batches):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", bound)
    docs = line_docs(batches, 120)
    got = line_dedup.dedup_lines(clashing(spark.createDataFrame(docs, DOCS).repartition(6)), batches=batches)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute_lines(docs)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_lines_of_no_rows_and_long_texts(spark, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", bound)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(i, "the same line for all of them\n" * 30_000 + f"own line of document {i} " * 3000, "x") for i in range(4)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {i: (30_001, 0 if i == 3 else 30_000) for i in range(4)}


def test_runs_take_batches_in_any_order_and_twice(spark):
    """Levels fill up and are compacted; a batch added again, or late, changes nothing it shouldn't."""
    r = random.Random(5)
    rows = [(r.randrange(6), 0, r.randrange(40)) for _ in range(300)]
    want = {}
    for h, _, d in rows:
        want.setdefault(h, set()).add(d)
    want = {h: max(d) for h, d in want.items() if len(d) >= 3}
    parts = [rows[i::7] for i in range(7)]
    runs = line_dedup.LineRuns(spark, 3)
    for p in [*parts, parts[2], parts[0]]:
        runs.add(spark.createDataFrame(p, "h1 long, h2 long, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 0, 0, 1]
    assert {x.h1: x.top for x in runs.common().collect()} == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_lookup_of_keys_that_share_a_half():
    keys = np.array([[1, 5], [1, 9], [1, 7], [2, 5], [-3, 0]], np.int64)
    found = line_dedup.Lookup(keys, np.arange(5)).find(np.array([[1, 7], [1, 8], [2, 5], [3, 5], [-3, 0], [-4, 0]], np.int64))
    tops = line_dedup.Lookup(keys, np.arange(5)).tops
    assert [int(tops[i]) if i >= 0 else None for i in found] == [2, None, 3, None, 4, None]


def test_query_digests_kept_lines(spark):
    from lexforge.llm.queries import QUERIES

    got = QUERIES["op13_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(docs))
