"""Semantics on small hand-made tables."""

import gzip
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from lexforge import adapters
from lexforge.functions import tables
from lexforge.functions import text as T
from lexforge.functions.stem import stem_word
from lexforge.operators import cells, citations, delta, derive, evaluation, index, merkle, relations, retrieval, search, segments
from lexforge.plans import retrieval as retrieval_plans
from lexforge.sources import archives, xml
from lexforge.streaming import changelog


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_asof_pins_versions(spark):
    d = spark.createDataFrame([("V1", "1973-07-14", "1981-05-16"), ("V2", "1981-05-16", None)], "id string, valid_from string, valid_to string")
    d = d.select("id", F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"))
    at = lambda day: [r.id for r in d.filter(retrieval.asof(day)).collect()]
    assert at("1975-01-01") == ["V1"] and at("1981-05-16") == ["V2"] and at("1960-01-01") == []


def test_text_functions(spark):
    assert one(spark, T.fold(F.lit("Élève Œuvre"))) == "eleve oeuvre"
    assert one(spark, T.code_hint(F.lit("article 5 du Code Pénal"))) == "code penal"
    assert one(spark, T.valid_date(F.lit("2023-02-29"))) is None and str(one(spark, T.valid_date(F.lit("2024-02-29")))) == "2024-02-29"
    assert one(spark, T.valid_date(F.lit("2999-01-01"))) is None
    assert one(spark, T.uid(F.lit("x LEGIARTI000000000012"), "LEGIARTI")) == "LEGIARTI000000000012"
    assert one(spark, T.article_number(F.lit("l. 121‑3"))) == "L121-3"
    assert one(spark, T.html_text(F.lit("<p>a  b</p><i>c</i><br/>"))) == "a b\nc"


#: Words and their stems, of the stemmer's published sample.
STEMS = "continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel continuelle continuel continuellement continuel continuelles continuel continuels continuel continuer continu continuera continu continuerait continu continueront continu continuez continu continuité continu continuons continuon contorsions contors contour contour contournait contourn contournant contourn contourne contourn contours contour contractait contract contracté contract contractée contract contracter contract contractés contract contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr contraint contraint contrainte contraint contraintes contraint contraire contrair contraires contrair contraria contrari main main mains main maintenaient mainten maintenait mainten maintenant mainten maintenir mainten maintenue maintenu maintien maintien maintint maintint maire mair maires mair mairie mair mais mais maison maison maisons maison maistre maistr maitre maitr maître maîtr maîtres maîtr maîtresse maîtress maîtresses maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeur majeur majeure majeur major major majordome majordom majordomes majordom majorité major majorités major mal mal malacca malacc malade malad malades malad maladie malad maladies malad maladive malad".split()


def test_french_stems():
    assert [stem_word(w) for w in STEMS[::2]] == STEMS[1::2]
    assert stem_word("") == "" and stem_word("y") == "y" and stem_word("123") == "123"


def test_cursors():
    for c in (retrieval.Cursor("chunk", 0.5, None, "chunk:a:0"), retrieval.Cursor("document", 0.5, None, "a:b"), retrieval.Cursor("chunk", 0.5, "core", "x:y:z")):
        assert retrieval.parse_cursor(c.encode(), c.group) == c
    with pytest.raises(ValueError):
        retrieval.parse_cursor("doc:0.5:x", "chunk")
    with pytest.raises(ValueError):
        retrieval.query_terms("?!")
    with pytest.raises(ValueError):
        retrieval.rrf_weights(lexical=float("nan"))
    assert retrieval.implied_rank(1 / 65) == 5


def test_authority_rerank_moves_within_band_and_order(spark):
    rows = [(1, 1, "a", 0, 1.0), (1, 2, "a", 3, 0.99), (1, 3, "b", 3, 0.98), (1, 4, "a", 3, 0.5)]
    got = retrieval.authority_rerank(spark.createDataFrame(rows, "query_id long, id long, order_key string, tier long, score double"), 0.3)
    assert [r.id for r in got.orderBy("position").collect()] == [2, 1, 3, 4]


def test_chunks_and_hierarchy(spark):
    assert derive.pack_paragraphs("aa\nbb\ncccc", 5) == ["aa\nbb", "cccc"]
    assert derive.pack_paragraphs("abcdefg", 3) == ["abc", "def", "g"]
    links = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(n).alias("level")) for t, n in (("Livre I", 1), ("Section gap", 3), ("Livre II", 1), ("Titre II", 2))))
    assert one(spark, derive.toc_stack(links)) == ["Livre II", "Titre II"]
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, derive.overlap_merge(a("x", "y"), a("y", "z"))) == ["x", "y", "z"]
    assert one(spark, derive.decision_part("dispositif", F.lit("a PAR CES MOTIFS b PAR CES MOTIFS : casse"), F.lit(None).cast("string"))).startswith("PAR CES MOTIFS : casse")
    assert derive.pack_lines(["aaaa", "bb", "c"], 4) == ["aaaa", "bb\nc"]


def test_inferred_citations(spark):
    d = spark.createDataFrame([("d", "article L. 1-2 puis article 7 du code civil, article 9 seul, articles R1\u20112 et é" + "é" * 60 + " du code x")], "id string, body string")
    got = d.select(derive.inferred_citations(F.col("id"), F.col("body")).alias("x")).first().x
    assert [(g.number, g.code) for g in got] == [("L1-2", ""), ("7", "code civil"), ("R1-2", "")]  # the window is of 80 bytes


def test_embeddings_are_checked(spark):
    c = spark.createDataFrame([(k, "x" * k) for k in range(70)], "chunk_id long, body string")

    def flaky():
        calls = []

        def provider(texts):
            calls.append(1)
            if len(calls) % 3:
                raise OSError("busy")
            assert len(texts) <= 32 and all(len(t) <= 50 for t in texts)
            return [[1.0, 0.0] for _ in texts]

        return provider

    def down(texts):
        raise OSError("down")

    assert derive.embed(c.coalesce(1), flaky(), 2, 50).count() == 70
    for bad, message in ((lambda ts: [[1.0] for _ in ts], "dimension"), (lambda ts: [[1.0, 1.0] for _ in ts], "normalised"), (down, "down")):
        with pytest.raises(Exception, match=message):
            derive.embed(c, bad, 2, 50).collect()


def test_strict_citations_and_readiness_fail(spark):
    s = spark.createDataFrame([("x", "exact"), ("y", "ambiguous")], "cite string, state string")
    assert citations.cite_strict(s.filter("state = 'exact'")).count() == 1
    with pytest.raises(Exception, match="failed for `y` with state `ambiguous`"):
        citations.cite_strict(s).collect()
    c = spark.createDataFrame([("a", 5, 5, 5, 4)], "corpus string, documents long, projected long, chunks long, embedded long")
    with pytest.raises(Exception, match="corpus a is incomplete"):
        relations.readiness_stamp(c, True).collect()
    with pytest.raises(Exception, match="no compact timestamp"):
        delta.ingest_cursor(spark.createDataFrame([("s", "completed", "2024", None)], "source string, status string, stamp string, member_limited boolean")).collect()


def test_stored_index_and_cells(spark, tmp_path):
    """Scores of the stored index are those of the formula."""
    sf = "/root/testdata/sf0.001"
    terms, chunks = ["the", "mit", "de"], adapters.chunks(spark, sf)
    d = adapters.docs(spark, sf).select("document_id", "kind", "source", "lang", "valid_from", "valid_to")
    want = {r.chunk_id: r.score for r in retrieval.bm25_scores(chunks, terms).collect()}
    for buckets in (1, 8):
        path = f"{tmp_path}/index{buckets}"
        index.build(chunks.join(d, "document_id"), path)
        i = index.open_index(spark, path)
        got = {r.chunk_id: r.score for r in i.scores(terms).collect()}
        assert got == want and i.scores(["nosuchword"]).count() == 0
    plan = spark._sc._jvm.PythonSQLUtils.explainString(i.scores(terms)._jdf.queryExecution(), "formatted")
    assert any("PartitionFilters: [" in x and "bucket" in x for x in plan.split("\n")) and any("PushedFilters: [" in x and "In(term" in x for x in plan.split("\n"))
    index.build(chunks.join(d, "document_id"), f"{tmp_path}/french", index.french)
    assert one(spark, index.french(F.lit("Les Maisons des contrées"))) == ["maison", "contre"] and index.open_index(spark, f"{tmp_path}/french").n == chunks.count()
    words = ["", "a", "é", "license", "x" * 40]
    assert one(spark, F.array(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(7)) for w in words))) == [index.bucket_of(w, 7) for w in words]


def test_cells_find_what_the_scan_finds(spark, tmp_path):
    """All cells give the exact order; the manifest's probes, well under half of the cells, nine tenths of it."""
    v = retrieval_plans.vectors(spark, "/root/testdata/sf0.01")
    path = f"file://{tmp_path}/cells"
    m = cells.build(v, v.select("document_id"), path, 64, "fp")
    assert m["probes"] < m["lists"] / 2 and m["curve"][-1] == [m["lists"], 1.0] or m["curve"][-1] == (m["lists"], 1.0)
    stored = spark.read.parquet(f"{tmp_path}/cells/cells")
    assert stored.select("document_id").distinct().count() == v.count() and stored.groupBy("document_id").count().filter("count > 2").count() == 0
    hits = []
    for q in v.filter("document_id % 50 = 1").collect():
        top = [r.document_id for r in retrieval.dense_topk(v, list(q.embedding), 10, pool=1).orderBy("rank").collect()]
        assert top == [r.document_id for r in cells.search(spark, path, list(q.embedding), 10, m["lists"]).orderBy("rank").collect()]
        hits.append(len(set(top) & {r.document_id for r in cells.search(spark, path, list(q.embedding), 10, None, "fp").collect()}) / 10)
    assert sum(hits) / len(hits) >= 0.9
    rare = cells.search(spark, path, list(q.embedding), 5, 1, "fp", F.col("document_id") % 97 == 0, 0).collect()
    assert len(rare) == 5 and all(r.document_id % 97 == 0 for r in rare)
    with pytest.raises(ValueError, match="missing"):
        cells.build(v, spark.range(10**6, 10**6 + 1).toDF("document_id"), f"file://{tmp_path}/other", 2, "fp")
    with pytest.raises(ValueError, match="fingerprint_mismatch"):
        cells.search(spark, path, [0.0] * 64, 5, fingerprint="other")


def test_best_blocks_give_the_full_order(spark, tmp_path, monkeypatch):
    """Whatever the query and the filter, the pruned search is the full one, and mostly reads a part of it."""
    monkeypatch.setattr(index, "SMALL", 0)
    monkeypatch.setattr(index, "FIRST", 4)
    i = adapters.indexed(spark, "/root/testdata/sf0.01")
    keep, read = F.col("kind") == "decision", []
    order = [F.desc("score"), F.asc("chunk_id")]
    for terms in (["the", "mit", "license"], ["license"], ["the", "and", "of", "de", "la"], ["mit", "nosuchword"], ["der", "die", "das", "und"], ["license", "apache"]):
        for k, where in ((3, None), (10, keep), (10, F.col("document_id") % 50 == 3)):
            told = {}
            got = [(r.chunk_id, r.score) for r in i.best(terms, k, where, told).orderBy(*order).collect()]
            assert got == [(r.chunk_id, r.score) for r in i.scores(terms, where).orderBy(*order).limit(k).collect()], (terms, k)
            read.append(told["read"] / max(told["postings"], 1))
    assert min(read) < 0.5 and sum(x < 1 for x in read) >= len(read) / 3, read


def test_canonical_json():
    assert delta.canonical_json({"b": 1, "a": [True]}) == '{"a":[true],"b":1}'
    with pytest.raises(ValueError):
        delta.canonical_json(float("nan"))


def test_a_broken_apply_leaves_the_old_generation(spark, tmp_path):
    g = delta.Generations(spark, f"file://{tmp_path}")
    t = spark.createDataFrame([(1, "a")], "id long, x string")
    whole = {"documents": segments.Table(t, ["id"])}
    r = merkle.table_digest(t, ["id"], ["id", "x"]).first()
    with pytest.raises(delta.Rejected, match="digest_mismatch"):
        g.load(delta.Baseline("b", "baseline", 4), "d", whole, expected={"documents": (1, "no")})
    assert g.state() is None
    assert g.load(delta.Baseline("b", "baseline", 4), "d", whole, delta.Stamps(24, "f", (("c", "1"),)), {"documents": (r.n, r.digest)}) == "applied"
    bad = t.select(F.raise_error(F.lit("broken")).cast("long").alias("id"), "x")
    with pytest.raises(Exception, match="broken"):
        g.apply(delta.Package("p5", "d5", 4, 5, stamps=delta.Stamps(24, "f", (("c", "1"),))), {"documents": segments.Delta(bad)})
    with pytest.raises(delta.Rejected, match="builder_version_mismatch"):
        g.apply(delta.Package("p5", "d5", 4, 5, stamps=delta.Stamps(24, "f", (("c", "2"),))), {"documents": segments.Delta(t)})
    assert g.state().sequence == 4 and g.state().stamps.builders == (("c", "1"),) and g.read("documents").count() == 1


def test_evaluation_helpers():
    a, b = [0.0, 1.0, None, 1.0, 0.5], [0.0, 0.5, 1.0, None, 0.25]
    point, low, high = evaluation.bootstrap_ci(a, b, 200)
    assert point == pytest.approx(2.5 / 4 - 1.75 / 4) and low <= point <= high
    rng, draws = evaluation.xorshift64(0x6A75726973656172 ^ 5), []
    for _ in range(200):  # the same by hand
        pick = [next(rng) % 5 for _ in range(5)]
        means = [[x[i] for i in pick if x[i] is not None] for x in (a, b)]
        if all(means):
            draws.append(sum(means[0]) / len(means[0]) - sum(means[1]) / len(means[1]))
    draws.sort()
    assert (low, high) == (draws[int(0.025 * len(draws))], draws[int(0.975 * len(draws))])
    assert sorted(evaluation.blind_pool([1, 2, 3], "q")) == [1, 2, 3] and evaluation.blind_pool([1, 2, 3], "q") == evaluation.blind_pool([1, 2, 3], "q")
    assert evaluation.sign_test([1, 1, 1], [0, 0, 0]) == (3, 0, 0.25)


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        x = b"<ARTICLE><META><META_COMMUN><ID>LEGIARTI000000000001</ID><NATURE>Article</NATURE></META_COMMUN><META_ARTICLE><DATE_DEBUT>2000-01-01</DATE_DEBUT><DATE_FIN>2999-01-01</DATE_FIN></META_ARTICLE></META><BLOC_TEXTUEL><CONTENU><p>Un  <i>texte</i></p><p>deux</p></CONTENU></BLOC_TEXTUEL><LIENS><LIEN id='LEGIARTI000000000002'>x</LIEN></LIENS></ARTICLE>"
        info = tarfile.TarInfo("a/b.xml")
        info.size = len(x)
        tar.addfile(info, io.BytesIO(x))
    (tmp_path / "LEGI_20240101-000000.tar.gz").write_bytes(data.getvalue())
    (tmp_path / "LEGI_20240102-000000.tar.gz").write_bytes(gzip.compress(b"not a tar")[:-6])
    rows = archives.read_archives(spark, str(tmp_path)).cache()
    assert sorted(r.ok for r in archives.verify_archives(rows).collect()) == [False, True]
    r = xml.parse_members(rows, "legi").first()
    assert (r.document_id, r.body, r.valid_to, r.links[0].target, r.error) == ("legi:LEGIARTI000000000001@2000-01-01", "Un texte\ndeux", None, "LEGIARTI000000000002", None)
    assert xml.parse(b"<OTHER/>", "legi")["error"].startswith("unsupported root")
    assert xml.parse(b"<ARTICLE>", "legi")["error"].startswith("malformed")
    whole = archives.members_of(spark.read.format("binaryFile").load(str(tmp_path))).drop("archive").collect()
    assert sorted(map(str, whole)) == sorted(map(str, rows.drop("archive").collect()))
    small = archives.read_archives(spark, str(tmp_path), limit=10)
    assert all("more than 10" in r.error or "Error" in r.error for r in small.collect())


def test_embeddings_are_guarded(spark, tmp_path):
    s = segments.Store(spark, f"file://{tmp_path}")
    s.create({"e": segments.Table(spark.createDataFrame([], "chunk_id long, embedding_fingerprint string, seq int"), ["chunk_id"])})
    c = spark.createDataFrame([(1, "fp"), (2, "other")], "chunk_id long, embedding_fingerprint string")
    for bad in (2, 3):
        rows = spark.createDataFrame([(1, "fp", 1), (bad, "fp", 1)], "chunk_id long, embedding_fingerprint string, seq int")
        with pytest.raises(Exception, match=f"fingerprint for chunk {bad}"):
            archives.upsert_embeddings(s, "e", rows, c, "seq")
        assert s.version() == 1 and s.read("e").count() == 0


def test_archive_plan(spark):
    names = ["Freemium_legi_global_20240101-000000.tar.gz", "Freemium_legi_global_20230101-000000.tar.gz", "LEGI_20240102-000000.tar.gz", "LEGI_20231231-000000.tar.gz", "CASS_20240102-000000.tar.gz"]
    plan = archives.plan_archives(spark.createDataFrame([(n,) for n in names], "name string"), "legi")
    assert [r.action for n in names for r in plan.filter(F.col("name") == n).collect()] == ["baseline", "older_baseline", "delta", "delta_not_after_selected_baseline", "unrecognized_filename"]
    assert [r.action for r in archives.select_archives(plan).collect()] == ["baseline", "delta"]


def changes_of(spark, path, numbers):
    rows = [(k, k % 3, "purchase" if k % 5 == 0 else "view") for k in numbers]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").select("event_id", F.timestamp_seconds("event_id").alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.mode("append").parquet(path)


def test_stream_goes_on_and_applies_once(spark, tmp_path):
    path, root = f"{tmp_path}/log", f"file://{tmp_path}/state"
    changes_of(spark, path, range(10))
    a = changelog.Applier(spark, root)
    changelog.run_available(changelog.change_stream(spark, path), a)
    want = lambda ks: {s: (max(k for k in ks if k % 3 == s), sum(k % 3 == s for k in ks)) for s in range(3)}
    got = lambda: {r.scope: (r.last_seq, r.n) for r in a.scopes().collect()}
    assert got() == want(range(10)) and a.state()["high"] == 9
    batch = spark.read.parquet(path).select(F.col("event_id").alias("change_seq"), "ts", F.col("user_id").alias("scope"), F.lit("upsert").alias("op"))
    a(batch, a.state()["batch"])  # the same batch again
    assert got() == want(range(10))
    changes_of(spark, path, [10, 11])
    changelog.run_available(changelog.change_stream(spark, path), changelog.Applier(spark, root))
    assert got() == want(range(12))


def test_a_gap_is_held_and_released(spark, tmp_path, monkeypatch):
    """Batches 1, 2, 4, 5, then 3, 6 and 4 again, then 8, 7: nothing is lost or comes twice, also after a restart."""
    monkeypatch.setattr(changelog, "RUN", 2)
    root, path = f"file://{tmp_path}/state", f"{tmp_path}/log"
    kind = "corpus string, change_seq long, ts timestamp, scope long, op string"
    out = []

    def come(*seqs):
        rows = [(c, k, k % 3, "upsert") for c in ("a", "b") for k in seqs if (c, k) != ("b", 3)]
        spark.createDataFrame(rows, "corpus string, change_seq long, scope long, op string").select("corpus", "change_seq", F.timestamp_seconds("change_seq").alias("ts"), "scope", "op").coalesce(1).write.mode("append").parquet(path)
        s = changelog.in_order(spark.readStream.schema(kind).parquet(path), first=1)
        changelog.run_available(s, lambda batch, _: out.extend((r.corpus, r.change_seq, r.scope, int(r.ts.timestamp())) for r in batch.collect()), root)
        return [k for c, k, *_ in out if c == "a"]

    assert come(5, 2, 4, 1) == [1, 2]
    assert [tuple(r) for r in changelog.held_back(spark, root).orderBy("corpus").collect()] == [("a", 3, 4, 1), ("b", 3, 4, 1)]
    assert come(3, 4, 6) == [1, 2, 3, 4, 5, 6]
    assert come(8, 7, 2) == list(range(1, 9))
    assert all(scope == k % 3 and ts == k for _, k, scope, ts in out)
    assert [k for c, k, *_ in out if c == "b"] == [1, 2]  # b's third never came
    assert [r.corpus for r in changelog.held_back(spark, root).collect()] == ["b"]


def test_cached_rows_hold_back_repeats(spark, tmp_path):
    """Within a status's lifetime a repeat is dropped; at its end the timer lets the next one pass."""
    day, path, root = 86_400, f"{tmp_path}/in", f"file://{tmp_path}/state"
    out = []

    def come(*rows):
        spark.createDataFrame(rows, "document_id string, status string, s long").select("document_id", "status", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("fetched_at")).coalesce(1).write.mode("append").parquet(path)
        s = changelog.while_cached(spark.readStream.schema("document_id string, status string, fetched_at timestamp").parquet(path))
        changelog.run_available(s, lambda batch, _: out.extend((r.document_id, r.status, int(r.fetched_at.timestamp()) - 1_700_000_000) for r in batch.collect()), root)
        return sorted(out)

    first = [("d", "ok", 0), ("e", "upstream_error", 0), ("e", "upstream_error", 3600)]
    assert come(("d", "ok", 5), ("d", "ok", 0), ("e", "upstream_error", 0), ("e", "upstream_error", 3600)) == first
    assert come(("d", "ok", 29 * day), ("f", "not_found", 40 * day)) == sorted([*first, ("f", "not_found", 40 * day)])
    assert come(("d", "ok", 41 * day)) == sorted([*first, ("f", "not_found", 40 * day), ("d", "ok", 41 * day)])
    state = spark.read.format("statestore").option("path", f"{root}/offsets").option("stateVarName", "until").load()
    assert {r.k for r in state.filter("value.ms is not null").select(F.col("key.document_id").alias("k")).collect()} == {"d", "f"}


def test_polling_tells_faults_apart():
    steps = iter([True, True, False, OSError(), OSError(), OSError(), delta.Rejected(delta.Reject.SEQUENCE_GAP, "x"), False])
    slept = []

    def cycle():
        x = next(steps)
        if isinstance(x, Exception):
            raise x
        return x

    done = changelog.poll(cycle, 8, 10.0, (1.0, 3.0), sleep=slept.append)
    assert [k.value for k, _ in done] == ["progress", "progress", "up_to_date", "retryable", "retryable", "retryable", "rejected", "up_to_date"]
    assert slept == [10.0, 1.0, 2.0, 3.0, 10.0, 10.0]


def test_bootstrap_rounds_jump_to_their_draws(spark):
    rng, draws = evaluation.xorshift64(99), []
    for _ in range(1000):
        draws.append(next(rng))
    assert [evaluation.jumped(99, k) for k in (1, 7, 64, 1000)] == [draws[k - 1] for k in (1, 7, 64, 1000)]
    r = random.Random(4)
    for n in (1, 7, 400):
        a, b = ([r.choice([None, r.random(), 0.5]) for _ in range(n)] for _ in range(2))
        rows = [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
        r.shuffle(rows)
        got = tuple(evaluation.bootstrap_rounds(spark.createDataFrame(rows, "key long, a double, b double"), 90).first())
        assert str(got) == str(tuple(map(float, evaluation.bootstrap_ci(a, b, 90))))


def test_table_functions(spark):
    tables.register(spark)
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("SELECT t, c.* FROM VALUES ('ab\n\ncd\nefgh'), (null) v(t), LATERAL chunk_text(t, 5) c") == [("ab\n\ncd\nefgh", 0, "ab\ncd", 5), ("ab\n\ncd\nefgh", 1, "efgh", 4)]
    assert sql("SELECT * FROM chunk_text('xyz', columns => 'chars')") == [(3,)]
    assert sql("SELECT * FROM extract_citations('voir Legiarti000000000012, 12-34.567 et ecli:fr:x:1', 'ecli,article_id', true)") == [("ecli", "ECLI:FR:X:1", 0, "ecli:fr:x:1"), ("article_id", "LEGIARTI000000000012", 0, "Legiarti000000000012")]
    for bad in ("chunk_text('x', 0)", "chunk_text('x', 5, 'nothing')", "extract_citations('x', 'nothing')"):
        with pytest.raises(Exception, match="must be 1 or more|is none of"):
            sql(f"SELECT * FROM {bad}")



def test_authority_rerank_equals_a_plain_loop(spark):
    r = random.Random(2)
    rows = [(q, i, r.choice("ab"), r.randrange(4), round(r.random(), 3)) for q in range(12) for i in range(15)]
    got = {}
    for x in retrieval.authority_rerank(spark.createDataFrame(rows, "query_id long, id long, order_key string, tier long, score double"), 0.4, 0.2).collect():
        got.setdefault(x.query_id, {})[x.position] = x.id
    for q in range(12):
        left, want = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[4], x[1])), []
        while left:
            band = [x for x in left if x[4] >= left[0][4] * 0.8]
            queues = {o: sorted((x for x in band if x[2] == o), key=lambda x: -x[4] * (1 + 0.4 * x[3] / 3)) for o in "ab"}
            want += [queues[x[2]].pop(0)[1] for x in band]
            left = left[len(band) :]
        assert [got[q][k + 1] for k in range(15)] == want


def test_search_moves_rows_by_authority(spark):
    sf = "/root/testdata/sf0.001"
    d = adapters.docs(spark, sf).withColumn("source", F.when(F.col("document_id") % 7 == 0, "cass").otherwise("inca"))
    ask = lambda w: search.search(search.Request("the mit license", "2008-06-01", mode="bm25", group_by="document", top_k=10, authority=w), d, adapters.indexed(spark, sf), None).rows
    plain, moved = ask(0.0), ask(2.0)
    assert len(plain) == len(moved) == 10 and plain != [{k: v for k, v in r.items() if k != "tier"} for r in moved]
    lead = lambda rows: sum(r["document_id"] % 7 == 0 for r in rows[:3])
    assert lead(moved) >= lead(plain) and {r["tier"] for r in moved} <= {1, 2}


def test_an_authority_lift_is_the_share_of_pairs(spark):
    pairs = spark.createDataFrame([(1, 1, 2), (1, 3, 2)], "query_id long, high_id long, low_id long")
    order = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids)], "query_id long, id long, position long")
    assert tuple(evaluation.authority_lift(pairs, order([2, 1, 3]), order([1, 2, 3])).first()) == (0.0, 0.5)


FEED = delta.Feed("core", 6, 2, delta.Baseline("base-1", "baseline", 0, 100, 100, 100), tuple(delta.Entry(f"p{n}", n - 1, n, 10, 10, 5) for n in range(3, 7)))
REBASED = delta.Feed("core", 6, 2, delta.Baseline("base-4", "rebaseline", 4, 100, 100, 100), FEED.packages)


def test_catchup_plans():
    """The plan of each kind of position against a feed."""
    from dataclasses import replace

    at, all_ = delta.Cursor, FEED.packages
    newer = tuple(replace(e, minimum_client=(9, 0, 0)) for e in all_)
    ahead = tuple(replace(e, stamps=delta.Stamps(delta.SCHEMA_VERSION + 1)) for e in all_)
    cases = [
        ("head", FEED, at(6)), ("chain", FEED, at(3)), ("fresh", FEED, None), ("ahead", FEED, at(7)), ("too old", FEED, at(1)), ("too old, rebased", REBASED, at(1)), ("gap", replace(FEED, packages=all_[:2] + all_[3:]), at(3)),
        ("other fingerprint", REBASED, at(3, delta.Stamps(fingerprint="x"))), ("too large", replace(REBASED, policy=delta.Policy(size_permille=200)), at(3)), ("routed", replace(REBASED, baseline_ranges=((0, 3), (5, None))), at(3)), ("new client needed", replace(FEED, packages=newer), at(3)),
        ("schema ahead", replace(FEED, packages=ahead), at(3)), ("rebased behind", replace(REBASED, baseline_ranges=((5, 5),)), at(5)), ("malformed", replace(FEED, baseline=delta.Baseline("x", "baseline", 9)), at(3)),
    ]
    want = {'head': ('up_to_date', (), None), 'chain': ('incremental', ('p4', 'p5', 'p6'), None), 'fresh': ('fresh_baseline', ('base-1',), None), 'ahead': ('blocked', (), 'wrong_generation'), 'too old': ('blocked', (), 'baseline_required'), 'too old, rebased': ('fresh_baseline', ('base-4',), None), 'gap': ('blocked', (), 'baseline_required'), 'other fingerprint': ('fresh_baseline', ('base-4',), None), 'too large': ('fresh_baseline', ('base-4',), None), 'routed': ('fresh_baseline', ('base-4',), None), 'new client needed': ('blocked', (), 'client_too_old'), 'schema ahead': ('blocked', (), 'schema_ahead'), 'rebased behind': ('blocked', (), 'baseline_required'), 'malformed': ('blocked', (), 'wrong_generation')}
    got = {name: delta.plan_catchup(feed, cursor) for name, feed, cursor in cases}
    assert {name: (p.kind, p.packages, p.code and p.code.value) for name, p in got.items()} == want
