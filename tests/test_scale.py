"""What grows with the input no faster than it: rows of joins, buckets, segments, batches, passes."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from lexforge import storage
from lexforge.llm import pii
from lexforge.operators import citations, derive, index, search, segments
from lexforge.plans import cite, retrieval
from lexforge.plans.registry import QUERIES
from lexforge.sources import xml

SF = "/root/testdata/sf0.001"


def join_rows(plan):
    """Rows that the joins of an executed plan gave."""
    kind, seq = plan.getClass().getSimpleName(), plan.children()
    if kind == "AdaptiveSparkPlanExec":
        return join_rows(plan.executedPlan())
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [seq.apply(i) for i in range(seq.size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in kind else []
    return own + [n for p in below for n in join_rows(p)]


def test_hot_citations_are_not_multiplied_out(spark):
    """Many citations of an article that many documents are: the join has 20 rows a question, the result 20 a citation."""
    n = 600
    legal = cite.legal(spark, SF).limit(1).select("*")
    k = F.col("id")
    d = spark.range(n).select(F.concat(F.lit("legi:x"), k.cast("string")).alias("document_id"), F.lit("legi").alias("source"), F.lit("article").alias("kind"), F.concat(F.lit("LEGIARTI"), F.lpad(k.cast("string"), 12, "0")).alias("source_uid"), F.lit("Code civil").alias("citation"), F.lit("Article 7").alias("title"), F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("string").alias("ecli"), F.lit(None).cast("array<string>").alias("case_numbers"))
    assert set(d.columns) == set(legal.columns)
    c = spark.range(n).select(k.alias("cite_id"), F.when(k % 2 == 0, "article 7 du Code civil").otherwise("article 7").alias("cite"))
    out = citations.cite_lookup(c, d, cite.roots(spark, SF).limit(0))
    rows = out.collect()
    assert max(join_rows(out._jdf.queryExecution().executedPlan())) <= 20 * n
    assert len(rows) == 20 * n
    best = {(r.rank, r.document_id) for r in rows}
    assert best == {(i + 1, f"legi:x{n - 1 - i}") for i in range(20)}


def test_an_id_of_another_version_finds_both_ways(spark):
    """The named version is exact and first, others of its publisher id follow, also beyond the limit."""
    k = F.col("id")
    d = spark.range(50).select(F.concat(F.lit("legi:LEGIARTI000000000001@"), k.cast("string")).alias("document_id"), F.lit("legi").alias("source"), F.lit("article").alias("kind"), F.lit("LEGIARTI000000000001").alias("source_uid"), F.lit("Code civil").alias("citation"), F.lit("Article 7").alias("title"), F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("string").alias("ecli"), F.lit(None).cast("array<string>").alias("case_numbers"))
    c = spark.createDataFrame([(1, "legi:LEGIARTI000000000001@3")], "cite_id long, cite string")
    got = citations.cite_lookup(c, d, cite.roots(spark, SF).limit(0)).orderBy("rank").collect()
    assert [(r.rank, r.exact, r.document_id.split("@")[1]) for r in got] == [(1, True, "3"), *((i + 2, False, str(49 - i)) for i in range(19))]


def test_a_table_of_long_texts_has_several_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_BYTES", 50_000, raising=False)
    rows = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), 5000).alias("body"))
    s = segments.Store(spark, f"file://{tmp_path}/store")
    s.create({"t": segments.Table(rows, ["id"])})
    assert s.manifest()["tables"]["t"]["buckets"] >= 10
    s.apply({"t": segments.Delta(spark.createDataFrame([(5, "new")], "id long, body string"))})
    assert s.read("t").count() == 100 and s.read("t").filter("id = 5").first().body == "new"


def test_segments_of_the_index_hold_whole_chunks(spark, tmp_path):
    d = spark.range(40).select(F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("document_id"), F.lit("k").alias("kind"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.concat(F.lit("the law of "), F.col("id").cast("string")).alias("body"))
    index.build(d.repartition(4), str(tmp_path))
    p = spark.read.parquet(f"{tmp_path}/postings").withColumn("file", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1))
    assert p.groupBy("chunk_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0
    assert index.open_index(spark, str(tmp_path)).scores(["law"]).count() == 40


def test_many_candidates_get_whole_scores_from_postings(spark, monkeypatch):
    monkeypatch.setattr(index, "SMALL", 0)
    monkeypatch.setattr(index, "CANDIDATES", 0)
    i = retrieval.indexed(spark, SF)
    best = i.best(retrieval.TERMS, 15)
    assert "forward" not in best._jdf.queryExecution().optimizedPlan().toString()
    want = i.scores(retrieval.TERMS).orderBy(F.desc("score"), "chunk_id").limit(15)
    assert [(r.chunk_id, r.score) for r in best.collect()] == [(r.chunk_id, r.score) for r in want.collect()]
    assert best.columns == want.columns


def test_a_citation_is_resolved_without_the_index(spark):
    def opened():
        raise AssertionError("the index isn't needed")

    out = search.search(search.Request("code civil article 34", "2008-06-01", embedding=[0.0] * 64, fingerprint="fp"), retrieval.docs(spark, SF), opened, retrieval.vectors(spark, SF), "fp")
    assert out.routing["route"] == "structured" and out.rows


@pytest.mark.parametrize("name", ["tune_sweep", "compare", "mode_overlap"])
def test_rankings_are_read_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" not in plan and "embedding" not in plan  # neither postings nor vectors again


def test_texts_go_to_python_in_small_batches(spark):
    keys = {f"spark.sql.execution.arrow.{k}": v for k, v in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", str(64 << 20)))}
    d = retrieval.docs(spark, SF)
    for use in (lambda: xml.parse_members(spark.createDataFrame([("m", bytearray(b"<x/>"))], "member string, xml binary"), "legi"), lambda: d.select(derive.decision_chunks(F.col("body"), F.col("title"))), lambda: d.select(derive.article_chunks(F.col("body"), F.col("title")))):
        for k, v in keys.items():
            spark.conf.set(k, v)
        use()
        assert all(int(spark.conf.get(k)) < int(v) for k, v in keys.items())
    assert storage.small_batches


def test_personal_data_is_learned_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 10, raising=False)
    seen, examples = [], pii.examples
    monkeypatch.setattr(pii, "examples", lambda docs: seen.append(docs.count()) or examples(docs.limit(5)))
    pii.fit(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("call +1 202-555-0143 now").alias("text")))
    assert seen == [200]
