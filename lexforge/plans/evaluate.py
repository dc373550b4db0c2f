"""Queries of evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import DOCS_SQL, docs, read
from ..operators import evaluation as E
from ..operators import retrieval as R
from .cite import LEGAL_SQL, legal
from .registry import query
from .retrieval import DEN, LEX, dense, lexical, page

#: Rankings by a deterministic rule: each benchmark item asks, documents of its residue answer, so a
#: document stands in one ranking.
RANK_SQL = """items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS m, count(*) OVER () AS n FROM benchmark),
ranking AS (SELECT item_id AS query_id, doc_id AS document_id, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id * 7919 + item_id * 104729) % 1009, doc_id) AS rank FROM items JOIN documents ON doc_id % n = m),
qrels AS (SELECT item_id AS query_id, doc_id AS document_id, CAST(quality + toxic AS BIGINT) AS label FROM labels JOIN items ON doc_id % n = m)"""
METRIC_SQL = """t AS (SELECT r.query_id, rank, coalesce(label, 0) AS l FROM ranking r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.document_id = r.document_id WHERE rank <= 10),
got AS (SELECT query_id, sum(CASE WHEN l > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hits, min(CASE WHEN l > 0 THEN rank END) AS first, sum((pow(2.0, l) - 1) / log2(rank + 1.0::DOUBLE)) AS dcg FROM t GROUP BY query_id),
ideal AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, document_id) AS r FROM qrels),
best AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN (pow(2.0, label) - 1) / log2(r + 1.0::DOUBLE) ELSE 0 END) AS idcg, sum(CASE WHEN label > 0 THEN 1.0::DOUBLE ELSE 0 END) AS relevant FROM ideal GROUP BY query_id),
m AS (SELECT query_id, round(coalesce(hits, 0) / 10, 6) AS precision, CASE WHEN relevant > 0 THEN round(coalesce(hits, 0) / relevant, 6) END AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
  coalesce(CASE WHEN idcg > 0 THEN round(coalesce(dcg, 0) / idcg, 6) END, 0) AS ndcg FROM (SELECT DISTINCT query_id FROM ranking) LEFT JOIN got USING (query_id) LEFT JOIN best USING (query_id))"""

def ranking(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ids = [r.item_id for r in read(spark, sf_dir, "benchmark").select("item_id").orderBy("item_id").collect()]  # the questions
    b = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "m long, query_id long"))
    of = lambda name, *cols: read(spark, sf_dir, name).select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % max(len(ids), 1)).alias("m"), *cols).join(b, "m")
    key = (F.col("document_id") * 7919 + F.col("query_id") * 104729) % 1009
    r = of("documents").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(key, "document_id")).cast("bigint")).select("query_id", "document_id", "rank")
    q = of("labels", (F.col("quality") + F.col("toxic")).cast("bigint").alias("label")).select("query_id", "document_id", "label")
    return r, q


def measured(spark, sf_dir):
    return E.metrics(*ranking(spark, sf_dir), 10)


@query("SELECT query_id, precision FROM m", RANK_SQL, METRIC_SQL)
def metric_precision(spark, sf_dir):
    return measured(spark, sf_dir).select("query_id", "precision")


@query("SELECT query_id, recall FROM m", RANK_SQL, METRIC_SQL)
def metric_recall(spark, sf_dir):
    return measured(spark, sf_dir).select("query_id", "recall")


@query("SELECT query_id, mrr FROM m", RANK_SQL, METRIC_SQL)
def metric_mrr(spark, sf_dir):
    return measured(spark, sf_dir).select("query_id", "mrr")


@query("SELECT query_id, ndcg FROM m", RANK_SQL, METRIC_SQL)
def metric_ndcg(spark, sf_dir):
    return measured(spark, sf_dir).select("query_id", "ndcg")


@query("""SELECT coalesce(backend, 'all') AS backend, count(*) AS scored, count(*) FILTER (WHERE label > 0) AS hits, round(avg(CASE WHEN label > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS metric FROM (
  SELECT CASE WHEN r.query_id % 3 = 0 THEN 'structured' ELSE 'hybrid' END AS backend, q.label FROM ranking r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.document_id = r.document_id WHERE r.rank = 1 AND r.query_id % 7 <> 0) GROUP BY GROUPING SETS ((backend), ())""", RANK_SQL)  # fmt: skip
def score_known_item(spark, sf_dir):
    """Hits at the top by the backend that answered; questions without their gold are left out."""
    r, q = ranking(spark, sf_dir)
    gold = r.filter("rank = 1").select("query_id", F.when(F.col("query_id") % 7 != 0, F.col("document_id")).alias("document_id"), F.when(F.col("query_id") % 3 == 0, "structured").otherwise("hybrid").alias("backend"))
    return E.score_known_item(gold.join(q, ["query_id", "document_id"], "left"))


@query("""WITH g AS (SELECT unnest([0.0, 0.1, 0.3, 1.0])::DOUBLE AS weight), f AS (SELECT weight, document_id, round(coalesce(1.0::DOUBLE / (60 + min(l)), 0) + coalesce(weight / (60 + min(d)), 0), 8) AS score FROM (SELECT document_id, rank AS l, NULL AS d FROM lex UNION ALL SELECT document_id, NULL, rank FROM den), g GROUP BY weight, document_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY weight ORDER BY score DESC, document_id) AS rank FROM f), s AS (SELECT weight, round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0 END) / 20, 6) AS score FROM r LEFT JOIN labels ON doc_id = document_id WHERE rank <= 20 GROUP BY weight)
  SELECT weight, score, weight = (SELECT max(weight) FROM s WHERE score = (SELECT max(score) FROM s)) AS best FROM s""", *LEX, *DEN)  # fmt: skip
def tune_sweep(spark, sf_dir):
    """The weight of the dense arm over a grid, the fusion run anew for each; of equal scores the last wins."""
    lex, den = page(lexical(spark, sf_dir)), page(dense(spark, sf_dir))
    runs = [R.rrf_fuse(lex, den, (R.LEXICAL_WEIGHT, w)).select(F.lit(w).alias("weight"), "document_id", "score") for w in (0.0, 0.1, 0.3, 1.0)]
    good = read(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("document_id"))
    return E.tune_sweep(reduce(DataFrame.unionByName, runs), good, 20)


@query("""WITH c AS (SELECT query_id, rank AS id, 'o' || (document_id % 2) AS o, CAST(document_id % 3 AS BIGINT) AS tier, 1.0::DOUBLE / (60 + rank) AS score, document_id % 5 = 0 AS absent FROM ranking WHERE rank <= 20)
  SELECT a.query_id, a.id AS high_id, b.id AS low_id FROM c a JOIN c b ON a.query_id = b.query_id AND a.o = b.o AND a.tier > b.tier AND least(a.score, b.score) >= greatest(a.score, b.score) * (1 - 0.05) WHERE NOT a.absent AND NOT b.absent""", RANK_SQL)  # fmt: skip
def authority_pairs(spark, sf_dir):
    return E.authority_pairs(candidates(spark, sf_dir))


@query()
def bootstrap_ci(spark, sf_dir):
    """nDCG against MRR over the same questions, the rounds as tasks that jump to their draws."""
    return E.bootstrap_rounds(measured(spark, sf_dir).select(F.col("query_id").alias("key"), F.col("ndcg").alias("a"), F.col("mrr").alias("b")))


@query("""SELECT * FROM (VALUES ('settled', true, ''), ('no run', false, 'latest_completed_ingest_run'), ('a failed member', false, 'failed_members'), ('embedding missing', false, 'embedding_coverage'), ('nothing projected', false, 'projection_coverage'), ('below a floor', false, 'recall@10'),
  ('advisory below', true, 'advisory_bsard'), ('nothing there', false, 'index_query_ready,latest_completed_ingest_run,failed_members,projection_coverage,embedding_coverage,replay_snapshot,embedding_model,recall@10,advisory_bsard')) t(scenario, claim_allowed, not_passed)""")  # fmt: skip
def gates(spark, sf_dir):
    good = {"query_ready": True, "available": True, "completed_run": "r1", "failed_members": 0, "projection": (5, 5), "embedding": (5, 5), "snapshot": "x", "model": True, "values": {"recall@10": 0.9, "advisory_bsard": 0.5}}
    cases = [("settled", good), ("no run", good | {"completed_run": None}), ("a failed member", good | {"failed_members": 1}), ("embedding missing", good | {"embedding": (4, 5)}), ("nothing projected", good | {"projection": (0, 0)}), ("below a floor", good | {"values": {"recall@10": 0.5, "advisory_bsard": 0.5}}), ("advisory below", good | {"values": {"recall@10": 0.9, "advisory_bsard": float("nan")}}), ("nothing there", {})]
    rows = [(name, E.release_gate(h, {"recall@10": 0.8, "advisory_bsard": 0.4})) for name, h in cases]
    return spark.createDataFrame([(name, E.claim_allowed(c), ",".join(k for k, status, _ in c if status != "pass")) for name, c in rows], "scenario string, claim_allowed boolean, not_passed string")


@query("""WITH w AS (SELECT count(*) FILTER (ndcg > mrr) AS wins, count(*) FILTER (ndcg < mrr) AS losses FROM m), c AS (SELECT *, wins + losses AS n, least(wins, losses) AS k FROM w)
  SELECT wins, losses, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) - n * ln(2.0::DOUBLE))) FROM (SELECT unnest(range(0, k + 1)) AS i))) END, 6) AS p FROM c""", RANK_SQL, METRIC_SQL)  # fmt: skip
def sign_test(spark, sf_dir):
    """nDCG against MRR over the same questions: how many each wins, and how likely that is by chance."""
    w = measured(spark, sf_dir).agg(F.count_if(F.col("ndcg") > F.col("mrr")).alias("wins"), F.count_if(F.col("ndcg") < F.col("mrr")).alias("losses"))
    return w.select("wins", "losses", F.round(E.sign_probability(F.col("wins"), F.col("losses")), 6).alias("p"))


@query("SELECT * FROM (VALUES ('fnv1a', '', '14695981039346656037'), ('fnv1a', 'a', '12638187200555641996'), ('fnv1a', 'foobar', '9625390261332436968'), ('xorshift64', '1', '1082269761'), ('xorshift64', '1,1', '1152992998833853505')) t(name, given, value)")
def seeds(spark, sf_dir):
    """Published values of the two generators."""
    g = E.xorshift64(1)
    rows = [("fnv1a", t, str(E.fnv1a(t))) for t in ("", "a", "foobar")] + [("xorshift64", "1", str(next(g))), ("xorshift64", "1,1", str(next(g)))]
    return spark.createDataFrame(rows, "name string, given string, value string")


@query("SELECT query_id, document_id FROM ranking WHERE rank <= 8", RANK_SQL)
def blind_pool(spark, sf_dir):
    """Each question's pool in an order that tells nothing of its rank; tests hold the order."""
    r, _ = ranking(spark, sf_dir)
    top = r.filter("rank <= 8").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("ids"))

    def run(pdf):
        import pandas as pd

        q = int(pdf.query_id.iloc[0])
        return pd.DataFrame({"query_id": q, "document_id": E.blind_pool(list(pdf.ids.iloc[0]), str(q))})

    return top.groupBy("query_id").applyInPandas(run, "query_id long, document_id long")


def candidates(spark, sf_dir):
    r, _ = ranking(spark, sf_dir)
    d, k = F.col("document_id"), F.col("rank")
    return r.filter("rank <= 20").select("query_id", k.alias("id"), F.concat(F.lit("o"), (d % 2).cast("string")).alias("order_key"), (d % 3).alias("tier"), (1.0 / (60 + k)).alias("score"), (d % 5 == 0).alias("marker_absent"))


@query()
def authority_lift(spark, sf_dir):
    """Shares of pairs that the higher authority leads, without re-ranking and with it."""
    c = candidates(spark, sf_dir)
    off, on = (R.authority_rerank(c.drop("marker_absent"), w) for w in (0.0, 0.5))
    return E.authority_lift(E.authority_pairs(c), off, on)


ZONE_SQL = """lined AS (SELECT document_id, source, unnest(range(0, len(string_split(body, chr(10))))) AS i, unnest(string_split(body, chr(10))) AS x FROM docs WHERE kind = 'decision'),
units AS (SELECT document_id, source, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS n, 'pourvoi 12-34.567 ' || x AS body FROM lined WHERE trim(x) <> ''),
cleaned AS (SELECT document_id, source, ['motivations', 'moyens', 'dispositif'][CAST(1 + n % 3 AS INTEGER)] AS zone, n, substr(trim(regexp_replace(regexp_replace(body, 'ECLI:[A-Z]{2}:[A-Za-z0-9.:_-]+|JURITEXT[0-9]+|CETATEXT[0-9]+|[0-9]{2}-[0-9]{1,3}\\.[0-9]{3}|[0-9]{2}-[0-9]{4,6}', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 500) AS query FROM units WHERE length(body) >= 120)"""


@query("SELECT zone, document_id, source, md5(query) AS query FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY document_id) AS k FROM (SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY zone, document_id ORDER BY n) = 1) WHERE length(trim(query)) >= 60) WHERE k <= 60", DOCS_SQL, ZONE_SQL)
def gold_zone(spark, sf_dir):
    """Of each zone 60 decisions, each asked by the first fragment, without what would identify it."""
    u = docs(spark, sf_dir).filter("kind = 'decision'").select("document_id", "source", F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("n", "x"))
    zone = F.element_at(F.array(*map(F.lit, ("motivations", "moyens", "dispositif"))), (F.col("n") % 3 + 1).cast("int"))
    return E.gold_zone(u.select("document_id", "source", zone.alias("zone"), F.col("n").alias("fragment_index"), F.concat(F.lit("pourvoi 12-34.567 "), "x").alias("body")), 60).withColumn("query", F.md5("query"))


@query("SELECT document_id, uid AS query FROM legal WHERE kind = 'decision' AND source = 'jade' AND regexp_matches(uid, '^CETATEXT[0-9]{12}$') ORDER BY document_id LIMIT 60", LEGAL_SQL)
def gold_cetatext(spark, sf_dir):
    d = legal(spark, sf_dir).filter("kind = 'decision' AND source = 'jade'").filter(F.col("source_uid").rlike("^CETATEXT[0-9]{12}$"))
    return d.select("document_id", F.col("source_uid").alias("query")).orderBy("document_id").limit(60)
