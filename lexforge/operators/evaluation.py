"""Retrieval quality: precision, recall, MRR, nDCG, bootstrap intervals, sweeps, pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, mrr, ndcg at k. ranking: query_id, document_id, rank; qrels:
    query_id, document_id, label. P@k divides by k; recall is null without relevant documents;
    gains are 2^label - 1, the ideal order is over the labels."""
    top = ranking.filter(F.col("rank") <= k).join(qrels.withColumnRenamed("label", "l"), ["query_id", "document_id"], "left").withColumn("l", F.coalesce("l", F.lit(0)))
    gain = lambda l, r: (F.pow(F.lit(2.0), l) - 1) / F.log2(r + 1.0)  # noqa: E731,E741
    got = top.groupBy("query_id").agg(F.sum((F.col("l") > 0).cast("double")).alias("hits"), F.min(F.when(F.col("l") > 0, F.col("rank"))).alias("first"), F.sum(gain(F.col("l"), F.col("rank"))).alias("dcg"))
    ideal = qrels.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("label"), "document_id")))
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("label"), F.col("r"))).otherwise(0.0)).alias("idcg"), F.sum((F.col("label") > 0).cast("double")).alias("relevant"))
    j = ranking.select("query_id").distinct().join(got, "query_id", "left").join(best, "query_id", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.coalesce(F.col(a), F.lit(0.0)) / F.col(b), 6))
    return j.select("query_id", F.round(F.coalesce("hits", F.lit(0.0)) / k, 6).alias("precision"), share("hits", "relevant").alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.coalesce(share("dcg", "idcg"), F.lit(0.0)).alias("ndcg"))


def score_known_item(answers: DataFrame) -> DataFrame:
    """backend, scored, hits, metric by backend and over all of answers (backend, document_id, label: of
    the gold document, null if it isn't judged); those without a gold document aren't scored."""
    hit = F.coalesce(F.col("label") > 0, F.lit(False))
    g = answers.filter("document_id is not null").rollup("backend").agg(F.count("*").alias("scored"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("metric"))
    return g.withColumn("backend", F.coalesce("backend", F.lit("all")))


def tune_sweep(runs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """weight, score (precision at k), best of runs (weight, document_id, score); the last of equal ones
    is best. Runs are fused pages, so a weight's rows are few."""
    top = runs.withColumn("rank", F.row_number().over(W.partitionBy("weight").orderBy(F.desc("score"), "document_id"))).filter(F.col("rank") <= k)
    hit = top.join(relevant.select("document_id", F.lit(1.0).alias("hit")), "document_id", "left")
    s = hit.groupBy("weight").agg(F.round(F.sum(F.coalesce("hit", F.lit(0.0))) / k, 6).alias("score"))
    return s.join(s.agg(F.max_by("weight", F.struct("score", "weight")).alias("top"))).select("weight", "score", (F.col("weight") == F.col("top")).alias("best"))


#: What would identify a decision in its own text.
IDENTIFIERS = r"ECLI:[A-Z]{2}:[A-Za-z0-9.:_-]+|JURITEXT[0-9]+|CETATEXT[0-9]+|[0-9]{2}-[0-9]{1,3}\.[0-9]{3}|[0-9]{2}-[0-9]{4,6}"


def gold_zone(units: DataFrame, limit: int) -> DataFrame:
    """zone, document_id, source, query: per zone the first `limit` decisions, each with its first
    fragment of 120 characters or more, cleaned of identifiers and cut at 500; it must keep 60."""
    first = units.filter(F.length("body") >= 120).groupBy("zone", "document_id").agg(F.min_by(F.struct("source", "body"), "fragment_index").alias("u"))
    query = F.substring(F.trim(F.regexp_replace(F.regexp_replace("u.body", IDENTIFIERS, " "), r"\s+", " ")), 1, 500)
    q = first.select("zone", "document_id", "u.source", query.alias("query")).filter(F.length(F.trim("query")) >= 60)
    return q.withColumn("k", F.row_number().over(W.partitionBy("zone").orderBy("document_id"))).filter(F.col("k") <= limit).drop("k")


MASK = (1 << 64) - 1


def fnv1a(text: str) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & MASK
    return h


def xorshift64(seed: int):
    """Marsaglia's xorshift64 with shifts 13, 7, 17; the seed is made odd."""
    x = seed | 1
    while True:
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        yield x


#: Fixed value: what the bootstrap's seed is made of, with the number of questions.
BOOTSTRAP_SEED = 0x6A75726973656172


def plain_sum(values) -> float:
    """One addition after another: what draws on other machines give, to the bit."""
    out = 0.0
    for v in values:
        out += v
    return out


def bootstrap_ci(a: list[float | None], b: list[float | None], rounds: int = 1000) -> tuple[float, float, float]:
    """The difference of the means of two systems over the same questions, and its 2.5 and 97.5
    percentiles, by index, when questions are drawn with replacement. A question without a value
    doesn't count in a mean; a draw without any is left out. In one process; `bootstrap_rounds` is the
    same as a Spark job."""
    n, nan = len(a), math.nan

    def delta(draw) -> float:
        means = []
        for values in (a, b):
            have = [v for i in draw if (v := values[i]) is not None]
            means.append(plain_sum(have) / len(have) if have else nan)
        return means[0] - means[1]

    rng = xorshift64(BOOTSTRAP_SEED ^ n)
    draws = (delta([next(rng) % n for _ in range(n)]) for _ in range(rounds)) if n else ()
    found = sorted(d for d in draws if not math.isnan(d))
    if not found:
        return delta(range(n)), nan, nan
    at = lambda share: found[min(len(found) - 1, int(share * len(found)))]
    return delta(range(n)), at(0.025), at(0.975)


def step_matrix() -> list[int]:
    """xorshift64's step as a matrix over bits: the image of each single bit."""
    out = []
    for k in range(64):
        x = 1 << k
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        out.append(x)
    return out


def apply_bits(matrix: list[int], x: int) -> int:
    out = 0
    for k in range(64):
        if x >> k & 1:
            out ^= matrix[k]
    return out


def jumped(x: int, steps: int) -> int:
    """The generator's state after so many steps, by the powers of its matrix: 64 squarings at most."""
    matrix = step_matrix()
    while steps:
        if steps & 1:
            x = apply_bits(matrix, x)
        steps >>= 1
        if steps:
            matrix = [apply_bits(matrix, row) for row in matrix]
    return x


#: Rounds that a task draws side by side.
ROUNDS_A_TASK = 16


def bootstrap_rounds(items: DataFrame, rounds: int = 1000) -> DataFrame:
    """(point, low, high) as bootstrap_ci gives them, to the bit. items: key (unique, gives the order), a, b.
    The rounds are independent tasks: each jumps to its place in the one stream of draws. No question is left
    out at any number; the values, 16 bytes a question, are sent to each machine once."""
    spark = items.sparkSession
    table = items.select("key", F.col("a").cast("double"), F.col("b").cast("double")).toArrow().sort_by("key")
    n = table.num_rows
    if not n:
        return spark.createDataFrame([(math.nan,) * 3], "point double, low double, high double")
    shared = spark.sparkContext.broadcast([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "ab"])
    seed = BOOTSTRAP_SEED ^ n | 1

    def draw(batches):
        for batch in batches:
            first = batch.column(0).to_pylist()
            state = np.array([jumped(seed, r * n) for r in first], np.uint64)
            sums = np.zeros((2, len(first)))
            have = np.zeros((2, len(first)))
            for _ in range(n):
                state ^= state << np.uint64(13)
                state ^= state >> np.uint64(7)
                state ^= state << np.uint64(17)
                at = (state % np.uint64(n)).astype(np.int64)
                for k, values in enumerate(shared.value):
                    x = values[at]
                    there = ~np.isnan(x)
                    sums[k] = np.where(there, sums[k] + x, sums[k])
                    have[k] += there
            with np.errstate(invalid="ignore"):
                means = sums / np.where(have > 0, have, np.nan)
            yield pa.record_batch([batch.column(0), pa.array(means[0] - means[1])], ["round", "delta"])

    drawn = spark.range(0, rounds, 1, max(1, -(-rounds // ROUNDS_A_TASK))).toDF("round").mapInArrow(draw, "round long, delta double").filter(~F.isnan("delta"))
    found = drawn.agg(F.sort_array(F.collect_list("delta")).alias("d"), F.count(F.lit(1)).alias("m"))  # a number a round
    at = lambda share: F.get("d", F.least(F.col("m") - 1, F.floor(F.lit(share) * F.col("m"))).cast("int"))
    mean = lambda values: plain_sum(v for v in values.tolist() if v == v) / m if (m := int((values == values).sum())) else math.nan
    point = mean(shared.value[0]) - mean(shared.value[1])
    nan = F.lit(math.nan)
    return found.select(F.lit(point).alias("point"), F.coalesce(at(0.025), nan).alias("low"), F.coalesce(at(0.975), nan).alias("high"))


def blind_pool(ids: list, question: str) -> list:
    """Fisher-Yates with a seed of the question."""
    out, rng = list(ids), xorshift64(fnv1a(question))
    for i in range(len(out) - 1, 0, -1):
        j = next(rng) % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def sign_test(a: list[float], b: list[float]) -> tuple[int, int, float]:
    """Wins, losses and the two-sided exact binomial probability; ties are left out."""
    wins, losses = sum(x > y for x, y in zip(a, b, strict=True)), sum(x < y for x, y in zip(a, b, strict=True))
    n, k = wins + losses, min(wins, losses)
    return wins, losses, min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def sign_probability(wins: Column, losses: Column) -> Column:
    """The two-sided exact binomial probability of so many wins and losses, as a column: its terms follow from
    one another, in logarithms, so that no number of questions is too many."""
    n, k = wins + losses, F.least(wins, losses)
    first = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    term = lambda a, i: a["t"] + F.log((n - i + 1) / i)
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), first, lambda a, i: F.struct(term(a, i).alias("t"), (a["s"] + F.exp(term(a, i))).alias("s")), lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def authority_pairs(candidates: DataFrame, band: float = 0.05) -> DataFrame:
    """Pairs of one query and order, of different tier, without a missing marker, within the band:
    query_id, high_id, low_id. Candidates are a page a query, so the self-join is small."""
    c = candidates.filter(~F.col("marker_absent")).select("query_id", "order_key", "id", "tier", "score")
    a, b = (c.select("query_id", "order_key", *(F.col(x).alias(f"{x}_{s}") for x in ("id", "tier", "score"))) for s in "ab")
    j = a.join(b, ["query_id", "order_key"]).filter((F.col("tier_a") > F.col("tier_b")) & (F.least("score_a", "score_b") >= F.greatest("score_a", "score_b") * (1 - band)))
    return j.select("query_id", F.col("id_a").alias("high_id"), F.col("id_b").alias("low_id"))


def authority_lift(pairs: DataFrame, off: DataFrame, on: DataFrame) -> DataFrame:
    """Share of pairs whose higher authority leads, without and with re-ranking (query_id, id, position)."""

    def leads(order: DataFrame, name: str) -> DataFrame:
        h, low = (order.select("query_id", F.col("id").alias(f"{x}_id"), F.col("position").alias(f"p_{x}")) for x in ("high", "low"))
        return pairs.join(h, ["query_id", "high_id"]).join(low, ["query_id", "low_id"]).agg(F.avg((F.col("p_high") < F.col("p_low")).cast("double")).alias(name))

    return leads(off, "share_off").join(leads(on, "share_on"))


def gates(values: dict[str, float], floors: dict[str, float]) -> dict[str, str]:
    """passed or failed per floor; a missing or non-finite value fails."""
    return {k: "passed" if np.isfinite(values.get(k, np.nan)) and values[k] >= f else "failed" for k, f in floors.items()}


def release_gate(health: dict, floors: dict[str, float]) -> list[tuple[str, str, bool]]:
    """(check, status, whether it gates) of a release: pass, pending or fail. health: query_ready,
    available, completed_run, failed_members, projection and embedding (covered, total), snapshot, model,
    and values for the floors."""
    there = bool(health.get("available"))
    covered = lambda c: "pending" if not c or not c[1] else "pass" if c[0] == c[1] else "fail"
    failed = health.get("failed_members")
    checks = [
        ("index_query_ready", "pass" if health.get("query_ready") else "pending", True),
        ("latest_completed_ingest_run", "pass" if there and health.get("completed_run") else "pending", True),
        ("failed_members", "pending" if not there else "pass" if failed == 0 else "fail", True),
        ("projection_coverage", covered(health.get("projection")), True),
        ("embedding_coverage", covered(health.get("embedding")), True),
        ("replay_snapshot", "pass" if there and health.get("snapshot") else "pending", True),
        ("embedding_model", "pass" if health.get("model") else "fail", True),
    ]
    bench = gates(health.get("values", {}), floors)
    return [*checks, *((k, "pass" if v == "passed" else "fail", not k.startswith("advisory")) for k, v in bench.items())]


def claim_allowed(checks: list[tuple[str, str, bool]]) -> bool:
    return all(status == "pass" for _, status, gating in checks if gating)
