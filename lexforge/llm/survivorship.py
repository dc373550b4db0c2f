"""Operator 12: golden record survivorship. Of the records of a cluster, each field takes the value of
one: the survivor of a lexicographic elimination.

Every field has a list of criteria (`RECENT`, `TRUSTED` and what stands before them). Candidates of all
fields stand in one long table with their criteria as numbers, the larger the better. A round takes the
next criterion: one aggregation finds the best of each cluster and field, a join with the one best row
lets only those that have it survive. Fields with a single candidate leave the rounds, and the rounds
end when no field has more. The segments' rounds come first, since their survivors drive the balance's
first criterion. Each round is written to the shared folder, so no plan is computed twice.

Scale: aggregations are partial before they shuffle. The joins are sort-merge joins between two
shuffled sides with one row a key on the right, so adaptive execution splits the partitions of a hot
cluster; nothing is collected, broadcast or put into one task.

Rows: strings that are empty or blank count as null, also sources; an unknown source is the least trusted.
An infinite or undefined balance counts as null. A null client_id comes after every other and supplies
no id. A row with neither master_id nor client_id belongs to the cluster of the null id. Rows that
all criteria leave equal (one client_id repeated) give the greatest value. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sources by falling trust, and after how many hours before its cluster's latest a record is stale.
TRUST, STALE_HOURS = ["partner", "store", "web", "crm"], 30 * 24
#: Criteria by field, first to last; each is the larger, the better.
RECENT = ["updated", "trust", "order"]
TRUSTED = ["fresh", "trust", "updated", "order"]
FIELDS = {"segment": RECENT, "email": TRUSTED, "name": ["length", *TRUSTED], "address": ["filled", *TRUSTED], "balance": ["matched", "updated", "trust", "order"]}
_LEAST = -(1 << 63)


def micros(t: Column) -> Column:
    """A time's microseconds since 1970 by its own clock, whatever the session's zone."""
    minutes = (F.unix_date(t.cast("date")).cast("bigint") * 24 + F.hour(t)) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def told(c: str) -> Column:
    """A string, null where it is blank."""
    return F.when(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.col(c))


def records(clients: DataFrame) -> DataFrame:
    """The rows narrowed and typed: cluster_id, client_id, values and what the criteria need."""
    client, at = F.col("client_id").cast("bigint"), micros(F.col("updated_at"))
    trust = reduce(lambda rest, i: F.when(F.col("source") == TRUST[i], len(TRUST) - i).otherwise(rest), range(len(TRUST)), F.lit(0))
    balance = F.col("balance").cast("double")
    return clients.select(
        F.coalesce(F.col("master_id").cast("bigint"), client).alias("cluster_id"),
        client.alias("client_id"),
        told("name").alias("name"),
        told("email").alias("email"),
        told("segment").alias("segment"),
        told("city").alias("city"),
        F.col("nation_id").cast("int").alias("nation_id"),
        F.when(F.abs(balance) < float("inf"), balance).alias("balance"),
        at.alias("at"),
        trust.cast("bigint").alias("trust"),
    )


def same_cluster(a: DataFrame, b: DataFrame) -> Column:
    return a["cluster_id"].eqNullSafe(b["cluster_id"])


def with_criteria(rows: DataFrame) -> DataFrame:
    """Adds updated, fresh, order, length and filled; latest is the cluster's, read from a written table."""
    latest = written(rows.groupBy("cluster_id").agg(F.max("at").alias("latest"))).hint("merge")
    fresh = F.coalesce(F.col("latest") - F.col("at") <= STALE_HOURS * 3_600_000_000, F.lit(False))
    return rows.join(latest, same_cluster(rows, latest), "left").select(
        rows["*"],
        F.coalesce("at", F.lit(_LEAST)).alias("updated"),
        fresh.cast("bigint").alias("fresh"),
        F.coalesce(F.bitwise_not("client_id"), F.lit(_LEAST)).alias("order"),
        F.length("name").cast("bigint").alias("length"),
        (F.col("city").isNotNull().cast("bigint") + F.col("nation_id").isNotNull().cast("bigint")).alias("filled"),
    )


VALUE = ["cluster_id", "client_id", "text", "nation", "amount"]


def candidates(rows: DataFrame, fields: dict[str, tuple[Column, dict[str, Column]]]) -> DataFrame:
    """The long table: a row per record and field whose value it has, its criteria as an array."""
    deep = max(len(FIELDS[f]) for f in fields)

    def one(field: str, there: Column, value: dict[str, Column]) -> Column:
        ranks = [F.col(c) for c in FIELDS[field]] + [F.lit(0).cast("bigint")] * (deep - len(FIELDS[field]))
        each = {"text": F.lit(None).cast("string"), "nation": F.lit(None).cast("int"), "amount": F.lit(None).cast("double")} | value
        return F.when(there, F.struct(F.lit(field).alias("field"), F.array(*ranks).alias("ranks"), *(c.alias(k) for k, c in each.items())))

    listed = F.filter(F.array(*(one(f, *x) for f, x in fields.items())), lambda c: c.isNotNull())
    return rows.select("cluster_id", "client_id", F.explode(listed).alias("c")).select("cluster_id", "client_id", "c.*")


def survivors(found: DataFrame, deep: int) -> DataFrame:
    """Eliminates by criterion after criterion until each cluster and field has one candidate, or equal ones."""
    left, done = written(found.withColumn("n", F.lit(2).cast("bigint"))), []
    for k in range(deep):
        left = left.filter("n > 1").select(*VALUE, "field", "ranks", F.col("ranks")[k].alias("rank"))
        best = left.groupBy("cluster_id", "field").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("_rank")).withColumnsRenamed({"cluster_id": "_cluster", "field": "_field"}).hint("merge")
        left = written(left.join(best, F.col("cluster_id").eqNullSafe(F.col("_cluster")) & F.expr("field = _field and rank = _rank")).select(*VALUE, "field", "ranks", "n"))
        done.append(left.filter("n = 1"))
        if left.filter("n > 1").isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, left.filter("n > 1")]).drop("ranks", "n")


def golden_records(clients: DataFrame) -> DataFrame:
    """cluster_id, n_records, n_stale, the fields' values and the client_id that each comes from."""
    rows = written(with_criteria(records(clients)))
    has = lambda c: F.col(c).isNotNull()
    segment = survivors(candidates(rows, {"segment": (has("segment"), {"text": F.col("segment")})}), len(FIELDS["segment"]))
    chosen = written(segment.groupBy("cluster_id").agg(F.max("text").alias("chosen"))).hint("merge")
    driven = rows.join(chosen, same_cluster(rows, chosen), "left").select(rows["*"], F.col("segment").eqNullSafe(F.col("chosen")).cast("bigint").alias("matched"))
    fields = {
        "email": (has("email"), {"text": F.col("email")}),
        "name": (has("name"), {"text": F.col("name")}),
        "address": (F.lit(True), {"text": F.col("city"), "nation": F.col("nation_id")}),
        "balance": (has("balance"), {"amount": F.col("balance")}),
    }
    others = survivors(candidates(driven, fields), max(len(FIELDS[f]) for f in fields))
    counted = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum(1 - F.col("fresh")).alias("n_stale"))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    value = F.struct("text", "nation", "amount", "client_id")
    long = counted.select("cluster_id", empty("field", "string"), "n_records", "n_stale", F.lit(None).cast("struct<text:string,nation:int,amount:double,client_id:bigint>").alias("value"))
    both = segment.unionByName(others).select("cluster_id", "field", empty("n_records", "bigint"), empty("n_stale", "bigint"), value.alias("value"))
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = long.unionByName(both).groupBy("cluster_id").agg(F.max("n_records").alias("n_records"), F.max("n_stale").alias("n_stale"), *(of(f).alias(f) for f in FIELDS))
    return wide.select(
        "cluster_id",
        "n_records",
        "n_stale",
        *(F.col(f"{f}.text").alias(f) for f in ("name", "email", "segment")),
        F.col("address.text").alias("city"),
        F.col("address.nation").alias("nation_id"),
        F.floor(100 * F.col("balance.amount") + 0.5).cast("bigint").alias("balance_cents"),
        *(F.col(f"{f}.client_id").alias(f"{f}_from") for f in ("name", "email", "segment", "balance")),
        F.when(F.col("address.text").isNotNull() | F.col("address.nation").isNotNull(), F.col("address.client_id")).alias("address_from"),
    )
