"""Segments and Merkle trees against plain dictionaries: any order of upserts, deletes, set
replacements and compactions reads as the full rewrite would, and digests as from scratch."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lexforge import storage
from lexforge.operators import merkle, segments
from lexforge.operators.segments import Delta, Store, Table

ROWS = "id long, part long, x string"


def rows_of(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", range(2))
def test_any_order_of_changes(spark, tmp_path, seed):
    r = random.Random(seed)
    s = Store(spark, f"file://{tmp_path}")
    have = [(i, i % 7, f"v{i}") for i in range(60)]
    s.create({"t": Table(rows_of(spark, have), ["part"])})
    for step in range(4):
        if r.random() < 0.35:
            s.settle(s.prepare("t", r.choice(["base", "deltas"]) if step > 1 and len(s.manifest()["tables"]["t"]["segments"]) > 1 else "base"))
        scopes = r.sample(range(9), 2)
        new = [(100 * step + i, r.choice([scopes[0], 7]), f"s{step}") for i in range(r.randrange(4))]
        touched = set(scopes) | {x[1] for x in new}
        have = [x for x in have if x[1] not in touched] + new
        s.apply({"t": Delta(rows_of(spark, new), rows_of(spark, [(p,) for p in scopes], "part long"))})
        assert sorted(map(tuple, s.read("t").collect())) == sorted(have)
        want = merkle.table_digest(rows_of(spark, have), ["part"], ["id", "part", "x"]).first()
        assert s.digest(s.manifest()["tables"]["t"]) == (want.n, want.digest)


def test_hot_keys_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "HOT_ROWS", 5)
    monkeypatch.setattr(segments, "BUCKET_ROWS", 20)
    have = [(i, 1 if i % 3 else i, f"v{i}") for i in range(90)]
    s = Store(spark, f"file://{tmp_path}")
    s.create({"t": Table(rows_of(spark, have), ["part"])})
    t = s.manifest()["tables"]["t"]
    assert t["hot"] == [["1"]] and t["buckets"] == 5
    per_file = [r["count"] for r in spark.read.parquet(f"{tmp_path}/{t['segments'][0]['path']}").filter("part = 1").groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) > 1
    s.apply({"t": Delta(rows_of(spark, [(7, 1, "only"), (3, 3, "new")]))})
    assert sorted(map(tuple, s.read("t").collect())) == sorted([x for x in have if x[1] not in (1, 3)] + [(7, 1, "only"), (3, 3, "new")])


def test_reading_with_deltas_leaves_the_base_in_place(spark, tmp_path):
    """The base isn't shuffled: of the exchanges, none lies over its scan."""
    monkey = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = Store(spark, f"file://{tmp_path}")
        s.create({"t": Table(rows_of(spark, [(i, i, "v") for i in range(50)]), ["id"])})
        s.apply({"t": Delta(rows_of(spark, [(1, 1, "new")]))})
        plan = s.read("t")._jdf.queryExecution().executedPlan().toString()
        over_base = [line for line in plan.splitlines() if "Bucketed: true" in line]
        assert len(over_base) == 1
        lines = plan.splitlines()
        at = lines.index(over_base[0])
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        above, least = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < least:
                above.append(line)
                least = depth(line)
        assert not any("Exchange" in line for line in above)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", monkey)


def test_an_increment_writes_in_proportion(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    d = spark.range(100_000).select("id", (F.col("id") % 50).alias("part"), F.md5(F.col("id").cast("string")).alias("x"))
    s.create({"t": Table(d, ["id"])})
    base = s.manifest()["tables"]["t"]["segments"][0]
    s.apply({"t": Delta(d.filter("id % 100 = 0").withColumn("x", F.lit("new")))})
    new = s.manifest()["tables"]["t"]["segments"][1]
    assert new["rows"] == base["rows"] // 100 and new["bytes"] < base["bytes"] / 20


def test_compaction_in_the_background(spark, tmp_path):
    """What is applied while a compaction is written stays on top; a second compaction of the same segments loses."""
    s = Store(spark, f"file://{tmp_path}")
    s.create({"t": Table(rows_of(spark, [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]), ["id"])})
    s.apply({"t": Delta(rows_of(spark, [(1, 1, "a2")]))})
    out = {}
    t = threading.Thread(target=lambda: out.update(plan=s.prepare("t", "base")))
    t.start()
    s.apply({"t": Delta(rows_of(spark, [(2, 2, "b2")]), rows_of(spark, [(3,)], "id long"))})
    t.join()
    plan = out["plan"]
    late = len(plan["old"]) == 2
    s.settle(plan)
    assert sorted(map(tuple, s.read("t").collect())) == [(1, 1, "a2"), (2, 2, "b2")]
    assert len(s.manifest()["tables"]["t"]["segments"]) == (2 if late else 1)
    with pytest.raises(segments.Conflict):
        s.settle(plan)


def test_two_writers_and_old_readers(spark, tmp_path):
    s, other = (Store(spark, f"file://{tmp_path}") for _ in range(2))
    s.create({"t": Table(rows_of(spark, [(1, 1, "a")]), ["id"])})
    opened = s.read("t")
    with pytest.raises(segments.Conflict):  # the other publishes while this one writes
        s.apply({"t": Delta(rows_of(spark, [(2, 2, "b")]))}, check=lambda _: other.apply({"t": Delta(rows_of(spark, [(3, 3, "c")]))}))
    assert sorted(map(tuple, s.read("t").collect())) == [(1, 1, "a"), (3, 3, "c")]
    assert [tuple(x) for x in s.read("t", 1).collect()] == [(1, 1, "a")] == [tuple(x) for x in opened.collect()]


def test_vacuum_and_a_new_session_read_on(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create({"t": Table(rows_of(spark, [(1, 1, "a"), (2, 2, "b")]), ["id"])})
    s.apply({"t": Delta(rows_of(spark, [(1, 1, "a2")]))})
    s.settle(s.prepare("t", "base"))
    assert s.vacuum(keep=1) == 4 and len(storage.names(spark, f"file://{tmp_path}/t")) == 2
    for t in spark.catalog.listTables():
        if t.name.startswith("lexforge_"):
            spark.sql(f"DROP TABLE {t.name}")  # as in another session: the catalog knows nothing
    assert sorted(map(tuple, Store(spark, f"file://{tmp_path}").read("t").collect())) == [(1, 1, "a2"), (2, 2, "b")]


def test_empty_tables_null_keys_and_nested_values(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    kind = "a string, b int, v array<float>"
    s.create({"t": Table(rows_of(spark, [], kind), ["a", "b"])})
    s.apply({"t": Delta(rows_of(spark, [("x", 1, [1.0]), ("x", None, None), (None, 2, [])], kind))})
    s.apply({"t": Delta(rows_of(spark, [("x", 1, [2.0])], kind))})
    got = sorted(map(tuple, s.read("t").collect()), key=repr)
    assert got == sorted([("x", 1, [2.0]), ("x", None, None), (None, 2, [])], key=repr)


def test_trees_differ_along_one_branch(spark, tmp_path):
    d = spark.range(5000).select("id", F.lit("v").alias("x"))
    other = d.withColumn("x", F.when(F.col("id") == 1234, "w").otherwise(F.col("x")))
    stored = []
    for k, rows in enumerate((d, other)):
        merkle.tree(merkle.leaves(rows.withColumn("_hash", merkle.row_hash(["id", "x"])), ["id"], 3), 3).write.partitionBy("level").parquet(f"{tmp_path}/{k}")
        stored.append(spark.read.parquet(f"{tmp_path}/{k}"))
    path = merkle.differing(*stored, 3)
    assert [[len(r.node) for r in level.collect()] for level in path] == [[0], [1], [2], [3]]
    leaf = path[-1].first().node
    inside = d.filter(merkle.leaf_of(["id"], 3) == leaf)
    assert inside.filter("id = 1234").count() == 1 and inside.count() < 20
    assert [x.count() for x in merkle.differing(stored[0], stored[0], 3)] == [0]


def test_repeated_rows_count(spark):
    digest = lambda rows: tuple(merkle.table_digest(rows_of(spark, rows), ["id"], ["id", "part", "x"], 2).first())
    a, b = (1, 1, "a"), (1, 1, "b")
    assert len({digest(x) for x in ([], [a], [a, a], [a, b], [b, b], [a, a, b, b])}) == 6
    assert digest([a, b]) == digest([b, a])
