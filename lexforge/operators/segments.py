"""Tables as segments: a base and deltas with tombstones, merged when they are read.

An increment writes its own rows and the keys it takes away, as one delta a table; the newest delta that
names a key says what the key's rows are. A key may have one row (an upsert by id) or a set of rows (a
scope that is replaced). The base is bucketed and sorted by key, so that reading it with deltas shuffles the deltas
only; keys that hold a large share of the rows are listed in the manifest and dealt over several buckets.

A version of the store is one manifest: the segments of every table, the leaves of its Merkle tree and
the caller's state. It is published by a rename that fails if another writer came first, so readers see
whole versions, keep the one they opened, and two writers can't both win. Deltas are merged
with each other, or into a new base once they are large, aside and at any time: what was applied meanwhile
stays on top. Files of versions that nobody needs go by `vacuum`.

Rows with a null key can't be replaced; they stay until the next base.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import storage
from . import merkle

#: Deltas of a table that are merged, and the share of the base's rows from which they become a new base.
FANOUT, REBASE = 4, 0.25
#: Rows and bytes a bucket has at about; a key is hot from HOT_ROWS rows and a HOT_SHARE-th of them on, and is dealt over SALTS.
BUCKET_ROWS, BUCKET_BYTES, HOT_ROWS, HOT_SHARE, SALTS = 1_000_000, 64 << 20, 10_000, 200, 32


class Conflict(RuntimeError):
    """Another writer published first; nothing of this one is visible."""


@dataclass
class Table:
    """A whole table to start from, and the columns of its key."""

    rows: DataFrame
    key: list[str]


@dataclass
class Delta:
    """New rows, and keys that go or whose rows are replaced (with columns of the key)."""

    rows: DataFrame
    gone: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    # --- versions

    def version(self) -> int:
        """The newest one's number; 0 if there is none."""
        return max((int(n) for n in storage.names(self.spark, f"{self.root}/versions")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return json.loads(storage.read_text(self.spark, f"{self.root}/versions/{v}")) if v else {"version": 0, "state": None, "tables": {}}

    def publish(self, tables: dict, state, after: int) -> int:
        text = json.dumps({"version": after + 1, "state": state, "tables": tables}, sort_keys=True)
        if not storage.publish_text(self.spark, f"{self.root}/versions/{after + 1}", text):
            raise Conflict(f"version {after + 1} exists")
        return after + 1

    # --- writing

    def _read(self, folder: str, schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    @staticmethod
    def _schema(t: dict, *more: tuple[str, str]) -> StructType:
        out = StructType.fromJson(json.loads(t["schema"]))
        for name, kind in more:
            out = out.add(name, kind)
        return out

    def _written(self, df: DataFrame, folder: str) -> dict:
        df.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        return self._measured(folder, df.schema)

    def _measured(self, folder: str, schema: StructType) -> dict:
        return {"path": folder, "rows": self._read(folder, schema).count(), "bytes": storage.size(self.spark, f"{self.root}/{folder}")}

    @staticmethod
    def is_hot(key: list[str], hot: list[list]) -> Column:
        return F.array(*(F.col(c).cast("string") for c in key)).isin([F.array(*map(F.lit, h)) for h in hot])

    def salt(self, key: list[str], hot: list[list], columns: list[str]) -> Column:
        """0, or of a hot key one of SALTS by the row."""
        return F.when(self.is_hot(key, hot), F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0)

    def _based(self, name: str, rows: DataFrame, key: list[str]) -> dict:
        """A table of one base segment, with the leaves of its tree."""
        columns = rows.columns
        text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind in ("string", "binary")]
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(text, F.lit(8 * len(columns)).cast("bigint"))), F.lit(0)).alias("bytes")).first()
        n = size.n
        hot = [[r[c] for c in key] for r in rows.groupBy(*(F.col(c).cast("string").alias(c) for c in key)).count().filter(F.col("count") >= max(HOT_ROWS, n // HOT_SHARE)).drop("count").collect()]  # HOT_SHARE of them at most
        hot = [h for h in hot if None not in h]
        buckets = max(1, -(-n // BUCKET_ROWS), -(-size.bytes // BUCKET_BYTES))
        folder = f"{name}/base-{uuid.uuid4().hex}"
        full = rows.select(*columns, self.salt(key, hot, columns).alias("_salt"), merkle.row_hash(columns).alias("_hash"))
        own = self._registered(folder)
        by = [*key, "_salt"] if hot else key
        full.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*key).option("path", f"{self.root}/{folder}").saveAsTable(own)
        base = self._measured(folder, full.schema) | {"kind": "base", "seq": 0}
        depth = merkle.DEPTH
        leaves = f"{name}/leaves-{uuid.uuid4().hex}"
        self._written(merkle.leaves(self.spark.table(own), key, depth), leaves)
        return {"key": key, "schema": rows.schema.json(), "buckets": buckets, "hot": hot, "depth": depth, "segments": [base], "leaves": leaves}

    def create(self, tables: dict[str, Table], state=None, check: Callable[[dict], None] = lambda _: None) -> int:
        """The store's tables from now on. check: gets the tables' entries before they are published."""
        now = self.manifest()
        made = {name: self._based(name, t.rows, t.key) for name, t in tables.items()}
        check(made)
        return self.publish(made, state, now["version"])

    def apply(self, deltas: dict[str, Delta], state=None, check: Callable[[dict], None] = lambda _: None) -> int:
        """One delta a table, all visible at once or none. Work follows the deltas; of the base, only
        keys and hashes are read."""
        now = self.manifest()
        made = {}
        for name, d in deltas.items():
            t = now["tables"][name]
            key, schema, seq = t["key"], self._schema(t), now["version"] + 1
            rows = d.rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).withColumn("_hash", merkle.row_hash(schema.names)).withColumn("_gone", F.lit(False))
            if d.gone is not None:
                gone = d.gone.select(*(F.col(c).cast(schema[c].dataType).alias(c) for c in key)).distinct().join(d.rows.select(*key).distinct(), key, "left_anti")
                rows = rows.unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
            segment = self._written(rows.hint("rebalance"), f"{name}/delta-{uuid.uuid4().hex}") | {"kind": "delta", "seq": seq}
            new = self._read(segment["path"], rows.schema)
            before = self._merged(t, [*key, "_hash"]).join(new.select(*key).distinct(), key, "left_semi")
            leaves = merkle.added(self._read(t["leaves"], merkle.LEAF), merkle.leaves(before, key, t["depth"], -1), merkle.leaves(new.filter("not _gone"), key, t["depth"]))
            folder = f"{name}/leaves-{uuid.uuid4().hex}"
            self._written(leaves, folder)
            made[name] = t | {"segments": [*t["segments"], segment], "leaves": folder}
        check(made)
        return self.publish(now["tables"] | made, now["state"] if state is None else state, now["version"])

    # --- reading

    def _registered(self, folder: str) -> str:
        return "lexforge_" + hashlib.md5(f"{self.root}/{folder}".encode()).hexdigest()

    def _base(self, t: dict) -> DataFrame:
        """The base as a bucketed table, whoever wrote it."""
        base, own = t["segments"][0], self._registered(t["segments"][0]["path"])
        if not self.spark.catalog.tableExists(own):
            schema = self._schema(t, ("_salt", "integer"), ("_hash", "binary"))
            ddl = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json()).toDDL()
            keys = ", ".join(f"`{c}`" for c in t["key"])
            self.spark.sql(f"CREATE TABLE {own} ({ddl}) USING parquet CLUSTERED BY ({keys}{', `_salt`' if t['hot'] else ''}) SORTED BY ({keys}) INTO {t['buckets']} BUCKETS LOCATION '{self.root}/{base['path']}'")
        return self.spark.table(own)

    def _deltas(self, t: dict, segments: list[dict], columns: list[str], gone: bool = False) -> tuple[DataFrame, DataFrame]:
        """Rows of deltas as they stand (with tombstones if asked for), and the keys they name."""
        key, schema = t["key"], self._schema(t, ("_hash", "binary"), ("_gone", "boolean"))
        parts = [self._read(s["path"], schema).select(*columns, "_gone", F.lit(s["seq"]).alias("_seq")) for s in segments]
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        named = all_.groupBy(*key).agg(F.max("_seq").alias("_last"))
        rows = all_
        if len(parts) > 1:
            rows = all_.join(named.withColumnsRenamed({c: f"_k_{c}" for c in key}), F.expr(" AND ".join(f"`{c}` <=> `_k_{c}`" for c in key) + " AND _seq = _last")).select(all_["*"])
        return (rows if gone else rows.filter("not _gone")).select(*columns, *["_gone"] * gone), named.select(*key)

    def _merged(self, t: dict, columns: list[str]) -> DataFrame:
        key, base, deltas = t["key"], self._base(t), t["segments"][1:]
        if not deltas:
            return base.select(*columns)
        rows, named = self._deltas(t, deltas, list(dict.fromkeys([*key, *columns])))
        # dealt like the base's buckets, so that only this side moves
        named = named.repartition(t["buckets"], *key)
        if t["hot"]:
            named = named.select(*key, F.explode(F.when(self.is_hot(key, t["hot"]), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")).repartition(t["buckets"], *key, "_salt")
        old = base.join(named, named.columns, "left_anti")
        return old.select(*columns).unionByName(rows.select(*columns))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as a version has it, the newest if none is given."""
        t = self.manifest(version)["tables"][name]
        return self._merged(t, self._schema(t).names)

    def leaves(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)["tables"][name]["leaves"], merkle.LEAF)

    def digest(self, t: dict) -> tuple[int, str]:
        """Of a table's entry, from the stored leaves."""
        r = merkle.root(self._read(t["leaves"], merkle.LEAF), t["depth"]).first()
        return r.n, r.digest

    # --- compaction

    def due(self, name: str) -> str | None:
        """`base` or `deltas` if that should be compacted."""
        base, *deltas = self.manifest()["tables"][name]["segments"]
        if deltas and sum(d["rows"] for d in deltas) >= REBASE * max(1, base["rows"]):
            return "base"
        return "deltas" if len(deltas) >= FANOUT else None

    def prepare(self, name: str, kind: str) -> dict:
        """Writes what the present segments come to, aside; nothing changes until `settle`."""
        t = self.manifest()["tables"][name]
        names = self._schema(t).names
        old = t["segments"] if kind == "base" else t["segments"][1:]
        if kind == "base":
            new = self._based(name, self._merged(t, names), t["key"])
            return {"name": name, "old": old, "new": new["segments"], "entry": {k: new[k] for k in ("buckets", "hot")}}
        rows, _ = self._deltas(t, old, [*names, "_hash"], gone=True)
        segment = self._written(rows.hint("rebalance"), f"{name}/delta-{uuid.uuid4().hex}") | {"kind": "delta", "seq": old[-1]["seq"]}
        return {"name": name, "old": old, "new": [segment], "entry": {}}

    def settle(self, plan: dict) -> int:
        """Puts a prepared compaction in the place of its segments; deltas that came meanwhile stay on top."""
        now = self.manifest()
        t = now["tables"][plan["name"]]
        at = next((i for i in range(len(t["segments"])) if t["segments"][i : i + len(plan["old"])] == plan["old"]), None)
        if at is None:
            raise Conflict("the segments were compacted by another")
        segments = t["segments"][:at] + plan["new"] + t["segments"][at + len(plan["old"]) :]
        return self.publish(now["tables"] | {plan["name"]: t | plan["entry"] | {"segments": segments}}, now["state"], now["version"])

    def compact(self, name: str) -> str | None:
        """Compacts if it is due, and says what."""
        kind = self.due(name)
        if kind:
            self.settle(self.prepare(name, kind))
        return kind

    def vacuum(self, keep: int = 2) -> int:
        """Deletes files that the last `keep` versions don't use; how many folders went."""
        last, held = self.version(), set()
        for v in range(max(1, last - keep + 1), last + 1):
            for t in self.manifest(v)["tables"].values():
                held |= {s["path"] for s in t["segments"]} | {t["leaves"]}
        gone = 0
        for name in storage.names(self.spark, self.root):
            for folder in storage.names(self.spark, f"{self.root}/{name}") if name != "versions" else []:
                if f"{name}/{folder}" not in held:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._registered(f'{name}/{folder}')}")
                    storage.delete(self.spark, f"{self.root}/{name}/{folder}")
                    gone += 1
        for v in range(1, max(1, last - keep + 1)):
            storage.delete(self.spark, f"{self.root}/versions/{v}")
        return gone
