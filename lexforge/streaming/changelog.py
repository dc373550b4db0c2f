"""The change log as a stream: windowed op counts under a watermark, coalescing per scope, release in
order with a buffer for what follows a gap, an idempotent applier, cache rows that expire by timer, and a
bounded polling loop.

Order is per corpus. A stateful processor keeps the next sequence of each and, as runs in the state
store, what came too early; when the missing change comes, in any later batch or after a restart, the
run behind it is released. A change that comes again is dropped. The state is RocksDB under the
query's checkpoint, so what is held lies on disk, and moves with the key's partition.

The applier writes each micro-batch's coalesced scopes as its own part of a table, then moves a
pointer (batch, high sequence) in one step, all in the folder that executors share; the query keeps
its offsets in a checkpoint folder beside them. A batch that is run again after a failure overwrites its
own part or is skipped, so nothing is applied twice, whoever restarts it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from enum import Enum
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import storage
from ..operators.delta import NEGATIVE_TTL, TTL, Rejected

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def change_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Change rows of the parquet files under a path (a file or folder), as they come."""
    glob = path if not path.endswith(".parquet") else path.rsplit("/", 1)[0]
    name = path.rsplit("/", 1)[1] if path.endswith(".parquet") else "*.parquet"
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", name).parquet(glob)
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "replace_set").otherwise("upsert")
    return s.select(F.col("event_id").alias("change_seq"), "ts", F.col("user_id").alias("scope"), op.alias("op"))


def op_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts per window and op; rows later than the watermark are dropped, as they must be."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "op").agg(F.count("*").alias("n"))


def coalesced(rows: DataFrame) -> DataFrame:
    """A row per scope: its last sequence, whether a set was replaced, and how many changes."""
    return rows.groupBy("scope").agg(F.max("change_seq").alias("last_seq"), F.bool_or(F.col("op") == "replace_set").alias("replaced"), F.count("*").alias("n"))


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each change once within the watermark: re-sent changes are no-ops."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["change_seq"])


#: Rows that are sorted in memory at a time, and rows of a run as it is kept in the state.
CHUNK, RUN = 20_000, 1_000
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RELEASED = "corpus string, change_seq long, ts timestamp, scope long, op string"


def chunks(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield part


class Release(StatefulProcessor):
    """Per corpus: changes in order without a gap, from `first` on. What follows a gap is held until the
    missing change comes; `held_back` tells what waits and for which."""

    def __init__(self, first: int) -> None:
        self.first = first

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.held = handle.getMapState("held", "start long", "rows string")

    def at(self) -> int:
        return self.next.get()[0] if self.next.exists() else self.first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.at()
        for part in chunks(rows, CHUNK):
            fresh = sorted({r.change_seq: (r.change_seq, r.ts.timestamp(), r.scope, r.op) for r in part if r.change_seq >= n}.items())
            runs: list[list[tuple]] = []
            for seq, x in fresh:
                if runs and seq == runs[-1][-1][0] + 1 and len(runs[-1]) < RUN:
                    runs[-1].append(x)
                else:
                    runs.append([x])
            for run in runs:
                if run[0][0] == n:
                    n += len(run)
                    yield from (self.row(key, x) for x in run)
                else:
                    before = json.loads(self.held.getValue((run[0][0],))[0]) if self.held.containsKey((run[0][0],)) else []
                    if len(run) > len(before):  # of two runs from one start the longer says all
                        self.held.updateValue((run[0][0],), (json.dumps(run),))
        starts = sorted(k[0] for k in self.held.keys())
        for start in starts:
            if start > n:
                break
            for x in json.loads(self.held.getValue((start,))[0]):
                if x[0] == n:
                    n += 1
                    yield self.row(key, x)
            self.held.removeKey((start,))
        self.next.update((n,))

    @staticmethod
    def row(key, x) -> Row:
        return Row(corpus=key[0], change_seq=x[0], ts=datetime.fromtimestamp(x[1]), scope=x[2], op=x[3])

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """The state store that the processors need."""
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)


def in_order(stream: DataFrame, first: int = 0) -> DataFrame:
    """Changes (corpus, change_seq, ts, scope, op) of each corpus as RELEASED, in order and once."""
    stateful(stream.sparkSession)
    rows = stream.select(F.col("corpus").cast("string").alias("corpus"), "change_seq", "ts", "scope", "op")
    return rows.groupBy("corpus").transformWithState(Release(first), RELEASED, "Append", "None")


def held_back(spark: SparkSession, root: str) -> DataFrame:
    """corpus, missing, held_from, runs of each corpus that waits: read from the state of the query under root."""
    state = lambda name: spark.read.format("statestore").option("path", f"{root}/offsets").option("stateVarName", name).load()
    at = state("next").select("key.corpus", F.col("value.seq").alias("missing"))
    held = state("held").groupBy(F.col("key.corpus").alias("corpus")).agg(F.min("user_map_key.start").alias("held_from"), F.count(F.lit(1)).alias("runs"))
    return at.join(held, "corpus")


class Cached(StatefulProcessor):
    """Per document and status: the look-ups that find no living cache row. One that passes is cached for its
    status's lifetime; at its end a timer removes it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ttl = 1000 * TTL.get(key[1], NEGATIVE_TTL)
        before = until = self.until.get()[0] if self.until.exists() else None
        for part in chunks(rows, CHUNK):
            for r in sorted(part, key=lambda r: r.fetched_at):
                ms = int(r.fetched_at.timestamp() * 1000)
                if until is None or ms >= until:
                    until = ms + ttl
                    yield Row(document_id=key[0], status=key[1], fetched_at=r.fetched_at)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def while_cached(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Of look-ups (document_id, status, fetched_at), those that find no living cache row of their
    status: a repeat within the status's lifetime is dropped, a later one passes. Look-ups come in order
    of time, but for `late`; of one micro-batch a key's are sorted."""
    stateful(stream.sparkSession)
    kind = f"document_id {stream.schema['document_id'].dataType.simpleString()}, status string, fetched_at timestamp"
    rows = stream.select("document_id", "status", "fetched_at").withWatermark("fetched_at", late)
    return rows.groupBy("document_id", "status").transformWithState(Cached(), kind, "Append", "EventTime")


class Applier:
    """For foreachBatch: applies micro-batches of changes under a shared folder; each writes its own part."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def state(self) -> dict:
        text = storage.read_text(self.spark, f"{self.root}/APPLIED")
        return json.loads(text) if text else {"batch": -1, "high": -1}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self.state()
        if batch_id <= now["batch"]:
            return
        # one run of the batch gives its scopes and how far it goes
        coalesced(batch).write.mode("overwrite").parquet(f"{self.root}/scopes/batch={batch_id}")
        top = self.spark.read.schema("last_seq long").parquet(f"{self.root}/scopes/batch={batch_id}").agg(F.max("last_seq")).first()[0]
        storage.swap_text(self.spark, f"{self.root}/APPLIED", json.dumps({"batch": batch_id, "high": now["high"] if top is None else max(now["high"], top)}))

    def scopes(self) -> DataFrame:
        """What all applied batches come to, a row per scope."""
        parts = self.spark.read.schema("scope long, last_seq long, replaced boolean, n long, batch int").parquet(f"{self.root}/scopes").filter(F.col("batch") <= self.state()["batch"])
        return parts.groupBy("scope").agg(F.max("last_seq").alias("last_seq"), F.bool_or("replaced").alias("replaced"), F.sum("n").alias("n"))


def run_available(stream: DataFrame, applier: Callable[[DataFrame, int], None], root: str | None = None) -> None:
    """Applies what is there now, from the offsets of the last run on."""
    q = stream.writeStream.foreachBatch(applier).option("checkpointLocation", f"{root or applier.root}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()


def coalesce_stream_once(spark: SparkSession, path: str) -> DataFrame:
    """Coalesces what is there now; run again, it goes on from there."""
    applier = Applier(spark, storage.place(spark, "changelog", path))
    run_available(change_stream(spark, path), applier)
    return applier.scopes()


class Cycle(Enum):
    UP_TO_DATE = "up_to_date"
    PROGRESS = "progress"
    RETRYABLE = "retryable"
    REJECTED = "rejected"


def poll(cycle: Callable[[], bool], rounds: int, interval: float, backoff: tuple[float, float], burst: int = 8, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> list[tuple[Cycle, float]]:
    """Runs cycles (true: something was applied) for a number of rounds and tells each one's class and
    the pause after it. After progress the next one follows at once, `burst` times at most; a refusal
    waits the interval, as it won't mend itself; any other error is tried again after a pause that
    doubles between the bounds. Asked to stop, it does so before the next cycle."""
    done: list[tuple[Cycle, float]] = []
    faults = progress = 0
    while len(done) < rounds and not stop():
        try:
            kind = Cycle.PROGRESS if cycle() else Cycle.UP_TO_DATE
        except Rejected:
            kind = Cycle.REJECTED
        except Exception:  # a fault of the data plane must not end the loop
            kind = Cycle.RETRYABLE
        faults = faults + 1 if kind is Cycle.RETRYABLE else 0
        progress = progress + 1 if kind is Cycle.PROGRESS else 0
        pause = min(backoff[1], backoff[0] * 2 ** (faults - 1)) if faults else 0.0 if 0 < progress <= burst else interval
        done.append((kind, pause))
        if pause:
            sleep(pause)
    return done
