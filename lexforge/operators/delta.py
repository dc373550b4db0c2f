"""Versioned replication: change ranges, coalescing, diffs, apply, catch-up plans, generations.

The frozen window (after, through] is a range filter on the monotone change_seq; coalescing is one
partial aggregation per scope; apply is anti-join and union, so a batch touches rows of its scopes
only. Planning and gates run on manifests of a few rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from .segments import Delta, Store, Table

#: The order in which a package's relations are applied.
APPLY_ORDER = ["documents", "chunks", "chunk_embeddings", "graph_edges", "zone_units", "zone_unit_embeddings", "decision_zones", "citations", "citation_resolutions", "metadata_roots"]
#: Relations whose rows are never deleted by a diff.
KEPT = {"citations"}


class Reject(Enum):
    """The closed vocabulary of codes with which a package is refused."""

    CLIENT_TOO_OLD = "client_too_old"
    SCHEMA_AHEAD = "schema_ahead"
    MISSING_ENTITLEMENT = "missing_entitlement"
    SEQUENCE_GAP = "sequence_gap"
    WRONG_GENERATION = "wrong_generation"
    EMBEDDING_FINGERPRINT_MISMATCH = "embedding_fingerprint_mismatch"
    BUILDER_VERSION_MISMATCH = "builder_version_mismatch"
    SIGNATURE_INVALID = "signature_invalid"
    DIGEST_MISMATCH = "digest_mismatch"
    EXTENSION_MISSING = "extension_missing"
    BASELINE_REQUIRED = "baseline_required"


class Rejected(ValueError):
    """A refusal: its code, and what was found. Nothing moved."""

    def __init__(self, code: Reject, detail: str) -> None:
        super().__init__(f"{code.value}: {detail}")
        self.code = code


def changed_scopes(changes: DataFrame, corpus: str, after: int, through: int) -> DataFrame:
    s = F.col("change_seq")
    return changes.filter((F.col("corpus") == corpus) & (s > after) & (s <= through))


def high_water(changes: DataFrame) -> DataFrame:
    return changes.groupBy("corpus").agg(F.coalesce(F.max("change_seq"), F.lit(0)).alias("high"))


def coalesce_scopes(changes: DataFrame) -> DataFrame:
    """A row per scope: the widest operation wins; a document change rebuilds the chunks; an
    embedding change counts only where nothing wider happened."""
    has = lambda r: F.bool_or(F.col("relation") == r)
    g = changes.groupBy("corpus", "scope").agg(has("documents").alias("d"), has("chunks").alias("c"), has("chunk_embeddings").alias("e"), F.bool_or(F.col("op") == "replace_set").alias("r"), F.max("change_seq").alias("last_seq"))
    return g.select("corpus", "scope", "last_seq", F.when(F.col("r"), "replace_set").otherwise("rows").alias("mode"), (F.col("d") | F.col("c")).alias("chunks_wide"), (F.col("e") & ~F.col("d") & ~F.col("c")).alias("embeddings_only"))


def diff_rows(scopes: DataFrame, present: DataFrame, relation: str = "documents") -> DataFrame:
    """Scopes with a row now are upserts, others deletes; but rows of KEPT relations are never deleted."""
    p = present.select("scope", F.lit(True).alias("_here")).distinct()
    out = scopes.select("scope").distinct().join(p, "scope", "left").select("scope", F.when(F.col("_here"), "upsert").otherwise("delete").alias("op"))
    return out.filter("op = 'upsert'") if relation in KEPT else out


def apply_deletes(target: DataFrame, gone: DataFrame, key: str, parent: str | None = None) -> DataFrame:
    """Rows whose key, or whose parent's, isn't deleted."""
    return target.join(gone.select(F.col(key).alias(parent or key)).distinct(), parent or key, "left_anti")


def apply_upserts(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def apply_replace_set(target: DataFrame, rows: DataFrame, scopes: DataFrame, scope: str) -> DataFrame:
    """The scopes' sets give way to the new rows; a scope without rows is emptied."""
    return target.join(scopes.select(scope).distinct(), scope, "left_anti").unionByName(rows)


def set_digests(rows: DataFrame, scope: str, key: str, columns: list[str]) -> DataFrame:
    """sha256 per scope over the canonical JSON of its rows in key order: an array of objects, their
    keys sorted, without white space."""
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("j")))), lambda x: x["j"])
    return rows.groupBy(scope).agg(F.count("*").alias("n"), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256)).alias("digest"))


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


# --- accounting --------------------------------------------------------------------------------

#: What a member's earlier run must share with the present one.
STAMPS = ["parser_version", "schema_version", "code_version", "source_payload_hash"]


def resume_decision(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """What to do with each wanted member (archive_name, member_path and STAMPS): action, reason,
    previous_run_id, previous_status, mismatched (comma-joined). members: rows of former runs, run_id,
    status, updated_at, member_id and the same columns. The last row counts; a stamp that differs
    blocks; inserted and skipped members are done, others are tried again."""
    key = ["archive_name", "member_path"]
    last = members.groupBy(*key).agg(F.max_by(F.struct("run_id", "status", *STAMPS), F.struct("updated_at", "member_id")).alias("p"))
    j = wanted.join(last, key, "left")
    differ = F.concat_ws(",", *(F.when(F.col(f"p.{c}") != F.col(c), c) for c in STAMPS))
    done, known = F.col("p.status").isin("inserted", "skipped"), F.col("p").isNotNull()
    action = F.when(~known, "process").when(differ != "", "blocked_incompatible").when(done, "skip").otherwise("retry")
    reason = F.when(~known, "new_member").when(differ != "", "compatibility_mismatch").when(done, "compatible_complete").when(F.col("p.status") == "failed", "previous_failed").otherwise("previous_unfinished")
    return j.select(*key, action.alias("action"), reason.alias("reason"), F.col("p.run_id").alias("previous_run_id"), F.col("p.status").alias("previous_status"), F.when(known, differ).otherwise("").alias("mismatched"))


def ingest_cursor(runs: DataFrame) -> DataFrame:
    """source, cursor: the newest archive stamp of completed runs (source, status, stamp,
    member_limited) that weren't limited to some members; null if none. A stamp of another shape than
    14 digits fails the query."""
    ok = (F.col("status") == "completed") & F.col("stamp").isNotNull() & ~F.coalesce("member_limited", F.lit(False))
    c = runs.groupBy("source").agg(F.max(F.when(ok, F.col("stamp"))).alias("cursor"))
    bad = F.col("cursor").isNotNull() & ~F.col("cursor").rlike("^[0-9]{14}$")
    return c.select("source", F.when(bad, F.raise_error(F.concat(F.lit("ingest_accounting: no compact timestamp: "), F.col("cursor"))).cast("string")).otherwise(F.col("cursor")).alias("cursor"))


def baseline_decision(sources: DataFrame) -> DataFrame:
    """The sources (source, run_group, fetched, adopted) with their state: no_baseline_fetched, current, or
    rebaseline_pending where the newest fetched baseline isn't the adopted one."""
    state = F.when(F.col("fetched").isNull(), "no_baseline_fetched").when(F.col("fetched").eqNullSafe(F.col("adopted")), "current").otherwise("rebaseline_pending")
    return sources.withColumn("state", state)


def group_run_kind(decisions: DataFrame) -> DataFrame:
    """run_group, kind, pending: one pending source makes the group's run a rebaseline, and no
    increment may cross it. pending: `source:baseline` of those, comma-joined in order."""
    p = F.when(F.col("state") == "rebaseline_pending", F.struct("source", "fetched"))
    listed = F.transform(F.sort_array(F.collect_set(p)), lambda x: F.concat_ws(":", x["source"], x["fetched"]))
    g = decisions.groupBy("run_group").agg(F.array_join(listed, ",").alias("pending"))
    return g.select("run_group", F.when(F.col("pending") != "", "rebaseline").otherwise("incremental").alias("kind"), "pending")


def producer_status(runs: DataFrame, decisions: DataFrame, published: bool, now: Column, stale_after: int) -> DataFrame:
    """overall: broken if a group's last run failed or nothing is published; else stale if a baseline
    is pending, a run is in flight, a group never ran, or its last success is older than stale_after
    seconds; else current. runs: run_group, outcome (success, failure, running, null: never), ended_at."""
    by_age = (F.col("outcome") == "success") & (F.unix_timestamp(now) - F.unix_timestamp("ended_at") > stale_after)
    r = runs.agg(F.coalesce(F.bool_or(F.col("outcome") == "failure"), F.lit(False)).alias("failed"), F.coalesce(F.bool_or(F.col("outcome").isNull() | (F.col("outcome") == "running") | F.coalesce(by_age, F.lit(False))), F.lit(False)).alias("behind"))
    d = decisions.agg(F.coalesce(F.bool_or(F.col("state") == "rebaseline_pending"), F.lit(False)).alias("pending"))
    return r.join(d).select(F.when(F.col("failed") | ~F.lit(published), "broken").when(F.col("behind") | F.col("pending"), "stale").otherwise("current").alias("overall"), "failed", "behind", "pending")  # one row each


def catalog_latest(catalog: DataFrame) -> DataFrame:
    """The newest package of each corpus."""
    return catalog.groupBy("corpus").agg(F.max_by(F.struct(*(c for c in catalog.columns if c != "corpus")), "package_sequence").alias("p")).select("corpus", "p.*")


def manifest_build(catalog: DataFrame, keep: int) -> DataFrame:
    """corpus, media_id, head, min_available, n_packages, requires_baseline_to, gap of a catalog (corpus,
    package_id, package_kind, from_sequence, to_sequence): the newest media root, the newest `keep`
    increments after it, and whether these leave a gap, with which a feed must not be published. A
    client below requires_baseline_to + 1 must load the media."""
    media = F.col("package_kind").isin("baseline", "rebaseline")
    root = catalog.filter(media).groupBy("corpus").agg(F.max_by("package_id", "to_sequence").alias("media_id"), F.max("to_sequence").alias("media_seq"))
    inc = catalog.filter(~media).join(F.broadcast(root), "corpus").filter(F.col("to_sequence") > F.col("media_seq"))  # a row per corpus
    newest = W.partitionBy("corpus").orderBy(F.desc("to_sequence"))
    inc = inc.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep)  # cut to `keep` a task before the shuffle
    gap = F.col("from_sequence") != F.lag("to_sequence").over(W.partitionBy("corpus").orderBy("to_sequence"))
    g = inc.withColumn("gap", F.coalesce(gap, F.lit(False))).groupBy("corpus").agg(F.max("to_sequence").alias("top"), F.min("from_sequence").alias("low"), F.count("*").alias("n"), F.bool_or("gap").alias("gap"))
    j = root.join(g, "corpus", "left")
    low = F.coalesce("low", "media_seq")
    return j.select("corpus", "media_id", F.coalesce("top", "media_seq").alias("head"), low.alias("min_available"), F.coalesce("n", F.lit(0)).alias("n_packages"), F.when(low > 1, low - 1).alias("requires_baseline_to"), F.coalesce("gap", F.lit(False)).alias("gap"))


# --- gates and plans ---------------------------------------------------------------------------

Version = tuple[int, int, int]
CLIENT_VERSION: Version = (1, 0, 0)
SCHEMA_VERSION = 24


@dataclass(frozen=True)
class Stamps:
    schema_version: int = SCHEMA_VERSION
    fingerprint: str = ""
    builders: tuple[tuple[str, str], ...] = ()


def schema_gate(package: int, corpus: int, client: int = SCHEMA_VERSION) -> str:
    """equal, or additive_ahead where the package's migration must run first."""
    if corpus > client:
        raise Rejected(Reject.SCHEMA_AHEAD, f"corpus schema {corpus} is ahead of the client's {client}")
    if package > client:
        raise Rejected(Reject.CLIENT_TOO_OLD, f"package schema {package} is beyond the client's {client}")
    if package < corpus:
        raise Rejected(Reject.BASELINE_REQUIRED, f"package schema {package} is behind the corpus's {corpus}")
    return "equal" if package == corpus else "additive_ahead"


def compat_check(package: Stamps, current: Stamps) -> None:
    """The embedding fingerprint and each builder of the package must be the corpus's."""
    if package.fingerprint != current.fingerprint:
        raise Rejected(Reject.EMBEDDING_FINGERPRINT_MISMATCH, f"{package.fingerprint!r} is not {current.fingerprint!r}")
    have = dict(current.builders)
    for name, version in package.builders:
        if have.get(name) != version:
            raise Rejected(Reject.BUILDER_VERSION_MISMATCH, f"{name}: {version!r} is not {have.get(name)!r}")


@dataclass(frozen=True)
class Entry:
    """An increment of a feed: one step from a sequence to the next."""

    package_id: str
    from_sequence: int
    to_sequence: int
    size: int = 0
    unpacked: int = 0
    apply_seconds: int = 0
    requires_baseline: bool = False
    minimum_client: Version = (0, 0, 0)
    stamps: Stamps = Stamps()


@dataclass(frozen=True)
class Baseline:
    baseline_id: str
    kind: str
    sequence: int
    size: int = 0
    unpacked: int = 0
    load_seconds: int = 0
    minimum_client: Version = (0, 0, 0)
    schema_version: int = SCHEMA_VERSION


@dataclass(frozen=True)
class Policy:
    max_packages: int = 60
    size_permille: int = 800
    unpacked_permille: int = 800
    apply_seconds: int = 3600


@dataclass(frozen=True)
class Feed:
    corpus: str
    head: int
    min_available: int
    baseline: Baseline
    packages: tuple[Entry, ...] = ()
    #: (from, to or None) ranges of positions that must load the baseline; open ones say nothing new.
    baseline_ranges: tuple[tuple[int, int | None], ...] = ()
    policy: Policy = Policy()


@dataclass(frozen=True)
class Cursor:
    sequence: int
    stamps: Stamps = Stamps()


@dataclass(frozen=True)
class Plan:
    kind: str
    packages: tuple[str, ...] = ()
    code: Reject | None = None


def plan_catchup(feed: Feed, cursor: Cursor | None, client: Version = CLIENT_VERSION, schema: int = SCHEMA_VERSION) -> Plan:
    """up_to_date, incremental, fresh_baseline or blocked. A client without the corpus loads the active
    baseline; one that has it can only be moved by the gap-free chain of increments to the head, or by a
    rebaseline ahead of it."""
    base = feed.baseline
    stop = lambda code: Plan("blocked", (), code)

    def load() -> Plan:
        if client < base.minimum_client:
            return stop(Reject.CLIENT_TOO_OLD)
        return stop(Reject.SCHEMA_AHEAD) if base.schema_version > schema else Plan("fresh_baseline", (base.baseline_id,))

    if base.sequence > feed.head:
        return stop(Reject.WRONG_GENERATION)
    if cursor is None:
        return load()
    if cursor.sequence == feed.head:
        return Plan("up_to_date")
    if cursor.sequence > feed.head:
        return stop(Reject.WRONG_GENERATION)
    reload = load() if base.kind == "rebaseline" and base.sequence > cursor.sequence else stop(Reject.BASELINE_REQUIRED)
    chain = chain_of(feed, cursor.sequence)
    routed = any(a <= cursor.sequence and b is not None and cursor.sequence <= b for a, b in feed.baseline_ranges)
    if cursor.sequence < feed.min_available or chain is None or routed:
        return reload
    if any(client < e.minimum_client for e in chain):
        return stop(Reject.CLIENT_TOO_OLD)
    if any(e.stamps.schema_version > schema for e in chain):
        return reload if reload.kind == "fresh_baseline" else stop(Reject.SCHEMA_AHEAD)
    return reload if baseline_preferred(feed, cursor, chain) else Plan("incremental", tuple(e.package_id for e in chain))


def chain_of(feed: Feed, at: int) -> list[Entry] | None:
    """The steps of one from a position to the head; None at a gap, a fork or a longer step."""
    chain: list[Entry] = []
    while at < feed.head:
        steps = [e for e in feed.packages if e.from_sequence == at]
        if len(steps) != 1 or steps[0].to_sequence != at + 1:
            return None
        chain += steps
        at += 1
    return chain


def baseline_preferred(feed: Feed, cursor: Cursor, chain: list[Entry]) -> bool:
    """Whether the chain crosses a reissue, or costs more than the policy allows against the baseline."""
    base, policy = feed.baseline, feed.policy
    over = lambda diff, whole, permille: diff > 0 if whole == 0 else 1000 * diff > permille * whole
    seconds = sum(e.apply_seconds for e in chain)
    return (
        any(e.requires_baseline or e.stamps.fingerprint != cursor.stamps.fingerprint or dict(e.stamps.builders) != dict(cursor.stamps.builders) for e in chain)
        or len(chain) > policy.max_packages
        or over(sum(e.size for e in chain), base.size, policy.size_permille)
        or over(sum(e.unpacked for e in chain), base.unpacked, policy.unpacked_permille)
        or seconds > min(policy.apply_seconds, base.load_seconds)
    )


#: What a chain of increments comes to, and how two chains that meet are put together.
CHAIN = {"packages": "a + b", "size": "a + b", "unpacked": "a + b", "seconds": "a + b", "reissue": "a OR b", "client": "greatest(a, b)", "schema": "greatest(a, b)", "least_stamp": "least(a, b)", "most_stamp": "greatest(a, b)"}


def chains(increments: DataFrame) -> DataFrame:
    """corpus, at, end and CHAIN: for each position with one step of one from it, how far steps go on without a
    gap, and what they come to. By pointer doubling: each round joins every chain with the one that begins where
    it ends, so a chain of any length takes the logarithm of it in rounds, for all corpora and
    positions at once, and no task holds a corpus. increments: corpus, from_sequence, to_sequence,
    size, unpacked, seconds, reissue (it needs a baseline), client (the least version), schema, stamp."""
    spark = increments.sparkSession
    storage.scratch_dir(spark)
    one = increments.groupBy("corpus", F.col("from_sequence").alias("at")).agg(F.count(F.lit(1)).alias("packages"), *(F.max(c).alias(c) for c in ("to_sequence", "size", "unpacked", "seconds", "reissue", "client", "schema")), F.min("stamp").alias("least_stamp"), F.max("stamp").alias("most_stamp"))
    now = one.filter("packages = 1 AND to_sequence = at + 1").withColumnRenamed("to_sequence", "end").checkpoint()
    while True:
        ahead = now.select(F.col("corpus").alias("_corpus"), F.col("at").alias("_at"), *(F.col(c).alias(f"_{c}") for c in ("end", *CHAIN)))
        joined = now.join(ahead, F.expr("corpus = _corpus AND end = _at"), "left")
        then = lambda c, both: F.expr(f"CASE WHEN _at IS NULL THEN {c} ELSE {both} END").alias(c)
        new = joined.select("corpus", "at", then("end", "_end"), *(then(c, re.sub(r"\b[ab]\b", lambda m, c=c: c if m[0] == "a" else f"_{c}", rule)) for c, rule in CHAIN.items()), F.col("_at").isNotNull().alias("_moved")).checkpoint()
        moved = not new.filter("_moved").isEmpty()
        now = new.drop("_moved")
        if not moved:
            return now


def plan_catchups(increments: DataFrame, feeds: DataFrame, cursors: DataFrame, policy: Policy = Policy(), client: int = 1, schema: int = SCHEMA_VERSION) -> DataFrame:
    """client_id, corpus, plan, packages, baseline_id, code for all cursors (client_id, corpus, sequence, null
    without the corpus; stamp) at once, by the rules of plan_catchup. feeds: corpus, head, min_available,
    baseline_id, baseline_kind, baseline_sequence, base_size, base_unpacked, load_seconds, base_client, base_schema."""
    feed = F.broadcast(feeds)  # a row per corpus
    j = cursors.join(feed, "corpus").join(chains(increments).withColumnsRenamed({"at": "sequence"}), ["corpus", "sequence"], "left")
    load = f"CASE WHEN {client} < base_client THEN 'client_too_old' WHEN base_schema > {schema} THEN 'schema_ahead' END"
    ahead = "baseline_kind = 'rebaseline' AND baseline_sequence > sequence"
    over = lambda diff, whole, permille: f"CASE WHEN {whole} = 0 THEN {diff} > 0 ELSE 1000 * {diff} > {permille} * {whole} END"
    preferred = f"reissue OR least_stamp <> stamp OR most_stamp <> stamp OR packages > {policy.max_packages} OR {over('size', 'base_size', policy.size_permille)} OR {over('unpacked', 'base_unpacked', policy.unpacked_permille)} OR seconds > least({policy.apply_seconds}, load_seconds)"
    route = f"""CASE WHEN baseline_sequence > head THEN 'wrong' WHEN sequence IS NULL THEN 'load' WHEN sequence = head THEN 'up_to_date' WHEN sequence > head THEN 'wrong' WHEN sequence < min_available OR end IS NULL OR end <> head THEN 'reload'
      WHEN client > {client} THEN 'old' WHEN schema > {schema} THEN 'newer' WHEN {preferred} THEN 'reload' ELSE 'incremental' END"""
    code = f"""CASE route WHEN 'wrong' THEN 'wrong_generation' WHEN 'old' THEN 'client_too_old' WHEN 'load' THEN {load} WHEN 'reload' THEN CASE WHEN {ahead} THEN {load} ELSE 'baseline_required' END
      WHEN 'newer' THEN CASE WHEN {ahead} AND ({load}) IS NULL THEN NULL ELSE 'schema_ahead' END END"""
    out = j.withColumn("route", F.expr(route)).withColumn("code", F.expr(code))
    plan = "CASE WHEN code IS NOT NULL THEN 'blocked' WHEN route IN ('up_to_date', 'incremental') THEN route ELSE 'fresh_baseline' END"
    return out.select("client_id", "corpus", F.expr(plan).alias("plan"), "route", "packages", "baseline_id", "code").select("client_id", "corpus", "plan", F.expr("CASE WHEN plan = 'incremental' THEN packages ELSE 0 END").alias("packages"), F.expr("CASE WHEN plan = 'fresh_baseline' THEN baseline_id END").alias("baseline_id"), "code")


@dataclass(frozen=True)
class State:
    """What a corpus is at: its row in the control table, or rather its pointer file."""

    sequence: int
    package_id: str
    package_digest: str
    generation: int
    baseline_id: str
    stamps: Stamps = Stamps()


def media_idempotency(now: State | None, sequence: int, package_id: str, digest: str, rebaseline: bool) -> str:
    """apply or noop for a baseline or rebaseline that leads to a sequence."""
    if now is None:
        return "apply"
    if now.sequence == sequence:
        if (now.package_id, now.package_digest) == (package_id, digest):
            return "noop"
        raise Rejected(Reject.DIGEST_MISMATCH, f"another package led to sequence {sequence}")
    if now.sequence > sequence:
        raise Rejected(Reject.WRONG_GENERATION, f"the corpus is at {now.sequence}, ahead of {sequence}")
    if not rebaseline:
        raise Rejected(Reject.BASELINE_REQUIRED, f"the corpus is installed at {now.sequence}; a rebaseline is needed")
    return "apply"


def activation_guard(now: State | None, guard: str, value: int = 0) -> None:
    """first: no generation may be active; exact: the corpus must be at `value`; forward: it must be
    absent or behind `value`."""
    at = None if now is None else now.sequence
    ok = {"first": at is None, "exact": at == value, "forward": at is None or at < value}[guard]
    if not ok:
        raise Rejected(Reject.BASELINE_REQUIRED if guard == "first" else Reject.WRONG_GENERATION, f"{guard} guard: the corpus is at {at}")


@dataclass(frozen=True)
class Package:
    """An increment to apply, with the state it expects and the digests it must lead to."""

    package_id: str
    digest: str
    from_sequence: int
    to_sequence: int
    previous_id: str | None = None
    previous_digest: str | None = None
    baseline_id: str | None = None
    generation: int | None = None
    minimum_client: Version = (0, 0, 0)
    stamps: Stamps = Stamps()
    #: table -> (rows, digest) after the apply
    expected: dict[str, tuple[int, str]] = field(default_factory=dict)


class Generations:
    """A corpus's tables as segments under a shared folder, and what it is at, in one versioned
    manifest. A baseline writes bases, an increment deltas; what is written is verified by the tables' Merkle
    roots and then published in one step; until then readers see the version before, and a broken
    apply leaves nothing visible."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def state(self) -> State | None:
        raw = self.store.manifest()["state"]
        if raw is None:
            return None
        s = raw["stamps"]
        return State(**{**raw, "stamps": Stamps(s["schema_version"], s["fingerprint"], tuple(map(tuple, s["builders"])))})

    def read(self, name: str, version: int | None = None) -> DataFrame:
        if self.state() is None:
            raise Rejected(Reject.BASELINE_REQUIRED, "no generation is active")
        return self.store.read(name, version)

    def _verified(self, expected: dict[str, tuple[int, str]], guard: tuple) -> Callable[[dict], None]:
        def check(made: dict) -> None:
            for name, want in expected.items():
                if (got := self.store.digest(made[name])) != want:
                    raise Rejected(Reject.DIGEST_MISMATCH, f"{name} has {got[0]} rows of {got[1]}")
            activation_guard(self.state(), *guard)

        return check

    @staticmethod
    def _told(s: State) -> dict:
        return {**s.__dict__, "stamps": {**s.stamps.__dict__, "builders": [list(b) for b in s.stamps.builders]}}

    def load(self, baseline: Baseline, digest: str, tables: dict[str, Table], stamps: Stamps = Stamps(), expected: dict[str, tuple[int, str]] | None = None) -> str:
        """applied or noop, for a baseline or rebaseline: the corpus is the given tables and no others."""
        forward = baseline.kind == "rebaseline"
        if client_below(baseline.minimum_client):
            raise Rejected(Reject.CLIENT_TOO_OLD, f"{baseline.baseline_id} needs {baseline.minimum_client}")
        now = self.state()
        if media_idempotency(now, baseline.sequence, baseline.baseline_id, digest, forward) == "noop":
            return "noop"
        guard = ("forward", baseline.sequence) if forward else ("first",)
        state = State(baseline.sequence, baseline.baseline_id, digest, 1 + (now.generation if now else 0), baseline.baseline_id, stamps)
        self.store.create(in_order(tables), self._told(state), self._verified(expected or {}, guard))
        return "applied"

    def apply(self, package: Package, deltas: dict[str, Delta]) -> str:
        """applied or noop; the gates in order: client, schema, installed, same package, order, chain,
        expected state, content stamps. All or nothing; what is written is in proportion to the deltas."""
        now = self.state()
        if client_below(package.minimum_client):
            raise Rejected(Reject.CLIENT_TOO_OLD, f"{package.package_id} needs {package.minimum_client}")
        if now is None:
            raise Rejected(Reject.BASELINE_REQUIRED, "no generation is active")
        schema_gate(package.stamps.schema_version, now.stamps.schema_version)
        if now.sequence >= package.to_sequence:
            return media_idempotency(now, package.to_sequence, package.package_id, package.digest, False)
        if now.sequence != package.from_sequence:
            raise Rejected(Reject.SEQUENCE_GAP, f"the corpus is at {now.sequence}, the package starts at {package.from_sequence}")
        if package.previous_id is not None and package.previous_id != now.package_id:
            raise Rejected(Reject.WRONG_GENERATION, f"the last package is {now.package_id}")
        if package.previous_digest is not None and package.previous_digest != now.package_digest:
            raise Rejected(Reject.DIGEST_MISMATCH, "the last package had another digest")
        if package.baseline_id not in (None, now.baseline_id) or package.generation not in (None, now.generation):
            raise Rejected(Reject.WRONG_GENERATION, f"the corpus is on {now.baseline_id}, generation {now.generation}")
        compat_check(package.stamps, now.stamps)
        state = State(package.to_sequence, package.package_id, package.digest, now.generation, now.baseline_id, package.stamps)
        self.store.apply(in_order(deltas), self._told(state), self._verified(package.expected, ("exact", package.from_sequence)))
        return "applied"


def in_order(tables: dict) -> dict:
    """Tables in the order in which they are applied."""
    return dict(sorted(tables.items(), key=lambda t: APPLY_ORDER.index(t[0]) if t[0] in APPLY_ORDER else len(APPLY_ORDER)))


def client_below(minimum: Version, client: Version = CLIENT_VERSION) -> bool:
    return client < minimum


# --- cache rows that expire --------------------------------------------------------------------

#: Seconds that a cached outcome holds, by status; any other is a negative one.
TTL = {"ok": 30 * 86_400, "invalid_offsets": 30 * 86_400, "upstream_error": 3_600}
NEGATIVE_TTL = 7 * 86_400


def expires_at(status: Column, fetched: Column) -> Column:
    seconds = F.lit(NEGATIVE_TTL)
    for name, n in TTL.items():
        seconds = F.when(status == name, n).otherwise(seconds)
    return F.timestamp_seconds(F.unix_timestamp(fetched) + seconds)


def zone_cache_read(rows: DataFrame, now: Column) -> DataFrame:
    """The newest cached row of each document (document_id, status, fetched_at), when it expires, and
    whether it has."""
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("status", "fetched_at"), F.struct("fetched_at", "status")).alias("z")).select("document_id", "z.*")
    out = last.withColumn("expires_at", expires_at(F.col("status"), F.col("fetched_at")))
    return out.withColumn("expired", F.col("expires_at") <= now)

