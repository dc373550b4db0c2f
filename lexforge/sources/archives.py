"""Archives of XML members: names, plans, integrity, a distributed reader, JSONL, and sinks."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import Delta, Store

SOURCES = ["legi", "cass", "capp", "inca", "jade"]
NAME = r"^(?:Freemium_([a-z]+)_global_|([A-Z]+)_)([0-9]{8})-([0-9]{6})\.tar\.gz$"
MEMBERS = "archive string, member string, size long, sha256 string, xml binary, error string"


def parse_name(name: Column, source: str) -> Column:
    """struct<kind, stamp> of an archive of the source; else null."""
    base, delta = F.regexp_extract(name, NAME, 1), F.regexp_extract(name, NAME, 2)
    stamp = F.concat(F.regexp_extract(name, NAME, 3), F.regexp_extract(name, NAME, 4))
    return F.when((base == source) | (F.lower(delta) == source), F.struct(F.when(base != "", "baseline").otherwise("delta").alias("kind"), stamp.alias("stamp")))


def plan_archives(names: DataFrame, source: str) -> DataFrame:
    """name, kind, stamp, action (baseline, delta or the reason it is skipped): the newest baseline
    and the deltas strictly after it."""
    p = names.select("name", parse_name(F.col("name"), source).alias("p")).select("name", "p.kind", "p.stamp")
    newest = p.filter("kind = 'baseline'").agg(F.max("stamp").alias("newest"))
    action = (
        F.when(F.col("kind").isNull(), "unrecognized_filename")
        .when((F.col("kind") == "baseline") & (F.col("stamp") < F.col("newest")), "older_baseline")
        .when(F.col("kind") == "baseline", "baseline")
        .when(F.col("newest").isNull() | (F.col("stamp") > F.col("newest")), "delta")
        .otherwise("delta_not_after_selected_baseline")
    )
    return p.join(F.broadcast(newest)).select("name", "kind", "stamp", action.alias("action"))


def select_archives(plan: DataFrame, since: str | None = None, incremental: bool = False) -> DataFrame:
    """What is read, in order: the baseline first unless incremental, deltas from `since` on."""
    keep = (F.col("action") == "delta") & (F.lit(True) if since is None else F.col("stamp") >= since)
    return plan.filter(keep if incremental else keep | (F.col("action") == "baseline")).orderBy(F.col("action") != "baseline", "stamp", "name")


def members(stream, limit: int) -> Iterator[tuple[str, int, bytes]]:
    """(name, size, content) of the regular .xml members; a larger one than the limit is an error."""
    with tarfile.open(fileobj=stream, mode="r|gz") as tar:
        for m in tar:
            if m.isreg() and m.name.endswith(".xml"):
                if m.size > limit:
                    raise ValueError(f"member {m.name} has {m.size} bytes, more than {limit}")
                yield m.name, m.size, tar.extractfile(m).read()


_SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("xml", pa.binary()), ("error", pa.string())])


def _unpacked(archives, limit: int, batch: int = 16 << 20):
    """Record batches of bounded bytes over the members of (name, stream) archives."""
    rows: list[tuple] = []
    held = 0
    for name, open_ in archives:
        try:
            with open_() as stream:
                for member, size, xml in members(stream, limit):
                    rows.append((name, member, size, "sha256:" + hashlib.sha256(xml).hexdigest(), xml, None))
                    held += size
                    if held > batch:
                        yield _batch(rows)
                        rows, held = [], 0
        except (tarfile.TarError, EOFError, OSError, ValueError, zlib.error) as e:
            rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def members_of(archives: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A row per XML member of archives (path, content): an archive is in memory whole."""

    def run(batches):
        yield from _unpacked(((p.as_py(), lambda c=c: io.BytesIO(c.as_buffer())) for b in batches for p, c in zip(b.column(0), b.column(1), strict=True)), limit)

    return archives.select("path", "content").mapInArrow(run, MEMBERS)


#: Stores that workers open by themselves, so that an archive is streamed and can have any size.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def read_archives(spark: SparkSession, path: str, limit: int = 64 << 20) -> DataFrame:
    """A row per XML member of the .tar.gz files under a path; a broken archive gives what can be read
    of it and one row with the error. Archives are the unit of distribution; of one, a bounded batch of
    members is held at a time. Other stores than STREAMED are read by Spark, an archive at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    if path.split(":", 1)[0] not in STREAMED and ":" in path.split("/", 1)[0]:
        return members_of(files, limit)

    def run(batches):
        from pyarrow import fs

        def opened(uri: str):
            scheme, rest = uri.split(":", 1)
            store, at = fs.FileSystem.from_uri(f"{STREAMED[scheme]}://{re.sub('^/+', '/' if scheme == 'file' else '', rest)}")
            return store.open_input_stream(at, compression=None)

        yield from _unpacked(((p.as_py(), lambda p=p: opened(p.as_py())) for b in batches for p in b.column(0)), limit)

    return files.select("path").mapInArrow(run, MEMBERS)


def verify_archives(rows: DataFrame) -> DataFrame:
    """archive, n_members, ok: the quarantine split."""
    return rows.groupBy("archive").agg(F.count("member").alias("n_members"), (F.count("error") == 0).alias("ok"))


#: An anchor's target, and what stands behind the anchor up to the next one.
ANCHOR = r"""(?is)<a\s+[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>((?:(?!<a\s).)*)"""
TAIL = r"([0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2})(?:\s+([0-9.]+[KMGT]?|-))?"


def parse_listing(html: Column) -> Column:
    """array<struct<name, date, size>> of an HTML index of files, in its order: parents, sort links,
    folders, absolute paths and URLs are left out; date and size are null where the row has none."""
    part = lambda k: F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(k))
    rows = F.arrays_zip(part(1).alias("href"), part(2).alias("rest"))

    def one(x: Column) -> Column:
        tail = F.regexp_replace(x["rest"], "<[^>]*>", " ")
        found = lambda k: F.nullif(F.regexp_extract(tail, TAIL, k), F.lit(""))
        name = F.regexp_extract(F.trim(x["href"]), "([^/]*)$", 1)
        return F.struct(F.replace(F.replace(name, F.lit("%20"), F.lit(" ")), F.lit("%2B"), F.lit("+")).alias("name"), found(1).alias("date"), F.nullif(found(2), F.lit("-")).alias("size"))

    kept = F.filter(rows, lambda x: ~F.trim(x["href"]).rlike(r"^$|^[?#/]|^\.\.|://|/$"))
    return F.filter(F.transform(kept, one), lambda x: x["name"] != "")


def source_listing(html: Column, source: str) -> Column:
    """Of a listing, the source's archives, in order of stamp and name."""
    own = F.filter(F.transform(parse_listing(html), lambda x: F.struct(parse_name(x["name"], source).alias("p"), x.alias("x"))), lambda y: y["p"].isNotNull())
    return F.transform(F.array_sort(F.transform(own, lambda y: F.struct(y["p"]["stamp"].alias("stamp"), y["x"]["name"].alias("name"), y["p"]["kind"].alias("kind"), y["x"]["date"].alias("date"), y["x"]["size"].alias("size")))), lambda z: z)


def fetch_plan(listed: DataFrame, fetched: DataFrame) -> DataFrame:
    """Names of a listing that weren't fetched yet, by the kept cursor of names."""
    return listed.select("name").distinct().join(fetched.select("name"), "name", "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def upsert(store: Store, table: str, rows: DataFrame, key: str, order: str) -> int:
    """The newest of each key's rows in `rows` stands in the store's table; its other rows stay."""
    from ..operators.relations import latest

    return store.apply({table: Delta(latest(rows, [key], [F.desc(order)]))})


def upsert_documents(store: Store, new: tuple[DataFrame, DataFrame, DataFrame]) -> int:
    """One version of documents, chunks and edges (keyed by document_id) after a batch: a document's newest
    row (by seq) stands, its chunks and edges give way to the batch's; a chunk whose body stays keeps its
    fingerprint, unless a new one came, and one whose body changed loses it. Edges of documents that
    aren't in the batch are added."""
    from ..operators.relations import latest

    rows, new_chunks, new_edges = new
    touched = rows.select("document_id").distinct()
    # texts are compared by SHA-256, so that the old ones don't move
    old = store.read("chunks").select("chunk_id", "document_id", F.sha2("body", 256).alias("_sha"), F.col("fingerprint").alias("_fp")).join(touched, "document_id", "left_semi").drop("document_id")
    fp = F.when(F.col("fingerprint").isNotNull(), F.col("fingerprint")).when(F.col("_sha").eqNullSafe(F.sha2("body", 256)), F.col("_fp"))
    fresh = new_chunks.join(old, "chunk_id", "left").select("chunk_id", "document_id", "body", fp.alias("fingerprint"))
    others = new_edges.select("document_id").distinct().join(touched, "document_id", "left_anti")
    kept = store.read("edges").join(others, "document_id", "left_semi")
    return store.apply({"documents": Delta(latest(rows, ["document_id"], [F.desc("seq")])), "chunks": Delta(fresh, touched), "edges": Delta(new_edges.unionByName(kept), touched)})


def guarded_embeddings(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows, if each has a chunk of the same fingerprint; else the query fails and names one."""
    c = chunks.select("chunk_id", F.col("embedding_fingerprint").alias("_want"))
    j = rows.join(c, "chunk_id", "left")
    bad = F.col("_want").isNull() | (F.col("_want") != F.col("embedding_fingerprint"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("missing or conflicting fingerprint for chunk "), F.col("chunk_id").cast("string"))).cast("string")).otherwise(F.col("chunk_id").cast("string"))
    return j.select(checked.cast(rows.schema["chunk_id"].dataType).alias("chunk_id"), *(c for c in rows.columns if c != "chunk_id"))


def upsert_embeddings(store: Store, table: str, rows: DataFrame, chunks: DataFrame, order: str) -> int:
    """A guarded batch: a chunk's newest vector stands; a batch that isn't in order leaves no version."""
    return upsert(store, table, guarded_embeddings(rows, chunks), "chunk_id", order)


def baseline_copy(df: DataFrame, key: str, path: str, corpus: str | None = None, generated: tuple[str, ...] = ()) -> None:
    """Exports a table, of one corpus if given, without generated columns, range-partitioned and sorted by key."""
    own = df if corpus is None else df.filter(F.col("corpus") == corpus)
    own.drop(*generated).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
