"""What the operators of this subpackage share: sessions, scratch space, splits, bounded samples.

Conventions that hold for every operator unless its docstring says otherwise:

* the input is a table with ``doc_id`` and ``text``; every other column is ignored, so extra
  columns with clashing names cannot interfere (inputs are narrowed by ``narrow`` first);
* a null text counts as the empty text; an empty table gives an empty result with the same schema;
* a row with a null ``doc_id`` is kept where the operator works row by row;
* repeated rows give repeated rows where the operator works row by row.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small_batches  # noqa: F401  (operators take it from here)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space of the word contracts, and its complement.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id as bigint and the text with null as empty; nothing else."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable holds it, so that Catalyst
    cannot inline the expression into every element of a nested higher-order function."""
    return F.transform(F.array(value), body)[0]


def settled(value: Column) -> Column:
    """The value, for a column that later steps use within higher-order functions: a condition that
    always holds, but that Catalyst takes for changing, keeps it from inlining the expression there."""
    return F.when(F.spark_partition_id() >= 0, value)


def held_out(modulus: int, remainder: int) -> Column:
    """True for rows whose crc32 of the decimal doc_id has the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(modulus) == remainder, F.lit(False))


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share. spark.checkpoint.dir names it; only where that is unset
    (tests, one machine) is a temporary folder made and set; elsewhere that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexforge-")
        sc.setCheckpointDir(f"file://{base}")
        base = f"file://{base}"
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small table by a reliable checkpoint."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: columnar, compressed, with known
    sizes, and safe from lost executors. The folder goes when the driver ends, or by drop_written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lexforge-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    if not _written:
        atexit.register(drop_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    return len(_written)


def drop_written(since: int = 0, last: bool = True) -> None:
    """Deletes the tables written after the first `since`; the last one only if said so."""
    gone = _written[since:] if last else _written[since:-1]
    _written[since:] = [] if last else _written[since:][-1:]
    for spark, path in gone:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


def split_words(texts: pa.Array, unicode: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, cut at ASCII (or all) white space; the place in them of each word, in
    order; where each text's words begin, and the end. A text may begin and end with an empty word."""
    lists = (pc.utf8_split_whitespace if unicode else pc.ascii_split_whitespace)(texts)
    words = lists.flatten().dictionary_encode()
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(), out=offsets[1:])
    return words.dictionary, words.indices.to_numpy(), offsets


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def bounded_sample(rows: DataFrame, key: str, bound: int, salt: int, total: int | None = None) -> DataFrame:
    """At most about `bound` rows (its square root more, at most, in all but freak cases), chosen by
    a hash of the key: the same rows whatever the partitions are."""
    n = rows.count() if total is None else total
    if n <= bound:
        return rows
    share = int(bound / n * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) < share)


def in_chunks(batches: Iterable, chars: int):
    """Splits record batches of (…, text binary last column) into slices of bounded bytes."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        n, at = batch.num_rows, 0
        if not n:
            continue
        lengths = [0 if not v.is_valid else len(v.as_buffer()) for v in text] if text.nbytes > chars else None
        if lengths is None:
            yield batch
            continue
        size = 0
        for i, x in enumerate(lengths):
            if size and size + x > chars:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += x
        yield batch.slice(at, n - at)
