"""Cells of vectors: an inverted file of nearest centroids, built and searched as Spark jobs.

Centroids come in two levels, trained on a sample of a bounded number of vectors chosen by hash: coarse ones by
k-means, and in each coarse cell, in a task of its own, the fine ones that its share of the sample asks
for. Every vector is then assigned to its `COPIES` nearest cells among those of its `WIDE` nearest coarse
ones, so that a neighbour across a border is still met by few probes. Rows are written as ranges
of (cell, id), so a cell of very many vectors is dealt over files, and a search reads its cells' row groups.
What a search filters by stands beside the vector.

How many cells to probe is measured at the build: for some vectors of the table, the exact nearest ones are
found by one scan, and the curve of recall over the number of probes is kept; the default is the rule of the
square root, or more where the curve asks for it (`RECALL`). The manifest comes last, so a broken build has none;
centroids are a table, not part of it.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import storage
from .retrieval import distance, ivfflat_probes, numbered

#: Vectors to train on, for each list and at most; lists at most; rounds of Lloyd's algorithm.
PER_LIST, SAMPLE, LISTS, ROUNDS = 256, 250_000, 65_536, 10
WIDE, COPIES, FILE_ROWS = 3, 2, 500_000
#: Vectors that are asked for at the build, their neighbours, and the recall that the default must reach.
ASKED, NEIGHBOURS, RECALL = 100, 10, 0.95


def lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of x (fewer if x has fewer distinct rows), by k-means++ and Lloyd's rounds."""
    r = np.random.default_rng(seed)
    c = [x[r.integers(len(x))]]
    near = ((x - c[0]) ** 2).sum(1)
    while len(c) < k and near.max() > 1e-12:
        c.append(x[r.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(ROUNDS):
        own = squared(x, c).argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def train(sample: DataFrame, lists: int, seed: int) -> pd.DataFrame:
    """cell, coarse, coarse_centroid, centroid: at most about `lists` rows. sample: embedding, bounded."""
    k = max(1, round(lists**0.5))
    some = np.stack(sample.select("embedding").limit(PER_LIST * k).toPandas()["embedding"].to_numpy()).astype(np.float64)
    coarse = lloyd(some, k, seed)
    n, shared = sample.count(), sample.sparkSession.sparkContext.broadcast(coarse)

    def fine(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        at = int(pdf["coarse"].iloc[0])
        c = lloyd(x, max(1, round(lists * len(x) / n)), seed)
        return pd.DataFrame({"coarse": at, "coarse_centroid": [shared.value[at].tolist()] * len(c), "centroid": c.tolist()})

    def own(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                yield pa.record_batch([b.column(0), pa.array(squared(x, shared.value).argmin(1).astype(np.int32))], ["embedding", "coarse"])

    dealt = sample.select(F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(own, "embedding array<double>, coarse int")
    found = dealt.groupBy("coarse").applyInPandas(fine, "coarse int, coarse_centroid array<double>, centroid array<double>").toPandas()  # LISTS rows at most, or one a coarse cell more
    found = found.sort_values(["coarse", "centroid"], key=lambda c: c.map(str) if c.name == "centroid" else c).reset_index(drop=True)
    found["cell"] = np.arange(len(found), dtype=np.int32)
    return found


def nearest(model: dict[str, np.ndarray], x: np.ndarray, copies: int) -> np.ndarray:
    """The nearest cells of each row, among those of its nearest coarse ones; -1 where there are fewer."""
    coarse = squared(x, model["coarse"])
    wide = min(WIDE, coarse.shape[1])
    chosen = np.argpartition(coarse, wide - 1, axis=1)[:, :wide]
    far, out = np.full((len(x), copies), np.inf), np.full((len(x), copies), -1)
    for c in np.unique(chosen):
        rows = np.flatnonzero((chosen == c).any(1))
        cells = np.flatnonzero(model["of"] == c)
        d = np.concatenate([far[rows], squared(x[rows], model["fine"][cells])], 1)
        ids = np.concatenate([out[rows], np.broadcast_to(cells, (len(rows), len(cells)))], 1)
        order = np.argsort(d, axis=1, kind="stable")[:, :copies]
        far[rows], out[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
    return out


def build(vectors: DataFrame, expected: DataFrame, path: str, lists: int, fingerprint: str, seed: int = 1) -> dict:
    """Stores vectors (document_id, embedding, ...) by their cells. expected(document_id): what must have a
    vector; a missing one fails the build."""
    spark = vectors.sparkSession
    missing = expected.select("document_id").join(vectors, "document_id", "left_anti").count()
    if missing:
        raise ValueError(f"dense_rebuild: {missing} embeddings are missing")
    n, lists = vectors.count(), min(lists, LISTS)
    by_hash = F.pmod(F.xxhash64(F.lit(seed), "document_id"), F.lit(1 << 30))
    want = min(SAMPLE, PER_LIST * lists)
    sample = vectors if n <= want else vectors.filter(by_hash < int(want / n * (1 << 30)))
    found = train(sample, lists, seed)
    spark.createDataFrame(found).select("cell", "coarse", "coarse_centroid", "centroid").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    firsts = found.groupby("coarse", sort=True)["coarse_centroid"].first()
    shared = spark.sparkContext.broadcast({"coarse": np.stack(firsts.to_numpy()), "of": np.searchsorted(firsts.index.to_numpy(), found["coarse"].to_numpy()), "fine": np.stack(found["centroid"].to_numpy())})
    at = vectors.columns.index("embedding")

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cells = nearest(shared.value, np.stack(b.column(at).to_numpy(zero_copy_only=False)).astype(np.float64), COPIES)
            row, copy = np.nonzero(cells >= 0)
            take = pa.array(row)
            yield pa.record_batch([*(c.take(take) for c in b.columns), pa.array(cells[row, copy].astype(np.int32)), pa.array(copy.astype(np.int32))], [*b.schema.names, "cell", "copy"])

    schema = StructType([*vectors.schema.fields, StructField("cell", IntegerType()), StructField("copy", IntegerType())])
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * COPIES // FILE_ROWS))
    rows = vectors.mapInArrow(assign, schema)
    rows.repartitionByRange(files, "cell", "document_id").sortWithinPartitions("cell", "document_id").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/cells")
    curve = recall_curve(spark, path, vectors, by_hash, n)
    enough = next((p for p, r in curve if r >= RECALL), len(found))
    manifest = {"lists": len(found), "probes": max(min(len(found), ivfflat_probes(len(found))), enough), "curve": curve, "fingerprint": fingerprint, "dimension": len(found["centroid"].iloc[0]), "rows": n}
    storage.swap_text(spark, f"{path}/MANIFEST.json", json.dumps(manifest))
    return manifest


def recall_curve(spark: SparkSession, path: str, vectors: DataFrame, by_hash: Column, n: int) -> list[tuple[int, float]]:
    """(probes, recall of NEIGHBOURS exact neighbours) for some vectors of the table."""
    asked = vectors.filter(by_hash < int(min(1.0, ASKED / max(n, 1)) * (1 << 30))).select("embedding").limit(2 * ASKED).toPandas()
    if not len(asked):
        return []
    q = spark.sparkContext.broadcast(np.stack(asked["embedding"].to_numpy()).astype(np.float64))

    def closest(batches):
        """Of a task's rows, the nearest to each query with their cells."""
        best: list[pd.DataFrame] = []
        for b in batches:
            if b.num_rows:
                d = squared(q.value, np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                k = min(NEIGHBOURS, d.shape[1])
                at = np.argpartition(d, k - 1, axis=1)[:, :k]
                best.append(pd.DataFrame({"q": np.repeat(np.arange(len(d)), k), "d": np.take_along_axis(d, at, 1).ravel(), "id": np.array(list(map(str, b.column(0).to_pylist())))[at.ravel()]}))
                best = [pd.concat(best).sort_values(["q", "d"]).groupby("q").head(NEIGHBOURS)]
        for out in best:
            yield pa.record_batch([pa.array(out["q"].to_numpy(np.int64)), pa.array(out["d"].to_numpy(np.float64)), pa.array(out["id"].tolist(), pa.string())], ["q", "d", "id"])

    near = vectors.select("document_id", "embedding").mapInArrow(closest, "q long, d double, id string").toPandas()  # ASKED * NEIGHBOURS rows a task
    near = near.sort_values(["q", "d"]).groupby("q").head(NEIGHBOURS)
    held = spark.read.parquet(f"{path}/cells").select(F.col("document_id").cast("string").alias("id"), "cell").filter(F.col("id").isin(near["id"].unique().tolist())).toPandas()
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    order = np.argsort(np.argsort(squared(q.value, np.stack(centroids["centroid"].to_numpy())), axis=1), axis=1)
    cells = held.groupby("id")["cell"].apply(list)
    needs = np.array([order[int(k), cells[i]].min() + 1 for k, i in zip(near["q"], near["id"], strict=True)])
    return [(p, round(float((needs <= p).mean()), 4)) for p in sorted({1, 2, 3, 4, *(int(1.3**k) for k in range(5, 43)), len(centroids)}) if p <= len(centroids)]


def manifest(spark: SparkSession, path: str) -> dict | None:
    text = storage.read_text(spark, f"{path}/MANIFEST.json")
    return None if text is None else json.loads(text)


def near_rows(spark: SparkSession, path: str, query: list[float], probes: int | None = None, fingerprint: str | None = None) -> DataFrame:
    """The rows of the cells nearest to the query; probes: of the request, else of the manifest."""
    m = manifest(spark, path)
    if m is None or (fingerprint is not None and m["fingerprint"] != fingerprint):
        raise ValueError("fingerprint_mismatch: no cells of this fingerprint are stored")
    by = spark.read.parquet(f"{path}/centroids").select("cell", distance(F.col("centroid"), query).alias("d")).orderBy("d", "cell").limit(min(m["lists"], probes or m["probes"]))
    return spark.read.parquet(f"{path}/cells").filter(F.col("cell").isin([r.cell for r in by.collect()]))


def search(spark: SparkSession, path: str, query: list[float], limit: int, probes: int | None = None, fingerprint: str | None = None, keep: Column | None = None, pool: int = 1) -> DataFrame:
    """document_id, distance, rank and the columns beside the vector, as by the exact scan over the probed cells:
    a pool of pool * limit nearest, filtered after; with pool 0 filtered before, and more cells are
    probed until `limit` pass or all were."""
    m = manifest(spark, path)
    at = probes or (m and m["probes"]) or 1
    order = [F.asc("distance"), F.asc("document_id")]
    while True:
        rows = near_rows(spark, path, query, at, fingerprint)
        if not pool and keep is not None:
            rows = rows.filter(keep)
        near = rows.withColumn("distance", distance(F.col("embedding"), query)).drop("embedding", "cell", "copy")
        near = near.orderBy(*order).limit(COPIES * max(1, pool) * limit).dropDuplicates(["document_id"]).orderBy(*order).limit(max(1, pool) * limit)
        if pool and keep is not None:
            near = near.filter(keep)
        if pool or keep is None or at >= m["lists"] or near.count() >= limit:
            return numbered(near.orderBy(*order).limit(limit), order)
        at *= 2
