"""Centroid clustering by Hamerly's exact k-means.

Vectors become whole numbers, floor(256 x). Between rounds each vector keeps its centroid, one upper bound of the distance to it and one lower
bound of the distance to the second nearest, in a table of the shared folder. When centroids drift, the upper bound grows by its centroid's
drift and the lower one shrinks by the largest drift of the others. A vector stays without a look at other centroids where its upper bound lies
strictly below the lower one, or below half the distance from its centroid to the next; where the bounds are ambiguous, its own distance is
measured, and where they still are, all distances, in whole numbers, so that ties go to the smaller number exactly. Upper bounds are rounded up and
lower ones down.

A round is one scan of that table and one shuffle of at most one row of sums a task and centroid. The driver holds the centroids alone.

Defined results: rows with a null vector, another number of components than asked, or a null or non-finite one are dropped. Components beyond
``vectors.limit`` (2**27 for 64 dimensions, x of half a million) are held there. Starts rank by the hash of the id, a null id's last, then by
their vectors; repeated rows repeat and may start several centroids, which are then equal: the smaller number takes all. With fewer vectors than
centroids each starts one. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, tuned, written
from .vectors import above, below, binary, digest, floored, matrix, squares, summed, usable, whole

DIMS, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
_STATE = "vec_id long, x binary, cluster int, upper double, lower double"


def scanned(x: np.ndarray, centroids: np.ndarray):
    """Nearest centroid of each row, upper bound, bound of the second nearest; every distance measured."""
    d = squares(x, centroids)
    near = d.argmin(1)
    at = np.arange(len(x))
    upper = above(np.sqrt(d[at, near]))
    if len(centroids) == 1:
        return near, upper, np.full(len(x), np.inf)
    d[at, near] = np.iinfo(np.int64).max
    return near, upper, below(np.sqrt(d.min(1)))


def rescanned(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The same after the centroids drifted, with a scan of the ambiguous rows only. Also the number of rows scanned."""
    k = len(centroids)
    most = np.array([np.delete(drift, j).max() if k > 1 else 0.0 for j in range(k)])
    upper, lower = above(upper + drift[near]), below(lower - most[near])
    if k > 1:
        between = squares(centroids, centroids)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        lower = np.maximum(lower, (below(np.sqrt(between.min(1))) / 2)[near])
    else:
        lower = np.full(len(x), np.inf)
    rows = np.flatnonzero(upper >= lower)
    upper[rows] = above(np.sqrt(((x[rows] - centroids[near[rows]]) ** 2).sum(1)))
    rows = rows[upper[rows] >= lower[rows]]
    near = near.copy()
    near[rows], upper[rows], lower[rows] = scanned(x[rows], centroids)
    return near, upper, lower, len(rows)


def _assigned(centroids: np.ndarray, drift: np.ndarray | None, last: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            x = matrix(get("x"), centroids.shape[1])
            if drift is None:
                near, upper, lower = scanned(x, centroids)
            else:
                near, upper, lower, _ = rescanned(x, centroids, drift, *(get(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("cluster", np.int64), ("upper", np.float64), ("lower", np.float64))))
            cluster = pa.array(near.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([get("vec_id"), cluster, pa.array(((x - centroids[near]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([get("vec_id"), binary(x.astype(np.int32)), cluster, pa.array(upper), pa.array(lower)], ["vec_id", "x", "cluster", "upper", "lower"])

    return run


def _members(k: int, dims: int):
    """Sums of a task's vectors by centroid."""

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster = batch.column(1).to_numpy(zero_copy_only=False)
            np.add.at(sums, cluster, matrix(batch.column(0), dims))
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return run


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the usable rows of vectors (vec_id, embedding), and the centroids."""
    spark = vectors.sparkSession
    tuned(spark)
    out = "vec_id long, cluster int, distance long"
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable("embedding") & (F.size("embedding") == dims)).select("vec_id", whole("embedding", dims).alias("x"), "embedding")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = [r["x"] for r in x.orderBy(F.asc_nulls_last(key), "embedding").limit(k).select("x").collect()]  # as many rows as centroids
    if not start:
        return spark.createDataFrame([], out), np.zeros((0, dims), np.int64)
    centroids = np.array(start, np.int64)
    rows, drift = x.select("vec_id", "x"), None
    for _ in range(rounds):
        state = written(rows.mapInArrow(_assigned(centroids, drift, False), _STATE), "clusters")
        if drift is not None:
            dropped(rows)
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for r in summed(state.select("x", "cluster").mapInArrow(_members(*centroids.shape), "cluster long, n long, s array<long>"), ["cluster"], dims):
            counts[r["cluster"]], sums[r["cluster"]] = r["n"], [r[f"s{i}"] for i in range(dims)]
        now = floored(sums, counts, centroids)
        drift = above(np.sqrt(((now - centroids) ** 2).sum(1)))
        centroids, rows = now, state
    return rows.mapInArrow(_assigned(centroids, drift, True), out), centroids


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of all usable embeddings; see the module's defined results."""
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    found = written(found, "clustered")  # read twice
    per = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    facts = [(j, s, sum(per.values()), digest(centroids[j])) for j, s in sorted(per.items())]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = [
        f"x AS (SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, x AS c FROM x QUALIFY k < {CENTROIDS})",
    ]
    gap = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT vec_id, x, arg_min(k, d * {CENTROIDS} + k) AS k, min(d) AS d FROM (SELECT vec_id, x, k, {gap} AS d FROM x, c{r}) GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT k, i, sum(v) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS v, unnest(range({DIMS})) AS i FROM a{r}) GROUP BY 1, 2)")
            steps.append(f"m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS n FROM s{r} GROUP BY 1)")
            steps.append(f"c{r + 1} AS (SELECT k, coalesce(n, c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"


ORACLE = _oracle()
