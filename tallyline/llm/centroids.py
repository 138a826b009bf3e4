"""Centroid clustering on whole numbers: every vector keeps its exact dot products with all centroids, which a round moves only by the components that changed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, remove, written

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
#: Components this large have squared distances beyond a long.
LARGEST = float(1 << 27)

STATE = "vec_id long, v array<int>, vv long, dots array<long>, cluster int, distance long"


def quantised(vectors: DataFrame, id_col: str, x: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of vectors with exactly `dimensions` components, none null, non-finite or, scaled, beyond LARGEST."""
    scaled = F.transform(vectors[x], lambda c: F.floor(c.cast("double") * scale))
    usable = F.forall(vectors[x], lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < LARGEST))  # NaN is above every number
    return vectors.where(vectors[x].isNotNull() & (F.size(vectors[x]) == dimensions) & usable).select(vectors[id_col].cast("long").alias("vec_id"), scaled.cast("array<int>").alias("v"))


def seeds(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:vec_id`, in the order of the hashes; rows without an id are none."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.where("vec_id IS NOT NULL").select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def rows_of(column: pa.ListArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(vv: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) from |v|^2 - 2 v.c + |c|^2; of equal distances the smaller number."""
    d = vv[:, None] - 2 * dots + (centroids * centroids).sum(1)[None]
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel(), kind))


def started(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """STATE of every vector: the whole products with the first centroids."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = rows_of(batch.column("v"))
                vv, dots = (v * v).sum(1), v @ centroids.T
                cluster, distance = nearest(vv, dots, centroids)
                yield {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "vv": vv, "dots": _lists(dots, pa.int64()), "cluster": cluster, "distance": distance}

    return map_batches(kept, run, STATE)


def moved(state: DataFrame, before: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """STATE for new centroids: each product moves by the vector's components times what changed in the centroid, where anything did."""
    change = centroids - before
    parts = [(k, np.flatnonzero(c), c[c != 0]) for k, c in enumerate(change) if c.any()]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v, vv, dots = rows_of(batch.column("v")), batch.column("vv").to_numpy(), rows_of(batch.column("dots"))
                for k, at, by in parts:
                    dots[:, k] += v[:, at] @ by
                cluster, distance = nearest(vv, dots, centroids)
                yield {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "vv": vv, "dots": _lists(dots, pa.int64()), "cluster": cluster, "distance": distance}

    return map_batches(state, run, STATE)


def recentred(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the exact floor of its vectors' componentwise mean; one without vectors stays. A task leaves one sum for each cluster."""

    def run(batches):
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            v, cluster = rows_of(batch.column("v")) if batch.num_rows else np.zeros((0, centroids.shape[1]), np.int64), batch.column("cluster").to_numpy()
            for k in np.unique(cluster):
                n[k] += (cluster == k).sum()
                total[k] += v[cluster == k].sum(0)
        if n.any():
            yield {"cluster": np.flatnonzero(n), "n": n[n > 0], "total": _lists(total[n > 0], pa.int64())}

    sums = map_batches(state.select("v", "cluster"), run, "cluster int, n long, total array<long>")
    cell = sums.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    after = centroids.copy()
    for r in cell.collect():  # clusters times components
        after[r["cluster"], r["i"]] = r["x"] // r["n"]
    return after


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", x: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that is kept.

    Components become floor(scale * x). The first centroids are the vectors whose hashes are smallest; each round assigns
    every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each centroid
    to the floor of its vectors' mean; then all are assigned once more. Everything is exact in whole numbers, so it doesn't
    depend on how rows are dealt. Vectors with another number of components, or a null, non-finite or (scaled) larger one than
    LARGEST, are not kept. Rows of one id are vectors of their own; those without an id are assigned, but never first
    centroids. With fewer kept vectors than clusters there are as many centroids as vectors. A round's state is a table in the shared folder, its predecessor is deleted.
    """
    spark: SparkSession = vectors.sparkSession
    kept = quantised(vectors, id_col, x, dimensions, scale)
    centroids = seeds(kept, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, path = written(started(kept, centroids), "products")
    for _ in range(rounds):
        after = recentred(state, centroids)
        (state, new), old = written(moved(state, centroids, after), "products"), path
        remove(spark, old)
        centroids, path = after, new
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row for each cluster
    total = sum(r["cluster_inertia"] for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, digest[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in SQL: a row for each (vector, component) would be slow, so vectors are lists, and centroids a table (cluster, list) for each round."""
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS cluster, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    assign = "SELECT vec_id, v, min(struct_pack(d := d, k := cluster)) AS best FROM (SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{}) GROUP BY vec_id, v"
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS ({assign.format(r)})")
        if r < ROUNDS:
            # floor of a quotient of whole numbers, also below zero
            parts.append(
                f"s{r} AS (SELECT cluster, list(((x - ((x % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (SELECT best.k AS cluster, i, sum(v[i])::BIGINT AS x, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY cluster)"
            )
            parts.append(f"c{r + 1} AS (SELECT cluster, coalesce(s.c, o.c) AS c FROM c{r} o LEFT JOIN s{r} s USING (cluster))")
    last = f"SELECT vec_id, best.k AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON cluster = best.k"
    return "WITH " + ",\n".join(parts) + "\n" + last


OP12_SQL = _sql()
