"""Embedding near-duplicates: tiles in the order of principal components, with bounds on what the trailing components can add."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table
from .components import components

THRESHOLD = 0.93
#: Vectors in a tile, which travels to the tiles it meets, and in a part of it that is compared at once; components in a
#: step of the comparison and in a part's box; vectors that the axes are fitted on.
TILE = 8192
PART = 512
STEP = 8
SAMPLE = 20_000
#: What rounding may take from a rotated product; the products that decide are those of the vectors as they came.
SLACK = 1e-9


def axes(classes: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Rows of an orthogonal matrix, by falling variance of a bounded sample of unit vectors: fixed vectors' moments summed in tasks."""
    some = classes.orderBy("hash", "uid").limit(sample).select("v")

    def moments(batches):
        for b in batches:
            v = np.array(b.column("v").to_pylist(), float)
            if len(v):
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                yield {"m": [(v.T @ v).tobytes()]}

    parts = [np.frombuffer(r["m"]) for r in map_batches(some, moments, "m binary").collect()]
    if not parts:
        return np.eye(1)
    total = np.sum(parts, 0)
    d = int(round(len(total) ** 0.5))
    values, vectors = np.linalg.eigh(total.reshape(d, d))
    return vectors[:, np.argsort(-values, kind="stable")].T


def valid(v: F.Column) -> F.Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _rests(a: np.ndarray) -> np.ndarray:
    """Norms of what follows each component, from all to none."""
    return np.sqrt(np.maximum(0, np.cumsum((a * a)[:, ::-1], 1)[:, ::-1]))


def _compare(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP, rests: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose product may reach the threshold; rows and columns leave when no pair of theirs can."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    rest_a, rest_b = rests or (_rests(a), _rests(b))
    d = a.shape[1]
    sums = np.zeros((len(a), len(b)))
    for k in range(0, d, step):
        sums += a[rows, k : k + step] @ b[cols, k : k + step].T
        if k + step < d:
            may = sums + np.outer(rest_a[rows, k + step], rest_b[cols, k + step]) >= threshold - SLACK
            r, c = may.any(1), may.any(0)
            if not r.any():
                return np.empty(0, int), np.empty(0, int)
            if r.mean() < 0.8 or c.mean() < 0.8:
                sums = sums[np.ix_(r, c)]
                rows, cols = rows[r], cols[c]
    i, j = np.nonzero(sums >= threshold - SLACK)
    return rows[i], cols[j]


def _boxes(u: np.ndarray, rest: np.ndarray, part: int, step: int = STEP) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each part of a tile the least and largest of its leading components, and the largest norm of what follows them."""
    k = min(step, u.shape[1])
    after = rest[:, k] if k < u.shape[1] else np.zeros(len(u))
    return [(u[x : x + part, :k].min(0), u[x : x + part, :k].max(0), float(after[x : x + part].max())) for x in range(0, len(u), part)]


def _may_meet(x: tuple, y: tuple, threshold: float) -> bool:
    """Whether some product between two boxes may reach the threshold."""
    best = np.max([x[0] * y[0], x[0] * y[1], x[1] * y[0], x[1] * y[1]], 0).sum()
    return best + x[2] * y[2] >= threshold - SLACK


def _links(u: np.ndarray, v: np.ndarray, u_b: np.ndarray, v_b: np.ndarray, threshold: float, same: bool, part: int = PART):
    """Index pairs of two tiles (of one, each pair once, if same) whose vectors link; u are rotated unit vectors, v those as they came."""
    rest, rest_b = _rests(u), _rests(u_b)
    boxes, boxes_b = _boxes(u, rest, part), _boxes(u_b, rest_b, part)
    length, length_b = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", v_b, v_b))
    for x, box in enumerate(boxes):
        for y in range(x if same else 0, len(boxes_b)):
            if not _may_meet(box, boxes_b[y], threshold):
                continue
            a, b = slice(x * part, (x + 1) * part), slice(y * part, (y + 1) * part)
            i, j = _compare(u[a], u_b[b], threshold, rests=(rest[a], rest_b[b]))
            i, j = i + x * part, j + y * part
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 50_000):
                p, q = i[k : k + 50_000], j[k : k + 50_000]
                true = np.einsum("ij,ij->i", v[p], v_b[q]) / (length[p] * length_b[q]) >= threshold
                if true.any():
                    yield p[true], q[true]


def _spanning(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of the links in a tile pair, those that hold its components together: at most one for each vector."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept; a row for each input row.

    Only vectors of equal, non-null labels and equal lengths are compared. Vectors that are null, empty, zero, or have null
    or non-finite components, and those without a label, link with nothing. Equal vectors are one class, compared once;
    each counts the others of its class among its links. Rows that repeat an id, or have none, are vectors of their own;
    component_id is the smallest id in a component, and null only if none of its rows has one.

    Classes are dealt by range of (label, first component, ...), so neither a large label nor a common vector fills a
    task, and cut into tiles. Two tiles meet, each shipped once as the vectors came, only if their ranges on the first
    component allow the threshold; inside, parts of them by their boxes on the leading components. A tile's own pairs
    need no shuffle. Data without leading components has all tiles of a label meet: the work is then that of all pairs of
    blocks, and the shuffle the square of a label's rows over TILE.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", valid(F.col("v")) & F.col("label").isNotNull())
    # -0.0 and 0.0 are equal components
    rows = table(rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + 0.0))), "vectors")
    good = rows.where("ok")
    classes = table(good.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n")).withColumn("hash", F.xxhash64("v")), "classes")
    # a class is known by its place in the written table, as ids may repeat
    classes = table(classes.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    # the axes are a rotation, so any orthogonal matrix is right; vectors of another length keep their own order of components
    basis = classes.sparkSession.sparkContext.broadcast(axes(classes.where(F.size("v") == (classes.agg(F.max(F.size("v"))).head()[0] or 1))))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def rotated(v: np.ndarray) -> np.ndarray:
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        return u @ basis.value.T if u.shape[1] == basis.value.shape[1] else u

    def lead(batches):
        for b in batches:
            vs = [np.array(x) for x in b.column("v").to_pylist()]
            yield {"label": b.column("label"), "uid": b.column("uid"), "n": b.column("n"), "dims": [len(v) for v in vs], "lead": [float(rotated(v[None])[0, 0]) for v in vs], "v": [v.tobytes() for v in vs]}

    ordered = map_batches(classes.select("label", "uid", "n", "v"), lead, "label string, uid long, n long, dims int, lead double, v binary")
    ranged = ordered.repartitionByRange("label", "dims", "lead", "uid").sortWithinPartitions("label", "dims", "lead", "uid")

    def tiles(batches):
        key, held = None, []

        def close():
            return {"tile": [held[0][1]], "label": [key[0]], "dims": [key[1]], "low": [held[0][3]], "high": [held[-1][3]], "ids": [[h[1] for h in held]], "n": [[h[2] for h in held]], "v": [b"".join(h[4] for h in held)]}

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("label", "uid", "n", "lead", "v", "dims")), strict=True):
                if key != (row[0], row[5]) or len(held) >= tile:
                    if held:
                        yield close()
                    key, held = (row[0], row[5]), []
                held.append(row)
        if held:
            yield close()

    cut = table(map_batches(ranged, tiles, "tile long, label string, dims int, low double, high double, ids array<long>, n array<long>, v binary"), "tiles")
    # bands as wide as the reach: a pair of tiles that can link shares a band, or has neighbouring ones
    heads = cut.select("tile", "label", "dims", "low", "high")
    band = lambda x: F.floor(x / reach).cast("int")
    left = heads.withColumn("band", F.explode(F.sequence(band(F.col("low") - reach), band(F.col("high") + reach))))
    right = heads.select(F.col("tile").alias("tile_b"), "label", "dims", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(band(F.col("low")), band(F.col("high")))).alias("band"))
    met = left.join(right, ["label", "dims", "band"]).where("tile < tile_b").where((F.col("low_b") - F.col("high") <= reach) & (F.col("low") - F.col("high_b") <= reach)).select("tile", "tile_b").distinct()
    a = cut.select("tile", "dims", "ids", "n", "v")
    b = cut.select(*[F.col(c).alias(f"{c}_b") for c in ("tile", "ids", "n", "v")])

    def links(batches):
        for batch in batches:
            for x in range(batch.num_rows):  # a row is two whole tiles
                r = batch.slice(x, 1).to_pylist()[0]
                same = "v_b" not in r
                ids, na, v = np.array(r["ids"]), np.array(r["n"]), np.frombuffer(r["v"]).reshape(-1, r["dims"])
                ids_b, nb, v_b = (ids, na, v) if same else (np.array(r["ids_b"]), np.array(r["n_b"]), np.frombuffer(r["v_b"]).reshape(-1, r["dims"]))
                u = rotated(v)
                mine, other, pairs = np.zeros(len(ids), np.int64), np.zeros(len(ids_b), np.int64), []
                for i, j in _links(u, v, u if same else rotated(v_b), v_b, threshold, same):
                    np.add.at(mine, i, nb[j])
                    np.add.at(other, j, na[i])
                    pairs = _spanning(np.append([p[0] for p in pairs], ids[i]).astype(np.int64), np.append([p[1] for p in pairs], ids_b[j]).astype(np.int64))
                count = [*zip(ids[mine > 0].tolist(), mine[mine > 0].tolist(), strict=True), *zip(ids_b[other > 0].tolist(), other[other > 0].tolist(), strict=True)]
                if count:
                    yield {"uid": [*[c[0] for c in count], *[p[0] for p in pairs]], "links": [*[c[1] for c in count], *[0] * len(pairs)], "other": [*[None] * len(count), *[p[1] for p in pairs]]}

    schema = "uid long, links long, other long"
    compared = met.join(a, "tile").join(b, "tile_b").repartition(F.xxhash64("tile", "tile_b"))
    within = a.repartition(F.xxhash64("tile"))  # a tile is much work and few bytes
    found = table(map_batches(compared, links, schema).unionByName(map_batches(within, links, schema)), "links")
    linked = found.where("other IS NULL").groupBy("uid").agg(F.sum("links").alias("links"))
    comp = components(found.where("other IS NOT NULL").select(F.col("uid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "uid")
    placed = classes.join(comp, "uid", "left").select("uid", "label", "v", "n", "vec_id", F.coalesce("component", "uid").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_class = placed.join(smallest, "component").join(linked, "uid", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    of_good = good.select("vec_id", "label", "v").join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    of_rest = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_good.unionByName(of_rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {THRESHOLD}),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
