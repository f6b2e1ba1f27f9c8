"""Exact k-means over integer vectors, with bounds that spare most distances.

Vectors of exactly ``dim`` finite components are kept and turned into integers floor(scale * x).
Centroids start as the ``k`` kept vectors with the smallest SHA-256 of ``seed:id``. A round assigns
every vector to its nearest centroid, ties to the smaller number, and replaces each centroid that
has vectors by the componentwise floor of their mean. All of that is integer arithmetic.

A vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of
the distance to every other one. When centroids move, the lower bound is not loosened by the full
drift. The vectors of a cluster lie in a sphere around the centroid they were measured from, whose
radius is their largest upper bound. In the plane through the sphere's centre c and a centroid that
moved from p to q, with m the middle of p and q: for any x

    |x - p| - |x - q| <= |q - p| * cos(angle between x - m and q - p)   where that is positive,

because |x - p| + |x - q| >= 2 |x - m|. Over the sphere the angle is at least that of c - m less the
angle asin(radius / |c - m|) that the sphere fills, so the largest such cosine, over all other
centroids, times their drift is all that the bound can lose. A vector whose upper bound stays under
its lower bound, or under half the way from its centroid to the next, keeps its cluster; all others
are ambiguous and scanned exactly. Bounds are doubles widened by a share far above their rounding.

Each round writes its state to the shared folder, reads it back and removes the one before. Sums are
kept by change: only vectors that moved are added and taken off, summed in each batch before the
shuffle. The driver holds k centroids. Equal vectors need no treatment: no step groups by content.

Vectors with null, missing or non-finite components are left out. Null ids, repeated ids and rows
come back one row each; as starting vectors null ids come last and equal ids are ordered by their
vectors. Fewer than k vectors make fewer centroids; an empty table gives no rows. Columns other than
the two named are not read. Components beyond 2**27 in size end the run with an error, since the
squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import drop_folder, work_folder

#: Bounds are widened by this share each time they are made or moved.
WIDER = 1e-12
LARGEST = 1 << 27
#: Rows whose distances are made at a time.
SCANNED = 4096


@dataclass(frozen=True)
class Bounds:
    """What moving centroids does to the bounds of each cluster's vectors."""

    drift: np.ndarray
    loosening: np.ndarray
    #: Half the distance from each centroid to the nearest other one.
    half_gap: np.ndarray


def planar_loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per cluster: the most that a lower bound of vectors in its sphere, ``radius`` around its
    centroid of ``before``, can lose as the other centroids move to ``after``."""
    drift = np.sqrt(((after - before) ** 2).sum(1))
    middle = (before + after) / 2
    out = np.zeros(len(before))
    for i, centre in enumerate(before):
        to_centre = centre - middle
        far = np.sqrt((to_centre**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            along = (to_centre * (after - before)).sum(1) / (far * drift)
            angle = np.arccos(np.clip(along, -1, 1)) - np.arcsin(np.clip(radius[i] / far, -1, 1))
        lost = drift * np.clip(np.cos(np.maximum(angle, 0)) + 1e-7, 0, 1)
        lost = np.where(far <= radius[i] * (1 + WIDER), drift, lost)
        lost = np.where(drift == 0, 0.0, lost)
        out[i] = np.delete(lost, i).max(initial=0.0)
    return out


def bounds(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> Bounds:
    old, new = before.astype(float), after.astype(float)
    apart = np.sqrt(((new[:, None] - new[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    drift = np.sqrt(((new - old) ** 2).sum(1))
    return Bounds(drift, planar_loosening(old, new, radius), apart.min(1, initial=np.inf) / 2 * (1 - WIDER))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all centroids, exact."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for begin in range(0, len(x), SCANNED):
        part = x[begin : begin + SCANNED].astype(np.int64)
        for j, centroid in enumerate(centroids):
            step = part - centroid
            out[begin : begin + SCANNED, j] = np.einsum("nd,nd->n", step, step)
    return out


def settle(
    x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: Bounds
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, upper and lower bound of every vector, and how many were scanned."""
    upper = (upper + moved.drift[cluster]) * (1 + WIDER)
    lower = (lower - moved.loosening[cluster]) * (1 - WIDER)
    lower = np.where(lower < 0, -np.inf, lower)
    enough = np.maximum(lower, moved.half_gap[cluster])
    rest = np.flatnonzero(~(upper < enough))
    step = x[rest].astype(np.int64) - centroids[cluster[rest]]
    upper[rest] = np.sqrt(np.einsum("nd,nd->n", step, step)) * (1 + WIDER)
    rest = rest[~(upper[rest] < enough[rest])]
    if len(rest):
        found = distances(x[rest], centroids)
        cluster = cluster.copy()
        cluster[rest] = found.argmin(1)
        upper[rest] = np.sqrt(found[np.arange(len(rest)), cluster[rest]]) * (1 + WIDER)
        found[np.arange(len(rest)), cluster[rest]] = np.iinfo(np.int64).max
        lower[rest] = np.sqrt(found.min(1)) * (1 - WIDER) if len(centroids) > 1 else np.inf
    return cluster, upper, lower, len(rest)


def integers(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, parts) of the rows whose vector is whole and finite."""
    given = df.select(df[id_col].alias("vec_id"), df[vec_col].cast("array<double>").alias("given"))
    fine = F.forall("given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform("given", lambda x: F.floor(F.lit(float(scale)) * x))
    return given.where((F.size("given") == dim) & fine).select("vec_id", parts.alias("parts"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digests: k rows on the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "parts").orderBy(F.col("digest").asc_nulls_last(), "parts").limit(k)
    return np.array([r["parts"] for r in rows.collect()], np.int64)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["vector"].to_pylist()), "<i4").reshape(batch.num_rows, dim)


def _packed(vectors: DataFrame, state: T.StructType) -> DataFrame:
    """The state before the first round: nothing is bounded, nothing has a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts = np.asarray(batch["parts"].flatten(), np.int64).reshape(n, -1)
            if abs(parts).max(initial=0) > LARGEST:
                raise ValueError("a component is too large for exact squared distances in a long")
            rows = [x.tobytes() for x in parts.astype("<i4")]
            none = pa.array(np.full(n, -1, np.int32))
            ends = pa.array(np.full(n, np.inf)), pa.array(np.full(n, -np.inf))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(rows, pa.binary()), none, none, *ends], names=state.names
            )

    return vectors.mapInArrow(run, state)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: Bounds) -> DataFrame:
    names, dim = state.schema.names, centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was = batch["cluster"].to_numpy()
            upper, lower = (batch[c].to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower"))
            x = _matrix(batch, dim)
            cluster, upper, lower, _ = settle(x, np.maximum(was, 0), upper, lower, centroids, moved)
            made = [pa.array(cluster.astype(np.int32)), batch["cluster"], pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], *made], names=names)

    return state.mapInArrow(run, state.schema)


def _changes(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, place, total) of the vectors that moved; place -1 holds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.concatenate([np.ones((batch.num_rows, 1), np.int64), _matrix(batch, dim)], 1)
            for column, sign in (("cluster", 1), ("came_from", -1)):
                at = batch[column].to_numpy()
                for c in np.unique(at[at >= 0]).tolist():
                    totals[c] = totals.get(c, 0) + sign * x[at == c].sum(0)
        for c, sums in totals.items():
            made = [np.full(dim + 1, c, np.int32), np.arange(-1, dim, dtype=np.int32), sums]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["cluster", "place", "total"])

    moved = state.where("cluster <> came_from").select("vector", "cluster", "came_from")
    return moved.mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))


def centroids_of(df: DataFrame, k: int, rounds: int, seed: int, dim: int, scale: int, id_col: str, vec_col: str) -> tuple[DataFrame | None, np.ndarray]:
    """The state after the last assignment, stored, and the centroids it was made with."""
    spark = df.sparkSession
    vectors = integers(df, id_col, vec_col, dim, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return None, centroids
    k, dim = centroids.shape
    fields = [("vector", T.BinaryType()), ("cluster", T.IntegerType()), ("came_from", T.IntegerType())]
    fields += [("upper", T.DoubleType()), ("lower", T.DoubleType())]
    schema = T.StructType([vectors.schema["vec_id"], *[T.StructField(n, t) for n, t in fields]])
    sums = np.zeros((k, dim + 1), dtype=object)
    moved = Bounds(np.zeros(k), np.zeros(k), np.full(k, -np.inf))
    state, path = _packed(vectors, schema), None
    for turn in range(rounds + 1):
        new_path = work_folder(spark, "clusters")
        _assigned(state, centroids, moved).write.parquet(new_path)
        state = spark.read.schema(schema).parquet(new_path)
        if path:
            drop_folder(spark, path)
        path = new_path
        if turn == rounds:
            break
        for c, place, total in _changes(state, dim).collect():
            sums[c, place + 1] += total
        after = centroids.copy()
        for c in range(k):
            if sums[c, 0]:
                after[c] = [s // sums[c, 0] for s in sums[c, 1:]]
        radius = np.zeros(k)
        for c, most in state.groupBy("cluster").agg(F.max("upper")).collect():
            radius[c] = most
        moved = bounds(centroids, after, radius)
        if (after == centroids).all():
            break
        centroids = after
    return state, centroids


def _by_cluster(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)


def clusters(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 0,
    dim: int = 64,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    state, centroids = centroids_of(df, k, rounds, seed, dim, scale, id_col, vec_col)
    if state is None:
        kind = df.schema[id_col].dataType.simpleString()
        schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], schema)
    schema = T.StructType([state.schema["vec_id"], state.schema["cluster"], T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = _matrix(batch, centroids.shape[1]) - centroids[batch["cluster"].to_numpy()]
            made = pa.array(np.einsum("nd,nd->n", step, step))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], made], names=schema.names)

    measured = state.select("vec_id", "vector", "cluster").mapInArrow(run, schema)
    inertia = [0] * len(centroids)
    for c, total in measured.groupBy("cluster").agg(F.sum("distance")).collect():
        inertia[c] = total
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return measured.select(
        "vec_id",
        "cluster",
        "distance",
        _by_cluster(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        _by_cluster(digests).alias("centroid_sha256"),
    )


def oracle(k: int, rounds: int, seed: int, dim: int, scale: int) -> str:
    """The same in DuckDB over ``embeddings``, one pair of tables a round; exact below 2**53."""
    steps = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS z FROM embeddings
            WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim}),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), z) - 1 AS c, z FROM v
            QUALIFY c < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
            SELECT row, any_value(vec_id) AS vec_id, any_value(v.z) AS z, min({{'d': (list_inner_product(v.z, v.z)
                - 2 * list_inner_product(v.z, c{i}.z) + list_inner_product(c{i}.z, c{i}.z))::BIGINT, 'c': c}}) AS best
            FROM v, c{i} GROUP BY row)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (
            SELECT c, place, sum(x)::BIGINT AS s, count(*) AS n
            FROM (SELECT best.c AS c, unnest(z)::BIGINT AS x, unnest(range({dim})) AS place FROM a{i}) GROUP BY c, place),
        c{i + 1} AS MATERIALIZED (
            SELECT c, coalesce(f.z, c{i}.z) AS z FROM c{i} LEFT JOIN (
                SELECT c, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY place) AS z FROM m{i} GROUP BY c) f USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
            sum(best.d) OVER ()::BIGINT AS inertia,
            sha256(array_to_string([x::BIGINT FOR x IN e.z], ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} e ON a.best.c = e.c"""
