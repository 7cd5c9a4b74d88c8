"""Centroid clustering in exact integers, screened in float32.

A batch of vectors meets all centroids in one float32 matrix product. Its rounding error has a proven bound,
so each score is an interval, and a centroid whose interval lies above the least upper end can't be nearest.
Only where intervals overlap are distances computed again, in integers, the lowest number winning ties.
Sums of clusters leave a task as exact integers in pieces of 40 bits, one row per cluster and piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

QUERY = "op13_centroid_clusters"

WIDTH = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Unit roundoff of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53
#: Integers below this have squared distances below 2 ** 63 at up to 2 ** 7 components; others are added as Python's integers.
SAFE = 2**27
#: Bits of a piece of a sum: pieces of 2 ** 23 tasks can be added in 64 bits.
PIECE = 40
MOST = 2**63 - 1


def quantised(column: pa.Array, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the kept vectors and their components floor(scale * x), whole numbers as float64.

    Kept are vectors of exactly ``width`` components, none null or not finite (nor beyond float64 once scaled).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(rows)).flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def exact(x: np.ndarray, c: np.ndarray) -> list[int] | np.ndarray:
    """Squared distances of rows of two arrays of whole numbers, pair by pair, without any rounding."""
    small = (np.abs(x).max(axis=1, initial=0) < SAFE) & (np.abs(c).max(axis=1, initial=0) < SAFE)
    if small.all():
        d = x.astype(np.int64) - c.astype(np.int64)
        return np.einsum("ij,ij->i", d, d)
    return [sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), c.tolist(), strict=True)]


class Screen:
    """Centroids (rows of whole numbers, as Python's integers) ready to be compared with batches of vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array([[float(v) for v in c] for c in centroids], np.float64)
        self.integers = centroids
        # Whole numbers beyond 2 ** 53 are rounded in float64; their centroids are then never told apart by screening.
        self.rounded = np.array([any(int(float(v)) != v for v in c) for c in centroids])
        with np.errstate(over="ignore"):
            self.single = self.centroids.astype(np.float32)
        self.norms = (self.centroids**2).sum(axis=1)
        self.lengths = np.sqrt(self.norms)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 x.c for every row and centroid.

        With n components, rounding both factors to float32 and adding their products in any order, with or without
        fused operations, errs by at most g = (n + 2) u / (1 - (n + 2) u) times the sum of |x_i c_i|, itself at most
        |x| |c|. Whole numbers have no underflow; what overflows gets the whole line. The float64 steps around the
        product get a margin of their own.
        """
        n = x.shape[1]
        g = (n + 2) * U32 / (1 - (n + 2) * U32)
        with np.errstate(over="ignore", invalid="ignore"):
            product = (x.astype(np.float32) @ self.single.T).astype(np.float64)
            scores = self.norms - 2 * product
            scale = np.sqrt((x**2).sum(axis=1))[:, None] * self.lengths
            error = 2 * g * scale * (1 + 2 * n * U64) + 4 * n * U64 * (self.norms + 2 * np.abs(product) + 2 * scale)
        open_ended = ~np.isfinite(scores) | ~np.isfinite(error) | self.rounded
        scores, error = np.where(open_ended, 0, scores), np.where(open_ended, np.inf, error)
        return scores - error, scores + error

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row; among equally near ones the lowest."""
        low, high = self.intervals(x)
        listed = low <= high.min(axis=1, keepdims=True)
        found = listed.argmax(axis=1)
        rows, numbers = np.nonzero(listed & (listed.sum(axis=1) > 1)[:, None])
        if len(rows):
            distances = self._distances(x, rows, numbers)
            best: dict[int, tuple[int, int]] = {}
            if isinstance(distances, np.ndarray):
                order = np.lexsort((numbers, distances, rows))
                first = np.concatenate(([True], rows[order][1:] != rows[order][:-1]))
                found[rows[order][first]] = numbers[order][first]
            else:
                for r, k, d in zip(rows.tolist(), numbers.tolist(), distances, strict=True):
                    best[r] = min(best.get(r, (d, k)), (d, k))
                for r, (_, k) in best.items():
                    found[r] = k
        return found

    def _distances(self, x: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> list[int] | np.ndarray:
        if self.rounded.any():
            return [sum((int(a) - b) ** 2 for a, b in zip(x[r].tolist(), self.integers[k], strict=True)) for r, k in zip(rows.tolist(), numbers.tolist(), strict=True)]
        return exact(x[rows], self.centroids[numbers])

    def distances(self, x: np.ndarray, numbers: np.ndarray) -> list[int] | np.ndarray:
        """Exact squared distances of rows to the centroids of these numbers."""
        return self._distances(x, np.arange(len(x)), numbers)


def pieces(values: list[int]) -> dict[int, list[int]]:
    """Whole numbers as signed pieces of PIECE bits: piece k counts 2 ** (PIECE * k); pieces that are all 0 are left out."""
    found, k = {}, 0
    rest = [(1 if v >= 0 else -1, abs(v)) for v in values]
    while any(v for _, v in rest):
        now = [s * (v & (2**PIECE - 1)) for s, v in rest]
        if any(now):
            found[k] = now
        rest, k = [(s, v >> PIECE) for s, v in rest], k + 1
    return found or {0: [0] * len(values)}


def cluster_sums(vectors: DataFrame, screen: Screen, width: int = WIDTH, scale: int = SCALE) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums of the vectors (column embedding) nearest to each centroid.

    A task adds up all its vectors before it sends anything: as many rows as centroids, however the clusters are filled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            _, x = quantised(batch.column(0), width, scale)
            found = screen.nearest(x)
            small = np.abs(x).max(axis=1, initial=0) < SAFE
            for k in np.unique(found).tolist():
                mine = x[(found == k) & small].astype(np.int64).sum(axis=0).tolist()
                for v in x[(found == k) & ~small].tolist():
                    mine = [a + int(b) for a, b in zip(mine, v, strict=True)]
                counts[k] = counts.get(k, 0) + int((found == k).sum())
                sums[k] = [a + b for a, b in zip(sums[k], mine, strict=True)] if k in sums else mine
        out = [(k, i, counts[k] if not i else 0, p) for k in counts for i, p in (pieces(sums[k]) | ({} if 0 in pieces(sums[k]) else {0: [0] * width})).items()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cluster", "piece", "n", "sums"])

    partial = vectors.select("embedding").mapInArrow(run, "cluster int, piece int, n long, sums array<long>")
    totals = partial.groupBy("cluster", "piece").agg(F.sum("n"), *[F.sum(F.col("sums")[i]) for i in range(width)])
    found: dict[int, tuple[int, list[int]]] = {}
    # One row per centroid and piece.
    for k, piece, n, *sums in totals.collect():
        count, so_far = found.get(k, (0, [0] * width))
        found[k] = (count + n, [a + (b << PIECE * piece) for a, b in zip(so_far, sums, strict=True)])
    return found


def first_centroids(vectors: DataFrame, centroids: int = CENTROIDS, width: int = WIDTH, scale: int = SCALE) -> list[list[int]]:
    """The kept vectors with the smallest sha256 of ``2:<vec_id>``, in that order; a null id counts as no digits, equal ids go by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[float]]] = []
        for batch in batches:
            rows, x = quantised(batch.column(1), width, scale)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            best += [(hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in zip(ids, x.tolist(), strict=True)]
            best = sorted(best)[:centroids]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.float64()))], names=["hash", "vector"])

    first = vectors.select("vec_id", "embedding").mapInArrow(run, "hash string, vector array<double>")
    return [[int(v) for v in r["vector"]] for r in first.orderBy("hash", "vector").limit(centroids).collect()]


def fit_centroids(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> list[list[int]]:
    """The centroids after ``rounds`` rounds: exact floors of the means of their vectors; a centroid without vectors stays."""
    at = first_centroids(vectors, centroids, width, scale)
    for _ in range(rounds if at else 0):
        sums = cluster_sums(vectors, Screen(at), width, scale)
        at = [[s // sums[k][0] for s in sums[k][1]] if k in sums else c for k, c in enumerate(at)]
    return at


def assigned(vectors: DataFrame, centroids: list[list[int]], width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance of every kept vector; a distance beyond 64 bits is given as the largest long."""
    screen = Screen(centroids) if centroids else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = quantised(batch.column(1), width, scale)
            if screen is None or not len(rows):
                continue
            found = screen.nearest(x)
            distances = screen.distances(x, found)
            if not isinstance(distances, np.ndarray):
                distances = [min(d, MOST) for d in distances]
            ids = batch.column(0).take(pa.array(rows)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(distances, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, ws: Workspace, centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row.

    Rows whose embedding is null, has another number of components, or any that is null or not finite, are left
    out. Repeated rows and ids each count; null ids are kept. With fewer kept vectors than ``centroids`` there are
    as many centroids as vectors; equal centroids leave all but the first empty. An empty table gives no rows;
    other columns are ignored. Inertias beyond 64 bits are given as the largest long.
    """
    at = fit_centroids(vectors, centroids, rounds, width, scale)
    found = ws.table(assigned(vectors, at, width, scale), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    known = [(k, min(s, MOST), min(sum(sums.values()), MOST), digests[k]) for k, s in sorted(sums.items())]
    table = found.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid: a proven bound for the broadcast.
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "centroid-clusters"))


def _oracle(rounds: int = ROUNDS) -> str:
    """Each round of SQL: all distances, the least of each vector, the floors of the means."""
    steps = [f"""WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
at0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM fine ORDER BY sha256('2:' || vec_id) LIMIT {CENTROIDS})"""]
    near = "SELECT vec_id, v, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM fine, at{}) GROUP BY vec_id, v"
    for i in range(rounds):
        steps.append(f"near{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(f"""at{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM at{i} o LEFT JOIN (SELECT k, list((CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT ORDER BY i) AS c
  FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{i}) GROUP BY k, i) GROUP BY k) m ON m.k = o.k)""")
    steps.append(f"last AS MATERIALIZED ({near.format(rounds)})")
    return ",\n".join(steps) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  (SELECT sha256(array_to_string(c, ',')) FROM at{rounds} a WHERE a.k = last.k) AS centroid_sha256 FROM last"""


ORACLE_SQL = _oracle()
