"""Centroid clustering of quantised vectors, in exact integers.

Vectors become integers floor(scale * x) and are packed, many to a row, as blocks of float64 in the
shared folder.  A round sends the centroids to all tasks (k x d numbers: bounded by parameters); each
block takes its distances from one matrix product, |x|^2 - 2 x.c + |c|^2.  As long as d * (max|x| +
max|c|)^2 is below 2^53 no partial sum of that expansion can be rounded, so float64 BLAS is exact;
rows of a block beyond the bound are worked in integers (64-bit to 2^63, beyond it of any length).
Sums, counts and inertia are combined by `treeAggregate` over the blocks, so the driver gets one
k x d table whatever the number of vectors.  A lost executor costs a reread of its blocks.

Defined results.  Only vectors of exactly `dims` components, none null or non-finite, take part; the
others, and null vectors, give no row.  Rows with one id are vectors of their own; a null id is hashed
as the empty text.  Equal hashes are ordered by the components.  With fewer vectors than `k` there
are that many centroids, with none the result is empty.  A distance, or sum of distances, beyond a
64-bit integer is null; clusters and centroids are right even then.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import shared_table, ship_by_value

BLOCK_ROWS = 4096
EXACT = 1 << 53
LONG = 1 << 63


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64 integers, or as Python integers where the product overflows."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[math.floor(x) * scale if abs(x) >= EXACT else math.floor(x * scale) for x in row] for row in values.tolist()], object)


def _integers(values: np.ndarray) -> np.ndarray:
    return values if values.dtype == object else np.array([[int(x) for x in row] for row in values.tolist()], object)


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and its squared distance."""
    n, dims = vectors.shape
    reach = np.abs(vectors).max(axis=1)
    far = max(abs(c) for row in centroids for c in row)
    cluster, distance = np.zeros(n, np.int64), np.zeros(n, object)
    bound = [dims * (int(r) + far) ** 2 for r in reach.tolist()]
    kind = np.array([0 if b < EXACT else 1 if b < LONG else 2 for b in bound])
    for way in np.unique(kind):
        rows = np.flatnonzero(kind == way)
        if way == 0:
            x, c = vectors[rows].astype(np.float64), np.array(centroids, np.float64)
            d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        elif way == 1:
            x, c = vectors[rows].astype(np.int64), np.array(centroids, np.int64)
            d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
        else:
            x, c = _integers(vectors[rows]), np.array(centroids, object)
            d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
        best = np.argmin(d, axis=1)
        cluster[rows] = best
        distance[rows] = [int(v) for v in d[np.arange(len(rows)), best]]
    return cluster, distance


def _sums(vectors: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums by cluster, exact."""
    if vectors.dtype != object and len(vectors) * float(np.abs(vectors).max()) < EXACT:
        member = (cluster[:, None] == np.arange(k)[None, :]).astype(np.float64)
        return np.array([[int(x) for x in row] for row in (member.T @ vectors).tolist()], object)
    out = np.zeros((k, vectors.shape[1]), object)
    np.add.at(out, cluster, _integers(vectors))
    return out


def _good(vectors: DataFrame, dims: int, id_column: str, vector_column: str) -> DataFrame:
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def pack(vectors: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Blocks (ids, known, values, huge) of the vectors that take part."""
    good = _good(vectors, dims, id_column, vector_column)

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                ids = part.column(0)
                values = whole(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims), scale)
                huge = values.dtype == object
                body = ";".join(",".join(map(str, row)) for row in values.tolist()).encode() if huge else values.tobytes()
                known = np.array(ids.is_valid().to_pylist(), bool)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], "known": [known.tobytes()], "body": [body], "huge": [huge]}), preserve_index=False)

    return good.mapInArrow(run, "ids binary, known binary, body binary, huge boolean")


def unpack(body: bytes, huge: bool, dims: int) -> np.ndarray:
    if huge:
        return np.array([[int(x) for x in row.split(",")] for row in bytes(body).decode().split(";")], object)
    return np.frombuffer(body, np.float64).reshape(-1, dims)


def start(vectors: DataFrame, k: int, dims: int, scale: int, salt: str, id_column: str, vector_column: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of salt:id, in that order."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = _good(vectors, dims, id_column, vector_column).select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    rows = np.array([r["v"] for r in first], np.float64).reshape(-1, dims)
    return [[int(x) for x in row] for row in whole(rows, scale).tolist()]


def _round(blocks, centroids: list[list[int]], dims: int):
    """Counts, sums and inertia by cluster over all blocks."""
    k = len(centroids)
    zero = (np.zeros(k, object), np.zeros((k, dims), object), np.zeros(k, object))
    sent = blocks.context.broadcast(centroids)

    def add(total, block):
        vectors = unpack(block[0], block[1], dims)
        cluster, distance = nearest(vectors, sent.value)
        inertia = np.zeros(k, object)
        np.add.at(inertia, cluster, distance)
        return total[0] + np.bincount(cluster, minlength=k).astype(object), total[1] + _sums(vectors, cluster, k), total[2] + inertia

    # Three levels at least: a combining task reads few partial tables, however many partitions there are.
    return blocks.treeAggregate(zero, add, lambda a, b: tuple(x + y for x, y in zip(a, b)), depth=3)


def cluster(vectors: DataFrame, k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, salt: str = "1", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector that takes part: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    schema = f"`{id_column}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = start(vectors, k, dims, scale, salt, id_column, vector_column)
    if not centroids:
        return spark.createDataFrame([], schema)
    blocks = shared_table(pack(vectors, dims, scale, id_column, vector_column), "centroid-blocks")
    packed = blocks.select("body", "huge").rdd
    for _ in range(rounds):
        counts, sums, _ = _round(packed, centroids, dims)
        centroids = [[int(s) // int(n) for s in row] if n else old for n, row, old in zip(counts, sums, centroids)]
    inertia = [int(x) for x in _round(packed, centroids, dims)[2]]
    fits = lambda x: x if x < LONG else None
    about = [(fits(x), fits(sum(inertia)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c, x in zip(centroids, inertia)]

    def run(batches) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        types = pa.schema([(id_column, pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])
        for batch in batches:
            for ids, known, body, huge in zip(*(c.to_pylist() for c in batch.columns)):
                found, distance = nearest(unpack(body, huge, dims), centroids)
                ids = [i if ok else None for i, ok in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(known, bool))]
                each = [about[c] for c in found.tolist()]
                columns = [ids, found.tolist(), [fits(d) for d in distance.tolist()], *([a[i] for a in each] for i in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types)], schema=types)

    return blocks.mapInArrow(run, schema)


ship_by_value(__name__)
