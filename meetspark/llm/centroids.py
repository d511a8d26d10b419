"""Centroid clustering over subvector dictionaries.

Vectors are turned into whole numbers and dictionary-encoded without loss, a row group of some thousand vectors at a time: each block
of ``WIDTH`` dimensions has the distinct subvectors of its row group, and a vector is one code for each block. In a round the
squared distances of a dictionary's subvectors to the centroids' subvectors are computed once each, and a vector's distances are
sums of partial distances looked up by its codes. The new centroids' sums come from counts of codes by cluster, so no vector is
ever decoded.

The dictionaries belong to row groups, as in columnar files: a round is one pass over the encoded table without any shuffle of
vectors (one dictionary for all would send a row for each block of each vector through a join, in every round). A task gives
one row of counts and sums for each cluster; only the centroids pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import saved

DIMENSIONS, WIDTH, SCALE = 64, 2, 64
GROUP_ROWS = 16_384
LIMIT = 1 << 27  # so that a distance fits 64 bits
_ENCODED = "ids array<long>, entries array<array<int>>, codes array<array<int>>"


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id, units`` of the vectors with all components present and finite; units are ``floor(64 * x)``."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    unit = lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    return vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, unit).alias("units"))


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a whole-number matrix and each row's place among them, by pairing one column after the other."""
    code = np.zeros(len(block), dtype=np.int64)
    for column in block.T:
        _, code = np.unique((code << 32) | (column.astype(np.int64) + (1 << 31)), return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return block[first], code


def _encode(width: int, dimensions: int, group_rows: int):
    def group(ids: list[np.ndarray], units: list[np.ndarray]) -> pa.RecordBatch:
        matrix = np.concatenate(units)
        pairs = [dictionary(matrix[:, i : i + width]) for i in range(0, dimensions, width)]
        columns = ([pa.concat_arrays(ids).to_pylist()], [[e.ravel() for e, _ in pairs]], [[c.astype(np.int32) for _, c in pairs]])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32()))), strict=True)], names=["ids", "entries", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, held = [], [], 0
        for batch in batches:
            matrix = batch.column("units").flatten().to_numpy().reshape(-1, dimensions)
            for i in range(0, len(matrix), group_rows):
                part = matrix[i : i + group_rows]
                if held and held + len(part) > group_rows:
                    yield group(ids, units)
                    ids, units, held = [], [], 0
                ids.append(batch.column("vec_id").slice(i, len(part)))
                units.append(part)
                held += len(part)
        if held:
            yield group(ids, units)

    return run


def _row_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            entries, codes = batch.column("entries")[i].values, batch.column("codes")[i].values
            pairs = [(entries[j].values.to_numpy().astype(np.int64).reshape(-1, width), codes[j].values.to_numpy()) for j in range(len(entries))]
            yield batch.column("ids")[i].values, pairs


def nearest(pairs: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each encoded vector; of equally near ones the first."""
    total, at = 0, 0
    for entries, codes in pairs:
        width = entries.shape[1]
        partial = sum((entries[:, j, None] - centroids[None, :, at + j]) ** 2 for j in range(width))  # of each distinct subvector
        total = total + partial[codes]
        at += width
    return total.argmin(axis=1), total.min(axis=1)


def _sums(centroids: np.ndarray, width: int):
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, parts = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), np.zeros((2, k), np.int64)
        for _, pairs in _row_groups(batches, width):
            cluster, distance = nearest(pairs, centroids)
            count += np.bincount(cluster, minlength=k)
            for half, value in enumerate((distance >> 32, distance & 0xFFFFFFFF)):
                np.add.at(parts[half], cluster, value)
            for j, (entries, codes) in enumerate(pairs):
                times = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
                sums[:, j * width : (j + 1) * width] += times @ entries
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(parts[0, some]), pa.array(parts[1, some]), *(pa.array(sums[some, j]) for j in range(dimensions))], names=["cluster", "n", "high", "low", *(f"s{j}" for j in range(dimensions))])

    return run


def _label(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pairs in _row_groups(batches, width):
            cluster, distance = nearest(pairs, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _totals(encoded: DataFrame, centroids: np.ndarray, width: int) -> list:
    """Of each cluster with vectors its count, sums and inertia, exactly: a row for each cluster and task is shuffled."""
    numbers = ["n", "high", "low", *(f"s{j}" for j in range(centroids.shape[1]))]
    found = encoded.mapInArrow(_sums(centroids, width), "cluster long, " + ", ".join(f"{c} long" for c in numbers))
    return found.groupBy("cluster").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in numbers)).collect()  # at most k rows


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dimensions: int = DIMENSIONS, width: int = WIDTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of each kept row of ``vectors(vec_id, embedding)``.

    All numbers are whole and exact. The first centroids are the k vectors of least sha256 of ``seed:vec_id``; each round assigns every
    vector to the nearest (ties: the smaller number) and replaces non-empty centroids by floored means. ``centroid`` is the final
    one, as numbers.

    Vectors that are null, of another length, or with a null or non-finite component are left out. Components beyond 2^21 in size
    count as 2^21, so that distances fit 64 bits; sums of distances beyond 2^63 - 1 are given as that. A null id is hashed as ``seed:``
    alone and stays null; rows with one id are vectors of their own, as first centroids in the order of their components; with fewer
    than k vectors each is a centroid; an empty table gives an empty result; extra columns are ignored.
    """
    if dimensions % width:
        raise ValueError("dimensions must be a multiple of width")
    spark, kept = vectors.sparkSession, kept_vectors(vectors, dimensions)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(digest, "units").limit(k).collect()
    centroids = np.array([r.units for r in first], dtype=np.int64).reshape(-1, dimensions)
    encoded = saved(kept.mapInArrow(_encode(width, dimensions, group_rows), _ENCODED), "encoded")
    for _ in range(rounds):
        for r in _totals(encoded, centroids, width):
            centroids[r.cluster] = [int(r[f"s{j}"]) // int(r.n) for j in range(dimensions)]
    within = {r.cluster: (int(r.high) << 32) + int(r.low) for r in _totals(encoded, centroids, width)}
    most = (1 << 63) - 1
    facts = [(i, min(within.get(i, 0), most), min(sum(within.values()), most), c.tolist()) for i, c in enumerate(centroids)]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType()))])
    labels = encoded.mapInArrow(_label(centroids, width), "vec_id long, cluster int, distance long")
    return labels.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
