"""Operator 12: k-means over whole-number vectors, each assignment by annulus search.

Centroids are sorted by norm. The two whose norms lie on either side of a vector's give an upper bound u of its distance to the closest one,
and no centroid whose norm differs by more than u from the vector's can be closer: two binary searches cut the sorted norms to that annulus,
whose border is part of it, so that ties there count. Those candidates are compared exactly, in whole numbers; of equally near centroids the one of
the smaller number is taken. Norms are square roots, so the annulus is widened by what rounding may take; a wider one only adds candidates.

Vectors that are null, have another number of components or a null or non-finite one are left out. A null vec_id stays null and is hashed as
the text "null"; repeated vec_ids are vectors of their own, ordered among starts by their components. With fewer vectors than centroids each
vector is one; without any the result is empty. Components beyond MOST are an error: their squared distances don't fit a long.
Other columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.llm.arrays import as_arrow, saved

SCALE, COMPONENTS, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Of a component after scaling, in either direction.
MOST = 1 << 27
#: Vectors compared at once.
BLOCK = 4096


def whole(batch: pa.RecordBatch, components: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """(vec_ids, vectors of whole numbers) of the rows that have proper vectors."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), components), False))
    column = batch.column("embedding")
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, components)
    good = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[good] * scale)
    if scaled.size and np.abs(scaled).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} after scaling")
    return batch.column("vec_id").filter(pa.array(good)), scaled.astype(np.int64)


class Annuli:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids**2).sum(axis=1).astype(np.float64))
        self.number = np.lexsort((np.arange(len(norms)), norms))
        self.norms, self.centroids = norms[self.number], centroids[self.number]

    def candidates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of each vector's candidates in the order of norms."""
        norms = np.sqrt((vectors**2).sum(axis=1).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        beside = (self.centroids[np.maximum(above - 1, 0)], self.centroids[above])
        bound = np.sqrt(np.minimum(*(((vectors - c) ** 2).sum(axis=1) for c in beside)).astype(np.float64))
        bound += 1e-6 + 1e-9 * (bound + norms + self.norms[-1])
        return np.searchsorted(self.norms, norms - bound, "left"), np.searchsorted(self.norms, norms + bound, "right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance to it)."""
        number, least = np.full(len(vectors), len(self.number)), np.full(len(vectors), np.iinfo(np.int64).max)
        for at in range(0, len(vectors), BLOCK):
            block, one, d = vectors[at : at + BLOCK], number[at : at + BLOCK], least[at : at + BLOCK]
            first, end = self.candidates(block)
            for place in range(int(first.min()), int(end.max())):
                rows = np.flatnonzero((first <= place) & (place < end))
                now = ((block[rows] - self.centroids[place]) ** 2).sum(axis=1)
                better = (now < d[rows]) | ((now == d[rows]) & (self.number[place] < one[rows]))
                d[rows[better]], one[rows[better]] = now[better], self.number[place]
        return number, least


def starts(embeddings: DataFrame, k: int, components: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors of the least digests of seed and vec_id."""

    def run(batches):
        for batch in batches:
            ids, vectors = whole(batch, components, scale)
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), components).cast(pa.list_(pa.int64()))], ["vec_id", "v"])

    kept = as_arrow(embeddings, run, "vec_id long, v array<long>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.v for r in kept.orderBy(digest, "v").limit(k).collect()], np.int64).reshape(-1, components)


def moved(embeddings: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Each centroid at the floored mean of its vectors; those without any stay. Tasks hand over one sum a component."""
    k, components = centroids.shape

    def run(batches):
        annuli, count, total = Annuli(centroids), np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for batch in batches:
            _, vectors = whole(batch, components, scale)
            number, _ = annuli.nearest(vectors)
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += vectors[number == c].sum(axis=0)
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count[found]), pa.array(list(total[found]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = as_arrow(embeddings, run, "cluster long, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place")
    out = centroids.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():  # k * components rows
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def assigned(embeddings: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """vec_id, cluster, distance (squared)."""

    def run(batches):
        annuli = Annuli(centroids)
        for batch in batches:
            ids, vectors = whole(batch, centroids.shape[1], scale)
            number, least = annuli.nearest(vectors)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(least)], ["vec_id", "cluster", "distance"])

    return as_arrow(embeddings, run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of all proper vectors of embeddings (vec_id, embedding), final centroids)."""
    vectors = embeddings.select(F.col("vec_id").cast("long"), "embedding")
    centroids = starts(vectors, k, components, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids, scale)
    return assigned(vectors, centroids, scale), centroids


def with_inertia(clusters: DataFrame, centroids: np.ndarray) -> DataFrame:
    """With cluster_inertia and inertia (distances summed over the cluster and over all) and the digest of each one's centroid."""
    session, clusters = clusters.sparkSession, saved(clusters, "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = clusters.groupBy("cluster").agg(total.alias("total")).collect()  # a row for each centroid
    whole_sum, digest = sum(r.total for r in sums), lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(r.cluster, int(r.total), int(whole_sum), digest(centroids[r.cluster].tolist())) for r in sums]
    facts = session.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
