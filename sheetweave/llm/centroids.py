"""Exact k-means over integer vectors by kd-tree filtering.

Each task packs its rows into kd-trees of at most ``BLOCK`` vectors and writes
them once; nothing is shuffled.  A node holds its count, the integer sums and
the bounding box of its vectors.  A round walks every tree from its root with
all centroids as candidates.  Of a node's candidates the one nearest to the
middle of the box is taken, and those go that are farther than it from every
point of the box, strictly, so that ties stay for the leaves.  A node with one
candidate left is assigned whole, by its count and sums; the vectors of leaves
are resolved exactly.  A round returns k rows of counts and sums a task.  All
arithmetic is in 64-bit integers.

Left out are vectors that are null, of another size, or hold a null or a
non-finite component; a component of which the scaled value is beyond ``LARGEST``
in size is an error, because squared distances might not fit 64 bits.  Null ids
are kept and hash after all others.  Rows that repeat an id are vectors of their
own.  With fewer than k vectors there are as many centroids as vectors; an empty
table gives no rows.  Other columns of the table aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import stored

#: Vectors of a tree, vectors of a leaf, size of a scaled component, and numbers that a step of a walk holds at once.
BLOCK, LEAF, LARGEST, HELD = 4096, 16, 1 << 27, 1 << 21
_TREE = {"ids": "array<bigint>", "n": "int", "points": "binary", "start": "binary", "stop": "binary", "left": "binary", "low": "binary", "high": "binary", "sums": "binary"}


class Tree:
    """A kd-tree over contiguous ranges of ``points``; ``left`` is a node's first child, the next one its other, -1 at a leaf."""

    def __init__(self, points, start, stop, left, low, high, sums):
        self.points, self.start, self.stop, self.left, self.low, self.high, self.sums = points, start, stop, left, low, high, sums

    @classmethod
    def over(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it holds the given points."""
        order = np.arange(len(points))
        start, stop, left, i = [0], [len(points)], [], 0
        while i < len(start):
            a, b = start[i], stop[i]
            own = points[order[a:b]]
            extent = own.max(0) - own.min(0)
            if b - a <= LEAF or not extent.any():
                left.append(-1)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, extent.argmax()], half)]
                left.append(len(start))
                start += [a, a + half]
                stop += [a + half, b]
            i += 1
        points = points[order]
        ranges = [points[a:b] for a, b in zip(start, stop, strict=True)]
        low, high, sums = (np.array([f(x) for x in ranges]) for f in (lambda x: x.min(0), lambda x: x.max(0), lambda x: x.sum(0)))
        return cls(points, np.array(start), np.array(stop), np.array(left), low, high, sums), order

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Nodes of one centroid with that centroid, and leaves with those that are left."""
        k = len(centroids)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        step = max(1, HELD // centroids.size)
        while len(nodes):
            after = []
            for i in range(0, len(nodes), step):
                at, may = nodes[i : i + step], alive[i : i + step]
                low, high = self.low[at][:, None], self.high[at][:, None]
                middle = ((2 * centroids - low - high) ** 2).sum(-1)
                best = np.where(may, middle, np.iinfo(np.int64).max).argmin(1)
                near = centroids[best][:, None]
                corner = np.where(centroids > near, high, low)
                may = may & (((centroids - near) * (centroids + near - 2 * corner)).sum(-1) <= 0)
                one, leaf = may.sum(1) == 1, self.left[at] < 0
                yield at[one], best[one], True
                yield at[leaf & ~one], may[leaf & ~one], False
                go = ~one & ~leaf
                after.append((np.concatenate([self.left[at[go]], self.left[at[go]] + 1]), np.concatenate([may[go], may[go]])))
            nodes, alive = (np.concatenate(x) for x in zip(*after, strict=True))

    def nearest(self, at: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the vectors of the leaves ``at``, and the nearest of each leaf's centroids, the first of equals."""
        size = self.stop[at] - self.start[at]
        where = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        found = np.zeros(len(where), np.int64)
        owner = np.repeat(np.arange(len(at)), size)
        square = (centroids**2).sum(1)
        for i in range(0, len(where), 1024):
            part = where[i : i + 1024]
            far = square - 2 * (self.points[part] @ centroids.T)  # without the vector's own square, which is the same for all
            found[i : i + 1024] = np.where(may[owner[i : i + 1024]], far, np.iinfo(np.int64).max).argmin(1)
        return where, found

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each centroid's count and sums of vectors."""
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for at, which, whole in self.filtered(centroids):
            if whole:
                np.add.at(count, which, self.stop[at] - self.start[at])
                np.add.at(sums, which, self.sums[at])
            elif len(at):
                where, found = self.nearest(at, which, centroids)
                count += np.bincount(found, minlength=len(centroids))
                np.add.at(sums, found, self.points[where])
        return count, sums

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector."""
        out = np.zeros(len(self.points), np.int64)
        for at, which, whole in self.filtered(centroids):
            if whole:
                for a, b, c in zip(self.start[at], self.stop[at], which, strict=True):
                    out[a:b] = c
            elif len(at):
                where, found = self.nearest(at, which, centroids)
                out[where] = found
        return out


def _plant(dims: int):
    names = list(_TREE)

    def rows(ids: list, points: list) -> pa.RecordBatch:
        tree, order = Tree.over(np.concatenate(points))
        ids = pa.concat_arrays(ids).take(pa.array(order))
        parts = (tree.points.astype(np.int32), tree.start.astype(np.int32), tree.stop.astype(np.int32), tree.left.astype(np.int32), tree.low.astype(np.int32), tree.high.astype(np.int32), tree.sums)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        points: list = []
        n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                got = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                if np.abs(got).max() > LARGEST:
                    raise ValueError(f"a scaled component is beyond {LARGEST}")
                if n + len(got) > BLOCK:
                    yield rows(ids, points)
                    ids, points, n = [], [], 0
                ids.append(part.column("id"))
                points.append(got)
                n += len(got)
        if n:
            yield rows(ids, points)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[Tree, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {name: batch.column(name)[i] for name in _TREE}
            read = {name: np.frombuffer(raw[name].as_buffer(), np.int64 if name == "sums" else np.int32).astype(np.int64) for name in list(_TREE)[2:]}
            yield Tree(*(x.reshape(-1, dims) if name in ("points", "low", "high", "sums") else x for name, x in read.items())), raw["ids"].values


def _round(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for tree, _ in _trees(batches, centroids.shape[1]):
            n, s = tree.totals(centroids)
            count += n
            sums += s
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(len(centroids)), "n": count, "sums": list(sums)})

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, ids in _trees(batches, centroids.shape[1]):
            label = tree.labels(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(((tree.points - centroids[label]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    return run


def quantised(vectors: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``id`` and the components times ``scale``, rounded down, of the vectors that count."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dims) & whole)
    return fit.select(F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector.

    The first centroids are the k vectors with the least SHA-256 of ``<seed>:<id>``.
    k rows of ``dims`` numbers come to the driver in a round, whatever the input.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_column, vector, dims, scale)
    drawn = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "q").limit(k).collect()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not drawn:
        return spark.createDataFrame([], result)
    centroids = np.array([r["q"] for r in drawn], np.int64)
    trees = stored(rows.mapInArrow(_plant(dims), ", ".join(f"{n} {t}" for n, t in _TREE.items())))
    for _ in range(rounds):
        made = trees.mapInArrow(_round(centroids), "cluster long, n long, sums array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims))).where("n > 0").collect()
        for r in made:
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    placed = stored(trees.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"))
    shas = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    own = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in own)
    facts = {r["cluster"]: r["cluster_inertia"] for r in own}
    told = spark.createDataFrame([(i, facts[i], total, sha) for i, sha in shas if i in facts], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
