"""Most similar vectors for every vector (problem 5).

A forest of random-projection trees is fitted on a bounded sample; every vector
is then indexed. One priority queue per vector runs over all trees: it first
yields the vector's own leaf in each tree, then the leaves beyond the splits it
passed most narrowly. Vectors meet in leaves, where cosines are computed
exactly, and the best ``k`` over all leaves remain. Leaves are large, so that
few copies of a vector are moved; a leaf that the sample can't split down to
size is split again by a tree of its own within its task. Exact copies (equal
after normalising) are one indexed vector and are expanded afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut

#: Vectors that the forest is fitted on at most; all vectors are indexed.
FIT_SAMPLE = 40_000
#: Trees, members of a leaf, and leaves that a vector visits beyond its own.
TREES, LEAF, PROBES = 2, 8192, 3
#: Members and visitors of a leaf that one task compares at most, as far as the sample tells.
BLOCK, VISITORS = 32_768, 131_072


class Forest:
    """Random-projection trees over unit vectors; nodes of all trees share one numbering."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, seed: int = 7):
        rng = np.random.default_rng(seed)
        share = max(1.0, total / max(1, len(sample)))
        stop = max(2.0, leaf / share)
        planes, cuts, kids, self.roots, leaves = [], [], [], [], []

        def grow(rows: np.ndarray) -> int:
            """Index of the node, or -1 - index of the leaf."""
            for _ in range(4 if len(rows) > stop else 0):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = a - b
                size = float(np.linalg.norm(normal))
                if size < 1e-6:
                    continue
                normal = normal / size
                along = sample[rows] @ normal
                at = float(np.median(along))
                right = along > at
                if 0 < right.sum() < len(rows):
                    node = len(planes)
                    planes.append(normal)
                    cuts.append(at)
                    kids.append([0, 0])
                    kids[node][0] = grow(rows[~right])
                    kids[node][1] = grow(rows[right])
                    return node
            leaves.append(len(rows) * share)
            return -len(leaves)

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        dim = sample.shape[1]
        self.planes = np.array(planes, dtype=np.float32).reshape(-1, dim)
        self.cuts = np.array(cuts, dtype=np.float32)
        self.kids = np.array(kids, dtype=np.int32).reshape(-1, 2)
        #: Blocks of members and parts of visitors that a leaf is compared in, by what is expected of it.
        self.blocks = np.maximum(1, np.ceil(np.array(leaves) / block)).astype(np.int32)
        self.parts = np.ones(len(leaves), dtype=np.int32)

    def expect(self, sample: np.ndarray, total: int, probes: int, visitors: int = VISITORS) -> None:
        """Sets the parts of visitors from those that the sample's vectors would be."""
        leaves = self.search(sample, probes)
        visits = np.bincount(leaves[leaves >= 0], minlength=len(self.parts)) * (total / max(1, len(sample)))
        self.parts = np.maximum(1, np.ceil(visits / visitors)).astype(np.int32)

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Leaves by priority, (rows, trees + probes); the first of each tree is the own leaf; -1 for none left."""
        n, trees = len(x), len(self.roots)
        rows = np.arange(n)
        nodes = [np.full(n, r, dtype=np.int32) for r in self.roots]
        prios = [np.full(n, np.inf, dtype=np.float32) for _ in self.roots]
        queue_n, queue_p = np.stack(nodes, 1), np.stack(prios, 1)
        out = np.full((n, trees + probes), -1, dtype=np.int32)
        for k in range(trees + probes):
            j = np.argmax(queue_p, axis=1)
            node, prio = queue_n[rows, j].copy(), queue_p[rows, j].copy()
            queue_p[rows, j] = -np.inf
            live = prio > -np.inf
            add_n, add_p = [], []
            while True:
                inner = np.flatnonzero(live & (node >= 0))
                if not len(inner):
                    break
                at = node[inner]
                margin = np.einsum("ij,ij->i", x[inner], self.planes[at]) - self.cuts[at]
                side = (margin > 0).astype(np.int8)
                far_n, far_p = np.zeros(n, dtype=np.int32), np.full(n, -np.inf, dtype=np.float32)
                far_n[inner] = self.kids[at, 1 - side]
                far_p[inner] = np.minimum(prio[inner], -np.abs(margin))
                add_n.append(far_n)
                add_p.append(far_p)
                node[inner] = self.kids[at, side]
            out[live, k] = -1 - node[live]
            if add_n:
                queue_n, queue_p = np.concatenate([queue_n, np.stack(add_n, 1)], 1), np.concatenate([queue_p, np.stack(add_p, 1)], 1)
        return out


def _unit(dim: int):
    """(id, vec, key): usable vectors at length one and a key that copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
            size = np.linalg.norm(x, axis=1)
            ok = np.flatnonzero(np.isfinite(size) & (size > 0))
            unit = x[ok] / size[ok, None]
            near = (np.round(unit, 5) + 0.0).astype(np.float32)
            keys = [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "big", signed=True) for r in near]
            vecs = [r.tobytes() for r in unit.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(vecs, pa.binary()), pa.array(keys, pa.int64())], names=["id", "vec", "key"])

    return run


def _emit(shared, dim: int, probes: int):
    """Each vector as a visitor of its leaves, in one part of every block; as a member of its own leaves, in its block of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        trees = len(forest.roots)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, dim)
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                leaves = forest.search(x, probes)
                row, col = np.nonzero(leaves >= 0)
                leaf, own = leaves[row, col], col < trees
                blocks, parts = forest.blocks[leaf], forest.parts[leaf]
                home, seat = (keys[row] % blocks).astype(np.int32), ((keys[row] >> 20) % parts).astype(np.int32)
                for b in range(int(blocks.max(initial=1))):
                    for p in range(int(parts.max(initial=1))):
                        visits = seat == p
                        member = own & (home == b)
                        on = np.flatnonzero((blocks > b) & (parts > p) & (visits | member))
                        if len(on):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(leaf[on]), pa.array(np.full(len(on), b * (1 << 15) + p, dtype=np.int32)), pa.array(member[on]), pa.array(visits[on]), batch.column(0).take(pa.array(row[on])), batch.column(1).take(pa.array(row[on]))],
                                names=["leaf", "block", "own", "visits", "key", "vec"],
                            )

    return run


def best_of(x: np.ndarray, keys: np.ndarray, m: np.ndarray, m_keys: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``x``, members, cosines): the best ``k`` members other than itself for each row, from ``least``.

    The best ``k`` of all columns are in the ``k`` groups of columns with the greatest maxima.
    """
    wide = -(-len(m) // 64) * 64
    groups = wide // 64
    out = []
    for lo in range(0, len(x) if len(m) else 0, 512):
        s = np.full((min(512, len(x) - lo), wide), -2, dtype=np.float32)
        s[:, : len(m)] = x[lo : lo + 512] @ m.T
        at = np.searchsorted(m_keys, keys[lo : lo + 512]).clip(0, len(m_keys) - 1)
        same = np.flatnonzero(m_keys[at] == keys[lo : lo + 512])
        s[same, at[same]] = -2
        by_group = s.reshape(len(s), groups, 64)
        top = by_group.max(axis=2)
        rows = np.flatnonzero(top.max(axis=1) > max(least - 1e-4, -1.5))
        if not len(rows):
            continue
        few = min(k, groups)
        g = np.argpartition(-top[rows], few - 1, axis=1)[:, :few] if groups > few else np.broadcast_to(np.arange(groups), (len(rows), groups))
        near = by_group[rows[:, None], g].reshape(len(rows), -1)
        j = np.argpartition(-near, k - 1, axis=1)[:, :k] if near.shape[1] > k else np.broadcast_to(np.arange(near.shape[1]), near.shape)
        value = np.take_along_axis(near, j, 1)
        r, c = np.nonzero(value > max(least - 1e-4, -1.5))
        q = rows[r] + lo
        col = g[r, j[r, c] // 64] * 64 + j[r, c] % 64
        exact = np.einsum("ij,ij->i", x[q].astype(np.float64), m[col].astype(np.float64))
        fine = exact >= least
        out.append((q[fine], col[fine], exact[fine]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*out))


def _compare(dim: int, k: int, least: float, probes: int, leaf: int):
    """The best ``k`` own members of a leaf block for each of its visitors; many members are split again by a tree of their own."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dim)[order]
        own, visits = (np.flatnonzero(table.column(c).to_numpy()[order]) for c in ("own", "visits"))
        parts = []
        if len(own) > 2 * leaf:
            forest = Forest(x[own], len(own), 1, leaf)
            home, asked = forest.search(x[own], 0)[:, 0], forest.search(x[visits], probes)
            for n in np.unique(home):
                m, v = own[home == n], visits[(asked == n).any(axis=1)]
                q, j, cosine = best_of(x[v], keys[v], x[m], keys[m], k, least)
                parts.append((keys[v[q]], keys[m[j]], cosine))
        else:
            q, j, cosine = best_of(x[visits], keys[visits], x[own], keys[own], k, least)
            parts.append((keys[visits[q]], keys[own[j]], cosine))
        a, b, c = (np.concatenate(p) for p in zip(*parts))
        return pa.table({"q": pa.array(a, pa.int64()), "m": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return run


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, min_cosine: float | None = None, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, block: int = BLOCK, visitors: int = VISITORS) -> DataFrame:
    """(id, neighbour, cosine, rank): the ``k`` most similar other vectors of each vector.

    * Vectors that are null, not of ``dim`` values, all zero or not finite take no part;
      null ids don't either. Rows of an id with one vector are one vector; should its
      vectors differ, each counts and the best cosine holds.
    * ``min_cosine`` leaves out less similar neighbours, which never changes the rest: all
      else is done alike with and without it.
    * Up to ``leaf`` vectors the result is exact; beyond, more ``probes`` find more.
    * Equal cosines go by the smaller neighbour id. Exact copies are neighbours at 1.
    * An empty table gives no rows; columns other than the two are not read.
    """
    least = -1.0 if min_cosine is None else min_cosine
    usable = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim) & ~F.exists("vec", lambda v: v.isNull()))
    unit = usable.mapInArrow(_unit(dim), "id string, vec binary, key long")
    units = cut(unit)
    members = units.select("key", "id").distinct()
    reps = cut(units.groupBy("key").agg(F.min("vec").alias("vec")))
    total = reps.count()
    if not total:
        return df.sparkSession.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    keep = min(1.0, FIT_SAMPLE / total)
    some = reps if keep == 1 else reps.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(keep * 950_000))
    sample = np.array([np.frombuffer(r.vec, dtype=np.float32) for r in some.orderBy("key").select("vec").collect()])
    forest = Forest(sample, total, trees if total > leaf else 1, leaf, block)
    forest.expect(sample, total, probes, visitors)
    shared = df.sparkSession.sparkContext.broadcast(forest)
    met = (
        reps.select("key", "vec")
        .mapInArrow(_emit(shared, dim, probes), "leaf int, block int, own boolean, visits boolean, key long, vec binary")
        .groupBy("leaf", "block")
        .applyInArrow(_compare(dim, k, least, probes, leaf), "q long, m long, cosine double")
    )
    both = met.select(F.explode(F.array(F.struct("q", "m", "cosine"), F.struct(F.col("m").alias("q"), F.col("q").alias("m"), F.col("cosine")))).alias("p")).select("p.*")
    by_q = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "m")
    best = both.groupBy("q", "m").agg(F.max("cosine").alias("cosine")).withColumn("r", F.row_number().over(by_q)).where(F.col("r") <= k).select("q", "m", "cosine")
    copies = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("q"), F.col("key").alias("m"), F.lit(1.0).alias("cosine"))
    linked = best.unionByName(copies)
    heads = members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("key").alias("m"), F.col("id").alias("neighbour"))
    pairs = (
        linked.join(members.select(F.col("key").alias("q"), "id"), "q")
        .join(heads, "m")
        .where(F.col("id") != F.col("neighbour"))
        .groupBy("id", "neighbour")
        .agg(F.max("cosine").alias("cosine"))
    )
    by_id = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k)
