"""Graph operators that need iteration: connected components and communities."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut, ship

#: Rows (nodes and edges) up to which a community is divided within one task, and rows that a task gets of smaller ones.
HELD, BUCKET = 400_000, 50_000
#: Turns of label propagation within a community.
ROUNDS = 4


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node with an edge; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shrink by half. Rounds are cut with
    checkpoints and end when no label changes. Null ends and self-loops are no
    edges, but a self-loop still makes its node known.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut(ends.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("n"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "n").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        stepped = cut(lower.join(jump, "component", "left").select("id", "old", F.least("component", "root").alias("component")))
        labels = stepped.select("id", "component")
        if stepped.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def communities(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, rounds: int = 10) -> DataFrame:
    """(id, community) by weighted label propagation: a node takes the label with most weight around
    it, its own counting half an edge; equal weights go by the smaller label.

    In each round half of the nodes take labels, then the other half, by another bit of a checksum
    of their ids each time, so that two sides don't swap theirs for ever. The result is deterministic; it ends when no node
    of either half would change, so that a part of the graph has the same labels alone, or after ``rounds``.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.coalesce(w, F.lit(1.0)).alias("w")).where("a is not null and b is not null and a <> b")
    both = cut(ends.select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("w")))).alias("e")).select("e.*").groupBy("a", "b").agg(F.sum("w").alias("w")))
    labels = cut(both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for turn in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("b"), "community"), "b").select(F.col("a").alias("id"), "community", "w").unionByName(labels.withColumn("w", F.lit(0.5)))
        sums = votes.groupBy("id", "community").agg(F.sum("w").alias("w"))
        best = sums.groupBy("id").agg(F.min_by("community", F.struct(-F.round("w", 6), F.col("community"))).alias("best"))
        mine = (F.shiftright(F.crc32(F.col("id").cast("string").cast("binary")), turn // 2) + turn) % 2 == 0
        stepped = cut(labels.join(best, "id").select("id", F.when(mine, F.col("best")).otherwise(F.col("community")).alias("community"), (F.col("best") != F.col("community")).alias("moves")))
        labels = stepped.select("id", "community")
        if stepped.where("moves").isEmpty():
            break
    return labels


def _propagate(crc: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """``communities`` of nodes numbered in the order of their ids, by distinct edges of weight 1; a node without one has its own number."""
    n, labels = len(crc), np.arange(len(crc))
    pairs, weight = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    a, b = pairs // n, pairs % n
    nodes = np.unique(a)
    weights = np.concatenate([2 * weight, np.ones(len(nodes), np.int64)])
    for turn in range(rounds if len(nodes) else 0):
        keys, at = np.unique(np.concatenate([a * n + labels[b], nodes * n + labels[nodes]]), return_inverse=True)
        votes = np.bincount(at, weights=weights)
        starts = np.flatnonzero(np.diff(keys // n, prepend=-1))
        most = np.repeat(np.maximum.reduceat(votes, starts), np.diff(starts, append=len(keys)))
        first = keys[votes == most]
        best = first[np.flatnonzero(np.diff(first // n, prepend=-1))] % n
        moves = best != labels[nodes]
        if not moves.any():
            break
        moves &= ((crc[nodes] >> (turn // 2)) + turn) % 2 == 0
        labels[nodes[moves]] = best[moves]
    return labels


def _several(groups: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` groups have two or more labels."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, groups, labels)
    np.maximum.at(high, groups, labels)
    return low < high


def _divide(most: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All levels from ``level`` on of whole communities; rows are edges, and nodes with their names."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        nodes, edges = rows.filter(pc.is_valid(rows["name"])).sort_by("src").combine_chunks(), rows.filter(pc.is_null(rows["name"]))
        ids, names, n = nodes["src"].combine_chunks(), nodes["name"].to_pylist(), len(nodes)
        a, b = (pc.index_in(edges[c], value_set=ids).to_numpy().astype(np.int64) for c in ("src", "dst"))
        crc = np.fromiter((zlib.crc32(x.encode()) for x in names), np.int64, n)
        coded = nodes["community"].combine_chunks().dictionary_encode()
        paths, of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)

        def told(some: np.ndarray, stuck: np.ndarray) -> Iterator[pa.RecordBatch]:
            step = max(1, 8_000_000 // max(map(len, paths)))
            text = pa.array(paths, pa.string())
            for i in range(0, len(some), step):
                x = some[i : i + step]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), pa.array(np.full(len(x), at, np.int32)), text.take(pa.array(of[x])), pa.array(stuck[of[x]])], ["id", "level", "community", "unsplittable"])

        at, live = level, np.arange(n)
        while len(live):
            labels = _propagate(crc, a, b, ROUNDS)
            parted = _several(of[live], labels[live], len(paths))
            whole = live[~parted[of[live]]]
            if len(whole):
                inner = ~parted[of[a]]
                c, d = a[inner], b[inner]
                degree = np.bincount(np.concatenate([c, d]), minlength=n)
                order = whole[np.lexsort((whole, -degree[whole], of[whole]))]
                hub = np.zeros(n, bool)
                hub[order[np.flatnonzero(np.diff(of[order], prepend=-1))]] = True
                rest, plain = ~hub[c] & ~hub[d], whole[~hub[whole]]
                labels[whole] = _propagate(crc, c[rest], d[rest], ROUNDS)[whole]
                parted |= _several(of[plain], labels[plain], len(paths))
            yield from told(live, ~parted)
            live = live[parted[of[live]]]
            if not len(live):
                return
            parts, code = np.unique(labels[live], return_inverse=True)
            paths = [f"{paths[of[x]]}/{names[x]}" for x in parts]
            of[live] = code
            at += 1
            large = np.bincount(code)[code] > most
            yield from told(live[~large], np.zeros(len(paths), bool))
            live = live[large]
            inside = np.zeros(n, bool)
            inside[live] = True
            keep = inside[a] & inside[b] & (of[a] == of[b])
            a, b = a[keep], b[keep]

    return divide


def bounded_communities(edges: DataFrame, most: int = 10) -> DataFrame:
    """(id, level, community, unsplittable): communities, and within those beyond ``most`` nodes again communities.

    Each step propagates labels on the edges inside the communities that are still
    too large; a node without such an edge is then on its own. One that comes out
    whole is tried again without its most connected node, which is then on its own.
    The id of a community is that of its parent and its own label. A community that
    doesn't come apart either way is ``unsplittable``. It ends when no other is too large.

    A community of up to ``HELD`` nodes and edges goes through all its steps within one task; one beyond it
    takes a step of the same kind over all tasks, until its parts are small enough.
    """
    ship(edges.sparkSession)
    kept = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    current = communities(kept).select("id", F.col("community").cast("string").alias("community"))
    out, level = [], 0

    def parted(nodes: DataFrame, inner: DataFrame, hub: str | None = None) -> DataFrame:
        """Parts of the communities of ``nodes`` by their ``inner`` edges, where there are two or more besides a hub."""
        near = communities(inner, rounds=ROUNDS).select("id", F.col("community").alias("label"))
        label = F.coalesce("label", "id") if hub is None else F.when(F.col(hub), F.col("id")).otherwise(F.coalesce("label", "id"))
        parts = cut(nodes.join(near, "id", "left").select("id", F.col("community").alias("parent"), F.concat_ws("/", "community", label).alias("community"), *([hub] if hub else [])))
        counted = parts if hub is None else parts.where(~F.col(hub))
        several = counted.groupBy("parent").agg(F.count_distinct("community").alias("n")).where("n > 1").select("parent")
        return parts.join(several, "parent", "left_semi").select("id", "community", "parent")

    def at_level(nodes: DataFrame, unsplittable: Column) -> DataFrame:
        return nodes.select("id", F.lit(level).alias("level"), "community", unsplittable.alias("unsplittable"))

    while True:
        sized = current.join(current.groupBy("community").agg(F.count("*").alias("n")), "community")
        out.append(at_level(sized.where(F.col("n") <= most), F.lit(False)))
        large = cut(sized.where(F.col("n") > most).select("id", "community"))
        a, b = large.select(F.col("id").alias("src"), F.col("community").alias("ca")), large.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
        within = kept.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("community"), F.lit(None).cast("string").alias("name"))
        rows = cut(within.unionByName(large.select(F.col("id").alias("src"), F.col("id").alias("dst"), "community", F.col("id").cast("string").alias("name"))))
        counts = rows.groupBy("community").agg(F.count("*").alias("n"))
        beyond = cut(counts.where(F.col("n") > HELD).select("community"))
        held = rows.join(beyond, "community", "left_anti")
        buckets = held.count() // BUCKET + 1
        kind = dict(large.dtypes)["id"]
        out.append(held.groupBy(F.pmod(F.xxhash64("community"), F.lit(buckets))).applyInArrow(_divide(most, level), f"id {kind}, level int, community string, unsplittable boolean"))
        if beyond.isEmpty():
            break
        inside = cut(large.join(beyond, "community", "left_semi"))
        within = cut(rows.where("name is null").join(beyond, "community", "left_semi").select("src", "dst"))
        first = cut(parted(inside, within))
        whole = inside.join(first.select(F.col("parent").alias("community")).distinct(), "community", "left_anti")
        degree = within.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        hubs = whole.join(degree, "id").groupBy("community").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("id")).select("id")
        marked = cut(whole.join(hubs.withColumn("hub", F.lit(True)), "id", "left").select("id", "community", F.coalesce("hub", F.lit(False)).alias("hub")))
        parts = first
        if not marked.isEmpty():
            plain = marked.where("not hub").select("id")
            rest = within.join(plain.withColumnRenamed("id", "src"), "src", "left_semi").join(plain.withColumnRenamed("id", "dst"), "dst", "left_semi")
            parts = cut(first.unionByName(parted(marked, rest, "hub")))
        divided = parts.select(F.col("parent").alias("community")).distinct().withColumn("divided", F.lit(True))
        out.append(at_level(inside.join(divided, "community", "left"), F.col("divided").isNull()))
        current, level = parts.select("id", "community"), level + 1
    return reduce(DataFrame.unionByName, out)
