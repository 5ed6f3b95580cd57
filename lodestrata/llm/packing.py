"""Filling fixed-capacity containers with items (problem 9).

Only the histogram of lengths goes to the driver: it has at most as many
entries as the capacity. Shallow combinations of lengths that fill a window
(the container, or half of it) are enumerated over coarse steps; non-negative
least squares finds how often to repeat each so that the histogram is used up;
the counts are rounded down and what remains is packed best-fit decreasing at
exact lengths. Items then find their place in the plan by their rank among the
items of their length, counted by a range-partitioned sort and prefix sums.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.tokenize import token_counts
from lodestrata.session import cut

#: Steps that the capacity is divided into for the combinations, and lengths in one at most.
STEPS, DEPTH = 256, 3
#: A plan: (length -> how many in a container, number of such containers).
Plan = list[tuple[dict[int, int], int]]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with the least squares of a x - b, by an active set."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        on[j] = True
        while True:
            at = np.flatnonzero(on)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if len(at) == 0 or s.min() > 1e-12:
                break
            low = s <= 1e-12
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            off = at[low & (x[at] <= 1e-9)]
            if not len(off):
                off = at[[int(np.argmin(np.where(low, x[at], np.inf)))]]
            x[off] = 0
            on[off] = False
        x[:] = 0
        x[at] = s
    return x


def combinations(steps: list[int], window: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` of the given step counts that sum to ``window``."""
    have = set(steps)
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, chosen: tuple[int, ...]) -> None:
        if left == 0:
            out.append(chosen)
        elif len(chosen) == depth - 1:
            if left <= most and left in have:
                out.append((*chosen, left))
        elif len(chosen) < depth:
            for s in steps[: bisect_right(steps, min(left, most))]:
                if s * (depth - len(chosen)) >= left:
                    grow(left - s, s, (*chosen, s))

    grow(window, window, ())
    return out


def plan_containers(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    """Contents of containers that hold every item of ``histogram`` (lengths 1 to ``capacity``) once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: Plan = []
    if full := left.pop(capacity, 0):
        plan.append(({capacity: 1}, full))
    size = -(-capacity // steps)
    window = capacity // size
    coarse: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        coarse.setdefault(-(-n // size), []).append(n)
    bins = sorted(coarse)
    columns = [(c, 1) for c in combinations(bins, window)] + [(c, 2) for c in combinations(bins, window // 2)]
    if columns:
        row = {s: k for k, s in enumerate(bins)}
        a = np.zeros((len(bins), len(columns)))
        for j, (c, _) in enumerate(columns):
            for s in c:
                a[row[s], j] += 1
        b = np.array([sum(left[n] for n in coarse[s]) for s in bins], dtype=np.float64)
        scale = b.max()
        x = nnls(a, b / scale) * scale
        for j in np.argsort(-x):
            times = int(x[j] + 1e-6)
            if times < 1:
                break
            c, copies = columns[j]
            _repeat(plan, left, coarse, c * copies, times // copies)
    _best_fit(plan, left, capacity)
    return plan


def _repeat(plan: Plan, left: dict[int, int], coarse: dict[int, list[int]], steps: tuple[int, ...], times: int) -> None:
    """Up to ``times`` containers with one item of each of ``steps``, of the longest lengths that remain."""
    need: dict[int, int] = {}
    for s in steps:
        need[s] = need.get(s, 0) + 1
    times = min([times, *(sum(left.get(n, 0) for n in coarse[s]) // k for s, k in need.items())])
    while times > 0:
        contents: dict[int, int] = {}
        for s in steps:
            n = next(n for n in coarse[s] if left.get(n, 0) > contents.get(n, 0))
            contents[n] = contents.get(n, 0) + 1
        some = min([times, *(left[n] // k for n, k in contents.items())])
        for n, k in contents.items():
            left[n] -= k * some
        plan.append((contents, some))
        times -= some


def _best_fit(plan: Plan, left: dict[int, int], capacity: int) -> None:
    """The rest, longest first, each into the open containers that it fills best."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, contents: dict[int, int], count: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((contents, count))

    for n in sorted((k for k, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                per = capacity // n
                whole, part = divmod(count, per)
                if whole:
                    put(capacity - per * n, {n: per}, whole)
                if part:
                    put(capacity - part * n, {n: part}, 1)
                break
            room = rooms[k]
            contents, have = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            per = min(room // n, count)
            used = min(have, count // per)
            if have > used:
                put(room, contents, have - used)
            put(room - per * n, contents | {n: contents.get(n, 0) + per}, used)
            count -= per * used
    for room in rooms:
        plan.extend(open_[room])


def _slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, first container, items per container of each entry of the plan."""
    slots: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for contents, count in plan:
        for n, per in contents.items():
            starts, bases, pers = slots.setdefault(n, ([], [], []))
            starts.append(taken.get(n, 0))
            bases.append(first)
            pers.append(per)
            taken[n] = taken.get(n, 0) + per * count
        first += count
    return {n: tuple(np.array(v, dtype=np.int64) for v in s) for n, s in slots.items()}


def pack(items: DataFrame, id_col: str, length_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, start_at, length, container_id) of every piece of every item.

    * An item beyond ``capacity`` is cut into full pieces and a rest; no other is cut.
    * Items of length 0, or without a length, take no room: one row, container_id null.
    * Repeated and null ids are items of their own. No container holds more than
      ``capacity``; the same items give the same containers. Other columns are not read.
    """
    src = items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    cap = F.lit(capacity).cast("long")
    pieces = (
        src.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / cap) - 1, F.lit(0).cast("long")))))
        .select("id", (F.col("k") + 1).cast("int").alias("piece_no"), (F.col("k") * cap).alias("start_at"), F.least(cap, F.col("n") - F.col("k") * cap).alias("length"))
    )
    order = ["length", "id", "piece_no"]
    ordered = cut(pieces.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = ordered.groupBy(F.spark_partition_id().alias("pid"), "length").agg(F.count("*").alias("n")).orderBy("pid", "length").collect()
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in counts:
        before[r.pid, r.length] = histogram.get(r.length, 0)
        histogram[r.length] = before[r.pid, r.length] + r.n
    slots = _slots(plan_containers({n: c for n, c in histogram.items() if n > 0}, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            container = np.full(len(lengths), -1, dtype=np.int64)
            edges = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1], True])
            for lo, hi in zip(edges[:-1], edges[1:]):
                n = int(lengths[lo])
                if n > 0:
                    done = seen.get(n, before[pid, n])
                    rank = np.arange(done, done + hi - lo)
                    seen[n] = done + int(hi - lo)
                    starts, bases, pers = slots[n]
                    at = np.searchsorted(starts, rank, side="right") - 1
                    container[lo:hi] = bases[at] + (rank - starts[at]) // pers[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(container, pa.int64(), mask=container < 0)], names=[*batch.schema.names, "container_id"])

    out = T.StructType([*ordered.schema.fields, T.StructField("container_id", T.LongType())])
    return ordered.mapInArrow(run, out).withColumnRenamed("id", id_col)


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """``pack`` of texts by their tokens of a public tokenizer; starts and lengths are in tokens. Texts are encoded once."""
    return pack(cut(token_counts(df, id_col, text_col, vocabulary)), id_col, "n_tokens", capacity)
