"""Vector retrieval and graph-augmented retrieval over batches of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.refs import source_ref
from lodestrata.functions.vectors import valid_embedding

#: Question vectors in one block: as many are broadcast; a larger set meets the items block by block.
BLOCK = 1024
#: Items in one part of a block, and cells of results that a task holds before it hands them on.
PART, HELD = 50_000, 2_000_000


def _matrix(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for r, v in enumerate(vectors):
        v = v[:dim]
        out[r, : len(v)] = np.nan_to_num(np.asarray(v, dtype=np.float64))
    return out


def best_of_each(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` largest scores of each row in order, equal ones by name.

    Columns are parted at the k-th largest score; only those from it on are sorted.
    """
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        r, c = np.nonzero(scores >= least[:, None])
    else:
        r, c = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((names[c].astype(str), -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.flatnonzero(np.r_[len(r) > 0, r[1:] != r[:-1]])
    keep = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k
    return r[keep], c[keep]


class _Best:
    """The best ``k`` items of every company for a block of questions."""

    def __init__(self, ids: np.ndarray, vectors: list, k: int):
        self.ids, self.k = ids, k
        self.matrix = _matrix(vectors, max((len(v) for v in vectors), default=0))
        self.best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, items: list, groups: list, vectors: list) -> None:
        x, names = _matrix(vectors, self.matrix.shape[1]), np.array(items, dtype=object)
        order: dict[str, list[int]] = {}
        for r, g in enumerate(groups):
            order.setdefault(g, []).append(r)
        for g, at in order.items():
            scores = np.round(self.matrix @ x[at].T, 10)
            r, c = best_of_each(scores, names[at], self.k)
            q, n, v = r, names[at][c], scores[r, c]
            if g in self.best:
                q, n, v = (np.concatenate(p) for p in zip(self.best[g], (q, n, v)))
                order_ = np.lexsort((n.astype(str), -v, q))
                q, n, v = q[order_], n[order_], v[order_]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < self.k
                q, n, v = q[keep], n[keep], v[keep]
            self.best[g] = q, n, v

    def full(self) -> bool:
        return len(self.best) * len(self.ids) * self.k > HELD

    def flush(self) -> pa.RecordBatch:
        out, self.best = self.best, {}
        q = np.concatenate([v[0] for v in out.values()]) if out else np.zeros(0, dtype=np.int64)
        g = [name for name, v in out.items() for _ in range(len(v[0]))]
        n = [x for v in out.values() for x in v[1]]
        s = np.concatenate([v[2] for v in out.values()]) if out else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q].tolist(), pa.string()), pa.array(g, pa.string()), pa.array(n, pa.string()), pa.array(s, pa.float64())], names=["question_id", "company", "id", "score"])


_SCORED = "question_id string, company string, id string, score double"


def topk_by_company(questions: DataFrame, items: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """(question_id, company, id, score, rank): per question and company the ``k`` items of largest dot product.

    ``questions`` has question_id and embedding, ``items`` id, company and embedding;
    ``asked`` (question_id, company) keeps what is asked only: items of other companies
    aren't scored. Each task keeps its best ``k`` of every company for a block of
    questions, so only those are shuffled. Up to ``BLOCK`` questions are broadcast; more
    are joined with the items by block, within Spark. Scores are rounded to 10 places.
    Null and empty vectors take no part; the dot product runs over the shorter vector;
    equal scores go by id. An id given twice may come out twice.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vectors = questions.select(F.col("question_id").cast("string").alias("question_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid_embedding(F.col("embedding")))
    usable = items.select(F.col("id").cast("string").alias("id"), "company", F.col("embedding").cast("array<double>").alias("embedding")).where(valid_embedding(F.col("embedding")) & F.col("id").isNotNull() & F.col("company").isNotNull())
    if asked is not None:
        usable = usable.join(asked.select("company").distinct(), "company", "left_semi").select("id", "company", "embedding")
    few = vectors.limit(BLOCK + 1).collect()
    if len(few) <= BLOCK:
        shared = usable.sparkSession.sparkContext.broadcast((np.array([r.question_id for r in few], dtype=object), [r.embedding for r in few]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(*shared.value, k)
            for batch in batches:
                best.add(*(c.to_pylist() for c in batch.columns))
                if best.full():
                    yield best.flush()
            yield best.flush()

        out = usable.mapInArrow(run, _SCORED) if few else usable.limit(0).select(F.lit("").alias("question_id"), "company", "id", F.lit(0.0).alias("score"))
    else:
        out = _by_block(vectors, usable, k)
    if asked is not None:
        out = out.join(asked.select(F.col("question_id").cast("string").alias("question_id"), "company").distinct(), ["question_id", "company"], "left_semi")
    w = Window.partitionBy("question_id", "company").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_block(vectors: DataFrame, usable: DataFrame, k: int) -> DataFrame:
    """Every block of questions meets every part of the items in a task of its own; both are of bounded size."""
    blocks, parts = -(-vectors.count() // BLOCK), max(1, -(-usable.count() // PART))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q = vectors.select("question_id", "embedding", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int").alias("block"), every(parts, "part"))
    i = usable.select("id", "company", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(blocks, "block"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_pylist()
        best = _Best(np.array(column(left, "question_id"), dtype=object), column(left, "embedding"), k)
        if left.num_rows and right.num_rows:
            best.add(column(right, "id"), column(right, "company"), column(right, "embedding"))
        return pa.Table.from_batches([best.flush()])

    return q.groupBy("block", "part").cogroup(i.groupBy("block", "part")).applyInArrow(met, _SCORED)


def seed_entities(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entities per question and company, clamped at 0 and rounded; blank names drop out after the cut.

    ``scored`` has question_id, company, name, score and id.
    """
    w = Window.partitionBy("question_id", "company").orderBy(F.col("score").desc(), "id")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .where(F.trim("name") != "")
        .withColumn("score", F.round(F.greatest(F.lit(0.0), F.nanvl("score", F.lit(0.0))), 4))
    )


def tied_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are entities of their company: ``nodes`` has company and name, edges company, source_entity, target_entity."""
    names = nodes.select("company", "name").where(F.trim("name") != "").distinct()
    for end in ("source_entity", "target_entity"):
        edges = edges.join(names.withColumnRenamed("name", end), ["company", end], "left_semi")
    return edges


def rank_relationships(seeds: DataFrame, relationships: DataFrame, k: int) -> DataFrame:
    """The ``k`` best relationships per question and company.

    Of a name seeded twice the lowest score holds. score = weight + 0.03 * combined
    degree + both seed scores + 2 per seeded end; ranked by seeded ends, then score, id.
    Only companies with a seed take part; blank ends don't.

    Edges meet the seeds by their ends alone. One without a seeded end scores the same
    for every question and stands behind all others, so the best 2 ``k`` - 1 of a
    company are enough: less than ``k`` of them are seeded wherever one is needed.
    """
    seed = seeds.groupBy("question_id", "company", "name").agg(F.min("score").alias("seed"))
    asked = seeds.select("question_id", "company").distinct()
    base = F.round(F.coalesce("weight", F.lit(0.0)) + 0.03 * F.coalesce("combined_degree", F.lit(0)), 6)
    plain = F.coalesce("weight", F.lit(0.0)) + 0.03 * F.coalesce("combined_degree", F.lit(0))
    edges = relationships.where((F.trim("source_entity") != "") & (F.trim("target_entity") != ""))
    ends = edges.select("company", "rel_id", F.explode(F.array("source_entity", "target_entity")).alias("name"))
    hits = ends.join(seed, ["company", "name"]).groupBy("question_id", "company", "rel_id").agg(F.count("*").cast("int").alias("hits"), F.sum("seed").alias("boost"))
    seeded = hits.join(edges, ["company", "rel_id"]).withColumn("raw", F.round(plain + F.col("boost") + 2.0 * F.col("hits"), 6)).drop("boost")
    first = Window.partitionBy("company").orderBy(base.desc(), "rel_id")
    others = edges.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 2 * k - 1).drop("_r").join(asked, "company").join(hits, ["question_id", "company", "rel_id"], "left_anti")
    scored = seeded.unionByName(others.withColumn("hits", F.lit(0)).withColumn("raw", base))
    w = Window.partitionBy("question_id", "company").orderBy(F.col("hits").desc(), F.col("raw").desc(), "rel_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round(F.greatest(F.lit(0.0), F.nanvl("raw", F.lit(0.0))), 4))


def page_importance(seeds: DataFrame, ranked: DataFrame) -> DataFrame:
    """(question_id, company, source_file, page_number, importance) from the references of both.

    An entity's reference adds 1 + its score, a relationship's 2 + its score up to 10; repeated references add again.
    """
    give = lambda df, value: df.select("question_id", "company", F.explode("source_refs").alias("ref"), value.alias("part"))
    parts = give(seeds, 1.0 + F.col("score")).unionByName(give(ranked, 2.0 + F.least("score", F.lit(10.0))))
    parsed = parts.withColumn("page", source_ref(F.col("ref"))).where(F.col("page").isNotNull())
    return parsed.groupBy("question_id", "company", F.col("page.source_file").alias("source_file"), F.col("page.page_number").alias("page_number")).agg(F.round(F.sum("part"), 6).alias("importance"))


def evidence_chunks(importance: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` chunks per question and company on the most important pages; all chunks of a page share its importance."""
    pages = chunks.select("company", "source_file", F.col("page_number").cast("bigint").alias("page_number"), "id").distinct()
    met = importance.join(pages, ["company", "source_file", "page_number"])
    w = Window.partitionBy("question_id", "company").orderBy(F.col("importance").desc(), "source_file", "page_number", "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
