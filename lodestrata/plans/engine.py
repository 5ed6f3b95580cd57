"""The engine: questions in, evidence and answers out, over the evidence tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.metrics import judge, token_f1
from lodestrata.functions.text import company_key, is_blank, name_key, normalize_companies, normalized_contains
from lodestrata.operators import context, evaluation, graph_build, pages, reports, retrieval
from lodestrata.plans.hooks import Hooks
from lodestrata.session import cut, ship

# Least and greatest values of request fields.
LIMITS = {"k": (1, 20), "entities": (1, 50), "relationships": (1, 80), "chunks": (1, 20), "max_new_tokens": (64, 2048), "temperature": (0.0, 1.5)}
METHODS = ("basic", "rag", "local", "graph", "global", "drift")


@dataclass
class Engine:
    """Retrieval and evaluation over chunks, entities (with vectors) and relationships.

    ``questions`` of a call have question_id, question and, optionally, companies;
    without known companies a question is asked of all. Of chunks, entities and
    relationships that were loaded again the last row holds, and deleted ones are out.
    """

    spark: SparkSession
    chunks: DataFrame
    entities: DataFrame
    relationships: DataFrame
    companies: DataFrame | None = None
    hooks: Hooks = field(default_factory=Hooks)
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        ship(self.spark)
        self.chunks = graph_build.current_rows(self.chunks, "id").withColumn("company", company_key("company"))

    def _keep(self, name: str, make) -> DataFrame:
        """A table that several calls use, made once."""
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]

    def health(self) -> dict[str, bool]:
        return {"ok": not self.chunks.isEmpty()}

    def list_companies(self) -> DataFrame:
        if self.companies is not None and not self.companies.isEmpty():
            return self.companies.select(company_key("company").alias("company")).where("company <> ''").distinct().orderBy("company")
        return self.chunks.where("company is not null").select("company").distinct().orderBy("company")

    def _check(self, **given: float) -> None:
        for name, value in given.items():
            low, high = LIMITS[name]
            if not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}")

    def _asked(self, questions: DataFrame) -> DataFrame:
        """(question_id, question, company, place) of the companies that each question is asked of."""
        if not questions.where(is_blank(F.col("question"))).isEmpty():
            raise ValueError("a question is empty")
        known = self.list_companies().agg(F.array_sort(F.collect_list("company")).alias("known"))
        wanted = normalize_companies(F.col("companies")) if "companies" in questions.columns else F.array().cast("array<string>")
        rows = questions.withColumn("w", wanted).crossJoin(F.broadcast(known))
        hit = F.filter("w", lambda c: F.array_contains("known", c))
        return rows.select(F.col("question_id").cast("string").alias("question_id"), "question", F.posexplode(F.when(F.size(hit) > 0, hit).otherwise(F.col("known"))).alias("place", "company"))

    def _vectors(self, questions: DataFrame) -> DataFrame:
        return questions.select("question_id", self.hooks.embed(F.col("question")).alias("embedding"))

    def rag(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(question_id, company, id, score, rank) of the most similar chunks."""
        self._check(k=k)
        return retrieval.topk_by_company(self._vectors(questions), self.chunks.select("id", "company", "embedding"), k, self._asked(questions).select("question_id", "company"))

    def nodes(self) -> DataFrame:
        """Entities with their vectors, embedded once: those without a vector by the hook, from their own text."""
        e = graph_build.current_rows(self.entities, "entity_id")
        text = context.entity_text(F.col("entity_name"), F.col("entity_type"), F.col("entity_description"), F.col("degree"))
        own = F.coalesce(F.col("embedding").cast("array<float>"), self.hooks.embed(text)) if "embedding" in e.columns else self.hooks.embed(text)
        make = lambda: e.select(
            F.col("entity_id").alias("id"), company_key("company").alias("company"), name_key("entity_name").alias("name"), F.col("entity_type").alias("type"), F.col("entity_description").alias("description"), "degree", "frequency", own.alias("embedding"), "source_refs"
        )
        return self._keep("nodes", make)

    def edges(self) -> DataFrame:
        """Relationships of a company between two of its entities."""
        end = lambda c: name_key(F.coalesce(c, F.lit(""))).alias(c)
        make = lambda: retrieval.tied_edges(
            graph_build.current_rows(self.relationships, "rel_id", deleted=None).select(
                "rel_id", company_key("company").alias("company"), end("source_entity"), end("target_entity"), F.col("relationship_description").alias("description"), F.col("relationship_weight").alias("weight"), "combined_degree", "source_refs"
            ),
            self.nodes(),
        )
        return self._keep("edges", make)

    def reports(self) -> DataFrame:
        """(company, community, title, report, n_entities) of the communities of each company's graph."""
        return self._keep("reports", lambda: reports.community_reports(self.nodes(), self.edges()))

    def graph_rag(self, questions: DataFrame, entities: int = 8, relationships: int = 20, chunks: int = 5) -> dict[str, DataFrame]:
        """Seed entities, ranked relationships and evidence chunks of each question and company."""
        self._check(entities=entities, relationships=relationships, chunks=chunks)
        nodes = self.nodes()
        top = retrieval.topk_by_company(self._vectors(questions), nodes.select("id", "company", "embedding"), entities, self._asked(questions).select("question_id", "company")).drop("rank")
        seeds = cut(retrieval.seed_entities(top.join(nodes.drop("embedding", "company"), "id"), entities))
        ranked = retrieval.rank_relationships(seeds, self.edges(), relationships)
        found = retrieval.evidence_chunks(retrieval.page_importance(seeds, ranked), self.chunks, chunks)
        return {"entities": seeds, "relationships": ranked, "chunks": found}

    def compare(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Chunks of both methods per question and company, side by side by rank."""
        a = self.rag(questions, k).select("question_id", "company", "rank", F.col("id").alias("rag_id"), F.col("score").alias("rag_score"))
        b = self.graph_rag(questions, chunks=k)["chunks"].select("question_id", "company", "rank", F.col("id").alias("graph_id"), F.col("importance").alias("graph_score"))
        return a.join(b, ["question_id", "company", "rank"], "full")

    def compared_companies(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(question_id, companies) that either method has evidence of: those of the graph first, then others of plain retrieval."""
        of = lambda df, name: df.groupBy("question_id").agg(F.array_sort(F.collect_set("company")).alias(name))
        a, b = of(self.graph_rag(questions, chunks=k)["chunks"], "a"), of(self.rag(questions, k), "b")
        none = F.array().cast("array<string>")
        return a.join(b, "question_id", "full").select("question_id", evaluation.united_companies(F.coalesce("a", none), F.coalesce("b", none)).alias("companies"))

    # Contexts: (question_id, company, context, n_evidence) of each method.

    def _chunk_lines(self, ranked: DataFrame, budget: int) -> DataFrame:
        texts = self.chunks.select("id", "source_file", "page_number", F.coalesce("text", F.lit("")).alias("text"))
        return ranked.select("question_id", "company", "id", "score", "rank").join(texts, "id").withColumn("line", context.chunk_line(F.col("rank"), F.col("source_file"), F.col("page_number"), F.col("score"), F.col("text"), budget))

    def _rag_context(self, questions: DataFrame, k: int, budget: int) -> DataFrame:
        lines = self._chunk_lines(self.rag(questions, k), budget)
        return context.context_blocks(lines, "line", ["question_id", "company"]).select("question_id", "company", "context", F.col("n_items").alias("n_evidence"))

    def _graph_context(self, questions: DataFrame, k: int, budget: int, with_reports: bool) -> DataFrame:
        """Entity, relationship and excerpt lines and, for the local method, the reports of the seeds' communities, within a budget."""
        keys = ["question_id", "company"]
        parts = self.graph_rag(questions, chunks=k)
        entities = parts["entities"].withColumn("line", context.entity_line(F.col("name"), F.col("type"), F.col("degree"), F.col("frequency"), F.col("score"), F.col("source_refs"), F.col("description")))
        edges = parts["relationships"].withColumn("line", context.relationship_line(F.col("source_entity"), F.col("target_entity"), F.col("weight"), F.col("combined_degree"), F.col("score"), F.col("source_refs"), F.col("description")))
        chunks = self._chunk_lines(parts["chunks"].withColumn("score", F.col("importance")), budget)
        whole = context.graph_context(entities, edges, chunks, keys)
        n = parts["entities"].select(*keys).unionByName(parts["relationships"].select(*keys)).unionByName(parts["chunks"].select(*keys)).groupBy(*keys).agg(F.count("*").alias("n_evidence"))
        out = whole.join(n, keys)
        if with_reports:
            near = reports.of_entities(self.reports(), self.nodes(), parts["entities"], budget)
            out = out.join(near, keys, "left").withColumn("context", F.concat("context", F.lit("\n\nReports:\n"), F.coalesce("reports", F.lit("- none")))).drop("reports")
        return out

    def _contexts(self, questions: DataFrame, method: str, k: int, budget: int) -> DataFrame:
        if method in ("basic", "rag"):
            return self._rag_context(questions, k, budget)
        if method in ("local", "graph"):
            return self._graph_context(questions, k, budget, method == "local")
        asked = self._asked(questions)
        rated = reports.rate_reports(asked, self.reports(), self.hooks.rate)
        if method == "global":
            return reports.reduce_reports(rated, budget).select("question_id", F.lit("").alias("company"), "context", "n_evidence")
        # drift: a primer from the best reports, then a local search for the question and for each follow-up that they raise
        best = cut(reports.best_reports(rated, 2))
        follow = best.join(asked, ["question_id", "company"]).select(F.concat_ws("\u0001", "question_id", "company", F.col("rank").cast("string")).alias("question_id"), F.concat_ws(" ", "question", "title").alias("question"), F.array("company").alias("companies"))
        own = questions.select(F.col("question_id").cast("string").alias("question_id"), "question", *(["companies"] if "companies" in questions.columns else [F.lit(None).cast("array<string>").alias("companies")]))
        local = self._graph_context(own.unionByName(follow), k, budget, True)
        found = local.select(F.split("question_id", "\u0001")[0].alias("question_id"), "company", F.coalesce(F.try_element_at(F.split("question_id", "\u0001"), F.lit(3)).cast("int"), F.lit(0)).alias("step"), "context", "n_evidence")
        primer = reports.reduce_reports(best, budget).select("question_id", F.lit("").alias("company"), F.lit(-1).alias("step"), "context", "n_evidence")
        every = primer.unionByName(found)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "company", "context"))), lambda x: x["context"]), "\n\n")
        return every.groupBy("question_id").agg(joined.alias("context"), F.sum("n_evidence").alias("n_evidence")).select("question_id", F.lit("").alias("company"), "context", "n_evidence")

    def answer(self, questions: DataFrame, method: str = "rag", k: int = 5, budget: int = 2200) -> DataFrame:
        """(question_id, answer, n_evidence): the hook's answer from the evidence of a method; without evidence the sentence for none, and no model is asked.

        ``basic`` and ``rag`` take the most similar chunks, ``graph`` entities, relationships
        and chunks of the graph, ``local`` also the reports of its communities, ``global``
        maps all reports to ratings and reduces the best, ``drift`` starts from the best
        reports and searches locally for what they raise.
        """
        if method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        parts = self._contexts(questions, method, k, budget)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("company", "context"))), lambda x: F.when(x["company"] == "", x["context"]).otherwise(F.concat(F.lit("[company="), x["company"], F.lit("]\n"), x["context"]))), "\n\n")
        whole = parts.groupBy("question_id").agg(joined.alias("context"), F.sum("n_evidence").alias("n_evidence"))
        asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question")
        some = F.coalesce("n_evidence", F.lit(0)) > 0
        return asked.join(whole, "question_id", "left").select("question_id", F.when(some, self.hooks.generate(F.col("question"), F.col("context"))).otherwise(F.lit(context.NOT_FOUND)).alias("answer"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))

    def query(self, questions: DataFrame, method: str = "rag", roots: DataFrame | None = None) -> DataFrame:
        """(question_id, answer, returncode, elapsed_seconds, error) of each question.

        With a ``query`` hook each question runs against the root of its company
        (``roots``: company, root); one without a root fails. The engine's own answers
        have code 0, and as time their share of the time that all took together.
        """
        if self.hooks.query is None:
            began = time.perf_counter()
            rows = cut(self.answer(questions, method))
            each = round((time.perf_counter() - began) / max(1, rows.count()), 3)
            return rows.select("question_id", "answer", F.lit(0).alias("returncode"), F.lit(each).alias("elapsed_seconds"), F.lit(None).cast("string").alias("error"))
        company = normalize_companies(F.col("companies")) if "companies" in questions.columns else F.array().cast("array<string>")
        rows = questions.select(F.col("question_id").cast("string").alias("question_id"), "question", F.try_element_at(company, F.lit(1)).alias("company"))
        placed = rows.join(roots.select(company_key("company").alias("company"), "root"), "company", "left") if roots is not None else rows.withColumn("root", F.lit(None).cast("string"))
        known = placed.where("root is not null").withColumn("r", self.hooks.query(F.col("question"), F.col("root"), method)).select("question_id", "r.answer", "r.returncode", "r.elapsed_seconds", "r.error")
        missing = placed.where("root is null").select("question_id", F.lit("").alias("answer"), F.lit(1).alias("returncode"), F.lit(0.0).alias("elapsed_seconds"), F.concat(F.lit("unknown company root: "), F.coalesce("company", F.lit(""))).alias("error"))
        return cut(known.unionByName(missing))

    def compare_companies(self, questions: DataFrame, method: str = "rag", roots: DataFrame | None = None) -> DataFrame:
        """Comparisons fanned out to a sub-question for each of their companies, and their answers made one.

        (question_id, answer, returncode, elapsed_seconds, error, n_companies): a comparison fails if
        one of its companies does, and takes the time of all. ``questions`` may have subquestions (a map by company).
        """
        own = F.col("subquestions") if "subquestions" in questions.columns else None
        some = questions.withColumn("question_id", F.col("question_id").cast("string")).withColumn("companies", normalize_companies(F.col("companies")))
        if not some.where(F.size("companies") < 2).isEmpty():
            raise ValueError("a comparison needs two companies")
        each = some.select("question_id", "question", *(["subquestions"] if own is not None else []), F.posexplode("companies").alias("place", "company"))
        parts = cut(each.select(F.concat_ws("\u0001", "question_id", "company").alias("part_id"), "question_id", "company", "place", evaluation.subquestion(F.col("question"), F.col("company"), own).alias("asked")))
        ran = self.query(parts.select(F.col("part_id").alias("question_id"), F.col("asked").alias("question"), F.array("company").alias("companies")), method, roots)
        met = parts.join(ran.withColumnRenamed("question_id", "part_id"), "part_id")
        sums = evaluation.combine_queries(met.withColumn("elapsed", F.col("elapsed_seconds")), ["question_id"])
        texts = context.company_answers(met, ["question_id"], "place")
        n = met.groupBy("question_id").agg(F.count("*").alias("n_companies"))
        whole = some.select("question_id", "question").join(texts, "question_id").join(sums, "question_id").join(n, "question_id")
        failed = F.when(F.col("any_failed") == 1, F.concat(F.lit("failed for: "), F.col("failed_companies")))
        return whole.select("question_id", self.hooks.synthesise(F.col("question"), F.col("answers")).alias("answer"), F.col("any_failed").alias("returncode"), F.col("elapsed").alias("elapsed_seconds"), failed.alias("error"), "n_companies")

    def evaluate(self, gold: DataFrame, method: str = "rag", grading: str = "token", roots: DataFrame | None = None, reply=None) -> DataFrame:
        """Evaluation rows of gold questions (question_id, question, gold_answer, type, companies and, optionally, company, subquestions).

        Comparisons, by their type or companies, are fanned out; others are asked of their
        companies. ``grading`` is none, token (by the ``judge`` hook) or model, whose
        ``reply`` makes a model's reply of the prompt.
        """
        wide = gold.withColumn("question_id", F.col("question_id").cast("string"))
        single = F.col("company") if "company" in gold.columns else F.lit(None).cast("string")
        wide = cut(wide.withColumn("companies", evaluation.effective_companies(F.col("companies"), single)))
        kind = F.coalesce(evaluation.is_comparison(F.col("companies"), F.col("type")), F.lit(False)) & (F.size(F.array_distinct("companies")) > 1)
        many, one = wide.where(kind), wide.where(~kind)
        cols = ["question_id", "answer", "returncode", "elapsed_seconds", "error"]
        results = None
        for part, run in ((one, self.query), (many, self.compare_companies)):
            if not part.isEmpty():
                got = run(part, method, roots).select(*cols)
                results = got if results is None else results.unionByName(got)
        if results is None:
            raise ValueError("no question is selected")
        rows = wide.join(results, "question_id")
        answer, right = F.coalesce("answer", F.lit("")), F.col("gold_answer")
        if grading == "token":
            j = self.hooks.judge(answer, right)
            graded = rows.withColumn("j", F.struct(j["label"].alias("label"), j["score"].cast("double").alias("score"), F.lit(None).cast("boolean").alias("hallucination"), F.lit("").alias("rationale")))
        else:
            said = reply(context.judge_prompt(F.col("type"), F.array_join("companies", ", "), F.col("question"), right, answer)) if grading == "model" else None
            graded = rows.withColumn("j", judge(grading, answer, right, said))
        f1 = token_f1(answer, right)
        return graded.withColumn("m", f1).select(
            "question_id", F.lit(method).alias("method"), "type", F.coalesce(single, F.array_join("companies", ",")).alias("company"), "question", "gold_answer", "answer", "returncode", F.col("elapsed_seconds").alias("elapsed"), "error",
            "j.label", "j.score", "j.hallucination", "j.rationale", "m.precision", "m.recall", "m.f1", normalized_contains(answer, right).alias("contained"),
        )

    def evaluation_matrix(self, gold: DataFrame, methods: list[str], grading: str = "token", run_dirs: dict[str, str] | None = None, roots: DataFrame | None = None, reply=None) -> DataFrame:
        """One row per method with its run folder and all fields of the summary."""
        rows = None
        for m in methods:
            part = self.evaluate(gold, m, grading, roots, reply).withColumn("run_dir", F.lit((run_dirs or {}).get(m, "-")))
            rows = part if rows is None else rows.unionByName(part)
        return evaluation.method_matrix(rows)

    def split_pages(self, documents: DataFrame, keep_markers: bool = False, zero_pad: int = 3) -> DataFrame:
        return pages.split_pages(documents, "file", "text", keep_markers, zero_pad)
