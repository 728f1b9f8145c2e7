"""Rounds of retrieval experiments over one document collection."""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.functions.config import EXPANSIONS, PIPELINES, goal_to_metric
from trialmesh.operators import retrieval as rt
from trialmesh.operators.chunking import build_corpus, chunk_recursive, chunk_token
from trialmesh.session import materialize, scratch

# Words of a description that call for chunks with more overlap, and the two ways of chunking.
VISUAL_WORDS = ("table", "tables", "image", "images", "figure", "figures", "diagram")
VISUAL_CHUNKS = ("recursive", 1200, 200)
PLAIN_CHUNKS = ("token", 1024, 128)

FUSION_KS = tuple(range(10, 81, 10))


@dataclass(frozen=True)
class Setup:
    """One point of the search grid."""

    pipeline: str
    top_k: int
    fusion_k: int
    expansion: str
    prompt_style: str


def chunk_plan(description: str | Column) -> Column:
    """struct<method, size, overlap, add_file_name> for the description of a collection."""
    text = F.lower(F.coalesce(F.col(description) if isinstance(description, str) else description, F.lit("")))
    visual = F.lit(False)
    for word in VISUAL_WORDS:
        visual = visual | text.contains(word)

    def plan(method: str, size: int, overlap: int) -> Column:
        return F.struct(F.lit(method).alias("method"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.lit(True).alias("add_file_name"))
    return F.when(visual, plan(*VISUAL_CHUNKS)).otherwise(plan(*PLAIN_CHUNKS))


def plan_goal(spark, goal: str) -> dict:
    """Metric, prompt style and result counts for a goal text."""
    return spark.range(1).select(goal_to_metric(F.lit(goal)).alias("g")).first()["g"].asDict()


def search_grid(plan: dict) -> list[Setup]:
    """Every setup of a goal: pipeline x result count x fusion constant x expansion x prompt style.

    The fusion constant only matters where lists are fused, so the other pipelines have it once.
    """
    counts = sorted({int(k) for k in plan["top_k"]})
    rows = itertools.product(PIPELINES, counts, FUSION_KS, EXPANSIONS, [plan["prompt_style"], *(s for s in rt.PROMPTS if s != plan["prompt_style"])])
    return [Setup(*row) for row in rows if row[0] == "hybrid_rrf" or row[2] == FUSION_KS[0]]


def next_setups(grid: list[Setup], log: list[tuple[Setup, float | None]], n: int) -> list[Setup]:
    """The ``n`` untried setups that promise most, given the scores of all earlier rounds.

    A setup promises the sum, over its five choices, of the mean score measured with that choice; a choice not
    measured yet counts as the best mean of its kind, so it gets its turn.  Failed experiments count as zero.  Of
    setups that promise the same, the one that differs most from those already picked comes first, then grid order.
    """
    means: dict[tuple[str, object], list[float]] = {}
    for setup, score in log:
        for choice in asdict(setup).items():
            means.setdefault(choice, []).append(score or 0.0)
    known = {choice: sum(v) / len(v) for choice, v in means.items()}
    hopes = {kind: max((m for (k, _), m in known.items() if k == kind), default=0.0) for kind in asdict(grid[0])}
    tried, picked = {setup for setup, _ in log}, []

    def promise(setup: Setup) -> float:
        return round(sum(known.get((kind, value), hopes[kind]) for kind, value in asdict(setup).items()), 12)

    def distance(setup: Setup) -> int:
        own = asdict(setup)
        return sum(own[kind] != value for other in [*tried, *picked] for kind, value in asdict(other).items())
    left = [s for s in grid if s not in tried]
    while left and len(picked) < n:
        top = max(map(promise, left))
        picked.append(max((s for s in left if promise(s) == top), key=distance))
        left.remove(picked[-1])
    return picked


class Collection:
    """The tables all experiments of a run share, each written once.

    Each way of expansion is made once and all its parts are searched together, for the most documents that a setup may
    ask for (``top_k``); a setup takes the first places of the lists of its expansion and pipeline.
    """

    def __init__(self, docs: DataFrame, n_questions: int, seed: int, description: str = "", top_k: int = 10):
        way = docs.sparkSession.range(1).select(chunk_plan(F.lit(description)).alias("p")).first()["p"]
        cut = {"token": chunk_token, "recursive": chunk_recursive}[way["method"]]
        chunks = cut(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), way["size"], way["overlap"])
        self.corpus, self.top_k = materialize(build_corpus(chunks, add_file_name=way["add_file_name"]), "corpus"), top_k
        self.index = materialize(rt.document_index(self.corpus), "index")
        self.qa = materialize(rt.drop_dont_know(rt.synthesize_qa(self.corpus, n_questions, seed, index=self.index)), "qa")
        self.stems = materialize(rt.stem_documents(self.index), "stems")
        self.size = materialize(rt.corpus_size(self.index), "size")
        vectors, self.model = rt.hash_vectors(self.corpus, index=self.index)
        self.vectors = materialize(vectors, "vectors")
        self.qrels = self.qa.select("qid", F.explode("retrieval_gt").alias("doc_id"))
        self.lists = materialize(self._search(), "lists")
        wanted = materialize(self.lists.select("doc_id").distinct(), "wanted")  # at most top_k for each part of a question
        self.passages = materialize(self.corpus.select("doc_id", "contents").join(wanted, "doc_id"), "passages")

    def _search(self) -> DataFrame:
        """way, expansion, qid, doc_id, rank: the lists of each part of the expanded questions."""
        plain = self.qa.select("qid", "query")
        found = rt.expansion_documents(plain, self.corpus, index=self.index, size=self.size)
        parts = None
        for method in EXPANSIONS:
            own = rt.expand_queries(plain, self.corpus, method, index=self.index, size=self.size, found=found)
            own = own.select(F.concat_ws("#", F.lit(method), "qid", "part").alias("qid"), "query")
            parts = own if parts is None else parts.unionByName(own)
        parts = materialize(parts, "parts")
        asked = materialize(rt.hash_vectors(parts, "qid", "query", model=self.model)[0], "asked")
        semantic = rt.vector_topk(asked, self.vectors, self.top_k)
        lexical = rt.bm25_topk(parts, None, self.top_k, stem=True, index=self.stems, size=self.size, index_stemmed=True)
        both = semantic.withColumn("way", F.lit("semantic")).unionByName(lexical.withColumn("way", F.lit("lexical")))
        part = F.split("qid", "#")
        return both.select("way", part[0].alias("expansion"), part[1].alias("qid"), "doc_id", "rank")

    def retrieve(self, setup: Setup) -> DataFrame:
        """Top documents per question: each part of an expanded question searches, the best rank counts."""
        if setup.top_k > self.top_k:
            raise ValueError(f"lists hold {self.top_k} documents, {setup.top_k} are asked for")
        mine = self.lists.where((F.col("expansion") == setup.expansion) & (F.col("rank") <= setup.top_k))
        ways = [way for way, pipelines in (("semantic", ("semantic_only", "hybrid_rrf")), ("lexical", ("lexical_bm25", "hybrid_rrf"))) if setup.pipeline in pipelines]
        lists = [mine.where(F.col("way") == way).groupBy("qid", "doc_id").agg(F.min("rank").alias("rank")) for way in ways]
        return rt.rrf_fuse(lists, setup.fusion_k, setup.top_k).select("qid", "doc_id", "rank")


def evaluate(collection: Collection, setup: Setup) -> dict:
    """Retrieval metrics of a setup, ROUGE-1 of the answers it extracts, and the mean length of its prompts."""
    with scratch(collection.retrieve(setup), "hits") as hits:
        passages = hits.join(collection.passages, "doc_id").join(collection.qa.select("qid", "query"), "qid")
        answers = rt.extract_answers(passages)
        pairs = answers.select("qid", F.col("answer").alias("candidate")).join(
            collection.qa.select("qid", F.col("generation_gt").alias("reference")), "qid")
        scores = rt.retrieval_metrics(hits, collection.qrels).first().asDict()
        scores["rouge"] = rt.rouge(pairs, ["qid"], ["rouge1"]).agg(F.avg("rouge1")).first()[0] or 0.0
        scores["prompt_chars"] = rt.make_prompts(passages, setup.prompt_style).agg(F.avg(F.char_length("prompt"))).first()[0] or 0.0
        return scores


def run_rag_rounds(docs: DataFrame, goal: str, rounds: int = 3, per_round: int = 3, n_questions: int = 24, seed: int = 42,
                   parallel: int = 3, description: str = "") -> DataFrame:
    """Search retrieval setups in rounds; returns the log, one row per experiment (eager).

    ``docs``: doc_id, text.  Every round takes the setups that promise most after all earlier rounds; a setup is
    tried once.  The description of the collection decides how it is cut into chunks.  A goal judged by a language
    model is scored by ROUGE instead.  A round without any success is the last one.
    """
    spark = docs.sparkSession
    plan = plan_goal(spark, goal)
    metric = "rouge" if plan["primary_metric"] == "g_eval" else plan["primary_metric"]
    log, grid = [], search_grid(plan)
    shared = Collection(docs, n_questions, seed, description, max(setup.top_k for setup in grid))

    def attempt(setup: Setup) -> dict:
        try:
            scores = evaluate(shared, setup)
            return {"status": "completed", "score": float(scores[metric]), "metrics": {k: float(v) for k, v in scores.items()}, "error": None}
        except Exception as error:  # a failed experiment is a result of the round
            return {"status": "failed", "score": None, "metrics": {}, "error": str(error)}

    for number in range(1, rounds + 1):
        setups = next_setups(grid, [(setup, row["score"]) for setup, row in log], per_round)
        with ThreadPoolExecutor(parallel) as pool:
            results = list(pool.map(attempt, setups))
        for i, (setup, row) in enumerate(zip(setups, results, strict=True), 1):
            log.append((setup, {"round": number, "experiment_id": f"r{number}_exp{i}", "seq": len(log), "primary_metric": metric, **row}))
        if not any(row["score"] is not None for row in results):
            break
    kind = """round int, experiment_id string, seq int, primary_metric string, status string, score double, metrics map<string,double>, error_summary string,
        pipeline string, top_k int, fusion_k int, query_expansion string, prompt_style string"""
    return spark.createDataFrame([(*row.values(), *asdict(setup).values()) for setup, row in log], kind)
