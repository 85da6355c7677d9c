"""Hybrid search: filtered vector top-k, full text, weighted reciprocal rank fusion, late hydration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import ann, fts
from tessella.operators.filters import Filters
from tessella.sources.corpus import DOC_COLUMNS, VECTOR_FIELDS

SOURCES = (*VECTOR_FIELDS, "fts")


@dataclass(frozen=True)
class SearchRequest:
    """A validated request. ``q_semantic`` and ``q_keywords`` replace ``q`` unless None; empty text does not fall back."""

    q: str | None = None
    q_semantic: str | None = None
    q_keywords: str | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SOURCES, 1.0))
    filters: Filters = field(default_factory=Filters)
    limit: int = 20
    rrf_k: int = 50
    overfetch: int = 4

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 100 or self.rrf_k < 1 or not 1 <= self.overfetch <= 20:
            raise ValueError("limit must be 1-100, rrf_k at least 1, overfetch 1-20")
        if set(self.weights) - set(SOURCES) or any(not 0 <= w <= 10 for w in self.weights.values()):
            raise ValueError(f"weights must be 0-10 for {', '.join(SOURCES)}")

    def enabled(self, mode: str) -> list[str]:
        """The sources to run, in order: those of weight 0 are not even planned."""
        allowed = {"hybrid": SOURCES, "semantic": tuple(VECTOR_FIELDS), "fts": ("fts",)}[mode]
        used = [s for s in allowed if self.weights.get(s, 0) > 0]
        if not used:
            raise ValueError("all weights are 0; nothing to search")
        return used

    def texts(self, used: list[str]) -> tuple[str | None, str | None]:
        sem = self.q_semantic if self.q_semantic is not None else self.q
        kw = self.q_keywords if self.q_keywords is not None else self.q
        if set(used) - {"fts"} and not sem:
            raise ValueError("provide q or q_semantic for vector search")
        if "fts" in used and not kw:
            raise ValueError("provide q or q_keywords for keyword search")
        return sem, kw


def rounded(vector: list[float]) -> list[float]:
    """A query vector as it is sent to a store: 7 places."""
    return [round(float(x), 7) for x in vector]


def vector_rows(docs: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, source, vector) of the vector columns that documents have, in long form."""
    each = [F.struct(F.lit(n).alias("source"), F.col(n).cast("array<double>").alias("vector")) for n in names]
    return docs.select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.source", "x.vector").where("vector is not null")


def vector_scores(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """(doc_id, source, score): the k best of each source in every task, by one matrix product a batch; the best of all are among them.

    Scores are 1 - cosine distance, rounded to 7 places and not clamped. Vectors of another length, with a null in them, or of
    length 0 have no score.
    """
    q = np.asarray([float(x) for x in query])
    q = q / (np.linalg.norm(q) or np.nan)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def best(part: pa.Table) -> pa.Table:
        kept = [one.take(pc.select_k_unstable(one, k, [("score", "descending"), ("doc_id", "ascending")])) for s in pc.unique(part["source"]).to_pylist() if (one := part.filter(pc.equal(part["source"], s))).num_rows]
        return pa.concat_tables(kept) if kept else part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            vectors = batch.column(2)
            whole = pc.equal(pc.list_value_length(vectors), len(q))
            some = batch.filter(whole)
            if not some.num_rows:
                continue
            x = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.round((x @ q) / np.linalg.norm(x, axis=1), 7)
            new = pa.table({"doc_id": some.column(0), "source": some.column(1), "score": score}).filter(pa.array(~np.isnan(score)))
            held = best(new if held is None else pa.concat_tables([held, new]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return rows.select("doc_id", "source", "vector").mapInArrow(run, f"doc_id {kind}, source string, score double")


def vector_lists(rows: DataFrame, names: list[str], query: list[float], k: int) -> DataFrame:
    """(source, place, doc_id, score, rank): the top k of several vector fields, given in long form, by one scan. Exact; ties go by doc_id."""
    scored = vector_scores(rows.where(F.col("source").isin(names)), query, k)
    place = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, SOURCES.index(n))]), F.col("source"))
    by_score = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    ranked = scored.select("source", place.alias("place"), "doc_id", "score").withColumn("rank", F.row_number().over(by_score))  # k rows a task
    return ranked.where(F.col("rank") <= k)


def vector_top(rows: DataFrame, name: str, query: list[float], k: int) -> DataFrame:
    """(doc_id, score): the k most similar documents by one vector field of the long form."""
    return vector_scores(rows.where(F.col("source") == name), query, k).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)


def ranked_list(source: str, rows: DataFrame) -> DataFrame:
    """(source, place, doc_id, score, rank) of one short list of (doc_id, score); ties go by doc_id."""
    by_score = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    one = rows.select(F.lit(source).alias("source"), F.lit(SOURCES.index(source)).alias("place"), "doc_id", "score")
    return one.withColumn("rank", F.row_number().over(by_score))


def fuse(ranks: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """(doc_id, score, ranks, scores, first_place, first_rank): sum of weight / (k + rank), with maps by source for explanation."""
    w = F.create_map(*[F.lit(x) for s, v in weights.items() for x in (s, float(v))])
    used = ranks.where(F.col("source").isin(*[s for s, v in weights.items() if v > 0]))
    return used.groupBy("doc_id").agg(
        F.sum(w[F.col("source")] / (F.lit(k) + F.col("rank"))).alias("score"),
        F.map_from_entries(F.collect_list(F.struct("source", "rank"))).alias("ranks"),
        F.map_from_entries(F.collect_list(F.struct("source", F.round("score", 4)))).alias("scores"),
        F.min(F.struct("place", "rank")).alias("first"),
    )


def searched_text(docs: DataFrame) -> Column:
    """Summary, domain, number and keywords in one text; keywords that aren't promoted are taken from the metadata."""
    keywords = F.col("keywords_search_query") if "keywords_search_query" in docs.columns else F.try_variant_get(F.try_parse_json("metadata"), "$.keywords_search_query", "string")
    return F.concat_ws(" ", "summary", "legal_domain", "process_number", keywords)


def search(
    docs: DataFrame,
    request: SearchRequest,
    mode: str = "hybrid",
    *,
    vector: list[float] | None = None,
    embed: Callable[[str], list[float]] | None = None,
    vectors: DataFrame | VectorIndex | None = None,
    text_index: DataFrame | None = None,
    cap: int | None = None,
    stemmed: bool = True,
) -> DataFrame:
    """Ranked results with per-source scores and ranks, in one plan.

    Each source carries only ids and scores, and documents join at the end to at most ``limit`` ids.
    The filter's ids restrict what is ranked. Equal fused scores keep the order of sources, then of rank.
    ``vector`` is the embedded query, or ``embed`` makes it from the text. ``vectors`` holds the vectors in long form
    (exact search), or is an inverted-file index that is probed; without it they are columns of docs. Text search reads
    summary, domain, number and keywords, from the postings of ``text_index`` if given, else by a scan.
    """
    used = request.enabled(mode)
    sem, kw = request.texts(used)
    named = [s for s in used if s != "fts"]
    if named and vector is None:
        if embed is None:
            raise ValueError("vector search needs a query vector or an embedder")
        vector = embed(sem)  # type: ignore[arg-type]
    filtered = request.filters != Filters()
    kept = docs.where(request.filters.predicate()) if filtered else docs
    fetch = request.limit * request.overfetch
    ranks = None
    if named:
        query = rounded(vector)  # type: ignore[arg-type]
        if isinstance(vectors, VectorIndex):
            ranks = vectors.lists(named, query, fetch, kept.select("doc_id") if filtered else None)
        elif vectors is None:
            ranks = vector_lists(vector_rows(kept, named), named, query, fetch)
        else:
            ranks = vector_lists(vectors.join(kept.select("doc_id"), "doc_id", "left_semi") if filtered else vectors, named, query, fetch)
    if "fts" in used:
        if text_index is None:
            matches = fts.ranked(kept, searched_text(kept), kw, fetch, cap=cap, stemmed=stemmed)
        else:
            matches = fts.ranked_by_index(text_index, kw, fetch, kept=kept if filtered else None, ids=docs, cap=cap, stemmed=stemmed)
        found = ranked_list("fts", matches)
        ranks = found if ranks is None else ranks.unionByName(found)
    weights = dict.fromkeys(used, 1.0) if mode == "fts" else {s: request.weights[s] for s in used}
    fused = fuse(ranks, weights, request.rrf_k)
    order = [F.desc(F.round("score", 12)), F.col("first.place"), F.col("first.rank")]
    top = fused.orderBy(*order).limit(request.limit).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # at most 100 rows
    found = hydrate(top.select("place", "doc_id", "score", "ranks", "scores"), docs)
    hybrid = F.round("score", 6) if mode == "hybrid" or mode == "semantic" and len(used) > 1 else F.lit(None).cast("double")
    sims = F.map_filter("scores", lambda s, _: s != "fts")
    return found.select(
        "place", *[c for c in DOC_COLUMNS if c in docs.columns], F.when(F.size(sims) > 0, sims).alias("similarity_scores"), F.col("scores")["fts"].alias("fts_rank"), hybrid.alias("hybrid_score"), F.col("ranks").alias("source_ranks")
    ).orderBy("place")


class VectorIndex:
    """Vectors in long form stored by source and nearest centroid, and how many lists a search looks into at first."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, probes: int) -> None:
        self.rows, self.centres, self.probes = rows, centres, probes

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int, probes: int) -> VectorIndex:
        """The index of (doc_id, source, vector) rows, written partitioned by source and list; every vector is in it."""
        centres = ann.centroids(rows, "vector", lists)
        ann.index(rows, "vector", centres).write.partitionBy("source", "list").parquet(path)
        return cls(rows.sparkSession.read.parquet(path), centres, probes)

    def near(self, query: list[float], probes: int) -> DataFrame:
        """The rows of the lists nearest to a query: the other lists' files are not read."""
        order = np.argsort(-(self.centres @ np.asarray(query, float)), kind="stable")[:probes]
        return self.rows.where(F.col("list").isin([int(i) for i in order]))

    def lists(self, names: list[str], query: list[float], k: int, kept: DataFrame | None = None) -> DataFrame:
        """As ``vector_lists`` over the probed lists. Where a filter leaves a source fewer than k rows there, twice as many lists are probed, up to all."""
        probes = self.probes
        while True:
            rows = self.near(query, probes)
            out = vector_lists(rows if kept is None else rows.join(kept, "doc_id", "left_semi"), names, query, k)
            if kept is None or probes >= len(self.centres):
                return out
            got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}  # a row per source
            if all(got.get(n, 0) >= k for n in names):
                return out
            probes *= 2


def hydrate(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked ids (at most 100, so broadcast) with their documents; ids without one are skipped."""
    return docs.select(*[c for c in DOC_COLUMNS if c in docs.columns]).join(F.broadcast(ids), "doc_id")


def lookup(docs: DataFrame, doc_id: object) -> DataFrame:
    """One document; an empty result where there is none."""
    return docs.where(F.col("doc_id") == F.lit(doc_id)).select(*[c for c in DOC_COLUMNS if c in docs.columns])
