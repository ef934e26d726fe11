"""Rank fusion, reranking and the composed retriever."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.text import words
from pandekt.operators.dense import dense_topk
from pandekt.operators.embedding import embed
from pandekt.operators.graph import expand_one_hop
from pandekt.operators.ordered import top_k
from pandekt.operators.search_index import SearchIndex
from pandekt.operators.sparse import sparse_topk
from pandekt.session import cut_lineage, prepare

RRF_K = 60
MODES = ("dense", "hybrid", "sparse")


def rrf(rank: Column, rrf_k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(rrf_k) + rank)


def fuse(rankings: DataFrame, k: int, rrf_k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of (qid, source, rank, chunk_id) rows; top k per question."""
    prepare(rankings.sparkSession)
    scored = rankings.groupBy("qid", "chunk_id").agg(F.round(F.sum(rrf(F.col("rank"), rrf_k)), digits).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")


def fuse_sources(rankings: DataFrame, k: int, rrf_k: int = RRF_K, payload: str | None = None, digits: int = 9) -> DataFrame:
    """Fusion that keeps the payload of the first source (smallest source_pos)."""
    if k <= 0 or rrf_k <= 0:
        raise ValueError("k and rrf_k must be > 0")
    extra = [F.min_by(F.col(payload), F.struct("source_pos", "rank")).alias(payload)] if payload else []
    scored = rankings.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(rrf(F.col("rank"), rrf_k)), digits).alias("score"), *extra,
    )
    cols = ["qid", "rank", "chunk_id", "score"] + ([payload] if payload else [])
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select(*cols)


def fusion_trace(rankings: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Per (qid, chunk): ordered contributions (source, rank, partial score).

    The list holds one entry per source, so its length is the source count.
    """
    return rankings.groupBy("qid", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("source_pos", "rank", "source", rrf(F.col("rank"), rrf_k).alias("partial")))).alias("contributions"),
    )


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def overlap_f1(query: Column, passage: Column) -> Column:
    """Default scorer: F1 of the two word sets."""
    # Both sets go through a one-element array so each text is split once.
    pair = F.array(F.struct(word_set(query).alias("a"), word_set(passage).alias("b")))
    return F.transform(pair, lambda p: F.when(
        F.size(p["a"]) + F.size(p["b"]) > 0, 2.0 * F.size(F.array_intersect(p["a"], p["b"])) / (F.size(p["a"]) + F.size(p["b"])),
    ).otherwise(F.lit(0.0)))[0]


Scorer = Callable[[Column, Column], Column]


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, scorer: Scorer = overlap_f1,
           qid: str = "qid", qtext: str = "text", chunk_id: str = "chunk_id", text: str = "text",
           max_chars: int | None = None, digits: int = 6) -> DataFrame:
    """Rescore (question, passage) pairs and keep the best k, re-ranked from 1.

    ``scorer`` builds the score column; pass a ``pandas_udf`` to use a model.
    ``max_chars`` limits the passage the scorer sees where a model needs it.
    Equal scores keep their previous order.

    The narrow hits are written first. With their size known Spark sends them to
    the tasks that read the passages when they are few, and pairs are scored
    there: of a passage only its scores are shuffled.
    """
    hits = cut_lineage(hits.select("qid", "rank", "chunk_id"))
    passage = F.col("_passage") if max_chars is None else F.substring(F.col("_passage"), 1, max_chars)
    pairs = hits.join(queries.select(F.col(qid).alias("qid"), F.col(qtext).alias("_query")), "qid").join(
        chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(text).alias("_passage")), "chunk_id",
    )
    scored = pairs.select("qid", "chunk_id", F.col("rank").alias("_prev"), F.round(scorer(F.col("_query"), passage), digits).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("_prev")], k).select("qid", "rank", "chunk_id", "score")


def stored(index: SearchIndex | None) -> dict[str, DataFrame]:
    """Options of ``sparse_topk`` that make it search a stored index."""
    return {} if index is None else {"postings": index.postings, "stats": index.stats, "frequencies": index.frequencies}


def own_depth(hits: DataFrame, queries: DataFrame, depth: Column | None) -> DataFrame:
    """Hits up to the depth of their question: a column of ``queries``, none for all."""
    if depth is None:
        return hits
    return hits.join(queries.select("qid", depth.alias("_depth")), "qid").filter(F.col("rank") <= F.col("_depth")).drop("_depth")


def hybrid_topk(queries: DataFrame, chunks: DataFrame, k: int, filter_doc: str | None = None,
                rrf_k: int = RRF_K, qvec: str = "vec", cvec: str = "vec", depth: Column | None = None, **sparse_options) -> DataFrame:
    """Dense and BM25 arms, each max(2k, 1) deep, fused by reciprocal rank.

    With ``depth``, a column of at most k, a question has arms of twice its own
    depth; all questions still share one search per arm.
    """
    arms = max(2 * k, 1)
    dense = dense_topk(queries, chunks, arms, qvec=qvec, cvec=cvec, filter_doc=filter_doc).withColumn("source", F.lit("dense"))
    sparse = sparse_topk(queries, chunks, arms, filter_doc=filter_doc, **sparse_options).withColumn("source", F.lit("sparse"))
    both = own_depth(dense.unionByName(sparse), queries, None if depth is None else 2 * depth)
    return own_depth(fuse(both, k, rrf_k), queries, depth)


def check_arguments(k: int, mode: str, rerank_k: int | None) -> None:
    if k <= 0:
        raise ValueError(f"k must be > 0 (got {k})")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {list(MODES)} (got {mode!r})")
    if rerank_k is not None and rerank_k < k:
        raise ValueError(f"rerank_k ({rerank_k}) must be >= k ({k})")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 10, mode: str = "hybrid", rerank_k: int | None = None,
             edges: DataFrame | None = None, max_expansions: int = 5, filter_doc: str | None = None,
             aliases: dict[str, list[str]] | None = None, encoder=None, scorer: Scorer = overlap_f1,
             rrf_k: int = RRF_K, index: SearchIndex | None = None, depth: str | None = None, rerank_depth: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Answer many questions at once.

    queries(qid, text[, filter]), chunks(chunk_id, doc_urn, text[, vec]);
    returns hits(qid, rank, chunk_id, score) and, when ``edges`` are given,
    one-hop expansions. Alias expansion of the question always comes first;
    ``aliases=None`` uses the default table, an empty one expands nothing.
    With a stored ``index`` the texts of ``chunks`` are read for reranking only.
    ``depth`` names a question column with its own number of hits, at most k:
    the result is that of a search per depth, from one search. ``rerank_depth``
    is then how deep a question is searched before reranking, at most
    ``rerank_k`` and at least its depth (default: ``rerank_k``).
    """
    from pandekt.operators.understanding import expand_terms

    check_arguments(k, mode, rerank_k)
    prepare(queries.sparkSession)
    q = queries.withColumn("text", expand_terms(F.col("text"), aliases))
    own = None if depth is None else F.col(depth)
    # Before reranking a question is searched at least ``rerank_k`` deep.
    deep = k if rerank_k is None else rerank_k
    first = own if own is None or rerank_k is None else F.greatest(own, F.lit(rerank_k if rerank_depth is None else rerank_depth))
    c = chunks if index is None else index.vectors.withColumn("text", F.lit(None).cast("string"))
    if mode != "sparse":
        q = q if "vec" in q.columns else embed(q, encoder=encoder)
        c = c if "vec" in c.columns else embed(c, encoder=encoder)
    if mode == "dense":
        hits = own_depth(dense_topk(q, c, deep, filter_doc=filter_doc), q, first)
    elif mode == "sparse":
        hits = own_depth(sparse_topk(q, c, deep, filter_doc=filter_doc, **stored(index)), q, first)
    else:
        hits = hybrid_topk(q, c, deep, filter_doc=filter_doc, rrf_k=rrf_k, depth=first, **stored(index))
    if rerank_k is not None:
        hits = own_depth(rerank(hits, q, chunks, k, scorer), q, own)
    if edges is None:
        return hits, None
    # At most k rows per question: written once instead of retrieving again for every use.
    hits = cut_lineage(hits)
    return hits, expand_one_hop(hits, edges, max_expansions)


def _fanned(queries: DataFrame, glossary: DataFrame, subqueries: DataFrame, k_per_norm: int, k_global: int) -> DataFrame:
    """Sub-queries of questions that name several laws: (key, source_pos, doc_urn, text, depth)."""
    from pandekt.operators.understanding import fan_out

    fanned = cut_lineage(fan_out(queries, glossary))
    own = fanned.join(subqueries.select("qid", "norm_id", "text"), ["qid", "norm_id"]).withColumn("depth", F.lit(k_per_norm))
    overall = fanned.filter(F.col("norm_id").isNull()).join(queries.select("qid", "text"), "qid").withColumn("depth", F.lit(k_global))
    kept = [F.struct("qid", "source").alias("_key"), "source_pos", "doc_urn", "text", "depth"]
    return own.select(*kept).unionByName(overall.select(*kept))


def _search_fanned(asked: DataFrame, chunks: DataFrame, deepest: int, mode: str, rerank_k: int | None, options: dict) -> DataFrame:
    """One search for all sub-queries, each in its own document and to its own depth."""
    # The sub-query key travels as text, because search works on plain ids.
    asked = cut_lineage(asked.select(F.to_json("_key").alias("qid"), "source_pos", "doc_urn", "text", "depth", "_key"))
    deep = None if rerank_k is None else max(rerank_k, deepest)
    if deep is not None:
        # Each sub-query goes as deep before reranking as it would alone.
        options = options | {"rerank_depth": rerank_k}
    hits = retrieve(asked.select("qid", "text", "doc_urn", "depth"), chunks, deepest, mode, rerank_k=deep, filter_doc="doc_urn", depth="depth", **options)[0]
    back = hits.withColumnRenamed("qid", "_sub").join(asked.select(F.col("qid").alias("_sub"), "source_pos", "_key"), "_sub")
    return back.select("_key.qid", "_key.source", "source_pos", "rank", "chunk_id", "score")


def cross_rankings(queries: DataFrame, chunks: DataFrame, glossary: DataFrame, subqueries: DataFrame, k_per_norm: int = 5,
                   k_global: int = 5, mode: str = "hybrid", rerank_k: int | None = None, **options) -> DataFrame:
    """Rankings of every sub-query of questions that name several laws.

    queries(qid, text, entities), subqueries(qid, norm_id, text). All
    sub-queries of all questions are searched together, each restricted to
    its law, next to the unrestricted original question. A law whose
    sub-query has no text yet is left out (see ``resolve_completions``).
    """
    asked = _fanned(queries, glossary, subqueries, k_per_norm, k_global)
    return _search_fanned(asked, chunks, max(k_per_norm, k_global), mode, rerank_k, options)


def retrieve_cross(queries: DataFrame, chunks: DataFrame, glossary: DataFrame, subqueries: DataFrame, k_per_norm: int = 5, k_global: int = 5,
                   k_final: int = 20, rrf_k: int = RRF_K, mode: str = "hybrid", rerank_k: int | None = None,
                   patterns: list[tuple[str, str]] | None = None, **options) -> DataFrame:
    """Questions naming two or more laws are fanned out and fused, the others searched as they are.

    Both kinds go into one search: the corpus is read once.
    """
    from pandekt.operators.understanding import detect_entities, route

    for name, value in (("k_per_norm", k_per_norm), ("k_global", k_global), ("k_final", k_final), ("rrf_k", rrf_k)):
        if value <= 0:
            raise ValueError(f"{name} must be > 0 (got {value})")
    q = queries.select("qid", "text").withColumn("entities", detect_entities(F.col("text"), patterns))
    q = cut_lineage(q.withColumn("path", route(F.col("entities"))))
    plain = q.filter("path = 'fallback'").select(F.struct("qid", F.lit("plain").alias("source")).alias("_key"), F.lit(0).alias("source_pos"), F.lit(None).cast("string").alias("doc_urn"), "text", F.lit(k_final).alias("depth"))
    asked = _fanned(q.filter("path = 'multi'"), glossary, subqueries, k_per_norm, k_global).unionByName(plain)
    ranked = cut_lineage(_search_fanned(asked, chunks, max(k_per_norm, k_global, k_final), mode, rerank_k, options))
    fused = fuse_sources(ranked.filter("source <> 'plain'"), k_final, rrf_k).withColumn("path", F.lit("multi"))
    alone = ranked.filter("source = 'plain'").select("qid", "rank", "chunk_id", "score").withColumn("path", F.lit("fallback"))
    return fused.unionByName(alone)


def compare_modes(hits: DataFrame, marks: DataFrame, setups: list[str], depth: int) -> DataFrame:
    """Rank of marked chunks per setup: (qid, chunk_id, marks..., one column per setup).

    ``hits`` carry a ``setup`` column; ``marks`` are (qid, chunk_id, flags...).
    """
    flags = [c for c in marks.columns if c not in ("qid", "chunk_id")]
    ranked = hits.filter(F.col("rank") <= depth).join(marks, ["qid", "chunk_id"])
    return ranked.groupBy("qid", "chunk_id", *flags).pivot("setup", setups).agg(F.min("rank"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
