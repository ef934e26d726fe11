"""Gold candidate mining: hints, terms and retrieval hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.ids import base_id
from pandekt.functions.text import count_occurrences
from pandekt.operators.ordered import top_k
from pandekt.session import cut_lineage

#: Characters of the grams through which pieces of terms find the words that hold them.
GRAM = 4
PIECES = r"[\s\x0B\p{Z}]+|[^\s\x0B\p{Z}]+"


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of exactly ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def term_occurrences(chunks: DataFrame, terms: DataFrame, chunk_id: str = "chunk_id", text: str = "text", term: str = "term") -> DataFrame:
    """(chunk_id, term, n, n_words) for every term found in a chunk, without case and also inside words.

    A join, so the number of terms doesn't matter: of every term the longest run
    without (or of) white space must lie within one such run of a text. Those
    runs of all texts, each once, meet the terms' runs by the rarest of its
    grams; a run that holds one leads to its chunks, and only these (chunk,
    term) pairs are counted in the text.
    """
    distinct = terms.select(F.lower(F.col(term)).alias("term")).filter(F.length("term") > 0).distinct()
    base = chunks.select(F.col(chunk_id).alias("chunk_id"), F.lower(F.col(text)).alias("_t"))
    held = base.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(PIECES), F.lit(0)))).alias("run"))
    runs = cut_lineage(held.select("run").distinct())
    longest = F.array_max(F.transform(F.regexp_extract_all("term", F.lit(PIECES), F.lit(0)), lambda p: F.struct(F.length(p).alias("n"), p.alias("piece"))))
    pieces = cut_lineage(distinct.select("term", longest["piece"].alias("piece")))
    # Short pieces are grams of their own length.
    asked = pieces.select("piece").distinct().withColumn("size", F.least(F.length("piece"), F.lit(GRAM)))
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())
    if not sizes:
        return base.select("chunk_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_words")).limit(0)
    wanted = asked.select("piece", F.explode(_grams(F.col("piece"), F.col("size"))).alias("gram"))
    grams = runs.select("run", F.explode(F.flatten(F.array(*[F.when(F.length("run") >= n, _grams(F.col("run"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes]))).alias("gram"))
    grams = cut_lineage(grams.join(wanted.select("gram").distinct(), "gram", "left_semi"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A piece with a gram that no run has occurs nowhere.
    rarest = wanted.join(often, "gram", "left").groupBy("piece").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0").select("piece", F.col("g.gram").alias("gram"))
    met = rarest.join(grams, "gram").filter(F.col("run").contains(F.col("piece"))).select("piece", "run")
    found = held.join(met, "run").join(pieces, "piece").select("chunk_id", "term").distinct()
    # The narrow pairs are written, so that Spark knows their size before it joins the texts.
    sized = base.withColumn("n_words", F.greatest(F.lit(1), F.size(F.filter(F.split("_t", r"[\s\x0B\p{Z}]+"), lambda w: w != ""))).cast("long"))
    counted = cut_lineage(found).join(sized, "chunk_id").select("chunk_id", "term", count_occurrences(F.col("_t"), F.col("term")).alias("n"), "n_words")
    return counted.filter("n > 0")


def term_frequency_rank(chunks: DataFrame, terms: DataFrame, n: int = 10, qid: str = "qid", term: str = "term",
                        digits: int = 9) -> DataFrame:
    """Top ``n`` chunks per (question, term) by occurrences per word."""
    wanted = terms.select(F.col(qid).alias("qid"), F.col(term).alias("_shown"), F.lower(F.col(term)).alias("term"))
    found = term_occurrences(chunks, terms, term=term)
    scored = found.withColumn("score", F.round(F.col("n") / F.col("n_words"), digits))
    # Rank once per distinct term, then attach the questions asking for it.
    ranked = top_k(scored, ["term"], [F.desc("score"), F.desc("n"), F.asc("chunk_id")], n)
    return ranked.join(wanted, "term").select("qid", F.col("_shown").alias("term"), "rank", "chunk_id", "n", "score")


def match_hints(hints: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """hints(qid, doc_urn, suffix): article hints also match the split children.

    The prefix test becomes an equi-join on the id without its split suffix.
    """
    target = F.concat_ws("__", "doc_urn", "suffix")
    h = hints.withColumn("_target", target)
    # A child id is matched through its base, an unsplit id through itself.
    ids = chunks.select(F.col(chunk_id).alias("chunk_id"))
    keyed = ids.select("chunk_id", F.col("chunk_id").alias("_target"), F.lit(False).alias("_child")).unionByName(
        ids.filter(base_id(F.col("chunk_id")) != F.col("chunk_id")).select(
            "chunk_id", base_id(F.col("chunk_id")).alias("_target"), F.lit(True).alias("_child")))
    hit = h.join(keyed, "_target")
    return hit.filter(~F.col("_child") | F.col("suffix").startswith("art_")).select(
        "qid", "doc_urn", "suffix", "chunk_id",
    ).distinct()


def mine_candidates(chunks: DataFrame, hint_hits: DataFrame, term_hits: DataFrame, retrieval_hits: DataFrame | None = None,
                    excerpt: int = 250) -> DataFrame:
    """One row per (question, chunk): how it was found, hint-backed first.

    hint_hits(qid, chunk_id, label), term_hits(qid, chunk_id, term),
    retrieval_hits(qid, chunk_id, rank). Without retrieval hits the other two
    sources still give a result. ``found_via`` holds one entry per strategy
    match, so its length is bounded by the hints and terms of a question.
    """
    found = hint_hits.select("qid", "chunk_id", F.lit(0).alias("_s"), F.concat(F.lit("hint:"), "label").alias("_via"))
    found = found.unionByName(term_hits.select("qid", "chunk_id", F.lit(1).alias("_s"), F.concat(F.lit("term:"), "term").alias("_via")))
    if retrieval_hits is not None:
        found = found.unionByName(retrieval_hits.select(
            "qid", "chunk_id", F.lit(2).alias("_s"), F.concat(F.lit("hybrid:rank="), F.col("rank").cast("string")).alias("_via")))
    per = found.distinct().groupBy("qid", "chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_s", "_via"))), lambda x: x["_via"]).alias("found_via"),
    )
    return per.withColumn("hint_backed", F.exists("found_via", lambda v: v.startswith("hint:"))).join(
        chunks.select("chunk_id", F.substring("text", 1, excerpt).alias("text_excerpt")), "chunk_id",
    ).select("qid", "chunk_id", "hint_backed", "found_via", "text_excerpt")


__all__ = ["term_occurrences", "term_frequency_rank", "match_hints", "mine_candidates", "count_occurrences"]
