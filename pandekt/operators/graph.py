"""One-hop graph expansion of retrieval hits and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.operators.ordered import top_k
from pandekt.session import cut_lineage


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every link: (node, neighbor, relation, note, link_pos, dir)."""
    extra = ["relation", "note", "link_pos"]
    out = edges.select(F.col("from_chunk").alias("node"), F.col("to_chunk").alias("neighbor"), *extra, F.lit(0).alias("dir"))
    back = edges.select(F.col("to_chunk").alias("node"), F.col("from_chunk").alias("neighbor"), *extra, F.lit(1).alias("dir"))
    return out.unionByName(back)


def adjacency_lists(edges: DataFrame, need: int, parallel: bool = True) -> DataFrame:
    """(node, near): per node its first ``need`` neighbours by id, each with the details of its first link.

    Links of a node to itself are left out. Without ``parallel`` links no two
    nodes have more than one, so none need to be compared.
    """
    details = ["relation", "note", "link_pos"]
    links = edges.select(F.inline(F.array(
        F.struct(F.col("from_chunk").alias("node"), F.col("to_chunk").alias("neighbor"), *details, F.lit(0).alias("dir")),
        F.struct(F.col("to_chunk").alias("node"), F.col("from_chunk").alias("neighbor"), *details, F.lit(1).alias("dir")),
    ))).filter(F.col("node") != F.col("neighbor"))
    if parallel:
        links = links.groupBy("node", "neighbor").agg(F.min_by(F.struct("relation", "note"), F.struct("link_pos", "dir")).alias("_l")).select(
            "node", "neighbor", "_l.relation", "_l.note")
    # Ranked limits are applied before the shuffle as well, so a hub sends no more than ``need`` rows per task.
    first = top_k(links.select("node", "neighbor", "relation", "note"), ["node"], [F.asc("neighbor")], need, "_nth")
    return first.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("neighbor", "relation", "note"))).alias("near"))


def question_walks(hits: DataFrame) -> DataFrame:
    """(qid, _own, _ranks): the hits of every question and their ranks, best first."""
    walk = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").alias("node")))).alias("_w"))
    return walk.select("qid", F.col("_w.node").alias("_own"), F.col("_w.rank").alias("_ranks"))


def first_expansions(walks: DataFrame, lists: DataFrame, max_expansions: int) -> DataFrame:
    """(qid, expanded_from, source_rank, _new, _own, _ranks): what the list of a question's best hit gives.

    A question that needs more lists has no ``_new`` but its hits, the others have no hits left.
    """
    met = walks.withColumn("node", F.col("_own")[0]).join(lists, "node", "left")
    new = met.withColumn("_new", F.slice(F.filter(
        F.coalesce("near", F.array()), lambda n: ~F.array_contains(F.col("_own"), n["neighbor"])), 1, max_expansions))
    more = (F.size("_new") < max_expansions) & (F.size("_own") > 1)
    return new.select("qid", F.col("node").alias("expanded_from"), F.col("_ranks")[0].alias("source_rank"),
                      F.when(~more, F.col("_new")).alias("_new"), F.when(more, F.col("_own")).alias("_own"), F.when(more, F.col("_ranks")).alias("_ranks"))


def reached_hits(own: DataFrame, sizes: DataFrame, max_expansions: int) -> DataFrame:
    """(qid, source_rank, node, _own): hits with neighbours that a walk may reach, each with all nodes of its question.

    A list with ``max_expansions`` entries more than the question has hits always
    completes it, so no hit behind the first of these is reached.
    """
    walk = own.join(sizes, "node", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("source_rank", "node", "_len"))).alias("_walk"))
    last = F.array_position(F.transform("_walk", lambda h: F.coalesce(h["_len"], F.lit(0)) >= F.size("_walk") + max_expansions), True)
    kept = F.slice("_walk", F.lit(1), F.when(last > 0, last.cast("int")).otherwise(F.size("_walk")))
    hit = walk.select("qid", F.col("_walk.node").alias("_own"), F.explode(F.filter(kept, lambda h: h["_len"].isNotNull())).alias("_h"))
    return hit.select("qid", "_h.source_rank", "_h.node", "_own")


def expand_one_hop(hits: DataFrame, edges: DataFrame, max_expansions: int = 5, parallel: bool = True, most_hits: int | None = None) -> DataFrame:
    """Neighbours of the hits that were not retrieved themselves.

    A neighbour reached from several hits keeps the best-ranked one (first
    link on ties); per question ordered by (source_rank, chunk_id) and cut to
    ``max_expansions``.

    A question walks its hits by rank and takes what is new from the sorted list
    of each node's neighbours until it has ``max_expansions``. Every question
    first goes, with its hits, to the list of its best hit; most end there and no
    list travels. The hits of the rest, if there are any, meet the sizes of the
    lists; only those that the walk may reach meet the lists. At most as many of
    a node's neighbours as a question has hits can be retrieved already, so
    beyond its first ``max_expansions`` + (most hits of a question) neighbours by
    id a node can never contribute; leaving them out keeps hub nodes harmless.
    ``most_hits`` says that no question has more; without it hits are written and
    counted first. ``parallel=False`` says that no two nodes have more than one link.
    """
    schema = "qid chunk_id expanded_from relation note source_rank".split()
    if max_expansions <= 0:
        return (hits.withColumn("expanded_from", F.col("chunk_id")).withColumn("relation", F.lit(""))
                .withColumn("note", F.lit("")).withColumn("source_rank", F.col("rank"))
                .select(*schema).limit(0))
    walks = question_walks(hits)
    if most_hits is None:
        walks = cut_lineage(walks)
        most_hits = walks.agg(F.max(F.size("_own"))).first()[0] or 0
    lists = cut_lineage(adjacency_lists(edges, max_expansions + most_hits, parallel))
    first = cut_lineage(first_expansions(walks, lists, max_expansions))
    ended = first.select("qid", "expanded_from", "source_rank", F.inline("_new")).withColumnRenamed("neighbor", "chunk_id").select(*schema)
    # Joins with no question on one side would still shuffle all lists.
    if first.filter(F.col("_own").isNotNull()).isEmpty():
        return ended
    own = first.select("qid", F.inline(F.arrays_zip(F.col("_ranks").alias("source_rank"), F.col("_own").alias("node"))))
    reached = reached_hits(own, lists.select("node", F.size("near").alias("_len")), max_expansions)
    walks = reached.join(lists, "node").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("source_rank", "node", "near"))).alias("_walk"), F.first("_own").alias("_own"))
    kind = own.schema
    empty = F.from_json(F.lit("[]"), f"array<struct<chunk_id:{lists.schema['near'].dataType.elementType['neighbor'].dataType.simpleString()},expanded_from:{kind['node'].dataType.simpleString()},"
                                     f"relation:string,note:string,source_rank:{kind['source_rank'].dataType.simpleString()}>>")

    def take(taken: Column, hit: Column) -> Column:
        fresh = F.filter(F.coalesce(hit["near"], F.array()), lambda n: ~F.array_contains(F.col("_own"), n["neighbor"]) & ~F.exists(taken, lambda t: t["chunk_id"] == n["neighbor"]))
        rows = F.transform(F.slice(fresh, 1, F.lit(max_expansions) - F.size(taken)), lambda n: F.struct(
            n["neighbor"].alias("chunk_id"), hit["node"].alias("expanded_from"), n["relation"].alias("relation"), n["note"].alias("note"), hit["source_rank"].alias("source_rank")))
        return F.when(F.size(taken) >= max_expansions, taken).otherwise(F.concat(taken, rows))

    found = walks.select("qid", F.explode(F.aggregate("_walk", empty, take)).alias("_x"))
    return ended.unionByName(found.select("qid", "_x.*").select(*schema))


def link_activation(expansions: DataFrame) -> DataFrame:
    """How often each (from, to, relation) was used."""
    return expansions.groupBy(F.col("expanded_from").alias("from_chunk"), F.col("chunk_id").alias("to_chunk"), "relation").agg(
        F.count(F.lit(1)).alias("n"),
    )


def expansion_summary(queries: DataFrame, expansions: DataFrame) -> DataFrame:
    """Mean expansions per question and questions with at least one."""
    per = queries.select("qid").join(expansions.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.coalesce("n", F.lit(0))).alias("mean_expansions"),
        F.count_if(F.coalesce("n", F.lit(0)) >= 1).alias("n_with_expansion"),
    )


def unused_links(edges: DataFrame, expansions: DataFrame) -> DataFrame:
    """Links that no expansion used, whichever way it was followed."""
    used = expansions.select(
        F.least("expanded_from", "chunk_id").alias("_a"), F.greatest("expanded_from", "chunk_id").alias("_b"),
    ).distinct()
    keyed = edges.withColumn("_a", F.least("from_chunk", "to_chunk")).withColumn("_b", F.greatest("from_chunk", "to_chunk"))
    return keyed.join(used, ["_a", "_b"], "left_anti").drop("_a", "_b")


def graph_rescue(gold: DataFrame, hits: DataFrame, expansions: DataFrame, k: int = 10) -> DataFrame:
    """Per question with gold: recall in the top k, recall with expansions, rescued gold, zero-recall coverage."""
    top = hits.filter(F.col("rank") <= k).select("qid", "chunk_id").distinct().withColumn("_top", F.lit(1))
    exp = expansions.select("qid", "chunk_id").distinct().withColumn("_exp", F.lit(1))
    n_exp = expansions.groupBy("qid").agg(F.count(F.lit(1)).alias("n_expansions"))
    flags = gold.select("qid", "chunk_id").distinct().join(top, ["qid", "chunk_id"], "left").join(exp, ["qid", "chunk_id"], "left")
    per = flags.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_gold"),
        F.count("_top").alias("n_top"),
        F.count_if(F.col("_top").isNull() & F.col("_exp").isNotNull()).alias("n_rescued"),
    )
    return per.join(n_exp, "qid", "left").select(
        "qid", "n_gold", "n_rescued",
        (F.col("n_top") / F.col("n_gold")).alias("baseline_recall"),
        ((F.col("n_top") + F.col("n_rescued")) / F.col("n_gold")).alias("effective_recall"),
        (F.col("n_top") == 0).alias("zero_recall"),
        F.coalesce("n_expansions", F.lit(0)).alias("n_expansions"),
    )


def rescue_links(gold: DataFrame, hits: DataFrame, expansions: DataFrame, k: int = 10) -> DataFrame:
    """The links through which gold missing from the top k was reached."""
    top = hits.filter(F.col("rank") <= k).select("qid", "chunk_id")
    missed = gold.select("qid", "chunk_id").distinct().join(top, ["qid", "chunk_id"], "left_anti")
    return expansions.join(missed, ["qid", "chunk_id"], "left_semi")


def validate_endpoints(edges: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Endpoints that are placeholders ``<...>`` or absent from the chunk table."""
    ends = edges.select(F.explode(F.array("from_chunk", "to_chunk")).alias("endpoint")).distinct()
    placeholder = ends.filter(F.col("endpoint").rlike(r"^<.*>$")).withColumn("problem", F.lit("placeholder"))
    real = ends.filter(~F.col("endpoint").rlike(r"^<.*>$"))
    missing = real.join(chunks.select(F.col(chunk_id).alias("endpoint")), "endpoint", "left_anti").withColumn("problem", F.lit("missing"))
    return placeholder.unionByName(missing)
