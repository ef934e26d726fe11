"""Views of the input tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pandekt.plans.registry import Tables


def chunks(t: Tables) -> DataFrame:
    """documents as chunks: ``<source>__art_<doc_id>`` under doc_urn ``<source>``."""
    return t.documents.select(
        F.concat("source", F.lit("__art_"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("source").alias("doc_urn"), "doc_id", "lang", "text",
    )


def questions(t: Tables) -> DataFrame:
    """benchmark passages as questions ``B<item_id>``."""
    return t.benchmark.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("qid"), "item_id", "text")


def lines(c) -> "F.Column":
    return F.split(c, "\n")


#: Hits of an order.
ORDER_HITS = 10


def order_hits(t: Tables, k: int = ORDER_HITS) -> DataFrame:
    """Ranked parts and suppliers of every order, as hits over graph nodes.

    Parts carry the line price, suppliers the price halved, so both kinds mix.
    """
    # The lines of an order come together once, before they become two rows each.
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").repartition("l_orderkey")
    nodes = l.select(F.col("l_orderkey").alias("qid"), F.explode(F.array(
        F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("chunk_id"), F.col("l_extendedprice").alias("s")),
        F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("chunk_id"), (F.col("l_extendedprice") / 2).alias("s")),
    )).alias("x")).select("qid", "x.chunk_id", "x.s")
    from pandekt.operators.ordered import top_k
    best = nodes.groupBy("qid", "chunk_id").agg(F.max("s").alias("score"))
    return top_k(best, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")


ORDER_HITS_SQL = """
oh_n AS (SELECT l_orderkey AS qid, 'P' || l_partkey AS chunk_id, l_extendedprice AS s FROM lineitem
  UNION ALL SELECT l_orderkey, 'S' || l_suppkey, l_extendedprice / 2 FROM lineitem),
oh_b AS (SELECT qid, chunk_id, max(s) AS score FROM oh_n GROUP BY ALL),
hits AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM oh_b) WHERE rank <= 10)"""


def part_supplier_edges(t: Tables) -> DataFrame:
    """Distinct (part, supplier) pairs as graph links."""
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_orderkey").alias("link_pos"), F.max("l_returnflag").alias("relation"), F.min("l_linestatus").alias("note"),
    )
    return pairs.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("from_chunk"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_chunk"), "relation", "note", "link_pos",
    )


EDGES_SQL = """
edges AS (SELECT 'P' || l_partkey AS from_chunk, 'S' || l_suppkey AS to_chunk, max(l_returnflag) AS relation,
  min(l_linestatus) AS note, min(l_orderkey) AS link_pos FROM lineitem GROUP BY l_partkey, l_suppkey)"""

EXPANSION_SQL = """
adj AS (SELECT from_chunk AS node, to_chunk AS neighbor, relation, note, link_pos FROM edges
  UNION ALL SELECT to_chunk, from_chunk, relation, note, link_pos FROM edges),
cand AS (SELECT h.qid, a.neighbor AS chunk_id, a.node AS expanded_from, a.relation, a.note, h.rank AS source_rank, a.link_pos
  FROM hits h JOIN adj a ON h.chunk_id = a.node),
fresh AS (SELECT c.* FROM cand c ANTI JOIN hits h ON c.qid = h.qid AND c.chunk_id = h.chunk_id),
best AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY source_rank, link_pos) AS i FROM fresh),
expansions AS (SELECT qid, chunk_id, expanded_from, relation, note, source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source_rank, chunk_id) AS j FROM best WHERE i = 1) WHERE j <= 5)"""
