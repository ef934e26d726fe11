"""Dense, BM25 and fused retrieval over documents and embeddings."""

from pyspark.sql import functions as F

from pandekt.functions.ids import base_id
from pandekt.functions.vectors import cosine, dot, l2_normalize, norm
from pandekt.operators import candidates as cand
from pandekt.operators import evaluation as ev
from pandekt.operators import fusion
from pandekt.operators.dense import dense_topk
from pandekt.operators.embedding import embed
from pandekt.operators.ordered import row_positions, top_k
from pandekt.operators.search_index import build_index
from pandekt.operators.sparse import bm25_index, document_frequency, sparse_topk
from pandekt.plans.base import EXPANSION_SQL, chunks, questions
from pandekt.plans.registry import query
from pandekt.session import cut_lineage, scratch_path
from pandekt.plans.sqlbits import CHUNKS, QUESTIONS, WORD, bm25, dense, f1, hashed, hybrid

# ------------------------------------------------------------------ encoding


@query("d1_l2_normalize", """
WITH x AS (SELECT vec_id, [CAST(v AS DOUBLE) * (label + 1) FOR v IN embedding] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum([a * a FOR a IN v])) AS n FROM x)
SELECT vec_id, round(n, 5) AS raw_norm, round(list_sum([(a / n) * (a / n) FOR a IN v]), 6) AS unit_norm, round(list_sum(v) / n, 6) AS total FROM n""")
def normalize(t):
    scaled = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * (F.col("label") + 1)).alias("v"))
    unit = scaled.withColumn("u", l2_normalize(F.col("v")))
    return unit.select("vec_id", F.round(norm(F.col("v")), 5).alias("raw_norm"), F.round(dot(F.col("u"), F.col("u")), 6).alias("unit_norm"),
                       F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("d1_hashing_encoder", f"""WITH {CHUNKS},{hashed('h', 'chunks', 'chunk_id')}
SELECT chunk_id, CAST(b AS INTEGER) AS bucket, round(w, 6) AS weight FROM h""")
def hashing(t):
    e = embed(chunks(t)).select("chunk_id", F.posexplode("vec").alias("bucket", "weight"))
    return e.filter(F.col("weight") > 0).withColumn("weight", F.round("weight", 6))


# --------------------------------------------------------------------- arms


@query("d2_dense_topk", """
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS chunk_id,
  round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM s) WHERE rank <= 10""")
def dense_self(t):
    e = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return dense_topk(e.select("qid", "vec"), e.select("chunk_id", "vec"), 10, skip_same_id=True)


@query("d2_many_questions", """
WITH q AS (SELECT o_orderkey AS qid, [o_custkey % 50 - 25, o_orderkey % 40 - 20, CAST(floor(o_totalprice) AS BIGINT) % 60 - 30] AS v FROM orders),
c AS (SELECT s_suppkey AS chunk_id, [s_nationkey - 12, s_suppkey % 40 - 20, CAST(floor(s_acctbal) AS BIGINT) % 60 - 30] AS w FROM supplier),
s AS (SELECT qid, chunk_id, CAST(v[1] * w[1] + v[2] * w[2] + v[3] * w[3] AS DOUBLE) AS score FROM q, c)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM s) WHERE rank <= 10""")
def dense_many(t):
    """Every order asks for suppliers: far more questions than fit one block."""
    part = lambda c: F.col(c).cast("double")
    whole = lambda c: F.floor(c).cast("long")
    q = t.orders.select(F.col("o_orderkey").alias("qid"), F.array((F.col("o_custkey") % 50 - 25).cast("double"), (F.col("o_orderkey") % 40 - 20).cast("double"), (whole("o_totalprice") % 60 - 30).cast("double")).alias("vec"))
    c = t.supplier.select(F.col("s_suppkey").alias("chunk_id"), F.array(part("s_nationkey") - 12, (F.col("s_suppkey") % 40 - 20).cast("double"), (whole("s_acctbal") % 60 - 30).cast("double")).alias("vec"))
    return dense_topk(q, c, 10)


@query("d2_dense_text_topk", f"WITH {CHUNKS},{QUESTIONS},{dense('hits', 10)} SELECT * FROM hits")
def dense_text(t):
    return fusion.retrieve(questions(t), chunks(t), 10, "dense")[0]


@query("d3_bm25_index", f"""WITH {CHUNKS}, tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT chunk_id, count(*) AS dl FROM tok GROUP BY ALL)
SELECT chunk_id, dl, term, tf, count(*) OVER (PARTITION BY term) AS df FROM tf JOIN dl USING (chunk_id)""")
def index(t):
    p = cut_lineage(bm25_index(chunks(t)))
    return p.join(document_frequency(p), "term").select("chunk_id", "dl", "term", "tf", "df")


def stored_index(t):
    """The index of all documents, written for this call."""
    return build_index(chunks(t), scratch_path(t.spark, "search-index"))


@query("d3_stored_frequencies", f"""WITH {CHUNKS}, tok AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM chunks)
SELECT term, count(*) AS df FROM tok GROUP BY term""")
def stored_frequencies(t):
    return stored_index(t).frequencies


@query("d4_stored_index", f"WITH {CHUNKS},{QUESTIONS},{bm25('hits', 10)} SELECT * FROM hits")
def stored_sparse(t):
    return fusion.retrieve(questions(t), chunks(t), 10, "sparse", aliases={}, index=stored_index(t))[0]


@query("d4_sparse_topk", f"WITH {CHUNKS},{QUESTIONS},{bm25('hits', 10)} SELECT * FROM hits")
def sparse(t):
    return sparse_topk(questions(t), chunks(t), 10)


def filtered_questions(t):
    """Every passage searches one source; passages without such a source find nothing."""
    return questions(t).withColumn("want", F.concat(F.lit("src"), F.col("item_id").cast("string")))


FILTERED = "questions AS (SELECT 'B' || item_id AS qid, 'src' || item_id AS want, text FROM benchmark)"


@query("d5_filtered_search", f"WITH {CHUNKS},{FILTERED},{bm25('hits', 5, where='q.want = p.doc_urn')} SELECT * FROM hits")
def filtered(t):
    return sparse_topk(filtered_questions(t), chunks(t), 5, filter_doc="want")


@query("d5_filtered_dense", f"""WITH {CHUNKS},{FILTERED},
{dense('hits', 5, where="EXISTS (SELECT 1 FROM questions x WHERE x.qid = hits_sc.qid AND x.want = split_part(hits_sc.chunk_id, '__', 1))")} SELECT * FROM hits""")
def filtered_dense(t):
    q = filtered_questions(t)
    return dense_topk(embed(q), embed(chunks(t)), 5, filter_doc="want")


@query("d5_stored_index", f"WITH {CHUNKS},{FILTERED},{bm25('hits', 5, where='q.want = p.doc_urn')} SELECT * FROM hits")
def stored_filtered(t):
    return fusion.retrieve(filtered_questions(t), chunks(t), 5, "sparse", filter_doc="want", aliases={}, index=stored_index(t))[0]


# ------------------------------------------------------------------- fusion


@query("d6_stored_index", f"WITH {CHUNKS},{QUESTIONS},{hybrid('hits', 10)} SELECT * FROM hits")
def stored_hybrid(t):
    return fusion.retrieve(questions(t), chunks(t), 10, "hybrid", index=stored_index(t))[0]


@query("d6_hybrid_rrf", f"WITH {CHUNKS},{QUESTIONS},{hybrid('hits', 10)} SELECT * FROM hits")
def hybrid_topk(t):
    return fusion.retrieve(questions(t), chunks(t), 10, "hybrid")[0]


@query("d7_rerank", f"""WITH {CHUNKS},{QUESTIONS},{bm25('hits', 20)},
s AS (SELECT h.qid, h.chunk_id, h.rank AS prev, round({f1('q.text', 'c.text')}, 6) AS score FROM hits h JOIN questions q USING (qid) JOIN chunks c USING (chunk_id))
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prev) AS rank, chunk_id, score FROM s) WHERE rank <= 10""")
def reranked(t):
    q, c = questions(t), chunks(t)
    return fusion.rerank(sparse_topk(q, c, 20), q, c, 10)


def same_source_edges(t):
    """Each document links to the next one of its source (by id)."""
    placed = row_positions(chunks(t).select("doc_urn", "doc_id", "chunk_id", "lang"), ["doc_urn"], ["doc_id"])
    following = placed.select("doc_urn", (F.col("pos") - 1).alias("pos"), F.col("chunk_id").alias("to_chunk"))
    return placed.withColumnRenamed("chunk_id", "from_chunk").join(following, ["doc_urn", "pos"]).select(
        "from_chunk", "to_chunk", F.lit("rinvia_a").alias("relation"), F.col("lang").alias("note"), F.col("doc_id").alias("link_pos"))


@query("d8_retrieve", f"""WITH {CHUNKS},{QUESTIONS},{hybrid('h20', 20)},
edges AS (SELECT * FROM (SELECT chunk_id AS from_chunk, lead(chunk_id) OVER (PARTITION BY doc_urn ORDER BY doc_id) AS to_chunk,
  'rinvia_a' AS relation, lang AS note, doc_id AS link_pos FROM chunks) WHERE to_chunk IS NOT NULL),
s AS (SELECT h.qid, h.chunk_id, h.rank AS prev, round({f1('q.text', 'c.text')}, 6) AS score FROM h20 h JOIN questions q USING (qid) JOIN chunks c USING (chunk_id)),
hits AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prev) AS rank, chunk_id, score FROM s) WHERE rank <= 10),
{EXPANSION_SQL}
SELECT qid, 'hit' AS kind, chunk_id, rank, NULL AS expanded_from FROM hits
UNION ALL SELECT qid, 'expansion', chunk_id, source_rank, expanded_from FROM expansions""")
def retrieve(t):
    hits, more = fusion.retrieve(questions(t), chunks(t), 10, "hybrid", rerank_k=20, edges=same_source_edges(t))
    a = hits.select("qid", F.lit("hit").alias("kind"), "chunk_id", "rank", F.lit(None).cast("string").alias("expanded_from"))
    return a.unionByName(more.select("qid", F.lit("expansion").alias("kind"), "chunk_id", F.col("source_rank").alias("rank"), "expanded_from"))


def line_rankings(t):
    """Per part: suppliers ranked within each return flag, the flags being the sources."""
    best = t.lineitem.groupBy(F.col("l_partkey").alias("qid"), F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("chunk_id")).agg(
        F.max("l_extendedprice").alias("s"), F.max("l_linestatus").alias("payload"))
    ranked = top_k(best, ["qid", "source"], [F.desc("s"), F.asc("chunk_id")], 20)
    pos = F.when(F.col("source") == "N", 0).when(F.col("source") == "R", 1).otherwise(2)
    return ranked.select("qid", "source", pos.alias("source_pos"), "rank", "chunk_id", "payload")


RANKINGS = """
lr_b AS (SELECT l_partkey AS qid, l_returnflag AS source, l_suppkey AS chunk_id, max(l_extendedprice) AS s, max(l_linestatus) AS payload FROM lineitem GROUP BY ALL),
rankings AS (SELECT * FROM (SELECT qid, source, CASE source WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS source_pos, chunk_id, payload,
  row_number() OVER (PARTITION BY qid, source ORDER BY s DESC, chunk_id) AS rank FROM lr_b) WHERE rank <= 20)"""


@query("d9_fuse_sources", f"""WITH {RANKINGS},
f AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, arg_min(payload, source_pos) AS payload FROM rankings GROUP BY ALL)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score, payload FROM f) WHERE rank <= 20""")
def fuse_sources(t):
    return fusion.fuse_sources(line_rankings(t), 20, payload="payload")


@query("d10_fusion_trace", f"""WITH {RANKINGS}
SELECT qid, chunk_id, string_agg(source || '@' || rank, ',' ORDER BY source_pos) AS trace, round(sum(1.0 / (60 + rank)), 9) AS total,
  count(*) AS n_sources FROM rankings GROUP BY ALL""")
def trace(t):
    tr = fusion.fusion_trace(line_rankings(t))
    return tr.select(
        "qid", "chunk_id",
        F.array_join(F.transform("contributions", lambda x: F.concat_ws("@", x["source"], x["rank"].cast("string"))), ",").alias("trace"),
        F.round(F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["partial"]), 9).alias("total"),
        F.size("contributions").cast("long").alias("n_sources"),
    )


# --------------------------------------------------------------- candidates

LONGEST_WORD = f"""
terms AS (SELECT qid, term FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term) AS i FROM (
  SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM questions)) WHERE i = 1)"""


def longest_words(t):
    """The longest word of each question as its search term."""
    from pandekt.operators.sparse import query_terms
    return top_k(query_terms(questions(t)), ["qid"], [F.desc(F.length("term")), F.asc("term")], 1, "i").select("qid", "term")


NWORDS = r"greatest(1, len(list_filter(regexp_split_to_array(text, '[\s\x0B\p{Z}]+'), lambda x: x <> '')))"

TERM_HITS = f"""
occ AS (SELECT t.qid, t.term, c.chunk_id, CAST((length(lower(c.text)) - length(replace(lower(c.text), t.term, ''))) / length(t.term) AS BIGINT) AS n,
  {NWORDS} AS nw FROM chunks c JOIN terms t ON contains(lower(c.text), t.term)),
term_hits AS (SELECT * FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid, term ORDER BY round(n / nw, 9) DESC, n DESC, chunk_id) AS rank,
  chunk_id, n, round(n / nw, 9) AS score FROM occ) WHERE rank <= 10)"""


@query("d11_term_frequency_rank", f"WITH {CHUNKS},{QUESTIONS},{LONGEST_WORD},{TERM_HITS} SELECT * FROM term_hits")
def term_rank(t):
    return cand.term_frequency_rank(chunks(t), longest_words(t))


def line_chunks(t):
    """Lines as chunk ids: late lines of an order are split children."""
    n = F.col("l_linenumber").cast("string")
    root = F.concat(F.lit("doc"), F.col("l_suppkey").cast("string"), F.lit("__art_"), F.col("l_partkey").cast("string"))
    return t.lineitem.select(F.when(F.col("l_linenumber") > 3, F.concat(root, F.lit("__paras_1_"), n)).otherwise(root).alias("chunk_id")).distinct()


LINE_CHUNKS = """
lc AS (SELECT DISTINCT 'doc' || l_suppkey || '__art_' || l_partkey || CASE WHEN l_linenumber > 3 THEN '__paras_1_' || l_linenumber ELSE '' END AS chunk_id FROM lineitem)"""


@query("d12_match_hints", f"""WITH {LINE_CHUNKS},
hints AS (SELECT 'C' || c_custkey AS qid, 'doc' || c_nationkey AS doc_urn, 'art_' || c_custkey AS suffix FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'doc' || s_suppkey, 'recital_' || s_nationkey FROM supplier)
SELECT DISTINCT qid, doc_urn, suffix, chunk_id FROM hints JOIN lc ON chunk_id = doc_urn || '__' || suffix
  OR (suffix LIKE 'art!_%' ESCAPE '!' AND starts_with(chunk_id, doc_urn || '__' || suffix || '__'))""")
def hints(t):
    h = t.customer.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("qid"), F.concat(F.lit("doc"), F.col("c_nationkey").cast("string")).alias("doc_urn"),
        F.concat(F.lit("art_"), F.col("c_custkey").cast("string")).alias("suffix"),
    ).unionByName(t.supplier.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("qid"), F.concat(F.lit("doc"), F.col("s_suppkey").cast("string")).alias("doc_urn"),
        F.concat(F.lit("recital_"), F.col("s_nationkey").cast("string")).alias("suffix")))
    return cand.match_hints(h, line_chunks(t))


@query("d13_mine_candidates", f"""WITH {CHUNKS},{QUESTIONS},{LONGEST_WORD},{TERM_HITS},{bm25('hy', 20)},
found AS (SELECT q.qid, c.chunk_id, 0 AS s, 'hint:' || split_part(c.chunk_id, '__', 2) AS via FROM benchmark b JOIN questions q ON q.qid = 'B' || b.item_id JOIN chunks c ON c.doc_id = b.item_id
  UNION ALL SELECT qid, chunk_id, 1, 'term:' || term FROM term_hits UNION ALL SELECT qid, chunk_id, 2, 'hybrid:rank=' || rank FROM hy)
SELECT qid, chunk_id, bool_or(s = 0) AS hint_backed, string_agg(via, '|' ORDER BY s, via) AS found_via, any_value(substr(text, 1, 250)) AS text_excerpt
FROM found JOIN chunks USING (chunk_id) GROUP BY qid, chunk_id""")
def mine(t):
    q, c = questions(t), chunks(t)
    hint_hits = cand.match_hints(
        q.join(c.select(F.col("doc_id").alias("item_id"), "doc_urn"), "item_id").select(
            "qid", "doc_urn", F.concat(F.lit("art_"), F.col("item_id").cast("string")).alias("suffix")), c,
    ).select("qid", "chunk_id", F.col("suffix").alias("label"))
    out = cand.mine_candidates(c, hint_hits, term_rank(t), sparse_topk(q, c, 20))
    return out.withColumn("found_via", F.array_join("found_via", "|"))


# ------------------------------------------------------------- comparisons


def similarity_pairs(t):
    """Consecutive vectors as labelled pairs, under the full and the half-length encoder."""
    e = t.embeddings
    a = e.select("vec_id", F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    pairs = a.join(b, "vec_id").withColumn("expected", F.when(F.col("la") == F.col("lb"), "alto").otherwise("basso"))
    half = pairs.select("vec_id", "expected", F.lit("half").alias("variant"), F.slice("a", 1, 32).alias("a"), F.slice("b", 1, 32).alias("b"))
    return pairs.select("vec_id", "expected", F.lit("full").alias("variant"), "a", "b").unionByName(half)


PAIRS = """
p AS (SELECT x.vec_id, CASE WHEN x.label = y.label THEN 'alto' ELSE 'basso' END AS expected, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b
  FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
v AS (SELECT vec_id, expected, 'full' AS variant, a, b FROM p UNION ALL SELECT vec_id, expected, 'half', a[1:32], b[1:32] FROM p),
s AS (SELECT vec_id, variant, expected, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS similarity FROM v),
c AS (SELECT *, CASE WHEN similarity >= 0.5 THEN 'alto' WHEN similarity >= 0.2 THEN 'medio' ELSE 'basso' END AS class FROM s)"""


@query("d14_pair_similarity_class", f"WITH {PAIRS} SELECT vec_id, variant, expected, similarity, class, class = expected AS agrees FROM c")
def pair_class(t):
    return ev.pair_similarity_class(similarity_pairs(t), high=0.5, medium=0.2).select("vec_id", "variant", "expected", "similarity", "class", "agrees")


@query("d14_pair_verdict", f"""WITH {PAIRS}
SELECT variant, count(*) AS n, count(*) FILTER (class = expected) AS n_agree,
  CASE WHEN count(*) FILTER (class = expected) >= 12 THEN 'PASS' WHEN count(*) FILTER (class = expected) >= 9 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict
FROM c GROUP BY variant""")
def pair_verdict(t):
    return ev.pair_verdict(pair_class(t))


@query("d15_expectation_check", f"""WITH {CHUNKS},{QUESTIONS},{bm25('hits', 10)},
e AS (SELECT 'B' || item_id AS qid, source || '__art_' || doc_id AS want, source AS want_doc FROM benchmark JOIN documents ON doc_id = item_id)
SELECT e.qid, coalesce(bool_or(h.chunk_id = want), FALSE) AS found_id, coalesce(bool_or(split_part(h.chunk_id, '__', 1) = want_doc), FALSE) AS found_doc
FROM e LEFT JOIN hits h ON h.qid = e.qid GROUP BY e.qid""")
def expectation(t):
    q, c = questions(t), chunks(t)
    expected = q.join(c.select(F.col("doc_id").alias("item_id"), F.col("chunk_id").alias("want_id"), F.col("doc_urn").alias("want_doc")), "item_id").select(
        "qid", "want_id", "want_doc")
    return ev.expectation_check(sparse_topk(q, c, 10), expected)


@query("d16_compare_modes", f"""WITH {CHUNKS},{QUESTIONS},{dense('dn', 20)},{bm25('sp', 20)},
rr_s AS (SELECT h.qid, h.chunk_id, h.rank AS prev, round({f1('q.text', 'c.text')}, 6) AS score FROM sp h JOIN questions q USING (qid) JOIN chunks c USING (chunk_id)),
rr AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prev) AS rank FROM rr_s),
u AS (SELECT 'dense' AS setup, qid, chunk_id, rank FROM dn UNION ALL SELECT 'sparse', qid, chunk_id, rank FROM sp UNION ALL SELECT 'rerank', qid, chunk_id, rank FROM rr),
m AS (SELECT q.qid, c.chunk_id, contains(lower(c.text), lower(q.text)) AS is_current, c.doc_id = b.item_id AS is_proposed
  FROM benchmark b JOIN questions q ON q.qid = 'B' || b.item_id JOIN chunks c ON contains(lower(c.text), lower(q.text)) OR c.doc_id = b.item_id)
SELECT qid, chunk_id, is_current, is_proposed, min(rank) FILTER (setup = 'dense') AS dense, min(rank) FILTER (setup = 'sparse') AS sparse,
  min(rank) FILTER (setup = 'rerank') AS rerank FROM u JOIN m USING (qid, chunk_id) WHERE rank <= 20 GROUP BY ALL""")
def modes(t):
    q, c = questions(t), chunks(t)
    sp = cut_lineage(sparse_topk(q, c, 20))
    setups = {"dense": dense_topk(embed(q), embed(c), 20), "sparse": sp, "rerank": fusion.rerank(sp, q, c, 20)}
    hits = fusion.union_all([h.withColumn("setup", F.lit(s)) for s, h in setups.items()])
    current = passage_gold(t).withColumn("k", F.lit("current"))
    proposed = q.join(c.select(F.col("doc_id").alias("item_id"), "chunk_id"), "item_id").select("qid", "chunk_id", F.lit("proposed").alias("k"))
    marks = current.unionByName(proposed).groupBy("qid", "chunk_id").agg(
        F.bool_or(F.col("k") == "current").alias("is_current"), F.bool_or(F.col("k") == "proposed").alias("is_proposed"))
    return fusion.compare_modes(hits, marks, list(setups), 20)


def passage_gold(t):
    """(qid, chunk_id) where the document contains the whole passage."""
    q = questions(t).select("qid", F.lower("text").alias("term"))
    return cand.term_occurrences(chunks(t), q).join(q, "term").select("qid", "chunk_id").distinct()
