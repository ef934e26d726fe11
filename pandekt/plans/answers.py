"""Prompts and citation checks over benchmark passages and conversations."""

from pyspark.sql import functions as F

from pandekt.operators import answers as an
from pandekt.operators.graph import expand_one_hop
from pandekt.operators.sparse import sparse_topk
from pandekt.plans.base import EXPANSION_SQL, chunks, questions
from pandekt.plans.registry import query
from pandekt.plans.retrieval import FILTERED, filtered_questions, same_source_edges
from pandekt.plans.sqlbits import CHUNKS, QUESTIONS, bm25
from pandekt.plans.structure import STRIP
from pandekt.session import cut_lineage


def pathed(t):
    return chunks(t).withColumn("hierarchy_path", F.when(F.col("lang") == "de", F.array().cast("array<string>")).otherwise(
        F.array(F.col("doc_urn"), F.concat(F.lit("art. "), F.col("doc_id").cast("string")))))


def prompt_sql(questions: str, related: str) -> str:
    return f"""
bl AS (SELECT h.qid, h.rank, '[chunk_id: ' || h.chunk_id || ']' || chr(10) || CASE WHEN lang = 'de' THEN '' ELSE doc_urn || ' > art. ' || doc_id || chr(10) END || '---' || chr(10) || {STRIP % 'c.text'} || chr(10) || '===' AS b
  FROM hits h JOIN chunks c USING (chunk_id)),
cx AS (SELECT qid, count(*) AS n, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS b FROM bl GROUP BY qid),
rl AS ({related}),
pm AS (SELECT q.qid, coalesce(n, 0) AS n_hits, 'Domanda: ' || {STRIP % 'q.text'} || chr(10) || chr(10) || 'Contesto normativo (' || coalesce(n, 0) || ' riferimenti):' || chr(10) || chr(10)
  || coalesce(cx.b, '(nessun riferimento normativo recuperato)') || coalesce(chr(10) || chr(10) || 'Riferimenti correlati (graph espansione):' || chr(10) || rl.r, '') || chr(10) || chr(10)
  || 'Rispondi alla domanda usando esclusivamente il contesto normativo fornito. Cita ogni affermazione con [cite:CHUNK_ID].' AS prompt FROM {questions} q LEFT JOIN cx USING (qid) LEFT JOIN rl USING (qid))"""


SAME_SOURCE = """edges AS (SELECT * FROM (SELECT chunk_id AS from_chunk, lead(chunk_id) OVER (PARTITION BY doc_urn ORDER BY doc_id) AS to_chunk,
  'rinvia_a' AS relation, lang AS note, doc_id AS link_pos FROM chunks) WHERE to_chunk IS NOT NULL)"""
RELATED = "SELECT qid, string_agg('- [chunk_id: ' || chunk_id || ']: ' || relation || ' — ' || note, chr(10) ORDER BY source_rank, chunk_id) AS r FROM expansions GROUP BY qid"


@query("f1_context_prompt", f"""WITH {CHUNKS},{FILTERED},{bm25('hits', 3, where='q.want = p.doc_urn')},{SAME_SOURCE},{EXPANSION_SQL},{prompt_sql('questions', RELATED)}
SELECT qid, n_hits, prompt FROM pm""")
def prompts(t):
    q = filtered_questions(t)
    hits = cut_lineage(sparse_topk(q, chunks(t), 3, filter_doc="want"))
    return an.context_prompt(q, hits, pathed(t), expand_one_hop(hits, same_source_edges(t), 5))


def answers(t):
    """Assistant turns whose sentence ends became citations; context = words of the user turn before."""
    c = t.conversations
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.regexp_replace("text", r"(\p{L}+)\.", r"$1 [cite:$1]. [cite:] [cite: x]").alias("answer"))
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("context"))
    return a.join(u, ["conv_id", "turn"], "left")


ANSWERS = r"""
an AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '(\p{L}+)\.', '\1 [cite:\1]. [cite:] [cite: x]', 'g') AS answer, coalesce(regexp_extract_all(u.text, '\p{L}+'), []) AS context
  FROM (SELECT * FROM conversations WHERE role = 'assistant') a LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1),
ci AS (SELECT conv_id, turn, answer, context, unnest(regexp_extract_all(answer, '\[cite:([^\]\s]+)\]', 1)) AS chunk_id, generate_subscripts(regexp_extract_all(answer, '\[cite:([^\]\s]+)\]', 1), 1) AS i FROM an),
pi AS (SELECT conv_id, turn, unnest(regexp_split_to_array(answer, '\[cite:[^\]\s]+\]')) AS piece, generate_subscripts(regexp_split_to_array(answer, '\[cite:[^\]\s]+\]'), 1) AS i FROM an),
mk AS (SELECT conv_id, turn, ci.i - 1 AS pos, chunk_id, piece, list_contains(context, chunk_id) AS ok,
  sum(length(piece) + length(chunk_id) + 7) OVER (PARTITION BY conv_id, turn ORDER BY i) AS e FROM ci JOIN pi USING (conv_id, turn, i))"""


@query("f2_extract_citations", f"WITH {ANSWERS} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, chunk_id, CAST(e - length(chunk_id) - 7 AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end FROM mk")
def extract(t):
    return an.extract_citations(answers(t), ["conv_id", "turn"])


@query("f3_verify_citations", f"""WITH {ANSWERS} SELECT an.conv_id, an.turn, count(chunk_id) AS n_total, count(*) FILTER (ok) AS n_verified, count(*) FILTER (NOT ok) AS n_unverified, count(*) FILTER (NOT ok) = 0 AS all_verified
FROM an LEFT JOIN mk USING (conv_id, turn) GROUP BY ALL""")
def verify(t):
    return an.verify_citations(answers(t)).select("conv_id", "turn", "n_total", "n_verified", "n_unverified", "all_verified")


@query("f4_annotate", r"WITH " + ANSWERS + r""", l AS (SELECT conv_id, turn, piece FROM pi QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) = 1),
s AS (SELECT conv_id, turn, string_agg(piece || '[cite:' || chunk_id || CASE WHEN ok THEN ']' ELSE ' NON VERIFICATA]' END, '' ORDER BY pos) AS x FROM mk GROUP BY ALL)
SELECT l.conv_id, l.turn, coalesce(x, '') || piece AS annotated FROM l LEFT JOIN s USING (conv_id, turn)""")
def annotated(t):
    return an.verify_citations(answers(t)).select("conv_id", "turn", "annotated")


@query("f5_lint_citations", rf"""WITH {ANSWERS}, e AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'positive' WHEN turn = 3 THEN 'negative' ELSE 'edge' END AS query_type, CASE WHEN turn = 3 THEN 0 ELSE 1 END AS n_gold,
  replace(answer, ' [cite:] [cite: x]', CASE WHEN conv_id > 50 THEN '[cite:y]' ELSE '' END) AS a FROM an)
SELECT conv_id, turn, unnest(list_filter([CASE WHEN query_type = 'positive' AND n_gold > 0 AND NOT regexp_matches(a, '\[cite:([^\]\s]+)\]') THEN 'positive_without_citation' END,
  CASE WHEN query_type = 'negative' AND n_gold = 0 AND regexp_matches(a, '\[cite:([^\]\s]+)\]') THEN 'negative_with_citation' END,
  CASE WHEN regexp_matches(a, '\[cite:[^\]]+\]\[cite:') THEN 'adjacent_citations' END], lambda x: x IS NOT NULL)) AS problem FROM e""")
def lint(t):
    a = answers(t)
    e = a.select("conv_id", "turn", F.when(F.col("turn") == 1, "positive").when(F.col("turn") == 3, "negative").otherwise("edge").alias("query_type"),
                 F.when(F.col("turn") == 3, 0).otherwise(1).alias("n_gold"),
                 F.replace("answer", F.lit(" [cite:] [cite: x]"), F.when(F.col("conv_id") > 50, "[cite:y]").otherwise("")).alias("answer"))
    return an.lint_citations(e).select("conv_id", "turn", "problem")


@query("f6_batch_responses", f"""WITH {CHUNKS},{QUESTIONS},{bm25('hits', 5)},{prompt_sql('questions', 'SELECT NULL AS qid, NULL AS r')},
rec AS (SELECT 'B' || item_id AS qid, 'Vedi [cite:' || source || '__art_' || doc_id || '] e [cite:' || lang || '].' AS answer FROM benchmark JOIN documents ON doc_id = item_id),
z AS (SELECT pm.qid, n_hits, md5(prompt) AS prompt_digest, answer, regexp_extract(answer, 'cite:([^]]+)', 1) AS c FROM pm LEFT JOIN rec USING (qid)),
k AS (SELECT z.*, EXISTS (SELECT 1 FROM hits h WHERE h.qid = z.qid AND h.chunk_id = z.c) AS ok FROM z)
SELECT qid, n_hits, prompt_digest, answer, replace(CASE WHEN ok THEN answer ELSE replace(answer, c || ']', c || ' NON VERIFICATA]') END, '].', ' NON VERIFICATA].') AS annotated,
  CAST(2 AS BIGINT) AS n_total, CAST(ok AS BIGINT) AS n_verified, FALSE AS all_verified,
  length(text) / 4.0::DOUBLE AS retrieval_ms, CASE WHEN answer IS NULL THEN NULL ELSE 12.5::DOUBLE END AS generate_ms, 0.5::DOUBLE AS verify_ms,
  length(text) / 4.0::DOUBLE + CASE WHEN answer IS NULL THEN 0 ELSE 12.5::DOUBLE END + 0.5::DOUBLE AS total_ms,
  CASE WHEN answer IS NULL THEN NULL ELSE length(answer)::INTEGER END AS n_chars FROM k JOIN questions USING (qid)""")
def responses(t):
    q, c = questions(t), pathed(t)
    rec = q.select("qid", "item_id").join(c.select(F.col("doc_id").alias("item_id"), "chunk_id", "lang"), "item_id").select(
        "qid", F.concat(F.lit(" Vedi [cite:"), "chunk_id", F.lit("] e [cite:"), "lang", F.lit("]. ")).alias("text"), F.lit(12.5).alias("generate_ms"))
    times = q.select("qid", (F.length("text") / 4).alias("retrieval_ms"), F.lit(0.5).alias("verify_ms"))
    r = an.batch_responses(q, cut_lineage(sparse_topk(q, c, 5)), c, rec.withColumn("n_chars", F.length(F.trim("text"))), times=times)
    steps = [F.col("timings_ms")[s].alias(s) for s in [*an.STEPS, "total_ms"]]
    r = r.select("*", *steps, F.col("generation_meta.n_chars").alias("n_chars"))
    return r.select(*an.STEPS, "total_ms", "n_chars", "qid", "n_hits", F.md5(F.col("prompt").cast("binary")).alias("prompt_digest"), "answer", "annotated", "n_total", "n_verified", "all_verified")
