"""The corpus operators bound to the input tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pandekt.llm import ann, chat, divergence, line_dedup, mixing, near_vectors, ngram_join, packing, substrings, token_store, toxicity, treap, warc
from pandekt.llm.common import spread_rows, table
from pandekt.llm.tokens import default_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spread_rows(table(spark, sf_dir, "documents"), "doc_id"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, default_path())
    return store.get(token_store.document_keys(docs), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(spread_rows(table(spark, sf_dir, "documents"), "doc_id"), words=4, per_cent=85)


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spread_rows(docs, "doc_id"), model).select(
        "doc_id", toxicity.in_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_pack_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread_rows(table(spark, sf_dir, "documents"), "doc_id"), default_path(), with_ids=False).drop("ids")


def op9_neighbour_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


CHAT_PROBE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CHAT_PROBE).alias("text"))
                                                      for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe), default_path()), default_path())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spread_rows(table(spark, sf_dir, "documents"), "doc_id"))


def op12_lempel_ziv_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(spread_rows(table(spark, sf_dir, "documents"), "doc_id"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = treap.build_index(spread_rows(table(spark, sf_dir, "documents"), "doc_id"))
    return treap.search(index, table(spark, sf_dir, "benchmark"))


SHA256_OF_KEPT = """
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM doc),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT d.doc_id, d.pos, d.line, c.k IS NOT NULL AND d.doc_id <> c.keeper AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

CHAT_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {escaped_role} AS er, {escaped_text} AS et FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _escaped(column: str) -> str:
    """SQL of chat.escape: the same replacements, one per control string."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in sorted(chat.CONTROL, key=len, reverse=True):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first FROM p),
bits AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM b)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(list_reduce(list_transform(range(1, 6), lambda m: bits[5 * j + m]::INT), lambda x, y: 2 * x + y) + 1)]), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""

NGRAM_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
bi AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM reach r JOIN bi b ON b.x = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
degree AS (SELECT x, count(*) AS k FROM bi GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp c ON c.node = d.doc_id LEFT JOIN degree g ON g.x = d.doc_id"""

NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
bi AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT b.y, r.root FROM reach r JOIN bi b ON b.x = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
degree AS (SELECT x, count(*) AS k FROM bi GROUP BY x)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp JOIN v ON v.vec_id = comp.node LEFT JOIN degree ON x = vec_id"""

MIX_SQL = """
WITH RECURSIVE unit AS (SELECT source, doc_id, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens FROM documents GROUP BY ALL),
src AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS units FROM unit GROUP BY source),
span AS (SELECT max(tokens)::DOUBLE / sum(tokens) AS hi, min(tokens)::DOUBLE / sum(tokens) AS lo FROM src WHERE tokens > 0),
bisect AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b
  UNION ALL SELECT i + 1, CASE WHEN pow(hi / lo, 1 - (a + b) / 2) > 2 THEN (a + b) / 2 ELSE a END, CASE WHEN pow(hi / lo, 1 - (a + b) / 2) > 2 THEN b ELSE (a + b) / 2 END FROM bisect, span WHERE i < 60),
alpha AS (SELECT CASE WHEN hi / lo > 2 THEN b ELSE 0 END AS alpha FROM bisect, span WHERE i = 60),
weighed AS (SELECT source, tokens, units, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE / (SELECT sum(tokens) FROM src), alpha) ELSE 0 END AS raw FROM src, alpha),
budget AS (SELECT *, coalesce(round(raw * (SELECT max(tokens / raw) FROM weighed WHERE tokens > 0)), 0)::BIGINT AS budget FROM weighed),
plan AS (SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
  greatest(ceil(tokens / 262144.0), ceil(units / 65536.0), 1)::BIGINT AS blocks FROM budget),
used AS (SELECT u.source, u.doc_id, u.tokens, p.epochs, p.rest, p.blocks, unnest(range(0, p.epochs + CASE WHEN p.rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM unit u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source),
hashed AS (SELECT *, md5('17#' || epoch || '#' || coalesce('s' || source, 'n') || '#' || coalesce(doc_id::VARCHAR, 'null')) AS hash FROM used),
placed AS (SELECT *, ('0x' || substr(hash, 1, 15))::BIGINT % blocks AS block FROM hashed),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY block, hash, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start FROM placed)
SELECT source, epoch::BIGINT AS epoch, block::BIGINT AS block, doc_id, tokens, start::BIGINT AS start FROM summed WHERE epoch < epochs OR start + tokens <= rest"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS all_n FROM kept GROUP BY lang),
gs AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gs.lang, gs.source, kept.term, coalesce(c.n, 0) AS n, total, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (group_n + 5 * v) AS p, 1 + 1000000000::HUGEINT * (total + 5) // (all_n + 5 * v) AS q
  FROM gs JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = kept.term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

SPANS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i AS s, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS j FROM later),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS j, unnest(ws) AS x FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY j) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY ALL)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

TREAP_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
size AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS nd, sum(len(ws))::BIGINT AS l FROM t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
o AS (SELECT id, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM t),
tf AS (SELECT id, doc_id, n, term, count(*)::BIGINT AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, nd),
s AS (SELECT item_id, id, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 8 * (100 - 90 + 90 * n * nd // l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_graph_search, op3_token_store, op4_warc_normalise, op5_ngram_join, op6_temperature_mix, op7_toxicity, op8_pack_differencing, op9_neighbour_descent, op10_chat_format,
                            op11_source_divergence, op12_lempel_ziv_spans, op13_treap_search)
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": SHA256_OF_KEPT,
    "op4_warc_normalise": WARC_SQL,
    "op5_ngram_join": NGRAM_SQL,
    "op9_neighbour_descent": NEAR_SQL,
    "op6_temperature_mix": MIX_SQL,
    "op11_source_divergence": DIVERGENCE_SQL,
    "op12_lempel_ziv_spans": SPANS_SQL,
    "op13_treap_search": TREAP_SQL,
    "op10_chat_format": CHAT_SQL.format(escaped_role=_escaped("role"), escaped_text=_escaped("text")),
}
