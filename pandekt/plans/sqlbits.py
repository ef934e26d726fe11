"""SQL fragments shared by the reference statements."""

WORD = r"[\p{L}\p{M}\p{N}_]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\x0B\p{Z}]"
NTOK = f"len(regexp_extract_all(%s, '{TOKEN}'))"
SPACE = r"[\s\x0B\p{Z}]+"

CHUNKS = """
chunks AS (SELECT source || '__art_' || doc_id AS chunk_id, source AS doc_urn, doc_id, lang, text FROM documents)"""

QUESTIONS = """
questions AS (SELECT 'B' || item_id AS qid, text FROM benchmark)"""


def bm25(name: str, k: int, questions: str = "questions", where: str = "TRUE") -> str:
    """CTEs ending in ``name(qid, rank, chunk_id, score)``."""
    return f"""
{name}_tok AS (SELECT chunk_id, doc_urn, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM chunks),
{name}_len AS (SELECT chunk_id, len(regexp_extract_all(lower(text), '{WORD}')) AS dl FROM chunks),
{name}_st AS (SELECT count(*) AS nd, avg(dl) AS avgdl FROM {name}_len),
{name}_tf AS (SELECT chunk_id, doc_urn, term, count(*) AS tf FROM {name}_tok GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_qt AS (SELECT DISTINCT * FROM (SELECT * EXCLUDE (text), unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM {questions})),
{name}_sc AS (
  SELECT q.qid, p.chunk_id,
    round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_qt q JOIN {name}_tf p USING (term) JOIN {name}_df USING (term) JOIN {name}_len USING (chunk_id) CROSS JOIN {name}_st
  WHERE {where} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM {name}_sc) WHERE rank <= {k})"""


PREFIX = "Rappresenta questo testo legale italiano per il recupero: "


def hashed(name: str, table: str, key: str, dim: int = 64) -> str:
    """CTE ``name(key, b, w)``: unit-length hashed bucket counts."""
    return f"""
{name}_c AS (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {dim} AS b, count(*) AS c FROM (
  SELECT {key}, unnest(regexp_extract_all(lower('{PREFIX}' || text), '{WORD}')) AS tok FROM {table}) GROUP BY ALL),
{name} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {name}_c)"""


def dense(name: str, k: int, questions: str = "questions", where: str = "TRUE") -> str:
    """CTEs ending in ``name(qid, rank, chunk_id, score)`` over hashed vectors."""
    return f"""{hashed(name + '_q', questions, 'qid')},{hashed(name + '_c', 'chunks', 'chunk_id')},
{name}_sc AS (SELECT q.qid, c.chunk_id, round(sum(q.w * c.w), 6) AS score
  FROM {name}_q q JOIN {name}_c c USING (b) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
  FROM {name}_sc WHERE {where}) WHERE rank <= {k})"""


def hybrid(name: str, k: int, questions: str = "questions") -> str:
    d = max(2 * k, 1)
    return f"""{dense(name + '_d', d, questions)},{bm25(name + '_s', d, questions)},
{name}_f AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (
  SELECT * FROM {name}_d UNION ALL SELECT * FROM {name}_s) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM {name}_f) WHERE rank <= {k})"""


def f1(q: str, d: str) -> str:
    a = f"list_distinct(regexp_extract_all(lower({q}), '{WORD}'))"
    b = f"list_distinct(regexp_extract_all(lower({d}), '{WORD}'))"
    return f"(2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})))"
