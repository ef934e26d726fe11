"""Question understanding over documents, benchmark passages and conversations."""

from pyspark.sql import functions as F

from pandekt.operators import keys as ky
from pandekt.operators import understanding as u
from pandekt.plans.base import chunks, questions
from pandekt.operators.fusion import cross_rankings, retrieve_cross
from pandekt.plans.registry import query
from pandekt.plans.sqlbits import CHUNKS, WORD, bm25

# Aliases and patterns over words of the data.
ALIASES = {
    "the": ["definite article", "that thing"],
    "de la": ["of the"],
    "der": ["definite article", "male form"],
    "und": ["AND", "plus"],
    "that": ["that thing"],
}
PATTERNS = [("en", r"\bthe\b"), ("fr", r"\b(de|la)\b"), ("de", r"\b(der|die|das)\b"), ("es", r"\b(el|los)\b"), ("num", r"\d+"), ("end", r"ing\.")]

NB = r"(^|[^\p{L}\p{M}\p{N}_])"
NA = r"($|[^\p{L}\p{M}\p{N}_])"


def alias_sql(text: str) -> str:
    """Reference statement: the same rules spelled out form by form."""
    parts, picked = [], []
    for key, forms in ALIASES.items():
        hit = f"contains(lower({text}), '{key.lower()}')" if " " in key else f"regexp_matches({text}, '(?i){NB}{key}{NA}')"
        for f in forms:
            cond = f"({hit} AND NOT contains(lower({text}), '{f.lower()}'))"
            for ef, ec in picked:
                if ef.lower() == f.lower():
                    cond = f"({cond} AND NOT {ec})"
            picked.append((f, cond))
            parts.append(f"CASE WHEN {cond} THEN '{f}' END")
    return f"concat_ws(' ', {text}, {', '.join(parts)})"


@query("c1_expand_terms", f"""SELECT 'c' || conv_id || '-' || turn AS qid, {alias_sql('text')} AS expanded FROM conversations
UNION ALL SELECT 'b' || item_id, {alias_sql('text')} FROM benchmark""")
def expand(t):
    q = t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), "text")
    q = q.unionByName(t.benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), "text"))
    return q.select("qid", u.expand_terms(F.col("text"), ALIASES).alias("expanded"))


def entity_sql(text: str) -> str:
    cases = []
    for pid, rx in PATTERNS:
        body = rx.replace(r"\b", "")
        if rx.startswith(r"\b"):
            body = f"{NB}({body}){NA}"
        cases.append(f"CASE WHEN regexp_matches({text}, '(?i){body}') THEN '{pid}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


ENTITIES = f"ent AS (SELECT doc_id AS qid, text, {entity_sql('text')} AS entities FROM documents)"


def detected(t):
    return t.documents.select(F.col("doc_id").alias("qid"), "text", u.detect_entities(F.col("text"), PATTERNS).alias("entities"))


@query("c2_detect_entities", f"WITH {ENTITIES} SELECT qid, array_to_string(entities, ',') AS entities FROM ent")
def detect(t):
    return detected(t).select("qid", F.array_join("entities", ",").alias("entities"))


# Phrases that name laws in several spellings, and some that only look alike.
LAW_PHRASES = [
    "secondo il GDPR", "il RGPD", "Regolamento (UE) 2016/679", "Reg. UE n. 2024/1689", "l'AI Act e la FRIA", "la IA  Act", "D.Lgs. n. 231", "Decreto Legislativo 231/2001 e NIS2",
    "ai sensi del 231", "reato-presupposto", "D. Lgs. 138/2024", "Codice della Privacy", "trattamento illecito di dati", "Legge n. 132 del 2025", "L. 132/2025 e gdpr", "gdprx 12310", "scoring creditizio", "la dpia",
]


def law_questions(t):
    phrase = F.element_at(F.array(*[F.lit(p) for p in LAW_PHRASES]), (F.pmod(F.col("doc_id"), F.lit(len(LAW_PHRASES))) + 1).cast("int"))
    return t.documents.select("doc_id", F.concat_ws(" ", phrase, F.substring("source", 1, 5)).alias("q"))


_PHRASED = "SELECT doc_id, [" + ", ".join("'" + p.replace("'", "''") + "'" for p in LAW_PHRASES) + f"][doc_id % {len(LAW_PHRASES)} + 1] || ' ' || substr(source, 1, 5) AS q FROM documents"


@query("c2_default_patterns", f"""WITH p AS ({_PHRASED})
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(q, '{rx}', 'i') THEN '{pid}' END" for pid, rx in u.DEFAULT_PATTERNS)}], lambda x: x IS NOT NULL), ',') AS entities FROM p""")
def default_patterns(t):
    return law_questions(t).select("doc_id", F.array_join(u.detect_entities(F.col("q")), ",").alias("entities"))


@query("c1_default_aliases", f"""WITH p AS ({_PHRASED})
SELECT doc_id, concat_ws(' ', q, CASE WHEN regexp_matches(q, '(^|[^a-z])fria($|[^a-z])', 'i') THEN 'valutazione d''impatto sui diritti fondamentali' END,
  CASE WHEN regexp_matches(q, '(^|[^a-z])dpia($|[^a-z])', 'i') THEN 'valutazione d''impatto sulla protezione dei dati' END, CASE WHEN contains(lower(q), 'scoring creditizio') THEN 'merito di credito' END) AS expanded FROM p""")
def default_aliases(t):
    return law_questions(t).select("doc_id", u.expand_terms(F.col("q")).alias("expanded"))


@query("c3_route_queries", f"""WITH {ENTITIES} SELECT qid, len(entities) AS n_entities, CASE WHEN len(entities) >= 2 THEN 'multi' ELSE 'fallback' END AS path FROM ent""")
def routed(t):
    return detected(t).select("qid", F.size("entities").cast("long").alias("n_entities"), u.route(F.col("entities")).alias("path"))


def glossary(t):
    """Entity ids as laws: the language codes map to sources, others stay unmapped."""
    langs = t.documents.groupBy(F.col("lang").alias("norm_id")).agg(
        F.min("source").alias("doc_urn"), F.concat(F.lit("Lingua "), F.max("lang")).alias("short_name"),
        F.array(F.min("source"), F.max("source")).alias("vocabulary"))
    return langs


GLOSSARY = """gl AS (SELECT lang AS norm_id, min(source) AS doc_urn, 'Lingua ' || max(lang) AS short_name, [min(source), max(source)] AS vocabulary FROM documents GROUP BY lang)"""

FANNED = """
fan AS (SELECT qid, CAST(i - 1 AS INTEGER) AS source_pos, 'norm:' || norm_id AS source, norm_id, doc_urn
  FROM (SELECT qid, unnest(entities) AS norm_id, generate_subscripts(entities, 1) AS i FROM ent) JOIN gl USING (norm_id)
  UNION ALL SELECT qid, CAST(len(entities) AS INTEGER), 'global', NULL, NULL FROM ent)"""


@query("c4_fan_out", f"WITH {ENTITIES},{GLOSSARY},{FANNED} SELECT * FROM fan")
def fan_out(t):
    return u.fan_out(detected(t), glossary(t))


@query("c4_unmapped", f"""WITH {ENTITIES} SELECT qid, norm_id FROM (SELECT qid, unnest(entities) AS norm_id FROM ent) WHERE norm_id NOT IN (SELECT lang FROM documents)""")
def unmapped(t):
    return u.unmapped_entities(detected(t), glossary(t))


@query("c5_render_prompt", f"""WITH {ENTITIES},{GLOSSARY},{FANNED}
SELECT f.qid, f.norm_id, 'Norma: ' || short_name || chr(10) || chr(10) || 'Vocabolario:' || chr(10) ||
  array_to_string(list_transform(vocabulary, lambda v: '- ' || v), chr(10)) || chr(10) || chr(10) || 'Domanda:' || chr(10) || '"' || text || '"' AS prompt
FROM fan f JOIN gl USING (norm_id) JOIN ent USING (qid)""")
def prompts(t):
    q = detected(t)
    return u.subquery_prompts(u.fan_out(q, glossary(t)), q, glossary(t))


@query("c5_unknown_ids", f"""WITH {ENTITIES} SELECT DISTINCT norm_id FROM (SELECT unnest(entities) AS norm_id FROM ent) WHERE norm_id NOT IN (SELECT lang FROM documents)""")
def unknown(t):
    return u.unknown_ids(detected(t).select(F.explode("entities").alias("norm_id")), glossary(t))


@query("c6_resolve_completions", """
WITH p AS (SELECT conv_id, turn + 1 AS turn, text AS prompt FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, '  ' || text || ' ' AS text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, prompt, trim(r.text) AS completion, r.text IS NULL AS pending FROM p LEFT JOIN r USING (conv_id, turn)""")
def completions(t):
    c = t.conversations
    p = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    r = c.filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    return u.resolve_completions(p, r, ["conv_id", "turn"])


QENT = f"qe AS (SELECT 'B' || item_id AS qid, text, {entity_sql('text')} AS entities FROM benchmark)"


def cross_parts(t):
    q = questions(t).select("qid", "text")
    e = q.withColumn("entities", u.detect_entities(F.col("text"), PATTERNS))
    sub = e.select("qid", F.explode("entities").alias("norm_id"), "text").select("qid", "norm_id", F.concat_ws(" ", "text", "norm_id").alias("text"))
    return q, e, sub


@query("d9_cross_retrieve", f"""WITH {CHUNKS},{QENT},{GLOSSARY},
multi AS (SELECT * FROM qe WHERE len(entities) >= 2),
sq AS (SELECT qid || '|' || norm_id AS qid, doc_urn AS want, text || ' ' || norm_id AS text FROM (SELECT qid, text, unnest(entities) AS norm_id FROM multi) JOIN gl USING (norm_id)
  UNION ALL SELECT qid || '|global', NULL, text FROM multi),
{bm25('r', 5, 'sq', 'q.want IS NULL OR q.want = p.doc_urn')},
f AS (SELECT split_part(qid, '|', 1) AS qid, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r GROUP BY ALL),
fused AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score, 'multi' AS path FROM f QUALIFY rank <= 20),
fb AS (SELECT qid, text FROM qe WHERE len(entities) < 2),
{bm25('pl', 20, 'fb')}
SELECT * FROM fused UNION ALL SELECT qid, rank, chunk_id, score, 'fallback' FROM pl""")
def cross(t):
    q, _, sub = cross_parts(t)
    return retrieve_cross(q, chunks(t), glossary(t), sub, mode="sparse", patterns=PATTERNS)


@query("d10_cross_rankings", f"""WITH {CHUNKS},{QENT},{GLOSSARY},
multi AS (SELECT * FROM qe WHERE len(entities) >= 2),
sq AS (SELECT qid || '|norm:' || norm_id AS qid, doc_urn AS want, text || ' ' || norm_id AS text FROM (SELECT qid, text, unnest(entities) AS norm_id FROM multi) JOIN gl USING (norm_id)
  UNION ALL SELECT qid || '|global', NULL, text FROM multi),
{bm25('r', 5, 'sq', 'q.want IS NULL OR q.want = p.doc_urn')}
SELECT split_part(qid, '|', 1) AS qid, split_part(qid, '|', 2) AS source, rank, chunk_id, score FROM r""")
def cross_trace(t):
    _, e, sub = cross_parts(t)
    multi = e.filter(F.size("entities") >= 2)
    return cross_rankings(multi, chunks(t), glossary(t), sub, mode="sparse").select("qid", "source", "rank", "chunk_id", "score")


# ------------------------------------------------------- keys as tables

PART_KEYS = f"""
tx AS (SELECT p_partkey AS qid, 'Have ' || p_name || ' ' || p_partkey || ', or ' || upper(p_name) || ' ' || (p_partkey + 64) || '; ' || p_brand || '!' AS text FROM part),
ky AS (SELECT p_partkey AS alias_pos, p_name || ' ' || p_partkey AS key, [p_type, p_name, p_brand || ' of ' || p_type] AS forms FROM part
  UNION ALL SELECT -1 - min(p_size), p_brand, ['brand', 'BRAND', min(p_type)] FROM part GROUP BY p_brand),
tw AS (SELECT qid, text, ' ' || array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ') || ' ' AS w FROM tx),
kw AS (SELECT alias_pos, key, forms, ' ' || array_to_string(regexp_extract_all(lower(key), '{WORD}'), ' ') || ' ' AS k FROM ky),
met AS (SELECT qid, text, alias_pos, key, forms FROM tw JOIN kw ON contains(w, k))"""


def part_keys(t):
    """Texts naming two parts and a brand, and a key for every part and brand with its alias forms."""
    p = t.part
    n, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    texts = p.select(n.alias("qid"), F.concat(F.lit("Have "), "p_name", F.lit(" "), text("p_partkey"), F.lit(", or "), F.upper("p_name"), F.lit(" "), (n + 64).cast("string"), F.lit("; "), "p_brand", F.lit("!")).alias("text"))
    own = p.select(n.cast("long").alias("alias_pos"), F.concat("p_name", F.lit(" "), text("p_partkey")).alias("key"), F.array("p_type", "p_name", F.concat("p_brand", F.lit(" of "), "p_type")).alias("forms"))
    brands = p.groupBy("p_brand").agg((-1 - F.min("p_size")).cast("long").alias("alias_pos"), F.array(F.lit("brand"), F.lit("BRAND"), F.min("p_type")).alias("forms"))
    return texts, own.unionByName(brands.select("alias_pos", F.col("p_brand").alias("key"), "forms"))


@query("c1_alias_table", f"""WITH {PART_KEYS},
f AS (SELECT DISTINCT qid, text, alias_pos, generate_subscripts(forms, 1) AS form_pos, unnest(forms) AS form FROM met),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, lower(form) ORDER BY alias_pos, form_pos, form) AS i FROM f WHERE NOT contains(lower(text), lower(form)))
SELECT tx.qid, concat_ws(' ', tx.text, string_agg(form, ' ' ORDER BY alias_pos, form_pos, form)) AS expanded FROM tx LEFT JOIN n ON n.qid = tx.qid AND n.i = 1 GROUP BY tx.qid, tx.text""")
def alias_table(t):
    return ky.expand_terms_by(*part_keys(t))


@query("c2_name_table", f"""WITH {PART_KEYS}, e AS (SELECT qid, key, min(alias_pos) AS p FROM met GROUP BY ALL)
SELECT tx.qid, coalesce(string_agg(key, '|' ORDER BY p, key), '') AS entities FROM tx LEFT JOIN e USING (qid) GROUP BY tx.qid""")
def name_table(t):
    texts, keys = part_keys(t)
    names = keys.select(F.col("alias_pos").alias("entity_pos"), F.col("key").alias("entity"), F.col("key").alias("name"))
    return ky.detect_entities_by(texts, names).withColumn("entities", F.array_join("entities", "|"))


@query("c6_generate", """
WITH p AS (SELECT conv_id, turn + 1 AS turn, text AS prompt FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0)
SELECT conv_id, turn, CASE WHEN r.text IS NULL THEN 'Echo: ' || substr(prompt, 1, 40) ELSE trim(r.text) END AS completion, r.text IS NULL AS generated FROM p LEFT JOIN r USING (conv_id, turn)""")
def generated(t):
    """Two thirds of the completions are not recorded and come from a generator that repeats the prompt."""
    c = t.conversations
    p = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    r = c.filter("role = 'assistant' AND conv_id % 3 = 0").select("conv_id", "turn", "text")
    done = u.resolve_completions(p, r, ["conv_id", "turn"])

    def echo(batches):
        for pdf in batches:
            yield pdf.assign(completion="Echo: " + pdf["prompt"].fillna("").str[:40])[["conv_id", "turn", "completion"]]

    live = u.generate(done.filter("pending").select("conv_id", "turn", "prompt"), echo, "conv_id bigint, turn bigint, completion string")
    return done.filter("NOT pending").select("conv_id", "turn", "completion", F.lit(False).alias("generated")).unionByName(live.withColumn("generated", F.lit(True)))
