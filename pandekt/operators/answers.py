"""Prompts, citations and complete responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.text import strip
from pandekt.session import cut_lineage

# Wording and separators of the question prompt.
QUESTION_LINE = "Domanda: "
CONTEXT_LINE = "Contesto normativo (%s riferimenti):"
NO_CONTEXT_LINE = "(nessun riferimento normativo recuperato)"
RELATED_LINE = "Riferimenti correlati (graph espansione):"
CLOSING_LINE = ("Rispondi alla domanda usando esclusivamente il contesto normativo fornito. "
                "Cita ogni affermazione con [cite:CHUNK_ID].")
BLOCK_SEPARATOR, BLOCK_END, PATH_JOIN = "---", "===", " > "

# Fixed value: a citation marker; the id has no blank and no closing bracket.
CITE_RE = r"\[cite:([^\]\s]+)\]"
UNVERIFIED = " NON VERIFICATA"


def hit_block(chunk_id: Column, path: Column, text: Column) -> Column:
    joined = F.array_join(F.coalesce(path, F.array().cast("array<string>")), PATH_JOIN)
    return F.concat_ws("\n", F.concat(F.lit("[chunk_id: "), chunk_id, F.lit("]")), F.when(joined != "", joined),
                       F.lit(BLOCK_SEPARATOR), strip(F.coalesce(text, F.lit(""))), F.lit(BLOCK_END))


def context_prompt(queries: DataFrame, hits: DataFrame, chunks: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """One prompt per question: question, numbered context blocks, related links, instruction.

    ``hits`` must be a top-k table: the blocks of a question are put together
    in one row. chunks(chunk_id, text, hierarchy_path). The narrow hits are
    written first, so that Spark knows their size and, when they are few,
    doesn't shuffle the chunks to find theirs.
    """
    blocks = cut_lineage(hits.select("qid", "rank", "chunk_id")).join(chunks.select("chunk_id", "hierarchy_path", "text"), "chunk_id")
    ctx = blocks.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", hit_block(F.col("chunk_id"), F.col("hierarchy_path"), F.col("text")).alias("b")))).alias("_b"))
    j = queries.select("qid", "text").join(ctx, "qid", "left")
    related = F.lit(None).cast("string")
    if expansions is not None:
        line = F.concat(F.lit("- [chunk_id: "), F.col("chunk_id"), F.lit("]: "), F.col("relation"), F.lit(" — "), F.col("note"))
        rel = expansions.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("source_rank", "chunk_id", line.alias("l")))).alias("_r"))
        j = j.join(rel, "qid", "left")
        related = F.when(F.col("_r").isNotNull(), F.concat(F.lit(f"\n{RELATED_LINE}\n"), F.array_join(F.transform("_r", lambda x: x["l"]), "\n")))
    n = F.coalesce(F.when(F.col("_b").isNotNull(), F.size("_b")), F.lit(0))
    prompt = F.concat_ws(
        "\n", F.concat(F.lit(QUESTION_LINE), strip(F.col("text"))), F.lit(""), F.format_string(CONTEXT_LINE, n.cast("string")), F.lit(""),
        F.when(n == 0, F.lit(NO_CONTEXT_LINE)).otherwise(F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n")),
        related, F.lit(""), F.lit(CLOSING_LINE))
    return j.select("qid", n.cast("long").alias("n_hits"), prompt.alias("prompt"))


def citations(answer: Column) -> Column:
    """Ordered array of (chunk_id, span_start, span_end), offsets in characters."""
    pieces = F.split(answer, CITE_RE, -1)
    ids = F.regexp_extract_all(answer, F.lit(CITE_RE), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<chunk_id:string,span_start:int,span_end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["c"]) + 7  # brackets and the word cite
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            x["c"].alias("chunk_id"), begin.alias("span_start"), end.alias("span_end")))).alias("out"))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(ids)), ids, lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    return F.aggregate(pairs, start, step)["out"]


def extract_citations(answers: DataFrame, key: list[str], answer: str = "answer") -> DataFrame:
    """One row per marker occurrence, in order, duplicates kept."""
    return answers.select(*key, F.posexplode(citations(F.col(answer))).alias("pos", "_c")).select(*key, "pos", "_c.*")


def contexts(hits: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """Retrieved ids per question (a top-k list, plus the expansions when the graph is on)."""
    ids = hits.select("qid", "chunk_id")
    if expansions is not None:
        ids = ids.unionByName(expansions.select("qid", "chunk_id"))
    return ids.groupBy("qid").agg(F.collect_set("chunk_id").alias("context"))


def verify_citations(answers: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """Add markers with verdicts, counts and the annotated text.

    ``context`` is the array of ids shown to the model. Unknown markers are
    rewritten in place, never removed. Row-local, no shuffle.
    """
    ctx = F.coalesce(F.col(context), F.array().cast("array<string>"))
    marks = F.transform(citations(F.col(answer)), lambda m: F.struct(
        m["chunk_id"].alias("chunk_id"), m["span_start"].alias("span_start"), m["span_end"].alias("span_end"),
        F.array_contains(ctx, m["chunk_id"]).alias("verified"),
        F.when(F.array_contains(ctx, m["chunk_id"]), "ok").otherwise("unknown_chunk_id").alias("reason")))
    out = answers.withColumn("markers", marks)
    n = F.size("markers").cast("long")
    ok = F.size(F.filter("markers", lambda m: m["verified"])).cast("long")
    return out.select("*", n.alias("n_total"), ok.alias("n_verified"), (n - ok).alias("n_unverified"), (n == ok).alias("all_verified"),
                      annotate(F.col(answer), F.col("markers")).alias("annotated"))


def annotate(answer: Column, markers: Column) -> Column:
    """Put the pieces of an answer together again with unverified markers labelled."""
    pieces = F.split(answer, CITE_RE, -1)
    shown = F.transform(markers, lambda m: F.concat(
        F.lit("[cite:"), m["chunk_id"], F.when(m["verified"], F.lit("")).otherwise(F.lit(UNVERIFIED)), F.lit("]")))
    return F.array_join(F.zip_with(pieces, F.concat(shown, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")


def lint_citations(entries: DataFrame, kind: str = "query_type", n_gold: str = "n_gold", answer: str = "answer") -> DataFrame:
    """Citation problems of gold answers: one row per problem."""
    n = F.regexp_count(F.col(answer), F.lit(CITE_RE))
    problems = F.array_compact(F.array(
        F.when((F.col(kind) == "positive") & (F.col(n_gold) > 0) & (n == 0), "positive_without_citation"),
        F.when((F.col(kind) == "negative") & (F.col(n_gold) == 0) & (n > 0), "negative_with_citation"),
        F.when(F.col(answer).rlike(r"\[cite:[^\]]+\]\[cite:"), "adjacent_citations")))
    keep = [c for c in entries.columns if c != answer]
    return entries.select(*keep, F.explode(problems).alias("problem"))


STEPS = ["retrieval_ms", "generate_ms", "verify_ms"]


def batch_responses(queries: DataFrame, hits: DataFrame, chunks: DataFrame, recorded: DataFrame,
                    expansions: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """Question to verified answer in one row.

    recorded(qid, text, generate_ms, ...) holds the completions; questions without
    one keep null answers and are the ones to send to a live generator. Its
    other columns (model, token counts, ...) come back as ``generation_meta``.
    times(qid, retrieval_ms, verify_ms) are the steps measured elsewhere.
    ``timings_ms`` holds the three steps and their total; a step without a
    time is null and adds nothing.
    """
    prompts = context_prompt(queries, hits, chunks, expansions)
    more = [c for c in recorded.columns if c not in ("qid", "text", "generate_ms")]
    meta = F.struct(*more).alias("generation_meta") if more else F.lit(None).cast("string").alias("generation_meta")
    done = prompts.join(recorded.select("qid", F.trim("text").alias("answer"), "generate_ms", meta), "qid", "left")
    if times is not None:
        done = done.join(times.select("qid", "retrieval_ms", "verify_ms"), "qid", "left")
    else:
        done = done.withColumns({c: F.lit(None).cast("double") for c in ("retrieval_ms", "verify_ms")})
    checked = verify_citations(done.join(contexts(hits, expansions), "qid", "left"))
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in STEPS), F.lit(0.0))
    pairs = [x for c in STEPS for x in (F.lit(c), F.col(c).cast("double"))]
    return checked.withColumn("timings_ms", F.create_map(*pairs, F.lit("total_ms"), total)).drop("context", *STEPS)


def respond(queries: DataFrame, chunks: DataFrame, glossary: DataFrame, subqueries: DataFrame, recorded: DataFrame, generator=None,
            schema: str = "qid string, text string, generate_ms double", times: DataFrame | None = None, **options) -> DataFrame:
    """Questions to verified answers, retrieval included.

    Questions naming several laws are searched law by law and fused, others as
    they are (see ``retrieve_cross``). Questions without a recorded completion go
    to ``generator``, which maps batches of (qid, prompt) to rows of ``schema``.
    """
    from pandekt.operators.fusion import retrieve_cross
    from pandekt.operators.understanding import generate

    hits = cut_lineage(retrieve_cross(queries, chunks, glossary, subqueries, **options).select("qid", "rank", "chunk_id", "score"))
    if generator is not None:
        pending = context_prompt(queries, hits, chunks).select("qid", "prompt").join(recorded.select("qid"), "qid", "left_anti")
        recorded = recorded.select("qid", "text", "generate_ms").unionByName(cut_lineage(generate(pending, generator, schema)))
    return batch_responses(queries, hits, chunks, recorded, times=times)
