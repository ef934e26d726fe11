"""Article and unit chunks with a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.text import count_tokens, strip
from pandekt.operators.packing import THRESHOLD, group_starts, slices

CHUNK_COLUMNS = ["chunk_id", "text", "source_type", "chunk_type", "doc_urn", "article_eid", "para_eids", "hierarchy_path", "metadata"]
METADATA_TYPE = ("struct<article_number:string,rubrica:string,tokens:int,oversize:boolean,group_index:int,group_count:int,"
                 "first_comma:string,last_comma:string,recital_number:int,annex_id:string,point:int,n_letters:int,annex_title:string>")


def metadata(**fields: Column) -> Column:
    """The typed metadata struct; fields not given are null."""
    out = []
    for part in METADATA_TYPE[len("struct<"):-1].split(","):
        name, kind = part.split(":")
        out.append(fields.get(name, F.lit(None)).cast(kind).alias(name))
    return F.struct(*out)


def render_paragraph(number: Column, text: Column) -> Column:
    """Text with its number in front, unless the text already starts with it."""
    t = strip(text)
    has = t.startswith(F.concat(number, F.lit("."))) | t.startswith(F.concat(number, F.lit(" ")))
    return F.when(number.isNull() | has, t).otherwise(F.concat(number, F.lit(". "), t))


def render_article(label: str, number: Column, heading: Column, paragraphs: Column) -> Column:
    """Header line and the non-empty paragraphs, separated by blank lines."""
    head = F.concat(F.lit(f"{label} "), number)
    head = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(head, F.lit(" - "), heading)).otherwise(head)
    shown = F.filter(paragraphs, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.array_join(F.concat(F.array(head), F.transform(shown, lambda p: render_paragraph(p["number"], p["text"]))), "\n\n")


def build_chunks(articles: DataFrame, source_type: str = "eurlex", label: str = "Articolo", threshold: int = THRESHOLD,
                 tokens=count_tokens, body_is_whole: bool = True) -> DataFrame:
    """Chunks of articles(doc_urn, article_eid, number, rubrica, hierarchy_path, paragraphs).

    ``paragraphs`` is the ordered array<struct<eid, number, text>> of one
    article. An article within the budget is one chunk; an oversize one whose
    paragraphs cannot be split (none, or a single body without number when
    ``body_is_whole``) is one chunk marked oversize; otherwise its paragraphs
    are packed into groups. All work stays inside the row of the article.
    """
    paras = F.col("paragraphs")
    sized = articles.withColumn("_full", render_article(label, F.col("number"), F.col("rubrica"), paras)).withColumn("_tokens", tokens(F.col("_full")))
    single_body = (F.size(paras) == 1) & paras[0]["number"].isNull() if body_is_whole else F.lit(False)
    whole = (F.col("_tokens") <= threshold) | (F.size(paras) == 0) | single_body
    per = F.transform(paras, lambda p: tokens(render_paragraph(p["number"], p["text"])))
    starts = F.when(F.col("_whole"), F.array(F.lit(0))).otherwise(group_starts(per, threshold))
    started = sized.withColumn("_whole", whole).withColumn("_starts", starts)
    cut = started.select("*", F.posexplode(slices(paras, F.col("_starts"))).alias("_gi", "_g"), F.size("_starts").alias("_gc"))
    split_text = render_article(label, F.col("number"), F.col("rubrica"), F.col("_g"))
    first, last = F.element_at("_g", 1)["number"], F.element_at("_g", -1)["number"]
    out = cut.withColumn("_text", F.when(F.col("_whole"), F.col("_full")).otherwise(split_text))
    w = F.col("_whole")
    base = F.concat_ws("__", "doc_urn", "article_eid")
    none = lambda c: F.when(~w, c)
    # A paragraph without number shows up in the id the way it is spelled: None.
    name = lambda c: F.coalesce(c, F.lit("None"))
    return out.select(
        F.when(w, base).otherwise(F.concat(base, F.lit("__paras_"), name(first), F.lit("_"), name(last))).alias("chunk_id"),
        F.col("_text").alias("text"), F.lit(source_type).alias("source_type"),
        F.when(w, "article").otherwise("article_group").alias("chunk_type"), "doc_urn", "article_eid",
        F.when(w, F.array().cast("array<string>")).otherwise(F.transform("_g", lambda p: p["eid"])).alias("para_eids"), "hierarchy_path",
        metadata(
            article_number=F.col("number"), rubrica=F.col("rubrica"), tokens=F.when(w, F.col("_tokens")).otherwise(tokens(F.col("_text"))),
            oversize=F.when(w & (F.col("_tokens") > threshold), F.lit(True)), group_index=none(F.col("_gi")), group_count=none(F.col("_gc")),
            first_comma=none(first), last_comma=none(last),
        ).alias("metadata"),
    )


def recital_chunks(recitals: DataFrame, tokens=count_tokens) -> DataFrame:
    """recitals(doc_urn, number, text) to ``Considerando N`` chunks."""
    n = F.col("number").cast("string")
    title = F.concat(F.lit("Considerando "), n)
    text = F.concat(title, F.lit("\n\n"), F.col("text"))
    return recitals.select(
        F.concat("doc_urn", F.lit("__recital_"), n).alias("chunk_id"), text.alias("text"), F.lit("eurlex").alias("source_type"),
        F.lit("recital").alias("chunk_type"), "doc_urn", F.lit(None).cast("string").alias("article_eid"),
        F.array().cast("array<string>").alias("para_eids"), F.array(title).alias("hierarchy_path"),
        metadata(recital_number=F.col("number"), tokens=tokens(text)).alias("metadata"),
    )


def annex_chunks(annexes: DataFrame, tokens=count_tokens) -> DataFrame:
    """annexes(doc_urn, annex_id, title, text, point, n_letters, annex_title) to chunks.

    A point of an annex (``__point_`` in its id) gets a two-level path.
    """
    aid, title = F.col("annex_id"), F.coalesce("title", F.lit(""))
    root = F.substring_index(aid, "__point_", 1)
    is_point = aid.contains("__point_")
    point = F.concat(F.lit("Allegato "), root, F.lit(", punto "), F.coalesce(F.col("point").cast("string"), F.lit("None")), F.lit(": "), title)
    path = F.when(is_point, F.array(
        F.concat(F.lit("Allegato "), root, F.lit(" - "), F.coalesce("annex_title", title)), F.rtrim(point, F.lit(": ")),
    )).otherwise(F.array(F.concat(F.lit("Allegato "), aid, F.lit(" - "), title)))
    return annexes.select(
        F.concat("doc_urn", F.lit("__annex_"), aid).alias("chunk_id"), "text", F.lit("eurlex").alias("source_type"), F.lit("annex").alias("chunk_type"),
        "doc_urn", F.concat(F.lit("annex_"), aid).alias("article_eid"), F.array().cast("array<string>").alias("para_eids"),
        path.alias("hierarchy_path"),
        metadata(annex_id=aid, tokens=tokens(F.col("text")), point=F.col("point"), n_letters=F.col("n_letters"), annex_title=F.col("annex_title")).alias("metadata"),
    )


def assemble_corpus(*parts: DataFrame) -> DataFrame:
    """All chunk kinds in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """Chunk counts by source type, chunk type and overall."""
    return chunks.groupingSets([["source_type"], ["chunk_type"], []], "source_type", "chunk_type").agg(F.count(F.lit(1)).alias("n"))


def chunk_invariants(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per rule with the number of violations (0 everywhere when sound)."""
    dup = chunks.groupBy("chunk_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_id").alias("rule"), "n")
    kinds = chunks.agg(
        F.count_if((F.col("chunk_type") == "article") & (F.size("para_eids") > 0)).alias("a"),
        F.count_if((F.col("chunk_type") == "article_group") & (F.size("para_eids") == 0)).alias("b"),
    ).select(F.inline(F.array(F.struct(F.lit("article_with_paragraphs").alias("rule"), F.col("a").alias("n")),
                              F.struct(F.lit("group_without_paragraphs").alias("rule"), F.col("b").alias("n")))))
    # Positions instead of a collected list: group g of an article must start
    # where group g-1 ended, so sizes and first/last ids are compared per row.
    a = articles.select("doc_urn", "article_eid", F.transform("paragraphs", lambda p: p["eid"]).alias("_all"))
    groups = chunks.filter("chunk_type = 'article_group'").groupBy("doc_urn", "article_eid").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("metadata.group_index", "para_eids"))), lambda g: g["para_eids"])).alias("_seen"))
    broken = groups.join(a, ["doc_urn", "article_eid"]).agg(F.count_if(F.col("_seen") != F.col("_all")).alias("n")).select(F.lit("groups_differ_from_article").alias("rule"), "n")
    uncovered = a.join(chunks.select("doc_urn", "article_eid"), ["doc_urn", "article_eid"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("article_not_covered").alias("rule"), "n")
    return dup.unionByName(kinds).unionByName(broken).unionByName(uncovered)
