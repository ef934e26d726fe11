"""Document structure: segmentation, hierarchy, metadata and repeal rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.text import strip
from pandekt.operators.ordered import MAX_GROUP, carry_forward

# Line markers of the source text format.
SECTION_LINE = r"##\s+"
ARTICLE_LINE = r"###\s+Art\.\s*[0-9]"
PARAGRAPH_LINE = r"\(?\(?\d+(?:-[a-z]+)?\.\s+"
NOTE_LINE = r"AGGIORNAMENTO\s+\(\d+\)"


def _split_at(text: Column, marker: str, indent: bool = False) -> Column:
    """Cut a text before every line that starts with ``marker``."""
    lead = r"[ \t]*" if indent else ""
    return F.split(text, rf"\n(?={lead}(?:{marker}))")


def line_segmenter(df: DataFrame, text: str = "text", section: str = SECTION_LINE, article: str = ARTICLE_LINE,
                   paragraph: str = PARAGRAPH_LINE, note: str = NOTE_LINE) -> DataFrame:
    """Line text to paragraph and note rows.

    Section lines close the running article; article lines open one; inside an
    article paragraph lines open a paragraph that following lines continue;
    from the first note line on everything belongs to notes. Lines before the
    first paragraph, or outside any article, are dropped.

    Each text is cut by look-ahead splits inside its row: no explode of lines,
    no window and no shuffle. Result columns: the input columns without the
    text, section, article_pos, header, kind, unit_pos, unit_text.
    """
    keep = [c for c in df.columns if c != text]
    sections = df.select(*keep, F.posexplode(_split_at(F.col(text), section)).alias("_s", "_sec"))
    titled = sections.select(
        *keep, "_s", F.when(F.col("_sec").rlike(f"^(?:{section})"), F.split("_sec", "\n")[0]).alias("section"), "_sec")
    articles = titled.select(*keep, "_s", "section", F.posexplode(_split_at(F.col("_sec"), article)).alias("_a", "_art")).filter(
        F.col("_art").rlike(f"^(?:{article})"))
    body = F.regexp_extract(F.col("_art"), r"(?s)^[^\n]*\n?(.*)$", 1)
    # A leading line break lets the first body line match the look-ahead too.
    parts = articles.select(*keep, "section", F.struct("_s", "_a").alias("article_pos"), F.split("_art", "\n")[0].alias("header"),
                            _split_at(F.concat(F.lit("\n"), body), note, indent=True).alias("_p"))
    paras = F.filter(_split_at(F.concat(F.lit("\n"), F.col("_p")[0]), paragraph, indent=True),
                     lambda x: x.rlike(rf"^[ \t]*(?:{paragraph})"))
    notes = F.slice(F.col("_p"), 2, F.size("_p"))
    # Blank lines stay inside a paragraph and are skipped inside a note.
    para_text = lambda x: strip(F.array_join(F.transform(F.split(x, "\n"), strip), "\n"))
    note_text = lambda x: F.array_join(F.filter(F.transform(F.split(x, "\n"), strip), lambda l: l != ""), " ")
    units = F.concat(
        F.transform(paras, lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("unit_pos"), para_text(x).alias("unit_text"))),
        F.transform(notes, lambda x, i: F.struct(F.lit("note").alias("kind"), i.alias("unit_pos"), note_text(x).alias("unit_text"))),
    )
    return parts.select(*keep, "section", "article_pos", "header", F.inline(units))


_NUMERAL = r"([IVXLCDM\d][\w-]*)"


def carry_hierarchy(chapters: DataFrame, doc: str = "doc_urn", pos: str = "pos", number: str = "number", title: str = "title",
                    max_group: int = MAX_GROUP) -> DataFrame:
    """Running titolo, capo and sezione over the sibling chapters of a document.

    A capo sets the sezione to the one named in its title, or clears it; a
    titolo clears nothing. Clearing travels through the running value as an
    empty string.
    """
    n = F.col(number)

    def label(kind: str, source: Column = n, anchor: str = r"^\s*") -> Column:
        m = F.regexp_extract(source, rf"(?i){anchor}{kind}\s+{_NUMERAL}", 1)
        return F.when(m != "", F.concat(F.lit(kind.capitalize() + " "), F.upper(m)))

    titolo, capo, sezione = label("titolo"), label("capo"), label("sezione")
    embedded = label("sezione", F.coalesce(F.col(title), F.lit("")), r"\b")
    marked = chapters.withColumn("_t", titolo).withColumn("_c", F.when(titolo.isNull(), capo)).withColumn(
        "_s", F.when(titolo.isNotNull(), F.lit(None)).when(capo.isNotNull(), F.coalesce(embedded, F.lit(""))).otherwise(sezione))
    run = carry_forward(marked, [doc], [pos], {"_t": "titolo", "_c": "capo", "_s": "sezione"}, max_group)
    return run.withColumn("sezione", F.nullif("sezione", F.lit(""))).drop("_t", "_c", "_s")


def hierarchy_path(article_number: Column, *levels: Column) -> Column:
    return F.array_compact(F.array(*levels, F.concat(F.lit("art. "), article_number)))


def dedup_articles(articles: DataFrame, doc: str, eid: str, pos: str, fields: list[str]) -> DataFrame:
    """Duplicate ids: the last content wins, the first position is kept."""
    return articles.groupBy(doc, eid).agg(F.min(pos).alias(pos), *[F.max_by(f, pos).alias(f) for f in fields])


def assign_chapter(articles: DataFrame, spans: DataFrame, doc: str, pos: str, max_group: int = MAX_GROUP) -> DataFrame:
    """Chapter whose span [start_pos, end_pos] contains the article position.

    Spans of a document do not overlap, so the enclosing one is the last span
    started before the article: one running value instead of a range join.
    Unclaimed articles get the synthetic chapter ''.
    """
    fields = [c for c in articles.columns if c not in (doc, pos)]
    s = spans.select(F.col(doc), F.col("start_pos").alias(pos), F.lit(0).alias("_kind"),
                     F.struct("chapter_id", "end_pos").alias("_span"), *[F.lit(None).cast(articles.schema[c].dataType).alias(c) for c in fields])
    a = articles.select(doc, pos, F.lit(1).alias("_kind"), F.lit(None).cast(s.schema["_span"].dataType).alias("_span"), *fields)
    tie = [c for c in fields[:1]]
    run = carry_forward(s.unionByName(a), [doc], [pos, "_kind", *tie], {"_span": "_open"}, max_group)
    return run.filter("_kind = 1").select(
        doc, pos, *fields,
        F.when(F.col(pos) <= F.col("_open.end_pos"), F.col("_open.chapter_id")).otherwise(F.lit("")).alias("chapter_id"),
    )


# Upper-case markers of repealed articles.
HEADING_MARKERS = ["ARTICOLO ABROGATO", "ABROGATO DAL", "ABROGATO DA"]
PARAGRAPH_PREFIXES = ["((ARTICOLO ABROGATO", "(ARTICOLO ABROGATO", "ARTICOLO ABROGATO"]
RESIDUAL_MARKER = "ABROGAT"


def repeal_class(heading: Column, first_paragraph: Column, body: Column, markers: list[str] | None = None,
                 prefixes: list[str] | None = None, residual: str = RESIDUAL_MARKER) -> Column:
    """repealed, residual (mention elsewhere: kept, for review) or active."""
    hit = F.lit(False)
    for m in HEADING_MARKERS if markers is None else markers:
        hit = hit | F.coalesce(heading.contains(m), F.lit(False))
    start = strip(F.coalesce(first_paragraph, F.lit("")))
    for p in PARAGRAPH_PREFIXES if prefixes is None else prefixes:
        hit = hit | start.startswith(p)
    return F.when(hit, "repealed").when(F.upper(body).contains(residual), "residual").otherwise("active")


def doc_type_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^/akn/[^/]+/act/([^/]+)/", 1)


def doc_number_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"/act/[^/]+/[^/]+/[^/]+/([^/]+)(?:/|$)", 1)


# Title keyword to document type, in priority order.
TITLE_TYPES = [("REGOLAMENTO", "regulation"), ("DIRETTIVA", "directive"), ("DECISIONE", "decision")]


def type_from_title(title: Column) -> Column:
    out = F.lit("")
    for word, kind in reversed(TITLE_TYPES):
        out = F.when(F.upper(title).contains(word), F.lit(kind)).otherwise(out)
    return out


def numbered_units(df: DataFrame, eid: str, text: str, prefix: str) -> DataFrame:
    """Units whose id is ``prefix`` plus digits: number cast, one leading ``(N)`` removed."""
    digits = F.regexp_extract(F.col(eid), f"^{prefix}(\\d+)$", 1)
    return df.filter(digits != "").withColumn("number", digits.cast("int")).withColumn(
        text, F.regexp_replace(F.col(text), r"^\s*\(\s*\d+\s*\)\s*", ""))


def unhandled_elements(tags: DataFrame, allowed: list[str], tag: str = "tag", by: tuple[str, ...] = ()) -> DataFrame:
    """Element names outside the allowed set, counted (with the parent when given)."""
    return tags.filter(~F.col(tag).isin(allowed)).groupBy(*by, tag).agg(F.count(F.lit(1)).alias("n"))
