"""XML and HTML sources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.ids import article_number
from pandekt.functions.text import collapse_ws, cut_at_word

# ----------------------------------------------------------------------- XML

_PARAGRAPH = "struct<_eId:string,num:string>"
_ARTICLE = "struct<_eId:string,num:string,heading:string,paragraph:array<string>>"
_SCHEMA = (f"act struct<body:struct<chapter:array<struct<_eId:string,num:string,heading:string,article:array<{_ARTICLE}>>>,article:array<{_ARTICLE}>>>")
_KEYS_SCHEMA = _SCHEMA.replace("array<string>", f"array<{_PARAGRAPH}>")
# Private-use stand-in, so an escaped '<' is not taken for a tag later.
_LT = "\ue000"


def _inner_text(xml: Column) -> Column:
    """Text of an element whose inner markup was kept as a string."""
    return F.replace(collapse_ws(F.regexp_replace(xml, r"<[^>]*>", "")), F.lit(_LT), F.lit("<"))


def xml_sections(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Law XML to one row per (chapter, article, paragraph).

    The built-in XML reader is applied twice to the same value: once for ids
    and numbers, once keeping the paragraphs as markup whose tags are then
    removed. Paragraphs without id or number are dropped; a document without
    chapters gets one synthetic chapter.
    """
    source = F.regexp_replace(F.col(xml), "&lt;", _LT)
    options = {"ignoreNamespace": "true"}
    parsed = df.select(*keep, F.from_xml(source, _SCHEMA, options).alias("_t"), F.from_xml(source, _KEYS_SCHEMA, options).alias("_k"))

    def chapters(root: str) -> Column:
        body = F.col(f"{root}.act.body")
        synthetic = F.array(F.struct(F.lit("").alias("_eId"), F.lit(None).cast("string").alias("num"), F.lit(None).cast("string").alias("heading"),
                                     body["article"].alias("article")))
        return F.when(F.size(body["chapter"]) > 0, body["chapter"]).otherwise(synthetic)

    ch = parsed.select(*keep, F.posexplode(F.arrays_zip(chapters("_t").alias("t"), chapters("_k").alias("k"))).alias("chapter_pos", "_c"))
    art = ch.select(*keep, "chapter_pos", F.col("_c.t._eId").alias("chapter_eid"), _inner_text(F.col("_c.t.num")).alias("chapter_number"),
                    _inner_text(F.col("_c.t.heading")).alias("chapter_title"),
                    F.posexplode(F.arrays_zip(F.col("_c.t.article").alias("t"), F.col("_c.k.article").alias("k"))).alias("article_pos", "_a"))
    head = ["chapter_pos", "chapter_eid", "chapter_number", "chapter_title", "article_pos"]
    para = art.select(
        *keep, *head, F.col("_a.t._eId").alias("article_eid"), article_number(_inner_text(F.col("_a.t.num")), F.col("_a.t._eId")).alias("article_number"),
        F.nullif(_inner_text(F.col("_a.t.heading")), F.lit("")).alias("rubrica"),
        F.posexplode_outer(F.arrays_zip(F.col("_a.t.paragraph").alias("t"), F.col("_a.k.paragraph").alias("k"))).alias("para_pos", "_p"))
    return para.filter(F.col("_p").isNull() | (F.col("_p.k._eId").isNotNull() & F.col("_p.k.num").isNotNull())).select(
        *keep, *head, "article_eid", "article_number", "rubrica", "para_pos", F.col("_p.k._eId").alias("para_eid"),
        F.rtrim(_inner_text(F.col("_p.k.num")), F.lit(".")).alias("para_number"), _inner_text(F.col("_p.t")).alias("para_text"))


# ---------------------------------------------------------------------- HTML


# Class names of law pages and the prefix of a numbered paragraph.
MARKER_CLASSES = frozenset({"title-article-norm", "oj-ti-art"})
TITLE_CLASSES = frozenset({"eli-title"})
CHAPTER_TITLE_CLASSES = frozenset({"title-division-2", "eli-title"})
NOISE_CLASSES = frozenset({"modref", "footnote", "oj-doc-end", "oj-signatory"})
NUMBERED = r"^\s*(\d+(?:bis|ter|quater|quinquies)?)\.\s+"


@dataclass(frozen=True)
class HtmlRules:
    """What opens a section or chapter, what titles it, and what is noise."""

    section_tags: frozenset[str] = frozenset({"article", "section"})
    section_id_prefixes: tuple[str, ...] = ("art_",)
    chapter_id_prefixes: tuple[str, ...] = ("cpt_",)
    marker_classes: frozenset[str] = MARKER_CLASSES
    title_tags: frozenset[str] = frozenset({"h1", "h2", "h3"})
    title_classes: frozenset[str] = TITLE_CLASSES
    chapter_title_classes: frozenset[str] = CHAPTER_TITLE_CLASSES
    noise_tags: frozenset[str] = frozenset({"script", "style", "nav"})
    noise_classes: frozenset[str] = NOISE_CLASSES


_VOID = frozenset({"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"})
#: Elements whose start ends an open one of the listed kinds, up to the nearest of the stops.
_BLOCKS = ("p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6")
_ENDS = {**{t: (("p",), ("td", "th", "li", "div", "section", "article", "body")) for t in _BLOCKS}, "li": (("li",), ("ul", "ol")),
         "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
_NUMBERED = re.compile(NUMBERED, re.IGNORECASE)
_ARTICLE = re.compile(r"Articolo\s+(\d+(?:[-\w]+)?)", re.IGNORECASE)
_WS = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _WS.sub(" ", text.replace("\xa0", " ")).strip()


class _Node:
    """An element with its text pieces and child elements in order."""

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.id = tag, attrs.get("id") or ""
        self.classes = frozenset((attrs.get("class") or "").split())
        self.parts: list[str | _Node] = []

    def children(self) -> list[_Node]:
        return [x for x in self.parts if isinstance(x, _Node)]


class _Tree(HTMLParser):
    """A page as nested elements; unclosed elements end where HTML ends them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("body", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        closes, stops = _ENDS.get(tag, ((), ()))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in closes:
                del self.open[i:]
                break
            if self.open[i].tag in stops:
                break
        node = _Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.open[-1].parts.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def page_tree(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _is_noise(n: _Node, rules: HtmlRules) -> bool:
    return n.tag in rules.noise_tags or bool(n.classes & rules.noise_classes)


def _text(n: _Node, rules: HtmlRules, skip=lambda _: False) -> str:
    """All text of an element but that of noise and skipped elements; text behind those is kept."""
    out, todo = [], list(reversed(n.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not _is_noise(x, rules) and not skip(x):
            todo.extend(reversed(x.parts))
    return squeeze("".join(out))


def _is_section(n: _Node, rules: HtmlRules) -> bool:
    return n.tag in rules.section_tags or n.id.startswith(rules.section_id_prefixes)


def read_sections(html: str | None, rules: HtmlRules) -> list[dict]:
    """Sections of a page in document order, with the text outside of sections first."""
    root = page_tree(html)
    out: list[dict] = []
    outside: list[str] = []
    todo: list[tuple[_Node | str, _Node | None]] = [(x, None) for x in reversed(root.parts)]
    while todo:
        x, chapter = todo.pop()
        if isinstance(x, str):
            if squeeze(x):
                outside.append(squeeze(x))
            continue
        if _is_noise(x, rules):
            continue
        section = _is_section(x, rules)
        if section:
            out.append(_section(x, chapter, rules))
        elif x.id.startswith(rules.chapter_id_prefixes) and "." not in x.id:
            chapter = x
        deeper = [c for c in x.parts if isinstance(c, _Node)] if section else x.parts
        if not section and not any(_is_section(c, rules) or c.id.startswith(rules.chapter_id_prefixes) for c in _below(x)):
            text = _text(x, rules)
            if text and chapter is None:
                outside.append(text)
            continue
        # Inside a section only sections of its own are looked for.
        todo.extend((c, chapter) for c in reversed(deeper) if not section or _is_section(c, rules) or any(_is_section(d, rules) for d in _below(c)))
    head = [{"eid": "", "heading": "", "marker": None, "chapter_id": None, "chapter_title": None, "numbered": [], "body": outside}] if outside else []
    return head + out


def _below(n: _Node):
    todo = n.children()
    while todo:
        x = todo.pop()
        yield x
        todo.extend(x.children())


def _section(n: _Node, chapter: _Node | None, rules: HtmlRules) -> dict:
    nested = lambda x: _is_section(x, rules)
    marker = next((m[1] for c in n.children() if c.classes & rules.marker_classes and (m := _ARTICLE.search(_text(c, rules)))), None)
    titled = next((c for c in n.children() if c.classes & rules.title_classes), None) or next((c for c in n.children() if c.tag in rules.title_tags), None)
    numbered, body, loose = [], [], []

    def flush():
        text = squeeze("".join(loose))
        loose.clear()
        if text:
            body.append(text)

    for x in n.parts:
        if isinstance(x, str):
            loose.append(x)
            continue
        if x is titled or x.classes & rules.marker_classes or _is_noise(x, rules) or nested(x):
            continue
        flush()
        text = _text(x, rules, nested)
        if text:
            body.append(text)
            if m := _NUMBERED.match(text):
                numbered.append((x.tag, m[1], text[m.end():]))
    flush()
    title = None
    if chapter is not None:
        title = next((_text(c, rules) for c in chapter.children() if c.classes & rules.chapter_title_classes), None)
    return {"eid": n.id, "heading": _text(titled, rules) if titled is not None else "", "marker": marker, "chapter_id": chapter.id if chapter is not None else None,
            "chapter_title": title, "numbered": numbered, "body": body}


#: Characters of markup whose rows a worker holds before it hands them on.
RUN_CHARS = 1 << 20


def _page_runs(pdf: pd.DataFrame, key: str, html: str) -> Iterator[list[tuple]]:
    """(key, markup) of the pages of a batch in runs of about ``RUN_CHARS`` characters."""
    run, held = [], 0
    for page, markup in zip(pdf[key], pdf[html]):
        run.append((page, markup))
        held += len(markup or "")
        if held >= RUN_CHARS:
            yield run
            run, held = [], 0
    if run:
        yield run


def html_sections(df: DataFrame, key: str, html: str, rules: HtmlRules | None = None) -> DataFrame:
    """Pages to section paragraphs: numbered ``N.`` children, else one joined body.

    A numbered paragraph is a child element of the section with all its text,
    tables and nested blocks included. ``marker`` is the number that the
    section's marker line gives, ``heading`` its title, ``chapter_id`` and
    ``chapter_title`` those of the chapter around it. Pages are parsed where
    they are read; there is no shuffle.
    """
    rules = rules or HtmlRules()
    base = df.select(key, html)
    schema = (f"{key} {base.schema[key].dataType.simpleString()}, section_pos int, section_id string, marker string, heading string, chapter_id string, chapter_title string, "
              "para_pos int, tag string, number string, text string")
    names = [key, "section_pos", "section_id", "marker", "heading", "chapter_id", "chapter_title", "para_pos", "tag", "number", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in (run for pdf in batches for run in _page_runs(pdf, key, html)):
            rows = []
            for page, markup in pages:
                for si, s in enumerate(read_sections(markup, rules)):
                    head = (page, si, s["eid"], s["marker"], s["heading"], s["chapter_id"], s["chapter_title"])
                    if s["numbered"]:
                        rows += [(*head, pi, *p) for pi, p in enumerate(s["numbered"])]
                    elif s["body"] or s["heading"]:
                        rows.append((*head, 0, "body", None, "\n\n".join(s["body"])))
            yield pd.DataFrame(rows, columns=names)
    return base.mapInPandas(run, schema)


_LISTS = ("ul", "ol", "table")


def _entries(n: _Node) -> list[_Node]:
    """Items of a list, rows of a table."""
    wanted = "tr" if n.tag == "table" else "li"
    out, todo = [], list(reversed(n.children()))
    while todo:
        x = todo.pop()
        if x.tag == wanted:
            out.append(x)
        elif x.tag not in _LISTS:
            todo.extend(reversed(x.children()))
    return out


def _inner_lists(n: _Node, rules: HtmlRules) -> list[_Node]:
    """Outermost lists and tables below an element."""
    out, todo = [], list(reversed(n.children()))
    while todo:
        x = todo.pop()
        if _is_noise(x, rules):
            continue
        if x.tag in _LISTS:
            out.append(x)
        else:
            todo.extend(reversed(x.children()))
    return out


def _entry_lines(n: _Node, depth: int, rules: HtmlRules) -> list[tuple[int, str]]:
    """(depth, text) of an item and of all items nested in it. Cells of a row are set apart by a blank."""
    is_list = lambda x: x.tag in _LISTS
    cells = [c for c in n.children() if c.tag in ("td", "th")] if n.tag == "tr" else [n]
    text = " ".join(t for c in cells if (t := _text(c, rules, is_list)))
    inner = [line for sub in _inner_lists(n, rules) for e in _entries(sub) for line in _entry_lines(e, depth + 1, rules)]
    return ([(depth, text)] if text else []) + inner


def nested_points(df: DataFrame, key: str, html: str, max_title: int = 60, rules: HtmlRules | None = None) -> DataFrame:
    """Top items of lists and tables: indented text of the whole item, child count, short title.

    A table row is an item (its marker and body cells), a table inside it holds
    its children. Noise is left out.
    """
    rules = rules or HtmlRules()
    base = df.select(key, html)
    schema = f"{key} {base.schema[key].dataType.simpleString()}, list_pos int, point int, n_children int, first_line string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in (run for pdf in batches for run in _page_runs(pdf, key, html)):
            rows = []
            for page, markup in pages:
                for li, lst in enumerate(_inner_lists(page_tree(markup), rules)):
                    for point, entry in enumerate(_entries(lst), 1):
                        lines = _entry_lines(entry, 0, rules)
                        kids = sum(len(_entries(sub)) for sub in _inner_lists(entry, rules))
                        rows.append((page, li, point, kids, lines[0][1] if lines else "", "\n".join("    " * d + t for d, t in lines)))
            yield pd.DataFrame(rows, columns=[key, "list_pos", "point", "n_children", "first_line", "text"])
    return base.mapInPandas(run, schema).withColumn("title", point_title(F.col("first_line"), max_title)).drop("first_line")


def point_title(text: Column, max_chars: int = 60) -> Column:
    """Part before the first colon, cut at a word boundary."""
    return cut_at_word(F.trim(F.substring_index(text, ":", 1)), max_chars)


def _plain(node: _Node, noise_tags: frozenset[str], noise_classes: frozenset[str], out: list[str]) -> None:
    for part in node.parts:
        if isinstance(part, str):
            out.append(part)
        elif part.tag not in noise_tags and not part.classes & noise_classes:
            _plain(part, noise_tags, noise_classes, out)


def html_text(html: Column, noise_tags: tuple[str, ...] = ("script", "style", "nav"), noise_classes: tuple[str, ...] = tuple(sorted(NOISE_CLASSES))) -> Column:
    """Text of a page without noise elements, whatever nests inside them.

    An element is noise by its tag or by one of the names in its class
    attribute. It goes with all it holds; the text behind it stays. Tags leave no
    blank, so a word with marked-up letters stays one word. White space,
    no-break space included, is collapsed.
    """
    tags, classes = frozenset(noise_tags), frozenset(noise_classes)

    def text_of(page: str | None) -> str | None:
        if page is None:
            return None
        tree, out = _Tree(), []
        tree.feed(page)
        tree.close()
        _plain(tree.root, tags, classes, out)
        return "".join(out)

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(text_of)

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return collapse_ws(F.pandas_udf(run, "string")(html))
