"""Column functions over text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Explicit Unicode classes: Java's bare \w and \s are ASCII only.
WORD = r"[\p{L}\p{M}\p{N}_]"
# Possessive repetition: a run of word characters is never given back.
WORD_RE = r"[\p{L}\p{M}\p{N}_]++"
TOKEN_RE = r"[\p{L}\p{M}\p{N}_]++|[^\p{L}\p{M}\p{N}_\s\x0B\p{Z}]"
SPACE_RE = r"[\s\x0B\p{Z}]+"


def collapse_ws(c: Column) -> Column:
    """Runs of white space (no-break space included) become one blank; trimmed."""
    return F.trim(F.regexp_replace(c, SPACE_RE, " "))


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$", "")


def words(c: Column) -> Column:
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RE), F.lit(0))


def count_tokens(c: Column) -> Column:
    """Words plus single punctuation marks; null and empty text count 0."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(TOKEN_RE), F.lit(0))), F.lit(0))


def count_occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term``; an empty term counts 0."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def quote(literal: str) -> str:
    """Escape a literal for use inside a regular expression."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in literal)


def has_word(c: Column, word: str) -> Column:
    """Case-insensitive match of ``word`` between word boundaries."""
    return c.rlike(f"(?iu)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){quote(word)}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])")


def excerpt(c: Column, n: int, ellipsis: str = "") -> Column:
    """First ``n`` characters, with a mark when something was cut."""
    if not ellipsis:
        return F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def cut_at_word(c: Column, n: int) -> Column:
    """Cut to ``n`` characters at the last blank, or hard when there is none."""
    head = F.substring(c, 1, n)
    at_blank = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(c) <= n, c).otherwise(
        F.rtrim(F.when(at_blank != "", at_blank).otherwise(head))
    )


def clean_heading(c: Column) -> Column:
    """Drop ``(( ))`` marks, outer parentheses and trailing dots of a heading."""
    s = F.regexp_replace(strip(c), r"\(\(|\)\)", "")
    s = strip(F.regexp_replace(strip(s), r"\.+$", ""))
    inner = F.regexp_extract(s, r"(?s)^\((.*)\)$", 1)
    s = F.when(s.rlike(r"(?s)^\(.*\)$"), strip(inner)).otherwise(s)
    return strip(F.regexp_replace(s, r"\.+$", ""))


def iso_date(c: Column) -> Column:
    """Strict YYYY-MM-DD parse; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def roman_to_int(c: Column) -> Column:
    """Roman numeral to integer; null when a character is not a Roman digit."""
    digits = F.create_map(*[F.lit(x) for kv in
                            (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))
                            for x in kv])
    vals = F.transform(F.split(F.upper(c), ""), lambda ch: digits[ch])
    folded = F.aggregate(
        F.reverse(vals),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")),
        lambda acc, v: F.struct(
            F.when(v < acc["last"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"),
            F.greatest(acc["last"], v).alias("last"),
        ),
    )
    return F.when(c.rlike("(?i)^[IVXLCDM]+$"), folded["total"])


# Order of the Latin suffixes in article numbers.
SUFFIX_ORDER = [
    "", "bis", "ter", "quater", "quater.1", "quater.2", "quinquies", "quinquies.1",
    "sexies", "septies", "septies.1", "octies", "novies", "decies", "undecies",
    "duodecies", "terdecies", "quaterdecies",
]


def article_sort_key(eid: Column) -> Column:
    """Sort key of ``art_N-suffix``: number, suffix order, suffix text."""
    s = F.regexp_replace(eid, "art_", "")
    number = F.coalesce(F.regexp_extract(s, r"^(\d+)", 1).try_cast("int"), F.lit(999))
    suffix = F.coalesce(F.when(F.instr(s, "-") > 0, F.regexp_extract(s, r"^[^-]*-(.*)$", 1)), F.lit(""))
    pos = F.array_position(F.array(*[F.lit(x) for x in SUFFIX_ORDER]), suffix)
    return F.struct(
        number.alias("number"),
        F.when(pos > 0, pos).otherwise(F.lit(999).cast("long")).alias("suffix_pos"),
        suffix.alias("suffix"),
    )
