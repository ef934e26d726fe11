"""Identifiers of documents, chunks and index points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the OID name space of RFC 4122.
OID_NAMESPACE_HEX = "6ba7b8129dad11d180b400c04fd430c8"


def point_id(chunk_id: Column) -> Column:
    """Name-based UUID (version 5, OID name space) of a chunk id."""
    digest = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE_HEX)), F.encode(chunk_id, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


# Act-type letter to path segment.
CELEX_TYPES = {"R": "reg", "L": "dir", "D": "dec"}


def celex_doc_urn(celex: Column) -> Column:
    """``3yyyyXnnnn`` to ``eli/<type>/yyyy/n/oj``; any other id to ``celex/<id>``."""
    pattern = r"^3(\d{4})([A-Z])(\d{4})$"
    letter = F.regexp_extract(celex, pattern, 2)
    kind = F.lower(letter)
    for code, segment in CELEX_TYPES.items():
        kind = F.when(letter == code, F.lit(segment)).otherwise(kind)
    return F.when(
        celex.rlike(pattern),
        F.concat(
            F.lit("eli/"), kind, F.lit("/"), F.regexp_extract(celex, pattern, 1), F.lit("/"),
            F.regexp_extract(celex, pattern, 3).cast("int").cast("string"), F.lit("/oj"),
        ),
    ).otherwise(F.concat(F.lit("celex/"), celex))


def article_number(raw: Column, eid: Column) -> Column:
    """``Art. N`` gives N; else the cleaned raw text; else the id without ``art_``."""
    raw = F.coalesce(raw, F.lit(""))
    from_art = F.rtrim(F.regexp_extract(raw, r"(?i)Art\.?\s*([^\s.]+)", 1), F.lit("."))
    cleaned = F.rtrim(F.trim(raw), F.lit("."))
    return F.coalesce(
        F.nullif(from_art, F.lit("")), F.nullif(cleaned, F.lit("")), F.regexp_replace(eid, "^art_", ""),
    )


def doc_urn_of(chunk_id: Column) -> Column:
    """Document part of a chunk id (everything before the first ``__``)."""
    return F.substring_index(chunk_id, "__", 1)


# Document ids of the six laws and their short names.
SHORT_NAMES = {
    "eli/reg/2016/679/oj": "GDPR",
    "eli/reg/2024/1689/oj": "AI Act",
    "akn/it/act/decreto_legislativo/stato/2003-06-30/196": "Codice Privacy",
    "akn/it/act/decreto_legislativo/stato/2001-06-08/231": "D.Lgs 231/2001",
    "akn/it/act/decreto_legislativo/stato/2024-09-04/138": "NIS2",
    "akn/it/act/legge/stato/2025-09-23/132": "L. 132/2025",
}


def short_name(chunk_id: Column, names: dict[str, str] | None = None, unknown: str = "?") -> Column:
    """Short name of the law a chunk id belongs to."""
    table = SHORT_NAMES if names is None else names
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[doc_urn_of(chunk_id)] if pairs else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(unknown))


def base_id(chunk_id: Column) -> Column:
    """Chunk id without the split suffix ``__paras_a_b``."""
    return F.regexp_replace(chunk_id, r"__paras_.*$", "")


def unit_type(chunk_id: Column) -> Column:
    """Kind of unit named by a chunk id."""
    return (
        F.when(chunk_id.contains("__art_") & chunk_id.contains("__paras_"), "article_fragment")
        .when(chunk_id.contains("__art_"), "article")
        .when(chunk_id.contains("__recital_"), "recital")
        .when(chunk_id.contains("__annex_") & chunk_id.contains("__point_"), "annex_point")
        .when(chunk_id.contains("__annex_"), "annex")
        .otherwise("other")
    )
