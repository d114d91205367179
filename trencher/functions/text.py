r"""Text normalisers, all JVM-side expressions.

Patterns are matched on lower-cased text unless said otherwise; ``edges`` gives
``\b`` one meaning on every JVM.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \\s is ASCII only; these are the other characters that count as blank.
SPACE = r"\s" + "".join(map(chr, (0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + (
    f"{chr(0x2000)}-{chr(0x200A)}"
)

# Named HTML entities that are decoded; all others stay as written.
NAMED_ENTITIES = {
    "amp": "&", "apos": "'", "copy": "(c)", "gt": ">", "lt": "<",
    "nbsp": chr(0xA0), "quot": '"', "reg": "®", "trade": "TM",
}
ENTITY = r"&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);"


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


#: The edge of a word of ASCII letters, digits and underscores (``\\w`` is these on every JVM, ``\\b`` is not).
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
#: An edge before a letter that must come, and after one that has come.
_BEFORE, _AFTER = re.compile(r"\\b(?=\w(?![?*{]))", re.A), re.compile(r"(?<=[^\\]\w)\\b|(?<=^\w)\\b", re.A)


def edges(pattern: str) -> str:
    """``pattern`` with every ``\\b`` at the edge of an ASCII word: before Java 19 it counts letters of any script."""
    return _AFTER.sub(r"(?!\\w)", _BEFORE.sub(r"(?<!\\w)", pattern)).replace(r"\b", EDGE)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def _decoded(entity: Column) -> Column:
    body = F.regexp_replace(entity, "^&|;$", "")
    digits = F.regexp_replace(body, "^#x?0*", "")
    code = F.when(body.rlike("^#x"), F.conv(digits, 16, 10)).when(body.startswith("#"), digits).try_cast("bigint")
    in_range = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    as_char = F.decode(F.unhex(F.lpad(F.hex(F.when(in_range, code)), 8, "0")), "UTF-32")
    named = F.create_map(*(F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair))
    return F.coalesce(F.when(body.startswith("#"), as_char), F.try_element_at(named, F.lower(body)), entity)


def decode_entities(c: Column) -> Column:
    """One left-to-right pass, so ``&amp;lt;`` becomes ``&lt;`` and stops there."""
    pieces = F.split(c, ENTITY, -1)
    entities = F.regexp_extract_all(c, F.lit(f"({ENTITY})"), F.lit(1))
    joined = F.array_join(
        F.zip_with(
            pieces, entities,
            lambda p, e: F.concat(p, F.when(e.isNull(), "").otherwise(_decoded(e))),
        ),
        "",
    )
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def clean_display(c: Column) -> Column:
    """Readable form of scraped text; null gives the empty string."""
    x = decode_entities(strip_tags(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(x, rf"^[{SPACE}\-_*?.,:;|/\\]+", "")
    x = F.regexp_replace(x, r"^\d+\.\s+(?=[A-Z][A-Z\s-]+$)", "")
    return collapse_spaces(x)


def display_name(c: Column) -> Column:
    cleaned = clean_display(c)
    return F.when(cleaned == "", c).otherwise(cleaned)


def strip_html(c: Column) -> Column:
    """Lighter cleaner used on imported payloads: tags out, entities decoded, spaces collapsed."""
    return collapse_spaces(decode_entities(strip_tags(F.coalesce(c, F.lit("")))))


def match_name(c: Column) -> Column:
    """Matching key: lower, keep ``[a-z0-9]`` and spaces, collapse."""
    return collapse_spaces(F.regexp_replace(F.lower(c), rf"[^a-z0-9{SPACE}]", ""))


def spaced_name(c: Column) -> Column:
    """Like :func:`match_name`, but punctuation becomes a space (apostrophes vanish)."""
    x = F.regexp_replace(F.lower(c), r"['‘’]", "")
    return collapse_spaces(F.regexp_replace(x, "[^a-z0-9]+", " "))


def chain_name(c: Column) -> Column:
    x = F.regexp_replace(F.lower(c), "[®™©]", "")
    x = F.regexp_replace(F.regexp_replace(x, "[‘’]", "'"), "[“”]", '"')
    x = F.regexp_replace(x, r"\s*[-–—]\s*", " ")
    x = F.regexp_replace(x, r"\s*\(.*?\)\s*", " ")
    return collapse_spaces(x)


@lru_cache(maxsize=1)
def _compat_letters() -> str:
    """Characters whose compatibility decomposition holds an ASCII letter, digit or apostrophe."""
    table = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        ch = chr(code)
        flat = unicodedata.normalize("NFKD", ch)
        if flat != ch and any(x.isascii() and (x.isalnum() or x == "'") for x in flat):
            table[ch] = flat
    return json.dumps(table, ensure_ascii=False)


def decompose(c: Column) -> Column:
    """Compatibility decomposition, exact for every key that later keeps only ``[a-z0-9']``.

    Spark has no normaliser.  ASCII rows skip the lookup altogether, and a
    character that is not in the table can only turn into a separator.
    """
    table = F.from_json(F.lit(_compat_letters()), "map<string,string>")
    flat = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    return F.when(c.rlike(r"[^\x00-\x7f]"), flat).otherwise(c)


def canonical_key(c: Column) -> Column:
    """Key under which two spellings of one name meet."""
    x = F.lower(decompose(clean_display(c)))
    x = F.regexp_replace(x, r"[’']s(?![A-Za-z0-9_])", "")
    x = F.regexp_replace(x, r"[’']", "")
    x = F.regexp_replace(x, rf"{EDGE}universals{EDGE}", "universal")
    x = F.regexp_replace(x, rf"{EDGE}disneys{EDGE}", "disney")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    x = F.regexp_replace(F.lower(decompose(c)), r"['’]", "")
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(x == "", "unknown").otherwise(x)


def file_slug(c: Column) -> Column:
    """Slug used for catalogue snapshots: ``&`` reads as "and"."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", "-")
    return F.regexp_replace(x, "^-+|-+$", "")


def words(c: Column) -> Column:
    return F.array_distinct(F.split(c, " "))


def parse_price(c: Column) -> Column:
    """First number in a price text; null where there is none."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
