"""HTML and XML expressions. They work within a row, so they need no shuffle.

Possessive quantifiers keep the matcher from recursing on very long tags. No tag holds a "<", so
that a page of tags that never end is still read once; what opens a script, a style or a comment
and never closes it runs to the end of the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datatrawl import fixed

_NOISE = (
    r"(?is)<script[^<>]*+>.*?(?:</script>|\z)|<style[^<>]*+>.*?(?:</style>|\z)|<!--.*?(?:-->|\z)")
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_TAG = r"<[^<>]*+>"
_START_TAG = rf"<[A-Za-z][A-Za-z0-9:_-]*+{_ATTRIBUTES}>"
_ATTRIBUTE = (
    r"""(?<![^\s"'=<>/])[^\s"'=<>/]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)""")
_PARAGRAPH_OPEN = r"(?i)<p(?:\s[^<>]*+)?>"
_PARAGRAPH = (
    r"(?is)^(.*?)(?:</?(?:p|div|article|section|nav|ul|ol|table|h1|h2|footer|header|body|html)\b"
    r"|\z)"
)
_TITLE_OPEN = r"(?i)<(?:title|h1)(?:\s[^<>]*+)?>"
_TITLE_CLOSE = r"(?is)</(?:title|h1)\b.*\z"


def without_noise(html: Column) -> Column:
    """Markup without scripts, styles and comments."""
    return F.regexp_replace(html, _NOISE, "")


def unescape(text: Column) -> Column:
    for entity, character in fixed.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def inner_text(markup: Column) -> Column:
    """Tags go, entities are decoded, white space stays."""
    return unescape(F.regexp_replace(markup, _TAG, ""))


def flowed_text(markup: Column) -> Column:
    """As `inner_text`, with a space for every tag so that words of two elements stay apart."""
    return unescape(F.regexp_replace(markup, _TAG, " "))


def _after_open_tags(clean: Column, open_tag: str) -> Column:
    pieces = F.split(clean, open_tag, -1)
    return F.slice(pieces, F.lit(2), F.size(pieces))


def title_array(clean: Column, cap: int = fixed.TITLE_CAP) -> Column:
    """Distinct texts of the first `cap` title and h1 elements; one placeholder if none."""
    heads = F.slice(_after_open_tags(clean, _TITLE_OPEN), 1, cap)
    texts = F.transform(heads, lambda x: inner_text(F.regexp_replace(x, _TITLE_CLOSE, "")))
    return F.when(F.size(texts) == 0, F.array(F.lit(fixed.NO_TITLE))).otherwise(
        F.array_distinct(texts))


def abstract_text(clean: Column, min_len: int = fixed.ABSTRACT_MIN_LENGTH) -> Column:
    """The first paragraph that is long enough."""
    texts = F.transform(_after_open_tags(clean, _PARAGRAPH_OPEN),
                        lambda x: inner_text(F.regexp_extract(x, _PARAGRAPH, 1)))
    long_enough = F.filter(texts, lambda x: F.length(x) >= min_len)
    return F.coalesce(F.get(long_enough, F.lit(0)), F.lit(fixed.NO_ABSTRACT))


def _attribute_pairs(tag: Column) -> Column:
    return F.regexp_extract_all(tag, F.lit(f"({_ATTRIBUTE})"), 1)


def _pair_name(pair: Column) -> Column:
    return F.lower(F.regexp_extract(pair, r"^([^\s=]*)", 1))


def _pair_value(pair: Column) -> Column:
    value = F.regexp_replace(pair, r"(?s)^[^=]*=\s*", "")
    return unescape(F.regexp_replace(value, r"""^["']|["']\z""", ""))


def attribute(tag: Column, name: str) -> Column:
    """Value of one attribute of a tag; null if the tag does not have it."""
    named = F.filter(_attribute_pairs(tag), lambda p: _pair_name(p) == name)
    return _pair_value(F.get(named, F.lit(0)))


def anchor_array(clean: Column) -> Column:
    """`a` elements that have a target, in document order, as (href, anchor_text)."""
    pieces = _after_open_tags(clean, r"(?i)<a(?=\s)")

    def anchor(piece: Column) -> Column:
        tag = F.regexp_extract(piece, rf"^({_ATTRIBUTES})>", 1)
        text = F.regexp_replace(piece, rf"^{_ATTRIBUTES}>", "")
        text = F.regexp_replace(text, r"(?is)</a\b.*\z", "")
        return F.struct(attribute(tag, "href").alias("href"), inner_text(text).alias("anchor_text"))

    return F.filter(F.transform(pieces, anchor), lambda x: x["href"].isNotNull())


def start_tag_array(clean: Column) -> Column:
    """Start tags in document order."""
    return F.regexp_extract_all(clean, F.lit(f"({_START_TAG})"), 1)


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([A-Za-z_][A-Za-z0-9:_.-]*)", 1))


def attribute_map(tag: Column) -> Column:
    """Attributes with a value, by lower-cased name; the first of equal names counts."""
    pairs = F.transform(_attribute_pairs(tag), lambda pair, i: F.struct(
        _pair_name(pair).alias("name"), i.alias("i"), _pair_value(pair).alias("value")))
    by_name = F.array_sort(pairs)
    nothing = F.lit(None).cast("struct<name: string, i: int, value: string>")
    firsts = F.array_compact(F.zip_with(
        by_name, F.concat(F.array(nothing), by_name),
        lambda x, before: F.when(x["name"].isNotNull() & ~x["name"].eqNullSafe(before["name"]), F.struct(
            x["i"].alias("i"), x["name"].alias("name"), x["value"].alias("value")))))
    return F.map_from_entries(F.transform(
        F.array_sort(firsts), lambda x: F.struct(x["name"], x["value"])))
