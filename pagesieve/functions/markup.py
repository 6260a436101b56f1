"""Reading HTML with regular expressions, in time linear in the page.

Rules that keep the patterns safe and fast on real pages:

* a page is read left to right, so a comment inside a script, or a script inside
  a comment, is taken as what it is;
* every repetition is possessive: no backtracking, and no deep recursion in the
  JVM's matcher on a start tag with a hundred thousand attributes;
* every alternative starts after one "<", so plain text costs one comparison per
  character;
* only start tags are trusted; nothing relies on balanced pairs, and whatever is
  left open runs to the end of the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.arrays import let
from pagesieve.functions.entities import decode_entities


def until(mark: str, end: str) -> str:
    """Everything before the first ``mark`` that ``end`` follows, or to the end."""
    return rf"[^{mark}]*+(?:{mark}(?!{end})[^{mark}]*+)*+"


def content(name: str) -> str:
    """The markup between a start tag of ``name`` and the next end tag of it."""
    return until("<", rf"/{name}[\s/>]")


def _element(name: str) -> str:
    return rf"{name}[\s/>]{content(name)}(?:</{name}[^<>]*+>?+)?+"


# The rest of a tag after its name. A quote counts only after "=".
_TAG_BODY = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>?"""

# These come after a "<". What is no part of the page's text ...
_HIDDEN = "|".join(
    [
        rf"!--(?:-?>|{until('-', '-!?>')}(?:--!?>)?+)",
        _element("script"),
        _element("style"),
        _element("title"),
        # Markup in these is text, or inert.
        _element("textarea"),
        _element("iframe"),
        _element("xmp"),
        _element("template"),
    ]
)
# ... and any tag, taken whole, as a quoted value may hold markup of its own.
_TAG = rf"[/!?a-z]{_TAG_BODY}"

# A name or an unquoted value ends before "<", as a tag does; otherwise each of many
# open tags would be read to the end of the page.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s<>]++)"""
_ATTRIBUTE = rf"[\s/]*+[^\s/<>][^\s/<>=]*+(?:\s*+=\s*+{_VALUE})?+"

# White space that is not one plain space.
_SPACE = r" \t\n\x0B\f\r\xA0"
_GAP = rf"[{_SPACE}](?:[{_SPACE}]++|(?<! ))"


def _tidy(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _GAP, " "))


def first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match of ``pattern``, NULL where there is none.

    Where the group is empty, a second look tells an empty match from none.
    """
    found = F.regexp_extract(text, pattern, 1)
    return let(found, lambda x: F.when((x != "") | text.rlike(pattern), x))


def start_tags(html: Column, *names: str) -> Column:
    """``array<string>``: the start tags of the given names, from name to ">"."""
    wanted = rf"(?:{'|'.join(names)})[\s/>]{_TAG_BODY}"
    found = F.regexp_extract_all(
        html, F.lit(rf"(?i)<(?:{_HIDDEN}|({wanted})|{_TAG})"), F.lit(1)
    )
    # Everything else that was matched has an empty group.
    return F.filter(found, lambda tag: tag != "")


def attribute(tag: Column, name: str, of: str = r"[^\s/>]++") -> Column:
    """The decoded, trimmed value of one attribute of a start tag.

    NULL where the attribute is missing or the tag's own name is not ``of``. The
    attributes before the wanted one are read one by one, so ``data-href`` or the
    text of another attribute's value is never mistaken for ``href``.
    """
    wanted = rf"[\s/]*+{name}\s*+="
    pattern = (
        rf"(?i)\A{of}(?=[\s/])(?:(?!{wanted}){_ATTRIBUTE})*+{wanted}\s*+({_VALUE})"
    )
    value = F.regexp_replace(
        first_group(tag, pattern), r"""(?s)\A(["'])(.*)\1\z""", "$2"
    )
    return _tidy(decode_entities(value))


def class_tag(name: str, cls: str) -> str:
    """Pattern of a start tag of ``name`` that has the class ``cls``."""
    word = re.escape(cls)
    wanted = r"[\s/]*+class\s*+="
    values = [
        rf"{q}\s*+(?:(?!{word}[\s{q}])[^\s{q}]++\s++)*+{word}(?=[\s{q}])[^{q}]*+{q}"
        for q in ('"', "'")
    ] + [rf"{word}(?=[\s>])"]
    return (
        rf"<{name}(?=[\s/])(?:(?!{wanted}){_ATTRIBUTE})*+"
        rf"{wanted}\s*+(?:{'|'.join(values)}){_TAG_BODY}"
    )


def _up_to(name: str) -> str:
    """Everything before the next start tag of ``name``, from the top of the page."""
    return rf"(?i)\A(?:[^<]++|<(?!{name}[\s/>])(?:{_HIDDEN}|{_TAG})?+)*+"


def language(html: Column) -> Column:
    """The ``lang`` attribute of the root element."""
    pattern = rf"{_up_to('html')}<(html[\s/>]{_TAG_BODY})"
    return attribute(F.regexp_extract(html, pattern, 1), "lang")


def title(html: Column) -> Column:
    """The text of the first title element, NULL where the page has none."""
    pattern = rf"{_up_to('title')}<title(?:[\s/][^>]*+)?(>{content('title')})"
    return let(
        F.regexp_extract(html, pattern, 1),
        lambda found: F.when(
            found != "", _tidy(decode_entities(F.substr(found, F.lit(2))))
        ),
    )


def named_meta(tags: Column) -> Column:
    """``array<struct<name, content>>``, one item per meta tag with a name.

    Pages use both ``name=`` and ``property=`` for the same thing.
    """
    pairs = F.transform(
        tags,
        lambda tag: F.struct(
            F.coalesce(
                attribute(tag, "name", "meta"), attribute(tag, "property", "meta")
            ).alias("name"),
            attribute(tag, "content", "meta").alias("content"),
        ),
    )
    return F.filter(pairs, lambda pair: pair["name"].isNotNull())


def targets(tags: Column, tag: str = "a", attr: str = "href") -> Column:
    """``array<string>``: link targets in page order, copies kept."""
    return F.filter(
        F.transform(tags, lambda t: attribute(t, attr, tag)),
        lambda target: target.isNotNull(),
    )


def cut_at(html: Column, start: str) -> Column:
    """``array<string>``: the page cut before every start tag that ``start`` matches;
    what comes before the first one is left out. Comments, scripts and the like are
    read over, so a start tag inside of them cuts nothing."""
    rest = rf"(?:[^<]++|<(?i:{_HIDDEN})|(?!{start})<(?i:{_TAG})?+)*+"
    pieces = F.regexp_extract_all(html, F.lit(rf"((?:{start}){rest})|{rest}"), F.lit(1))
    return F.filter(pieces, lambda piece: piece != "")


def visible_text(markup: Column) -> Column:
    """The text of a page, or of a piece of one, without scripts, styles, comments
    and title. A tag becomes a space, so words on its two sides stay apart."""
    pattern = rf"(?i)<(?:{_HIDDEN}|{_TAG})"
    return _tidy(decode_entities(F.regexp_replace(markup, pattern, " ")))
