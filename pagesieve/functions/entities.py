"""HTML character references, decoded in one pass."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.arrays import let

REPLACEMENT = "�"

# A reference without its "&": decimal, hexadecimal or named, with the ";".
_REFERENCE = r"\A(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]{1,31}+);"


def _table(chars: dict[str, str]) -> Column:
    # One literal, folded into a constant map, keeps plans small.
    lines = "\n".join(f"{name}\t{char}" for name, char in chars.items())
    return F.str_to_map(F.lit(lines), F.lit("\n"), F.lit("\t"))


def _named() -> Column:
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
    return _table(names | {name: html5[f"{name};"] for name in name2codepoint})


def _windows() -> Column:
    """The numbers from 128 to 159 that browsers read as windows-1252."""
    chars = {str(n): bytes([n]).decode("cp1252", errors="ignore") for n in range(128, 160)}
    return _table({number: char for number, char in chars.items() if char})


def _from_code_point(point: Column) -> Column:
    valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(point), 8, "0"))
    return F.when(valid, F.decode(utf32, "UTF-32")).otherwise(F.lit(REPLACEMENT))


def decode_entities(text: Column) -> Column:
    """``text`` with its character references decoded exactly once.

    The text is cut at "&" and each piece is decoded on its own, so ``&amp;lt;``
    becomes ``&lt;`` and not ``<``. References without ";" and unknown names stay
    as they are.
    """
    named, windows = _named(), _windows()

    def piece(part: Column, i: Column) -> Column:
        found = F.nullif(F.regexp_extract(part, _REFERENCE, 0), F.lit(""))
        return F.when(i == 0, part).otherwise(let(found, lambda ref: decoded(part, ref)))

    def decoded(part: Column, ref: Column) -> Column:
        name = F.substring_index(ref, ";", 1)
        hexadecimal = F.lower(F.left(name, F.lit(2))) == "#x"
        digits = F.regexp_replace(name, r"\A#[xX]?+0*+", "")
        # A number too long to be a code point is none, like 0.
        number = (
            F.when(F.length(digits) > 7, F.lit("0"))
            .when(hexadecimal, F.conv(digits, 16, 10))
            .otherwise(digits)
            .try_cast("int")
        )
        numeric = let(
            F.coalesce(number, F.lit(0)),
            lambda n: F.when(
                n.between(128, 159),
                F.coalesce(F.try_element_at(windows, n.cast("string")), _from_code_point(n)),
            ).otherwise(_from_code_point(n)),
        )
        char = F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(named, name))
        return F.coalesce(
            F.concat(char, F.substr(part, F.length(ref) + 1)),
            F.concat(F.lit("&"), part),
        )

    return F.array_join(F.transform(F.split(text, "&"), piece), "")
