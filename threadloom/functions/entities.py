"""HTML entities decoded by Spark's own functions, as the HTML5 rules and Python's ``html.unescape`` have it.

A text is cut at its ampersands. What follows one is a number, a name with its semicolon, or begins with the longest of the names
that may go without one. Names are looked up in a constant map of maps, by their first two characters and then the rest. The names and
the numbers that stand for something else come from Python's library when a plan is made.
"""

from __future__ import annotations

import html
import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..skew import let

_LARGEST = 0x10FFFF
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@cache
def named() -> dict[str, dict[str, str]]:
    """Of each two first characters, the rest of the names (without semicolon) and what they mean."""
    out: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        if name.endswith(";"):
            out.setdefault(name[:2], {})[name[2:-1] or "."] = value
    return out


@cache
def open_names() -> tuple[str, ...]:
    """Names that need no semicolon, longest first."""
    return tuple(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


@cache
def odd_numbers() -> dict[str, str]:
    """Numbers that don't stand for the character of that number."""
    some = [*range(0x300), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))]
    return {str(n): value for n in some if (value := html.unescape(f"&#{n};")) != chr(n)}


def _constant(pairs: dict, kind: str) -> Column:
    """A map as one constant, however many entries it has."""
    return F.from_json(F.lit(json.dumps(pairs)), kind)


def _number(reference: Column) -> Column:
    """The number of ``#...`` or ``#x...``; LARGEST + 1 for all that are larger."""
    hexadecimal = F.lower(F.substring(reference, 2, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(reference, "^#[xX]?0*", ""), ";$", "")
    short = F.when(digits == "", F.lit("0")).when(F.length(digits) <= 8, digits)
    value = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).cast("long")
    return F.coalesce(F.least(value, F.lit(_LARGEST + 1)), F.lit(_LARGEST + 1))


def _character(number: Column) -> Column:
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    bad = (number > _LARGEST) | number.between(0xD800, 0xDFFF)
    return F.coalesce(F.get(_constant(odd_numbers(), "map<string,string>"), number.cast("string")) if False else F.try_element_at(_constant(odd_numbers(), "map<string,string>"), number.cast("string")), F.when(bad, "�").otherwise(plain))


def _name(reference: Column) -> Column:
    """What a name stands for, with what it doesn't take up; null if it is none."""
    names = _constant(named(), "map<string,map<string,string>>")
    bare = F.substring(reference, 1, F.length(reference) - 1)
    rest = F.when(F.length(bare) > 2, F.substring(bare, 3, 2**31 - 1)).otherwise(".")
    whole = F.when(F.endswith(reference, F.lit(";")), F.try_element_at(F.try_element_at(names, F.substring(bare, 1, 2)), rest))
    some = F.regexp_extract(reference, "^(" + "|".join(open_names()) + ")", 1)
    values = {n: html5[n] for n in open_names()}
    opened = F.when(some != "", F.concat(F.try_element_at(_constant(values, "map<string,string>"), some), F.substr(reference, F.length(some) + 1)))
    return F.coalesce(whole, opened)


def _decoded(piece: Column) -> Column:
    """A piece after an ampersand."""
    return let(F.regexp_extract(piece, _REFERENCE, 1), lambda r: F.when(r == "", F.concat(F.lit("&"), piece)).otherwise(
        F.concat(
            F.coalesce(F.when(F.startswith(r, F.lit("#")), let(_number(r), _character)).otherwise(_name(r)), F.concat(F.lit("&"), r)),
            F.substr(piece, F.length(r) + 1),
        )))


def decode_entities(text: Column) -> Column:
    """All HTML5 entities decoded once; texts without an ampersand stay as they are."""
    pieces = F.split(text, "&", -1)
    whole = let(pieces, lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, 2, F.size(p)), _decoded), "")))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)
