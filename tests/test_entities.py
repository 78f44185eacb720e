"""Entities against Python's own decoder."""

import html
import random
from html.entities import html5

from threadloom.functions.entities import decode_entities


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in rows.select("i", decode_entities(rows.t).alias("d")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else html.unescape(t)), t


def test_every_name(spark):
    names = [n.rstrip(";") for n in html5]
    check(spark, [f"&{n}" for n in html5] + [f"a&{n};b" for n in names] + [f"&{n}x &{n}; &{n}=" for n in names])


def test_numbers(spark):
    some = [*range(0, 400), 0x2028, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 99_999_999, 10**30]
    check(spark, [f"&#{n};" for n in some] + [f"&#x{n:x};{n}" for n in some] + [f"&#X{n:X}z" for n in some] + [f"&#000{n}" for n in some])


def test_anything(spark):
    rng = random.Random(2)
    parts = ["&", "amp;", "amp", "lt", "gt;", "notit;", "not", "notin;", "#", "#x", "#38;", "#x26", ";", " ", "é", "😀", "&&", "copy", "A", "<", "\t", "x" * 40, "ampamp;", "#9999999999;"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(2000)] + [None, "", "&", "none", "&amp;lt;", "&😀" * 40, "& " * 5000])
