"""Line-wise scans of SQL text, numbered from 1. Texts are scanned within their row: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for patterns that are to treat a no-break space as a space.
UNICODE = "(?U)"


def lines(sql: Column) -> Column:
    """Lines of a text; a last line break makes no line of its own."""
    return F.split(F.regexp_replace(sql, r"(?:\r\n|[\r\n])\z", ""), r"\r\n|[\r\n]", -1)


def numbered(body: Column) -> Column:
    return F.transform(body, lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line")))


def first(body: Column, hit: Callable[[Column], Column]) -> Column:
    """(line_number, line) of the first of ``numbered`` lines that ``hit`` holds for, or null."""
    return F.get(F.filter(body, lambda x: hit(x["line"])), F.lit(0))


def trimmed_lines(sql: Column) -> Column:
    return lines(F.regexp_replace(sql, r"^\s+|\s+\z", ""))


def last(body: Column, hit: Callable[[Column], Column]) -> Column:
    """(line_number, line) of the last of the lines that ``hit`` holds for, or null."""
    return F.try_element_at(F.filter(numbered(body), lambda x: hit(x["line"])), F.lit(-1))
