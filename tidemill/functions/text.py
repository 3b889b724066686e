"""Lines, trimming and KEY=VALUE pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode (Spark's trim alone knows spaces only) and line breaks. Patterns that are run for
#: each row or line name the characters of a class one by one: Java looks these up in a table, but goes through a chain
#: of lambdas for ranges and the like, which tasks of one JVM slow down for each other.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85]|[\u2028-\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def lines(c: Column) -> Column:
    """Array of the lines; a last line break opens no further line."""
    return let(F.split(c, BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def is_entry(line: Column) -> Column:
    """Whether a stripped line is neither blank nor a comment."""
    return (line != "") & ~line.startswith("#")


def entries(content: Column) -> Column:
    """Array of a list's or playlist's entries in order; all tags are skipped, a master playlist's too."""
    return F.filter(F.transform(F.filter(lines(content), is_entry), strip), is_entry)


def is_master(content: Column) -> Column:
    return content.contains("#EXT-X-STREAM-INF")


def signature(segments: Column) -> Column:
    """SHA-256 of the segments in order; null for null."""
    return F.sha2(F.array_join(segments, "\n").cast("binary"), 256)


def key_value(line: Column) -> Column:
    """Struct of key and value, split at the first `=`; null without one."""
    parts = F.split(strip(line), "=", 2)
    return F.when(line.contains("="), F.struct(parts[0].alias("key"), parts[1].alias("value")))
