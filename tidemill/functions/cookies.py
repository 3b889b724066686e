"""Cookie strings, headers and files. Only text is formatted; nothing is read from a browser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first lines of a cookie file.
HEADER = ("# Netscape HTTP Cookie File", "# This file is generated, do not edit.", "")


def parse(text: Column) -> Column:
    """Array of name and value, split at the first `=`; parts without one are dropped."""
    parts = F.filter(F.split(text, "; "), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.struct(F.split(p, "=", 2)[0].alias("name"), F.split(p, "=", 2)[1].alias("value")))


def header(cookies: Column) -> Column:
    """The request header of an array of name and value; line breaks go, empty pairs stay."""

    def clean(c: Column) -> Column:
        return F.regexp_replace(c, "[\r\n]", "")

    return F.array_join(F.transform(cookies, lambda c: F.concat(clean(c["name"]), F.lit("="), clean(c["value"]))), "; ")


def file_line(name: Column, value: Column, domain: Column, path: Column, secure: Column, expires: Column) -> Column:
    """One line of a cookie file, its seven fields joined by tabs."""
    flags = F.when(F.coalesce(secure, F.lit(False)), "TRUE").otherwise("FALSE")
    return F.concat_ws("\t", domain, F.lit("TRUE"), F.coalesce(path, F.lit("/")), flags, F.coalesce(expires, F.lit(0)).cast("string"), name, value)


def file_text(cookies: Column, domain: str) -> Column:
    """A cookie file of an array of cookies; those without name or value are left out, a missing domain is `domain`."""
    kept = F.filter(cookies, lambda c: (F.coalesce(c["name"], F.lit("")) != "") & (F.coalesce(c["value"], F.lit("")) != ""))
    body = F.transform(kept, lambda c: file_line(c["name"], c["value"], F.coalesce(c["domain"], F.lit(domain)), c["path"], c["secure"], c["expires"]))
    return F.array_join(F.concat(F.array(*[F.lit(h) for h in HEADER]), F.coalesce(body, F.array())), "\n")


def file_of_string(text: Column, domain: str) -> Column:
    """A cookie file of a cookie string, all for one domain."""
    lines = F.transform(parse(text), lambda c: file_line(c["name"], c["value"], F.lit(domain), F.lit("/"), F.lit(False), F.lit(0)))
    return F.array_join(F.concat(F.array(*[F.lit(h) for h in HEADER]), F.coalesce(lines, F.array())), "\n")
