"""Progress lines of downloaders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of a download line, and bytes of each unit (any other counts as bytes).
LINE = r"\[download\]\s+(\d+(?:\.\d+)?)%\s+of\s+(\d+(?:\.\d+)?)([KMG]?i?B)\s+at\s+(.+?)\s+ETA\s+(\S+)"
UNITS = {"KiB": 1024, "MiB": 1024**2, "GiB": 1024**3, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "B": 1}


def size_in_bytes(number: Column, unit: Column) -> Column:
    factor = F.lit(1.0)
    for name, n in UNITS.items():
        factor = F.when(unit == name, float(n)).otherwise(factor)
    return (number.cast("double") * factor).cast("long")


def download_line(line: Column) -> Column:
    """Struct of percent, downloaded and total bytes, speed and eta; null for other lines."""

    def parsed(parts: Column) -> Column:
        percent = parts[0].cast("double")
        total = size_in_bytes(parts[1], parts[2])
        downloaded = (total.cast("double") * percent / 100).cast("long")
        return F.struct(percent.alias("percent"), downloaded.alias("downloaded"), total.alias("total"), parts[3].alias("speed"), parts[4].alias("eta"))

    groups = F.split(F.regexp_replace(line, rf"^[\s\S]*?{LINE}[\s\S]*$", "$1\n$2\n$3\n$4\n$5"), "\n")
    return F.when(line.rlike(LINE), F.get(F.transform(F.array(groups), parsed), F.lit(0)))


#: Fields of an encoder's progress block and their types.
FIELDS = {"frame": "int", "fps": "double", "speed": "double", "total_size": "bigint", "out_time_us": "bigint", "out_time_ms": "bigint", "out_time": "string", "progress": "string"}


def field(name: str, value: Column, strict: bool = True) -> Column:
    """A field's value, N/A as null; a bad number raises, or is null with strict=False."""
    given = F.nullif(value, F.lit("N/A"))
    given = F.rtrim(given, F.lit("x")) if name == "speed" else given
    kind = FIELDS[name]
    return given if kind == "string" else given.cast(kind) if strict else given.try_cast(kind)
