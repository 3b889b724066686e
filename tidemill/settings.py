"""Settings with their bounds, from arguments and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "TIDEMILL_"
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
#: Bounds of the numbers.
BOUNDS = {
    "max_retries": (1, 10),
    "download_timeout": (30, 3600),
    "max_concurrent_downloads": (1, 16),
    "throttled_rate": (1000, 1_000_000),
    "http_chunk_size": (1_048_576, 104_857_600),
}


@dataclass(frozen=True)
class Settings:
    max_retries: int = 3
    download_timeout: int = 300
    ssl_verify: bool = True
    max_concurrent_downloads: int = 4
    throttled_rate: int = 10_000
    http_chunk_size: int = 10_485_760
    log_level: str = "INFO"
    log_file: str | None = None

    def __post_init__(self) -> None:
        for name, (least, most) in BOUNDS.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name}: not in {least} to {most}")
        object.__setattr__(self, "log_level", self.log_level.upper())
        object.__setattr__(self, "log_file", self.log_file or None)
        if self.log_level not in LOG_LEVELS:
            raise ValueError("log_level: unknown")


def env_file(text: str) -> dict[str, str]:
    """Names and values of the lines NAME=value of a .env file; `export` before a name, quotes around a value and what
    follows ` #` after one without quotes are left out."""
    out: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        name, equals, value = line.removeprefix("export ").partition("=")
        if equals and not line.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out


def from_environment(environment: Mapping[str, str] | None = None, env_text: str = "", **given: object) -> Settings:
    """Arguments go before the environment's prefixed names, and those before a .env file's text; values that don't fit
    raise."""
    environment = env_file(env_text) | dict(os.environ if environment is None else environment)
    read: dict[str, object] = {}
    for f in fields(Settings):
        text = environment.get(PREFIX + f.name.upper())
        if text is not None:
            read[f.name] = int(text) if f.type == "int" else text.lower() in ("1", "true", "yes", "on") if f.type == "bool" else text
    return Settings(**(read | given))  # type: ignore[arg-type]


def unknown_settings(names: DataFrame) -> DataFrame:
    """The rows of `name` that have the prefix and are no setting, as of many machines' environments."""
    known = names.sparkSession.createDataFrame([(PREFIX + f.name.upper(),) for f in fields(Settings)], "known string")
    return names.where(F.upper("name").startswith(PREFIX)).join(F.broadcast(known), F.upper("name") == F.col("known"), "left_anti")


def unknown_names(environment: Mapping[str, str]) -> list[str]:
    """Prefixed names that are no setting, sorted."""
    known = {PREFIX + f.name.upper() for f in fields(Settings)}
    return sorted(n for n in environment if n.upper().startswith(PREFIX) and n.upper() not in known)
