"""Playlist urls of recorded responses and of their JSON bodies."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import urls

#: Fixed value: bodies of so many bytes or more aren't parsed.
LARGEST = 1_000_000


@F.udtf(returnType=StructType([StructField("place", IntegerType()), StructField("found", StringType())]))
class JsonUrls:
    """Playlist urls that are values of objects, depth first in the text's order; strings in lists don't count."""

    def eval(self, body: str) -> Iterator[tuple[int, str]]:
        try:
            open_values = [json.loads(body)]
        except (TypeError, ValueError, RecursionError):
            return
        place = 0
        while open_values:
            value = open_values.pop()
            if isinstance(value, str):
                yield place, value
                place += 1
            elif isinstance(value, dict):
                open_values.extend(v for v in reversed(value.values()) if isinstance(v, dict | list) or isinstance(v, str) and ".m3u8" in v.lower())
            elif isinstance(value, list):
                open_values.extend(v for v in reversed(value) if isinstance(v, dict | list))


def json_candidates(responses: DataFrame) -> DataFrame:
    """Responses whose body is to be parsed: by url, type and size."""
    length = F.coalesce(F.col("content_length").try_cast("bigint"), F.lit(0))
    small = (length < LARGEST) & (F.octet_length("body") < LARGEST)
    return responses.where(F.col("url").contains("video") & F.coalesce("content_type", F.lit("")).startswith("application/json") & small)


def json_urls(spark_rows: DataFrame, key: str) -> DataFrame:
    """key, place and found of rows of key and body."""
    return spark_rows.select(key, "body").lateralJoin(JsonUrls(F.col("body").outer())).select(key, "place", "found")


def playlist_urls(responses: DataFrame) -> DataFrame:
    """The distinct urls in order of arrival: seq, place and url."""
    direct = responses.where(urls.is_playlist(F.col("url"))).select("seq", F.lit(-1).alias("place"), "url")
    inside = json_urls(json_candidates(responses), "seq").select("seq", "place", F.col("found").alias("url"))
    found = direct.unionByName(inside).withColumn("url", urls.normalize(F.col("url")))
    return found.groupBy("url").agg(F.min(F.struct("seq", "place")).alias("first")).select("first.seq", "first.place", "url")
