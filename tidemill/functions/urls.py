"""Video ids, redaction, normalisation, resolution and output names."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# How a video's id stands in a url, what stands for hidden parts, what a file name can't hold, and the most
# characters of a title.
VIDEO = r"video-(-?\d+)_(\d+)"
REDACTED = "***REDACTED***"
FORBIDDEN, TITLE_LENGTH = '/\\:*?"<>|', 100


def has_video_id(url: Column) -> Column:
    return F.coalesce(url.rlike(VIDEO), F.lit(False))


def video_id(url: Column) -> Column:
    """Struct of owner and video, anywhere in the url; null without them."""
    return F.when(has_video_id(url), F.struct(F.regexp_extract(url, VIDEO, 1).alias("owner"), F.regexp_extract(url, VIDEO, 2).alias("video")))


def full_id(url: Column) -> Column:
    v = video_id(url)
    return F.when(v.isNotNull(), F.concat_ws("_", v["owner"], v["video"]))


def progress_id(url: Column) -> Column:
    """What follows the last underscore, or the whole url."""
    return F.substring_index(url, "_", -1)


def redact(url: Column) -> Column:
    """Scheme and authority, with the rest hidden; all is hidden without both."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://[^/?#]+", 1)
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)
    return F.when(scheme != "", F.concat(F.lower(scheme), F.lit("://"), authority, F.lit("/" + REDACTED))).otherwise(REDACTED)


def normalize(url: Column) -> Column:
    """With https:// put before what has no scheme; leading slashes go."""
    u = strip(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), F.regexp_replace(u, "^//?", "")))


def is_playlist(url: Column) -> Column:
    return F.coalesce(F.lower(url).contains(".m3u8"), F.lit(False))


#: Characters before a url that don't belong to it.
BLANK = "".join(map(chr, range(33)))
#: The parts of a url (RFC 3986): scheme, authority with its slashes, path, query and fragment.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
#: A path's last name and the parameters that follow its first semicolon.
PARAMETERS = r"^((?:[^/]*/)*[^/;]*)(;[^/]*)?$"
#: Bases without dots, parameters or empty names in their folders, and names and paths without any. Classes as in text.BREAK.
_NAME, _BLANK = f"{ascii_letters}{digits}_-", r" \t\n\x0b\f\r"
PLAIN_BASE = rf"^(https?://[^/?#;{_BLANK}]+)((?:/[{_NAME}]+)*/)[^/?#;{_BLANK}]*(?:\?[^#{_BLANK}]*)?$"
PLAIN_NAME = rf"^[{_NAME}][.{_NAME}]*$"
PLAIN_ROOTED = rf"^(?:/[{_NAME}][.{_NAME}]*)+$"


def _without_dots(names: Column) -> Column:
    """A path's names with `.` and `..` worked off from the left; `..` at the top goes no further."""

    def step(out: Column, name: Column) -> Column:
        up = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(name == "..", up).when(name == ".", out).otherwise(F.concat(out, F.array(name)))

    done = F.aggregate(names, F.array().cast("array<string>"), step)
    return F.when(F.element_at(names, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)


def _inner(names: Column) -> Column:
    """Names without empty ones between the first and the last."""
    return F.filter(names, lambda name, i: (name != "") | (i == 0) | (i == F.size(names) - 1))


def _path_parts(path: Column) -> tuple[Column, Column]:
    """A path's names and the parameters of the last one, empty if there is but a semicolon."""
    parameters = F.regexp_extract(path, PARAMETERS, 2)
    return F.regexp_extract(path, PARAMETERS, 1), F.when(parameters != ";", parameters).otherwise("")


def _rooted(path: Column) -> Column:
    """A path as it follows an authority."""
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _parts(url: Column) -> Column:
    """Struct of a url's parts; an empty query or fragment is none."""

    def of(u: Column) -> Column:
        scheme, authority, path, query, fragment = [F.regexp_extract(u, PARTS, i) for i in range(1, 6)]

        def named(p: Column) -> Column:
            names, parameters = _path_parts(p)
            return F.struct(
                F.lower(scheme).alias("scheme"), authority.alias("authority"), names.alias("names"), parameters.alias("parameters"),
                F.when(query != "?", query).otherwise("").alias("query"), F.when(fragment != "#", fragment).otherwise("").alias("fragment"),
            )

        return let(path, named)

    return let(F.translate(F.ltrim(url, F.lit(BLANK)), "\t\r\n", ""), of)


def _merged(own: Column, names: Column) -> Column:
    """The path that names mean beside a base's."""

    def below(there: Column) -> Column:
        before = F.when(F.element_at(there, -1) != "", F.slice(there, F.lit(1), F.size(there) - 1)).otherwise(there)
        return let(F.concat(before, F.split(names, "/", -1)), _inner)

    listed = F.when(names.startswith("/"), F.split(names, "/", -1)).otherwise(let(F.split(own, "/", -1), below))
    return let(F.array_join(let(listed, _without_dots), "/"), lambda m: F.when(m == "", "/").otherwise(_rooted(m)))


def join(base: Column, reference: Column) -> Column:
    """The url that a reference means at a base with http or https; as a standard library's join of urls gives it.

    Plain names at plain bases, which most are, need no more than the base's folder or site before them.
    """
    plain = base.rlike(PLAIN_BASE)
    beside, rooted = (F.concat(F.regexp_replace(base, PLAIN_BASE, kept), reference) for kept in ("$1$2", "$1"))
    return F.when(plain & reference.rlike(PLAIN_NAME), beside).when(plain & reference.rlike(PLAIN_ROOTED), rooted).otherwise(_joined(base, reference))


def _joined(base: Column, reference: Column) -> Column:

    def of(b: Column, r: Column) -> Column:
        elsewhere = F.concat(b["scheme"], F.lit(":"), r["authority"], _rooted(F.concat(r["names"], r["parameters"])), r["query"], r["fragment"])
        site = F.concat(b["scheme"], F.lit(":"), b["authority"])
        there = F.concat(site, _rooted(F.concat(b["names"], b["parameters"])), F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"])
        beside = F.concat(site, _merged(b["names"], r["names"]), r["parameters"], r["query"], r["fragment"])
        other = (r["scheme"] != "") & (r["scheme"] != b["scheme"])
        return F.when(other, reference).when(F.length(r["authority"]) > 2, elsewhere).when((r["names"] == "") & (r["parameters"] == ""), there).otherwise(beside)

    return F.when(reference == "", base).otherwise(let(_parts(base), lambda b: let(_parts(reference), lambda r: of(b, r))))


def resolve(base: Column, segment: Column) -> Column:
    """The segment's url; whatever starts with http is taken as it is."""
    return F.when(segment.startswith("http"), segment).otherwise(join(base, segment))


def sanitize_title(title: Column) -> Column:
    return F.substring(strip(F.translate(title, FORBIDDEN, "_" * len(FORBIDDEN))), 1, TITLE_LENGTH)


def output_name(title: Column, full: Column, place: Column) -> Column:
    """The title's or, without one, the place's name for a video."""
    named = F.coalesce(F.nullif(sanitize_title(title), F.lit("")), place.cast("string"))
    return F.concat(named, F.lit("_"), full, F.lit(".mp4"))


def has_traversal(path: Column) -> Column:
    """Whether two dots stand anywhere in a path."""
    return path.contains("..")


def segment_name(idx: Column) -> Column:
    """Five digits at least; longer numbers stay whole."""
    return F.format_string("%05d.ts", idx)
