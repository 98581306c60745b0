"""URL parts, link resolution and file-name templates as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from pulsewake.functions.let import let
from pulsewake.functions.text import empty_to_null, md5_prefix, md5_when_too_long

# Longest file extension (with its dot) that counts as one.
MAX_EXTENSION = 9

# Longest path a save-path template may fill.
MAX_PATH = 260 - 1

# File extensions that are never article pages.
IGNORED_EXTENSIONS = "pdf|docx?|xlsx?|pptx?|epub|jpe?g|png|bmp|gif|tiff|webp|avi|mpe?g|mov|qt|webm|ogg|midi|mid|mp3|wav|zip|rar|exe|apk|css"

_DOMAIN = r"[^/]+\.[^/]+"
_LAST_TWO_LABELS = r"[^/.]+\.[^/.]+$"


def full_domain(url: Column) -> Column:
    """Domain with sub-domains; a leading ``www`` label is removed. Null when there is no dot."""
    return empty_to_null(F.regexp_replace(F.regexp_extract(url, _DOMAIN, 0), "^(www.)", ""))


def registrable_domain(url: Column) -> Column:
    """The last two labels of :func:`full_domain`."""
    return empty_to_null(F.regexp_extract(full_domain(url), _LAST_TWO_LABELS, 0))


def subdomain(url: Column) -> Column:
    """Labels before the registrable domain, with the trailing dot; empty when there are none."""
    return let(full_domain(url), lambda d: F.left(d, F.length(d) - F.length(F.regexp_extract(d, _LAST_TWO_LABELS, 0))))


def start_url(url: Column) -> Column:
    return F.concat(F.lit("http://"), full_domain(url), F.lit("/"))


def directory_string(url: Column) -> Column:
    """Path segments before the file name, joined by ``_``; a trailing slash drops one segment more."""
    domain = full_domain(url)

    def joined(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda p: F.contains(p, domain)), F.lit(True)).cast("int")
        dropped = F.when(F.element_at(parts, -1) == "", 2).otherwise(1)
        return F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts) - at - dropped, F.lit(0))), "_")

    return let(F.split(url, "/"), joined)


def file_name(url: Column) -> Column:
    """Last path segment without its extension (when that has at most nine characters)."""
    last = F.element_at(F.split(url, "/"), -1)
    split = r"^(\.*[^.].*)(\.[^.]*)$"

    def cut(name: Column) -> Column:
        short = F.length(F.regexp_extract(name, split, 2)).between(1, MAX_EXTENSION)
        return F.when(short, F.regexp_extract(name, split, 1)).otherwise(name)

    return let(last, cut)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def json_file_name(url: Column) -> Column:
    return F.concat(F.url_encode(url), F.lit(".json"))


def absolute_url(page_url: Column, link: Column) -> Column:
    """``link`` against ``page_url``; links that start with ``http:/`` stay as they are."""
    scheme = F.regexp_extract(page_url, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    root = F.regexp_extract(page_url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(page_url, "[?#].*$", "")
    folder = F.when(bare.rlike("://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))

    def resolved(target: Column) -> Column:
        return (
            F.when(target.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
            .when(target == "", page_url)
            .when(target.startswith("//"), F.concat(scheme, target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("?"), F.concat(bare, target))
            .when(target.startswith("#"), F.concat(F.regexp_replace(page_url, "#.*$", ""), target))
            .otherwise(F.concat(folder, F.regexp_replace(target, r"^(\./)+", "")))
        )

    return let(link, resolved)


def is_followable(url: Column, ignore: str | None = None) -> Column:
    """False for links that end in an unwanted file extension or match ``ignore``."""
    keep = ~url.rlike(rf"(?i)\.({IGNORED_EXTENSIONS})$")
    return keep & ~url.rlike(ignore) if ignore else keep


def path_safe(path: Column) -> Column:
    """Characters that file systems refuse become ``_``."""
    return F.regexp_replace(path, r'[<>:"|?*]', "_")


def relative_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\.[/\\]", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def constant_base(template: str) -> str:
    """Longest leading folder of a template that holds no placeholder."""
    if "%" not in template:
        return template
    return template[: template.index("%")].rpartition("/")[0]


def save_path(
    template: str,
    url: Column,
    *,
    executed: datetime,
    downloaded: Column,
    working_path: str = ".",
    relative_to: str = "/",
) -> Column:
    """A path per row from a template of ``%name(size)`` placeholders.

    The template is split once, on the driver, into constants and column expressions; the result is one
    ``concat`` per row.
    """
    parts: dict[str, Column] = {
        "domain": registrable_domain(url),
        "full_domain": full_domain(url),
        "subdomains": subdomain(url),
        "url_directory_string": directory_string(url),
        "url_file_name": file_name(url),
    }
    shapes: dict[str, Callable[[Column, int], Column]] = {
        "": lambda text, size: F.substring(text, 1, size),
        "appendmd5_": md5_when_too_long,
        "md5_": md5_prefix,
    }
    executed_utc = executed.replace(tzinfo=timezone.utc)
    pieces: list[Column | str] = []
    for token in re.split(r"(%[a-z0-9_]+(?:\([^)]+\))?)", template):
        match = re.fullmatch(r"%([a-z0-9_]+?)(?:\(([^)]+)\))?", token)
        name, argument = match.groups() if match else (None, None)
        shape = next((s for s in ("appendmd5_", "md5_") if name and name.startswith(s)), "")
        base = name[len(shape):] if name else ""
        if name == "working_path":
            pieces.append(F.lit(working_path))
        elif name == "timestamp_execution":
            pieces.append(F.lit(str(int(executed_utc.timestamp()))))
        elif name == "time_execution":
            pieces.append(F.lit(executed_utc.strftime(argument)))
        elif name == "timestamp_download":
            pieces.append(F.unix_timestamp(downloaded.cast("timestamp")).cast("string"))
        elif name == "time_download":
            pieces.append(F.date_format(downloaded, _strftime_pattern(argument)))
        elif base in parts and argument:
            pieces.append(shapes[shape](parts[base], int(argument)))
        elif base == "max_url_file_name":
            pieces.append("max:" + shape)
        elif token:
            pieces.append(F.lit(token))
    return path_safe(_fill_longest(pieces, parts["url_file_name"], template, relative_to))


def _fill_longest(pieces: list[Column | str], name: Column, template: str, relative_to: str) -> Column:
    """Give every ``max_url_file_name`` an equal share of what the path limit leaves."""
    fixed = [p for p in pieces if isinstance(p, Column)]
    longest = sum(isinstance(p, str) for p in pieces)
    prefix = 0 if template.startswith("/") else len(relative_to.rstrip("/")) + 1
    if longest == 0:
        return F.concat(*fixed)
    room = F.lit(MAX_PATH - prefix) - (F.length(F.concat(*fixed)) if fixed else F.lit(0))
    share = F.greatest(F.floor(room / longest).cast("int"), F.lit(0))
    shaped = {"max:": F.left(name, share), "max:appendmd5_": md5_when_too_long(name, share)}
    return F.concat(*[shaped[p] if isinstance(p, str) else p for p in pieces])


# Strftime codes and the matching date_format letters.
_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def _strftime_pattern(codes: str) -> str:
    out = ""
    for piece in re.split(r"(%[A-Za-z])", codes):
        quoted = "'" + piece.replace("'", "''") + "'" if piece else ""
        out += _STRFTIME.get(piece, quoted)
    return out
