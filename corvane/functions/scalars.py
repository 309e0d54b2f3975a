"""Scalar expressions: paths, JSON cells, validity checks, versions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
#: Date, any separator, time to hours, minutes or seconds, and an offset of nothing; extended or basic form.
UTC = r"^(\d{4}-?\d{2}-?\d{2})[^0-9](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?(?:Z|[+-]00(?::?00(?::?00(?:\.0+)?)?)?)$"


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.regexp_replace(F.lit(p) if isinstance(p, str) else p, "/+$", "") for p in parts])


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def suffixes(path: Column) -> Column:
    """All endings of the file name, in order; none for a name without, or with a leading dot only."""
    return F.regexp_extract_all(F.regexp_replace(file_name(path), r"^\.+", ""), F.lit(r"(\.[^.]+)"), 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scheme(path: Column) -> Column:
    """The scheme with its slashes, as gs://, or the empty string."""
    return F.regexp_extract(path, r"^([a-z0-9]+://)", 1)


def bucket(path: Column) -> Column:
    """The bucket of a cloud path; empty for a local one."""
    return F.regexp_extract(path, r"^[a-z0-9]+://([^/]*)", 1)


def parts(path: Column) -> Column:
    """The parts of a path: for a cloud path the scheme with the bucket first, for an absolute one the slash."""
    head = F.regexp_extract(path, r"^([a-z0-9]+://[^/]*|/)", 1)
    rest = F.filter(F.split(F.substring(path, F.length(head) + 1, F.length(path)), "/+"), lambda x: (x != "") & (x != "."))
    return F.when(path.isNotNull(), F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), rest))


def _of_parts(some: Column) -> Column:
    joined = F.array_join(some, "/")
    return F.regexp_replace(joined, "^//", "/")


def parents(path: Column) -> Column:
    """All parents, the nearest first; the root or the bucket is the last."""
    p = parts(path)
    return F.transform(F.when(F.size(p) > 1, F.sequence(F.size(p) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda n: _of_parts(F.slice(p, F.lit(1), n)))


def with_name(path: Column, name: Column | str) -> Column:
    return F.concat(F.regexp_replace(path, "[^/]*$", ""), F.lit(name) if isinstance(name, str) else name)


def with_stem(path: Column, new: Column | str) -> Column:
    return with_name(path, F.concat(F.lit(new) if isinstance(new, str) else new, suffix(path)))


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(new))


def matches(path: Column, pattern: str) -> Column:
    """Whether the last parts of a path match a glob of *, ?, [..] within parts and ** over parts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inside = pattern[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", close + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return path.rlike(f"(?:^|/){out}$")


def s3_path(path: Column) -> Column:
    """A path of the scheme r2 as the s3 path that connectors read."""
    return F.regexp_replace(path, "^r2://", "s3://")


def https_url(path: Column) -> Column:
    """The https address of an object of a gs path, with or without scheme; everything but letters, digits, _.-~ and slashes is percent-encoded.

    A path of s3 or r2 has none, and gives an error.
    """
    plain = F.regexp_replace(F.regexp_replace(path, "^gs://", ""), "^/+", "")
    quoted = plain
    # the form encoding of the JVM, mended where it differs from that of paths
    for wrong, right in ((r"\+", "%20"), ("%2F", "/"), ("%7E", "~"), (r"\*", "%2A")):
        quoted = F.regexp_replace(F.url_encode(plain) if quoted is plain else quoted, wrong, right)
    refused = F.raise_error(F.concat(F.lit("Unsupported storage scheme in path: "), path))
    return F.when(path.rlike("^(s3|r2)://"), refused).otherwise(F.concat(F.lit("https://storage.googleapis.com/"), quoted))


def with_folder(path: Column, folder: str) -> Column:
    """The path under a folder, which is put in front unless it is there."""
    return F.when(path.startswith(folder + "/"), path).otherwise(F.concat(F.lit(folder + "/"), path))


def replace_once(path: Column, old: str, new: str) -> Column:
    """The first occurrence of a token replaced; a path without it as it is."""
    at = F.instr(path, old)
    return F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(new), F.substring(path, at + len(old), F.length(path)))).otherwise(path)


def split_pick(text: Column, sep: str, place: int) -> Column:
    """One part of a text cut at a separator, counted from 0 or from the end; null beyond."""
    cells = F.split(text, f"\\Q{sep}\\E")
    return F.get(cells, F.lit(place) if place >= 0 else F.size(cells) + place)


def json_value(cell: Column, path: str, kind: str = "string") -> Column:
    """A scalar of a JSON cell; null where it is missing, malformed or of another kind."""
    return F.get_json_object(cell, path).try_cast(kind)


def number_of(text: Column, kind: str = "bigint", default: float | None = None) -> Column:
    """A number from text; what is none gives the default, or null."""
    value = F.trim(text).try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def json_list(cell: Column) -> Column:
    """A JSON array in a cell -> its strings; blank, null and malformed cells give none."""
    return F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))


def is_semver(c: Column) -> Column:
    return c.rlike(SEMVER)


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def is_utc(c: Column) -> Column:
    """Whether a cell is an ISO 8601 date and time that exists, with an offset of zero. Week dates are not read."""
    part = lambda i: F.regexp_extract(c, UTC, i)
    day = F.try_to_timestamp(F.regexp_replace(part(1), "-", ""), F.lit("yyyyMMdd"))
    small = lambda i, n: (part(i) == "") | (part(i).try_cast("int") < n)
    same = F.regexp_replace(part(1), "-", "") == F.date_format(day, "yyyyMMdd")
    return c.rlike(UTC) & F.coalesce(same, F.lit(False)) & small(2, 24) & small(3, 60) & small(4, 60)


def is_json(c: Column) -> Column:
    """Whether a cell holds a JSON value; null for null. A blank cell holds none."""
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull())


def utc_now() -> Column:
    """The time of the query in UTC as ISO 8601 text, the same in every row."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def make_id() -> Column:
    """A random UUID per row. Not repeatable: write the table before reading it twice."""
    return F.expr("uuid()")


def bump(version: str, part: str) -> str:
    """The next major, minor or patch version."""
    if not re.match(SEMVER, version):
        raise ValueError(f"not a version: {version!r}")
    major, minor, patch = map(int, version.split("."))
    steps = {"major": (major + 1, 0, 0), "minor": (major, minor + 1, 0), "patch": (major, minor, patch + 1)}
    if part not in steps:
        raise ValueError(f"unknown part {part!r}")
    return ".".join(map(str, steps[part]))


def chosen_path(original: str, by_rate: str | None) -> Column:
    """The path of the wanted rate where it is not blank, else the original."""
    if by_rate is None:
        return F.col(original)
    return F.coalesce(F.nullif(F.trim(by_rate), F.lit("")), F.col(original))


def available_rates(columns: list[str], paths: dict[int, str], checked: bool = True) -> list[int]:
    """Sample rates with a path column of their own, ascending; unchecked, all that are configured."""
    return sorted(rate for rate, name in paths.items() if not checked or name in columns)
