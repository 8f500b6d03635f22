"""Path expressions: separators, base name, extension, owning repository."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from termscan.functions.patterns import escape, ignore_case

# Two letters at least, so that a drive such as "C:" is no scheme.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?(?=/)"

_PERCENT_VAR = re.compile(r"%([^%]+)%")
_SHELL_VAR = re.compile(r"\$\(\$env:(\w+)\)|\$env:(\w+)")


def expand_env(path: str) -> str:
    """Expand ``%NAME%`` and ``$env:NAME``; unknown names stay as written."""

    def value(match: re.Match) -> str:
        name = next(group for group in match.groups() if group)
        return os.environ.get(name, match.group(0))

    return _SHELL_VAR.sub(value, _PERCENT_VAR.sub(value, path))


def normalize_extensions(patterns: Iterable[str]) -> list[str]:
    """``*.md``, ``.md`` and ``md`` all become ``.md``, lower case, once."""
    names = (p.strip().lower().lstrip("*").lstrip(".") for p in patterns)
    return list(dict.fromkeys("." + name for name in names if name))


def slashes(path: Column) -> Column:
    """Path with ``/`` as the only separator."""
    return F.translate(path, "\\", "/")


def without_scheme(path: Column) -> Column:
    """Drop ``file:``, ``hdfs://host`` and the like in front of an absolute path."""
    return F.regexp_replace(path, SCHEME, "")


def plain_path(path: str) -> str:
    """The same for a driver-side string."""
    return re.sub(SCHEME, "", path)


def base_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix of the base name with its dot, or ``''``."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def _under(root: str) -> str:
    """Regex of ``root`` up to and including the separators that end it.

    A root ends at a separator: ``/a`` owns ``/a/x`` but not ``/ab/x``.
    """
    return escape(root.rstrip("/\\")) + r"[/\\]+"


def is_below(path: Column, root: str) -> Column:
    """Whether ``path`` lies under ``root``, in any case."""
    return F.rlike(path, F.lit(ignore_case(f"^{_under(root)}[^/\\\\]")))


def first_root(path: Column, roots: Sequence[str]) -> Column:
    """The first listed root above ``path``, null when there is none."""
    matches = [F.when(is_below(path, root), F.lit(root)) for root in roots]
    return F.coalesce(*matches) if matches else F.lit(None).cast("string")


def repo_name(path: Column, roots: Sequence[str]) -> Column:
    """First path segment below the first matching root.

    A blank segment reads ``(root)``.  Without a matching root it is the third
    part of the path, or the last one if there are fewer.
    """
    parts = F.split(path, r"[/\\]")
    fallback = F.get(parts, F.least(F.size(parts) - 1, F.lit(2)))
    if not roots:
        return fallback
    # Alternatives are tried in order, so the first root that fits decides.
    above = "|".join(map(_under, roots))
    segment = F.regexp_extract(path, ignore_case(rf"^(?:{above})([^/\\]+)"), 1)
    return F.when(segment == "", fallback).when(F.trim(segment) == "", F.lit("(root)")).otherwise(segment)
