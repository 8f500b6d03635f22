"""Driver-side regex helpers: escaping, glob rules, hint patterns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Case-insensitive with Unicode letters; "(?i)" alone is ASCII only in Java.
IGNORE_CASE = "(?iu)"

_META = re.compile(r"([\\.^$|?*+()\[\]{}])")
_GLOB_TOKEN = re.compile(r"\*\*|\*|\?|[^*?]+")
_LITERAL_ALTERNATIVES = re.compile(r"(?:\(\?i\))?([^\\.^$|?*+()\[\]{}]+(?:\|[^\\.^$|?*+()\[\]{}]+)*)")


def escape(literal: str) -> str:
    """Regex matching ``literal`` and nothing else."""
    return _META.sub(r"\\\1", literal)


def is_blank(value: str | None) -> bool:
    return value is None or not value.strip()


def ignore_case(pattern: str) -> str:
    return IGNORE_CASE + pattern


def glob_regex(glob: str) -> str:
    """Unanchored regex of a path glob.

    ``**`` crosses separators, ``*`` and ``?`` stay within one segment, and
    everything else, brackets included, is literal.
    """
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(wild.get(token) or escape(token) for token in _GLOB_TOKEN.findall(glob))


def parse_rules(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """Ignore lines to ``(glob, negated)`` in order; blanks and ``#`` dropped."""
    rules = []
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            rules.append((line[1:].strip() if negated else line, negated))
    return rules


def rule_runs(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """Merge neighbouring rules of the same sign into one anchored regex each.

    The last matching rule decides, so rules of equal sign next to each other
    can share one alternation without changing the verdict.
    """
    runs: list[tuple[list[str], bool]] = []
    for glob, negated in parse_rules(lines):
        if not runs or runs[-1][1] != negated:
            runs.append(([], negated))
        runs[-1][0].append(glob_regex(glob))
    return [(ignore_case(f"^(?:{'|'.join(globs)})$"), negated) for globs, negated in runs]


def literal_alternatives(pattern: str) -> list[str] | None:
    """The words of a pattern such as ``plan|todo|spec``, else ``None``."""
    match = _LITERAL_ALTERNATIVES.fullmatch(pattern)
    return match.group(1).split("|") if match else None


def longest_match(pattern: str) -> int | None:
    """A bound of what ``pattern`` can match, in characters; ``None`` without one.

    There is none either for a pattern that looks at what surrounds a match
    (anchors, word boundaries, lookaround).  What is not understood counts as
    such: the answer may be ``None`` without need, but a bound always holds.
    """
    if any((c.isalnum() or c == "_") and c not in "dDwWsS" for c in re.findall(r"\\(.)", pattern, re.DOTALL)):
        return None
    plain = re.sub(r"\\.", "x", pattern, flags=re.DOTALL)
    if re.search(r"[\^$*+]|\(\?(?!:)|\{\d+,\}|&&", plain):
        return None
    times = [int(n) for n in re.findall(r"\{(?:\d+,)?(\d+)\}", plain)]
    return len(pattern) * math.prod(n for n in times if n)


_usable: dict[str, bool] = {}


def usable_pattern(spark: SparkSession, pattern: str | None) -> str | None:
    """``pattern`` if the engine can compile it, ``None`` if blank or invalid.

    A hint that cannot be compiled matches nothing.  The probe is a constant
    expression, so no job is started; its verdict is remembered by pattern.
    """
    if is_blank(pattern):
        return None
    if pattern not in _usable:
        try:
            spark.sql("SELECT '' RLIKE :rx", {"rx": ignore_case(pattern)}).collect()
            _usable[pattern] = True
        except PySparkException:
            _usable[pattern] = False
    return pattern if _usable[pattern] else None
