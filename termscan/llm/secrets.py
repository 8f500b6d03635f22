"""Secrets in texts: fixed patterns, and values whose guessing would cost too much.

Three patterns give the base spans.  Beside them every value in a credential
context (a name such as ``password`` or ``auth``, then a separator) is priced:
the cheapest way to cut it into dictionary words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming, is the number of
guesses an attacker needs.  Values from ``LEAST_GUESSES`` on (a power of ten)
that no base span holds become ``guess`` spans.

The dictionary is learned from the corpus: words are counted over all texts,
outside base spans and context values, and ranked by count.  It holds at most
``DICTIONARY_WORDS`` words, which is a parameter of the model and bounds what
is broadcast; words of equal count are taken together or not at all.

A span is that of a whole match (for ``guess``, of the value), in code points,
end exclusive.  Defined cases: null and empty texts have no spans; texts and
values of any length are taken whole; repeated rows get equal results; null
ids are returned; on an empty table or without words the dictionary is empty;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.storage import stored

# The base patterns, and the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more: shorter ones would fail
LEAST_ASSIGN = 8
LEAST_ACCESS = 16
KINDS = ("assign", "access", "hex", "guess")

# Names of credentials, a separator, and a value without space, quotes or brackets.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key|auth)"""
    r"""["']?\x20*(?:=>|:=|[:=])\x20*["']?([^\x00-\x20\x7f"'<>,;(){}\[\]]+)""", re.IGNORECASE | re.ASCII
)
# Each match of the two holds one of these.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth")
WORD = re.compile(r"[^\W\d_]{3,24}")
SHORTEST_WORD, LONGEST_WORD = 3, 24

DICTIONARY_WORDS = 50_000
LEAST_GUESSES = 10.0
# A task sends its counts on when it holds so many words.
HELD_WORDS = 200_000

# The rows of a keyboard, plain and with shift.
KEYBOARD = (("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"), ("~!@#$%^&*()_+", "QWERTYUIOP{}|", "ASDFGHJKL:\"", "ZXCVBNM<>?"))
# How far to the right a row begins, in half keys.
ROW_STARTS = (0, 3, 4, 5)

KEYS = 94
STEPS = 6  # keys beside a key
LONGEST_UNIT = 12
YEARS = 200
# The choice of a kind of span: words, dates, repeats, walks or brute force.
CHOICE = math.log10(5)

_PLACES = {key: (r, 2 * c + ROW_STARTS[r]) for rows in KEYBOARD for r, row in enumerate(rows) for c, key in enumerate(row)}
_DATES = (
    (re.compile(r"(?P<y>\d{4})(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<d>\d\d)", re.ASCII), False),
    (re.compile(r"(?P<d>\d\d)(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<y>\d{4})", re.ASCII), False),
    (re.compile(r"(?P<m>\d\d)(?P<s>[-/._]?)(?P<d>\d\d)(?P=s)(?P<y>\d{4})", re.ASCII), False),
    (re.compile(r"(?P<d>\d\d?)(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<y>\d\d)", re.ASCII), True),
    (re.compile(r"(?P<y>(?:19|20)\d\d)(?P<s>)(?P<m>)(?P<d>)", re.ASCII), False),
)


def _char_cost(char: str) -> float:
    if not char.isascii():
        return 2.0
    if char.isdigit():
        return 1.0
    return math.log10(26 if char.isalpha() else 33)


def _case_cost(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if upper == 0:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return math.log10(2)
    return math.log10(2 * math.comb(len(word), upper))


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to the next, if they lie side by side."""
    if a not in _PLACES or b not in _PLACES:
        return None
    (r, c), (s, d) = _PLACES[a], _PLACES[b]
    down, right = s - r, d - c
    return (down, right) if (down == 0 and abs(right) == 2) or (abs(down) == 1 and abs(right) <= 2) else None


class Guesser:
    """Prices values by a dictionary of word -> rank, from 1."""

    def __init__(self, ranks: dict[str, int]) -> None:
        self.ranks = ranks

    def _words(self, value: str, i: int) -> Iterator[tuple[int, float]]:
        end = i
        while end < len(value) and end < i + LONGEST_WORD and value[end].isalpha():
            end += 1
            if end - i >= SHORTEST_WORD:
                rank = self.ranks.get(value[i:end].lower())
                if rank:
                    yield end, math.log10(rank) + _case_cost(value[i:end])

    @staticmethod
    def _dates(value: str, i: int) -> Iterator[tuple[int, float]]:
        if not value[i].isdigit():
            return
        for pattern, short in _DATES:
            found = pattern.match(value, i)
            if not found:
                continue
            if not found["m"]:
                yield found.end(), math.log10(YEARS)
            elif 1 <= int(found["m"]) <= 12 and 1 <= int(found["d"]) <= 31 and (short or 1900 <= int(found["y"]) < 1900 + YEARS):
                yield found.end(), math.log10(365 * (100 if short else YEARS)) + (math.log10(4) if found["s"] else 0.0)

    @staticmethod
    def _walks(value: str) -> list[tuple[int, int]]:
        """For each place the end of the longest walk from it, and the turns up to each place."""
        n = len(value)
        steps = [_step(a, b) for a, b in zip(value, value[1:])]
        turns = [0] * n
        for i in range(1, n - 1):
            turns[i] = turns[i - 1] + (steps[i] != steps[i - 1])
        ends = list(range(1, n + 1))
        for i in range(n - 2, -1, -1):
            if steps[i] is not None:
                ends[i] = ends[i + 1]
        return [(end, 1 + turns[end - 2] - turns[i] if end - i >= 3 else 0) for i, end in enumerate(ends)]

    def _repeats(self, value: str) -> list[list[int]]:
        """For each length of unit, from each place the characters that equal those a unit later."""
        n = len(value)
        out = []
        for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
            equal = [0] * (n + 1)
            for i in range(n - unit - 1, -1, -1):
                equal[i] = equal[i + 1] + 1 if value[i] == value[i + unit] else 0
            out.append(equal)
        return out

    def spans(self, value: str, repeats: bool = True) -> Iterator[list[tuple[int, float]]]:
        """For each place the spans from it, but for brute force: their ends and prices."""
        walks = self._walks(value)
        equal = self._repeats(value) if repeats else []
        units: dict[str, float] = {}
        for i in range(len(value)):
            out = [*self._words(value, i), *self._dates(value, i)]
            end, turns = walks[i]
            if turns:
                length = end - i
                out.append((end, math.log10(KEYS) + math.log10(length) + turns * math.log10(STEPS) + (turns - 1) * math.log10(length)))
            for unit, matches in enumerate(equal, 1):
                times = 1 + matches[i] // unit  # the most whole units from here
                if times > 1:
                    text = value[i : i + unit]
                    if text not in units:
                        units[text] = self.log_guesses(text, repeats=False)
                    out.append((i + unit * times, units[text] + math.log10(times)))
            yield out

    def log_guesses(self, value: str, repeats: bool = True) -> float:
        """The power of ten of the guesses that the cheapest cut of the value takes."""
        n = len(value)
        known = [math.inf] * (n + 1)  # the last span is not brute force
        brute = [math.inf] * (n + 1)
        known[0] = 0.0
        for i, spans in enumerate(self.spans(value, repeats)):
            here = min(known[i], brute[i])
            for end, price in spans:
                known[end] = min(known[end], here + CHOICE + price)
            brute[i + 1] = min(known[i] + CHOICE, brute[i]) + _char_cost(value[i])
        return min(known[n], brute[n])


def _holds(low: str, hints: tuple[str, ...]) -> bool:
    return any(hint in low for hint in hints)


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and kind."""
    found = []
    if _holds(text.lower() if low is None else low, ASSIGN_HINTS):
        found += [(m.start(), m.end(), KINDS[0]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), KINDS[1]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), KINDS[2]) for m in HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def context_values(text: str, low: str | None = None) -> list[tuple[int, int]]:
    """Start and end of the values in credential contexts, without points at their end."""
    if not _holds(text.lower() if low is None else low, CONTEXT_HINTS):
        return []
    out = []
    for found in CONTEXT.finditer(text):
        start, end = found.span(1)
        while end > start and text[end - 1] in ".:":
            end -= 1
        if end > start:
            out.append((start, end))
    return out


def _counter():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if not text:
                    continue
                low = text.lower()
                spans = [(s, e) for s, e, _ in base_spans(text, low)] + context_values(text, low)
                if spans:
                    parts, at = [], 0
                    for start, end in sorted(spans):
                        parts.append(text[at:start])
                        at = max(at, end)
                    low = " ".join([*parts, text[at:]]).lower()
                counts.update(WORD.findall(low))
                if len(counts) >= HELD_WORDS:
                    yield flush()
        if counts:
            yield flush()

    return count


def dictionary(documents: DataFrame, most: int = DICTIONARY_WORDS) -> dict[str, int]:
    """The most frequent words outside secrets, with their ranks; at most ``most`` reach the driver."""
    texts = documents.select(F.col("text").cast("string"))
    words = stored(texts.mapInArrow(_counter(), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.floor(F.log2("n") * 64).cast("int")  # some thousand steps at most
    steps = words.groupBy(step.alias("step")).count().collect()
    held, least = 0, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    if least is None:
        return {}
    chosen = sorted(words.where(step >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    return {row["word"]: rank for rank, row in enumerate(chosen, 1)}


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(text: str | None, guesser: Guesser, least: float = LEAST_GUESSES) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans of a text, and all its spans, by start and kind."""
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    added = []
    for start, end in context_values(text, low):
        if any(s <= start and end <= e for s, e, _ in base):
            continue
        if guesser.log_guesses(text[start:end]) >= least:
            added.append((start, end, KINDS[3]))
    return base, sorted(base + added, key=_place)


def _finder(shared, least: float):
    names = ["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(shared.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = secret_spans(text.as_py(), guesser, least)
                counts = Counter(kind for _, _, kind in every)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(counts[k] for k in KINDS[:3]), digest, _joined(every), counts[KINDS[3]]))
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return find


def find_secrets(documents: DataFrame, words: int = DICTIONARY_WORDS, least: float = LEAST_GUESSES, row_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess``, one row per document."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionary(documents, words))
    rows = documents.select(F.col(row_id).alias("_id"), F.col("text").cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return rows.mapInArrow(_finder(shared, least), schema).withColumnRenamed("_id", row_id)
