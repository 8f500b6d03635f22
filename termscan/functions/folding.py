"""Case folding shared by term matching and hint matching.

Terms are found case-insensitively with Unicode simple casing, the meaning of
the regex flags ``(?iu)``.  Rather than running one case-insensitive regex per
term over every text, each text is folded once and all terms are compared
with plain byte search.  Folding keeps one code point per code point, so a
position in the folded text is the same position in the original.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The only character whose lower case is two code points; it folds to "i".
DOTTED_CAPITAL_I = "İ"


@lru_cache(maxsize=1)
def case_variants() -> dict[str, str]:
    """Characters that ``lower`` leaves apart from their case-insensitive equal.

    Two characters are equal under ``(?iu)`` when ``lower(upper(c))`` agrees;
    listed are those for which plain ``lower`` says otherwise (long s, dotless
    i, final sigma, the micro sign and so on).
    """
    variants = {}
    for char in map(chr, range(0x10000)):
        upper = char.upper()
        if len(upper) == 1 and len(upper.lower()) == 1 and upper.lower() != char.lower():
            variants[char] = upper.lower()
    return variants


def fold_string(value: str) -> str:
    """Fold a driver-side string the way :func:`folded` folds a column."""
    variants = case_variants()
    chars = ("i" if c == DOTTED_CAPITAL_I else c.lower() for c in value)
    return "".join(variants.get(c, c) for c in chars)


def folded(text: Column, alphabet: Iterable[str]) -> Column:
    """Folded text, exact for needles written in ``alphabet``.

    Only variants of letters that occur in the needles are replaced, which
    keeps the expression to a few byte searches for a Latin vocabulary.  The
    result is never null, so no null check re-evaluates the folding.
    """
    wanted = set(alphabet)
    out = F.lower(F.replace(text, F.lit(DOTTED_CAPITAL_I), F.lit("i")))
    for variant, canonical in case_variants().items():
        if canonical in wanted:
            out = F.replace(out, F.lit(variant), F.lit(canonical))
    return F.coalesce(out, F.lit(""))
