"""Bucket of a text: does it look planned, like code, both or neither?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termscan.functions.folding import fold_string
from termscan.functions.patterns import ignore_case, is_blank, literal_alternatives

UNKNOWN, PLANNED, CODE, OVERLAP = "Unknown", "Planned", "Code", "Overlap"


def hint_alphabet(*patterns: str | None) -> set[str]:
    """Folded letters needed to test the literal hints among ``patterns``."""
    words = [w for p in patterns if not is_blank(p) for w in literal_alternatives(p) or ()]
    return set(fold_string("".join(words)))


def has_hint(text: Column, folded_text: Column, pattern: str | None) -> Column:
    """Whether ``pattern`` occurs in any case; a blank pattern never does.

    A plain list of words, the usual form of a hint, is looked up in the
    folded text; any other pattern runs as a regex on the text.
    """
    if is_blank(pattern):
        return F.lit(False)
    words = literal_alternatives(pattern)
    if words is None:
        return F.rlike(text, F.lit(ignore_case(pattern)))
    found = F.lit(False)
    for word in words:
        found = found | F.contains(folded_text, F.lit(fold_string(word)))
    return found


def bucket(planned: Column, code: Column) -> Column:
    return (
        F.when(planned & code, F.lit(OVERLAP))
        .when(planned, F.lit(PLANNED))
        .when(code, F.lit(CODE))
        .otherwise(F.lit(UNKNOWN))
    )
