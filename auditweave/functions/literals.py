"""Literals that a regular expression cannot match without, as a cheap test before the expression runs."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose case folds beyond ASCII too (the long s, the Kelvin sign, the dotted and dotless i): no literal crosses them.
FOLDED = "iks"
#: More branches than this cost more than they save.
MOST_BRANCHES = 12


def _from(items, cased: bool) -> tuple[str, ...]:
    """Alternatives of which a match contains one; empty if nothing is certain."""
    run, best = "", ()
    worth = lambda alternatives: min(map(len, alternatives), default=0)
    for op, value in [*items, (None, None)]:
        letter = chr(value) if str(op) == "LITERAL" else ""
        if letter and not letter.isspace() and (cased or (letter.isascii() and letter.lower() not in FOLDED)):
            run += letter
            continue
        if len(run) > worth(best):
            best = (run,)
        run, inner = "", ()
        if str(op) == "SUBPATTERN":
            inner = _from(value[3], cased)
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            inner = _from(value[2], cased)
        elif str(op) == "BRANCH":
            each = [_from(b, cased) for b in value[1]]
            inner = tuple(dict.fromkeys(x for e in each for x in e)) if all(each) and sum(map(len, each)) <= MOST_BRANCHES else ()
        if inner and worth(inner) > worth(best):
            best = inner
    return best


@lru_cache(maxsize=4096)
def needed(pattern: str, cased: bool) -> tuple[str, ...]:
    """Literals of which every match contains one, lower-cased where case is ignored; empty if there are none worth a test.

    Patterns with flags of their own have none; nor has a blank, since a code view has more of them than its text."""
    if re.search(r"\(\?[a-zA-Z-]", pattern):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ()
    found = tuple(x if cased else x.lower() for x in _from(tree, cased))
    return found if all(len(x) > 1 or not x.isalnum() for x in found) else ()  # single letters are in nearly every text


def possible(text: Column, lowered: Column, pattern: str, cased: bool) -> Column | None:
    """Whether the text has one of the literals; None if the pattern has no such literals."""
    test = None
    for x in needed(pattern, cased):
        one = F.contains(text if cased else lowered, F.lit(x))
        test = one if test is None else test | one
    return test
