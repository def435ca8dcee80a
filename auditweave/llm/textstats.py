"""Statistics of whole texts for the quality rules and classifiers.

Words are runs outside space and ``\\t``..``\\r``; lines are split at ``\\n``. An empty or null text has zero everywhere.
"""

from __future__ import annotations

import math

import numpy as np

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = bytes([*range(65, 91), *range(97, 123)])
#: Counts in contract order, then the ratios that rules and trees look at.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["log_words", "word_length", "symbols_per_word", "bangs_per_word", "upper_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "words_per_line"]
#: With so many distinct words or fewer, five word numbers fit one 64-bit integer.
EXACT = int((2**63) ** 0.2)


def repeated_words(ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """Words covered by windows of ``width`` words that the text has twice or more, first occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code, base = ids[:n].copy(), max(distinct, 1)
    for k in range(1, width):
        if base > EXACT:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * base + ids[k : n + k]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice))
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(data.count(b) for b in BLANKS)
    symbols = sum(data.count(b) for b in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dups = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeats = repeated_words(ids, len(number))
    letters = len(data) - len(data.translate(None, LETTERS))
    over = max(n, 1)
    ratios = [
        math.log1p(n), chars / over, symbols / over, data.count(b"!") / over, (len(data) - len(data.translate(None, UPPER))) / max(letters, 1), (len(data) - len(data.translate(None, DIGITS))) / max(len(data), 1),
        dups / max(len(lines), 1), repeats / over, len(number) / over, (int(np.bincount(ids).max()) if n else 0) / over, n / max(len(lines), 1),
    ]
    return [n, chars, symbols, dups, repeats], ratios
