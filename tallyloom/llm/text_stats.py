"""Statistics of one text for the quality classifier; plain functions that run inside Arrow tasks."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

NAMES = (
    "log_words", "word_len", "word_len_spread", "longest_word", "distinct_words", "top_word", "short_words", "alpha_words",
    "symbols", "upper", "digits", "marks", "commas", "bars", "dup_lines", "line_words", "sentence_ends", "repeat_windows", "compressed", "distinct_chars",
)
_UPPER, _DIGITS, _SYMBOLS = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[0-9]+"), re.compile(r"[#*$%&|<>]+")
_MARKS, _COMMAS, _ENDS = re.compile(r"[!?]+"), re.compile(r"[,;:]+"), re.compile(r"[.!?](?=\s|$)")


def _share(pattern: re.Pattern, text: str, n: int) -> float:
    return sum(map(len, pattern.findall(text))) / n


def statistics(text: str) -> list[float]:
    """The numbers of NAMES for a whole text; an empty text has zeros."""
    words = text.split()
    n, n_chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    windows = Counter(zip(words, words[1:], words[2:])) if n > 2 else {}
    raw = text.encode()
    return [
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        len(counts) / n,
        max(counts.values()) / n,
        float((lengths <= 3).mean()),
        sum(c for w, c in counts.items() if w.isalpha()) / n,
        _share(_SYMBOLS, text, n_chars),
        _share(_UPPER, text, n_chars),
        _share(_DIGITS, text, n_chars),
        _share(_MARKS, text, n_chars),
        _share(_COMMAS, text, n_chars),
        text.count("|") / n_chars,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        len(_ENDS.findall(text)) / n,
        sum(c for c in windows.values() if c > 1) / max(1, n - 2),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        len(set(text)) / math.sqrt(n_chars),
    ]
