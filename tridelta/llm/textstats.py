"""Statistics of one whole text, shared by the quality operators."""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from operator import eq

from .common import words_of

SYMBOLS = "#*$%&|<>"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[0-9]")
_ODD_WORD = re.compile(r"[#*$%&|<>]|^[\W_]+$")
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def repeated_words(words: list[str], n: int = 5) -> int:
    """Words that lie in an ``n``-word window which occurs more than once."""
    windows = list(zip(*(words[k:] for k in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = covered = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + n - max(at, covered)
            covered = at + n
    return total


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    return len(lines), len(lines) - len(set(lines))


class TextStats:
    """Counts of a text; empty for null."""

    def __init__(self, text: str | None):
        text = text or ""
        words = words_of(text)
        self.words = words
        self.n_words = len(words)
        self.n_chars = len(text)
        self.word_chars = sum(map(len, words))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        self.n_lines, self.n_dup_lines = line_counts(text)
        self.n_repeat_words = repeated_words(words)
        self.letters = len(_LETTER.findall(text))
        self.upper = len(_UPPER.findall(text))
        self.digits = len(_DIGIT.findall(text))
        self.exclaims = text.count("!")
        self.stops = text.count(".") + text.count("?") + self.exclaims
        self.commas = text.count(",") + text.count(";")
        self.distinct = len(set(words))
        self.odd_words = sum(1 for w in words if _ODD_WORD.search(w))
        self.stutters = sum(map(eq, words, words[1:]))
        self.top = max(Counter(words).values(), default=0)

    def features(self) -> list[float]:
        """Document statistics for a classifier, each of moderate range."""
        n, chars, letters = max(1, self.n_words), max(1, self.word_chars), max(1, self.letters)
        lengths = [len(w) for w in self.words]
        mean = self.word_chars / n
        spread = sqrt(sum((x - mean) ** 2 for x in lengths) / n) if lengths else 0.0
        return [log(1 + self.n_words), mean, spread, log(1 + self.n_lines),
                sqrt(self.n_symbols / n), self.n_dup_lines / max(1, self.n_lines), self.n_repeat_words / n,
                self.upper / letters, self.letters / chars, self.digits / chars, sqrt(self.exclaims / n),
                sqrt(self.stops / n), sqrt(self.commas / n), self.distinct / n, self.top / n,
                log(1 + n / max(1, self.stops))]


N_FEATURES = 16
