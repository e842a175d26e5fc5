"""Many ordered patterns in one pass over a text.

Every pattern needs some literal, such as ``gmbh``; one automaton over all those literals
finds which of them a text has, and only the patterns whose literal occurs are tried, in
the order of their list.  Words are found by the same automaton, the longest first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick

_PIECES = re.compile(r"\(\?:.*?\)|\[.*?\]|\\\.\?|\\[bs][*+]?|.[?*+]|\\.|[$^|]|.")


def literal(pattern: str) -> str:
    """The longest run of characters that every match holds, case folded."""
    runs = [""]
    for piece in _PIECES.findall(pattern):
        if len(piece) == 1 and piece not in "$^|.":
            runs[-1] += piece
        elif re.fullmatch(r"\\[^bs\w]", piece):
            runs[-1] += piece[1]
        else:
            runs.append("")
    return max(runs, key=len).casefold()


class Ordered:
    """Patterns with a value each, before words with a value each."""

    def __init__(self, patterns: Iterable[tuple[str, str]], words: Iterable[tuple[str, str]]):
        self.patterns = [(re.compile(p, re.IGNORECASE), v) for p, v in patterns]
        # Longest first; equally long ones stay in order.
        self.words = [(re.compile(rf"\b{re.escape(w)}\b"), v) for w, v in sorted(words, key=lambda x: -len(x[0]))]
        held: dict[str, tuple[list[int], list[int]]] = {}
        for k, (p, _) in enumerate(self.patterns):
            held.setdefault(literal(p.pattern), ([], []))[0].append(k)
        for k, (w, _) in enumerate(sorted(words, key=lambda x: -len(x[0]))):
            held.setdefault(w.casefold(), ([], []))[1].append(k)
        self.machine = ahocorasick.Automaton()
        for text, numbers in held.items():
            self.machine.add_word(text, numbers)
        self.machine.make_automaton()

    def first(self, text: str | None) -> str | None:
        """The value of the first pattern that matches, else of the longest word that occurs; None if none does."""
        if not text:
            return None
        patterns, words = set(), set()
        for _, (some, others) in self.machine.iter(text.casefold()):
            patterns.update(some)
            words.update(others)
        for k in sorted(patterns):
            if self.patterns[k][0].search(text):
                return self.patterns[k][1]
        low = text.lower()
        return next((self.words[k][1] for k in sorted(words) if self.words[k][0].search(low)), None)
